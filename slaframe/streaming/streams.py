"""Structured Streaming jobs over file sources.

* ``ingest_once``: event files into a date-partitioned table, every event id
  once. Of rows that share an id the least one stays, whatever files and
  micro-batches they come in. ``stream_ingest`` is the variant with bounded state.
* ``stream_kpis``: daily tumbling counts per event type with a watermark;
  append mode emits a day once the watermark passes its end, and rows later
  than the watermark are dropped. ``event_balance`` accounts for every row.
* ``score_stream``: arriving tickets are scored by a saved model and get
  priority and urgency; each micro-batch owns a folder, so a repeated batch
  replaces itself. ``stream_score`` is the same with the propensity formula.

State and progress live in the checkpoint location (a folder under the
session's checkpoint dir), so a restarted query resumes where it stopped
and a lost executor only replays its tasks. ``run_available`` drives a query
with ``trigger(availableNow=True)``: it processes everything present and
stops, which is how the tests and the driver queries run streams to the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import dims
from ..functions.exprs import priority_formula
from ..operators import enrich, model, urgency
from ..session import path_kind
from ..sources.files import load_model

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
EVENT_COLUMNS = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
SEEN_SCHEMA = ("event_id bigint, r struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>, "
               "bucket int, batch bigint")
ID_BUCKETS = 16
_EPOCH = "1970-01-01 00:00:00"


def ntz_to_instant(c: Column) -> Column:
    """Zone-free NTZ -> TIMESTAMP as if the wall time were UTC (watermarks
    and windows need TIMESTAMP; a plain cast would depend on the session
    time zone)."""
    micros = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), c)
    return F.timestamp_micros(micros)


def instant_to_ntz(c: Column) -> Column:
    """Inverse of ``ntz_to_instant``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit(_EPOCH).cast("timestamp_ntz"))


def read_event_stream(spark: SparkSession, folder: str, name: str = "",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream over a table of events: a folder of files or a single file, at
    ``folder`` or under ``name`` in it. Raises if there is neither."""
    path = f"{folder.rstrip('/')}/{name}".rstrip("/")
    kind = path_kind(spark, path)
    if kind is None:
        raise FileNotFoundError(path)
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if kind == "folder":
        return reader.option("recursiveFileLookup", "true").parquet(path)
    parent, _, leaf = path.rpartition("/")
    return reader.option("pathGlobFilter", leaf).parquet(parent)


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write rows into folders by ``by``; folders of the same values (an earlier
    attempt at the same micro-batch) are replaced. The hint gives a folder a few
    files of fair size, also where one holds most rows."""
    rows = rows.hint("rebalance", *by)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def ingest_once(events: DataFrame, sink: str, checkpoint: str, buckets: int = ID_BUCKETS) -> StreamingQuery:
    """Files into a date-partitioned table, every event id once, however
    late its rows arrive and however they are split into micro-batches. Of the
    rows of an id the least (ts, user_id, event_type, value, props) stays; null
    ids count as one id.

    ``sink/rows`` (by event_date and batch) only grows. ``sink/seen`` holds
    the ids and their rows in ``buckets`` hash buckets; a micro-batch reads the buckets it
    touches and writes only rows below what is there. ``sink/replaced`` names the
    rows that such a later, lesser row stands for; ``read_ingested`` leaves them out.
    A micro-batch looks at earlier batches only and replaces its own folders,
    so it may run again at any point.
    """
    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        least = F.min(F.struct(*[c for c in EVENT_COLUMNS if c != "event_id"])).alias("r")
        rows = batch.groupBy("event_id").agg(least)
        rows = rows.withColumns({"bucket": F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int"), "batch": F.lit(n).cast("long")})
        rows = rows.persist()  # used for the buckets and for three writes; a lost block is computed again
        if path_kind(spark, f"{sink}/seen"):
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
            there = (spark.read.schema(SEEN_SCHEMA).parquet(f"{sink}/seen").where(F.col("bucket").isin(touched) & (F.col("batch") < n))
                     .groupBy("event_id").agg(F.min(F.struct("r", "batch")).alias("old")))
            mixed = rows.join(there.withColumnRenamed("event_id", "old_id"), F.col("event_id").eqNullSafe(F.col("old_id")), "left")
            new = mixed.where(F.col("old").isNull() | (F.col("r") < F.col("old.r")))
        else:
            new = rows.withColumn("old", F.lit(None).cast("struct<r:string,batch:bigint>"))
        _replace(new.select("event_id", "r.*", F.to_date("r.ts").alias("event_date"), "batch"), f"{sink}/rows", "event_date", "batch")
        _replace(new.where("old is not null").select("event_id", F.col("old.batch").alias("stale"), "batch"), f"{sink}/replaced", "batch")
        _replace(new.select("event_id", "r", "bucket", "batch"), f"{sink}/seen", "bucket", "batch")
        rows.unpersist()

    q = (events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_ingested(spark: SparkSession, sink: str) -> DataFrame:
    """The table that ``ingest_once`` keeps at ``sink``: the events with event_date
    (a folder each); empty if nothing was ingested."""
    def part(name: str, schema: str) -> DataFrame:
        if path_kind(spark, f"{sink}/{name}") is None:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{sink}/{name}")

    rows = part("rows", f"{EVENT_SCHEMA}, event_date date, batch bigint")
    stale = part("replaced", "event_id bigint, stale bigint, batch bigint").select(F.col("event_id").alias("stale_id"), "stale")
    same = F.col("event_id").eqNullSafe(F.col("stale_id")) & (F.col("batch") == F.col("stale"))
    return rows.join(stale, same, "left_anti").select(*EVENT_COLUMNS, "event_date")


def stream_ingest(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Event-time watermark and de-duplication by event id for endless streams:
    bounded state, rows behind the watermark are dropped."""
    return (events.withColumn("event_time", ntz_to_instant(F.col("ts")))
            .withWatermark("event_time", watermark)
            .dropDuplicatesWithinWatermark(["event_id"])
            .drop("event_time"))


def stream_kpis(events: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Tumbling-window counts and value sums per event type."""
    w = (events.withColumn("event_time", ntz_to_instant(F.col("ts")))
         .withWatermark("event_time", watermark)
         .groupBy(F.window("event_time", window), "event_type")
         .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum")))
    return w.select(instant_to_ntz(F.col("window.start")).alias("window_start"),
                    instant_to_ntz(F.col("window.end")).alias("window_end"),
                    "event_type", "events", "value_sum")


def event_balance(query: StreamingQuery, sink: DataFrame, checkpoint: str) -> dict[str, int]:
    """Where the rows of a finished ``stream_kpis`` run went: rows read (from the
    query's progress), rows in emitted windows, rows in windows that the state
    still holds, and rows dropped behind the watermark, which are the rest.
    ``late_groups`` is Spark's own count of dropped rows; it counts them
    after the partial aggregation of a micro-batch."""
    spark = sink.sparkSession
    read = sum(p["numInputRows"] for p in query.recentProgress)
    groups = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    emitted = sink.agg(F.sum("events")).first()[0] or 0
    state = spark.read.format("statestore").load(checkpoint)
    held = state.agg(F.sum("value.count")).first()[0] or 0
    return {"rows": read, "emitted": emitted, "held": held, "dropped": read - emitted - held, "late_groups": groups}


def _with_priority(scored: DataFrame, as_of: str) -> DataFrame:
    w = dims.DEFAULT_PRIORITY_WEIGHTS
    scored = scored.withColumn("stream_priority", priority_formula(
        "stream_risk", "severity", "vulnerable_population", "citizen_sentiment", "festival_season",
        (w["risk"], w["severity"], w["vuln"], w["sent"], w["fest"])))
    return urgency.with_urgency(scored, as_of)


def stream_score(tickets: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    """T03 by formula: score arriving tickets (row-local, no state)."""
    return _with_priority(enrich.breach_propensity(tickets, out="stream_risk"), as_of)


def score_stream(tickets: DataFrame, model_path: str, sink: str, checkpoint: str, as_of: str = dims.AS_OF) -> StreamingQuery:
    """T03 by the fitted model: load the saved ``PipelineModel``, give each
    arriving ticket ``stream_risk``, ``stream_priority`` and urgency, and write each
    micro-batch into the folder of its batch id. A batch that runs again
    after a failure replaces its folder, so no ticket is written twice."""
    fitted = load_model(model_path)

    def add(batch: DataFrame, n: int) -> None:
        scored = _with_priority(model.score(fitted, batch, "stream_risk"), as_of)
        scored.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    q = tickets.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                  fmt: str = "parquet") -> StreamingQuery:
    """Run a streaming DataFrame over everything available, then stop."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return q
