"""Driver queries for the streaming jobs: each runs a stream to the end
into a fresh folder under the checkpoint dir and returns the sink as a batch
DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import priority_formula
from ..operators import model as M
from ..plans.catalog import r6, register
from ..plans.model_queries import _W5, _fitted
from ..plans.sql import PROPENSITY_SQL, d, hours_since, round_even, with_tickets
from ..session import fresh_dir
from ..sources.files import save_model
from ..sources.tickets import stored_tickets as T
from . import streams


def _arrivals(spark, path: str, rows: DataFrame, files: int):
    """Write ``rows`` (with a column ``arrival``, 0 to files - 1) as one file
    an arrival, in that order, and return the folder."""
    for k in range(files):
        rows.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.mode("append").parquet(path)
    return path


_SHIFT = "CASE event_id % 10 WHEN 3 THEN ts - INTERVAL 1 DAY ELSE ts END"


@register("t01_stream_ingest",
          f"SELECT event_id, {_SHIFT} AS ts, user_id, event_type, value, props, CAST({_SHIFT} AS DATE) AS event_date FROM events")
def t01_stream_ingest(spark, sf):
    """Each event comes in one of four arrivals. A tenth of the ids comes again on
    a later date, another tenth on an earlier one (that row stays), a third tenth as it is."""
    base = fresh_dir(spark, "t01")
    ev = spark.read.schema(streams.EVENT_SCHEMA).parquet(f"{sf.rstrip('/')}/events.parquet")
    k, arrival = F.col("event_id") % 10, (F.col("event_id") % 4).cast("int")
    again = (ev.where(k < 4).withColumn("arrival", (arrival + k.cast("int") + 1) % 4)
             .withColumn("ts", F.timestamp_add("DAY", F.when(k == 2, 1).when(k == 3, -1).otherwise(0), F.col("ts"))))
    path = _arrivals(spark, f"{base}/incoming", ev.withColumn("arrival", arrival).unionByName(again), 4)
    streams.ingest_once(streams.read_event_stream(spark, path, max_files_per_trigger=1), f"{base}/sink", f"{base}/checkpoint")
    return streams.read_ingested(spark, f"{base}/sink")


# Events arrive up to nine days late, in six micro-batches of five days. A row is dropped
# if its day ended before the watermark that the batch before it closed windows with,
# which the batches before that one have set.
T02_DELAY = 36  # hours, times event_id % 7
T02_BATCHES, T02_START = 6, "2024-01-01 00:00:00"
_T02_SQL = f"""WITH a AS (SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS day_end,
    least({T02_BATCHES - 1}, CAST(floor(date_diff('hour', TIMESTAMP '{T02_START}', date_trunc('hour', ts) + to_hours(CAST(event_id % 7 * {T02_DELAY} AS BIGINT))) / 120.0) AS INTEGER)) AS batch FROM events),
  w AS (SELECT batch, coalesce(max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 HOUR,
    TIMESTAMP '1970-01-01') AS mark, max(max(ts)) OVER () - INTERVAL 1 HOUR AS final FROM a GROUP BY batch),
  kept AS (SELECT a.*, day_end <= mark AS late, final FROM a JOIN w USING (batch))
  SELECT day_end - INTERVAL 1 DAY AS window_start, day_end AS window_end, event_type, count(*) AS events, round(sum(value), 6) AS value_sum,
    (SELECT count(*) FROM kept WHERE late) AS dropped, (SELECT count(*) FROM kept WHERE NOT late AND day_end > final) AS held
  FROM kept WHERE NOT late AND day_end <= final GROUP BY day_end, event_type"""


@register("t02_stream_kpis", _T02_SQL)
def t02_stream_kpis(spark, sf):
    base = fresh_dir(spark, "t02")
    ev = spark.read.schema(streams.EVENT_SCHEMA).parquet(f"{sf.rstrip('/')}/events.parquet")
    hours = F.timestamp_diff("HOUR", F.lit(T02_START).cast("timestamp_ntz"),
                             F.timestamp_add("HOUR", (F.col("event_id") % 7 * T02_DELAY).cast("int"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")))
    arrival = F.least(F.lit(T02_BATCHES - 1), F.floor(hours / F.lit(120)).cast("int"))
    path = _arrivals(spark, f"{base}/incoming", ev.withColumn("arrival", arrival), T02_BATCHES)
    counts = streams.stream_kpis(streams.read_event_stream(spark, path, max_files_per_trigger=1))
    q = streams.run_available(counts, f"{base}/sink", f"{base}/checkpoint")
    out = spark.read.parquet(f"{base}/sink")
    went = streams.event_balance(q, out, f"{base}/checkpoint")
    return out.select("window_start", "window_end", "event_type", "events", r6("value_sum").alias("value_sum"),
                      F.lit(went["dropped"]).cast("long").alias("dropped"), F.lit(went["held"]).cast("long").alias("held"))


def _ticket_stream(spark, sf, base: str, per_trigger: int = 2):
    """The derived tickets as eight files, read a few a trigger."""
    T(spark, sf).repartition(8, "ticket_id").write.mode("append").parquet(f"{base}/incoming")
    return (spark.readStream.schema(spark.read.parquet(f"{base}/incoming").schema)
            .option("maxFilesPerTrigger", per_trigger).parquet(f"{base}/incoming"))


def _priority_sql(risk: str) -> str:
    w = dims.DEFAULT_PRIORITY_WEIGHTS
    return round_even(
        f"{d(100)} * least(greatest({d(w['risk'])} * {risk} + {d(w['severity'])} * (severity / {d(3)}) + {d(w['vuln'])} * "
        f"CAST(vulnerable_population AS DOUBLE) + {d(w['sent'])} * ((-citizen_sentiment + {d(1)}) / {d(2)}) + "
        f"{d(w['fest'])} * CAST(festival_season AS DOUBLE), {d(0)}), {d(1)})", 1)


@register("t03_stream_score", with_tickets(
    f"SELECT ticket_id, round(stream_risk, 6) AS stream_risk, {_priority_sql('stream_risk')} AS stream_priority, "
    "round(hours_until_breach, 6) AS hours_until_breach FROM "
    f"(SELECT *, {PROPENSITY_SQL} AS stream_risk, {d(72)} - {hours_since('created_at')} AS hours_until_breach FROM tickets)"))
def t03_stream_score(spark, sf):
    base = fresh_dir(spark, "t03")
    out = streams.stream_score(_ticket_stream(spark, sf, base))
    out = out.select("ticket_id", "stream_risk", "stream_priority", "hours_until_breach")
    streams.run_available(out, f"{base}/sink", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sink").withColumns({c: r6(c) for c in ("stream_risk", "hours_until_breach")})


@register("t03_stream_model", with_tickets(
    f"SELECT ticket_id, TRUE AS risk_equal, TRUE AS priority_equal, round({d(72)} - {hours_since('created_at')}, 6) AS hours_until_breach FROM tickets"))
def t03_stream_model(spark, sf):
    """The fitted model, saved and loaded into the stream: each ticket's streamed
    risk and priority beside the batch ones (M11, M14) of the same model."""
    base = fresh_dir(spark, "t03-model")
    fitted = _fitted(spark, sf)
    save_model(fitted, f"{base}/model")
    streams.score_stream(_ticket_stream(spark, sf, base), f"{base}/model", f"{base}/sink", f"{base}/checkpoint")
    streamed = spark.read.parquet(f"{base}/sink")
    batch = M.score(fitted, T(spark, sf).drop("priority_score")).select(
        F.col("ticket_id").alias("id"), F.col("pred_sla_breach_prob").alias("risk"), priority_formula(
            "pred_sla_breach_prob", "severity", "vulnerable_population", "citizen_sentiment", "festival_season", _W5).alias("priority"))
    both = streamed.join(batch, streamed.ticket_id == batch.id, "full")
    return both.select("ticket_id", F.col("stream_risk").eqNullSafe(F.col("risk")).alias("risk_equal"),
                       F.col("stream_priority").eqNullSafe(F.col("priority")).alias("priority_equal"), r6("hours_until_breach").alias("hours_until_breach"))
