"""Q01-Q08: action queue, routing, selection and the assignment log.

The queue is a top-k (``orderBy(...).limit(k)`` plans as
TakeOrderedAndProject: every task keeps its own k best rows, the driver merges
k x #tasks rows), so it never sorts the whole table. Operator edits arrive as a
DataFrame keyed by ticket id; it is at most queue-sized, which bounds the
broadcast. The assignment log is a parquet table with a folder a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions.exprs import as_of_ts, priority_formula
from ..session import ensure_checkpoint_dir, path_kind

QUEUE_COLUMNS = ["select", "escalate", "route_dept", "route_ministry", "ticket_id", "created_at", "district",
                 "ward", "dept", "category", "severity", "vulnerable_population", "pred_sla_breach_prob",
                 "priority_dynamic", "historical_backlog"]


def normalised_weights(w: dict[str, float] | None = None) -> tuple[float, float, float, float, float]:
    """Q01 weights: divided by their sum; all zero falls back to the defaults."""
    w = w or dims.DEFAULT_PRIORITY_WEIGHTS
    ws = [float(w["risk"]), float(w["severity"]), float(w["vuln"]), float(w["sent"]), float(w["fest"])]
    total = 0.0
    for x in ws:
        total += x
    if total == 0:
        d = dims.DEFAULT_PRIORITY_WEIGHTS
        return (d["risk"], d["severity"], d["vuln"], d["sent"], d["fest"])
    return tuple(x / total for x in ws)


def dynamic_priority(df: DataFrame, w: dict[str, float] | None = None) -> DataFrame:
    """Q01: priority from user weights, 0..100, half-even to one decimal."""
    ws = normalised_weights(w)
    return df.withColumn("priority_dynamic", priority_formula(
        "pred_sla_breach_prob", "severity", "vulnerable_population", "citizen_sentiment", "festival_season", ws))


def ministry_of(dept: Column) -> Column:
    """Q02: department -> ministry, anything else -> Cross-Ministry."""
    return F.coalesce(dims.lookup(dims.MINISTRY, dept), F.lit(dims.CROSS_MINISTRY))


def route_ministry(df: DataFrame) -> DataFrame:
    return df.withColumn("ministry_default", ministry_of(F.col("dept")))


def action_queue(df: DataFrame, w: dict[str, float] | None = None, k: int = dims.QUEUE_SIZE) -> DataFrame:
    """Q03: the k most urgent tickets by dynamic priority, then risk (ticket
    id breaks remaining ties), with default routing and edit columns."""
    ranked = dynamic_priority(df, w)
    top = ranked.orderBy(F.col("priority_dynamic").desc(), F.col("pred_sla_breach_prob").desc(),
                         F.col("ticket_id").asc()).limit(k)
    return top.select(
        F.lit(False).alias("select"), F.lit(False).alias("escalate"),
        F.col("dept").alias("route_dept"), ministry_of(F.col("dept")).alias("route_ministry"),
        "ticket_id", "created_at", "district", "ward", "dept", "category", "severity",
        (F.col("vulnerable_population") == 1).alias("vulnerable_population"),
        "pred_sla_breach_prob", "priority_dynamic", "historical_backlog")


def fixture_edits(queue: DataFrame) -> DataFrame:
    """Deterministic operator edits on a queue (stand-in for the editable
    grid): every even ticket selected, every third escalated, every tenth
    routed to Cross-Department."""
    k = F.col("ticket_id").cast("long")
    return queue.select(
        "ticket_id",
        (k % 2 == 0).alias("select"),
        (k % 3 == 0).alias("escalate"),
        F.when(k % 10 == 0, F.lit(dims.CROSS_DEPARTMENT)).alias("route_dept"),
        F.lit(None).cast("string").alias("route_ministry"))


def select_rows(queue: DataFrame, edits: DataFrame) -> DataFrame:
    """Q04: apply edits (null keeps the default) and keep selected rows."""
    e = edits.select("ticket_id", *[F.col(c).alias(f"_e_{c}") for c in ("select", "escalate", "route_dept",
                                                                          "route_ministry")])
    joined = queue.join(e, "ticket_id", "left")
    edited = joined.select(
        F.coalesce("_e_select", "select").alias("select"),
        F.coalesce("_e_escalate", "escalate").alias("escalate"),
        F.coalesce("_e_route_dept", "route_dept").alias("route_dept"),
        F.coalesce("_e_route_ministry", "route_ministry").alias("route_ministry"),
        *[c for c in QUEUE_COLUMNS[4:]])
    return edited.where(F.col("select"))


def export_selection(selected: DataFrame) -> DataFrame:
    """S07 projection: the selection without its ``select`` flag."""
    return selected.drop("select")


def build_payload(selected: DataFrame, assigned_at: Column | None = None, status: str = "In Progress") -> DataFrame:
    """Q05: one nested assignment record per selected row."""
    assigned_at = as_of_ts() if assigned_at is None else assigned_at
    return selected.select(
        "ticket_id",
        F.struct(F.col("route_ministry").alias("ministry"), F.col("route_dept").alias("department"),
                 F.col("escalate").cast("boolean").alias("escalated")).alias("assignment"),
        F.lit(status).alias("status"),
        assigned_at.cast("timestamp_ntz").alias("assigned_at"),
        F.col("priority_dynamic").cast("double").alias("priority_score"),
        F.col("pred_sla_breach_prob").cast("double").alias("risk_score"),
        F.struct("district", "ward", "category", F.col("severity").cast("int").alias("severity"),
                 F.col("vulnerable_population").cast("boolean").alias("vulnerable_household")).alias("metadata"))


def fixture_assigned_at(as_of: str = dims.AS_OF) -> Column:
    """Fixture assignment times: as_of minus (id mod 96) hours."""
    return F.timestamp_add("HOUR", -(F.col("ticket_id").cast("long") % 96).cast("int"), as_of_ts(as_of))


def assignments_from(df: DataFrame, w: dict[str, float] | None = None, as_of: str = dims.AS_OF) -> DataFrame:
    """The fixture assignment log: queue -> edits -> selection -> payload."""
    return build_payload(fixture_selection(df, w), fixture_assigned_at(as_of))


def fixture_selection(df: DataFrame, w: dict[str, float] | None = None) -> DataFrame:
    """The selected rows of the queue under the fixture edits. The queue (at most
    ``QUEUE_SIZE`` rows) is checkpointed, as rows and edits both come from it."""
    ensure_checkpoint_dir(df.sparkSession)
    q = action_queue(df, w).checkpoint()
    return select_rows(q, fixture_edits(q))


def append_assignments(payload: DataFrame, path: str, batch: int = 0) -> None:
    """Q06: add a payload batch to the log at ``path``. The log has a folder a
    batch; a batch that is added again (after a failure) replaces its folder
    and is no second copy."""
    rows = payload.select(*[f.name for f in dims.ASSIGNMENT_SCHEMA.fields]).withColumn("batch", F.lit(batch).cast("long"))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/log"))


def _cleared(spark: SparkSession, path: str) -> int:
    if path_kind(spark, f"{path}/cleared") is None:
        return -1
    return spark.read.schema("upto long").parquet(f"{path}/cleared").agg(F.max("upto")).first()[0]


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """The log: all batches behind the last clear."""
    if path_kind(spark, f"{path}/log") is None:
        return spark.createDataFrame([], dims.ASSIGNMENT_SCHEMA)
    log = spark.read.schema(T.StructType([*dims.ASSIGNMENT_SCHEMA.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/log")
    return log.where(F.col("batch") > _cleared(spark, path)).drop("batch")


def assignment_log(log: DataFrame, k: int = 20) -> DataFrame:
    """Q07: the k newest records (ticket id breaks ties) with the log total."""
    total = log.agg(F.count(F.lit(1))).scalar()  # scalar subquery, one value
    recent = log.orderBy(F.col("assigned_at").desc(), F.col("ticket_id")).limit(k)
    return recent.withColumn("total_assigned", total)


def clear_assignments(spark: SparkSession, path: str) -> DataFrame:
    """Q08: empty the log. A clear is one added row, the number of the last batch it
    covers; the batches' files stay, so a clear that dies half-way changes
    nothing. Batches numbered above it count again."""
    if path_kind(spark, f"{path}/log"):
        last = spark.read.parquet(f"{path}/log").agg(F.max(F.col("batch").cast("long")).alias("upto"))
        last.where("upto is not null").write.mode("append").parquet(f"{path}/cleared")
    return read_assignments(spark, path)
