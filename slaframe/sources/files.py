"""Readers and writers.

Tables are written by Spark's writers into folders (one file per task, no
single-file funnel through the driver). Predictions keep the reference's CSV
layout; the ticket table is parquet partitioned by creation date so date
filters prune whole folders.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions.exprs import clean_number


def predictions_read_schema() -> T.StructType:
    """Declared CSV schema; the two scores are read as text and coerced so
    that bad values become 0 instead of failing the read."""
    fields = []
    for f in dims.TICKET_SCHEMA.fields:
        if f.name in ("pred_sla_breach_prob", "priority_score"):
            fields.append(T.StructField(f.name, T.StringType()))
        else:
            fields.append(f)
    return T.StructType(fields)


def write_predictions(df: DataFrame, path: str) -> None:
    """The 26-column predictions layout as CSV with a header."""
    (df.select(*dims.PREDICTION_COLUMNS).write.mode("overwrite")
     .option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """The predictions CSV as written (no coercion)."""
    return (spark.read.schema(dims.TICKET_SCHEMA).option("header", True)
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Read predictions; risk clipped to [0, 1] and priority to
    [0, 100], unparseable / missing / NaN values -> 0."""
    raw = (spark.read.schema(predictions_read_schema()).option("header", True)
           .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))
    return raw.withColumns({
        "pred_sla_breach_prob": clean_number("pred_sla_breach_prob", 0.0, 1.0),
        "priority_score": clean_number("priority_score", 0.0, 100.0),
    })


def write_tickets(df: DataFrame, path: str) -> None:
    """The ticket table as parquet, partitioned by creation date."""
    # REBALANCE lets AQE split a hot date and merge small ones, so each date
    # folder gets a few right-sized files instead of one file per task.
    (df.withColumn("created_date", F.to_date("created_at")).hint("rebalance", "created_date")
     .write.mode("overwrite").partitionBy("created_date").parquet(path))


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_importance(importance: DataFrame, path: str) -> None:
    """Importance table, most important first."""
    (importance.orderBy(F.col("importance_mean").desc(), F.col("feature"))
     .write.mode("overwrite").option("header", True).csv(path))


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, importance_mean double, importance_std double") \
        .option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    """MLlib persistence (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_summary(metrics: DataFrame, readiness: DataFrame, paths: dict[str, str]) -> DataFrame:
    """One JSON document with paths, model metrics and readiness.

    ``metrics`` and ``readiness`` are one-row aggregates; they are combined
    with scalar subqueries, not joins.
    """
    r = readiness
    doc = F.struct(
        *[F.lit(v).alias(k) for k, v in paths.items()],
        metrics.select("auc").scalar().alias("auc"),
        metrics.select("brier").scalar().alias("brier"),
        F.struct(r.select("already_breached_pct").scalar().alias("already_breached_pct"),
                 r.select("critical").scalar().alias("critical_count"),
                 r.select("dire").scalar().alias("dire_count"),
                 r.select("high_risk").scalar().alias("high_risk_count")).alias("dashboard_readiness"))
    spark = metrics.sparkSession
    return spark.range(1).select(F.to_json(doc).alias("summary"))


_EMPTY = "\x00"  # stands for a quoted empty field while a file is read
_EXACT_CSV = {"header": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": False,
              "ignoreTrailingWhiteSpace": False, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV that ``read_csv`` gives back as it was: every field with
    a comma, quote or line end is quoted, quotes are doubled, empty texts
    are told from nulls, timestamps keep their microseconds."""
    df.write.mode("overwrite").options(**_EXACT_CSV, quoteAll=False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read what ``write_csv`` wrote. Fields may hold line ends, so a file is
    read by one task; the writer makes one file a task."""
    df = spark.read.schema(schema).options(**_EXACT_CSV | {"emptyValue": _EMPTY}, multiLine=True).csv(path)
    return df.select(*[F.when(F.col(c) == _EMPTY, "").otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
