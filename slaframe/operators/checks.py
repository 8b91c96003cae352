"""Profiling and data checks, each one aggregate pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import dbl
from . import urgency as U
from .enrich import age_days


def dept_distribution(df: DataFrame) -> DataFrame:
    """Tickets and share per department, key-sorted."""
    g = df.where(F.col("dept").isNotNull()).groupBy("dept").agg(F.count(F.lit(1)).alias("tickets"))
    total = F.sum("tickets").over(Window.partitionBy())  # over one row per department
    return g.withColumn("pct", F.col("tickets") * dbl(100.0) / total).orderBy("dept")


def recency_split(df: DataFrame, as_of: str = dims.AS_OF, days: int = 30) -> DataFrame:
    """Tickets at most ``days`` old and older, with shares."""
    age = age_days("created_at", as_of)
    out = df.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(age <= days).alias("recent"),
                 F.count_if(age > days).alias("older"))
    return out.select("total", "recent", "older",
                      F.try_divide(F.col("recent") * dbl(100.0), F.col("total")).alias("recent_pct"),
                      F.try_divide(F.col("older") * dbl(100.0), F.col("total")).alias("older_pct"))


def label_check(df: DataFrame, label: str = "sla_breach") -> DataFrame:
    """Label rate; FATAL when it is constant (0 or 1)."""
    out = df.agg(F.count(F.lit(1)).alias("total"), F.avg(label).alias("breach_rate"),
                 F.count_if(F.col(label) == 1).alias("breaches"),
                 F.count_if(F.col(label) == 0).alias("non_breaches"))
    rate = F.col("breach_rate")
    return out.withColumn("verdict", F.when(rate.isNull() | (rate == 0) | (rate == 1), "FATAL").otherwise("PASS"))


def readiness(df: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    """Dashboard readiness: already-breached share and urgent tiers."""
    u = U.with_urgency(df, as_of)
    out = u.agg(F.count(F.lit(1)).alias("total"),
                F.count_if(U.already_breached()).alias("already_breached"),
                F.count_if(U.critical()).alias("critical"),
                F.count_if(U.dire()).alias("dire"),
                F.count_if(U.high_risk()).alias("high_risk"))
    pct = F.try_divide(F.col("already_breached") * dbl(100.0), F.col("total"))
    out = out.withColumn("already_breached_pct", pct)
    return out.withColumns({
        "breached_verdict": F.when(F.col("already_breached_pct") > 60, "FAIL")
        .when(F.col("already_breached_pct") < 20, "WARNING").otherwise("PASS"),
        "urgent_verdict": F.when((F.col("critical") == 0) & (F.col("dire") == 0), "WARNING").otherwise("PASS"),
    })


def coef_consistency(importance: DataFrame, max_rank: int = 7, min_coef: float = 0.5) -> DataFrame:
    """Every feature whose logit coefficient is at least ``min_coef``
    should rank within the top ``max_rank`` by importance.

    ``importance`` (feature, importance_mean) has one row per model feature
    (16), so the rank window and the 16-row coefficient table are bounded.
    Rank: importance descending, feature name on ties.
    """
    rank = F.row_number().over(Window.orderBy(F.col("importance_mean").desc(), F.col("feature")))
    ranked = importance.select("feature", "importance_mean", rank.alias("rank"))
    coef = dims.coefficient_dim(importance.sparkSession).where(F.col("coefficient") >= min_coef)
    out = ranked.join(F.broadcast(coef), "feature")
    out = out.withColumn("status", F.when(F.col("rank") <= max_rank, "PASS").otherwise("FAIL"))
    issues = F.count_if(F.col("status") == "FAIL").over(Window.partitionBy())
    return (out.withColumn("issues", issues)
            .withColumn("overall", F.when(F.col("issues") == 0, "PASS").otherwise("WARNING"))
            .orderBy(F.col("coefficient").desc(), F.col("feature")))
