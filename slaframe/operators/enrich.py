"""Ticket enrichment as column operators.

The reference computes these inside its row generator; here each one is a
``DataFrame -> DataFrame`` step built from built-in expressions, usable on any
ticket table (``df.transform(time_features)``). Only ``dept_quota_sample`` and
``recency_tier`` shuffle, and both pre-aggregate first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import as_of_ts, clip, col, dbl, sigmoid
from ..functions.strata import exact_stratified_flag, hash_order


def time_features(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Hour of creation, business hours 9..17, weekend (Monday = 0)."""
    return df.withColumns({
        "created_hour": F.hour(ts),
        "is_business_hours": F.when(F.hour(ts).between(9, 17), 1).otherwise(0),
        "is_weekend": F.when(F.weekday(ts) >= 5, 1).otherwise(0),
    })


def severity_lookup(df: DataFrame, category: str = "category") -> DataFrame:
    """Category -> severity (unknown category -> null)."""
    return df.withColumn("severity", dims.lookup(dims.SEVERITY, F.col(category)).cast("int"))


def sla_deadline(df: DataFrame, dept: str = "dept") -> DataFrame:
    """Department -> SLA hours."""
    return df.withColumn("sla_deadline_hours", dims.lookup(dims.SLA_HOURS, F.col(dept)).cast("int"))


def category_domain(df: DataFrame) -> DataFrame:
    """Tickets per (dept, category) with a flag for the allowed domain.

    The dimension has 15 fixed rows, so broadcasting it is bounded.
    """
    allowed = dims.category_dim(df.sparkSession).select("dept", "category", F.lit(True).alias("_ok"))
    counts = df.groupBy("dept", "category").agg(F.count(F.lit(1)).alias("tickets"))
    return (counts.join(F.broadcast(allowed), ["dept", "category"], "left")
            .select("dept", "category", "tickets", F.coalesce("_ok", F.lit(False)).alias("in_domain")))


def district_pressure(df: DataFrame, district: str = "district") -> DataFrame:
    """District -> pressure weight."""
    return df.withColumn("district_pressure", dims.lookup(dims.DISTRICT_PRESSURE, F.col(district)))


def festival_flag(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Created in a festival month (8..11)."""
    return df.withColumn("festival_month", F.when(F.month(ts).isin(dims.FESTIVAL_MONTHS), 1).otherwise(0))


def breach_logit(df: DataFrame, intercept: float = -1.5, pressure: str | None = "district_pressure") -> Column:
    """The generator's logit without its noise term."""
    z = (dbl(intercept) + dbl(0.8) * F.col("severity") + dbl(1.2) * F.col("vulnerable_population")
         + dbl(0.8) * (-F.col("citizen_sentiment")) + dbl(0.01) * F.col("historical_backlog")
         + dbl(1.0) * (dbl(1.0) - F.col("resource_availability")) + dbl(0.005) * F.col("weather_rain_mm")
         + dbl(0.006) * F.col("traffic_index"))
    if pressure is not None:
        z = z + dbl(0.6) * F.col(pressure)
    return (z + dbl(0.5) * F.col("festival_season") + dbl(0.4) * (dbl(1.0) - F.col("is_business_hours"))
            + dbl(0.5) * F.col("is_weekend"))


def breach_propensity(df: DataFrame, intercept: float = -1.5, out: str = "breach_propensity") -> DataFrame:
    """Sigmoid of the logit, clipped to [0.001, 0.999]."""
    if "district_pressure" not in df.columns:
        df = district_pressure(df)
    return df.withColumn(out, clip(sigmoid(breach_logit(df, intercept)), 0.001, 0.999))


def expected_resolution(df: DataFrame, out: str = "expected_resolution_hours") -> DataFrame:
    """Expected hours to resolve from the ticket's conditions."""
    hours = (dbl(48.0) + F.col("severity") * dbl(24.0) + F.col("vulnerable_population") * dbl(36.0)
             + (F.col("historical_backlog") / dbl(100.0)) * dbl(24.0)
             + (dbl(1.0) - F.col("resource_availability")) * dbl(48.0)
             + (dbl(1.0) - F.col("is_business_hours")) * dbl(12.0)
             + F.col("is_weekend") * dbl(24.0)
             + (F.col("weather_rain_mm") / dbl(50.0)) * dbl(12.0)
             + (F.col("traffic_index") / dbl(100.0)) * dbl(6.0))
    return df.withColumn(out, hours)


def resolution_hours(df: DataFrame, observed: str, p: str = "pred_sla_breach_prob",
                     deadline: str = "sla_deadline_hours") -> DataFrame:
    """E09 + E10: floor at 24 h, stretch by (1 + 0.8 p), breach flag on the
    stretched value, then cap at three times the deadline."""
    raw = F.greatest(dbl(24.0), col(observed)) * (dbl(1.0) + col(p) * dbl(0.8))
    return (df.withColumn("raw_hours", raw)
            .withColumn("raw_breach", sla_breach_flag(F.col("raw_hours"), col(deadline)))
            .withColumn("capped_hours", F.least(F.col("raw_hours"), (col(deadline) * 3).cast("double"))))


def sla_breach_flag(hours: Column, deadline: Column) -> Column:
    """Strictly over the deadline."""
    return F.when(hours > deadline, 1).otherwise(0)


def escalation_probability(df: DataFrame, p: str = "pred_sla_breach_prob", out: str = "p_escalate") -> DataFrame:
    """Chance of escalation, clipped to [0, 0.7]."""
    raw = (dbl(0.1) + dbl(0.3) * F.when(col(p) > 0.6, 1.0).otherwise(0.0)
           + dbl(0.2) * (-F.col("citizen_sentiment")) + dbl(0.15) * (F.col("severity") / dbl(3.0)))
    return df.withColumn(out, clip(raw, 0.0, 0.7))


def speedup(level: Column) -> Column:
    """0.7 ** level for levels 0..3, multiplied out so it is bit-exact."""
    return (F.when(level == 1, dbl(0.7)).when(level == 2, dbl(0.7) * dbl(0.7))
            .when(level == 3, dbl(0.7) * dbl(0.7) * dbl(0.7)).otherwise(dbl(1.0)))


def escalation_speedup(df: DataFrame, hours: str = "capped_hours", breach: str = "raw_breach",
                       deadline: str = "sla_deadline_hours") -> DataFrame:
    """Escalated tickets resolve 0.7**level faster; their breach flag
    is recomputed on the faster time."""
    esc = F.col("escalated") == 1
    fast = F.when(esc, col(hours) * speedup(F.col("escalation_level"))).otherwise(col(hours))
    return (df.withColumn("escalated_hours", fast)
              .withColumn("escalated_breach",
                          F.when(esc, sla_breach_flag(F.col("escalated_hours"), col(deadline)))
                          .otherwise(col(breach))))


def escalation_days(df: DataFrame, hours: str = "resolution_hours") -> DataFrame:
    """E13."""
    return df.withColumn("escalation_days", col(hours) / dbl(24.0))


def escalation_label(df: DataFrame, level: str = "escalation_level") -> DataFrame:
    """Level -> None / Supervisor / District Officer / Ministry."""
    return df.withColumn("escalation_label", dims.lookup(dims.ESCALATION_LABELS, F.col(level)))


def quotas(n: int, weights: dict[str, float] | None = None,
           remainder_to: str = dims.QUOTA_REMAINDER_DEPT) -> dict[str, int]:
    """int(n * w) per stratum; the rounding remainder goes to one stratum."""
    weights = weights or dims.DEPT_WEIGHTS
    q = {k: int(n * w) for k, w in weights.items()}
    q[remainder_to] += n - sum(q.values())
    return q


def dept_quota_sample(df: DataFrame, n: int, weights: dict[str, float] | None = None,
                      seed: str = "42") -> DataFrame:
    """Exactly ``int(n * w)`` tickets per department (remainder to Roads),
    chosen by a seeded hash order; all of a department if it has fewer."""
    q = quotas(n, weights)
    quota = df.sparkSession.createDataFrame(list(q.items()), "dept string, quota long")
    flagged = exact_stratified_flag(df, "dept", quota, hash_order(F.col("ticket_id"), seed), "_take")
    return flagged.where(F.col("_take")).drop("_take")


def age_days(ts: str | Column = "created_at", as_of: str = dims.AS_OF) -> Column:
    """Whole days from creation to ``as_of``, floored like ``timedelta.days``."""
    secs = F.timestamp_diff("SECOND", col(ts), as_of_ts(as_of))
    return F.floor(secs / F.lit(86400)).cast("int")


def recency_tier(df: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    """Tickets and share per age tier (0-6, 7-29, 30-89, 90+ days;
    tickets created after ``as_of`` count as 0-6)."""
    age = age_days("created_at", as_of)
    tier = (F.when(age < 7, "0-6").when(age < 30, "7-29").when(age < 90, "30-89").otherwise("90+"))
    counts = df.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("tickets"))
    total = F.sum("tickets").over(Window.partitionBy())
    return counts.select("tier", "tickets", (F.col("tickets") * dbl(100.0) / total).alias("pct"))
