"""SLA urgency tiers against a fixed ``as_of`` instant.

The dashboard uses the wall clock; every function here takes ``as_of`` so
results are repeatable. Tiers use the reference's exact bounds: 0 h left is
neither breached nor critical, exactly 24 h left is dire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import as_of_ts, dbl, hours_between


def with_urgency(df: DataFrame, as_of: str = dims.AS_OF,
                 window_hours: float | Column = dims.URGENCY_WINDOW_HOURS) -> DataFrame:
    """Hours since creation, hours until breach, already breached.

    ``window_hours`` is one window for all or a column, such as each
    department's deadline; without a window the hours left are null and the ticket is in no tier."""
    window = window_hours.cast("double") if isinstance(window_hours, Column) else dbl(window_hours)
    return (df.withColumn("hours_since_creation", hours_between("created_at", as_of_ts(as_of)))
              .withColumn("hours_until_breach", window - F.col("hours_since_creation"))
              .withColumn("already_breached", F.col("hours_until_breach") < 0))


def already_breached() -> Column:
    """U03."""
    return F.col("hours_until_breach") < 0


def critical() -> Column:
    """Risk above 0.80 and 0 < hours left < 24."""
    h = F.col("hours_until_breach")
    return (F.col("pred_sla_breach_prob") > 0.80) & (h < 24) & (h > 0)


def dire() -> Column:
    """Risk above 0.80 and 24 <= hours left <= 72."""
    return (F.col("pred_sla_breach_prob") > 0.80) & F.col("hours_until_breach").between(24, 72)


def high_risk() -> Column:
    """0.60 < risk <= 0.80, whatever the age."""
    p = F.col("pred_sla_breach_prob")
    return (p > 0.60) & (p <= 0.80)


def vulnerable_critical() -> Column:
    """U07."""
    return critical() & (F.col("vulnerable_population") == 1)


def urgency_counts() -> list[Column]:
    """U03-U08 as aggregate expressions for a single ``agg``."""
    return [
        F.count_if(already_breached()).alias("already_breached"),
        F.count_if(critical()).alias("critical"),
        F.count_if(dire()).alias("dire"),
        F.count_if(high_risk()).alias("high_risk"),
        F.count_if(vulnerable_critical()).alias("vulnerable_critical"),
        F.count_if(F.col("vulnerable_population") == 1).alias("vulnerable_total"),
    ]


def capacity_alert(critical_n: Column, dire_n: Column, high_n: Column) -> Column:
    """Alert ladder, first match wins."""
    return (F.when(critical_n > 50, "CRISIS MODE").when(critical_n > 20, "HIGH ALERT")
            .when(critical_n > 0, "URGENT").when(dire_n > 50, "ELEVATED ALERT")
            .when(dire_n > 0, "ATTENTION").when(high_n > 30, "PROACTIVE MODE")
            .when(high_n > 0, "STABLE").otherwise("OPTIMAL"))


def urgency_by(df: DataFrame, key: str = "dept", as_of: str = dims.AS_OF,
               window_hours: float | Column = dims.URGENCY_WINDOW_HOURS) -> DataFrame:
    """Urgency tier counts per group with the alert level of each group."""
    out = (with_urgency(df, as_of, window_hours).where(F.col(key).isNotNull())
           .groupBy(key).agg(F.count(F.lit(1)).alias("tickets"), *urgency_counts()))
    return out.withColumn("capacity_alert", capacity_alert(F.col("critical"), F.col("dire"), F.col("high_risk")))
