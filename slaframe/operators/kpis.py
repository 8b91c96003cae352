"""KPIs, summaries, group-bys, trends and top-k.

Every aggregate is a hash aggregate with a map-side partial step, so a group
holding a third of all rows is combined inside each task before the shuffle.
The executive summary computes all of its per-group means and counts in ONE
scan with grouping sets; the ranking afterwards runs on a result whose size is
the number of groups, not the number of tickets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import dbl, risk_band, risk_status, round_half_even
from . import urgency as U

P = "pred_sla_breach_prob"


def kpis(df: DataFrame) -> DataFrame:
    """K01 + K02: tickets, mean risk, breach rate, mean priority, mean backlog
    (0 on an empty input) and the status words."""
    out = df.agg(
        F.count(F.lit(1)).alias("tickets"),
        F.coalesce(F.avg(P), dbl(0.0)).alias("mean_risk"),
        F.coalesce(F.avg("sla_breach"), dbl(0.0)).alias("breach_rate"),
        F.coalesce(F.avg("priority_score"), dbl(0.0)).alias("avg_priority"),
        F.coalesce(F.avg("historical_backlog"), dbl(0.0)).alias("avg_backlog"),
    )
    return out.withColumns({"risk_status": risk_status("mean_risk"), "breach_status": risk_status("breach_rate")})


def _first_by(key: str, value: Column, descending: bool = True) -> Column:
    """idxmax: the key with the largest value, first key on ties."""
    v = -value if descending else value
    return F.min_by(F.col(key), F.struct(v, F.col(key)))


def executive_summary(df: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    """K03-K08 + U03-U09 in one row, from one scan of ``df``.

    Grouping sets (dept), (district), (category) and () are aggregated in a
    single Expand + partial/final hash aggregate. Null keys are dropped for
    the idxmax/mode picks (pandas group-by) but kept for the distinct count
    of departments (pandas ``unique`` counts a null).
    """
    u = U.with_urgency(df, as_of)
    g = (u.groupingSets([["dept"], ["district"], ["category"], []], "dept", "district", "category")
         .agg(F.grouping_id().alias("gid"),
              F.count(F.lit(1)).alias("n"),
              F.avg(P).alias("mean_risk"),
              F.avg("sla_breach").alias("breach_rate"),
              *U.urgency_counts()))
    # gid bits: dept=4, district=2, category=1 (1 = aggregated away).
    is_dept, is_district, is_category, is_total = (F.col("gid") == 3), (F.col("gid") == 5), \
        (F.col("gid") == 6), (F.col("gid") == 7)
    out = g.agg(
        F.max(F.when(is_total, F.col("n"))).alias("tickets"),
        F.count_if(is_dept).alias("dept_count"),
        F.max(F.when(is_total, F.col("already_breached"))).alias("already_breached"),
        F.max(F.when(is_total, F.col("critical"))).alias("critical"),
        F.max(F.when(is_total, F.col("dire"))).alias("dire"),
        F.max(F.when(is_total, F.col("high_risk"))).alias("high_risk"),
        F.max(F.when(is_total, F.col("vulnerable_critical"))).alias("vulnerable_critical"),
        F.max(F.when(is_total, F.col("vulnerable_total"))).alias("vulnerable_total"),
        F.min_by(F.col("dept"), F.when(is_dept & F.col("dept").isNotNull(),
                                       F.struct(-F.col("mean_risk"), F.col("dept")))).alias("top_dept"),
        F.min_by(F.col("district"), F.when(is_district & F.col("district").isNotNull(),
                                           F.struct(-F.col("breach_rate"), F.col("district")))).alias("worst_district"),
        F.min_by(F.col("district"), F.when(is_district & F.col("district").isNotNull(),
                                           F.struct(-F.col("mean_risk"), F.col("district")))).alias("top_district_risk"),
        F.min_by(F.col("category"), F.when(is_category & F.col("category").isNotNull(),
                                           F.struct(-F.col("n"), F.col("category")))).alias("top_category"),
    )
    counts = ("tickets", "already_breached", "critical", "dire", "high_risk", "vulnerable_critical", "vulnerable_total")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return out.withColumn("capacity_alert", U.capacity_alert(F.col("critical"), F.col("dire"), F.col("high_risk")))


def top_dept(df: DataFrame) -> DataFrame:
    """Department with the highest mean risk (first key on ties)."""
    return _top(df, "dept", F.avg(P), "mean_risk")


def worst_district(df: DataFrame) -> DataFrame:
    """District with the highest breach rate."""
    return _top(df, "district", F.avg("sla_breach"), "breach_rate")


def top_district_risk(df: DataFrame) -> DataFrame:
    """District with the highest mean risk."""
    return _top(df, "district", F.avg(P), "mean_risk")


def top_category(df: DataFrame) -> DataFrame:
    """Most frequent category, lowest name on ties (pandas mode()[0])."""
    return _top(df, "category", F.count(F.lit(1)), "tickets")


def _top(df: DataFrame, key: str, measure: Column, name: str) -> DataFrame:
    grouped = df.where(F.col(key).isNotNull()).groupBy(key).agg(measure.alias(name))
    return grouped.orderBy(F.col(name).desc(), F.col(key).asc()).limit(1)


def dept_count(df: DataFrame) -> DataFrame:
    """Distinct departments, a null counted as one value."""
    return df.agg((F.count_distinct("dept") + F.max(F.when(F.col("dept").isNull(), 1).otherwise(0)))
                  .alias("dept_count"))


def risk_by(df: DataFrame, key: str) -> DataFrame:
    """Mean risk per key, highest first (key breaks ties)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(P).alias("mean_risk"))
            .orderBy(F.col("mean_risk").desc(), F.col(key)))


def category_top(df: DataFrame, key: str, k: int) -> DataFrame:
    """Tickets and mean risk per (key, category); the k riskiest,
    then by volume. Top-k is a TakeOrderedAndProject, not a full sort."""
    g = (df.where(F.col(key).isNotNull() & F.col("category").isNotNull())
         .groupBy(key, "category")
         .agg(F.count("ticket_id").alias("tickets"), F.avg(P).alias("risk")))
    return g.orderBy(F.col("risk").desc(), F.col("tickets").desc(), F.col(key), F.col("category")).limit(k)


def daily_trend(df: DataFrame) -> DataFrame:
    """Per creation day: tickets, mean risk, breach rate."""
    return (df.groupBy(F.to_date("created_at").alias("day"))
            .agg(F.count("ticket_id").alias("tickets"), F.avg(P).alias("risk"),
                 F.avg("sla_breach").alias("breaches"))
            .where(F.col("day").isNotNull()).orderBy("day"))


def peak_day(df: DataFrame) -> DataFrame:
    """First day with the most tickets."""
    d = daily_trend(df)
    return d.orderBy(F.col("tickets").desc(), F.col("day")).limit(1).select("day", "tickets")


def trend_long(df: DataFrame) -> DataFrame:
    """Daily risk and breach rate as (day, variable, value)."""
    return daily_trend(df).unpivot("day", ["risk", "breaches"], "variable", "value")


def weekly_dept(df: DataFrame) -> DataFrame:
    """Tickets per (Monday-start week, department)."""
    return (df.where(F.col("dept").isNotNull())
            .groupBy(F.date_trunc("week", "created_at").alias("week"), "dept")
            .agg(F.count("ticket_id").alias("tickets"))
            .where(F.col("week").isNotNull()).orderBy("week", "dept"))


def dept_stats(df: DataFrame) -> DataFrame:
    """G10 + G12: per department tickets, breach rate, mean risk, mean
    resolution hours (rounded half-even to 3), riskiest first, with bands."""
    g = (df.where(F.col("dept").isNotNull()).groupBy("dept")
         .agg(F.count("ticket_id").alias("total_tickets"),
              round_half_even(F.avg("sla_breach"), 3).alias("actual_breach_rate"),
              round_half_even(F.avg(P), 3).alias("ai_risk_score"),
              round_half_even(F.avg("resolution_hours"), 3).alias("avg_resolution_hrs")))
    return (g.withColumns({"risk_band": risk_band("ai_risk_score"),
                           "breach_band": risk_band("actual_breach_rate")})
            .orderBy(F.col("ai_risk_score").desc(), F.col("dept")))


def dept_state(df: DataFrame) -> DataFrame:
    """Per department: tickets, share of all tickets, breach rate,
    tickets with risk above 0.60, vulnerable tickets."""
    g = (df.where(F.col("dept").isNotNull()).groupBy("dept")
         .agg(F.count(F.lit(1)).alias("current_tickets"),
              F.avg("sla_breach").alias("current_breach_rate"),
              F.count_if(F.col(P) > 0.60).alias("high_risk_count"),
              F.count_if(F.col("vulnerable_population") == 1).alias("vulnerable_count")))
    # The total is summed over the grouped rows (one per department).
    total = F.sum("current_tickets").over(Window.partitionBy())
    return g.withColumn("share_pct", F.col("current_tickets") * dbl(100.0) / total)
