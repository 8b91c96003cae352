"""Monitoring of the assignment log by ministry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import as_of_ts, hours_between

STUCK_HOURS = 72


def flatten_assignments(log: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    """O01 + O02: ministry and department out of the nested record
    ("Unknown" when absent) and hours since assignment."""
    assigned = F.col("assigned_at").cast("string").try_cast("timestamp_ntz")
    return log.select(
        "ticket_id", "status", "priority_score", "risk_score",
        F.coalesce(F.col("assignment.ministry"), F.lit("Unknown")).alias("ministry"),
        F.coalesce(F.col("assignment.department"), F.lit("Unknown")).alias("department"),
        assigned.alias("assigned_at_dt"),
        hours_between(assigned, as_of_ts(as_of)).alias("hours_since_assignment"))


def assignment_overview(flat: DataFrame) -> DataFrame:
    """Total, in progress (count and %), pending, resolved."""
    out = flat.agg(
        F.count(F.lit(1)).alias("total_assigned"),
        F.count_if(F.col("status") == "In Progress").alias("in_progress"),
        F.count_if(F.col("status") == "Pending").alias("pending"),
        F.count_if(F.col("status") == "Resolved").alias("resolved"))
    return out.withColumn("in_progress_pct", F.when(F.col("total_assigned") > 0,
                                                    F.col("in_progress") * F.lit(100.0) / F.col("total_assigned"))
                          .otherwise(F.lit(0.0)))


def ministry_status(hours) -> F.Column:
    """On Track below 24 h, Monitor below 48 h, else Attention Needed."""
    return (F.when(hours < 24, "On Track").when(hours < 48, "Monitor").otherwise("Attention Needed"))


def ministry_performance(flat: DataFrame) -> DataFrame:
    """O04 + O05 + O07: per ministry: assigned tickets, mean hours since
    assignment, mean risk, stuck tickets, status; busiest first."""
    g = (flat.where(F.col("ministry").isNotNull()).groupBy("ministry")
         .agg(F.count("ticket_id").alias("assigned_tickets"),
              F.avg("hours_since_assignment").alias("avg_hours_since_assignment"),
              F.avg("risk_score").alias("avg_risk_score"),
              F.count_if(F.col("hours_since_assignment") > STUCK_HOURS).alias("stuck_tickets")))
    return (g.withColumn("status", ministry_status(F.col("avg_hours_since_assignment")))
            .orderBy(F.col("assigned_tickets").desc(), F.col("ministry")))


def stuck_tickets(flat: DataFrame, threshold: float = STUCK_HOURS) -> DataFrame:
    """Assigned more than ``threshold`` hours ago."""
    return flat.where(F.col("hours_since_assignment") > threshold)


def stuck_by_ministry(flat: DataFrame, threshold: float = STUCK_HOURS) -> DataFrame:
    """Stuck tickets per ministry, most first."""
    return (stuck_tickets(flat, threshold).groupBy("ministry").agg(F.count("ticket_id").alias("stuck"))
            .orderBy(F.col("stuck").desc(), F.col("ministry")))


def recent_assignments(flat: DataFrame, k: int = 20) -> DataFrame:
    """The k newest assignments, seven display columns."""
    top = flat.orderBy(F.col("assigned_at_dt").desc(), F.col("ticket_id")).limit(k)
    return top.select(F.col("ticket_id").alias("Ticket ID"), F.col("ministry").alias("Ministry"),
                      F.col("department").alias("Department"), F.col("status").alias("Status"),
                      F.col("risk_score").alias("Risk Score"), F.col("priority_score").alias("Priority"),
                      F.col("hours_since_assignment").alias("Hours Since Assignment"))
