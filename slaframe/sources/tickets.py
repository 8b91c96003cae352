"""Derive the wide ``tickets`` table from the TPC-H-like parquet tables.

The reference builds its tickets with a random simulator; we map the given
tables onto tickets instead, so Spark and the DuckDB oracle read the same rows
and the work grows with the data.

Plan shape: ``lineitem`` is aggregated by order key (partial + final hash
aggregate, so a hot order key is pre-combined map-side); that aggregate is
already hash-partitioned on the order key and feeds the left join with
``orders`` without a second exchange of its side. ``customer`` joins on the
customer key; Spark broadcasts it only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold``, otherwise it is a sort-merge join and
AQE splits a hot customer key (skew join). Every other column is a row-local
expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import as_of_ts, clip, dbl, round_half_even, sigmoid


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.col("o_orderkey")


def offset_days(k: Column) -> Column:
    """Age in days, spread over the reference's four age tiers."""
    bucket = k % 100
    return (F.when(bucket < 30, k % 7)
            .when(bucket < 65, F.lit(8) + k % 22)
            .when(bucket < 90, F.lit(31) + k % 59)
            .otherwise(F.lit(91) + k % 89)).cast("int")


def tickets(spark: SparkSession, sf_dir: str, as_of: str = dims.AS_OF) -> DataFrame:
    """Tickets (26 columns, the ``predictions`` layout) derived from parquet."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rain = (read_table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.sum("l_quantity").alias("qty")))
    # Hash-partition orders on the order key: it is the exchange the
    # order-key join needs at scale anyway (the aggregate side is already
    # partitioned that way), and it spreads the wide per-row projection over
    # ``spark.sql.shuffle.partitions`` tasks even when the scan has one split.
    base = (orders.repartition("o_orderkey")
            .join(rain, orders.o_orderkey == rain.l_orderkey, "left")
            .join(customer, orders.o_custkey == customer.c_custkey, "inner"))

    k = _k()
    category_lists = {d: F.array(*[F.lit(c) for c in cs]) for d, cs in dims.CATEGORIES.items()}
    category_of = F.create_map(*[x for d, arr in category_lists.items() for x in (F.lit(d), arr)])
    stage1 = base.select(
        F.col("o_orderkey").cast("string").alias("ticket_id"),
        F.timestamp_add(
            "MINUTE",
            (-offset_days(k) * 1440 + (k % 24) * 60 + (k * 7) % 60).cast("int"),
            as_of_ts(as_of)).alias("created_at"),
        F.element_at(F.array(*[F.lit(d) for d in dims.DISTRICTS]),
                     (F.col("c_nationkey") % 10 + 1).cast("int")).alias("district"),
        F.concat(F.lit("W"), F.lpad((F.col("o_custkey") % 30 + 1).cast("string"), 2, "0")).alias("ward"),
        dims.lookup(dims.SEGMENT_DEPT, F.col("c_mktsegment")).alias("dept"),
        (k % 3 + 1).cast("int").alias("_cat_pos"),
        dims.lookup(dims.STATUS_CHANNEL, F.col("o_orderstatus")).alias("reported_via"),
        (((k * 37) % 201 - 100).cast("double") / F.lit(100.0)).alias("citizen_sentiment"),
        F.when(F.col("o_orderpriority") == dims.URGENT_PRIORITY, 1).otherwise(0).alias("vulnerable_population"),
        (F.col("o_custkey") % 121).cast("int").alias("historical_backlog"),
        (((k * 53) % 101).cast("double") / F.lit(100.0)).alias("resource_availability"),
        (F.coalesce(F.col("qty"), dbl(0.0)) / F.lit(10.0)).alias("weather_rain_mm"),
        ((k * 29) % 101).cast("int").alias("traffic_index"),
        (k % 4 == 0).alias("_k4"),
        (k % 40).cast("int").alias("_k40"),
        (((k * 31) % 61 - 30).cast("double") / F.lit(100.0)).alias("_noise"),
    )
    stage2 = stage1.select(
        "*",
        F.element_at(F.element_at(category_of, F.col("dept")), F.col("_cat_pos")).alias("category"),
        F.hour("created_at").alias("created_hour"),
        F.when(F.month("created_at").isin(dims.FESTIVAL_MONTHS) & F.col("_k4"), 1).otherwise(0)
        .alias("festival_season"),
        dims.lookup(dims.SLA_HOURS, F.col("dept")).cast("int").alias("sla_deadline_hours"),
    )
    stage3 = stage2.select(
        "*",
        dims.lookup(dims.SEVERITY, F.col("category")).cast("int").alias("severity"),
        F.when(F.col("created_hour").between(9, 17), 1).otherwise(0).alias("is_business_hours"),
        F.when(F.weekday("created_at") >= 5, 1).otherwise(0).alias("is_weekend"),
    )
    sev = F.col("severity")
    vul = F.col("vulnerable_population")
    sent = F.col("citizen_sentiment")
    res = F.col("resource_availability")
    bus = F.col("is_business_hours")
    wkd = F.col("is_weekend")
    # Breach propensity: the generator's logit without pressure and noise,
    # shifted by -2.5 so the scores spread over (0, 1).
    z = (dbl(-1.5) + dbl(0.8) * sev + dbl(1.2) * vul - dbl(0.8) * sent
         + dbl(0.01) * F.col("historical_backlog") + (dbl(1.0) - res)
         + dbl(0.005) * F.col("weather_rain_mm") + dbl(0.006) * F.col("traffic_index")
         + dbl(0.5) * F.col("festival_season") + dbl(0.4) * (dbl(1.0) - bus)
         + dbl(0.5) * wkd - dbl(2.5))
    expected = (dbl(48.0) + dbl(24.0) * sev + dbl(36.0) * vul
                + dbl(24.0) * F.col("historical_backlog") / dbl(100.0)
                + dbl(48.0) * (dbl(1.0) - res) + dbl(12.0) * (dbl(1.0) - bus)
                + dbl(24.0) * wkd + dbl(12.0) * F.col("weather_rain_mm") / dbl(50.0)
                + dbl(6.0) * F.col("traffic_index") / dbl(100.0))
    stage4 = stage3.select("*", sigmoid(z).alias("pred_sla_breach_prob"), expected.alias("_expected"))
    p = F.col("pred_sla_breach_prob")
    level = (F.when(~F.col("_k4"), 0).when(F.col("_k40") < 24, 1)
             .when(F.col("_k40") < 36, 2).otherwise(3))
    stage5 = stage4.select(
        "*",
        (F.greatest(dbl(24.0), F.col("_expected") * (dbl(1.0) + F.col("_noise")))
         * (dbl(1.0) + dbl(0.8) * p)).alias("_raw_h"),
        F.when(F.col("_k4"), 1).otherwise(0).alias("escalated"),
        level.alias("escalation_level"),
    )
    capped = F.least(F.col("_raw_h"), (F.col("sla_deadline_hours") * 3).cast("double"))
    speed = (F.when(F.col("escalation_level") == 1, dbl(0.7))
             .when(F.col("escalation_level") == 2, dbl(0.7) * dbl(0.7))
             .when(F.col("escalation_level") == 3, dbl(0.7) * dbl(0.7) * dbl(0.7))
             .otherwise(dbl(1.0)))
    stage6 = stage5.select(
        "*",
        F.when(F.col("escalation_level") == 0, capped).otherwise(capped * speed).alias("resolution_hours"))
    breach_h = F.when(F.col("escalated") == 1, F.col("resolution_hours")).otherwise(F.col("_raw_h"))
    priority = round_half_even(
        F.lit(100.0) * clip(dbl(0.5) * p + dbl(0.2) * (sev / dbl(3.0)) + dbl(0.15) * vul
                            + dbl(0.1) * ((dbl(1.0) - sent) / dbl(2.0)) + dbl(0.05) * F.col("festival_season"),
                            0.0, 1.0), 1)
    out = stage6.select(
        "*",
        F.when(breach_h > F.col("sla_deadline_hours"), 1).otherwise(0).alias("sla_breach"),
        (F.col("resolution_hours") / dbl(24.0)).alias("escalation_days"),
        priority.alias("priority_score"),
    )
    return out.select(*dims.PREDICTION_COLUMNS)


MATERIALIZE_CONF = "spark.slaframe.materializeTickets"
_STORED: dict[tuple[str, str, str], str] = {}


def ticket_folders(spark: SparkSession, sf_dir: str, as_of: str = dims.AS_OF) -> DataFrame:
    """The derived ticket table with ``created_date``, its folder column: written
    once per session as parquet partitioned by creation date under the shared
    checkpoint folder, then read back (the production pattern: derive once,
    query many times)."""
    from ..session import fresh_dir
    key = (spark.sparkContext.applicationId, sf_dir, as_of)
    if key not in _STORED:
        path = fresh_dir(spark, "tickets")
        (tickets(spark, sf_dir, as_of).withColumn("created_date", F.to_date("created_at"))
         .hint("rebalance", "created_date").write.partitionBy("created_date").parquet(path))
        _STORED[key] = path
    return spark.read.parquet(_STORED[key]).select(*dims.PREDICTION_COLUMNS, "created_date")


def stored_tickets(spark: SparkSession, sf_dir: str, as_of: str = dims.AS_OF) -> DataFrame:
    """The ticket table: from ``ticket_folders`` if ``spark.slaframe.materializeTickets``
    is true, else the plain derivation."""
    if spark.conf.get(MATERIALIZE_CONF, "false").lower() != "true":
        return tickets(spark, sf_dir, as_of)
    return ticket_folders(spark, sf_dir, as_of).drop("created_date")
