"""Exact stratified selection by a seeded hash order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

KEY_CHARS = 32  # an md5 in hex
ABOVE = "~"     # sorts behind every hex digit


def hash_order(key: Column, seed: str = "42") -> Column:
    """Deterministic order key shared with the DuckDB oracle."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def order_cuts(keys: DataFrame, quota: DataFrame | Callable[[Column], Column], digits: int = 4) -> DataFrame:
    """stratum, cut: the first ``quota`` keys of a stratum are those below its
    cut, found by radix descent.

    ``keys`` (stratum, ord) is read once a level. A level counts the keys that
    agree with the stratum's prefix so far by their next ``digits`` hex digits
    (at most 16**digits rows a stratum, pre-aggregated) and steps into the
    bucket that holds the quota's last key. It ends when every such bucket is
    taken whole, after two levels as a rule, or when the key is used up: equal
    keys then stay out together. ``quota`` is a table (stratum, quota) or
    a function of the stratum's size; strata missing from the table have no cut.
    """
    ensure_checkpoint_dir(keys.sparkSession)
    state = None
    for at in range(0, KEY_CHARS, digits):
        rows = keys
        if state is not None:
            open_ = state.where("need < n").select("stratum", "prefix", "need")
            rows = keys.join(open_, "stratum").where(F.substring("ord", 1, at) == F.col("prefix"))
        hist = rows.groupBy("stratum", F.substring("ord", at + 1, digits).alias("digit")).agg(
            F.count(F.lit(1)).alias("n"), *([F.first("prefix").alias("prefix"), F.first("need").alias("need")] if state is not None else []))
        whole = Window.partitionBy("stratum")
        if state is None:
            total = F.sum("n").over(whole)
            hist = hist.withColumn("size", total).withColumn("prefix", F.lit(""))
            hist = (hist.withColumn("need", quota(F.col("size")).cast("long")) if callable(quota)
                    else hist.join(quota.select("stratum", F.col("quota").cast("long").alias("need")), "stratum"))
        before = F.coalesce(F.sum("n").over(whole.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if state is None:  # an empty or a whole stratum needs no descent
            hist = hist.withColumn("need", F.least(F.greatest("need", F.lit(0)), "size"))
        steps = (hist.withColumn("before", before)
                 .where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
                 .select("stratum", F.concat("prefix", "digit").alias("prefix"), (F.col("need") - F.col("before")).alias("need"), "n"))
        state = (steps if state is None else steps.unionByName(state.where("need = n"))).checkpoint()
        if state.where("need < n").isEmpty():
            break
    return state.select("stratum", F.when(F.col("need") == F.col("n"), F.concat("prefix", F.lit(ABOVE))).otherwise(F.col("prefix")).alias("cut"))


def exact_stratified_flag(df: DataFrame, stratum: str, quota: DataFrame | Callable[[Column], Column], order: Column, out: str,
                          digits: int = 4) -> DataFrame:
    """Add boolean ``out``: the row is among the first ``quota`` rows of its
    stratum by ``order`` (an md5 hex string).

    ``df`` is scanned twice: once for its (stratum, order) pairs, which are
    checkpointed, and once to compare each row's order with its stratum's cut.
    No row is ranked in a window, and the plan has no union. ``quota`` is a table
    (stratum, quota) or a function of the stratum's size. Rows with a null
    order, a null stratum or a stratum without quota get False. Rows with equal
    order (a repeated id) are never torn apart: if all of them would exceed the
    quota, none is taken.
    """
    keys = df.select(F.col(stratum).alias("stratum"), order.alias("ord")).where(F.col("ord").isNotNull() & F.col("stratum").isNotNull())
    ensure_checkpoint_dir(df.sparkSession)
    keys = keys.checkpoint()
    if not callable(quota):
        quota = quota.withColumnRenamed(stratum, "stratum")
    cuts = order_cuts(keys, quota, digits).select(F.col("stratum").alias("_stratum"), F.col("cut").alias("_cut"))
    return (df.withColumn("_ord", order).join(cuts, F.col(stratum) == F.col("_stratum"), "left")
            .withColumn(out, F.coalesce(F.col("_ord") < F.col("_cut"), F.lit(False))).drop("_ord", "_stratum", "_cut"))
