"""Empty tables, one class, null keys."""

from pyspark.sql import functions as F

from slaframe.functions.strata import exact_stratified_flag, hash_order
from slaframe.operators import checks, kpis, model
from slaframe.sources.tickets import stored_tickets

from conftest import SF_SMALL


def test_empty_table_gives_zero_or_null(spark):
    empty = stored_tickets(spark, SF_SMALL).where("false")
    split = checks.recency_split(empty).first()
    assert split.total == 0 and split.recent_pct is None
    ready = checks.readiness(empty).first()
    assert ready.total == 0 and ready.already_breached_pct is None
    k = kpis.executive_summary(empty).first()
    assert k.tickets == 0 and k.critical == 0


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.2, 1), (0.9, 1)], "p double, sla_breach int")
    assert model.auc(df, "p").first().auc is None


def test_null_order_keys_stay_unselected(spark):
    df = spark.range(1500).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"), (F.col("id") % 2).alias("s"))
    quota = spark.createDataFrame([(0, 100), (1, 100)], "s long, quota long")
    out = exact_stratified_flag(df, "s", quota, hash_order(F.col("k")), "pick")
    assert out.count() == 1500
    assert out.where("pick").count() == 200
    assert out.where("k is null and pick").count() == 0
