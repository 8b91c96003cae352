"""Model quality and persistence (rows-only operators)."""

from pyspark.sql import functions as F

from slaframe.operators import checks
from slaframe.operators import model as M
from slaframe.session import fresh_dir
from slaframe.sources import files
from slaframe.sources.tickets import tickets

from conftest import SF_SMALL


def test_split_fit_score_save(spark):
    t = tickets(spark, SF_SMALL)
    split = M.stratified_split(t).checkpoint()
    rates = {r.is_test: (r.rows, r.breach_rate) for r in M.split_rates(split).collect()}
    n = t.count()
    assert abs(rates[True][0] - 0.2 * n) <= 2
    model = M.train_gbt(M.features(split.where(~F.col("is_test"))), max_iter=5)
    test = M.features(split.where(F.col("is_test")))
    scored = M.score(model, test)
    assert M.auc(scored, "pred_sla_breach_prob").collect()[0].auc > 0.6
    path = fresh_dir(spark, "test-model")
    files.save_model(model, path)
    again = M.score(files.load_model(path), test)
    a = {r.ticket_id: r.pred_sla_breach_prob for r in scored.collect()}
    b = {r.ticket_id: r.pred_sla_breach_prob for r in again.collect()}
    assert a == b
    imp = M.permutation_importance(model, test, repeats=2)
    assert imp.count() == 16
    cons = checks.coef_consistency(imp).collect()
    assert {r.feature for r in cons} == {"vulnerable_population", "resource_availability", "severity",
                                         "citizen_sentiment", "district", "festival_season", "is_weekend"}
    assert all(r.overall in ("PASS", "WARNING") for r in cons)


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    got = [r.x_z for r in M.standardize(df, ["x"]).collect()]
    assert abs(got[0] + 1.3416407864998738) < 1e-12
