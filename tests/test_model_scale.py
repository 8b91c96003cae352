"""Model queries at size: tasks of the fit, AUC by groups read once, importance against brute force."""

import numpy as np

from slaframe.operators import model as M
from slaframe.plans import model_queries as Q
from slaframe.sources.tickets import tickets

from conftest import SF_SMALL
from test_skewed_scores import brute_auc

P = "pred_sla_breach_prob"


def test_fit_has_tasks_by_rows_and_cores():
    assert [Q.fit_tasks(n, 12) for n in (0, 12_000, 120_000)] == [1, 1, 3]
    assert Q.fit_tasks(7_200_000, 12) == 24
    assert Q.fit_tasks(7_200_000, 1) == 4  # two million rows a task at most
    assert Q.fit_tasks(7_200_000, 1_000) == 144


def test_auc_is_the_same_with_any_cuts(spark):
    rng = np.random.default_rng(3)
    n = 3000
    group, score = rng.integers(0, 3, n), np.round(rng.random(n), 2)
    label = (rng.random(n) < score).astype(int)
    group[:5], label[:5] = 3, 1  # a group of one class
    df = spark.createDataFrame(list(zip(group.tolist(), score.tolist(), label.tolist())), "g int, p double, sla_breach int")
    counts = M.score_counts(df, "p", by=["g"])
    for cuts in (None, [float("-inf"), 0.25, 0.5, float("inf")], [float("-inf"), 7.0, float("inf")]):
        got = {r.g: r.auc for r in M.auc_from_counts(counts, "p", ["g"], cuts=cuts).collect()}
        assert sorted(got) == [0, 1, 2, 3] and got[3] is None
        assert all(abs(got[g] - brute_auc(score[group == g], label[group == g])) < 1e-12 for g in range(3))


def test_importance_equals_brute_force_and_stores_no_variants(spark, monkeypatch):
    test = M.features(tickets(spark, SF_SMALL).limit(400)).checkpoint()
    rows = {r.ticket_id: r for r in test.collect()}
    stored = []
    kept = type(test).checkpoint
    monkeypatch.setattr(type(test), "checkpoint", lambda df, *a: stored.append(kept(df, *a)) or stored[-1])
    got = {r.feature: r for r in M.permutation_importance(Q._propensity, test, repeats=2).collect()}
    monkeypatch.undo()
    assert all(df.count() <= 400 for df in stored)  # 16 x 2 variants before
    pairs = M._pairing(test, 2, 42).collect()

    def auc(made):
        df = spark.createDataFrame(made, test.schema)
        scored = Q._propensity(df).toPandas()
        return brute_auc(scored[P].to_numpy(), scored.sla_breach.to_numpy())

    base = auc(list(rows.values()))
    for f in ("severity", "district", "weather_rain_mm"):
        drops = [base - auc([tuple(r[f"_p_{c}"] if c == f else r[c] for c in test.columns) for r in pairs if r.repeat == k]) for k in (0, 1)]
        assert abs(got[f].importance_mean - np.mean(drops)) < 1e-12 and abs(got[f].importance_std - np.std(drops)) < 1e-12


def test_score_gives_trees_dense_vectors(spark):
    train = M.features(tickets(spark, SF_SMALL)).checkpoint()
    model = M.train_gbt(train, max_iter=2, max_depth=3)
    plan = M.score(model, train)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF") > model.transform(train).select("probability")._jdf.queryExecution().optimizedPlan().toString().count("UDF")
    a = {r.ticket_id: r[P] for r in M.score(model, train).collect()}
    b = {r.ticket_id: float(r.probability[1]) for r in model.transform(train).select("ticket_id", "probability").collect()}
    assert a == b
