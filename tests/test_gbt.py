"""The fit over bundled histograms and the leaf masks, against MLlib's own fit and scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slaframe.operators import gbt
from slaframe.operators import model as M
from slaframe.sources.tickets import tickets

from conftest import SF_SMALL

P = "pred_sla_breach_prob"


@pytest.fixture(scope="module")
def train(spark):
    return M.features(tickets(spark, SF_SMALL)).repartition(3, "ticket_id").checkpoint()


@pytest.fixture(scope="module")
def model(spark, train):
    kept, M.MLLIB_ROWS = M.MLLIB_ROWS, 0
    try:
        return M.train_gbt(train, max_iter=5)
    finally:
        M.MLLIB_ROWS = kept


def _scores(df, col=P):
    return {r.ticket_id: r[col] for r in df.select("ticket_id", col).collect()}


def test_fit_equals_mllib_when_all_rows_are_drawn(spark, train, monkeypatch):
    theirs = M.train_gbt(train, max_iter=4, subsample=1.0)
    fits = []
    fit = gbt.fit
    monkeypatch.setattr(gbt, "fit", lambda *a: fits.append(fit(*a)) or fits[-1])
    monkeypatch.setattr(M, "MLLIB_ROWS", 0)
    monkeypatch.setattr(gbt, "CHECKPOINT_ROUNDS", 2)
    own = M.train_gbt(train, max_iter=4, subsample=1.0)
    assert fits == [own] and own.stages[-1].treeWeights == theirs.stages[-1].treeWeights == [1.0, 0.1, 0.1, 0.1]
    a, b = _scores(M.score(own, train)), _scores(M.score(theirs, train))
    assert len(set(a.values())) > 20 and max(abs(a[k] - b[k]) for k in b) < 1e-9


def test_rounds_draw_rows_and_repeat_themselves(train, model, monkeypatch):
    monkeypatch.setattr(M, "MLLIB_ROWS", 0)
    again = M.train_gbt(train, train.count(), max_iter=5)
    assert again.stages[-1].toDebugString.split("\n")[1:] == model.stages[-1].toDebugString.split("\n")[1:]
    root = [t._call_java("rootNode").impurityStats().rawCount() for t in model.stages[-1].trees]
    assert len(set(root)) > 1 and all(0.7 * train.count() < n < 0.9 * train.count() for n in root)


def test_masks_score_like_the_trees(spark, train, model):
    odd = train.limit(60).withColumns({"ward": F.lit("new"), "dept": F.lit(None).cast("string"), "severity": F.lit(None).cast("int"),
                                       "weather_rain_mm": F.lit(float("nan"))}).withColumn("ticket_id", F.concat(F.lit("odd"), "ticket_id"))
    rows = train.unionByName(odd).checkpoint()
    masks = gbt.masks(model)
    got, want = _scores(masks.score(masks.coded(rows), P)), _scores(M.score(model, rows))
    assert len(got) == len(want) > 60 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert gbt.masks(M.train_gbt(train, max_iter=1, max_depth=3)) is not None  # of MLlib's own fit, too


def test_importance_by_masks_equals_importance_by_rows(train, model, monkeypatch):
    test = train.limit(300).checkpoint()
    own = {r.feature: r for r in M.permutation_importance(model, test, repeats=2).collect()}
    monkeypatch.setattr(gbt, "masks", lambda model: None)
    rows = {r.feature: r for r in M.permutation_importance(model, test, repeats=2).collect()}
    assert own.keys() == rows.keys() and len({r.importance_mean for r in own.values()}) > 3
    for f, r in rows.items():
        assert abs(own[f].importance_mean - r.importance_mean) < 1e-12 and abs(own[f].importance_std - r.importance_std) < 1e-12


def test_thresholds_by_shares_of_rows():
    assert list(gbt.thresholds(np.array([3.0, 1, 1, np.nan, 2]), 32)) == [1.5, 2.5]
    assert len(gbt.thresholds(np.array([5.0, 5, 5]), 32)) == 0
    many = gbt.thresholds(np.arange(10_000.0), 32)
    assert len(many) == 31 and np.ptp(np.diff(many)) <= 1


def test_bad_labels_and_numbers_are_refused(train, monkeypatch):
    monkeypatch.setattr(M, "MLLIB_ROWS", 0)
    with pytest.raises(Exception, match="neither 0 nor 1"):
        M.train_gbt(train.withColumn("sla_breach", F.lit(2)), max_iter=1)
    with pytest.raises(Exception, match="null or infinite"):
        M.train_gbt(train.withColumn("severity", F.when(F.col("severity") > 1, F.col("severity"))), max_iter=1)
