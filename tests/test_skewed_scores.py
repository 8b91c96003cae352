"""AUC and permutation where values crowd together."""

import numpy as np
from pyspark.sql import functions as F

from slaframe.operators import model as M


def brute_auc(score, label):
    order = np.sort(score[label == 0])
    below = np.searchsorted(order, score[label == 1], "left")
    upto = np.searchsorted(order, score[label == 1], "right")
    return (below + upto).sum() / 2 / ((label == 1).sum() * (label == 0).sum())


def test_auc_of_concentrated_scores(spark):
    rng = np.random.default_rng(5)
    score = np.concatenate([rng.random(20_000) * 1e-6, [0.0, 0.5, 1.0], np.full(500, 3e-7)])
    label = (rng.random(len(score)) < 0.2 + 4e5 * np.minimum(score, 1e-6)).astype(int)
    df = spark.createDataFrame(list(zip(score.tolist(), label.tolist())), "p double, sla_breach int")
    got = M.auc(df, "p").first().auc
    assert abs(got - brute_auc(score, label)) < 1e-12
    counts = M.score_counts(df, "p")
    cuts = sorted(set(counts.approxQuantile("p", [i / M.AUC_BUCKETS for i in range(1, M.AUC_BUCKETS)], 0.25 / M.AUC_BUCKETS)))
    largest = np.bincount(np.searchsorted(cuts, np.unique(score), "right")).max()
    assert largest < 4 * len(np.unique(score)) / M.AUC_BUCKETS + 4


def test_ranks_are_a_permutation_of_all_rows(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("ticket_id"))
    got = M._ranked(rows, 7).toPandas()
    assert sorted(got["_rank"]) == list(range(1, 5001))
    other = M._ranked(rows, 8).toPandas().set_index("ticket_id")["_rank"]
    assert abs(np.corrcoef(got.set_index("ticket_id")["_rank"].sort_index(), other.sort_index())[0, 1]) < 0.1
