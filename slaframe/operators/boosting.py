"""M05 with the split minimum and deviance leaves that MLlib's trees lack.

Gradient boosting over histograms. Every feature is coded once: a numeric one by
its place among at most ``bins`` quantile cuts, a category by its place among its
``MAX_LEVELS`` most frequent values (others share -1 and are never split off). The codes
are checkpointed. A level of a tree is one grouped aggregate over (node, feature,
code), with a partial step in each task; only these histograms, whose size does not depend
on the rows, come to the driver, which chooses the splits:

* the gain is the squared distance of the two mean residuals, weighted by the two counts;
* a node of fewer than ``min_split`` rows is a leaf, a side of fewer than ``min_leaf`` rows no side;
* a leaf's value is the Newton step of the deviance, sum of residuals over sum of p(1-p);
* equal gains (9 digits) go to the first feature, then to the least code.

Rows of a round are chosen by a hash of id and round, so a lost task draws the same ones.
Scores of the rows are stored again every ``CHECKPOINT_ROUNDS`` rounds.

A level is a job of its own, so small tables cost the jobs' overhead: MLlib's trees, the default of
M05, are several times faster there (README). The first tree weighs ``rate`` like all others, where
MLlib's first one counts in full.

Defined cases: a null number lies above all cuts, a null category is one of the
others; rows with a null label are left out of the fit; rows with one id are drawn together; an empty table and
a constant label raise ValueError. The column with the score replaces one of that name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .model import CAT_COLS, LABEL, NUM_COLS

MAX_LEVELS = 255
CHECKPOINT_ROUNDS = 5
RAW, CODES = "_raw", "_codes"


@dataclass
class Node:
    """A node and what its rows sum up to; a leaf has no feature."""
    rows: int
    residuals: float
    weights: float
    feature: int | None = None
    code: int | None = None

    @property
    def value(self) -> float:
        return self.residuals / self.weights if self.weights else 0.0


@dataclass
class Boosted:
    """A fitted model: plain numbers, small enough for the driver at any size of data."""
    levels: dict[str, list[str]]
    cuts: dict[str, list[float]]
    start: float
    rate: float
    trees: list[dict[int, Node]] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.levels, *self.cuts]

    def codes(self) -> Column:
        """array<int>: the codes of a row, in the order of ``features``."""
        cats = [F.coalesce(F.array_position(F.lit(values).cast("array<string>"), F.col(c).cast("string")) - 1, F.lit(-1)).cast("int")
                for c, values in self.levels.items()]
        nums = []
        for c, cuts in self.cuts.items():
            code = reduce(lambda acc, k: acc.when(F.col(c) <= cuts[k], k), range(1, len(cuts)),
                          F.when(F.col(c) <= cuts[0], 0)) if cuts else F.when(F.lit(False), 0)
            nums.append(code.otherwise(len(cuts)))
        return F.array(*cats, *nums)

    def goes_left(self, node: Node, codes: str) -> Column:
        code = F.get(F.col(codes), node.feature)
        return code == node.code if node.feature < len(self.levels) else code <= node.code

    def route(self, tree: dict[int, Node], leaf, codes: str = CODES, at: int = 0) -> Column:
        """``leaf(number)`` of the node in which a row's way ends."""
        node = tree.get(at)
        if node is None or node.feature is None:
            return leaf(at)
        return (F.when(self.goes_left(node, codes), self.route(tree, leaf, codes, 2 * at + 1))
                .otherwise(self.route(tree, leaf, codes, 2 * at + 2)))

    def step(self, tree: dict[int, Node], codes: str = CODES) -> Column:
        return self.route(tree, lambda at: F.lit(self.rate * tree[at].value), codes)


def _cuts(train: DataFrame, cols: list[str], bins: int) -> dict[str, list[float]]:
    found = train.approxQuantile(cols, [i / bins for i in range(1, bins)], 0.1 / bins)
    return {c: sorted(set(q)) for c, q in zip(cols, found)}


def _levels(train: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """The most frequent values (ties by name), in the order of their names."""
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)]))
    counted = train.select(named.alias("x")).where("x.v is not null").groupBy("x.f", "x.v").count()
    top = Window.partitionBy("f").orderBy(F.col("count").desc(), "v")
    got = counted.withColumn("k", F.row_number().over(top)).where(F.col("k") <= MAX_LEVELS).collect()
    return {c: sorted(r.v for r in got if r.f == i) for i, c in enumerate(cols)}


def _best(sums: dict[tuple[int, int], tuple[int, float, float]], n_cats: int, total: Node, min_leaf: int):
    """(gain, feature, code, left) of the best split of one node, or None."""
    best = None
    ahead = None
    for (f, code), own in sorted(sums.items()):
        if f >= n_cats:  # numbers: everything up to the code goes left
            own = tuple(a + b for a, b in zip(ahead[1], own)) if ahead and ahead[0] == f else own
            ahead = (f, own)
        elif code < 0:
            continue
        n, r, _ = own
        if min(n, total.rows - n) < max(min_leaf, 1):
            continue
        gap = r / n - (total.residuals - r) / (total.rows - n)
        gain = round(n * (total.rows - n) / total.rows * gap * gap, 9)
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, f, code, own)
    return best


def _grow(model: Boosted, bag: DataFrame, depth: int, min_split: int, min_leaf: int) -> dict[int, Node]:
    """One tree over rows with codes, residual ``_r`` and weight ``_h``."""
    tree: dict[int, Node] = {}
    codes = F.posexplode(CODES).alias("f", "code")
    level = [0]
    for _ in range(depth):
        node = model.route(tree, lambda at: F.lit(at))
        hist = (bag.withColumn("node", node).where(F.col("node").isin(level)).select("node", "_r", "_h", codes)
                .groupBy("node", "f", "code").agg(F.count(F.lit(1)), F.sum("_r"), F.sum("_h")))
        sums: dict[int, dict] = {}
        for at, f, code, *own in hist.collect():  # at most 2**depth x features x codes
            sums.setdefault(at, {})[f, code] = tuple(own)
        if not tree:
            own = [v for (f, _), v in sorted(sums.get(0, {}).items()) if f == 0]
            tree[0] = Node(*(sum(x) for x in zip(*own))) if own else Node(0, 0.0, 0.0)
        grown = []
        for at in level:
            node = tree[at]
            best = _best(sums.get(at, {}), len(model.levels), node, min_leaf) if node.rows >= min_split else None
            if best:
                _, node.feature, node.code, (n, r, h) = best
                tree[2 * at + 1] = Node(n, r, h)
                tree[2 * at + 2] = Node(node.rows - n, node.residuals - r, node.weights - h)
                grown += [k for k in (2 * at + 1, 2 * at + 2) if tree[k].rows >= min_split]
        level = grown
        if not level:
            break
    return tree


def fit(train: DataFrame, label: str = LABEL, id_col: str = "ticket_id", cats: list[str] | None = None, nums: list[str] | None = None,
        rounds: int = 200, depth: int = 5, rate: float = 0.1, subsample: float = 0.8, min_split: int = 20, min_leaf: int = 10,
        bins: int = 32, cuts: dict[str, list[float]] | None = None, seed: str = "42") -> Boosted:
    """Boosted trees of the training rows. ``cuts`` gives fixed cuts of
    numbers instead of quantiles."""
    ensure_checkpoint_dir(train.sparkSession)
    cats, nums = CAT_COLS if cats is None else cats, NUM_COLS if nums is None else nums
    train = train.where(F.col(label).isNotNull())
    mean = train.agg(F.avg(label)).first()[0]
    if mean is None or not 0 < mean < 1:
        raise ValueError("the label is constant or there are no rows")
    cuts = cuts or {}
    rest = [c for c in nums if c not in cuts]
    found = _cuts(train, rest, bins) if rest else {}
    model = Boosted(_levels(train, cats) if cats else {}, {c: cuts.get(c, found.get(c)) for c in nums}, math.log(mean / (1 - mean)), rate)
    rows = train.select(F.col(id_col).cast("string").alias("_id"), F.col(label).cast("double").alias("_y"),
                        F.lit(model.start).alias(RAW), model.codes().alias(CODES)).checkpoint()
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(RAW)))
    below = f"{round(subsample * 16**8):08x}"
    for t in range(rounds):
        drawn = rows if subsample >= 1 else rows.where(F.substring(F.md5(F.concat("_id", F.lit(f"{seed}-{t}"))), 1, 8) < below)
        bag = drawn.withColumn("_p", p).withColumns({"_r": F.col("_y") - F.col("_p"), "_h": F.col("_p") * (1 - F.col("_p"))})
        tree = _grow(model, bag, depth, min_split, min_leaf)
        model.trees.append(tree)
        rows = rows.withColumn(RAW, F.col(RAW) + model.step(tree))
        if (t + 1) % CHECKPOINT_ROUNDS == 0 and t + 1 < rounds:
            rows = rows.checkpoint()
    return model


def score(model: Boosted, df: DataFrame, out: str = "pred_sla_breach_prob") -> DataFrame:
    """M06 / M11 for this model: a narrow map of built-in expressions."""
    codes = CODES
    while codes in {c.lower() for c in df.columns}:
        codes += "_"
    raw = reduce(lambda acc, tree: acc + model.step(tree, codes), model.trees, F.lit(model.start))
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.select("*", model.codes().alias(codes)).select(*keep, (F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))).alias(out))


def nodes(model: Boosted, tree: int, df: DataFrame) -> DataFrame:
    """A tree as rows: node, feature (null in leaves), code (-1 in leaves), rows, value."""
    got = [(at, None if n.feature is None else model.features[n.feature], -1 if n.code is None else n.code, n.rows, n.value)
           for at, n in sorted(model.trees[tree].items())]
    return df.sparkSession.createDataFrame(got, "node int, feature string, code int, rows long, value double")
