"""M05 and M12 at size: the boosting of MLlib's GBTClassifier, and its trees applied by leaf masks.

``fit`` builds what ``GBTClassifier`` builds, as one of MLlib's own models: log loss, residuals as labels of
regression trees, variance gain, thresholds by MLlib's rule from a sample of 10,000 rows, the same limits, learning
rate and rounds, all training rows. What differs is how a level is summed up:

* MLlib adds every row to the bins of every assembled column. Here the one-hot columns of a category are one feature
  with a bin a value; their splits (value against the rest) follow from its bins.
* Features are bundled: the bins of several make one mixed-radix code of at most ``BUNDLE_CELLS`` values, and a
  feature's histogram is a margin of its bundle's. A row is added to five bundles instead of 79 columns.
* Rows are blocks of ``BLOCK_ROWS`` in numpy; the coded blocks are checkpointed. A level is a job whose tasks return the
  histograms of their rows, whose size does not depend on the rows; the driver chooses the splits. A job costs its start
  beside its work, a thousand times, so there is one task a core, unless it had more than ``TASK_ROWS`` rows.

A block's scores are advanced by one tree a round, persisted, and checkpointed every ``CHECKPOINT_ROUNDS`` rounds;
the checkpoint before is then deleted. The rows of a round are drawn by a generator seeded with round, partition and
block, so a task that runs again draws the same ones. Sums are added in the order of the partitions.

Leaf masks: a tree gives each bin of each feature the set of leaves that this bin leaves open, as bits. The leaf
of a row is the one bit left when the masks of its bundles are joined by AND, so a tree costs a lookup a bundle, and
another value of one feature costs one more lookup.

Defined cases: a null category is the indexer's unknown one. As in MLlib, the fit raises an error for a null or infinite
number and for a label other than 0 and 1, and trees send a null number to the right.
"""

from __future__ import annotations

import array
import pickle
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BUNDLE_CELLS = 2048
BLOCK_ROWS = 65_536
CHECKPOINT_ROUNDS = 20
MAX_DEPTH = 5  # 32 leaves, one bit each
TASK_ROWS = 2_000_000
REDUCE_FROM = 64  # partitions beyond which histograms are summed on the executors first
SCORE_ROWS = 8_192
_ALL = 0xFFFFFFFF
_EXPONENT = 127  # of 1.0 as float32: bit k of a mask, read as a number, has exponent 127 + k
_EPSILON = np.finfo(float).eps

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


@dataclass
class Layout:
    """Features in the order of the assembler, their bins, and the bundles that hold them."""
    cats: dict[str, int]          # bins of each category
    cuts: dict[str, np.ndarray]   # thresholds of each number: its bin is the count of those below it

    def __post_init__(self):
        self.names = [*self.cats, *self.cuts]
        self.sizes = [*self.cats.values(), *(len(x) + 1 for x in self.cuts.values())]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bundles: list[list[int]] = []
        self.cells: list[int] = []
        for f in sorted(range(len(self.sizes)), key=lambda f: -self.sizes[f]):
            for b, n in enumerate(self.cells):
                if n * self.sizes[f] <= BUNDLE_CELLS:
                    self.bundles[b].append(f)
                    self.cells[b] *= self.sizes[f]
                    break
            else:
                self.bundles.append([f])
                self.cells.append(self.sizes[f])
        self.least = int(np.argmin(self.cells))
        self.bundle = {f: b for b, fs in enumerate(self.bundles) for f in fs}
        self.stride = {f: int(np.prod([self.sizes[g] for g in fs[i + 1:]], dtype=np.int64)) for fs in self.bundles for i, f in enumerate(fs)}

    def bins(self, columns: list[pa.Array]) -> list[np.ndarray]:
        """Each feature's bins, from the indexed categories and the numbers."""
        values = [np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in columns]
        return ([v.astype(np.int64) for v in values[:len(self.cats)]]
                + [np.searchsorted(t, v, side="left") for t, v in zip(self.cuts.values(), values[len(self.cats):])])

    def codes(self, bins: list[np.ndarray]) -> list[np.ndarray]:
        return [sum(bins[f] * self.stride[f] for f in fs) for fs in self.bundles]

    def tables(self, splits: dict[int, tuple[int, np.ndarray]]) -> tuple[list[np.ndarray | None], dict[int, np.ndarray], list[int]]:
        """Leaf masks a bundle (None: the tree does not look at it), the same a feature,
        and the nodes that are leaves, in the order of their bits. ``splits``: node (0,
        children 2k + 1 and 2k + 2) -> feature and which of its bins go left."""
        masks: dict[int, np.ndarray] = {}
        leaves: list[int] = []

        def walk(at: int) -> int:
            if at not in splits:
                leaves.append(at)
                return 1 << (len(leaves) - 1)
            left, right = walk(2 * at + 1), walk(2 * at + 2)
            f, goes = splits[at]
            own = masks.setdefault(f, np.full(self.sizes[f], _ALL, np.uint32))
            own &= np.where(goes, np.uint32(_ALL ^ right), np.uint32(_ALL ^ left))
            return left | right

        whole = np.uint32(walk(0))
        masks = {f: m & whole for f, m in masks.items()}
        out: list[np.ndarray | None] = []
        for fs, n in zip(self.bundles, self.cells):
            found = [masks[f][np.arange(n) // self.stride[f] % self.sizes[f]] for f in fs if f in masks]
            out.append(reduce(np.bitwise_and, found) if found else None)
        return out, masks, leaves


def _places(mask: np.ndarray) -> np.ndarray:
    """The exponents of masks of one bit: 127 + the bit's place."""
    return mask.astype(np.float32).view(np.int32) >> 23


def _leaf_places(tables: list[np.ndarray | None], codes: list[np.ndarray]) -> np.ndarray:
    found = [t[c] for t, c in zip(tables, codes) if t is not None]
    return _places(reduce(np.bitwise_and, found)) if found else np.full(len(codes[0]), _EXPONENT)


def _by_place(values: list, rest=0) -> np.ndarray:
    out = np.full(_EXPONENT + 33, rest, np.result_type(*values, rest) if values else float)
    out[_EXPONENT:_EXPONENT + len(values)] = values
    return out


# ------------------------------------------------------------- thresholds

def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """MLlib's thresholds of a number: all middles between neighbours if they are few enough,
    else those nearest to equal shares of the rows. Nulls are left out."""
    found, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= bins - 1:
        return middles
    stride = counts.sum() / bins
    out, seen, target = [], int(counts[0]), stride
    for i in range(1, len(found)):
        before, seen = seen, seen + int(counts[i])
        if abs(before - target) < abs(seen - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def _layout(train: DataFrame, rows: int, indexer: StringIndexerModel, cats: list[str], nums: list[str], bins: int, seed: int) -> Layout:
    most = max(bins * bins, 10_000)
    some = train.select(*[F.col(c).cast("double") for c in nums])
    got = np.array([tuple(r) for r in (some if rows <= most else some.sample(False, most / rows, seed)).collect()], float).reshape(-1, len(nums))
    return Layout({c: len(x) + 1 for c, x in zip(cats, indexer.labelsArray)}, {c: thresholds(got[:, i], min(bins, rows)) for i, c in enumerate(nums)})


# ------------------------------------------------------------- rows

def _blocks(layout: Layout, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label and features as blocks: the codes of each bundle, one after the other, and the labels as -1 and 1."""
    kind = np.uint16 if max(layout.cells) <= 1 << 16 else np.uint32
    kept, held = [], 0

    def block():
        codes, labels = zip(*kept)
        whole = np.concatenate([np.concatenate(x) for x in zip(*codes)])
        return pa.record_batch([pa.array([whole.tobytes()], pa.binary()), pa.array([np.concatenate(labels).tobytes()], pa.binary())], ["codes", "labels"])

    for batch in batches:
        label, *columns = batch.columns
        y = np.asarray(label.cast(pa.float64()).to_numpy(zero_copy_only=False))
        if not np.isin(y, (0.0, 1.0)).all():
            raise ValueError("a label is neither 0 nor 1")
        if not all(np.isfinite(c.cast(pa.float64()).to_numpy(zero_copy_only=False)).all() for c in columns[len(layout.cats):]):
            raise ValueError("a feature is null or infinite")
        codes = layout.codes(layout.bins(columns))
        for at in range(0, len(y), BLOCK_ROWS):
            own = slice(at, at + BLOCK_ROWS)
            n = len(y[own])
            if kept and held + n > BLOCK_ROWS:
                yield block()
                kept, held = [], 0
            kept.append(([c[own].astype(kind) for c in codes], (2 * y[own] - 1).astype(np.int8)))
            held += n
    if kept:
        yield block()


def _codes(layout: Layout, codes: bytes, n: int) -> list[np.ndarray]:
    kind = np.uint16 if max(layout.cells) <= 1 << 16 else np.uint32
    return list(np.frombuffer(codes, kind).reshape(-1, n))


class _Block:
    """Some rows: codes, labels (-1, 1), scores; for a round residuals and the rows drawn."""

    def __init__(self, layout: Layout, part: int, at: int, codes: bytes, labels: bytes, scores: bytes | None = None):
        self.layout, self.part, self.at = layout, part, at
        self.labels = np.frombuffer(labels, np.int8)
        self.codes = _codes(layout, codes, len(self.labels))
        self.scores = None if scores is None else np.frombuffer(scores)

    def start(self, subsample: float, seed: int) -> None:
        y = self.labels.astype(float)
        self.residuals = y if self.scores is None else 4.0 * y / (1.0 + np.exp(2.0 * y * self.scores))
        draw = np.random.Generator(np.random.PCG64([seed, self.part, self.at]))
        self.drawn = None if subsample >= 1 else draw.random(len(y), dtype=np.float32) < subsample

    def advance(self, tables: list[np.ndarray | None], worth: np.ndarray) -> None:
        """Add a tree's (weighted) values to the scores."""
        step = worth[_leaf_places(tables, self.codes)]
        self.scores = step if self.scores is None else self.scores + step


def _advancing(layout: Layout, splits: dict, values: dict[int, float]) -> tuple[list[np.ndarray | None], np.ndarray]:
    tables, _, leaves = layout.tables(splits)
    return tables, _by_place([values[k] for k in leaves])


def _histograms(layout: Layout, splits: dict, active: list[int], last: bool, blocks: Iterator[_Block]) -> np.ndarray:
    """rows, sum and sum of squares of the residuals, by active node and bin, shape (3, nodes,
    bins of all features). The gain needs no squares, so above the ``last`` level only one
    bundle's features have them, for the nodes' totals; the others have zeros."""
    tables, _, leaves = layout.tables(splits)
    none = len(active)
    place = _by_place([active.index(k) if k in active else none for k in leaves], none)
    sums = [np.zeros((3, none + 1, n)) for n in layout.cells]
    for block in blocks:
        node = place[_leaf_places(tables, block.codes)]
        if block.drawn is not None:
            node = np.where(block.drawn, node, none)
        squares = block.residuals * block.residuals
        for b, (own, n, c) in enumerate(zip(sums, layout.cells, block.codes)):
            at = node * n + c
            for total, weights in zip(own, (None, block.residuals, squares)[:3 if last or b == layout.least else 2]):
                total += np.bincount(at, weights, total.size).reshape(total.shape)
    out = np.zeros((3, none, layout.starts[-1]))
    for fs, own in zip(layout.bundles, sums):
        cube = own[:, :none].reshape(3, none, *(layout.sizes[f] for f in fs))
        for k, f in enumerate(fs):
            out[:, :, layout.starts[f]:layout.starts[f + 1]] = cube.sum(axis=tuple(2 + j for j in range(len(fs)) if j != k))
    return out


class _Rows:
    """The training rows, a job a level; the blocks of a round are held until the next ones are stored."""

    def __init__(self, layout: Layout, blocks: RDD):
        self.layout, self.round, self.before, self.path = layout, 0, None, None
        self.blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)

    def start(self, subsample: float, seed: int) -> None:
        self.draw = (subsample, seed)

    def histograms(self, splits: dict, active: list[int], last: bool) -> np.ndarray:
        layout, draw = self.layout, self.draw

        def run(rows):
            def started():
                for row in rows:
                    block = _Block(layout, *row)
                    block.start(*draw)
                    yield block
            yield _histograms(layout, splits, active, last, started())

        found = self.blocks.mapPartitions(run)
        out = found.treeReduce(np.add) if found.getNumPartitions() > REDUCE_FROM else reduce(np.add, found.collect())
        self._stored()
        return out

    def advance(self, splits: dict, values: dict[int, float]) -> None:
        layout = self.layout

        def run(rows):
            step = _advancing(layout, splits, values)
            for row in rows:
                block = _Block(layout, *row)
                block.advance(*step)
                yield *row[:4], block.scores.tobytes()

        self.before, self.blocks = self.blocks, self.blocks.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)
        self.round += 1
        if self.round % CHECKPOINT_ROUNDS == 0:
            self.blocks.checkpoint()

    def _stored(self) -> None:
        """A job has run over the blocks: what they were made of is let go."""
        if self.before is not None:
            self.before.unpersist()
            self.before = None
            if self.blocks.getCheckpointFile():
                self._drop()
                self.path = self.blocks.getCheckpointFile()

    def _drop(self) -> None:
        if self.path:
            ctx = self.blocks.context
            p = ctx._jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(ctx._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        self.blocks.unpersist()
        self._drop()


# ------------------------------------------------------------- trees

@dataclass
class Node:
    """A node with MLlib's statistics: rows, sum, sum of squares. A leaf has no feature."""
    stats: np.ndarray
    valid: bool = True          # False: a split was looked for and none was allowed
    gain: float = -1.0
    feature: int | None = None
    bin: int = -1               # numbers: bins up to it go left
    equal: bool = False         # categories: does this value go left, or do all others

    @property
    def value(self) -> float:
        return self.stats[1] / self.stats[0] if self.stats[0] else 0.0

    @property
    def impurity(self) -> float:
        return float(_variance(self.stats))

    def goes_left(self, layout: Layout) -> np.ndarray:
        bins = np.arange(layout.sizes[self.feature])
        return (bins == self.bin) == self.equal if self.feature < len(layout.cats) else bins <= self.bin


def _variance(x: np.ndarray) -> np.ndarray:
    n = np.where(x[0] > 0, x[0], 1.0)
    return np.where(x[0] > 0, (x[2] - x[1] * x[1] / n) / n, 0.0)


def _split(layout: Layout, node: Node, hist: np.ndarray, min_rows: int) -> tuple[Node, Node] | None:
    """Choose the node's split as MLlib does, the first of the best, and return its children."""
    lefts, rights, which = [], [], []
    for f in range(len(layout.sizes)):
        own = hist[:, layout.starts[f]:layout.starts[f + 1]]
        if f < len(layout.cats):
            rest = own.sum(axis=1, keepdims=True) - own
            with np.errstate(divide="ignore", invalid="ignore"):
                equal = (own[0] > 0) & ((rest[0] == 0) | (own[1] / own[0] < rest[1] / rest[0]))
            lefts.append(np.where(equal, own, rest))
            rights.append(np.where(equal, rest, own))
            which += [(f, k, bool(e)) for k, e in enumerate(equal)]
        else:
            sums = own.cumsum(axis=1)
            lefts.append(sums[:, :-1])
            rights.append(sums[:, -1:] - sums[:, :-1])
            which += [(f, k, False) for k in range(own.shape[1] - 1)]
    left, right = np.concatenate(lefts, axis=1), np.concatenate(rights, axis=1)
    rows = np.maximum(left[0] + right[0], 1.0)
    parts = sum(x[1] * x[1] / np.maximum(x[0], 1.0) for x in (left, right))  # the squares cancel out
    gain = (parts - (left[1] + right[1]) ** 2 / rows) / rows
    gain = np.where((left[0] >= min_rows) & (right[0] >= min_rows) & (gain >= 0), gain, -np.inf)
    best = int(np.argmax(gain)) if len(gain) else -1
    node.valid = best >= 0 and gain[best] > -np.inf
    if not node.valid or gain[best] <= 0:
        return None
    node.gain, (node.feature, node.bin, node.equal) = float(gain[best]), which[best]
    return Node(left[:, best]), Node(right[:, best])


def _grow(layout: Layout, rows: _Rows, depth: int, min_rows: int) -> dict[int, Node]:
    tree: dict[int, Node] = {}
    splits: dict[int, tuple[int, np.ndarray]] = {}
    active = [0]
    f = layout.bundles[layout.least][0]
    for level in range(depth):
        hists = rows.histograms(splits, active, level == depth - 1)
        totals = hists[:, :, layout.starts[f]:layout.starts[f + 1]].sum(axis=2)
        tree.setdefault(0, Node(totals[:, 0]))
        grown = []
        for k, at in enumerate(active):
            tree[at].stats[2] = totals[2, k]
            if abs(tree[at].impurity) < _EPSILON:
                continue
            found = _split(layout, tree[at], hists[:, k], min_rows)
            if found:
                splits[at] = (tree[at].feature, tree[at].goes_left(layout))
                for side, child in enumerate(found, 1):
                    tree[2 * at + side] = child
                    grown.append(2 * at + side)
        active = grown
        if not active:
            break
    return tree


@dataclass
class Plan:
    rounds: int
    depth: int
    rate: float
    subsample: float
    min_rows: int
    seed: int

    def weight(self, t: int) -> float:
        return self.rate if t else 1.0  # the first tree counts in full


def _boost(layout: Layout, plan: Plan, rows: _Rows) -> list[dict[int, Node]]:
    trees: list[dict[int, Node]] = []
    for t in range(plan.rounds):
        if trees:
            last = trees[-1]
            rows.advance({at: (n.feature, n.goes_left(layout)) for at, n in last.items() if n.feature is not None},
                         {at: n.value * plan.weight(t - 1) for at, n in last.items()})
        rows.start(plan.subsample, (plan.seed + t) % 2**32)
        trees.append(_grow(layout, rows, plan.depth, plan.min_rows))
    return trees


def fit(train: DataFrame, rows: int, encoders: PipelineModel, gbt: GBTClassifier) -> PipelineModel:
    """``encoders`` (fitted) and the model that ``gbt`` describes, fitted on the training rows."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    indexer, _, assembler = encoders.stages
    cats, label = indexer.getInputCols(), gbt.getLabelCol()
    nums = assembler.getInputCols()[len(cats):]
    layout = _layout(train, rows, indexer, cats, nums, gbt.getMaxBins(), gbt.getSeed())
    plan = Plan(gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getStepSize(), gbt.getSubsamplingRate(), gbt.getMinInstancesPerNode(), gbt.getSeed())
    coded = indexer.transform(train.select(label, *cats, *nums)).select(label, *indexer.getOutputCols(), *nums)
    coded = coded.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    blocks = coded.mapInArrow(partial(_blocks, layout), "codes binary, labels binary").checkpoint().rdd
    held = _Rows(layout, blocks.mapPartitionsWithIndex(lambda part, found: (
        (part, i, bytes(codes), bytes(labels), None) for i, (codes, labels) in enumerate(found))))
    trees = _boost(layout, plan, held)
    held.close()
    return PipelineModel([*encoders.stages, _mllib(spark, layout, trees, [plan.weight(t) for t in range(plan.rounds)], gbt)])


def _mllib(spark, layout: Layout, trees: list[dict[int, Node]], weights: list[float], gbt: GBTClassifier) -> GBTClassificationModel:
    """The trees as MLlib's model."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml, calculator = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
    width = sum(layout.cats.values()) + len(layout.cuts)
    columns = [*np.concatenate([[0], np.cumsum(list(layout.cats.values()))])[:-1], *range(width - len(layout.cuts), width)]
    cuts = list(layout.cuts.values())

    def doubles(xs):
        return jvm.org.apache.spark.mllib.api.python.SerDe.loads(bytearray(pickle.dumps(array.array("d", xs), 2)))

    def made(tree, at):
        """(node, its value if it is a leaf); leaves of one value become one, as in MLlib."""
        n = tree[at]
        stats = calculator(doubles(n.stats), int(n.stats[0]))
        if n.feature is not None:
            (left, a), (right, b) = made(tree, 2 * at + 1), made(tree, 2 * at + 2)
            if a is None or a != b:
                if n.feature < len(layout.cats):
                    split = ml.tree.CategoricalSplit(int(columns[n.feature] + n.bin), doubles([float(n.equal)]), 2)
                else:
                    split = ml.tree.ContinuousSplit(int(columns[n.feature]), float(cuts[n.feature - len(layout.cats)][n.bin]))
                return ml.tree.InternalNode(float(n.value), n.impurity, n.gain, left, right, split, stats), None
        return ml.tree.LeafNode(float(n.value), n.impurity if n.valid else -1.0, stats), float(n.value)

    kind = ml.regression.DecisionTreeRegressionModel
    out = gateway.new_array(kind, len(trees))
    for t, tree in enumerate(trees):
        out[t] = kind(made(tree, 0)[0], width)
    model = GBTClassificationModel(ml.classification.GBTClassificationModel(gbt.uid, out, doubles(weights), width, 2))
    model._resetUid(gbt.uid)
    return gbt._copyValues(model)


# ------------------------------------------------------------- a fitted model by masks

@dataclass
class Masks:
    """A fitted model as leaf masks: its layout, and per tree the tables of the bundles, the
    features that it looks at, and its leaves' weighted values."""
    layout: Layout
    indexer: StringIndexerModel
    trees: list[tuple[list[np.ndarray | None], set[int], np.ndarray]]

    def coded(self, df: DataFrame) -> DataFrame:
        """``df`` with its features replaced by their bins (int)."""
        layout, names = self.layout, self.layout.names
        ahead = [c for c in df.columns if c not in names]
        found = self.indexer.transform(df).select(*ahead, *self.indexer.getOutputCols(), *layout.cuts)

        def run(batches):
            for b in batches:
                columns = b.columns
                bins = layout.bins(columns[len(ahead):])
                yield pa.record_batch([*columns[:len(ahead)], *(pa.array(x.astype(np.int32)) for x in bins)], [*ahead, *names])

        return found.mapInArrow(run, df.select(*ahead, *[F.lit(0).alias(c) for c in names]).schema)

    def score(self, coded: DataFrame, out: str) -> DataFrame:
        """P(breach) of coded rows, beside their other columns."""
        layout, trees = self.layout, self.trees
        ahead = [c for c in coded.columns if c not in layout.names]

        def run(batches):
            for b in _sliced(batches):
                own = _bins(b, layout.names)
                margin = _margins(layout, trees, own, {})[0]
                yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in ahead), pa.array(_probability(margin))], [*ahead, out])

        return coded.mapInArrow(run, coded.select(*ahead, F.lit(0.0).alias(out)).schema)

    def score_variants(self, pairs: DataFrame, label: str, out: str) -> DataFrame:
        """P(breach) of each pair of coded rows with one feature after the other taken
        from the second row: label, ``repeat``, ``_variant`` (the feature's place), ``out``."""
        layout, trees = self.layout, self.trees

        def run(batches):
            for b in _sliced(batches):
                own = _bins(b, layout.names)
                other = dict(enumerate(_bins(b, [f"_p_{c}" for c in layout.names])))
                kept = [b.column(b.schema.get_field_index(c)) for c in (label, "repeat")]
                for f, margin in _margins(layout, trees, own, other)[1].items():
                    yield pa.record_batch([*kept, pa.array(np.full(b.num_rows, f, np.int32)), pa.array(_probability(margin))], [label, "repeat", "_variant", out])

        return pairs.mapInArrow(run, pairs.select(label, "repeat", F.lit(0).alias("_variant"), F.lit(0.0).alias(out)).schema)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SCORE_ROWS):
            yield b.slice(at, SCORE_ROWS)


def _bins(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.intp) for c in names]


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-2.0 * margin))


def _margins(layout: Layout, trees: list, own: list[np.ndarray], other: dict[int, np.ndarray]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The trees' sums for the rows, and for the rows with the bins ``other[f]`` of one feature f."""
    codes = layout.codes(own)
    changed = {f: codes[layout.bundle[f]] + (x - own[f]) * layout.stride[f] for f, x in other.items()}
    base, sums = np.zeros(len(own[0])), {f: np.zeros(len(own[0])) for f in other}
    for tables, used, worth in trees:
        found = {b: t[codes[b]] for b, t in enumerate(tables) if t is not None}
        step = worth[_places(reduce(np.bitwise_and, found.values()))] if found else worth[_EXPONENT]
        base += step
        rests = {b: [m for k, m in found.items() if k != b] for b in found} if other else {}
        rests = {b: reduce(np.bitwise_and, ms) if ms else None for b, ms in rests.items()}
        for f, total in sums.items():
            if f in used:
                b = layout.bundle[f]
                mask = tables[b][changed[f]]
                total += worth[_places(mask if rests[b] is None else mask & rests[b])]
            else:
                total += step
    return base, sums


_LINE = re.compile(r"( *)(?:(Tree) \d+ |If \(feature (\d+) (?:<= (\S+)|(not in|in) \{([^}]*)\})\)|Predict: (\S+)|(Else) )")


def _parsed(model: GBTClassificationModel) -> list[dict[int, tuple]]:
    """Each tree as node -> ("leaf", value) or (column, threshold or the values that go left)."""
    trees: list[dict[int, tuple]] = []
    path: list[int] = []
    for line in model.toDebugString.split("\n")[1:]:
        m = _LINE.match(line)
        if not m:
            continue
        depth, tree, column, at, how, values, value, other = m.groups()
        if tree:
            trees.append({})
            path = [0]
        elif other:  # the right side of the split at this depth
            path = path[:len(depth) - 3]
            path.append(2 * path[-1] + 2)
        elif value:
            trees[-1][path[-1]] = ("leaf", float(value))
        else:
            path = path[:len(depth) - 3]
            trees[-1][path[-1]] = (int(column), float(at) if at else ({float(x) for x in values.split(",")}, how == "in"))
            path.append(2 * path[-1] + 1)
    return trees


def masks(model: PipelineModel) -> Masks | None:
    """The leaf masks of a fitted M05, or None for a pipeline of another kind or with trees of more than 32 leaves."""
    kinds = (StringIndexerModel, OneHotEncoderModel, VectorAssembler, GBTClassificationModel)
    if len(model.stages) != len(kinds) or not all(isinstance(s, k) for s, k in zip(model.stages, kinds)):
        return None
    indexer, ohe, assembler, gbt = model.stages
    cats, inputs = indexer.getInputCols(), assembler.getInputCols()
    plain = indexer.getHandleInvalid() == ohe.getHandleInvalid() == assembler.getHandleInvalid() == "keep" and ohe.getDropLast()
    if not plain or inputs[:len(cats)] != ohe.getOutputCols() or ohe.getInputCols() != indexer.getOutputCols() or gbt.numClasses != 2:
        return None
    sizes = {c: len(x) + 1 for c, x in zip(cats, indexer.labelsArray)}
    nums = inputs[len(cats):]
    starts = np.concatenate([[0], np.cumsum(list(sizes.values()))])
    if gbt.numFeatures != starts[-1] + len(nums):
        return None
    parsed = _parsed(gbt)
    cuts: dict[str, set[float]] = {c: set() for c in nums}
    for tree in parsed:
        if sum(n[0] == "leaf" for n in tree.values()) > 32:
            return None
        for column, at in tree.values():
            if column != "leaf" and column >= starts[-1]:
                cuts[nums[column - starts[-1]]].add(at)
    layout = Layout(sizes, {c: np.array(sorted(x)) for c, x in cuts.items()})

    def split(column, at):
        if column >= starts[-1]:
            f = len(cats) + column - int(starts[-1])
            return f, np.arange(layout.sizes[f]) <= np.searchsorted(layout.cuts[layout.names[f]], at)
        f = int(np.searchsorted(starts, column, side="right")) - 1
        values, inside = at
        return f, (np.isin((np.arange(layout.sizes[f]) == column - starts[f]).astype(float), list(values))) == inside

    out = []
    for tree, weight in zip(parsed, gbt.treeWeights):
        tables, used, leaves = layout.tables({at: split(*n) for at, n in tree.items() if n[0] != "leaf"})
        out.append((tables, set(used), _by_place([tree[k][1] * weight for k in leaves])))
    return Masks(layout, indexer, out)
