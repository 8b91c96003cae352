"""N-gram Jaccard self-join by parity sketches.

A document's set holds the hashes of its distinct word 5-grams. Its parity
sketch at a level has 2**level cells; a cell is the XOR of the hashes that
fall into it. Every element of the symmetric difference of two sets changes
one cell at most, so the Hamming distance of two sketches, counted in cells,
lower-bounds the symmetric difference. Two sets with Jaccard >= t differ in at
most ``d = (1 - t) / (1 + t) * (a + b)`` elements, so of any d + 1 filled cells
one agrees (pigeonhole). Each document offers its d + 1 globally rarest filled
cells; in any fixed global order the first cell that two documents share is
then among the offers of both. Levels are size bands (mostly of ratio 2): a pair meets
at the level of its larger member, so a document offers cells at its own level
and, if a partner 1/t as large lies in the next one, there too.

Pairs that share an offered cell are first held against each other by the bit
form of a sketch four times as fine (one parity bit a cell): a Hamming distance
above ``d`` rules the pair out. The rest is verified on the exact sets.

Steps and what bounds them:

* ``_census``: one narrow pass gives set size, digest and bit sketch of every
  document, and the cells that are frequent inside a task's block of texts. At
  most ``HOT_CELLS`` of them (16 bytes each) are sent to all tasks; they only
  put frequent cells last in the order, so they cannot change the result.
* ``_postings``: offered cells travel packed, one row per block of texts and
  key range, about 15 bytes a cell. A range keeps the cells that two different
  sets share and, of cells with the same documents, one. A cell that is
  frequent in a block skips its range, split by a salt. Equal sets then become
  one class, named by its smallest id.
* ``_rounds``: instead of all pairs of a cell, its documents are first compared
  with one pivot. Cells whose documents are then still in different components
  are looked through in blocks of sketches: for each document the nearest one of
  another component goes on, in further rounds four times as many, until none
  is left out. No pair that could join two components stays untested, so
  the components are those of all links, while a family of copies costs about
  one pair a document.
* Texts are fetched only for pairs that the sketches let through. The ids are
  broadcast up to ``FEW_IDS``, and joined beyond.
* Joins have plain exchanges on both sides: AQE splits hot pivots and cells.

Larger sets have far more filled cells than d + 1. They offer that many more,
of which a share is sent, chosen by the cell's hash: two sets that link have so
many offers in common that all are left out with a chance below exp(-SURE),
5e-12. So a document sends about a hundred cells, however long it is.

Guarantee: no link is dropped but by chance of hashes. 64-bit hashes stand for
words and shingles; the share above; and a set with more than ``d`` collisions
inside its own sketch, where small sets use 2**32 cells and larger ones have
chances of 1e-7 (17 elements) and far less.

Defined cases: null and empty texts, and texts of white space only, have size
0, link with nothing and are their own component. A row with a null id is
returned with a null component and links with nothing. Repeated rows link and
are all returned; rows that share an id count as one document whose texts all
link. Columns other than id and text are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_blocks, free_name, partitions, stored, table, utf8_column
from .components import connected_components

WORDS = 5
SMALL_SET = 16        # up to this size a set has 2**32 cells
BLOCK_BYTES = 4 << 20  # texts handled at once inside a task
HOT_CELLS = 1 << 16
HOT_SHARE = 0.004     # of a block's documents: such a cell is put last
FEW_IDS = 1_000_000
GROUP = 1024          # documents of a cell that are looked through at once
SURE = 26             # a link is lost with a chance below exp(-SURE)
SPLIT_AT = 64         # offers of one cell in a block beyond this are split by a salt

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = _mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C55 | 1
_INV = pow(_BASE, -1, 1 << 64)
_PLACE = _mix(np.arange(1, WORDS + 1, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK_BYTES // 4)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, U(base))
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def _words_of(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of one stretch of text."""
    solid = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start) == 0:
        return np.zeros(0, U)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def words(raw: np.ndarray) -> np.ndarray:
    """Word hashes of a whole text; very long ones go in pieces cut at white
    space, so temporary arrays stay small."""
    step = BLOCK_BYTES // 4
    if len(raw) <= step:
        return _words_of(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(at + step, len(raw))
        while end < len(raw):
            gap = np.flatnonzero(_SPACE[raw[end:end + step]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + step, len(raw))
        out.append(_words_of(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(raw: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the word 5-grams; fewer words make one."""
    w = words(raw)
    k = len(w)
    if k == 0:
        return w
    if k < WORDS:
        return _mix((w * _PLACE[:k]).sum(keepdims=True) + U(k))
    n = k - WORDS + 1
    s = w[:n] * _PLACE[0]
    for j in range(1, WORDS):
        s += w[j:j + n] * _PLACE[j]
    s = np.sort(_mix(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def top(level: int) -> int:
    """Largest set of a level of 2**level cells: two elements a cell, and one
    in small sketches, so that more than d cells are filled."""
    return SMALL_SET if level == 0 else 2 ** level * (2 if level >= 8 else 1)


def level_of(n: int) -> int:
    """0 for small sets, else the first level that takes sets of this size."""
    if n <= SMALL_SET:
        return 0
    level = 5
    while top(level) < n:
        level += 1
    return level


def levels(n: int) -> list[tuple[int, int]]:
    """(level, largest symmetric difference with a partner met there)."""
    if n <= 0:
        return []
    most = 4 * n // 3
    own = level_of(n)
    out = [(own, (n + min(most, top(own))) // 7)]
    return out + [(level_of(most), (n + most) // 7)] if most > top(own) else out


def spare(level: int) -> int:
    """Cells offered beyond d + 1. Of a level's sets at least about 0.27 times
    its cells are filled beyond d, so this many more common ones are sure."""
    return int(0.22 * 2 ** level) if level >= 8 else 0


def kept_share(level: int) -> float:
    """Share of the offers that is sent. Two sets that link have more than
    ``spare`` offers in common, so all of them are left out with a chance below
    exp(-SURE)."""
    return min(1.0, SURE / max(spare(level), 1)) if spare(level) else 1.0


def cells(s: np.ndarray, level: int) -> np.ndarray:
    """Keys of the filled cells of the parity sketch of a sorted set."""
    index = s >> U(64 - level if level else 32)
    first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    return _mix(np.bitwise_xor.reduceat(s, first) ^ _mix(index[first] + U((level + 1) << 40)))


def bits(s: np.ndarray, level: int) -> bytes:
    """Parity bits of the finer sketch of 4 * 2**level cells."""
    odd = np.bincount((s >> U(62 - level)).astype(np.int64), minlength=4 << level) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def digests(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(s.sum().astype(U).view(np.int64)), int(np.bitwise_xor.reduce(_mix(s)).view(np.int64))


def _sets(b: pa.RecordBatch) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Blocks of (id, set) of a batch with columns id, text."""
    ids = b.column(0).to_pylist()
    data, offs = utf8_column(b.column(1))
    for lo, hi in doc_blocks(offs, BLOCK_BYTES):
        yield [(ids[i], shingle_set(data[offs[i]:offs[i + 1]])) for i in range(lo, hi)]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _census(docs: DataFrame) -> DataFrame:
    """id, n, d1, d2, s0, s1 (size, digest and bit sketches of the set at its
    levels), and per block of texts the frequent cells and their counts on its
    first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in _sets(b):
                keys = [cells(s, lv) for _, s in block for lv, _ in levels(len(s))]
                hot, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, U), np.zeros(0, int))
                often = n >= max(4, HOT_SHARE * len(block))
                blank = [None] * (len(block) - 1)
                both = [digests(s) for _, s in block]
                drawn = [[bits(s, lv) if lv else None for lv, _ in levels(len(s))] + [None, None] for _, s in block]
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _ in block], pa.int64()), pa.array([len(s) for _, s in block], pa.int64()),
                    pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.int64()),
                    pa.array([x[0] for x in drawn], pa.binary()), pa.array([x[1] for x in drawn], pa.binary()),
                    pa.array([_signed(hot[often]).tolist(), *blank], pa.list_(pa.int64())),
                    pa.array([n[often].tolist(), *blank], pa.list_(pa.int64()))],
                    names=["id", "n", "d1", "d2", "s0", "s1", "hot", "hot_n"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, s0 binary, s1 binary, "
                                "hot array<long>, hot_n array<long>")


def _hot_cells(census: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HOT_CELLS frequent cells, sorted by key, with their counts."""
    top = (census.where("hot is not null").select(F.explode(F.arrays_zip("hot", "hot_n")).alias("h"))
           .groupBy(F.col("h.hot").alias("key")).agg(F.sum("h.hot_n").alias("c"))
           .orderBy(F.col("c").desc(), "key").limit(HOT_CELLS).toPandas())
    keys = top["key"].to_numpy(np.int64).view(U) if len(top) else np.zeros(0, U)
    by = np.argsort(keys)
    return keys[by], top["c"].to_numpy(np.int64)[by] if len(top) else np.zeros(0, np.int64)


def offers(s: np.ndarray, hot: np.ndarray, hot_n: np.ndarray) -> np.ndarray:
    """Of the d + 1 + spare rarest filled cells at each level of a set, those
    whose hash falls into the level's share."""
    out = []
    for level, d in levels(len(s)):
        keys = cells(s, level)
        need = d + 1 + spare(level)
        if len(keys) > need:
            often = np.zeros(len(keys), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                often = np.where(hot[at] == keys, hot_n[at], 0)
            keys = keys[np.lexsort((keys, often))[:need]]
        if kept_share(level) < 1:
            keys = keys[_mix(keys ^ U(0x5851F42D4C957F2D)) <= U(int(kept_share(level) * (2 ** 64 - 1)))]
        out.append(keys)
    return np.concatenate(out) if out else np.zeros(0, U)


def _postings(texts: DataFrame, hot: np.ndarray, hot_n: np.ndarray, ranges: int) -> DataFrame:
    """key, id, n: cells that at least two different sets offer."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in _sets(b):
                own: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}
                for i, s in block:  # of equal sets in a block the smallest id
                    if i is not None and len(s):
                        k = (len(s), *digests(s))
                        if k not in own or i < own[k][0]:
                            own[k] = (i, s)
                if not own:
                    continue
                offered = [offers(s, hot, hot_n) for _, s in own.values()]
                ids = np.array([i for i, _ in own.values()], np.int64)
                size = np.array([k[0] for k in own], np.int64)
                digest = np.array([k[1] ^ (k[2] << 1 & (1 << 63) - 1) for k in own], np.int64)
                keys = np.concatenate(offered)
                owner = np.repeat(np.arange(len(own)), [len(k) for k in offered])
                by = np.argsort(keys, kind="stable")
                keys, owner = keys[by], owner[by]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                count = np.diff(np.append(first, len(keys)))
                # Offers of a cell that is frequent here: the first leads to the
                # key's range, the others go to ranges of their own choice.
                often = np.repeat(count, count) > SPLIT_AT
                nth = np.arange(len(keys)) - np.repeat(first, count)
                salt = (_mix(ids[owner].view(U) ^ keys) % U(ranges)).astype(np.int64)
                part = np.where(often & (nth > 0), ranges + salt, (keys % U(ranges)).astype(np.int64))
                lead = often & (nth == 0)
                by = np.lexsort((owner, lead, part))
                part, lead, keys, owner = part[by], lead[by], keys[by], owner[by]
                cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(lead.view(np.int8)) != 0)) + 1
                rows = []
                for x, y in zip([0, *cut], [*cut, len(part)]):
                    who, n = np.unique(owner[x:y], return_counts=True)
                    rows.append((int(part[x]), bool(lead[x]), keys[x:y].tobytes(), n.astype(np.int32).tobytes(),
                                 ids[who].tobytes(), size[who].tobytes(), digest[who].tobytes()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_())] + [pa.array(c, pa.binary()) for c in cols[2:]],
                    names=["part", "lead", "keys", "counts", "ids", "sizes", "digests"])

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        keys = np.concatenate([np.frombuffer(x, U) for x in frame["keys"]])
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in frame["counts"]])
        ids, size, digest = (np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in frame[c]]), counts)
                             for c in ("ids", "sizes", "digests"))
        if part < ranges:
            lead = np.repeat(frame["lead"].to_numpy(bool), [len(x) // 8 for x in frame["keys"]])
            by = np.lexsort((ids, digest, keys))
            keys, ids, size, digest, lead = keys[by], ids[by], size[by], digest[by], lead[by]
            leads = keys[lead]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (digest[1:] != digest[:-1])))
            keys, ids, size = keys[new], ids[new], size[new]  # equal sets: the smallest id
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            count = np.diff(np.append(first, len(keys)))
            whose = np.add.reduceat(_mix(ids.view(U)), first)  # digest of a cell's documents
            _, one = np.unique(np.stack([whose, count.astype(U)]), axis=1, return_index=True)
            keep = np.zeros(len(first), bool)
            keep[one] = True
            keep = (keep & (count > 1)) | np.isin(keys[first], leads)
            live = np.repeat(keep, count)
            keys, ids, size = keys[live], ids[live], size[live]
        return pd.DataFrame({"key": _signed(keys), "id": ids, "n": size})

    packed = texts.mapInArrow(pack, "part long, lead boolean, keys binary, counts binary, ids binary, sizes binary, "
                                    "digests binary")
    return packed.groupBy("part").applyInPandas(shared, "key long, id long, n long")


def _sketch_at(n: int, s0: bytes | None, s1: bytes | None, level: int) -> bytes | None:
    for (lv, _), s in zip(levels(n), (s0, s1)):
        if lv == level:
            return s
    return None


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b, near: whether the bit sketches at the larger set's level allow the pair."""
    def side(x: str) -> DataFrame:
        return sketches.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "s0", "s1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for na, a0, a1, nb, b0, b1 in zip(*(batch.column(c).to_pylist() for c in range(2, 8))):
                most = max(na, nb)
                level = level_of(most)
                x, y = _sketch_at(na, a0, a1, level), _sketch_at(nb, b0, b1, level)
                near.append(x is None or y is None or int.from_bytes(x).__xor__(int.from_bytes(y)).bit_count() <= (na + nb) // 7)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())],
                                             names=["a", "b", "near"])

    full = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "s0a", "s1a", "nb", "s0b", "s1b")
    return full.mapInArrow(run, "a long, b long, near boolean")


def _tested(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, ok for each pair: sketches first, then the exact sets of both
    texts. ``pairs`` and the outcome are written to the shared folder."""
    near = stored(_near(pairs, sketches), "near")
    left = near.where("near").select("a", "b")
    ids = stored(left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    pool = stored(texts.join(few, "id", "left_semi"), "pool")
    out = stored(_verified(left, pool), "verified")
    return near.where("not near").select("a", "b", F.lit(False).alias("ok")).unionByName(out)


def _verified(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """a, b, ok for each pair, by the exact sets of both texts."""
    full = (pairs.join(pool.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
            .join(pool.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for b in batches:
            ids = b.column(0).to_pylist()
            da, oa = utf8_column(b.column(2))
            db, ob = utf8_column(b.column(3))
            ok = []
            for i, a in enumerate(ids):
                left = da[oa[i]:oa[i + 1]]
                if last is None or last[0] != a:
                    last = (a, shingle_set(left))
                x, y = last[1], shingle_set(db[ob[i]:ob[i + 1]])
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= 75 * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return full.mapInArrow(run, "a long, b long, ok boolean")


def _close(n: str, m: str):
    return 4 * F.least(n, m) >= 3 * F.greatest(n, m)


def _crossing(live: DataFrame, most: int) -> DataFrame:
    """key, a, b, rest: pairs of a cell's documents (key, id, comp, c, n, s0,
    s1) from different components that sketches and sizes allow: for each
    document the ``most`` nearest by Hamming distance; ``rest`` tells that a cell
    has more. Documents travel in blocks of about
    ``GROUP``, so a cell costs (its documents / GROUP) ** 2 rows, not pairs."""
    of = F.struct("id", "n", "comp", "s0", "s1")
    small = live.where(F.col("c") <= GROUP).groupBy("key").agg(F.collect_list(of).alias("x")).select(
        "key", F.lit(True).alias("same"), "x", F.expr("CAST(NULL AS array<struct<id:bigint,n:bigint,comp:bigint,s0:binary,s1:binary>>)")
        .alias("y"))
    blocks = stored(live.where(F.col("c") > GROUP).withColumn("blk", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / GROUP)))
                    .groupBy("key", "blk").agg(F.collect_list(of).alias("docs")), "blocks")
    large = blocks.withColumnRenamed("docs", "x").join(
        blocks.select("key", F.col("blk").alias("other"), F.col("docs").alias("y")), "key"
    ).where("blk <= other").select("key", (F.col("blk") == F.col("other")).alias("same"), "x", "y")

    def read(rows: list[dict]):
        ids, n, comp = (np.array([r[k] for r in rows], np.int64) for k in ("id", "n", "comp"))
        return ids, n, comp, max(level_of(m) for m in n.tolist())

    def words_at(rows: list[dict], level: int) -> np.ndarray:
        return np.stack([np.frombuffer(_sketch_at(r["n"], r["s0"], r["s1"], level), np.uint8) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, same, left, right in zip(*(batch.column(c).to_pylist() for c in range(4))):
                right = left if same else right
                ids, n, comp, lv = read(left)
                ids2, n2, comp2, lv2 = (ids, n, comp, lv) if same else read(right)
                level = max(lv, lv2)
                x = words_at(left, level) if level else np.zeros((len(left), 1), np.uint8)
                y = x if same else (words_at(right, level) if level else np.zeros((len(right), 1), np.uint8))
                rest = False
                for i in range(len(ids)):
                    ok = (comp2 != comp[i]) & (4 * np.minimum(n2, n[i]) >= 3 * np.maximum(n2, n[i]))
                    if same:
                        ok[:i + 1] = False
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    far = np.bitwise_count(y[at] ^ x[i]).sum(1, dtype=np.int64)
                    fit = far <= (n[i] + n2[at]) // 7
                    at, far = at[fit], far[fit]
                    rest |= len(at) > most
                    for j in ids2[at[np.lexsort((ids2[at], far))[:most]]].tolist():
                        out.append((key, min(int(ids[i]), j), max(int(ids[i]), j), False))
                if rest:
                    out.append((key, None, None, True))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                                             names=["key", "a", "b", "rest"])

    kind = "key long, a long, b long, rest boolean"
    return small.mapInArrow(run, kind).unionByName(large.mapInArrow(run, kind))


def _rounds(postings: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """v, c: component of every document with a link to another text."""
    cells_of = stored(postings.groupBy("key").agg(
        F.min(F.struct("id", "n")).alias("p"), F.count(F.lit(1)).alias("c"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
        .where("c > 1").select("key", F.col("p.id").alias("a"), F.col("p.n").alias("na"), "c", "x", "y"), "cells")
    pivots = stored(cells_of.groupBy("c", "x", "y", "a", "na").agg(F.min("key").alias("key"))  # one of each list of documents
                    .select("key", "a", "na", "c"), "pivots")
    postings = stored(postings.join(pivots.select("key"), "key", "left_semi"), "postings")
    pairs = (postings.withColumnRenamed("id", "b").join(pivots, "key").where((F.col("a") != F.col("b")) & _close("n", "na"))
             .select("a", "b").distinct())
    tested = _tested(pairs, sketches, texts)
    links = tested.where("ok").select("a", "b")
    comps = connected_components(links)
    open_keys, most = pivots.where("c > 2").select("key", "c"), 1
    while True:
        member = (postings.join(comps.select(F.col("v").alias("id"), F.col("c").alias("comp")), "id", "left")
                  .withColumn("comp", F.coalesce("comp", "id")).select("key", "id", "comp"))
        spread = stored(member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                        .where("lo <> hi").select("key"), "spread")
        open_keys = stored(open_keys.join(spread, "key", "left_semi"), "open")
        if open_keys.isEmpty():
            return comps
        found = stored(_crossing(member.join(open_keys, "key").join(sketches, "id"), most), "crossing")
        fresh = (found.where("a is not null").select("a", "b").distinct()
                 .join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        more = _tested(fresh, sketches, texts)
        tested = tested.unionByName(more)
        if not more.where("ok").isEmpty():
            links = links.unionByName(more.where("ok").select("a", "b"))
            comps = connected_components(links)
        open_keys = open_keys.join(found.where("rest").select("key").distinct(), "key", "left_semi")
        most *= 4


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest id with the same set)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    census = stored(_census(texts), "census")
    hot, hot_n = _hot_cells(census)
    filled = census.where("n > 0 and id is not null")
    classes = stored(filled.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), "classes")
    copies = stored(filled.select("id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).where("id <> rep")
                    .select("id", "rep"), "copies")
    raw = stored(_postings(texts, hot, hot_n, partitions(docs.sparkSession)), "offers")
    postings = stored(raw.join(copies, "id", "left").select("key", F.coalesce("rep", "id").alias("id"), "n").distinct(),
                      "postings")
    comps = _rounds(postings, filled.select("id", "n", "s0", "s1"), texts.where("id is not null"))
    named = stored(classes.join(comps, classes.rep == comps.v, "left")
                   .select("n", "d1", "d2", "rep", F.coalesce("c", "rep").alias("comp")), "named")
    return (census.select("id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("class_id")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT k.doc_id, k.n AS n_shingles, min(r.c) AS component_id, any_value(k.k) AS class_id
FROM (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(sh)) END AS k
      FROM s) k JOIN r ON r.v = k.doc_id GROUP BY k.doc_id, k.n
"""


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id
    stays, with all its columns; rows with a null id stay."""
    name = free_name(docs, "_kept_id")
    keep = jaccard_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias(name))
    return docs.join(keep, F.col("doc_id") == F.col(name), "left_semi").unionByName(docs.where("doc_id is null"))
