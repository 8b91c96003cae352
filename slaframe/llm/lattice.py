"""Language-model scores from a subword lattice.

The lattice of a text has an arc for every piece of an existing vocabulary that
matches inside a word (a blank stands before the word; every byte is a piece, so
any text has a path), one for each whole word that training texts have, and one for
each whole sentence that they have. A text's probability is the sum over all
segmentations of the lattice.

* Pieces: L(word) is the sum over all segmentations into pieces, by forward
  recursion in log space. Pieces are drawn independently; after each the word ends
  with a fixed chance. The weights start from the vocabulary's own scores (the scores
  of a BPE file are negated ranks and enter as Zipf weights); ``ROUNDS`` rounds of
  expectation and maximization over all distinct training words (forward and
  backward sums, expected counts added up by Spark) fit them, with the start as
  ``PRIOR`` pseudo-counts.
* Words: P(word) = (max(c - D, 0) + (D * V + 1) * L(word)) / (N + 2) with the training
  count c and the absolute discount D = n1 / (n1 + 2 * n2). The end of a text counts
  like a word, with (max(c - D, 0) + 1) / (N + 2).
* Sentences end behind a word that ends with ``.``, ``!`` or ``?``, or with the end of
  the text, so they are told from the words alone. P(sentence) = (1 - ``SPELLED``) * share
  among the training sentences + ``SPELLED`` * product over its words. All sums to one.

Jobs: one narrow map turns documents into blocks, each with its distinct words and
sentences and its documents as their numbers. A block sends a word or sentence once with its
training count, so the commonest one has a row a block, and the sum over
its rows is a window of that size. Each distinct word is scored once a run of its rows;
counts and scores go back to their block, which is bounded in bytes. Only the
pieces' counts (bounded by the vocabulary) and a few sums come to the driver.

Defined cases: words are what is between the white space bytes 9 to 13 and 32, with A-Z
in lower case; null and empty texts have the end token alone; a null id belongs to
the training texts, as its remainder is not 0; rows that repeat are scored (and
counted) each; without training texts N is 0 and only pieces weigh; an empty table
gives an empty result; columns other than id and text are not read. Sentences are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_blocks, stored, table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
ROUNDS = 3
PRIOR = 1000.0
FOLDS = 10
SPELLED = 0.7
BLOCK_BYTES = 12 << 20
ROWS = 100_000        # words scored together
PLACES = 1 << 28      # a block's number and a place in it share a long
CELLS = 1 << 20       # word positions looked at together
LONG = 192            # bytes; longer words are scored one by one
NOTHING = -1e30       # log of zero


class Trie(NamedTuple):
    """Double array: the child of node s by byte b is ``base[s] + b`` where
    ``owner`` of that place is s. ``piece``: the piece that ends there, or -1."""
    base: np.ndarray
    owner: np.ndarray
    piece: np.ndarray
    depth: int


def read_pieces(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a blank for the word mark), each byte once at least, and
    their Zipf weights by score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        best[piece] = max(best.get(piece, -math.inf), model.get_score(i))
    by_score = sorted(best, key=lambda p: (-best[p], p))
    pieces = by_score + [bytes([b]) for b in range(256) if bytes([b]) not in best]
    weight = 1.0 / (np.arange(len(pieces)) + 2.0)
    return pieces, weight / weight.sum()


@lru_cache(maxsize=2)
def build_trie(path: str = VOCABULARY) -> Trie:
    pieces, _ = read_pieces(path)
    children: list[dict[int, int]] = [{}]
    ends = {}
    for k, piece in enumerate(pieces):
        node = 0
        for b in piece:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
            node = children[node][b]
        ends[node] = k
    size = 1 << (2 * len(children)).bit_length()
    used = np.zeros(size + 256, bool)
    used[0] = True
    base, owner, piece = (np.full(size + 256, -1, np.int32) for _ in range(3))
    rng, place = np.random.default_rng(0), {0: 0}
    for node in sorted(range(len(children)), key=lambda n: (-len(children[n]), n)):
        if not children[node]:
            continue
        own = np.fromiter(children[node], np.int64)
        while True:
            tries = rng.integers(1, size, 32)
            free = np.flatnonzero(~used[tries[:, None] + own].any(1))
            if len(free):
                break
        at = int(tries[free[0]])
        used[at + own] = True
        children[node] = {b: (at, child) for b, child in children[node].items()}
    todo = [0]
    while todo:  # places are known from the parent on
        node = todo.pop()
        s = place[node]
        piece[s] = ends.get(node, -1)
        for b, (at, child) in children[node].items():
            base[s] = at
            owner[at + b] = s
            place[child] = at + b
            todo.append(child)
    return Trie(base, owner, piece, max(map(len, pieces)))


def _words_array(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, a blank before each, and where each begins."""
    words = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8), offsets


class Model(NamedTuple):
    """Log weight of each piece with going on after it, and the log of ending
    instead."""
    log_piece: np.ndarray
    log_end: float


def model_of(weights: np.ndarray, end: float) -> Model:
    return Model(np.log(weights) + math.log1p(-end), math.log(end) - math.log1p(-end))


def _arcs(trie: Trie, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray, int]]]:
    """For each position: (word numbers, pieces, length) of the arcs that begin
    there. ``size`` must not fall."""
    out = []
    for d in range(int(size[-1]) if len(size) else 0):
        rows = np.arange(np.searchsorted(size, d, side="right"), len(size))
        node, here = np.zeros(len(rows), np.int64), []
        for length in range(1, trie.depth + 1):
            inside = size[rows] >= d + length
            rows, node = rows[inside], node[inside]
            at = trie.base[node] + data[start[rows] + (d + length - 1)].astype(np.int64)
            good = (trie.base[node] >= 0) & (trie.owner[at] == node)
            rows, node = rows[good], at[good]
            if not len(rows):
                break
            piece = trie.piece[node]
            whole = piece >= 0
            if whole.any():
                here.append((rows[whole], piece[whole], length))
        out.append(here)
    return out


def _chunks(size: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the words, by size, in parts of about ``CELLS`` positions."""
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        step = max(1, CELLS // max(1, int(size[order[lo]])))
        hi = min(len(order), lo + step)
        while hi - lo > 1 and (hi - lo) * int(size[order[hi - 1]]) > 2 * CELLS:
            hi = lo + (hi - lo) // 2
        yield order[lo:hi]
        lo = hi


def _forward(arcs, rows: int, width: int, model: Model) -> np.ndarray:
    alpha = np.full((width + 1, rows), NOTHING)
    alpha[0] = 0.0
    for d, here in enumerate(arcs):
        for word, piece, length in here:
            to = alpha[d + length]
            to[word] = np.logaddexp(to[word], alpha[d][word] + model.log_piece[piece])
    return alpha


def _scan_long(trie: Trie, text: bytes) -> list[list[tuple[int, int]]]:
    """Arcs (end, piece) by position of one long word."""
    base, owner, piece = trie.base, trie.owner, trie.piece
    out = []
    for d in range(len(text)):
        node, here = 0, []
        for end in range(d, min(len(text), d + trie.depth)):
            at = int(base[node]) + text[end]
            if base[node] < 0 or owner[at] != node:
                break
            node = at
            if piece[node] >= 0:
                here.append((end + 1, int(piece[node])))
        out.append(here)
    return out


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def _forward_long(arcs, model: Model) -> list[float]:
    alpha = [0.0] + [NOTHING] * len(arcs)
    for d, here in enumerate(arcs):
        for end, k in here:
            alpha[end] = _add(alpha[end], alpha[d] + float(model.log_piece[k]))
    return alpha


def log_likelihood(words: pa.Array, trie: Trie, model: Model) -> np.ndarray:
    """Natural log of the sum over all segmentations, for each word."""
    data, offsets = _words_array(words)
    size = np.diff(offsets)
    out = np.empty(len(size))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = _forward_long(_scan_long(trie, data[offsets[i]:offsets[i + 1]].tobytes()), model)[-1]
    short = np.flatnonzero(size <= LONG)
    for part in _chunks(size[short]):
        rows = short[part]
        own = size[rows]
        alpha = _forward(_arcs(trie, data, offsets[rows], own), len(rows), int(own[-1]), model)
        out[rows] = alpha[own, np.arange(len(rows))]
    return out + model.log_end


def expected_counts(words: pa.Array, trie: Trie, model: Model) -> np.ndarray:
    """How often each piece is used, over all words and segmentations."""
    data, offsets = _words_array(words)
    size = np.diff(offsets)
    counts = np.zeros(len(model.log_piece))
    for i in np.flatnonzero(size > LONG).tolist():
        arcs = _scan_long(trie, data[offsets[i]:offsets[i + 1]].tobytes())
        alpha, beta = _forward_long(arcs, model), [NOTHING] * len(arcs) + [0.0]
        for d in range(len(arcs) - 1, -1, -1):
            for end, k in arcs[d]:
                rest = float(model.log_piece[k]) + beta[end]
                beta[d] = _add(beta[d], rest)
                counts[k] += math.exp(min(0.0, alpha[d] + rest - alpha[-1]))
    short = np.flatnonzero(size <= LONG)
    for part in _chunks(size[short]):
        rows = short[part]
        own = size[rows]
        arcs = _arcs(trie, data, offsets[rows], own)
        alpha = _forward(arcs, len(rows), int(own[-1]), model)
        total = alpha[own, np.arange(len(rows))]
        beta = np.full(alpha.shape, NOTHING)
        beta[own, np.arange(len(rows))] = 0.0
        used, share = [], []
        for d in range(len(arcs) - 1, -1, -1):
            for word, piece, length in arcs[d]:
                rest = model.log_piece[piece] + beta[d + length][word]
                beta[d][word] = np.logaddexp(beta[d][word], rest)
                used.append(piece)
                share.append(np.exp(alpha[d][word] + rest - total[word]))
        if used:
            counts += np.bincount(np.concatenate(used), np.concatenate(share), len(counts))
    return counts


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _sentence_keys(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each sentence from the hashes of its words."""
    ratio = np.uint64(0x9E3779B97F4A7C15)
    powers = np.full(len(keys), ratio)
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    inverse = pow(int(ratio), -1, 1 << 64)
    back = np.full(len(keys), np.uint64(inverse))
    back[:1] = 1
    back = np.multiply.accumulate(back)
    x = np.add.reduceat(keys * powers, starts) * back[starts]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _block(ids: pa.Array, held: pa.Array, texts: pa.Array, number: int) -> pa.RecordBatch:
    texts = pa.concat_arrays([texts, pa.array([], texts.type)])  # bytes from 0 on: ascii_lower needs that
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    flat = split.flatten()
    full = pc.not_equal(flat, "")
    flat, of = flat.filter(full).dictionary_encode(), of[full.to_numpy(zero_copy_only=False)]
    words, uses = flat.dictionary, flat.indices.to_numpy()
    end = len(words)
    lengths = np.bincount(of, minlength=len(texts)) + 1
    tokens = np.full(int(lengths.sum()), end, np.int64)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(lengths) - 1] = False
    tokens[inner] = uses
    train = ~held.to_numpy(zero_copy_only=False)
    counts = np.bincount(uses[train[of]], minlength=end)
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, end)
    closes = np.append(pc.match_substring_regex(words, r"[.!?]$").to_numpy(zero_copy_only=False).astype(bool), True)
    ends = np.flatnonzero(closes[tokens])
    starts = np.concatenate(([0], ends[:-1] + 1))
    sentence, names = pd.factorize(_sentence_keys(np.append(keys, np.uint64(1))[tokens], starts))
    doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
    seen = np.bincount(sentence[train[doc]], minlength=len(names))
    one = lambda x, kind: pa.array([x], kind)
    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays(
        [one(number, pa.int64()), listed(ids), listed(held), one(_pack(lengths), pa.binary()), one(_pack(tokens), pa.binary()),
         listed(words.cast(pa.string())), listed(pa.array(counts, pa.int64())), one(_pack(np.diff(starts, append=len(tokens))), pa.binary()),
         one(_pack(sentence), pa.binary()), listed(pa.array(names, pa.int64())), listed(pa.array(seen, pa.int64())),
         one(int(train.sum()), pa.int64()), one(int(seen.sum()), pa.int64()), one(end, pa.int64())],
        names=["block", "ids", "held", "lengths", "tokens", "words", "counts", "spans", "uses", "sentences", "seen",
               "train_texts", "train_sentences", "n_words"])


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, size = TaskContext.get().partitionId() << 15, [], 0

        def close():
            whole = pa.Table.from_batches(waiting).combine_chunks()
            return _block(*(whole.column(c).combine_chunks() for c in range(3)), number)

        for b in batches:
            texts = pc.fill_null(b.column(2).cast(pa.large_string()), "")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            for lo, hi in doc_blocks(offsets, block_bytes):
                more = int(offsets[hi] - offsets[lo])
                if waiting and size + more > block_bytes:
                    yield close()
                    number, waiting, size = number + 1, [], 0
                waiting.append(pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), texts.slice(lo, hi - lo)],
                                                          names=["id", "held", "text"]))
                size += more
        if waiting:
            yield close()

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))
    return (docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, lengths binary, tokens binary, words array<string>, "
                             "counts array<long>, spans binary, uses binary, sentences array<long>, seen array<long>, train_texts long, "
                             "train_sentences long, n_words long"))


def _summed(blocks: DataFrame, names: str, counts: str) -> DataFrame:
    """name, at (block and place in it), c: the name's training count over all
    blocks; head: one row of each name."""
    rows = (blocks.select("block", F.posexplode(F.arrays_zip(F.col(names).alias("name"), F.col(counts).alias("n"))))
            .select(F.col("col.name").alias("name"), (F.col("block") * PLACES + F.col("pos")).alias("at"), F.col("col.n").alias("n")))
    own = Window.partitionBy("name")
    return rows.select("name", "at", F.sum("n").over(own).alias("c"), (F.min("at").over(own) == F.col("at")).alias("head"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, ``ROWS`` at a time or a few more."""
    waiting, n = [], 0
    for b in batches:
        waiting.append(b)
        n += b.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def fit(words: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Weights of the pieces for distinct words (name)."""
    trie, (_, start) = build_trie(path), read_pieces(path)
    model, n = model_of(start, 0.3), words.count()
    for _ in range(rounds if n else 0):
        def run(batches: Iterator[pa.RecordBatch], now=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(start))
            for b in _gathered(batches):
                total += expected_counts(b.column(0), trie, now)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "n"])

        counts = np.zeros(len(start))
        for r in words.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            counts[r.piece] = r.n
        weights = counts + PRIOR * start
        model = model_of(weights / weights.sum(), min(0.999, n / counts.sum()))
    return model


def lattice_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = stored(_blocks(docs, id_col, text_col, block_bytes), "blocks")
    words = stored(_summed(blocks, "words", "counts"), "words")
    once = words.where(F.col("head") & (F.col("c") > 0))
    t = blocks.agg(F.sum("train_texts"), F.sum("train_sentences")).first()
    texts, sentences = (int(x or 0) for x in t)
    n, kinds, n1, n2 = (int(x or 0) for x in once.agg(F.sum("c"), F.count("c"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first())
    total, kinds = n + texts, kinds + (texts > 0)
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    model, trie = fit(once.select("name"), path), build_trie(path)
    rest = math.log(discount * kinds + 1)

    def log_word(c: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return (np.logaddexp(np.log(np.maximum(c - discount, 0)), rest + pieces) - math.log(total + 2)) / math.log(10)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            name = b.column(0).dictionary_encode()
            pieces = log_likelihood(name.dictionary, trie, model)[name.indices.to_numpy()]
            c = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(log_word(c, pieces))], names=["at", "c", "score"])

    scored = words.select("name", "at", "c").mapInArrow(score, "at long, c long, score double")
    known = _summed(blocks, "sentences", "seen").where("c > 0").select("at", "c", F.lit(None).cast("double").alias("score"))
    back = scored.unionByName(known).select(F.floor(F.col("at") / PLACES).cast("long").alias("block"),
                                            (F.col("at") % PLACES).cast("int").alias("place"), "c", "score")
    log_end = math.log10((max(texts - discount, 0) + 1) / (total + 2))

    def finish(block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        lengths, tokens, spans, uses = (_unpack(row[c]) for c in ("lengths", "tokens", "spans", "uses"))
        end, word = int(row["n_words"]), got["score"].notna().to_numpy()
        place, c = got["place"].to_numpy(), got["c"].to_numpy()
        count, log_p = np.zeros(end + 1, np.int64), np.empty(end + 1)
        count[place[word]], log_p[place[word]] = c[word], got["score"].to_numpy()[word]
        count[end], log_p[end] = texts, log_end
        base = np.log10((count + 0.1) / (total + 0.1 * (kinds + 1)))
        seen = np.zeros(int(uses.max()) + 1)
        seen[place[~word]] = c[~word]
        first = np.cumsum(lengths) - lengths
        at = np.cumsum(spans) - spans
        spelled = np.add.reduceat(log_p[tokens], at) * math.log(10) + math.log(SPELLED)
        with np.errstate(divide="ignore"):
            whole = np.log(seen[uses] * (1 - SPELLED) / max(sentences, 1))
        scores = np.logaddexp(spelled, whole) / math.log(10)
        return pd.DataFrame({
            "doc_id": row["ids"], "held_out": row["held"], "n_tokens": lengths, "n_known": np.add.reduceat((count[tokens] > 0).astype(np.int64), first),
            "train_tokens": total, "base_score": np.add.reduceat(base[tokens], first),
            "score": np.add.reduceat(scores, np.searchsorted(at, first))})

    own = blocks.select("block", "ids", "held", "lengths", "tokens", "spans", "uses", "n_words")
    return (own.groupBy("block").cogroup(back.groupBy("block"))
            .applyInPandas(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def op13_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"))
