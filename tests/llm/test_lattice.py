"""Lattice scores against sums over all segmentations and plain counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from slaframe.llm import lattice

from conftest import SF_SMALL


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def sentences(words):
    out, own = [], []
    for w in words:
        own.append(w)
        if w[-1] in ".!?":
            out.append((*own, ""))
            own = []
    return [*out, (*own, None)]  # the last one holds the end


def brute(rows, log_pieces):
    """Scores from counts in Python; log_pieces(word) is the lattice's sum."""
    c, s, texts = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            c.update(tokens(t))
            s.update(sentences(tokens(t)))
            texts += 1
    n, kinds = sum(c.values()) + texts, len(c) + (texts > 0)
    ones = Counter(c.values())
    d = min(0.9, max(0.1, ones[1] / (ones[1] + 2 * ones[2]))) if ones[1] else 0.5

    def p(w):
        if w is None:
            return (max(texts - d, 0) + 1) / (n + 2)
        return (max(c[w] - d, 0) + (d * kinds + 1) * math.exp(log_pieces(w))) / (n + 2)

    out = []
    for i, t in rows:
        own = tokens(t)
        counts = [c[w] for w in own] + [texts]
        score = 0.0
        for x in sentences(own):
            spelled = sum(math.log(p(w)) for w in x if w != "")
            whole = s[x] * (1 - lattice.SPELLED) / max(1, sum(s.values()))
            score += math.log10(whole + lattice.SPELLED * math.exp(spelled)) if whole else (math.log(lattice.SPELLED) + spelled) / math.log(10)
        out.append((i, held(i), len(counts), sum(x > 0 for x in counts), n,
                    sum(math.log10((x + 0.1) / (n + 0.1 * (kinds + 1))) for x in counts), score))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


@pytest.fixture(scope="module")
def model():
    _, start = lattice.read_pieces()
    return lattice.model_of(start, 0.3)


def all_segmentations(text, weights):
    ways = [1.0] + [0.0] * len(text)
    for end in range(1, len(text) + 1):
        ways[end] = sum(ways[b] * weights[text[b:end]] for b in range(end) if text[b:end] in weights)
    return ways[-1]


def test_sum_over_segmentations(model):
    pieces, start = lattice.read_pieces()
    trie = lattice.build_trie()
    weights = {p: w * 0.7 for p, w in zip(pieces, start)}
    words = ["a", "the", "tionhering", "éçà", "ÿ", "日本語", "x" * 40, "\x00", "the" * 100]
    want = [math.log(all_segmentations(b" " + w.encode(), weights) * 0.3 / 0.7) for w in words[:-1]]
    got = lattice.log_likelihood(pa.array(words), trie, model)
    assert got[:-1] == pytest.approx(want, abs=1e-9)
    assert got[-1] == pytest.approx(lattice._forward_long(lattice._scan_long(trie, b" " + words[-1].encode()), model)[-1] + model.log_end)
    assert len(words[-1]) > lattice.LONG


def test_short_and_long_words_alike(model, monkeypatch):
    trie, words = lattice.build_trie(), pa.array(["thering", "tion", "a", "überall", "x" * 30])
    one, counts = lattice.log_likelihood(words, trie, model), lattice.expected_counts(words, trie, model)
    monkeypatch.setattr(lattice, "LONG", 0)
    assert lattice.log_likelihood(words, trie, model) == pytest.approx(one)
    assert lattice.expected_counts(words, trie, model) == pytest.approx(counts)
    pieces, _ = lattice.read_pieces()
    assert sum(c * len(p) for c, p in zip(counts, pieces)) == pytest.approx(sum(len(w.as_py().encode()) + 1 for w in words))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    trained = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    model = lattice.fit(spark.createDataFrame([(w,) for w in trained], "name string"))
    every = sorted({w for _, t in rows for w in tokens(t)})
    pieces = dict(zip(every, lattice.log_likelihood(pa.array(every), lattice.build_trie(), model)))
    got = lattice.op13_lattice_scores(spark, SF_SMALL).collect()
    same(got, brute(rows, pieces.__getitem__))
    unfitted = lattice.log_likelihood(pa.array(every), lattice.build_trie(), lattice.model_of(lattice.read_pieces()[1], 0.3))
    before, new = dict(zip(every, unfitted)), [w for i, t in rows if held(i) for w in tokens(t) if w not in trained]
    assert sum(pieces[w] for w in new) > sum(before[w] for w in new) + len(new)  # fitted weights also fit unseen words


def test_defined_cases(spark, model, monkeypatch):
    monkeypatch.setattr(lattice, "fit", lambda *a: model)
    trie = lattice.build_trie()
    rows = [(1, None), (2, ""), (3, "One two. Two one! end"), (3, "One two. Two one! end"), (None, "one\x0btwo. x"), (35, "unseen  words"), (36, " A.  ")]
    rows += [(i, "Two one!") for i in range(40, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS held", "3 AS block", "4 AS name")
    log_pieces = lambda w: float(lattice.log_likelihood(pa.array([w]), trie, model)[0])
    want = brute(rows, log_pieces)
    assert any(w[1] for w in want)
    same(lattice.lattice_scores(docs).collect(), want)
    same(lattice.lattice_scores(docs, block_bytes=1).collect(), want)
    assert lattice.lattice_scores(docs.where("false")).count() == 0
    only = docs.where("crc32(string(doc_id)) % 10 = 0")
    same(lattice.lattice_scores(only).collect(), brute([r for r in rows if held(r[0])], log_pieces))


def test_weights_stay_a_distribution(spark):
    model = lattice.fit(spark.createDataFrame([("thering",), ("tion",), ("x" * 300,)], "name string"))
    assert np.exp(model.log_piece).sum() + math.exp(model.log_end) / (1 + math.exp(model.log_end)) == pytest.approx(1)
