"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from slaframe.llm import runs

from conftest import SF_SMALL


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def collapse(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    words = split(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(collapse(words, found)))


def test_query_against_brute_force(spark):
    want = sorted(brute(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    assert sorted(map(tuple, runs.op12_periodic_runs(spark, SF_SMALL).collect())) == want
    assert any(w[1] for w in want)


def test_random_sequences():
    rnd = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randrange(1, 6)):
            words = []
            while len(words) < rnd.randrange(60):
                words += [rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randrange(1, 8))] * rnd.randrange(1, 9)
            texts.append(words)
        got = runs.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]))
        assert list(zip(*[x.tolist() for x in got])) == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]


def test_common_extensions_both_ways():
    rnd = np.random.default_rng(2)
    for kinds in (1, 2, 3, 50):
        s = rnd.integers(0, kinds, 400)
        levels = runs.grammar(s)
        x = rnd.integers(0, 399, 200)
        y = rnd.integers(x + 1, 401)
        ahead = runs.common_extension(levels, x, y)
        behind = runs.common_extension(runs.mirrored(levels), len(s) - y, len(s) - x)
        for i, j, a, b in zip(x, y, ahead, behind):
            k = 0
            while j + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            assert a == k
            k = 0
            while i - k > 0 and s[i - k - 1] == s[j - k - 1]:
                k += 1
            assert b == k


def test_long_text_in_chunks(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 1000)
    words = np.concatenate((np.arange(500), np.tile(np.arange(40), 9), np.zeros(3000, int), np.arange(60)))
    got = runs.find_runs(words, np.array([len(words)]))
    assert list(zip(*[x.tolist() for x in got[1:]])) == plain_runs(words.tolist())


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 6), (4, "x " * 6), (4, "x " * 6), (5, "x " * 5), (6, "a b " * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS t", "2 AS runs", "3 AS collapsed")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()]
    want = [(i, len(split(t)), plain_runs(split(t)), collapse(split(t), plain_runs(split(t)))) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert runs.periodic_runs(docs.where("false")).count() == 0
    assert runs.periodic_runs(docs, block_bytes=1).count() == len(rows)
