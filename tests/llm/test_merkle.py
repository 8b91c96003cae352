"""Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F
from slaframe.llm import merkle

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def leaf(row):
    out = b""
    for v in row:
        raw = None if v is None else str(v).encode()
        out += b"-" if raw is None else str(len(raw)).encode() + b":" + raw
    return digest(out)


def tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            lo = a // 16 * 16
            paths[i].append(("".join(nodes[lo:a]), "".join(nodes[a + 1:lo + 16])))
            at[i] = a // 16
        nodes = [digest("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = [tree([x[1] for x in groups[g]]) for g in names]
    root, up = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), above in zip(names, trees, up):
        for (r, own), path in zip(groups[g], paths):
            folded = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                folded = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path + above:
                folded = digest(left + folded + right)
            out.append((r[0], own, subroot, root, digest("".join(a + b for a, b in path + above)), folded, folded == root))
    return sorted(out, key=order)


def order(row):
    return tuple((x is not None, x) for x in row)


def manifest(docs):
    return docs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"),
                       merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded")).withColumn("ok", F.col("folded") == F.col("root"))


def test_nulls_ties_repeats_and_several_blocks(spark):
    rnd = random.Random(1)
    rows = [(None, None, None, None, None)] * 2 + [(1, None, "en", 3, "ABC")] * 2 + [(5, "", "x", 0, ""), (7, "é", "y", 1, "É A")]
    rows += [(rnd.randrange(3000), "big", "en", 4, f"Text {rnd.randrange(50)}") for _ in range(4500)]
    rows += [(i, f"s{i}", "en", 1, "Z") for i in range(40)]
    docs = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 AS key", "2 AS grp", "3 AS rank", "4 AS digest", "5 AS kids")
    got = manifest(merkle.merkle_manifest(docs)).collect()
    assert sorted(map(tuple, got), key=order) == brute(rows)


def test_one_row_and_no_row(spark):
    docs = spark.createDataFrame([(0, "a", "en", 1, "X")], FIELDS)
    got = manifest(merkle.merkle_manifest(docs)).first()
    assert got.leaf == got.subroot == got.root and got.proof == digest("")
    assert merkle.merkle_manifest(docs.where("false")).count() == 0
