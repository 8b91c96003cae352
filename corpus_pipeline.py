"""Corpus pipeline: quality filter, exact dedup, near dedup, packing.

Each stage works on all rows its predecessor kept. ``run`` writes every
stage's result as Parquet to the shared folder and rereads it as the next
stage's documents, so a lost executor costs one stage at most.

Defined cases, for every stage: a null text counts as empty (without words it
is near to nothing); rows with a null id stay unless the classifier rejects their
text or a row with an equal text stays for them; rows that repeat an id are
judged each by their text in the first two stages and go the same way in the third,
which keeps them if their id is the smallest of its group; further columns are
carried along whatever their names; empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slaframe.llm.common import stored, table
from slaframe.llm.exact_dedup import dedup_stage
from slaframe.llm.packing import packing_stage
from slaframe.llm.parity_join import near_duplicate_stage
from slaframe.llm.quality import quality_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", dedup_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: A fitted network and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
