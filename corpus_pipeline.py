"""A corpus pipeline over ``documents``: five stages, each one operator.

Every stage's result is written as Parquet in the shared folder and read again by
the next.  All stages but the last return the columns of ``documents``, further
columns included, whatever their names.

Defined results: a null or empty text, one without a letter, or one whose language
has a mean probability under 0.4, goes in the first stage (later stages, given such texts, take null as empty: they are near-duplicates
of each other, hold no passage and no secret, and pack as the lone end id); a null
doc_id is kept, stands last in its group of near-duplicates, and names its pieces;
rows with equal ids in one group leave one row; other columns may be null; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontamination, language_id, packing, secret_scan, simhash
from rivulet.llm.queries import table, tokenizer_path
from rivulet.llm.shared_tables import written
from rivulet.llm.textbatch import held_out


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go: no letter, or a score under 0.4."""
    return language_id.accepted(docs, language_id.fit(docs, train=~held_out(F.col("id"))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more) the document of the least id stays.

    Fingerprints that the SimHash grid joins come first, verified; min-hash bands add the pairs it does not carry.
    """
    return simhash.representatives(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redacted(docs, tokenizer_path("byte_bpe_50k.tiktoken"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("simhash", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Trained networks, XXH64 and token ids have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
