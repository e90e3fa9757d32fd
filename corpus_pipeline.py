"""Corpus pipeline: documents in, token shards out, in five stages of cloakbench.llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the next stage's documents, the last one
the decoded token rows. Every stage works on what its predecessor kept; run() writes each result to the shared folder and
reads it back, so a lost executor costs one stage at most.

Defined cases: a document with null or empty text is scored, kept or dropped like any other and ends as the end id alone; documents
without identifier all pass the near-dedup; rows that repeat an identifier share its draw in the mix; extra columns are kept up to the
last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cloakbench.llm import decontam, mixing, quality_fm, similar, token_output
from cloakbench.llm.common import documents, drop_stash, fewer_children, in_few_tasks, stash


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose files, and those that its caller writes of its result, start few processes."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        fewer_children(spark)
        return in_few_tasks(f(spark, docs, sf_dir))

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go; it learns from the labelled ones of this input."""
    labels = quality_fm.training_fold(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.keep_good(docs, quality_fm.train(docs, labels), least=0.3)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; op1's SimHash links and those of similarity 0.8 or more of five-word shingles make the groups.

    No bound on differing SimHash bits reaches all similar pairs: a lossless prefix filter finds the rest (see the README).
    """
    return similar.dedup_with_simhash(docs, shingle=5, least=0.8)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn, 150 % of the words; a document taken twice comes twice."""
    return mixing.mix(docs)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document taken, read back from the shards."""
    return token_output.round_trip(docs, token_output.default_tokenizer(), end_id=2)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: A trained classifier and tokenizers decide here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, made in STAGES[:-1]:
        docs = stash(made(spark, docs, sf_dir), "stage-" + name.split()[0].lower(), release=True)
        if before is not None:
            drop_stash(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
