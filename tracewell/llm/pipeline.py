"""Training-corpus pipeline: five stages over `documents`, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `docs`.  Rows with null ids or texts pass every
stage unless its own decision removes them.  Repeated rows are judged alike (as
near duplicates they share an id and stay or go together), an empty table gives
an empty one, and a text is taken whole, however long; it must fit a task.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontamination, near_dedup, quality_classifier, secrets
from tracewell.llm.frames import cut, drop_cut, read
from tracewell.sources.shared import scratch


def _whole(docs: DataFrame) -> DataFrame:
    """The rows as one struct beside their text, so that no new column clashes with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def _rewritten(before: DataFrame, after: DataFrame) -> DataFrame:
    """`after` with n_chars counted again."""
    if "n_chars" not in before.columns:
        return after
    kind = before.schema["n_chars"].dataType
    return after.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, trained on `labels`, does not reject.

    A text without words has nothing to judge and counts as rejected only if
    its score says so.
    """
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.score(_whole(docs), model, keep=["row"]).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest id."""
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of `benchmark` out of the texts."""
    return _rewritten(docs, decontamination.remove_spans(docs, read(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark."""
    return _rewritten(docs, secrets.redact(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(docs, path, keep=["doc_id"], decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("tokenize", tokenize),
]

#: The classifier's scores have no SQL.  Tests compare the stages after it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared folder and read back."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = docs
        with scratch(spark) as tables:  # what a stage writes on its way goes once its result is written
            docs = tables.keep(cut(stage(spark, docs, sf_dir), f"stage_{name}"))
        if i:
            drop_cut(before)
    return docs
