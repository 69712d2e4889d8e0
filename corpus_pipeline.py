"""A corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factweave.llm import exact_dedup, language_id, ngram_join, packing, substring_dedup
from factweave.llm.shared import delete_table, docs_of, fresh, keep, scratch, write_table

#: Languages that stay (None: every language that the labels teach), and the least score of a prediction.
LANGUAGES: list[str] | None = None
LEAST_SCORE = 0.0


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among ids, with their own columns."""
    name = fresh(docs, "kept_doc_id")
    kept = ids.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of LANGUAGES; texts without a letter have none. `lang` becomes the predicted one, whatever the label was."""
    return language_id.accepted(docs, language_id.fit(docs), LANGUAGES, LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id; rows that repeat an id stay or go together."""
    return _only(docs, exact_dedup.dedup(docs).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id; documents that only null ids have stay."""
    return _only(docs, ngram_join.join_texts(docs).filter("kept"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; n_chars follows the new text."""
    spans = fresh(docs, "cut_spans")
    cut = substring_dedup.dedup(docs, spans)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; each predicted language of each source is a queue, so all windows have the same mixture of them."""
    queue = fresh(docs, "queue")
    return packing.digests(packing.pack(docs.withColumn(queue, F.to_json(F.struct("lang", "source"))), source_col=queue))


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("substring_dedup", passages), ("packing", packed)]

#: Near duplicates, passages and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = docs_of(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = keep(write_table(stage(spark, docs, sf_dir), f"stage-{name}"))
        if old is not None:
            delete_table(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
