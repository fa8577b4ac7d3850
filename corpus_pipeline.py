"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and works on all that its predecessor kept.

toxicity: documents scored 0.5 or more go. near_dedup: of each near-duplicate class, the least doc_id stays.
substring_dedup: repeated passages are cut from the texts; a document of which nothing is left goes. decontamination:
documents that the benchmark contaminates go, others stay as they are. mixing: documents of which the mix takes
nothing go; the others have size, source_size, target and taken (words, repeats counted) beside their own columns.

Columns of documents that share a name with a stage's own are set aside and come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontam, minhash, mixing, substring_dedup, toxicity
from logloom.llm.common import written


def _aside(docs: DataFrame, used: tuple[str, ...], stage: Callable[[DataFrame], DataFrame], new: tuple[str, ...] = ()) -> DataFrame:
    """stage applied with all columns but the used ones under names that clash with nothing; new: columns it adds for good."""
    away = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c not in used}
    out = stage(docs.withColumnsRenamed(away))
    return out.select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns if c not in new], *new)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose toxicity is below 0.5.

    Null and empty texts have the score of no words at all. Equal texts have equal scores and share their fate; a score
    of exactly 0.5 goes. Without labels all scores are alike and below 0.5, and all stay.
    Texts of any length are scored whole; an empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _aside(docs, ("doc_id", "text"), lambda d: toxicity.score_toxicity(d, model).where("score < 0.5"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the least doc_id's.

    Null, empty and blank texts are copies of one another. Rows without doc_id stay. Of rows that share a doc_id the one
    with the least text stays. An empty table stays empty.
    """
    return _aside(docs, ("doc_id", "text"), minhash.deduplicated)


def substring_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the passages that documents of smaller ids hold; n_chars follows the text.

    A document whose words are all removed goes; null and empty texts have no words and stay. Kept stretches of a text
    are as they stood, joined by newlines. An empty table stays empty.
    """
    def cut(d: DataFrame) -> DataFrame:
        d = substring_dedup.remove_repeats(d).where("n_removed = 0 or n_removed < n_words")
        return d.withColumn("text", F.col("kept_text"))

    out = _aside(docs, ("doc_id", "text"), cut)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the benchmark does not contaminate, as they are.

    Null and empty texts have no words and stay; an empty benchmark contaminates nothing; an empty table stays empty.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _aside(docs, ("doc_id", "text"), lambda d: decontam.judged(d, items).where("not contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs of which the mix takes words, with size, source_size, target and taken.

    Null and empty texts have size 0 and go; a null source is a source of its own, the last. Ties of equal length are
    settled by a seeded hash of all columns. An empty table stays empty.
    """
    return _aside(docs, ("doc_id", "text", "source"), lambda d: mixing.mix(d).where("taken > 0"), ("size", "source_size", "target", "taken"))


STAGES = [("toxicity", remove_toxic), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup_), ("decontamination", decontaminate), ("mixing", mix_sources)]
#: Trained scores and subset sums are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written as Parquet and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
