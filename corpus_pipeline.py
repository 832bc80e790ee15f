"""From raw documents to a mixed training set, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.leaks import find_leaks
from assayer.llm.mixing import mix_sources
from assayer.llm.neardup import near_duplicates
from assayer.llm.quality import quality_model, score_quality
from assayer.llm.repeats import PASSAGE_BYTES, PASSAGE_WORDS, dedupe_repeats
from assayer.llm.store import materialize, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    scored = score_quality(docs.select("doc_id", "text", "lang", "source", "n_chars"), quality_model(docs, read(spark, sf_dir, "labels")))
    return scored.where("predicted = 1").drop("score", "predicted")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest id, then of the smallest digest; a row without id
    only if no row of its class has one. Rows that repeat an id and a text stay once; rows without id and without text
    match none and all stay."""
    keyed = docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.md5("text").alias("digest")))
    first = near_duplicates(keyed, doc_id="_row").where("doc_id <=> class_id").groupBy(F.col("doc_id").alias("_row")).count()
    first = materialize(first, "pipeline-first")
    kept = keyed.join(first.select("_row"), "_row", "left_semi")
    if first.where("count > 1").limit(1).count():
        bare = F.col("doc_id").isNull() & (F.coalesce("text", F.lit("")) == "")
        kept = kept.where(~bare).dropDuplicates(["_row"]).unionByName(kept.where(bare))
    return kept.select("doc_id", "text", "lang", "source", "n_chars")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of more than 50 words that also stand elsewhere; a character cut in two goes with them.
    Null texts become empty; repeated rows repeat each other; an empty table stays empty."""
    cut = dedupe_repeats(docs, length=PASSAGE_BYTES, words=PASSAGE_WORDS, with_kept=True, carry=("lang", "source", "n_chars"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    judged = find_leaks(docs, read(spark, sf_dir, "benchmark"), carry=("text", "lang", "source", "n_chars"))
    return judged.where("not contaminated").select("doc_id", "text", "lang", "source", "n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies."""
    return mix_sources(docs).where("copies > 0")


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_copies), ("repeats", cut_repeats), ("decontamination", drop_leaks), ("mixing", mix)]
ORACLE_SQL = None  # models, similarity graphs and balanced draws are not SQL; tests/llm holds every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
