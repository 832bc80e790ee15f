"""Evaluation and audits: fuzzy claim matches, hypothesis scores, provenance, references, determinism, schema shapes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def fuzzy_matches(predicted: DataFrame, gold: DataFrame, text: str = "text", at: float = 0.6) -> DataFrame:
    """Distinct predicted texts with ``matched``: whether a gold text shares enough words, of the longer one's distinct words.

    Texts meet by a word and not all with all: each is listed under the rarest of its words only, as many as a match can't
    do without, and the few that meet are compared."""
    every = predicted.select(normal(F.col(text)).alias("t")).union(gold.select(normal(F.col(text)).alias("t"))).distinct()
    word_sets = lambda df: df.select(normal(F.col(text)).alias("t")).distinct().select("t", F.array_distinct(F.filter(F.split("t", " "), lambda w: w != "")).alias("w"))
    rare = every.select(F.explode(F.array_distinct(F.split("t", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("seen"))

    def listed(sets: DataFrame) -> DataFrame:
        held = sets.select("t", F.size("w").alias("n"), F.explode("w").alias("word")).join(rare, "word")
        place = Window.partitionBy("t").orderBy("seen", "word")
        prefix = F.col("n") - F.ceil(F.col("n") * at) + 1
        return held.withColumn("k", F.row_number().over(place)).where(F.col("k") <= prefix).select("t", "word")

    p, g = word_sets(predicted), word_sets(gold)
    meet = listed(p).join(listed(g).withColumnRenamed("t", "g"), "word").select("t", "g").distinct()
    both = meet.join(p, "t").join(g.select(F.col("t").alias("g"), F.col("w").alias("gw")), "g")
    shared = F.size(F.array_intersect("w", "gw")) / F.greatest(F.size("w"), F.size("gw"))
    hit = both.where(shared >= at).select("t").distinct().withColumn("matched", F.lit(True))
    return p.select("t").join(hit, "t", "left").select(F.col("t").alias("text"), F.coalesce("matched", F.lit(False)).alias("matched"))


def fuzzy_scores(predicted: DataFrame, gold: DataFrame, text: str = "text", at: float = 0.6) -> DataFrame:
    """precision, recall and F1 of fuzzy matches, each side against the other."""
    share = lambda df, name: df.agg(F.coalesce(F.avg(F.col("matched").cast("int")), F.lit(0.0)).alias(name))
    both = share(fuzzy_matches(predicted, gold, text, at), "p").crossJoin(share(fuzzy_matches(gold, predicted, text, at), "r"))
    return both.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0), 6).alias("f1"))


def hypothesis_scores(hypotheses: DataFrame) -> DataFrame:
    """completeness, confidence, grounding, revision depth, and their weighted sum."""
    have = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", 1).otherwise(0)
    some = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, 1).otherwise(0)
    many = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    complete = (have("statement") + some("assumptions") + some("independent_variables") + some("dependent_variables") + have("novelty_basis")) / 5
    level = F.lower("qualitative_confidence")
    sure = F.coalesce(F.round("confidence_score", 4), F.when(level == "high", 0.85).when(level == "low", 0.2).otherwise(0.5))
    grounded = F.least(F.lit(1.0), (many("supporting_citations") + many("grounding_claim_ids")) / 5)
    depth = F.least(F.lit(1.0), many("revision_history") / 3)
    out = hypotheses.select("hypothesis_id", F.round(complete, 4).alias("completeness"), sure.alias("confidence"), grounded.alias("evidence_grounding"), depth.alias("revision_depth"))
    return out.withColumn("aggregate", F.round(F.col("completeness") * 0.4 + F.col("confidence") * 0.3 + F.col("evidence_grounding") * 0.2 + F.col("revision_depth") * 0.1, 4))


def trace_coverage(traces: DataFrame, by: str = "session_id") -> DataFrame:
    """Per session: steps, steps with both digests, their share, and failed steps."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    out = traces.groupBy(by).agg(F.count("*").alias("steps"), F.count_if(filled("input_hash") & filled("output_hash")).alias("hashed"), F.count_if(F.col("status") == "error").alias("errors"))
    return out.withColumn("coverage", F.round(F.col("hashed") / F.col("steps"), 4)).withColumn("valid", F.col("errors") == 0)


def trace_findings(traces: DataFrame) -> DataFrame:
    """session_id, sequence, tool, finding: digests that are missing, steps that failed."""
    lacks = F.array_join(F.filter(F.array(F.when(F.coalesce("input_hash", F.lit("")) == "", "input_hash"), F.when(F.coalesce("output_hash", F.lit("")) == "", "output_hash")), lambda x: x.isNotNull()), ", ")
    found = F.filter(F.array(F.when(lacks != "", F.concat(F.lit("missing: "), lacks)), F.when(F.col("status") == "error", F.concat(F.lit("failed: "), F.coalesce("error_message", F.lit("unknown error"))))), lambda x: x.isNotNull())
    return traces.select("session_id", "sequence", "tool", F.explode(found).alias("finding"))


def ungrounded(assertions: DataFrame) -> DataFrame:
    """Assertions without both paper and chunk that are not marked as of low confidence and ungrounded."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    excused = (F.lower(F.trim(F.coalesce("confidence", F.lit("")))) == "low") & F.coalesce("ungrounded", F.lit(False))
    return assertions.where(~(filled("paper_id") & filled("chunk_id")) & ~excused)


def assertion_audit(assertions: DataFrame) -> DataFrame:
    bad = ungrounded(assertions).agg(F.count("*").alias("violations"))
    return assertions.agg(F.count("*").alias("checked")).crossJoin(bad).withColumn("passed", F.col("violations") == 0)


def reference_audit(references: DataFrame, papers: DataFrame, by: str = "proposal_id") -> DataFrame:
    """Per proposal: references, those without a paper, those to unknown papers, and the share of known papers that are cited."""
    known = papers.select("paper_id").distinct().withColumn("known", F.lit(True))
    total = papers.select("paper_id").distinct().agg(F.count("*").alias("papers"))
    blank = F.coalesce("paper_id", F.lit("")) == ""
    out = references.join(known, "paper_id", "left").groupBy(by).agg(
        F.count("*").alias("references"), F.count_if(blank).alias("missing"), F.count_if(~blank & F.col("known").isNull()).alias("unknown"), F.countDistinct(F.when(F.col("known"), F.col("paper_id"))).alias("cited"),
    )
    return out.crossJoin(F.broadcast(total)).select(by, "references", "missing", "unknown", F.round(F.when(F.col("papers") > 0, F.col("cited") / F.col("papers")).otherwise(1.0), 4).alias("citation_coverage"), (F.col("missing") == 0).alias("valid"))


def hypothesis_audit(hypotheses: DataFrame, claims: DataFrame) -> DataFrame:
    """Per hypothesis: grounding claims, those that are not known, and whether anything grounds it."""
    each = hypotheses.select("hypothesis_id", F.explode("grounding_claim_ids").alias("claim_id"))
    lost = each.join(claims.select("claim_id").distinct(), "claim_id", "left_anti").groupBy("hypothesis_id").agg(F.count("*").alias("unknown_claims"))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    out = hypotheses.select("hypothesis_id", n("grounding_claim_ids").alias("grounding_claims"), n("supporting_citations").alias("citations"), (F.trim(F.coalesce("statement", F.lit(""))) != "").alias("valid"))
    return out.join(lost, "hypothesis_id", "left").fillna(0, ["unknown_claims"]).withColumn("fully_grounded", F.col("grounding_claims") + F.col("citations") > 0)


def determinism(runs: DataFrame) -> DataFrame:
    """Runs (document_id, run, digest) that differ from the document's first: expected and observed digest, and the place of
    the run."""
    order = Window.partitionBy("document_id").orderBy("run")
    seen = runs.withColumns({"expected": F.first("digest").over(order), "run_index": F.row_number().over(order)})
    return seen.where("digest <> expected").select("document_id", "expected", F.col("digest").alias("observed"), "run_index")


def determinism_rate(runs: DataFrame) -> DataFrame:
    """documents, those whose runs are all equal, and their share."""
    same = runs.groupBy("document_id").agg((F.countDistinct("digest") <= 1).cast("int").alias("same"))
    return same.agg(F.count("*").alias("documents"), F.coalesce(F.sum("same"), F.lit(0)).alias("deterministic"), F.round(F.coalesce(F.avg("same"), F.lit(1.0)), 6).alias("rate"))


def shape(value: object) -> object:
    """A JSON value with the kinds of its leaves; lists keep their length, keys their order by name."""
    if isinstance(value, dict):
        return {k: shape(value[k]) for k in sorted(value)}
    return [shape(v) for v in value] if isinstance(value, list) else "null" if value is None else type(value).__name__


def same_shape(df: DataFrame, left: str, right: str) -> DataFrame:
    """``same_shape``: whether two JSON columns are built alike; texts that are no JSON have no shape and match none."""

    def of(text: str | None) -> str | None:
        try:
            return json.dumps(shape(json.loads(text)))
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(x := of(p)) is not None and x == of(q) for p, q in zip(a, b, strict=True)])

    return df.withColumn("same_shape", same(left, right))
