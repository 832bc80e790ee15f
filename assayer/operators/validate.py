"""Validators: rules as columns. A rule is (field, rule, severity, fails); a row's problems are the rules that fail on it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx

Rule = tuple[str, str, str, Column]
_PROBLEMS = "array<struct<field:string,rule:string,severity:string>>"


def _blank(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def _none(c: str | Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _shorter(c: str | Column, n: int) -> Column:
    return F.length(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))) < n


def _repeats(c: str) -> Column:
    return F.coalesce(F.size(F.array_distinct(c)) < F.size(c), F.lit(False))


def non_empty(*fields: str) -> list[Rule]:
    return [(f, "non_empty_string", "error", _blank(f)) for f in fields]


def id_format(field: str, prefix: str) -> list[Rule]:
    return [(field, "id_format", "error", _blank(field)), (field, "id_prefix_convention", "warning", ~_blank(field) & ~F.startswith(field, F.lit(prefix)))]


def min_items(field: str, n: int = 1) -> list[Rule]:
    return [(field, "list_min_length", "error", F.coalesce(F.size(field), F.lit(0)) < n)]


def _failed(rules: list[Rule]) -> Column:
    """The rules that fail; null in the place of each that holds."""
    each = [F.when(F.coalesce(fails, F.lit(False)), F.struct(F.lit(f).alias("field") if isinstance(f, str) else f.alias("field"), F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for f, r, s, fails in rules]
    return F.array(*each)


def _each(field: str, rules: Callable[[Column, Column], list[Rule]]) -> Column:
    """Problems of every item of a list, under names like evidence[2].snippet, and nulls for rules that hold."""
    name = lambda i, f: F.concat(F.lit(f"{field}["), i.cast("string"), F.lit(f"]{f}"))
    found = F.flatten(F.transform(field, lambda item, i: _failed([(name(i, f), r, s, c) for f, r, s, c in rules(item, i)]).cast(_PROBLEMS)))
    return F.coalesce(found, F.array().cast(_PROBLEMS))


def provenance(field: str = "evidence") -> Column:
    return _each(field, lambda e, i: [(".source_id", "provenance_completeness", "error", _blank(e.source_id))])


def claim_problems() -> Column:
    """Claims (subject, predicate, object, confidence_level, evidence of source_id, snippet, retrieval_score)."""
    statement = F.lower(F.concat_ws(" ", "subject", "predicate", "object"))
    joining = "|".join(re.escape(w) for w in lx.CONJUNCTIONS if not re.search(r"\s", w))
    n = F.coalesce(F.size("evidence"), F.lit(0))
    mean = F.when(n > 0, F.aggregate("evidence", F.lit(0.0), lambda t, e: t + F.coalesce(e.retrieval_score, F.lit(0.0))) / n).otherwise(0.0)
    sources = F.size(F.array_distinct(F.transform("evidence", lambda e: e.source_id)))
    weak = F.exists("evidence", lambda e: e.retrieval_score < 0.5)
    level = lambda x: (F.col("confidence_level") == x) & (n > 0)
    whole = _failed([
        *((f, "non_empty_string", "error", _blank(f)) for f in ("subject", "predicate", "object")),
        ("statement", "compound_words", "warning", statement.rlike(rf"(?:^|\s)(?:{joining})(?:\s|$)")),
        ("statement", "atomicity", "warning", F.contains(statement, F.lit(" and ")) | F.contains(statement, F.lit(" or "))),
        ("evidence", "evidence_required", "error", n == 0),
        ("predicate", "statement_coherence", "warning", ~F.lower("predicate").rlike("|".join(lx.RELATION_VERBS))),
        ("object", "statement_coherence", "error", _shorter("object", 3)),
        ("confidence_level", "confidence_sources", "error", level("high") & (sources < 2)), ("confidence_level", "confidence_calibration", "error", level("high") & (mean < 0.7)),
        ("evidence", "evidence_quality", "warning", level("high") & weak), ("confidence_level", "confidence_calibration", "warning", level("medium") & (mean < 0.5)),
        ("confidence_level", "confidence_justification", "warning", level("low") & (sources >= 3) & (mean >= 0.8)),
    ])
    items = _each("evidence", lambda e, i: [(".source_id", "evidence_provenance", "error", _blank(e.source_id)), (".snippet", "evidence_quality", "error", _shorter(e.snippet, 10)), (".retrieval_score", "evidence_quality", "warning", e.retrieval_score < 0.5)])
    return F.concat(whole, items)


def evidence_problems() -> Column:
    """Evidence records (evidence_id, source_id, type, page, model_version, caption, units, bounding_box, extracted_data as JSON)."""
    kind = lambda x: F.lower("type") == x
    data = F.col("extracted_data")
    return _failed([
        *non_empty("evidence_id", "source_id", "model_version"), ("page", "page_number_valid", "error", F.coalesce(F.col("page"), F.lit(0)) < 1),
        ("extracted_data", "extracted_data_non_empty", "error", _blank("extracted_data") | (F.trim(data) == "{}")),
        ("context.caption", "table_caption_recommended", "warning", kind("table") & _blank("caption")),
        ("context.units", "numeric_units_recommended", "warning", kind("table") & F.get_json_object(data, "$.columns").isNotNull() & F.get_json_object(data, "$.rows").rlike(r"(?<![\w\"])\d") & _blank("units")),
        ("context.caption", "figure_caption_recommended", "warning", kind("figure") & _blank("caption")), ("bounding_box", "figure_bbox_recommended", "warning", kind("figure") & _blank("bounding_box")),
        ("extracted_data.text", "text_length_check", "warning", kind("text") & F.get_json_object(data, "$.text").isNotNull() & _shorter(F.get_json_object(data, "$.text"), 10)),
    ])


def hypothesis_problems() -> Column:
    """Hypotheses: texts, lists of texts, counts of supporting and contradicting evidence, revisions (iteration, changes, rationale)."""
    total = F.coalesce(F.col("supporting_count"), F.lit(0)) + F.coalesce(F.col("contradicting_count"), F.lit(0))
    ratio = F.when(total > 0, F.col("supporting_count") / total).otherwise(0.0)
    high = (F.col("qualitative_confidence") == "high") & (total > 0)
    lower = lambda c: F.transform(c, F.lower)
    whole = _failed([
        *id_format("hypothesis_id", "hyp_"), *non_empty("statement", "rationale"), ("statement", "statement_length", "warning", _shorter("statement", 20)),
        ("assumptions", "no_hypothesis_without_assumptions", "error", _none("assumptions")),
        ("independent_variables", "variables_required", "error", _none("independent_variables")), ("dependent_variables", "variables_required", "error", _none("dependent_variables")),
        ("variables", "variable_independence", "error", F.arrays_overlap(lower("independent_variables"), lower("dependent_variables"))),
        ("evidence", "evidence_required", "warning", total == 0), ("qualitative_confidence", "confidence_evidence_alignment", "warning", high & (ratio < 0.7)),
        ("qualitative_confidence", "confidence_evidence_count", "warning", high & (F.col("supporting_count") < 2)), ("qualitative_confidence", "contradictions_acknowledged", "warning", high & (F.col("contradicting_count") > 0)),
        ("novelty_basis", "novelty_justification", "warning", _shorter("novelty_basis", 20)), ("novelty_basis", "novelty_clarity", "warning", ~F.lower(F.coalesce("novelty_basis", F.lit(""))).rlike("|".join(lx.NOVELTY))),
        ("boundary_conditions", "boundary_conditions_recommended", "warning", _none("boundary_conditions")),
    ])
    short = lambda field, n, rule, severity="error": _each(field, lambda x, i: [("", rule, severity, _shorter(x, n))])
    revisions = _each("revision_history", lambda r, i: [(".iteration", "revision_history_sequential", "error", r.iteration != i + 1), (".changes", "revision_quality", "warning", _shorter(r.changes, 10)), (".rationale", "revision_quality", "warning", _shorter(r.rationale, 10))])
    return F.concat(whole, short("assumptions", 5, "assumption_quality"), short("independent_variables", 2, "variable_quality"), short("dependent_variables", 2, "variable_quality"), revisions, short("boundary_conditions", 5, "boundary_condition_quality", "warning"))


def paper_problems() -> Column:
    return _failed([*non_empty("title", "pdf_path"), *id_format("paper_id", "paper_"), ("metadata", "paper_metadata_completeness", "warning", _blank("abstract") & _blank("doi") & _blank("arxiv_id")), ("chunk_ids", "unique_chunk_ids", "error", _repeats("chunk_ids"))])


def chunk_problems() -> Column:
    return _failed([*non_empty("paper_id", "text", "embedding_id"), *id_format("chunk_id", "chunk_"), ("text", "chunk_text_length", "warning", _shorter("text", 10))])


def cluster_map_problems() -> Column:
    """Maps (map_id, provenance, clusters of cluster_id, representative_paper_ids, centroid_embedding)."""
    ids = F.transform("clusters", lambda c: c.cluster_id)
    whole = _failed([*id_format("map_id", "map_"), ("clusters", "cluster_map_non_empty", "error", _none("clusters")), ("clusters", "unique_cluster_ids", "error", F.size(F.array_distinct(ids)) < F.size(ids)), ("provenance", "cluster_map_provenance", "warning", _none("provenance"))])
    return F.concat(whole, _each("clusters", lambda c, i: [(".representative_paper_ids", "cluster_representative_required", "error", _none(c.representative_paper_ids)), (".centroid_embedding", "cluster_centroid_required", "error", _none(c.centroid_embedding))]))


def critique_problems() -> Column:
    nothing = _none("counter_evidence") & _none("weak_assumptions") & _none("suggested_revisions")
    return _failed([*id_format("critique_id", "crit_"), *non_empty("hypothesis_id"), ("critique", "critique_substance", "error", nothing), ("suggested_revisions", "critique_actionability", "warning", F.col("severity").isin("high", "critical") & _none("suggested_revisions"))])


def proposal_problems() -> Column:
    return _failed([*id_format("proposal_id", "proposal_"), *non_empty("hypothesis_id"), ("references", "proposal_references", "warning", _none("references")), ("references", "proposal_reference_uniqueness", "warning", _repeats("references"))])


def session_problems() -> Column:
    return _failed([*id_format("session_id", "session_"), *non_empty("user_input", "phase"), ("active_paper_ids", "session_active_paper_uniqueness", "warning", _repeats("active_paper_ids")), ("hypothesis_ids", "session_hypothesis_uniqueness", "warning", _repeats("hypothesis_ids"))])


def context_problems() -> Column:
    return _failed([*id_format("context_id", "ctx_"), *non_empty("dataset"), ("metric.range", "metric_range_order", "error", F.col("range_min") >= F.col("range_max")), ("protocol", "protocol_consistency", "warning", (F.coalesce("cross_validation_folds", F.lit(0)) > 0) & (F.col("split_type") == "train/test"))])


def normalized_claim_problems() -> Column:
    given = ~_blank("normalized_claim_id")
    return _failed([*non_empty("claim_id", "subject", "predicate", "metric_canonical"), ("normalized_claim_id", "id_prefix_convention", "warning", given & ~F.startswith("normalized_claim_id", F.lit("norm_"))), ("metric", "metric_alias_consistency", "warning", ~_blank("metric") & (F.col("metric") != F.col("metric_canonical"))), ("source_claim_ids", "source_claim_traceability", "warning", ~_none("source_claim_ids") & ~F.array_contains("source_claim_ids", F.col("claim_id")))])


def extraction_result_problems() -> Column:
    return _failed([*id_format("result_id", "extract_"), *non_empty("paper_id"), ("provenance.page", "extraction_page_alignment", "warning", F.col("provenance_page") != F.col("page_number")), ("caption", "artifact_caption_recommended", "warning", F.col("artifact_type").isin("table", "figure") & _blank("caption")), ("normalized_data", "normalized_data_recommended", "warning", _blank("normalized_data") | (F.col("normalized_data") == "{}"))])


def report_problems() -> Column:
    return _failed([*id_format("report_id", "report_"), *non_empty("claim_cluster_id"), ("report", "report_non_empty", "error", _none("consensus_claims") & _none("contradiction_pairs") & _none("uncertainty_markers"))])


VALIDATORS: dict[str, Callable[[], Column]] = {
    "claim": claim_problems, "evidence": evidence_problems, "hypothesis": hypothesis_problems, "paper": paper_problems, "chunk": chunk_problems, "cluster_map": cluster_map_problems,
    "critique": critique_problems, "proposal": proposal_problems, "session": session_problems, "context": context_problems, "normalized_claim": normalized_claim_problems,
    "extraction_result": extraction_result_problems, "contradiction_report": report_problems,
}


def validated(df: DataFrame, kind: str) -> DataFrame:
    """All rows with ``problems`` and ``is_valid`` (no error among them)."""
    found = F.filter(VALIDATORS[kind](), lambda p: p.isNotNull()).cast(_PROBLEMS)
    return df.withColumn("problems", found).withColumn("is_valid", ~F.exists("problems", lambda p: p.severity == "error"))


def problem_rows(df: DataFrame, kind: str, key: str) -> DataFrame:
    """key, field, rule, severity: one row per problem. Rules that hold are left out after the rows are made, where it is
    compiled, and not in the arrays, where each item would be looked at by itself."""
    return df.select(key, F.explode(VALIDATORS[kind]()).alias("p")).where("p is not null").select(key, "p.field", "p.rule", "p.severity")


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that stand in several rows, which breaks a batch's uniqueness rule."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
