import hashlib
import itertools
import json
import random
from collections import Counter

from assayer.operators import contexts as cx
from assayer.operators import relations as rel

ROWS = [(1, "ctx_bert_glue", "BERT", 92.5, "absolute"), (2, "ctx_bert_glue", "BERT", 45.0, "absolute"), (3, "ctx_bert_glue", "GPT", 88.0, "absolute"), (4, "ctx_bert_squad", "BERT", 93.0, "absolute"), (5, "ctx_improvement", "BERT-Improved", 2.5, "delta")]
SCHEMA = "ord long, claim_id string, context_id string, subject string, predicate string, metric string, value double, unit string, polarity string, subtype string"


def claims(spark):
    rows = [(o, f"c{o}", c, s, "achieves", "ACCURACY", v, "%", "supports", k) for o, c, s, v, k in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


def chance_claims(spark, n=160):
    """Random claims with ties, values at the tolerance, nulls, and both polarities."""
    r = random.Random(3)
    values = [0.1, 0.15, 0.2, 0.2 + 0.05, 0.25, 0.3, 0.3000000001, 0.35, 0.1 + 5e-10, None]
    rows = [(i, f"c{i}", r.choice(["x", "y", None]), r.choice(["A", "a", "B"]), "is", r.choice(["m", "k"]), r.choice(values), "%", r.choice(["supports", "refutes", "neutral", None]), r.choice(["absolute"] * 3 + ["delta"])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_relations(spark):
    c = claims(spark)
    both = lambda df: sorted((r.claim_a, r.claim_b) for r in df.collect())
    assert both(rel.contradictions(c)) == [("c1", "c2")]
    assert both(rel.conditional_divergence(c)) == [("c1", "c4"), ("c2", "c4")]
    assert both(rel.legacy_contradictions(c)) == [("c1", "c2"), ("c1", "c3"), ("c2", "c3")]
    assert both(rel.legacy_divergence(c)) == [("c1", "c4"), ("c2", "c4")]
    v = rel.performance_variance(c).first()
    assert (v.n, v.subjects, v.value_mean, v.value_range) == (3, 2, 75.166667, 47.5)
    assert {r.claim_id for r in rel.members(rel.performance_variance(c), c, "subtype = 'absolute'").collect()} == {"c1", "c2", "c3"}
    assert [(r.subject, r.contexts, r.claims, r.links) for r in rel.divergence_classes(c).collect()] == [("bert", 2, 3, 2)]
    assert [(r.context_id, r.n) for r in rel.group_contradictions(rel.contradictions(c), c).collect()] == [("ctx_bert_glue", 1)]


def test_counts_equal_pairs(spark):
    c = chance_claims(spark)
    count = lambda df: Counter((r.context_id, r.metric) for r in df.collect())
    as_counter = lambda df: Counter({(r.context_id, r.metric): r.contradictions for r in df.collect()})
    assert as_counter(rel.contradiction_counts(c)) == count(rel.contradictions(c))
    assert as_counter(rel.legacy_counts(c)) == count(rel.legacy_contradictions(c))
    known = c.where("polarity is not null")
    assert as_counter(rel.legacy_counts(known)) == count(rel.legacy_contradictions(known))
    pairs = Counter()
    for a, b in itertools.combinations([r for r in c.collect() if r.value is not None], 2):
        pairs[a.metric] += a.metric == b.metric and abs(a.value - b.value) <= 0.05
    assert {r.metric: r.close for r in rel.close_pairs(c, ["metric"], 0.05).collect()} == pairs
    links = Counter((r.subject, r.metric) for r in rel.conditional_divergence(c).collect())
    assert {(r.subject, r.metric): r.links for r in rel.divergence_classes(c).collect()} == links


def test_tolerances_by_unit(spark, monkeypatch):
    monkeypatch.setattr(rel, "TOLERANCES", {"ms": 0.5})
    r = random.Random(4)
    rows = [(i, f"c{i}", "x", r.choice("AB"), "is", "m", r.choice([0.1, 0.3, 0.6, 0.7, 1.2]), r.choice(["ms", "%"]), r.choice(["supports", "refutes"]), "absolute") for i in range(60)]
    c = spark.createDataFrame(rows, SCHEMA)
    assert rel.contradiction_counts(c).first().contradictions == rel.contradictions(c).count() > 0


def test_beliefs(spark):
    got = {r.context_id: r for r in rel.beliefs(claims(spark)).collect()}
    assert (got["ctx_bert_glue"].confidence, got["ctx_bert_glue"].status, got["ctx_bert_glue"].strength) == ("medium", "supported", 3)
    assert got["ctx_bert_squad"].confidence == "medium" and got["ctx_improvement"].confidence == "low" and got["ctx_improvement"].value_max == 2.5


def test_proposition_ids(spark):
    got = rel.proposition_ids(spark.createDataFrame([("ctx_é", "M"), (None, "M")], "context_id string, metric string")).collect()
    for r in got:
        assert r.proposition_id == hashlib.sha256(json.dumps({"context_id": r.context_id, "metric": r.metric}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def context(i, version, dataset="GLUE", unit="%"):
    return (i, "classification", dataset, version, ("Accuracy", unit, True, None))


CONTEXT = "context_id string, task string, dataset string, dataset_version string, metric struct<name:string,unit:string,higher_is_better:boolean,aggregation_method:string>"


def test_contexts(spark):
    c = spark.createDataFrame([context("a", "1"), context("b", "2", "glue"), context("c", None), context("d", "1", unit=None), context("d", "1", unit=None)], CONTEXT)
    assert sorted(tuple(r) for r in cx.comparable_pairs(c.where("context_id <> 'd'")).collect()) == [("a", "c"), ("b", "c")]
    assert {r.identity for r in cx.equivalence_classes(c).collect()} == {"classification:glue:1:accuracy:%", "classification:glue:2:accuracy:%", "classification:glue:default:accuracy:%", "classification:glue:1:accuracy:dimensionless"}
    assert [r.context_id for r in cx.registered_twice(c).collect()] == ["d"]
    rows = [(1, "p", "a", "S", "v", "supports"), (2, "q", "b", "s", "V", "refutes"), (3, "r", "c", "s", "v", "refutes"), (4, "t", "a", "s", "v", "refutes"), (5, "u", "lost", "s", "v", "refutes")]
    found = rel.comparable_contradictions(spark.createDataFrame(rows, "ord long, claim_id string, context_id string, subject string, predicate string, polarity string"), c)
    assert sorted(tuple(r) for r in found.collect()) == [("p", "r"), ("p", "t")]


def test_registry_and_tasks(spark):
    known = {r.context_id: r.chunks for r in cx.registry(spark.createDataFrame([("ctx_glue",), ("ctx_glue",)], "context_id string")).collect()}
    assert known == {"ctx_glue": 2, "ctx_unknown": 0}
    rows = [("s", 1, 2, "Penn  Treebank", "WER"), ("s", 1, 1, "penn treebank", None), ("s", 1, 3, "WMT 2014", "BLEU")]
    got = {r.context_id: r for r in cx.discover(spark.createDataFrame(rows, "source_id string, page long, ord long, dataset string, metric string")).collect()}
    assert (got["ctx_penn_treebank"].task, got["ctx_penn_treebank"].metric, got["ctx_penn_treebank"].chunks) == ("sequence_labeling", "unknown", 2)
    assert (got["ctx_wmt_2014"].task, got["ctx_wmt_2014"].higher_is_better) == ("translation", True)
