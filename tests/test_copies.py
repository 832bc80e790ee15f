"""Rows that share a key, and figures that must not grow with the input."""

import os
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from assayer.functions import lexicon as lx
from assayer.functions.patterns import branches, factored, lowered
from assayer.operators import claims as cl
from assayer.operators import retrieval as rt
from assayer.operators import text as tx
from assayer.operators import validate as va
from assayer.sources import adapters as ad


def test_telemetry_of_rows_that_share_a_source(spark):
    long = "accuracy on GLUE " + "x" * 1500 + " bleu"
    rows = [(1, "92% accuracy on GLUE"), (1, "loss of 3 ms"), (1, "loss of 3 ms"), (2, long), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "k long, text string")
    got = sorted((r.source_id, r.chunks, tuple(r.context_ids), tuple(r.numeric_strings), len(r.warnings)) for r in tx.telemetry(df, "k").collect())
    assert got == [(1, 1, ("ctx_glue",), ("92%",), 1), (1, 1, ("ctx_metric_loss",), ("3 ms",), 1), (1, 1, ("ctx_metric_loss",), ("3 ms",), 1), (2, 2, ("ctx_glue", "ctx_metric_bleu"), (), 0)]
    chunks = tx.ingested(df.where("k = 2"), "k").orderBy("ord").select("context_id").collect()
    assert [r.context_id for r in chunks] == ["ctx_glue", "ctx_metric_bleu"]


def test_artifacts_of_rows_that_share_a_key(spark):
    rows = [(1, "accuracy = 95.3% and BLEU: 3.5"), (1, "Accuracy = 95.3%; bleu: 3.5"), (1, "accuracy = 95.3%"), (2, "accuracy = 95.3%")]
    got = sorted(tuple(r) for r in tx.metric_artifacts(spark.createDataFrame(rows, "k long, text string").repartition(3), "k").collect())
    assert got == [(1, "accuracy", 95.3, True), (1, "accuracy", 95.3, True), (1, "bleu", 3.5, False), (1, "bleu", 3.5, False), (2, "accuracy", 95.3, True)]


def test_factored_patterns_find_the_same():
    r = random.Random(1)
    for listed in (lx.METRICS, lx.CLAIM_METRICS, lx.DATASETS, lx.EFFICIENCY_UNITS, lx.NORMAL_METRICS, lx.DELTA):
        whole, short = re.compile(rf"\b({listed})\b", re.IGNORECASE), re.compile(rf"\b({factored(listed)})\b", re.IGNORECASE)
        low = re.compile(lowered(short.pattern))
        words = [re.sub(r"\\s[?+]?", " ", re.sub(r"\\d\+?", "7", b)).replace("?", "") for b in branches(listed)]
        for _ in range(400):
            text = r.choice(["", " ", "-", "x"]).join(r.choice([*words, "\u212a", "\u017f", "-", "1", "é"]) for _ in range(r.randint(1, 5)))
            text = r.choice([text, text.upper(), text[:-1]])
            spans = [m.span(1) for m in whole.finditer(text)]
            assert spans == [m.span(1) for m in short.finditer(text)]
            assert not text.isascii() or spans == [m.span(1) for m in low.finditer(text.lower())]
    assert max(map(len, branches(factored(lx.METRICS)[3:-1]))) > 60 and branches(r"a\||b[|]|(?:c|d)") == [r"a\|", "b[|]", "(?:c|d)"]


def test_repeated_texts_are_asked_once(monkeypatch):
    asked = []
    cl._again.cache_clear()
    monkeypatch.setattr(cl, "claims_of", lambda t, k=None, of=cl.claims_of: asked.append(t) or of(t, k))
    texts = ["BERT-9 achieves 91% accuracy on GLUE.", None, "x" * 500, "BERT-9 achieves 91% accuracy on GLUE.", "Results show 90% accuracy and 85% accuracy on RTE."] * 3
    got = cl._claims_of_each(texts, [None] * len(texts)).to_pylist()
    assert got == [[c._asdict() for c in cl.claims_of(t or "")] for t in texts] and len(asked) == 4 + len(texts)
    cl._claims_of_each(texts, [None] * len(texts))
    assert len(asked) == 4 + len(texts) + 1  # only the long one, which is not kept


def test_scans_of_ascii_and_other_texts(spark):
    """Both ways to search give what the listed patterns give."""
    r = random.Random(2)
    pieces = ["accuracy", "F1-macro", "ROUGE-L", "GLUE", "CIFAR - 10", "SQuAD", "mAP", "top-5 accuracy", "92.5 %", "3 ms", "7", "ctx_my-1", "xctx_a", "_", "K", "ſ", "é", " ", "٣", "-", ".", "hit@10", "ms-marco", "CIFAR-100"]
    texts = ["".join(r.choice(["", " ", "_"]) + r.choice(pieces) for _ in range(r.randint(0, 7))) for _ in range(3000)]
    df = spark.createDataFrame([(t, t.upper()) for t in texts] + [(None, None)], "t string, u string").select(F.explode(F.array("t", "u")).alias("t"))
    every = lambda p, g=0: F.regexp_extract_all("t", F.lit("(?iU)" + p), F.lit(g))
    names, sets, numbers = every(rf"\b({lx.METRICS})\b", 1), every(rf"\b({lx.DATASETS})\b", 1), every(rf"\b\d+(?:\.\d+)?(?:\s*(?:{lx.UNITS}))?")
    context = F.coalesce(F.get(F.regexp_extract_all("t", F.lit(r"\bctx_[a-zA-Z0-9_-]+\b"), F.lit(0)), F.lit(0)), F.concat(F.lit("ctx_"), F.lower(F.get(sets, F.lit(0)))), F.concat(F.lit("ctx_metric_"), F.replace(F.lower(F.get(names, F.lit(0))), F.lit("-"), F.lit("_"))), F.lit("ctx_unknown"))
    signal = F.round(F.greatest(F.least((F.size(names) + F.size(numbers)) / (F.greatest(F.length("t"), F.lit(1)) / 100), F.lit(1.0)), F.lit(0.01)), 4)
    t = F.col("t")
    wrong = df.where(~context.eqNullSafe(tx.context_id(t)) | ~signal.eqNullSafe(tx.signal(t)) | ~names.eqNullSafe(tx.metric_names(t)) | ~sets.eqNullSafe(tx.dataset_names(t)) | ~numbers.eqNullSafe(tx.numbers(t)))
    assert wrong.collect() == []
    plan = df.select(tx.signal(t), tx.context_id(t))._jdf.queryExecution().optimizedPlan().toString()
    assert lx.METRICS not in plan and "lower(t" in plan  # the listed form, each alternative tried anew at every word, took most of the time


def test_cluster_labels_by_hash_with_ties(spark):
    r = random.Random(3)
    rows = [(r.choice(["x", "y", None]), r.choice([3, 4, 9, -10]), " ".join(r.choice(["one", "two", "the", "Six", "ten", "abc", "of"]) for _ in range(r.randint(0, 6)))) for _ in range(30)] + [("z", 1, "zeta eta zeta theta eta"), ("w", 2, None)]
    want = {}
    for by in {b for b, _, _ in rows}:
        n, first = Counter(), {}
        for _, k, t in (x for x in rows if x[0] == by):
            for at, w in enumerate(re.findall("[a-z]{3,}", (t or "").lower())):
                if w not in lx.LABEL_STOPWORDS:
                    n[w] += 1
                    first[w] = min(first.get(w, (k, at)), (k, at))
        if n:
            want[by] = " ".join(w.capitalize() for w in sorted(n, key=lambda w: (-n[w], first[w], w))[:4])
    df = spark.createDataFrame([(*x, f"{x[1] + 20:03}") for x in rows], "by string, k long, text string, s string").repartition(3)
    labels = rt.cluster_labels(df, "by", order="k")
    assert {x.by: x.name for x in labels.collect()} == want == {x.by: x.name for x in rt.cluster_labels(df, "by", order="s").collect()}
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan.split("Window")[-1]  # counting by sorting all words took much of the time


def test_semantic_scores_without_texts_in_python(spark):
    df = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 97 > 0, F.concat(F.lit("text "), (F.col("id") % 700).cast("string"))).alias("text")).repartition(2)
    query = [r.embedding for r in rt.hash_embedding(spark.createDataFrame([("text 5",)], "text string")).collect()][0]
    slow = rt.vector_topk(rt.hash_embedding(df).withColumnRenamed("doc_id", "vec_id"), query, 40).select("vec_id", "score")
    found = rt.semantic_topk(df, "text 5", 40)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in slow.collect()]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "score(unhex(sha2(" in plan and "double" not in plan.split("ArrowEvalPython")[1].split("\n")[1]


def test_joined_tables_are_dealt_by_their_size(spark, monkeypatch):
    """The tasks of the join grow in number with the files, so that the rows of a task do not."""
    d = "/root/testdata/sf0.001"
    size = sum(os.path.getsize(f"{d}/{t}.parquet") for t in ("lineitem", "orders"))
    for share in (20, 40):
        monkeypatch.setattr(ad, "TASK_BYTES", size // share)
        plan = tx.propagate_contexts(ad.view(spark, d, ad.PAGED))._jdf.queryExecution().sparkPlan().toString()
        n = {int(x) for x in re.findall(r"hashpartitioning\([lo]_orderkey#\w+, (\d+)\), REPARTITION_BY_NUM", plan)}
        assert n and all(share <= x <= share + 1 for x in n)


def test_problem_rows_are_those_of_validated(spark):
    claims = [("c1", "A", "is", "fast and cheap", "high", [("s", "short", 0.2), ("s", None, None)]), ("c2", None, "beats", "ok", "low", []), ("c3", "A or\tB", "beats", "andy  and", "medium", None), ("c4", "A", "beats", "andy brands", "low", [("s", "a long snippet", 0.9)])]
    df = spark.createDataFrame(claims, "claim_id string, subject string, predicate string, object string, confidence_level string, evidence array<struct<source_id:string,snippet:string,retrieval_score:double>>")
    rows = va.problem_rows(df, "claim", "claim_id")
    listed = va.validated(df, "claim").select("claim_id", F.inline("problems"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, listed.collect()))
    assert {(r.claim_id, r.rule) for r in rows.where("rule = 'compound_words'").collect()} == {("c1", "compound_words"), ("c3", "compound_words")}
    assert "filter(" not in rows._jdf.queryExecution().optimizedPlan().toString()  # items were looked at one by one, uncompiled
