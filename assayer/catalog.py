"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import lexicon as lx
from .operators import claims as cl
from .operators import normalize as nz
from .operators import relations as rel
from .operators import retrieval as rt
from .operators import segment as sg
from .operators import text as tx
from .plans import flagship
from .sources import adapters as ad

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


N, S, P, T = (f"({x})" for x in (ad.NCLAIMS, ad.SENTENCES, ad.PAGED, ad.TRACES))
def _mean(keep: str = "") -> str:
    some = f" FILTER ({keep})" if keep else ""
    return f"(2 * sum(CAST(round(value * 1000000) AS HUGEINT)){some} + count(value){some}) // (2 * count(value){some}) / 1000000"


_PAIR = "a.ord < b.ord AND a.context_id IS NOT DISTINCT FROM b.context_id AND a.metric IS NOT DISTINCT FROM b.metric"
_OPPOSED = "(a.polarity <> b.polarity AND abs(a.value - b.value) <= 1e-9 + 1e-12)"
_CONTRA = f"""SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, a.context_id, lower(a.subject) AS subject, a.metric, round(abs(a.value - b.value), 6) AS difference,
 CASE WHEN {_OPPOSED} THEN 'polarity_opposition' ELSE 'value_divergence' END AS reason FROM {N} a JOIN {N} b ON {_PAIR} AND lower(a.subject) = lower(b.subject) AND a.subtype = 'absolute' AND b.subtype = 'absolute'
 AND ({_OPPOSED} OR abs(a.value - b.value) > 0.05 + 1e-12)"""
_BOOST = f"SELECT subject, metric, count(DISTINCT context_id) AS contexts FROM {N} GROUP BY ALL HAVING count(DISTINCT context_id) >= 2 AND bool_and(polarity = 'supports')"
_LEGACY = f"""SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, a.context_id, a.metric, CASE WHEN a.polarity <> b.polarity THEN 'polarity_opposition' ELSE 'value_divergence' END AS reason
 FROM {N} a JOIN {N} b ON {_PAIR} AND (a.polarity <> b.polarity OR abs(a.value - b.value) > 0.05)"""


@query(_CONTRA)
def contradictions(spark, d):
    return rel.contradictions(ad.view(spark, d, ad.NCLAIMS))


@query(f"SELECT context_id, metric, count(*) AS n, count(DISTINCT lower(subject)) AS subjects, min(value) AS value_min, max(value) AS value_max, {_mean()} AS value_mean, round(max(value) - min(value), 6) AS value_range FROM {N} WHERE subtype = 'absolute' GROUP BY context_id, metric HAVING count(*) >= 2 AND count(DISTINCT lower(subject)) >= 2")
def perf_variance(spark, d):
    return rel.performance_variance(ad.view(spark, d, ad.NCLAIMS))


@query(f"SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, lower(a.subject) AS subject, a.metric, a.context_id AS context_a, b.context_id AS context_b FROM {N} a JOIN {N} b ON a.ord < b.ord AND lower(a.subject) = lower(b.subject) AND a.metric = b.metric AND a.context_id IS DISTINCT FROM b.context_id WHERE a.subtype = 'absolute' AND b.subtype = 'absolute'")
def cond_divergence(spark, d):
    return rel.conditional_divergence(ad.view(spark, d, ad.NCLAIMS))


@query(_LEGACY)
def legacy_contradictions(spark, d):
    return rel.legacy_contradictions(ad.view(spark, d, ad.NCLAIMS))


@query(f"SELECT g.*, round(coalesce(c, 0) / (n * (n - 1) / 2), 6) AS density FROM (SELECT context_id, metric, count(*) AS n, {_mean()} AS value_mean, min(value) AS value_min, max(value) AS value_max FROM {N} GROUP BY context_id, metric HAVING count(*) >= 2) g LEFT JOIN (SELECT context_id, metric, count(*) AS c FROM ({_LEGACY}) GROUP BY ALL) f USING (context_id, metric)")
def consensus(spark, d):
    return rel.consensus(ad.view(spark, d, ad.NCLAIMS))


@query(f"SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, lower(a.subject) AS subject, a.metric FROM {N} a JOIN {N} b ON a.ord < b.ord AND lower(a.subject) = lower(b.subject) AND lower(a.predicate) = lower(b.predicate) AND a.metric = b.metric AND a.context_id IS DISTINCT FROM b.context_id")
def legacy_divergence(spark, d):
    return rel.legacy_divergence(ad.view(spark, d, ad.NCLAIMS))


@query(_BOOST)
def context_boost(spark, d):
    return rel.context_boost(ad.view(spark, d, ad.NCLAIMS))


def _beliefs_sql(n: str, contradictions: str, boost: str) -> str:
    return f"""WITH n AS {n}, g AS (SELECT context_id, metric, count(*) AS total, coalesce(min(value) FILTER (subtype = 'absolute'), min(value)) AS value_min, coalesce(max(value) FILTER (subtype = 'absolute'), max(value)) AS value_max,
 coalesce({_mean("subtype = 'absolute'")}, {_mean()}) AS value_mean, count(*) FILTER (polarity = 'supports') AS supporting, count(*) FILTER (polarity = 'refutes') AS refuting FROM n GROUP BY ALL),
 c AS (SELECT context_id, metric, count(*) AS k FROM ({contradictions}) GROUP BY ALL), b AS (SELECT DISTINCT context_id, metric, true AS boost FROM n SEMI JOIN ({boost}) USING (subject, metric)),
 j AS (SELECT g.*, coalesce(k, 0) AS contradictions, CASE WHEN total > 1 THEN coalesce(k, 0) / (total * (total - 1) / 2) ELSE 0.0 END AS den, coalesce(boost, false) AS boost, CASE WHEN supporting + refuting > 0 THEN supporting / (supporting + refuting) ELSE 0.0 END AS ratio FROM g LEFT JOIN c USING (context_id, metric) LEFT JOIN b USING (context_id, metric))
 SELECT context_id, metric, total, value_min, value_max, value_mean, supporting, refuting, contradictions, round(den, 6) AS density, supporting - refuting AS strength,
 CASE WHEN supporting >= 3 AND ratio >= 0.75 AND den <= 0.2 THEN 'high' WHEN supporting >= 2 AND ratio >= 0.6 THEN 'medium' WHEN boost THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN supporting + refuting = 0 THEN 'insufficient_evidence' WHEN refuting = 0 THEN 'supported' WHEN refuting > supporting THEN 'contested' ELSE 'weakly_supported' END AS status FROM j"""


@query(_beliefs_sql(N, _CONTRA, _BOOST))
def beliefs(spark, d):
    return rel.beliefs(ad.view(spark, d, ad.NCLAIMS))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return rel.duplicate_ids(ad.table(spark, d, "orders"), "o_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1 OR o_custkey IS NULL")
def ordered_dedup(spark, d):
    return rel.first_of(ad.table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query(f"SELECT session_id, tool, count(*) AS calls, sum(tokens) AS tokens, (2 * sum(CAST(round(duration * 10000) AS BIGINT)) + count(*)) // (2 * count(*)) / 10000 AS mean_duration, round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate, round(count(*) FILTER (cache_hit) / count(*), 6) AS cache_rate FROM {T} GROUP BY ROLLUP (session_id, tool)")
def tool_metrics(spark, d):
    return rel.tool_metrics(ad.view(spark, d, ad.TRACES))


def _scan(name: str, column, group: int, pattern: str, source: str = S):
    def run(spark, d):
        return ad.view(spark, d, ad.SENTENCES).select("ord", F.array_join(column(F.col("text")), "|").alias("found"))

    run.__name__ = name
    query(f"SELECT ord, array_to_string(regexp_extract_all(text, '(?i){pattern}', {group}), '|') AS found FROM {source}")(run)


_scan("scan_numeric", tx.numbers, 0, rf"\b\d+(?:\.\d+)?(?:\s*(?:{lx.UNITS}))?")
_scan("scan_units", tx.units, 1, rf"\b\d+(?:\.\d+)?\s*({lx.UNITS})")
_scan("scan_metrics", tx.metric_names, 1, rf"\b({lx.METRICS})\b")
_scan("scan_datasets", tx.dataset_names, 1, rf"\b({lx.DATASETS})\b")


def _one(pattern: str) -> str:
    return f"nullif(regexp_extract(text, '(?i){pattern}', 1), '')"


@query(rf"SELECT ord, coalesce('ctx_' || lower({_one(rf'\b({lx.DATASETS})\b')}), 'ctx_metric_' || replace(lower({_one(rf'\b({lx.METRICS})\b')}), '-', '_'), 'ctx_unknown') AS context_id FROM {S}")
def context_id(spark, d):
    return ad.view(spark, d, ad.SENTENCES).select("ord", tx.context_id(F.col("text")).alias("context_id"))


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents")
def text_hash(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t-\r]+')) AS BIGINT) AS words FROM documents")
def word_count(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[^ \t-\r]+")).cast("long").alias("words"))


@query("SELECT doc_id, i AS chunk_index, i * 900 AS start_char, least(i * 900 + 1000, length(text)) AS end_char, sha256(substr(text, i * 900 + 1, 1000)) AS chunk_hash FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 100) / 900) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0)")
def chunk_window(spark, d):
    return tx.window_chunks(ad.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "start_char", "end_char", F.sha2("chunk", 256).alias("chunk_hash"))


@query()
def sentence_chunks(spark, d):
    return sg.sentences(ad.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "sentence_index", "start_char", "end_char", F.sha2("sentence", 256).alias("sentence_hash"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS distinct_n FROM documents")
def token_sets(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n"), F.size(F.array_distinct(tx.tokens(F.col("text")))).alias("distinct_n"))


@query(rf"SELECT ord, round(greatest(least((len(regexp_extract_all(text, '(?i)\b({lx.METRICS})\b')) + len(regexp_extract_all(text, '(?i)\b\d+(?:\.\d+)?(?:\s*(?:{lx.UNITS}))?'))) / (greatest(length(text), 1) / 100), 1), 0.01), 4) AS signal FROM {S}")
def signal_score(spark, d):
    return ad.view(spark, d, ad.SENTENCES).select("ord", tx.signal(F.col("text")).alias("signal"))


_ANCHOR = "CASE WHEN dataset IS NOT NULL THEN 'ctx_' || replace(lower(dataset), ' ', '_') END"


@query(f"SELECT source_id, page, ord, coalesce(d, CASE WHEN metric IS NOT NULL OR number IS NOT NULL THEN coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY source_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(d IGNORE NULLS) OVER (PARTITION BY source_id, page ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 'ctx_metric_' || replace(lower(metric), '-', '_'), 'ctx_unknown') AS context_id FROM (SELECT *, {_ANCHOR} AS d FROM {P})")
def ctx_propagate(spark, d):
    return tx.propagate_contexts(ad.view(spark, d, ad.PAGED)).select("source_id", "page", "ord", "context_id")


_PARA = f"SELECT *, sum(b) OVER (PARTITION BY source_id ORDER BY page, ord ROWS UNBOUNDED PRECEDING) AS paragraph FROM (SELECT *, coalesce(CAST(lag(blank_line) OVER w OR lag(page) OVER w <> page OR start_char - lag(end_char) OVER w > 200 AS INT), 0) AS b FROM {P} WINDOW w AS (PARTITION BY source_id ORDER BY page, ord))"


@query(f"SELECT source_id, page, ord, CAST(paragraph AS BIGINT) AS paragraph FROM ({_PARA})")
def paragraphs(spark, d):
    return tx.paragraphs(ad.view(spark, d, ad.PAGED)).select("source_id", "page", "ord", "paragraph")


@query(f"SELECT *, CASE WHEN datasets <> '' THEN 'explicit' WHEN metrics <> '' THEN 'inferred' ELSE 'none' END AS context_source FROM (SELECT source_id, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS chunks, false AS compares, min(metric) AS inferred_metric, coalesce(string_agg(DISTINCT dataset, ',' ORDER BY dataset), '') AS datasets, coalesce(string_agg(DISTINCT metric, ',' ORDER BY metric), '') AS metrics, min(dataset) AS inferred FROM ({_PARA}) GROUP BY source_id, paragraph)")
def paragraph_context(spark, d):
    return tx.paragraph_contexts(ad.view(spark, d, ad.PAGED))


#: What the cascade makes of the synthetic sentences, by the template that each was made from.
_Q = "cast(l_quantity AS int)"
_DATA = "CASE l_returnflag WHEN 'A' THEN 'GLUE' WHEN 'N' THEN 'SQuAD' ELSE 'ImageNet' END"
_EXPECTED = f"""SELECT ord, source_id, k, CASE k WHEN 0 THEN 'performance' WHEN 1 THEN 'efficiency' WHEN 2 THEN 'structural' WHEN 3 THEN 'performance' WHEN 6 THEN 'performance' WHEN 8 THEN 'efficiency' END AS claim_type,
 CASE k WHEN 0 THEN 'ctx_' || lower({_DATA}) WHEN 1 THEN 'ctx_efficiency' WHEN 2 THEN 'ctx_structural' WHEN 3 THEN 'ctx_metric_accuracy' WHEN 6 THEN 'ctx_wmt' WHEN 8 THEN 'ctx_cifar-10' END AS context_id,
 CASE k WHEN 0 THEN concat('Supplier ', l_suppkey) WHEN 1 THEN 'Training' WHEN 2 THEN concat('The model number ', l_partkey) WHEN 3 THEN 'The network may achieve' WHEN 6 THEN concat('BLEU score of ', {_Q}, ' was') WHEN 8 THEN concat('System ', l_suppkey) END AS subject,
 CASE k WHEN 0 THEN 'achieves' WHEN 1 THEN 'requires' WHEN 2 THEN 'introduces' WHEN 3 THEN 'scores' WHEN 6 THEN 'reported' WHEN 8 THEN 'runs' END AS predicate,
 CASE k WHEN 0 THEN concat(40 + {_Q}, '% accuracy on ', {_DATA}) WHEN 1 THEN concat({_Q}, ' hours on a single V100') WHEN 2 THEN 'a transformer-based architecture' WHEN 3 THEN concat({_Q}, '% accuracy on the dataset')
 WHEN 6 THEN concat('on WMT in ', 1990 + l_linenumber) WHEN 8 THEN concat('in ', {_Q}, ' ms latency and reaches ', 1 + {_Q}, ' fps on CIFAR-10') END AS object, CASE WHEN k IN (0, 1, 2, 3, 6, 8) THEN 'absolute' END AS claim_subtype,
 CASE k WHEN 4 THEN 'no_predicate' WHEN 5 THEN 'context_missing' WHEN 7 THEN 'context_missing' END AS reason, CASE k WHEN 0 THEN (40 + {_Q}) / 100.0 WHEN 3 THEN {_Q} / 100.0 WHEN 8 THEN {_Q} / 1000.0 END AS value
 FROM (SELECT *, l_orderkey % 9 AS k, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + cast(l_quantity AS bigint) AS ord, concat('src_', l_suppkey) AS source_id FROM lineitem)"""
_CLAIMS = f"SELECT *, CASE WHEN reason IS NULL THEN 'claim_' || sha256(concat_ws('|', context_id, subject, predicate, object)) END AS claim_id FROM ({_EXPECTED})"
_NORMAL = f"""SELECT ord, claim_id, context_id, subject, predicate, CASE k WHEN 0 THEN 'ACCURACY' WHEN 3 THEN 'ACCURACY' WHEN 8 THEN 'LATENCY' END AS metric, CAST(value AS DOUBLE) AS value, CASE k WHEN 0 THEN 'ratio' WHEN 3 THEN 'ratio' WHEN 8 THEN 's' END AS unit,
 CASE k WHEN 0 THEN concat(regexp_extract(object, '^[0-9]+'), '%') WHEN 3 THEN concat(regexp_extract(object, '^[0-9]+'), '%') WHEN 8 THEN concat(regexp_extract(object, '^in ([0-9]+)', 1), 'ms') END AS value_raw,
 CASE WHEN k NOT IN (0, 3, 8) THEN 'missing_metric' END AS reason_none, CASE WHEN k IN (0, 3, 8) THEN 'adjacent' END AS how, 'supports' AS polarity, claim_subtype AS subtype FROM ({_CLAIMS}) WHERE reason IS NULL"""
_VALUED = f"(SELECT * FROM ({_NORMAL}) WHERE reason_none IS NULL)"


@query(f"SELECT ord, source_id, 0 AS claim_index, claim_type, context_id, subject, predicate, object, claim_subtype, claim_id, reason FROM ({_CLAIMS})")
def claim_extract(spark, d):
    return cl.extract_claims(ad.view(spark, d, ad.SENTENCES)).drop("text")


@query(f"SELECT reason, count(*) AS n FROM ({_EXPECTED}) GROUP BY reason")
def claim_reasons(spark, d):
    return cl.extract_claims(ad.view(spark, d, ad.SENTENCES)).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT ord, claim_id, metric, value, unit, value_raw, reason_none, how FROM ({_NORMAL})")
def normalize(spark, d):
    claims = cl.extract_claims(ad.view(spark, d, ad.SENTENCES)).where("reason is null")
    return nz.normalize_claims(claims).select("ord", "claim_id", "metric", "value", "unit", "value_raw", "reason_none", "how")


@query(f"SELECT reason_none, how, count(*) AS n FROM ({_NORMAL}) GROUP BY ALL")
def normalize_diagnostics(spark, d):
    return nz.diagnostics(normalize(spark, d))


@query(f"SELECT ord, CASE k WHEN 0 THEN CASE WHEN l.l_returnflag = 'A' THEN 'ACCURACY,GLUE_SCORE' ELSE 'ACCURACY' END WHEN 3 THEN 'ACCURACY' WHEN 4 THEN 'LATENCY' WHEN 6 THEN 'BLEU' WHEN 8 THEN 'LATENCY,FPS' ELSE '' END AS metrics, CASE k WHEN 0 THEN CASE WHEN l.l_returnflag = 'A' THEN NULL ELSE 'ACCURACY' END WHEN 3 THEN 'ACCURACY' WHEN 4 THEN 'LATENCY' WHEN 6 THEN 'BLEU' END AS resolved FROM (SELECT l_returnflag, l_orderkey % 9 AS k, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + cast(l_quantity AS bigint) AS ord FROM lineitem) l")
def metric_ontology(spark, d):
    return nz.resolve_metrics(ad.view(spark, d, ad.SENTENCES)).select("ord", F.array_join("metrics", ",").alias("metrics"), "resolved")


def _contra_sql(n: str) -> str:
    return _CONTRA.replace(N, n)


@query(_beliefs_sql(_VALUED, _contra_sql(_VALUED), _BOOST.replace(N, _VALUED)))
def text_beliefs(spark, d):
    return flagship.beliefs_of_texts(ad.view(spark, d, ad.SENTENCES))


@query(rf"SELECT ord, regexp_matches(text, '(?i)\b(?:{lx.DELTA})') AS is_delta, (({' OR '.join(f'contains(lower(text), {h!r})' for h in lx.HEDGES)}) AND NOT (regexp_matches(text, '\d') AND regexp_matches(text, '(?i)\b({lx.CLAIM_METRICS})\b'))) AS hedged FROM {S}")
def claim_filters(spark, d):
    return ad.view(spark, d, ad.SENTENCES).select("ord", tx.is_delta(F.col("text")).alias("is_delta"), tx.hedged(F.col("text")).alias("hedged"))


_WEAK = f"""CASE WHEN regexp_matches(lower(text), '{lx.WEAK_HEDGE}') THEN 'HEDGED_STATEMENT' WHEN {' OR '.join(f"regexp_matches(lower(text), '{p}')" for p in lx.WEAK_COMPOUND)} THEN 'COMPOUND_METRIC'
 WHEN NOT ({' OR '.join(f"regexp_matches(lower(text), '{p}')" for p in lx.WEAK_DELTA)}) THEN 'NOT_QUANTITATIVE_DELTA' WHEN NOT (regexp_matches(lower(text), '\\bp\\s*[<>=]') OR contains(lower(text), 'p-value') OR regexp_matches(lower(text), '{lx.WEAK_PROPERTY}')) THEN 'NO_MEASURABLE_PROPERTY' END"""


@query(rf"SELECT ord, {_WEAK} AS verdict, list_max(list_transform(regexp_extract_all(text, '(\d+\.?\d*)', 1), lambda x: CAST(x AS DOUBLE))) AS largest FROM {S}")
def weak_claims(spark, d):
    return ad.view(spark, d, ad.SENTENCES).select("ord", tx.weak_verdict(F.col("text")).alias("verdict"), tx.largest_number(F.col("text")).alias("largest"))


@query(rf"SELECT ord, MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in lx.METRIC_ALIASES.items())}}}[regexp_replace(lower(regexp_extract(text, '(?i)\b({lx.NORMAL_METRICS})\b', 1)), '[^a-z0-9]+', '', 'g')] AS metric FROM {S}")
def canonical_metric(spark, d):
    return ad.view(spark, d, ad.SENTENCES).select("ord", tx.canonical_metric(F.col("text")).alias("metric"))


_UNIT = "CASE l_linenumber WHEN 1 THEN '%' WHEN 2 THEN 'ms' WHEN 3 THEN 'sec' WHEN 4 THEN 'mb' WHEN 5 THEN 'kb' WHEN 6 THEN 'GB' END"


@query(f"SELECT l_orderkey, l_linenumber, CASE u WHEN '%' THEN v / 100.0 WHEN 'ms' THEN v / 1000.0 WHEN 'mb' THEN v / 1024.0 WHEN 'kb' THEN v / 1048576.0 ELSE v END AS value, CASE u WHEN '%' THEN 'ratio' WHEN 'ms' THEN 's' WHEN 'sec' THEN 's' WHEN 'mb' THEN 'gb' WHEN 'kb' THEN 'gb' WHEN 'GB' THEN 'gb' END AS unit FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS v, {_UNIT} AS u FROM lineitem)")
def unit_convert(spark, d):
    v, u = tx.converted(F.col("l_quantity").cast("double"), F.expr(_UNIT))
    return ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("value"), u.alias("unit"))


_QUERY = "the license version of data"


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) SELECT doc_id, round(s / 5.0, 6) AS score FROM (SELECT doc_id, " + " + ".join(f"CAST(list_contains(w, '{w}') AS INT)" for w in _QUERY.split()) + " AS s FROM t) WHERE s > 0 ORDER BY score DESC, doc_id LIMIT 50")
def rag_lexical_topk(spark, d):
    return rt.lexical_topk(ad.table(spark, d, "documents"), _QUERY, 50)


_VECTOR = [round(0.1 * ((i * 7) % 11 - 5), 1) for i in range(64)]
_COS = f"round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_VECTOR}::DOUBLE[]), 6)"


@query(f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return rt.vector_topk(ad.table(spark, d, "embeddings"), _VECTOR, 10).select("vec_id", "score")


@query(f"SELECT vec_id, {_COS} AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    return rt.vector_topk(ad.table(spark, d, "embeddings"), _VECTOR, 10, F.col("label") == 3).select("vec_id", "score")


@query(f"SELECT vec_id, score FROM (SELECT vec_id, label, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10) WHERE label = 3")
def vector_topk_post_filtered(spark, d):
    return rt.vector_topk(ad.table(spark, d, "embeddings"), _VECTOR, 10, F.col("label") == 3, post_filter=True).select("vec_id", "score")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL),
 d AS (SELECT label, vec_id, round(sqrt(sum((v - m) * (v - m))), 6) AS distance FROM x JOIN c USING (label, i) GROUP BY label, vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY distance DESC, vec_id) AS b FROM d)
 SELECT label, vec_id, distance, CASE WHEN a <= 3 THEN 'representative' ELSE 'boundary' END AS role FROM r WHERE a <= 3 OR b <= 2""")
def cluster_profile(spark, d):
    return rt.cluster_profiles(ad.table(spark, d, "embeddings"))


@query("""WITH a AS (SELECT label AS g, vec_id % 7 + label // 3 AS p FROM embeddings), c AS (SELECT p, g, count(*) AS n FROM a GROUP BY ALL), r AS (SELECT p, sum(n) AS r, max(n) AS top FROM c GROUP BY p), s AS (SELECT g, sum(n) AS s FROM c GROUP BY g), t AS (SELECT sum(n) AS t FROM c)
 SELECT CAST((SELECT t FROM t) AS BIGINT) AS n, round((SELECT sum(top) FROM r) / (SELECT t FROM t), 6) AS purity, round((SELECT sum(n / t * ln(n * t / (r * s) + 1e-10)) FROM c JOIN r USING (p) JOIN s USING (g), t) / (((SELECT -sum(r / t * ln(r / t + 1e-10)) FROM r, t) + (SELECT -sum(s / t * ln(s / t + 1e-10)) FROM s, t)) / 2), 6) AS nmi""")
def cluster_purity_nmi(spark, d):
    e = ad.table(spark, d, "embeddings").select(F.col("label").alias("g"), (F.col("vec_id") % 7 + F.floor(F.col("label") / 3)).alias("p"))
    return rt.purity_nmi(e, "p", "g")


@query("WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w WHERE term NOT IN ('the', 'and', 'that') GROUP BY ALL) SELECT lang, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 5")
def cluster_label(spark, d):
    return rt.frequent_terms(ad.table(spark, d, "documents"), "lang", "text", stopwords=("the", "and", "that"))


@query("WITH p AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 45), g AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.09), h AS (SELECT count(*) AS hit FROM p SEMI JOIN g USING (k)), v AS (SELECT hit / (SELECT count(*) FROM p) AS a, hit / (SELECT count(*) FROM g) AS b FROM h) SELECT round(a, 6) AS precision, round(b, 6) AS recall, round(2 * a * b / (a + b), 6) AS f1 FROM v")
def claim_prf_exact(spark, d):
    li = ad.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity", "l_discount")
    return rt.precision_recall(li.where("l_quantity > 45"), li.where("l_discount > 0.09"), "k")


@query(rf"SELECT ord, lower(m[1]) AS name, CAST(replace(m[2], '%', '') AS DOUBLE) AS value, ends_with(m[2], '%') AS percent FROM (SELECT DISTINCT ord, [x, y] AS m FROM (SELECT ord, unnest(regexp_extract_all(t, '(?i)\b({lx.ARTIFACT_METRICS})\b\s*(?:=|:|of|is)\s*(\d+\.?\d*%?)', 1)) AS x, unnest(regexp_extract_all(t, '(?i)\b({lx.ARTIFACT_METRICS})\b\s*(?:=|:|of|is)\s*(\d+\.?\d*%?)', 2)) AS y FROM (SELECT ord, concat(text, ' accuracy = ', ord % 100, '% and BLEU: 3.5; BLEU: 3.5') AS t FROM {S})))")
def metric_artifacts(spark, d):
    return tx.metric_artifacts(ad.view(spark, d, ad.SENTENCES).select("ord", F.concat("text", F.lit(" accuracy = "), F.col("ord") % 100, F.lit("% and BLEU: 3.5; BLEU: 3.5")).alias("text")), "ord")


@query("""WITH l AS (SELECT doc_id, i AS line, x AS raw, regexp_full_match(x, '.+[|\\t].+[|\\t].+') AS row FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
 r AS (SELECT *, line - sum(CAST(row AS INT)) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT doc_id, min(line) AS first_line, count(*) AS row_count, arg_min(len(list_filter(list_transform(regexp_split_to_array(raw, '[|\\t]'), lambda x: trim(x)), lambda x: x <> '')), line) AS headers FROM r WHERE row GROUP BY doc_id, run HAVING count(*) >= 2""")
def text_tables(spark, d):
    return tx.text_tables(ad.table(spark, d, "documents").select("doc_id", "text"), "doc_id").drop("cells")


@query("SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<p[ >]')) AS INT) AS paragraphs, CAST(len(regexp_extract_all(html, '(?i)<li[ >]')) AS INT) AS items FROM pages")
def html_outline(spark, d):
    return ad.table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("title"), F.regexp_count("html", F.lit("(?i)<p[ >]")).alias("paragraphs"), F.regexp_count("html", F.lit("(?i)<li[ >]")).alias("items"))
