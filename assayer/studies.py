"""More queries with their SQL: contexts, stores, pages, identifiers, validators, audits, artifacts, retrieval, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _CONTRA, N, P, query
from .functions import lexicon as lx
from .operators import audit as au
from .operators import claims as cl
from .operators import contexts as cx
from .operators import relations as rel
from .operators import render as rd
from .operators import retrieval as rt
from .operators import segment as sg
from .operators import text as tx
from .operators import validate as va
from .plans.tools import REGISTRY
from .sources import adapters as ad
from .sources import html, pages, stores
from .sources import identifiers as ids
from .streaming import ingest

S = f"({ad.SENTENCES})"


# contexts


def _case(entries: dict[str, str], value: str, other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in entries.items()) + f" ELSE {other} END"


@query(f"""WITH c AS (SELECT *, 'ctx_' || replace(lower(dataset), ' ', '_') AS context_id, coalesce(lower(trim(metric)), 'unknown') AS m FROM {P} WHERE dataset IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY source_id, ord, page, m, dataset) AS n, count(*) OVER (PARTITION BY context_id) AS chunks FROM c)
 SELECT context_id, dataset, {_case(lx.DATASET_TASKS, 'lower(dataset)', "'other'")} AS task, m AS metric, m NOT IN ({', '.join(f"'{m}'" for m in lx.LESS_IS_BETTER)}) AS higher_is_better, chunks FROM r WHERE n = 1""")
def context_discovery(spark, d):
    return cx.discover(ad.view(spark, d, ad.PAGED))


_RESOLVED = f"SELECT coalesce(d, CASE WHEN metric IS NOT NULL OR number IS NOT NULL THEN coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY source_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(d IGNORE NULLS) OVER (PARTITION BY source_id, page ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 'ctx_metric_' || replace(lower(metric), '-', '_'), 'ctx_unknown') AS context_id FROM (SELECT *, 'ctx_' || replace(lower(dataset), ' ', '_') AS d FROM {P})"


@query(f"SELECT context_id, count(x) AS chunks, context_id <> 'ctx_unknown' AS known FROM (SELECT context_id, 1 AS x FROM ({_RESOLVED}) UNION ALL SELECT 'ctx_unknown', NULL) GROUP BY context_id")
def context_registry(spark, d):
    return cx.registry(tx.propagate_contexts(ad.view(spark, d, ad.PAGED)))


def _contexts(spark, d):
    return ad.view(spark, d, ad.CONTEXTS).select("context_id", "task", "dataset", "dataset_version", F.struct(F.col("metric_name").alias("name"), F.col("metric_unit").alias("unit"), F.col("higher").alias("higher_is_better"), F.col("aggregation").alias("aggregation_method")).alias("metric"))


_COMPARABLE = """a.task = b.task AND lower(a.dataset) = lower(b.dataset) AND lower(trim(a.metric_name)) = lower(trim(b.metric_name)) AND a.metric_unit IS NOT DISTINCT FROM b.metric_unit AND a.higher = b.higher AND a.aggregation IS NOT DISTINCT FROM b.aggregation
 AND (coalesce(a.dataset_version, '') = '' OR coalesce(b.dataset_version, '') = '' OR lower(a.dataset_version) = lower(b.dataset_version))"""


@query(f"SELECT a.context_id AS context_a, b.context_id AS context_b FROM ({ad.CONTEXTS}) a JOIN ({ad.CONTEXTS}) b ON a.context_id < b.context_id AND {_COMPARABLE}")
def context_comparable(spark, d):
    return cx.comparable_pairs(_contexts(spark, d))


@query(f"SELECT concat_ws(':', task, lower(dataset), CASE WHEN coalesce(dataset_version, '') = '' THEN 'default' ELSE lower(dataset_version) END, lower(trim(metric_name)), CASE WHEN coalesce(metric_unit, '') = '' THEN 'dimensionless' ELSE metric_unit END) AS identity, count(*) AS contexts, min(context_id) AS first FROM ({ad.CONTEXTS}) GROUP BY 1")
def context_classes(spark, d):
    return cx.equivalence_classes(_contexts(spark, d))


_PAGED_TEXT = f"""SELECT *, concat('chunk_', cast(source_id AS varchar(20)), '_', cast(ord AS varchar(20))) AS chunk_id, 'ctx_unknown' AS context_id, CASE WHEN ord % 3 = 0 THEN concat('Latency improved by ', cast(ord % 90 + 1 AS varchar(5)), '% over the baseline.') WHEN ord % 3 = 1 THEN 'Accuracy may increase.' ELSE 'We ran experiments on various datasets.' END AS text FROM {P}"""
_STITCHED = f"""SELECT *, min(dataset) OVER w AS inferred, min(metric) OVER w AS inferred_metric, bool_or(regexp_matches(text, '(?i){lx.COMPARISONS}')) OVER w AS paragraph_compares FROM (SELECT *, sum(b) OVER (PARTITION BY source_id ORDER BY page, ord ROWS UNBOUNDED PRECEDING) AS paragraph FROM
 (SELECT *, coalesce(CAST(lag(blank_line) OVER v OR lag(page) OVER v <> page OR start_char - lag(end_char) OVER v > 200 AS INT), 0) AS b FROM ({_PAGED_TEXT}) WINDOW v AS (PARTITION BY source_id ORDER BY page, ord))) WINDOW w AS (PARTITION BY source_id, paragraph)"""


def _stitched(spark, d):
    chunks = ad.view(spark, d, _PAGED_TEXT)
    return tx.stitched(chunks.withColumn("compares", tx.compares(F.col("text"))))


@query(f"SELECT chunk_id, CAST(paragraph AS BIGINT) AS paragraph, inferred, inferred_metric, paragraph_compares, CASE WHEN dataset IS NOT NULL OR metric IS NOT NULL THEN 'explicit' WHEN inferred IS NOT NULL OR inferred_metric IS NOT NULL THEN 'inferred' ELSE 'none' END AS context_source FROM ({_STITCHED})")
def context_stitching(spark, d):
    return _stitched(spark, d).select("chunk_id", "paragraph", "inferred", "inferred_metric", "paragraph_compares", "context_source")


@query(f"SELECT 'weak_' || chunk_id AS claim_id, chunk_id, context_id, 'quantitative property' || coalesce(' on ' || inferred, '') AS subject, 'changed' AS predicate, concat(CAST(CAST(ord % 90 + 1 AS DOUBLE) AS VARCHAR), '%') AS object, 'delta' AS claim_subtype, 'weak' AS tier, coalesce(metric, inferred_metric) AS metric_explicit FROM ({_STITCHED}) WHERE ord % 3 = 0")
def claim_weak(spark, d):
    metric_names = F.when(F.col("metric").isNotNull(), F.array("metric")).otherwise(F.array().cast("array<string>"))
    return cl.weak_claims(_stitched(spark, d).withColumn("metric_names", metric_names))


# relations


@query(f"SELECT context_id, metric, claim_id, lower(subject) AS subject FROM {N} JOIN (SELECT context_id AS c, metric AS m FROM {N} WHERE subtype = 'absolute' GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT lower(subject)) >= 2) ON context_id = c AND metric = m WHERE subtype = 'absolute'")
def variance_members(spark, d):
    claims = ad.view(spark, d, ad.NCLAIMS)
    return rel.members(rel.performance_variance(claims), claims, "subtype = 'absolute'")


@query(f"SELECT context_id, metric, claim_id, lower(subject) AS subject FROM {N} JOIN (SELECT context_id AS c, metric AS m FROM {N} GROUP BY ALL HAVING count(*) >= 2) ON context_id = c AND metric = m")
def consensus_members(spark, d):
    claims = ad.view(spark, d, ad.NCLAIMS)
    return rel.members(rel.consensus(claims), claims)


_CLASSES = "SELECT {keys}, count(*) AS contexts, CAST(sum(n) AS BIGINT) AS claims, CAST((sum(n) * sum(n) - sum(n * n)) // 2 AS BIGINT) AS links FROM (SELECT {each}, context_id, count(*) AS n FROM {source} {where} GROUP BY ALL) GROUP BY {keys} HAVING count(*) >= 2"


@query(_CLASSES.format(keys="subject, metric", each="lower(subject) AS subject, metric", source=N, where="WHERE subtype = 'absolute'"))
def divergence_classes(spark, d):
    return rel.divergence_classes(ad.view(spark, d, ad.NCLAIMS))


@query(_CLASSES.format(keys="subject, predicate, metric", each="lower(subject) AS subject, lower(predicate) AS predicate, metric", source=N, where=""))
def legacy_divergence_classes(spark, d):
    return rel.divergence_classes(ad.view(spark, d, ad.NCLAIMS), {"subject": F.lower("subject"), "predicate": F.lower("predicate"), "metric": F.col("metric")}, None)


@query(f"SELECT context_id, metric, count(*) AS n FROM ({_CONTRA}) GROUP BY ALL")
def group_contradictions(spark, d):
    claims = ad.view(spark, d, ad.NCLAIMS)
    return rel.group_contradictions(rel.contradictions(claims), claims)


@query(f"""SELECT context_id, metric, sha256('{{"context_id":"' || context_id || '","metric":"' || metric || '"}}') AS proposition_id FROM (SELECT DISTINCT context_id, metric FROM {N})""")
def proposition_ids(spark, d):
    return rel.proposition_ids(ad.view(spark, d, ad.NCLAIMS).select("context_id", "metric").distinct())


_IN_CONTEXT = f"SELECT ord, claim_id, concat('ctx_c', cast(ord % 200 AS varchar(5))) AS context_id, subject, predicate, polarity, CASE ord % 3 WHEN 0 THEN NULL WHEN 1 THEN 'GLUE' ELSE 'glue' END AS dataset, CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN 'text' END AS domain FROM {N}"
_OPPOSED = "least(s.ord, r.ord) AS o, s.ord AS so, s.claim_id AS sc, r.claim_id AS rc"


@query(f"SELECT CASE WHEN so = o THEN sc ELSE rc END AS claim_a, CASE WHEN so = o THEN rc ELSE sc END AS claim_b FROM (SELECT {_OPPOSED} FROM ({_IN_CONTEXT}) s JOIN ({_IN_CONTEXT}) r ON s.polarity = 'supports' AND r.polarity = 'refutes' AND lower(s.subject) = lower(r.subject) AND lower(s.predicate) = lower(r.predicate) JOIN ({ad.CONTEXTS}) a ON a.context_id = s.context_id JOIN ({ad.CONTEXTS}) b ON b.context_id = r.context_id WHERE {_COMPARABLE})")
def comparable_contradictions(spark, d):
    return rel.comparable_contradictions(ad.view(spark, d, _IN_CONTEXT), _contexts(spark, d))


@query(f"""SELECT CASE WHEN so = o THEN sc ELSE rc END AS claim_a, CASE WHEN so = o THEN rc ELSE sc END AS claim_b FROM (SELECT {_OPPOSED} FROM ({_IN_CONTEXT}) s JOIN ({_IN_CONTEXT}) r ON s.polarity = 'supports' AND r.polarity = 'refutes' AND lower(s.subject) = lower(r.subject) AND lower(s.predicate) = lower(r.predicate)
 WHERE CASE WHEN s.dataset IS NOT NULL AND r.dataset IS NOT NULL THEN lower(s.dataset) = lower(r.dataset) WHEN s.dataset IS NOT NULL OR r.dataset IS NOT NULL THEN false ELSE coalesce(s.domain, '') = coalesce(r.domain, '') END)""")
def condition_contradictions(spark, d):
    return rel.conditions_overlap(ad.view(spark, d, _IN_CONTEXT))


_RATIOS = {"claim_extraction_yield": ("extracted_claims", "expected_claims"), "normalization_precision": ("truly_equivalent_collapses", "collapsed_claim_pairs"), "contradiction_recall": ("contradictions_found", "known_contradictions"), "hypothesis_grounding_rate": ("hypotheses_grounded", "hypotheses_generated"), "proposal_completeness": ("proposals_complete", "proposals_generated")}


@query("SELECT " + ", ".join(f"CASE WHEN sum({b}) > 0 THEN sum({a}) / sum({b}) ELSE 0.0 END AS {n}" for n, (a, b) in _RATIOS.items()) + f" FROM ({ad.EVALUATED})")
def evaluation_ratios(spark, d):
    return rel.ratios(ad.view(spark, d, ad.EVALUATED))


# stores


_OLD = "SELECT c_custkey AS paper_id, c_name AS title, c_mktsegment AS venue, 1 AS version FROM customer"
_NEW = "SELECT o_custkey AS paper_id, concat('order ', cast(o_orderkey AS varchar(20))) AS title, o_orderstatus AS venue, o_orderkey AS version FROM orders"


@query(f"SELECT paper_id, title, venue, version FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY fresh DESC, version DESC) AS n FROM (SELECT *, 0 AS fresh FROM ({_OLD}) UNION ALL SELECT *, 1 FROM ({_NEW}))) WHERE n = 1")
def store_upsert(spark, d):
    return stores.upsert(ad.view(spark, d, _OLD), ad.view(spark, d, _NEW), ["paper_id"], "version")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def store_delete(spark, d):
    e = ad.table(spark, d, "embeddings").select("vec_id", "label")
    return stores.delete(e, ad.table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), ["vec_id"])


@query("SELECT paper_id, CASE WHEN trim(title) <> '' THEN title ELSE coalesce(t1, t2) END AS title, CASE WHEN trim(venue) <> '' THEN venue ELSE coalesce(v1, v2) END AS venue FROM (SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE ' ' END AS title, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS venue FROM customer) LEFT JOIN (SELECT o_custkey AS paper_id, max(o_orderpriority) AS t1, max(CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END) AS v1 FROM orders GROUP BY 1) USING (paper_id) LEFT JOIN (SELECT c_custkey AS paper_id, 'untitled' AS t2, 'unknown' AS v2 FROM customer) USING (paper_id)")
def metadata_merge(spark, d):
    papers = ad.view(spark, d, "SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE ' ' END AS title, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS venue FROM customer")
    first = ad.view(spark, d, "SELECT o_custkey AS paper_id, o_orderpriority AS title, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END AS venue FROM orders")
    second = ad.view(spark, d, "SELECT c_custkey AS paper_id, 'untitled' AS title, 'unknown' AS venue FROM customer")
    return stores.merge_metadata(papers, [first, second], ["title", "venue"])


@query("WITH h AS (SELECT doc_id AS paper_id, text FROM documents WHERE lang = 'en' AND length(trim(text)) > 2000), p AS (SELECT doc_id AS paper_id, text FROM documents ANTI JOIN h ON doc_id = paper_id) SELECT paper_id, via, sha256(text) AS digest FROM (SELECT *, 'html' AS via FROM h UNION ALL SELECT *, 'pdf' FROM p)")
def html_or_pdf(spark, d):
    docs = ad.table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "text", "lang")
    return stores.html_or_pdf(docs.where("lang = 'en'").drop("lang"), docs.drop("lang")).select("paper_id", "via", F.sha2("text", 256).alias("digest"))


# identifiers and pages


@query(rf"""SELECT o_orderkey, kind, identifier, html_url, pdf_url, landing_url FROM (SELECT o_orderkey, k, CASE k WHEN 0 THEN 'arxiv' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'pmc' WHEN 3 THEN 'acl' WHEN 4 THEN 'doi' WHEN 5 THEN 'doi' WHEN 6 THEN 'url' WHEN 7 THEN 'url' WHEN 8 THEN 'url' ELSE 'unknown' END AS kind, x AS identifier,
 CASE k WHEN 0 THEN 'https://arxiv.org/html/' || x WHEN 1 THEN 'https://arxiv.org/html/' || replace(x, 'v2', '') WHEN 2 THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || x || '/' WHEN 3 THEN 'https://aclanthology.org/' || x || '/' WHEN 4 THEN 'https://doi.org/' || x WHEN 5 THEN 'https://doi.org/' || x WHEN 6 THEN x WHEN 7 THEN x WHEN 8 THEN x END AS html_url,
 CASE k WHEN 0 THEN 'https://arxiv.org/pdf/' || x WHEN 1 THEN 'https://arxiv.org/pdf/' || x WHEN 2 THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || x || '/pdf/' WHEN 3 THEN 'https://aclanthology.org/' || x || '.pdf' WHEN 6 THEN x || '.full.pdf' WHEN 7 THEN 'https://proceedings.mlr.press/v9/p' || o_orderkey || '/p' || o_orderkey || '.pdf' WHEN 8 THEN 'https://openreview.net/pdf?id=q' || o_orderkey END AS pdf_url,
 CASE k WHEN 0 THEN 'https://arxiv.org/abs/' || x WHEN 1 THEN 'https://arxiv.org/abs/' || x WHEN 2 THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || x || '/' WHEN 3 THEN 'https://aclanthology.org/' || x || '/' WHEN 4 THEN 'https://doi.org/' || x WHEN 5 THEN 'https://doi.org/' || x WHEN 6 THEN x WHEN 7 THEN x WHEN 8 THEN x END AS landing_url
 FROM (SELECT o_orderkey, o_orderkey % 10 AS k, CASE o_orderkey % 10 WHEN 0 THEN '1706.' || lpad(cast(o_orderkey % 100000 AS varchar), 5, '0') WHEN 1 THEN '2302.' || lpad(cast(o_orderkey % 100000 AS varchar), 5, '0') || 'v2' WHEN 2 THEN 'PMC' || (1000000 + o_orderkey) WHEN 3 THEN '2023.acl-long.' || o_orderkey WHEN 4 THEN '10.1234/abc' || o_orderkey WHEN 5 THEN '10.1000/x' || o_orderkey
 WHEN 6 THEN 'https://www.biorxiv.org/content/10.1101/' || o_orderkey WHEN 7 THEN 'https://proceedings.mlr.press/v9/p' || o_orderkey || '.html' WHEN 8 THEN 'https://openreview.net/forum?id=q' || o_orderkey ELSE 'plain words ' || o_orderkey END AS x FROM orders))""")
def resolve_id(spark, d):
    return ad.view(spark, d, ad.IDENTIFIERS).select("o_orderkey", ids.resolve(F.col("identifier")).alias("r")).select("o_orderkey", "r.kind", "r.identifier", "r.html_url", "r.pdf_url", "r.landing_url")


@query("SELECT page_id, CASE WHEN length(s) > 80 THEN substr(s, 1, 60) || '_' || substr(sha256(url), 1, 16) ELSE s END AS safe, CASE WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(url), 'pmc.ncbi.nlm.nih.gov') THEN 'pmc' WHEN contains(lower(url), 'aclanthology.org') THEN 'acl' ELSE 'generic' END AS layout FROM (SELECT *, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS s FROM pages)")
def page_layout(spark, d):
    return ad.table(spark, d, "pages").select("page_id", ids.safe_id(F.col("url")).alias("safe"), ids.layout(F.col("url")).alias("layout"))


@query()
def html_parse(spark, d):
    parsed = html.parse_pages(ad.table(spark, d, "pages"), layout=ids.layout(F.col("url")))
    return parsed.select("page_id", "title", F.size("sections").alias("sections"), F.size("references").alias("references"), F.size("tables").alias("tables"), F.size("figures").alias("figures"), F.sha2("raw_text", 256).alias("text_digest"), F.sha2("markdown", 256).alias("markdown_digest"))


_PDFISH = "SELECT o_orderkey, concat('Deep  learn-', chr(10), '  ing for ﬁnite', chr(9), 'sets', chr(10), chr(10), chr(10), chr(10), cast(o_orderkey AS varchar(20)), ' end ') AS text FROM orders"


@query(f"SELECT o_orderkey, concat('Deep learn-', chr(10), 'ing for finite sets', chr(10), chr(10), cast(o_orderkey AS varchar), ' end') AS cleaned, concat('Deep  learning for ﬁnite', chr(9), 'sets', chr(10), chr(10), chr(10), chr(10), cast(o_orderkey AS varchar), ' end ') AS joined FROM ({_PDFISH})")
def page_cleaning(spark, d):
    t = F.col("text")
    return ad.view(spark, d, _PDFISH).select("o_orderkey", pages.clean(t).alias("cleaned"), pages.dehyphenated(t).alias("joined"))


@query("SELECT concat('src_', cast(c_nationkey AS varchar)) AS source_id, c_custkey % 5 AS page, 'pdf_table_' || c_custkey % 5 || '_' || (row_number() OVER (PARTITION BY c_nationkey, c_custkey % 5 ORDER BY c_custkey) - 1) AS table_id, 'Name | Segment' || chr(10) || c_name || ' | ' || c_mktsegment AS text FROM customer")
def page_tables(spark, d):
    t = ad.table(spark, d, "customer").select(F.concat(F.lit("src_"), F.col("c_nationkey").cast("string")).alias("source_id"), (F.col("c_custkey") % 5).alias("page"), F.col("c_custkey").alias("ord"), F.array(F.array(F.lit(" Name"), F.lit("Segment ")), F.array("c_name", "c_mktsegment")).alias("rows"))
    return pages.table_text(t).select("source_id", "page", "table_id", "text")


@query()
def page_chunks(spark, d):
    p = ad.table(spark, d, "documents").select(F.concat(F.lit("src_"), (F.col("doc_id") % 50).cast("string")).alias("source_id"), F.col("doc_id").alias("page"), "text")
    return pages.paged_chunks(p).select("source_id", "page", "chunk_id", "start_char", "end_char", F.sha2("text", 256).alias("digest"))


@query()
def block_sentences(spark, d):
    return sg.blocks(ad.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "sentence_index", F.sha2("sentence", 256).alias("digest"))


_SCAN = rf"regexp_extract_all({{}}, '(?i)\b\d+(?:\.\d+)?(?:\s*(?:{lx.UNITS}))?')"


@query(f"SELECT source_id, CAST(1 AS BIGINT) AS chunks, ctx AS context_ids, array_to_string({_SCAN.format('text')}, '|') AS numbers, 'shorter than a chunk' AS warnings FROM (SELECT ord AS source_id, text, coalesce('ctx_' || lower(nullif(regexp_extract(text, '(?i)\\b({lx.DATASETS})\\b', 1), '')), 'ctx_metric_' || replace(lower(nullif(regexp_extract(text, '(?i)\\b({lx.METRICS})\\b', 1), '')), '-', '_'), 'ctx_unknown') AS ctx FROM {S})")
def ingest_telemetry(spark, d):
    out = tx.telemetry(ad.view(spark, d, ad.SENTENCES), "ord")
    return out.select("source_id", "chunks", F.array_join("context_ids", ",").alias("context_ids"), F.array_join("numeric_strings", "|").alias("numbers"), F.array_join("warnings", ",").alias("warnings"))


@query("SELECT doc_id AS source_id, doc_id || '_chunk_' || i AS chunk_id, sha256(substr(text, i * 900 + 1, 1000)) AS text_hash FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 100) / 900) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0)")
def ingest_chunks(spark, d):
    return tx.ingested(ad.table(spark, d, "documents"), "doc_id").select("source_id", "chunk_id", "text_hash")


@query(f"SELECT ord, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS spaced, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS key, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[-_]', ' ', 'g'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM {S}")
def text_normalizers(spark, d):
    t = F.col("text")
    return ad.view(spark, d, ad.SENTENCES).select("ord", tx.spaced(t).alias("spaced"), tx.metric_key(t).alias("key"), tx.plain(t).alias("plain"))


# artifacts


_CAPTIONED = "SELECT o_orderkey AS chunk_id, cast(o_custkey AS varchar(20)) AS paper_id, o_orderkey % 3 + 1 AS page, concat('Table ', cast(o_orderkey % 9 + 1 AS varchar(5)), ': Results of run ', cast(o_orderkey AS varchar(20)), chr(10), 'FIG. 2. Curve ') AS text FROM orders"
_CAPTIONS = f"SELECT chunk_id, paper_id, page, p AS position, CASE p WHEN 0 THEN 'table' ELSE 'figure' END AS kind, CASE p WHEN 0 THEN CAST(chunk_id % 9 + 1 AS INT) ELSE 2 END AS number, CASE p WHEN 0 THEN concat('Results of run ', chunk_id) ELSE 'Curve' END AS caption FROM ({_CAPTIONED}), (VALUES (0), (1)) v(p)"


def _captions(spark, d):
    chunks = ad.view(spark, d, _CAPTIONED)
    return tx.captions(chunks, "chunk_id").join(chunks.select("chunk_id", "paper_id", "page"), "chunk_id")


@query(f"SELECT chunk_id, position, kind, number, caption FROM ({_CAPTIONS})")
def captions(spark, d):
    return _captions(spark, d).select("chunk_id", "position", "kind", "number", "caption")


@query(f"SELECT chunk_id, position, i AS index, 'extract_' || substr(sha256(concat_ws(':', paper_id, page, 'caption', i)), 1, 12) AS result_id, 'c1,c2,c3' AS links FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id, position) - 1 AS i FROM ({_CAPTIONS}) WHERE page = 2)")
def artifact_ids(spark, d):
    out = tx.with_result_ids(_captions(spark, d), "caption", ["chunk_id", "position"], 2, ["c1", "c2", "c3", "c4"])
    return out.select("chunk_id", "position", "index", "result_id", F.array_join("linked_claims", ",").alias("links"))


# retrieval and clusters


_QUERY = "the license version of data"


@query("WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents WHERE lang = 'en') SELECT doc_id, round(s / 5.0, 6) AS score, 'lexical' AS method FROM (SELECT doc_id, " + " + ".join(f"CAST(list_contains(w, '{w}') AS INT)" for w in _QUERY.split()) + " AS s FROM t) WHERE s > 0 ORDER BY score DESC, doc_id LIMIT 50")
def rag_by_source(spark, d):
    return rt.retrieve(ad.table(spark, d, "documents"), _QUERY, 50, False, sources=["en"], source="lang")


@query()
def rag_semantic(spark, d):
    return rt.retrieve(ad.table(spark, d, "documents"), _QUERY, 20)


@query()
def hash_embeddings(spark, d):
    return rt.hash_embedding(ad.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"), F.col("embedding")[0].alias("first"))


@query()
def vector_clusters(spark, d):
    return rt.cluster(ad.table(spark, d, "embeddings"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL),
 d AS (SELECT label, vec_id, round(sqrt(sum((v - m) * (v - m))), 6) AS distance FROM x JOIN c USING (label, i) GROUP BY label, vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY distance DESC, vec_id) AS b FROM d)
 SELECT 'cluster_' || label AS cluster_id, count(*) AS members, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY distance, vec_id) FILTER (a <= 3) AS representatives FROM r GROUP BY label""")
def cluster_map(spark, d):
    return rt.cluster_map(ad.table(spark, d, "embeddings")).select("cluster_id", "members", F.array_join("representatives", ",").alias("representatives"))


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(lx.LABEL_STOPWORDS))


@query(f"""WITH w AS (SELECT lang, doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT lang, doc_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS t FROM documents)), c AS (SELECT lang, term, count(*) AS n, min(doc_id * 1000000 + pos) AS first FROM w WHERE term NOT IN ({_STOP}) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) AS k FROM c) SELECT lang, string_agg(upper(substr(term, 1, 1)) || substr(term, 2), ' ' ORDER BY k) AS name FROM r WHERE k <= 4 GROUP BY lang""")
def cluster_names(spark, d):
    return rt.cluster_labels(ad.table(spark, d, "documents"), "lang", order="doc_id")


# evaluation and audits


_PREDICTED, _GOLD = "SELECT concat(p_name, ' ', p_brand) AS text FROM part", "SELECT concat(p_name, ' ', lower(p_type)) AS text FROM part"
_SETS = "SELECT DISTINCT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM ({})"
_WORDS = "list_distinct(list_filter(string_split(t, ' '), lambda w: w <> ''))"
_FUZZY = f"SELECT p.t AS text, bool_or(len(list_intersect(p.w, g.w)) / greatest(len(p.w), len(g.w)) >= 0.6) AS matched FROM (SELECT t, {_WORDS} AS w FROM ({{a}})) p, (SELECT t, {_WORDS} AS w FROM ({{b}})) g GROUP BY p.t"


@query(_FUZZY.format(a=_SETS.format(_PREDICTED), b=_SETS.format(_GOLD)))
def fuzzy_matches(spark, d):
    return au.fuzzy_matches(ad.view(spark, d, _PREDICTED), ad.view(spark, d, _GOLD))


@query(f"WITH p AS (SELECT avg(CAST(matched AS INT)) AS p FROM ({_FUZZY.format(a=_SETS.format(_PREDICTED), b=_SETS.format(_GOLD))})), r AS (SELECT avg(CAST(matched AS INT)) AS r FROM ({_FUZZY.format(a=_SETS.format(_GOLD), b=_SETS.format(_PREDICTED))})) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p, r")
def fuzzy_scores(spark, d):
    return au.fuzzy_scores(ad.view(spark, d, _PREDICTED), ad.view(spark, d, _GOLD))


def _hypotheses(spark, d):
    listed = lambda n: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.concat(F.lit("c"), i.cast("string")))
    some = lambda n: F.when(F.col(n) > 0, listed(n)).otherwise(F.array().cast("array<string>"))
    h = ad.view(spark, d, ad.HYPOTHESES)
    return h.select("hypothesis_id", "statement", "novelty_basis", "qualitative_confidence", "confidence_score", *(some(f"n_{c}").alias(c) for c in ("assumptions", "independent_variables", "dependent_variables", "supporting_citations", "grounding_claim_ids", "revision_history", "known_risks")))


@query(f"""SELECT hypothesis_id, completeness, confidence, evidence_grounding, revision_depth, round(completeness * 0.4::DOUBLE + confidence * 0.3::DOUBLE + evidence_grounding * 0.2::DOUBLE + revision_depth * 0.1::DOUBLE, 4) AS aggregate FROM (SELECT hypothesis_id, round((CAST(trim(coalesce(statement, '')) <> '' AS INT) + CAST(n_assumptions > 0 AS INT) + CAST(n_independent_variables > 0 AS INT) + CAST(n_dependent_variables > 0 AS INT) + CAST(trim(coalesce(novelty_basis, '')) <> '' AS INT)) / 5, 4) AS completeness,
 coalesce(round(confidence_score, 4), CASE lower(qualitative_confidence) WHEN 'high' THEN 0.85::DOUBLE WHEN 'low' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END) AS confidence, least(1.0::DOUBLE, (n_supporting_citations + n_grounding_claim_ids) / 5) AS evidence_grounding, least(1.0::DOUBLE, n_revision_history / 3) AS revision_depth FROM ({ad.HYPOTHESES}))""")
def hypothesis_scores(spark, d):
    return au.hypothesis_scores(_hypotheses(spark, d))


@query(f"SELECT hypothesis_id, CAST(n_grounding_claim_ids AS INT) AS grounding_claims, CAST(n_supporting_citations AS INT) AS citations, trim(coalesce(statement, '')) <> '' AS valid, CAST(greatest(n_grounding_claim_ids - 2, 0) AS BIGINT) AS unknown_claims, n_grounding_claim_ids + n_supporting_citations > 0 AS fully_grounded FROM ({ad.HYPOTHESES})")
def hypothesis_audit(spark, d):
    return au.hypothesis_audit(_hypotheses(spark, d), spark.sql("SELECT * FROM VALUES ('c0'), ('c1') AS v(claim_id)"))


@query(f"SELECT session_id, count(*) AS steps, count(*) FILTER (input_hash <> '' AND output_hash <> '') AS hashed, count(*) FILTER (status = 'error') AS errors, round(count(*) FILTER (input_hash <> '' AND output_hash <> '') / count(*), 4) AS coverage, count(*) FILTER (status = 'error') = 0 AS valid FROM ({ad.HASHED}) GROUP BY session_id")
def provenance_coverage(spark, d):
    return au.trace_coverage(ad.view(spark, d, ad.HASHED))


@query(f"SELECT session_id, sequence, tool, finding FROM (SELECT session_id, sequence, tool, 'missing: ' || concat_ws(', ', CASE WHEN coalesce(input_hash, '') = '' THEN 'input_hash' END, CASE WHEN coalesce(output_hash, '') = '' THEN 'output_hash' END) AS finding FROM ({ad.HASHED}) WHERE coalesce(input_hash, '') = '' OR coalesce(output_hash, '') = '' UNION ALL SELECT session_id, sequence, tool, 'failed: ' || coalesce(error_message, 'unknown error') FROM ({ad.HASHED}) WHERE status = 'error')")
def provenance_findings(spark, d):
    return au.trace_findings(ad.view(spark, d, ad.HASHED))


_BAD = f"SELECT assertion_id FROM ({ad.ASSERTIONS}) WHERE NOT (coalesce(paper_id, '') <> '' AND coalesce(chunk_id, '') <> '') AND NOT (lower(trim(confidence)) = 'low' AND coalesce(ungrounded, false))"


@query(_BAD)
def assertion_violations(spark, d):
    return au.ungrounded(ad.view(spark, d, ad.ASSERTIONS)).select("assertion_id")


@query(f"SELECT (SELECT count(*) FROM ({ad.ASSERTIONS})) AS checked, count(*) AS violations, count(*) = 0 AS passed FROM ({_BAD})")
def assertion_audit(spark, d):
    return au.assertion_audit(ad.view(spark, d, ad.ASSERTIONS))


_REFS = "SELECT o_custkey AS proposal_id, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'lost' ELSE concat('p', cast(o_orderkey % 40 AS varchar(5))) END AS paper_id FROM orders"
_PAPERS = "SELECT DISTINCT concat('p', cast(n_nationkey AS varchar(5))) AS paper_id FROM nation"


@query(f"WITH r AS ({_REFS}), p AS ({_PAPERS}), j AS (SELECT r.*, p.paper_id AS k FROM r LEFT JOIN p USING (paper_id)) SELECT proposal_id, count(*) AS \"references\", count(*) FILTER (paper_id = '') AS missing, count(*) FILTER (paper_id <> '' AND k IS NULL) AS unknown, round(count(DISTINCT k) / (SELECT count(*) FROM p), 4) AS citation_coverage, count(*) FILTER (paper_id = '') = 0 AS valid FROM j GROUP BY proposal_id")
def ref_integrity(spark, d):
    return au.reference_audit(ad.view(spark, d, _REFS), ad.view(spark, d, _PAPERS))


_RUNS = "SELECT user_id AS document_id, event_id AS run, md5(CASE WHEN user_id % 4 = 0 AND event_id % 9 = 0 THEN event_type ELSE cast(user_id AS varchar(20)) END) AS digest FROM events"


@query(f"SELECT document_id, expected, digest AS observed, CAST(run_index AS INT) AS run_index FROM (SELECT *, first_value(digest) OVER w AS expected, row_number() OVER w AS run_index FROM ({_RUNS}) WINDOW w AS (PARTITION BY document_id ORDER BY run)) WHERE digest <> expected")
def determinism_issues(spark, d):
    return au.determinism(ad.view(spark, d, _RUNS))


@query(f"SELECT count(*) AS documents, CAST(sum(same) AS BIGINT) AS deterministic, round(avg(same), 6) AS rate FROM (SELECT document_id, CAST(count(DISTINCT digest) <= 1 AS INT) AS same FROM ({_RUNS}) GROUP BY document_id)")
def determinism_audit(spark, d):
    return au.determinism_rate(ad.view(spark, d, _RUNS))


_SHAPES = """SELECT event_id, concat('{"b": 1, "a": [1, "x"]}') AS a, CASE event_id % 3 WHEN 0 THEN '{"a": [2, "y"], "b": 3}' WHEN 1 THEN '{"a": [2], "b": 3}' ELSE 'no json' END AS b FROM events"""


@query(f"SELECT event_id, event_id % 3 = 0 AS same_shape FROM ({_SHAPES})")
def schema_shapes(spark, d):
    return au.same_shape(ad.view(spark, d, _SHAPES), "a", "b").select("event_id", "same_shape")


# validators


def _problems(checks: list[tuple[str, str, str, str]], source: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{f}' AS field, '{r}' AS rule, '{s}' AS severity FROM ({source}) WHERE {w}" for f, r, s, w in checks)


@query(_problems([
    ("paper_id", "non_empty_string", "error", "coalesce(trim(paper_id), '') = ''"), ("text", "non_empty_string", "error", "coalesce(trim(text), '') = ''"), ("embedding_id", "non_empty_string", "error", "coalesce(trim(embedding_id), '') = ''"),
    ("chunk_id", "id_prefix_convention", "warning", "NOT starts_with(chunk_id, 'chunk_')"), ("text", "chunk_text_length", "warning", "length(coalesce(trim(text), '')) < 10"),
], ad.CHUNK_RECORDS, "chunk_id"))
def validate_chunks(spark, d):
    return va.problem_rows(ad.view(spark, d, ad.CHUNK_RECORDS), "chunk", "chunk_id")


def _claim_records(spark, d):
    c = ad.view(spark, d, ad.CLAIM_RECORDS)
    item = lambda k: F.struct(F.col(f"source_{k}").alias("source_id"), F.col(f"snippet_{k}").alias("snippet"), F.col(f"score_{k}").alias("retrieval_score"))
    return c.withColumn("evidence", F.array(item(0), item(1)))


_MEAN, _SOURCES = "(score_0 + score_1) / 2", "CASE WHEN source_0 = source_1 THEN 1 ELSE 2 END"


@query(_problems([
    ("object", "non_empty_string", "error", "trim(object) = ''"), ("statement", "compound_words", "warning", "contains(object, ' and ')"), ("statement", "atomicity", "warning", "contains(object, ' and ')"),
    ("predicate", "statement_coherence", "warning", "predicate = 'is'"), ("object", "statement_coherence", "error", "length(trim(object)) < 3"),
    ("confidence_level", "confidence_sources", "error", f"confidence_level = 'high' AND {_SOURCES} < 2"), ("confidence_level", "confidence_calibration", "error", f"confidence_level = 'high' AND {_MEAN} < 0.7"),
    ("evidence", "evidence_quality", "warning", "confidence_level = 'high' AND (score_0 < 0.5 OR score_1 < 0.5)"), ("confidence_level", "confidence_calibration", "warning", f"confidence_level = 'medium' AND {_MEAN} < 0.5"),
    *((f"evidence[{k}].snippet", "evidence_quality", "error", f"length(trim(snippet_{k})) < 10") for k in (0, 1)), *((f"evidence[{k}].retrieval_score", "evidence_quality", "warning", f"score_{k} < 0.5") for k in (0, 1)),
], ad.CLAIM_RECORDS, "claim_id"))
def validate_claims(spark, d):
    return va.problem_rows(_claim_records(spark, d), "claim", "claim_id")


# rendering


_MARKED = "SELECT p_partkey, concat(p_name, ' 50% & $x_1$ #', cast(p_partkey AS varchar(20)), ' {a} ~ ^ ', chr(92)) AS text FROM part"


def _escaped(text: str) -> str:
    out = f"replace({text}, chr(92), chr(1))"
    for c in "&%$#_{}":
        out = f"replace({out}, '{c}', chr(92) || '{c}')"
    for c, name in (("~", "textasciitilde"), ("^", "textasciicircum")):
        out = f"replace({out}, '{c}', chr(92) || '{name}{{}}')"
    return f"replace({out}, chr(1), chr(92) || 'textbackslash{{}}')"


@query(f"SELECT p_partkey, {_escaped('text')} AS latex FROM ({_MARKED})")
def latex_escapes(spark, d):
    return ad.view(spark, d, _MARKED).select("p_partkey", rd.escape_latex(F.col("text")).alias("latex"))


def _proposal_inputs(spark, d):
    h = _hypotheses(spark, d).withColumns({"rationale": F.col("novelty_basis"), "weak_assumptions": F.col("assumptions"), "suggested_revisions": F.col("revision_history")})
    claims = ad.view(spark, d, "SELECT concat('hyp_', cast(o_custkey AS varchar(20))) AS hypothesis_id, o_orderkey AS ord, concat('order ', cast(o_orderkey AS varchar(20))) AS subject, 'achieves' AS predicate, concat(cast(o_orderkey % 100 AS varchar(5)), '%') AS object_raw, CASE WHEN o_orderkey % 2 = 0 THEN 'ACCURACY' END AS metric, 'ctx_unknown' AS context_id FROM orders")
    refs = ad.view(spark, d, "SELECT concat('hyp_', cast(o_custkey AS varchar(20))) AS hypothesis_id, o_orderkey AS ord, concat('p', cast(o_orderkey % 3 AS varchar(5))) AS paper_id, o_orderpriority AS title, '' AS doi FROM orders").withColumn("authors", F.array(F.lit("A. Writer")))
    return h, claims, refs


@query(f"SELECT 'proposal_' || substr(sha256(hypothesis_id || ':' || statement), 1, 12) AS proposal_id, hypothesis_id, 5 AS sections, CASE WHEN k IS NULL THEN 'no supporting claims,no references' ELSE '' END AS warnings FROM ({ad.HYPOTHESES}) LEFT JOIN (SELECT DISTINCT concat('hyp_', o_custkey) AS k FROM orders) ON k = hypothesis_id WHERE statement <> ''")
def proposals(spark, d):
    return rd.proposals(*_proposal_inputs(spark, d)).select("proposal_id", "hypothesis_id", F.size("sections").alias("sections"), F.array_join("warnings", ",").alias("warnings"))


@query(f"SELECT h + b + c AS findings, r + x AS gaps, h AS hypotheses, cl AS clusters, x AS contradictions, n AS claims, format('Analysis of {{}} claims across {{}} literature clusters. Found {{}} key findings. Identified {{}} evidence gaps or contradictions.', n, cl, h + b + c, r + x) AS summary FROM (SELECT count(*) AS h, CAST(sum(n_known_risks) AS BIGINT) AS r FROM ({ad.HYPOTHESES})), (SELECT count(*) AS b FROM (SELECT DISTINCT metric FROM {N})), (SELECT count(DISTINCT label) AS cl, count(DISTINCT label) AS c FROM embeddings), (SELECT count(*) AS x FROM ({_CONTRA})), (SELECT count(*) AS n FROM {N})")
def consolidation(spark, d):
    claims = ad.view(spark, d, ad.NCLAIMS)
    clusters = ad.table(spark, d, "embeddings").where("label is not null").groupBy(F.concat(F.lit("label "), F.col("label").cast("string")).alias("label")).agg(F.count("*").alias("members"))
    h = _hypotheses(spark, d).withColumn("statement", F.coalesce("statement", F.lit("")))
    return rd.consolidate(h, claims.select("metric").distinct().withColumn("status", F.lit("supported")), clusters, rel.contradictions(claims), claims)


@query(f"SELECT loop_id, CASE WHEN a >= 0.8 THEN 1 WHEN b >= 0.8 THEN 2 WHEN c >= 0.8 THEN 3 WHEN abs(b - a) < 0.01 AND abs(c - b) < 0.01 THEN 3 ELSE 3 END AS iterations, CASE WHEN a >= 0.8 THEN a WHEN b >= 0.8 THEN b ELSE c END AS confidence, CASE WHEN greatest(a, b, c) >= 0.8 THEN 'confidence_threshold_met' WHEN abs(b - a) < 0.01 AND abs(c - b) < 0.01 THEN 'converged' ELSE 'max_iterations_reached' END AS stopped_reason FROM ({ad.LOOPS})")
def bounded_loops(spark, d):
    return rd.replay_loops(ad.view(spark, d, ad.LOOPS).select("loop_id", F.array("a", "b", "c").alias("confidences")))


@query("SELECT 'pr_' || o_custkey AS proposal_id, 'hyp_' || o_custkey AS hypothesis_id, 'claim_' || o_orderkey AS claim_id, 'chunk_' || o_orderkey AS chunk_id, 'paper_' || o_orderkey % 9 AS paper_id FROM orders")
def evidence_chain(spark, d):
    o = ad.table(spark, d, "orders")
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    h = o.groupBy(s("hyp_", F.col("o_custkey")).alias("hypothesis_id")).agg(F.collect_list(s("claim_", F.col("o_orderkey"))).alias("grounding_claim_ids"))
    p = o.select(s("pr_", F.col("o_custkey")).alias("proposal_id"), s("hyp_", F.col("o_custkey")).alias("hypothesis_id")).distinct()
    c = o.select(s("claim_", F.col("o_orderkey")).alias("claim_id"), s("chunk_", F.col("o_orderkey")).alias("chunk_id"), s("paper_", F.col("o_orderkey") % 9).alias("paper_id"))
    return rd.evidence_chain(p, h, c)


# streaming forms on batch input, and the tools


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS calls FROM events GROUP BY ALL")
def windowed_tools(spark, d):
    return ingest.windowed_tools(ad.table(spark, d, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "calls")


@query("SELECT name FROM (VALUES " + ", ".join(f"('{n}')" for n in REGISTRY.names()) + ") v(name)")
def tools(spark, d):
    return spark.createDataFrame([(n,) for n in REGISTRY.names()], "name string")


@query(f"SELECT claim_a, claim_b, context_id, metric, reason FROM (SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, a.context_id, a.metric, CASE WHEN a.polarity <> b.polarity THEN 'polarity_opposition' ELSE 'value_divergence' END AS reason FROM {N} a JOIN {N} b ON a.ord < b.ord AND a.context_id = b.context_id AND a.metric = b.metric AND (a.polarity <> b.polarity OR abs(a.value - b.value) > 0.05))")
def tool_contradiction(spark, d):
    return REGISTRY.get("contradiction")(claims=ad.view(spark, d, ad.NCLAIMS))
