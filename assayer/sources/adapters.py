"""Synthetic claim-bearing views over the star schema, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Normalised claims out of events.
NCLAIMS = """SELECT event_id AS ord, concat('claim_', event_id) AS claim_id, concat('ctx_', cast(cast(ts AS date) AS varchar(10))) AS context_id, concat('user_', user_id) AS subject, 'measures' AS predicate,
 upper(event_type) AS metric, value / 1000 AS value, 'ratio' AS unit, CASE WHEN event_id % 7 = 0 THEN 'refutes' WHEN event_id % 11 = 0 THEN 'neutral' ELSE 'supports' END AS polarity,
 CASE WHEN event_id % 5 = 0 THEN 'delta' ELSE 'absolute' END AS subtype FROM events"""

#: Sentences out of line items: claims of each kind and texts without one.
SENTENCES = """SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + cast(l_quantity AS bigint) AS ord, concat('src_', l_suppkey) AS source_id, CASE l_orderkey % 9
 WHEN 0 THEN concat('Supplier ', l_suppkey, ' achieves ', 40 + cast(l_quantity AS int), '% accuracy on ', CASE l_returnflag WHEN 'A' THEN 'GLUE' WHEN 'N' THEN 'SQuAD' ELSE 'ImageNet' END, '.')
 WHEN 1 THEN concat('Training requires ', cast(l_quantity AS int), ' hours on a single V100.') WHEN 2 THEN concat('The model number ', l_partkey, ' introduces a transformer-based architecture.')
 WHEN 3 THEN concat('The network may achieve ', cast(l_quantity AS int), '% accuracy on the dataset.') WHEN 4 THEN concat('Latency improved by ', cast(l_quantity AS int), '% over the baseline.')
 WHEN 5 THEN 'We ran experiments on various datasets.' WHEN 6 THEN concat('BLEU score of ', cast(l_quantity AS int), ' was reported on WMT in ', 1990 + l_linenumber, '.')
 WHEN 7 THEN concat('It might help (see Table ', l_linenumber, ') in some cases.') ELSE concat('System ', l_suppkey, ' runs in ', cast(l_quantity AS int), ' ms latency and reaches ', 1 + cast(l_quantity AS int), ' fps on CIFAR-10.') END AS text FROM lineitem"""

#: Chunks on pages, with a data set word on every fifth.
PAGED = """SELECT o_custkey AS source_id, l_orderkey AS page, cast(l_linenumber AS bigint) * 1000000000 + cast(l_quantity AS bigint) * 10000000 + l_partkey AS ord, CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN CASE l_returnflag WHEN 'A' THEN 'GLUE' WHEN 'N' THEN 'SQuAD' ELSE 'ImageNet' END END AS dataset,
 CASE WHEN l_linenumber % 2 = 0 THEN 'accuracy' END AS metric, CASE WHEN l_linenumber % 3 = 0 THEN concat(cast(l_quantity AS int), '%') END AS number, l_linenumber * 300 AS start_char,
 l_linenumber * 300 + CASE WHEN l_quantity > 25 THEN 50 ELSE 150 END AS end_char, l_partkey % 10 = 0 AS blank_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

#: Trace entries out of events.
TRACES = "SELECT event_id AS seq, user_id % 50 AS session_id, event_type AS tool, value AS duration, CASE WHEN event_id % 13 = 0 THEN 'error' ELSE 'success' END AS status, event_id % 4 = 0 AS cache_hit, event_id % 100 AS tokens FROM events"


#: Experimental contexts out of customers.
CONTEXTS = """SELECT concat('ctx_c', cast(c_custkey AS varchar(20))) AS context_id, CASE c_nationkey % 3 WHEN 0 THEN 'classification' WHEN 1 THEN 'translation' ELSE 'other' END AS task,
 CASE WHEN c_custkey % 2 = 0 THEN concat('Set', cast(c_nationkey % 7 AS varchar(5))) ELSE concat('SET', cast(c_nationkey % 7 AS varchar(5))) END AS dataset, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'V1' ELSE 'v2' END AS dataset_version,
 CASE WHEN c_custkey % 5 = 0 THEN 'F1' ELSE ' accuracy' END AS metric_name, CASE WHEN c_custkey % 3 = 0 THEN '%' END AS metric_unit, true AS higher, CASE WHEN c_custkey % 7 = 0 THEN 'macro' END AS aggregation FROM customer"""

#: Evaluation rows out of line items.
EVALUATED = """SELECT l_linenumber AS expected_claims, l_linenumber % 3 AS extracted_claims, l_partkey % 5 AS collapsed_claim_pairs, l_partkey % 3 AS truly_equivalent_collapses, l_suppkey % 4 AS known_contradictions, l_suppkey % 2 AS contradictions_found,
 0 AS hypotheses_generated, 1 AS hypotheses_grounded, 2 AS proposals_generated, 1 AS proposals_complete FROM lineitem"""

#: Identifiers of every kind out of orders.
IDENTIFIERS = """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN concat(' arXiv:1706.', lpad(cast(o_orderkey % 100000 AS varchar(10)), 5, '0')) WHEN 1 THEN concat('https://arxiv.org/abs/2302.', lpad(cast(o_orderkey % 100000 AS varchar(10)), 5, '0'), 'v2')
 WHEN 2 THEN concat('pmc', cast(1000000 + o_orderkey AS varchar(10))) WHEN 3 THEN concat('https://aclanthology.org/2023.acl-long.', cast(o_orderkey AS varchar(10)), '/') WHEN 4 THEN concat('see 10.1234/abc', cast(o_orderkey AS varchar(10)), ').') WHEN 5 THEN concat('https://doi.org/10.1000/x', cast(o_orderkey AS varchar(10)))
 WHEN 6 THEN concat('https://www.biorxiv.org/content/10.1101/', cast(o_orderkey AS varchar(10))) WHEN 7 THEN concat('https://proceedings.mlr.press/v9/p', cast(o_orderkey AS varchar(10)), '.html') WHEN 8 THEN concat('https://openreview.net/forum?id=q', cast(o_orderkey AS varchar(10)))
 ELSE concat('plain words ', cast(o_orderkey AS varchar(10))) END AS identifier FROM orders"""

#: Hypotheses out of customers; lists are given by their lengths.
HYPOTHESES = """SELECT concat('hyp_', cast(c_custkey AS varchar(20))) AS hypothesis_id, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE concat('Statement of ', c_name) END AS statement, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'a novel idea' END AS novelty_basis,
 CASE c_custkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'low' END AS qualitative_confidence, CASE WHEN c_custkey % 4 = 0 THEN cast(0.25 AS double) END AS confidence_score, c_custkey % 3 AS n_assumptions, c_custkey % 2 AS n_independent_variables, c_custkey % 4 AS n_dependent_variables,
 c_custkey % 5 AS n_supporting_citations, c_custkey % 4 AS n_grounding_claim_ids, c_custkey % 6 AS n_revision_history, c_custkey % 2 AS n_known_risks FROM customer"""

#: Trace entries with digests, some missing.
HASHED = """SELECT user_id % 50 AS session_id, event_id AS sequence, event_type AS tool, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 15 = 0 THEN '' ELSE md5(event_type) END AS input_hash, CASE WHEN event_id % 12 = 0 THEN '' ELSE md5(cast(event_id AS varchar(20))) END AS output_hash,
 CASE WHEN event_id % 13 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN event_id % 26 = 0 THEN 'timeout' END AS error_message FROM events"""

#: Assertions out of events.
ASSERTIONS = """SELECT concat('a', cast(event_id AS varchar(20))) AS assertion_id, CASE WHEN event_id % 3 > 0 THEN concat('p', cast(user_id AS varchar(20))) END AS paper_id, CASE WHEN event_id % 4 > 0 THEN 'c' ELSE '' END AS chunk_id, CASE WHEN event_id % 2 = 0 THEN ' LOW' ELSE 'medium' END AS confidence, event_id % 5 = 0 AS ungrounded FROM events"""

#: Chunk records out of documents, some broken.
CHUNK_RECORDS = """SELECT concat(CASE WHEN doc_id % 9 = 0 THEN 'ck_' ELSE 'chunk_' END, cast(doc_id AS varchar(20))) AS chunk_id, CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE 'paper_1' END AS paper_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'short ' ELSE text END AS text, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'e1' END AS embedding_id FROM documents"""

#: Claim records with two pieces of evidence out of line items.
CLAIM_RECORDS = """SELECT concat('claim_', cast(l_orderkey * 10 + l_linenumber AS varchar(20)), '_', cast(l_partkey AS varchar(20)), '_', cast(l_suppkey AS varchar(20))) AS claim_id, concat('System ', cast(l_suppkey AS varchar(10))) AS subject, CASE WHEN l_linenumber = 3 THEN 'is' ELSE 'Achieves' END AS predicate,
 CASE l_linenumber WHEN 1 THEN '92% accuracy' WHEN 2 THEN '92% accuracy and 3 s' WHEN 4 THEN 'ok' WHEN 5 THEN '  ' ELSE 'a value' END AS object, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence_level,
 'src_0' AS source_0, CASE WHEN l_suppkey % 2 = 0 THEN 'src_0' ELSE 'src_1' END AS source_1, 'a long enough snippet' AS snippet_0, CASE WHEN l_partkey % 3 = 0 THEN ' short ' ELSE 'another long snippet' END AS snippet_1, cast(l_partkey % 8 AS double) / 8 AS score_0, cast(l_suppkey % 4 AS double) / 4 AS score_1 FROM lineitem"""

#: Loops with three scripted confidences.
LOOPS = "SELECT concat('loop_', cast(event_id AS varchar(20))) AS loop_id, cast(event_id % 9 AS double) / 10 AS a, cast(event_id % 9 AS double) / 10 + cast(event_id % 4 AS double) / 400 AS b, cast(event_id % 9 AS double) / 10 + cast(event_id % 5 AS double) / 400 AS c FROM events"


#: Bytes of files whose rows meet in one task of a join by key, so that a task's sorts do not grow with the tables.
TASK_BYTES = 4 << 20
_JOINED = {"JOIN orders ON l_orderkey = o_orderkey": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}


def _bytes(df: DataFrame) -> int:
    """Size of a scan's files, as Spark knows it without reading them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The adapter's rows; only the columns that a query asks for are read. Tables that are joined by a key are dealt out by it
    over as many tasks as their size asks for."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "lineitem", "orders", "documents", "embeddings", "benchmark", "pages", "conversations", "customer", "part", "nation") if t in sql}
    for join, keys in _JOINED.items():
        if join in sql:
            n = max(spark.sparkContext.defaultParallelism, -(-sum(_bytes(read[t]) for t in keys) // TASK_BYTES))
            read |= {t: read[t].repartition(n, k) for t, k in keys.items()}
    for t, df in read.items():
        df.createOrReplaceTempView(t)
    return spark.sql(re.sub(r"varchar\(\d+\)", "string", sql))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
