"""Verdicts on URLs: a blocked Bloom filter of the listed keys passes possible hits to an exact hash join.

Every URL has few keys: each host suffix with each prefix of the path that is as long as some listed path. The filter
is a table of blocks, one 64-bit word each; a key that misses a bit in its block can't be listed. Survivors meet the
list in an equi-join that removes false positives, and the longest rule wins. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read

BITS = 4
#: Largest filter or list that is broadcast; beyond it both joins shuffle (AQE splits hot keys).
BROADCAST_ROWS = 200_000

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(n_blocks))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """block, bits: the filter; building it is one aggregation with partial sums."""
    return keys.groupBy(_block(F.col(key), n_blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``. ``rules``: host, path, verdict.

    A rule fits its host and all subdomains where the url's path starts with the rule's; the longest key (host and
    path) wins, and of equal keys listed twice 'block' does. Without a rule the verdict is 'allow'. Null urls and urls without ``://`` have empty
    host and path and no rule. Repeated rows come back as often as they came; null ids stay.
    An empty list allows everything.
    """
    listed = rules.where("host is not null and path is not null").groupBy(F.concat("host", "path").alias("key"), "host", F.length("path").alias("n_path")).agg(F.max("verdict").alias("verdict"))
    facts = listed.agg(F.count("*").alias("n"), F.collect_set("n_path").alias("sizes")).first()
    sizes = sorted(facts.sizes) or [0]
    n_blocks = max(1, math.ceil(facts.n * 16 / 64))
    small = F.broadcast if facts.n <= BROADCAST_ROWS else lambda df: df
    judged = pages.select(F.col(page_id).alias("_id_"), F.col(url).alias("_url_")).groupBy("_id_", "_url_").count()
    judged = judged.withColumns({"_host_": host_of(F.col("_url_")), "_path_": path_of(F.col("_url_"))})
    labels = F.split("_host_", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("_path_"))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda n: F.struct(F.concat(h, F.col("_path_").substr(F.lit(1), n)).alias("key"), h.alias("host")))))
    each = judged.where("_host_ <> ''").select("_id_", "_url_", F.explode(keys).alias("k")).select("_id_", "_url_", "k.key", "k.host").withColumn("block", _block(F.col("key"), n_blocks))
    possible = each.join(small(bloom_blocks(listed, "key", n_blocks)), "block").where(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")))
    exact = possible.join(small(listed.select("key", "host", "verdict")), ["key", "host"])
    best = exact.groupBy("_id_", "_url_").agg(F.max(F.struct(F.length("key").alias("n"), "verdict", "key")).alias("best"))
    back = judged.alias("j").join(best.alias("b"), F.col("j._id_").eqNullSafe(F.col("b._id_")) & (F.col("j._url_") == F.col("b._url_")), "left")
    return back.select(
        F.explode(F.array_repeat(F.struct(F.col("j._id_").alias(page_id), F.col("j._host_").alias("host"), F.col("j._path_").alias("path"), F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")), F.col("count").cast("int"))).alias("r")
    ).select("r.*")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


_KEY = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in RULES)
OP3_SQL = f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), r AS ({_KEY})
SELECT page_id, host, path,
  (SELECT h || p FROM r WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) ORDER BY length(h || p) DESC, v DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM r WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) ORDER BY length(h || p) DESC, v DESC LIMIT 1), 'allow') AS verdict
FROM u"""
