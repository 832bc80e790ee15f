"""Lexical and vector top-k, cluster profiles, cluster and claim evaluation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import lexicon as lx
from .text import tokens


def lexical_topk(corpus: DataFrame, query: str, k: int, key: str = "doc_id", text: str = "text", sources: list[str] | None = None, source: str = "source") -> DataFrame:
    """Share of the query's words (repeats count) that a text has; texts without any are left out. Only texts of the
    ``sources``, if given. The texts' words are made once, as an array of the distinct ones."""
    words = re.findall("[a-z0-9]+", query.lower())
    asked = F.array(*map(F.lit, words)).cast("array<string>")
    pool = corpus if not sources else corpus.where(F.col(source).isin(*sources))
    hits = pool.select(key, F.array_distinct(tokens(F.col(text))).alias("_have")).select(key, F.size(F.filter(asked, lambda w: F.array_contains("_have", w))).alias("_hits"))
    return hits.where("_hits > 0").select(key, F.round(F.col("_hits") / max(len(words), 1), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


#: Rows that are worked on at once, so that a Python worker's memory does not follow the batch.
_ROWS = 512


def _embedded(digests: np.ndarray, size: int) -> np.ndarray:
    x = np.round(np.take(digests, np.arange(size) % 32, axis=1) / 127.5 - 1.0, 6)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.round(np.divide(x, norm, where=norm > 0, out=x), 6)


def _each_digest(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Where each slice of the column begins, and its digests as rows of 32 bytes."""
    for at in range(0, len(column), _ROWS):
        yield at, np.frombuffer(b"".join(column.slice(at, _ROWS).to_pylist()), np.uint8).reshape(-1, 32)


def _digest(text: Column) -> Column:
    """Only digests go to Python, no texts."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def hash_embedding(df: DataFrame, text: str = "text", size: int = 384) -> DataFrame:
    """embedding: the bytes of the text's digest round and round, scaled to -1..1 and then to length one (six places)."""

    @F.arrow_udf("array<double>")
    def embed(column: pa.Array) -> pa.Array:
        out = np.empty((len(column), size))
        for at, digests in _each_digest(column):
            out[at : at + _ROWS] = _embedded(digests, size)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * size, pa.int32()), pa.array(out.ravel()))

    return df.withColumn("embedding", embed(_digest(F.col(text))))


def semantic_topk(corpus: DataFrame, query: str, k: int = 5, key: str = "doc_id", text: str = "text", sources: list[str] | None = None, source: str = "source") -> DataFrame:
    """Nearest texts of the query by the cosine of hash embeddings, of the ``sources`` if given. Digests go to Python and
    scores come back; components are summed one after the other, as cosine() does."""
    q = _embedded(np.frombuffer(hashlib.sha256(query.encode()).digest(), np.uint8).reshape(1, 32), 384)[0]
    norm_q = np.sqrt(sum((x * x for x in q.tolist()), 0.0))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column))
        for at, digests in _each_digest(column):
            e = np.ascontiguousarray(_embedded(digests, len(q)).T)
            dot, square = np.zeros(len(digests)), np.zeros(len(digests))
            for x, y in zip(e, q, strict=True):
                dot += x * y
                square += x * x
            both = np.sqrt(square) * norm_q
            np.divide(dot, both, where=both != 0, out=out[at : at + _ROWS])
        return pa.array(out)

    pool = corpus if not sources else corpus.where(F.col(source).isin(*sources))
    return pool.select(key, F.round(score(_digest(F.col(text))), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def retrieve(corpus: DataFrame, query: str, k: int = 5, embed: bool = True, **how) -> DataFrame:
    """Semantic matches, or without embeddings lexical ones; ``method`` tells which."""
    found = semantic_topk(corpus, query, k, **how) if embed else lexical_topk(corpus, query, k, **how)
    return found.withColumn("method", F.lit("semantic" if embed else "lexical"))


def cluster(vectors: DataFrame, least: int = 3, seed: int = 42) -> DataFrame:
    """vec_id and cluster (null: noise) by k-means, with as many clusters as the square root of half the rows, at most one
    for every ``least`` rows and two at least; fewer rows than ``least`` are all noise."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    if n < least:
        return vectors.select("vec_id", F.lit(None).cast("int").alias("cluster"))
    k = max(2, min(int((n / 2) ** 0.5), n // least))
    features = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(features).transform(features).select("vec_id", F.col("prediction").alias("cluster"))


def cluster_map(vectors: DataFrame, texts: DataFrame | None = None, by: str = "label", near: int = 3, far: int = 2) -> DataFrame:
    """One row per cluster of ``vectors`` (vec_id, embedding, ``by``): id, number of members, representatives, boundary members,
    the first ten numbers of the centroid, and a label from the representatives' ``texts`` (vec_id, text)."""
    known = vectors.where(F.col(by).isNotNull())
    roles = cluster_profiles(known, by, near, far)
    pick = lambda role, order: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct(order.alias("d"), "vec_id")))), lambda s: s.vec_id)
    named = roles.groupBy(by).agg(pick("representative", F.col("distance")).alias("representatives"), pick("boundary", -F.col("distance")).alias("boundary"))
    centre = known.select(by, F.posexplode(F.slice("embedding", 1, 10)).alias("i", "x")).groupBy(by, "i").agg(F.round(F.avg("x"), 6).alias("m")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("centroid"))
    out = known.groupBy(by).agg(F.count("*").alias("members")).join(named, by).join(centre, by)
    if texts is not None:
        out = out.join(cluster_labels(roles.where("role = 'representative'").join(texts, "vec_id"), by), by, "left")
    return out.withColumn("cluster_id", F.concat(F.lit("cluster_"), F.col(by).cast("string")))


def cluster_labels(texts: DataFrame, by: str, text: str = "text", order: str = "vec_id", words: int = 4, stopwords: tuple[str, ...] = tuple(lx.LABEL_STOPWORDS)) -> DataFrame:
    """Per cluster the most frequent words of its texts, capitalised: ties go to the word that stands first. Where the order is
    a whole number, a place is one number too, which is kept while counting by hash; others are counted by sorting all words."""
    terms = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    whole = isinstance(texts.schema[order].dataType, IntegralType)
    row = F.col(order).cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)") if whole else F.col(order)
    found = texts.select(F.col(by).alias("by"), row.alias("row"), F.posexplode(terms).alias("at", "term")).where(~F.col("term").isin(*stopwords))
    place = F.col("row") + F.col("at").cast("decimal(10,0)") if whole else F.struct("row", "at")
    counts = found.groupBy("by", "term").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    rank = F.row_number().over(Window.partitionBy("by").orderBy(F.desc("n"), F.asc_nulls_last("first"), "term"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= words)
    return top.groupBy(F.col("by").alias(by)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: F.initcap(s.term)), " ").alias("name"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    both = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (both == 0), 0.0).otherwise(dot / both)


def vector_topk(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, post_filter: bool = False) -> DataFrame:
    """Nearest by cosine; the filter comes first, or with ``post_filter`` after the cut, so that fewer can be left."""
    q = F.array(*(F.lit(float(x)) for x in query))
    pool = vectors if where is None or post_filter else vectors.where(where)
    top = pool.withColumn("score", F.round(cosine(F.col("embedding"), q), 6)).orderBy(F.desc("score"), "vec_id").limit(k)
    return top.where(where) if post_filter and where is not None else top


def cluster_profiles(vectors: DataFrame, cluster: str = "label", near: int = 3, far: int = 2) -> DataFrame:
    """Members, nearest and farthest from the centroid of each cluster."""
    centre = vectors.select(cluster, F.posexplode("embedding").alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("m")).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("centroid"))
    apart = F.sqrt(F.aggregate(F.zip_with("embedding", "centroid", lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x))
    d = vectors.join(centre, cluster).select(cluster, "vec_id", F.round(apart, 6).alias("distance"))
    by = lambda o: F.row_number().over(Window.partitionBy(cluster).orderBy(o, "vec_id"))
    d = d.withColumns({"near_rank": by(F.asc("distance")), "far_rank": by(F.desc("distance"))})
    return d.where(f"near_rank <= {near} or far_rank <= {far}").select(cluster, "vec_id", "distance", F.when(F.col("near_rank") <= near, "representative").otherwise("boundary").alias("role"))


def purity_nmi(assigned: DataFrame, predicted: str, gold: str) -> DataFrame:
    cells = assigned.groupBy(predicted, gold).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy(predicted).agg(F.sum("n").alias("r"), F.max("n").alias("top")), cells.groupBy(gold).agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum("n").alias("t"))
    joined = cells.join(rows, predicted).join(cols, gold).join(F.broadcast(total))
    mutual = joined.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("r") * F.col("c")) + 1e-10)).alias("mi"))
    entropy = lambda df, x, name: df.join(F.broadcast(total)).agg((-F.sum(F.col(x) / F.col("t") * F.log(F.col(x) / F.col("t") + 1e-10))).alias(name))
    purity = rows.join(F.broadcast(total)).agg((F.sum("top") / F.max("t")).alias("purity"), F.max("t").alias("n"))
    one = purity.join(mutual).join(entropy(rows, "r", "hr")).join(entropy(cols, "c", "hc"))
    nmi = F.when(F.col("hr") + F.col("hc") > 0, F.col("mi") / ((F.col("hr") + F.col("hc")) / 2)).otherwise(0.0)
    return one.select("n", F.round("purity", 6).alias("purity"), F.round(nmi, 6).alias("nmi"))


def frequent_terms(df: DataFrame, group: str, text: str, k: int = 5, stopwords: tuple[str, ...] = ()) -> DataFrame:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    counts = df.select(group, F.explode(words).alias("term")).where(~F.col("term").isin(*stopwords) if stopwords else F.lit(True)).groupBy(group, "term").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "term"))).where(F.col("rank") <= k)


def precision_recall(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    p, g = predicted.select(key).distinct(), gold.select(key).distinct()
    flag = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), key, "full")
    s = flag.agg(F.count("p").alias("np"), F.count("g").alias("ng"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("hit"))
    pr, rc = F.when(F.col("np") > 0, F.col("hit") / F.col("np")).otherwise(0.0), F.when(F.col("ng") > 0, F.col("hit") / F.col("ng")).otherwise(0.0)
    f1 = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)
    return s.select(F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(f1, 6).alias("f1"))
