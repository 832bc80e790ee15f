"""Approximate nearest neighbours with a hash-prefix forest.

Rows are dealt into shards of bounded size and queries into blocks. In a shard every tree holds the rows' hash strings
(signs of random projections about the centre) in sorted order. A query descends to its longest prefix match in each
tree and then all trees ascend together, one character shorter at a time, until enough distinct candidates are met;
these are compared by their true distance, and the best of all shards are the answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, read

SHARD_ROWS = 8192
QUERY_ROWS = 4096


class Forest:
    """Sorted arrays of hash strings, one for each tree."""

    def __init__(self, rows: np.ndarray, trees: int, bits: int, seed: int) -> None:
        self.rows, self.bits = rows, bits
        self.centre = rows.mean(axis=0)
        self.planes = np.random.default_rng(seed).standard_normal((trees, bits, rows.shape[1]))
        codes = self.codes(rows)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return np.stack([((x - self.centre) @ p.T > 0) @ weights for p in self.planes])

    def candidates(self, queries: np.ndarray, enough: int) -> list[np.ndarray]:
        """Row numbers for each query: the synchronous ascent."""
        codes = self.codes(queries)
        lows, highs = [], []
        for cut in range(self.bits + 1):  # ranges of every prefix length, longest first
            lo = codes >> cut << cut
            hi = lo + (1 << cut)
            lows.append(np.stack([np.searchsorted(s, v) for s, v in zip(self.sorted, lo, strict=True)]))
            highs.append(np.stack([np.searchsorted(s, v) for s, v in zip(self.sorted, hi, strict=True)]))
        out, n = [], len(self.rows)
        for q in range(codes.shape[1]):
            seen = np.zeros(n, bool)
            for cut, (lo, hi) in enumerate(zip(lows, highs, strict=True)):
                if cut < self.bits and (hi[:, q] - lo[:, q]).sum() < enough:
                    continue
                for t in range(len(self.order)):
                    seen[self.order[t, lo[t, q] : hi[t, q]]] = True
                if seen.sum() >= enough:
                    break
            out.append(np.flatnonzero(seen))
        return out


def _usable(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(rows: DataFrame, is_query: Column, k: int = 10, row_id: str = "vec_id", vector: str = "embedding", trees: int = 256, bits: int = 32, share: float = 0.25, least: int = 1000, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's ``k`` nearest found by Euclidean distance in double precision,
    ties to the smaller id; never the row with the query's own id.

    Vectors that are null, zero, or hold null or non-finite components take no part, neither do null ids; vectors of
    different length are never neighbours. Of exactly equal vectors only the k + 1 smallest ids are indexed: no other
    can be in any answer. ``share`` of a shard's rows (``least`` at least) end the ascent; fewer candidates than ``k``
    give all of them. Rows that repeat an id with another vector count on their own; an empty table gives an empty result.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = rows.select(F.col(row_id).alias("vec_id"), v.alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    equal = Window.partitionBy("v").orderBy("vec_id")
    data = rows.select("vec_id", "v").distinct().withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1).drop("n")
    data, queries = materialize(data, "ann-rows"), rows.where("q").select("vec_id", "v").distinct()
    shards = max(1, -(-data.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    put = lambda n, tag: F.pmod(F.xxhash64("vec_id", F.lit(tag)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = data.withColumn("shard", put(shards, "shard")).withColumn("block", every(blocks)).withColumn("dim", F.size("v"))
    right = queries.withColumn("block", put(blocks, "block")).withColumn("shard", every(shards)).withColumn("dim", F.size("v"))

    def search(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a = a.sort_values("vec_id", kind="stable")
        ids, x = a["vec_id"].to_numpy(), np.stack(a["v"].to_list())
        forest = Forest(x, trees, bits, seed + key[0])
        found = []
        y = np.stack(b["v"].to_list())
        for own, query, near in zip(b["vec_id"].to_numpy(), y, forest.candidates(y, max(int(share * len(x)), least)), strict=True):
            near = near[ids[near] != own]
            d = np.sqrt(((x[near] - query) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], d))[:k]
            found.append(pd.DataFrame({"query_id": own, "vec_id": ids[near][best], "score": d[best]}))
        return pd.concat(found)

    kind = dict(rows.dtypes)["vec_id"]
    keys = ("shard", "block", "dim")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, f"query_id {kind}, vec_id {kind}, score double")
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
