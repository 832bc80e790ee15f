"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source with ratio r = target / size is taken floor(r) times for sure and once more with probability
r - floor(r). Which ones get the extra copy is drawn by the cube method: three undecided documents at a time move along
the null space of the constraints (number of documents, number of words) until one is decided, so both totals stay
where they are. Blocks of a source are decided on their own, in parallel; each leaves at most two undecided documents
(three if rounding interferes), which meet in the next, far smaller level, until one block per source remains and a
landing step rounds its last few.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, read

#: Words of the contract (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK = 4096
_EDGE = 1e-9


def flight(sizes: list[float], p: list[float], draws: Iterator[float]) -> list[float]:
    """Moves probabilities to 0 or 1, keeping their sum and that of size times probability; at most 2 stay between."""
    p = [min(max(x, 0.0), 1.0) for x in p]
    hand: list[int] = []
    for i in range(len(p)):
        if not _EDGE < p[i] < 1 - _EDGE:
            p[i] = float(round(p[i]))
            continue
        hand.append(i)
        while len(hand) == 3 or len(hand) == 2 and sizes[hand[0]] == sizes[hand[1]]:
            if len(hand) == 2:
                u = [1.0, -1.0]
            else:
                a, b, c = (sizes[k] for k in hand)
                u = [b - c, c - a, a - b]
                if not any(u):
                    u = [1.0, -1.0, 0.0]
            up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(hand, u, strict=True) if v)
            down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(hand, u, strict=True) if v)
            step = up if next(draws) * (up + down) < down else -down
            for k, v in zip(hand, u, strict=True):
                p[k] += step * v
            for k in list(hand):
                if not _EDGE < p[k] < 1 - _EDGE:
                    p[k] = float(round(p[k]))
                    hand.remove(k)
    return p


def land(sizes: list[float], p: list[float]) -> list[float]:
    """Rounds the few undecided so that the number of words comes nearest, then the number of documents."""
    left = [i for i, x in enumerate(p) if _EDGE < x < 1 - _EDGE]
    want, many = sum(sizes[i] * p[i] for i in left), sum(p[i] for i in left)
    best = min(itertools.product((0.0, 1.0), repeat=len(left)), key=lambda c: (abs(sum(sizes[i] * x for i, x in zip(left, c, strict=True)) - want), abs(sum(c) - many), c))
    for i, x in zip(left, best, strict=True):
        p[i] = x
    return p


def _draws(seed: int) -> Iterator[float]:
    x = seed & (1 << 64) - 1
    while True:  # splitmix64: the same on every machine
        x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
        z = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        yield ((z ^ z >> 31) >> 11) / (1 << 53)


def _step(columns: list[str], seed: int, last: bool):
    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mark", "doc_id", "size"], kind="stable")
        x = pdf["size"].astype(float).tolist()
        p = flight(x, pdf["p"].tolist(), _draws(int(pdf["mark"].iloc[0]) ^ seed))
        pdf["p"] = land(x, p) if last else p
        return pdf[columns]

    return step


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, cap: float = 2.0) -> DataFrame:
    """source, source_size, target. One row per source: weights go round by code point order (null last), shares above
    ``cap`` times a source's size are cut and dealt again by weight. With level L, a target is
    min(cap * size, L * weight); the window finds L in one pass over the sources in the order they reach their cap."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    total = total.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = (F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap).cast("double")
    t = total.withColumns({"_all": F.sum("source_size").over(everything) * F.lit(share), "_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)), "_full": full})
    t = t.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_left"))
    t = t.withColumn("_level", F.max(F.when(F.col("_level") * F.col("w") <= F.col("source_size") * cap, F.col("_level"))).over(everything))
    return t.select("source", "source_size", F.least(F.col("source_size") * F.lit(cap), F.coalesce(F.col("_level") * F.col("w"), F.col("source_size") * F.lit(cap))).alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size times copies) for every row.

    Null texts have size 0 and, like all of size 0, are taken 0 times. Null sources are one source, the last. Rows with the same id are
    documents of their own. The draws depend on ids, sizes and ``seed`` alone, so reruns agree. An empty table gives an empty result.
    """
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n.alias("size")), "mix-sizes")
    targets = materialize(source_targets(sizes, share, weights, cap), "mix-targets")
    known = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = known.withColumns({"sure": F.when(F.col("size") > 0, F.floor(ratio)).otherwise(0).cast("int"), "p": F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(0.0), "mark": F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(seed))})
    columns = state.columns
    schema = f"doc_id {dict(sizes.dtypes)['doc_id']}, source {dict(sizes.dtypes)['source']}, size long, source_size long, target double, sure int, p double, mark long"
    largest = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    done: DataFrame | None = None
    while largest:
        blocks = -(-largest // BLOCK)
        last = blocks == 1

        # blocks by mark within a source: a hot source fills many
        dealt = state.withColumn("_block", F.pmod(F.col("mark"), F.lit(blocks)))
        state = materialize(dealt.groupBy("source", "_block").applyInPandas(_step(columns, seed, last), schema), "mix-level")
        decided = state.where("p = 0 or p = 1")
        done = decided if done is None else done.unionByName(decided)
        if last:
            break
        state = state.where("p > 0 and p < 1")
        largest = state.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        state = state.withColumn("mark", F.xxhash64("mark"))
    done = state if done is None else done
    copies = (F.col("sure") + F.col("p")).cast("int")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
