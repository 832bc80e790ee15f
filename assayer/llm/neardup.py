"""Near duplicates by DartMinHash over counted five-word shingles, banded joins, exact verification and connected components.

Every element of a weighted set owns a region: its weight along one axis, an endless rank axis along the other. Hashed
darts fall on each unit cell of weight as a Poisson process in rank (so the same darts for every text that holds the
element); a dart beyond the element's weight misses. Each dart belongs to one of K coordinates and the earliest of each
coordinate is the signature: only darts up to a rank that fits the total weight are thrown, about K ln K in all,
however long the text. Two signatures agree in a coordinate with the probability of the weighted Jaccard similarity.

Texts with equal word sequences are one node. Nodes that share a band meet in a bucket; each bucket compares its members
with a pivot, by the exact similarity, and goes on with those that are not linked to it and four times as many pivots,
so that a bucket of copies costs about as many comparisons as it has members. What the pivots could miss - a link across two stars - is looked for afterwards, only where the
triangle inequality of the Jaccard distance leaves room for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytekit as bk
from .store import materialize, read, release, tidy

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
PIECE_BYTES = 1_000_000
#: Members of a block; open members of a bucket up to which pivots give way to comparing all of them.
BLOCK, OPEN = 256, 2048


def shingles(firsts: np.ndarray, h: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle (repeats included); a text of fewer words has one, of all its words."""
    n = len(firsts) - 1
    counts = np.diff(firsts)
    owner = np.repeat(np.arange(n), counts)
    salts = bk.mix(np.arange(1, size + 1, dtype=np.uint64))
    whole = max(len(h) - size + 1, 0)
    acc = np.zeros(whole, np.uint64)
    for j in range(size):
        acc += bk.mix(h[j : j + whole] + salts[j])
    ok = owner[:whole] == owner[size - 1 :] if whole else np.zeros(0, bool)
    few = np.flatnonzero((counts > 0) & (counts < size))
    short = np.zeros(len(few), np.uint64)
    for j in range(size - 1):
        more = counts[few] > j
        short[more] += bk.mix(h[firsts[few[more]] + j] + salts[j])
    return np.concatenate((owner[:whole][ok], few)), bk.mix(np.concatenate((acc[ok], short)))


def distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def counted(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of the distinct shingles of each text."""
    o, e = distinct(owner, h)
    both = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (owner[both][1:] != owner[both][:-1]) | (h[both][1:] != h[both][:-1])
    return o, e, np.diff(np.append(np.flatnonzero(new), len(h)))


def numbered(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and element of every shingle, the k-th repeat of one as an element of its own: sets of these have the weighted
    similarity (sum of the smaller counts by sum of the larger ones) of the shingles."""
    o, e, n = counted(owner, h)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    e = np.repeat(e, n)
    return np.repeat(o, n), np.where(k > 0, bk.mix(e + bk.mix(k.astype(np.uint64))), e)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def dart_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n x k, as bits of the earliest rank) of n weighted sets given as (set, element hash, weight > 0);
    elements are distinct within a set. An empty set has the largest value everywhere."""
    sig = np.full(n * k, np.iinfo(np.int64).max)
    total = np.bincount(owner, weight, n)
    cells = np.ceil(weight).astype(np.int64)
    owner, element, weight = (np.repeat(x, cells) for x in (owner, element, weight))
    begin = np.repeat(np.cumsum(cells) - cells, cells)
    cell = np.arange(len(owner)) - begin
    key = bk.mix(element + bk.mix(cell.astype(np.uint64)))
    room = np.minimum(weight - cell, 1.0)
    limit = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = total > 0
    low = np.zeros(n)
    while todo.any():  # a second turn, with twice the ranks, only for sets that left a coordinate empty
        mine = np.flatnonzero(todo[owner])
        rank, j = np.zeros(len(mine)), 0
        while len(mine):
            j += 1
            h = bk.mix(key[mine] + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            rank = rank - np.log(_uniform(h))
            inside = rank < limit[owner[mine]]
            mine, rank, h = mine[inside], rank[inside], bk.mix(h[inside])
            thrown = rank >= low[owner[mine]]
            hit = thrown & (_uniform(h) < room[mine])
            coordinate = (bk.mix(h[hit]) % np.uint64(k)).astype(np.int64)
            np.minimum.at(sig, owner[mine[hit]] * k + coordinate, rank[hit].view(np.int64))
        todo &= (sig.reshape(n, k) == np.iinfo(np.int64).max).any(axis=1)
        low, limit = limit, limit * 2
    return sig.reshape(n, k)


def _node_keys(data: np.ndarray, offsets: np.ndarray, firsts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """128 bits of each text's word sequence, or of its bytes if it has no words."""
    n = len(firsts) - 1
    counts = np.diff(firsts)
    place = np.arange(len(h)) - np.repeat(firsts[:-1], counts)
    up, _ = bk.POWERS.get(int(max(counts.max(initial=0), np.diff(offsets).max(initial=0))) + 1)
    out = np.zeros((n, 2), np.uint64)
    for c in range(2):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(bk.mix(h + np.uint64(c + 1)) * up[place])))
        out[:, c] = bk.mix(sums[firsts[1:]] - sums[firsts[:-1]] + counts.astype(np.uint64))
        bare = np.flatnonzero(counts == 0)
        if len(bare):
            p = bk.prefix(data, bk._TABLE if c else bk._TABLE2)
            out[bare, c] = ~bk.span_hash(p, offsets[bare], offsets[bare + 1])
    return out


def _read_pieces(batches: Iterator[pa.RecordBatch], text: int):
    for batch in batches:
        data, offsets = bk.binary(batch.column(text))
        for lo, hi in bk.pieces(offsets, PIECE_BYTES):
            part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            _, _, firsts, h = bk.word_hashes(part, off)
            yield batch.slice(lo, hi - lo), part, off, firsts, h


def _binary16(keys: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(keys.astype(">u8")).tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(raw)]).cast(pa.binary())


def signatures(docs: DataFrame, doc_id: str, text: str, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (of the word sequence), solid (has words) and bands (one hash each)."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off, firsts, h in _read_pieces(batches, 1):
            n = part.num_rows
            owner, element, weight = counted(*shingles(firsts, h, size))
            sig = dart_minhash(owner, element, weight.astype(float), n, bands * rows).astype(np.uint64).reshape(n, bands, rows)
            salts = bk.mix(np.arange(1, rows + 1, dtype=np.uint64))
            band = bk.mix(bk.mix(sig + salts).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
            solid = np.diff(firsts) > 0
            listed = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(solid * bands))).astype(np.int32), pa.array(band[solid].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), _binary16(_node_keys(data, off, firsts, h)), pa.array(np.diff(off) > 0), listed], names=["doc_id", "node", "filled", "bands"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, node binary, filled boolean, bands array<long>")


def shingle_sets(docs: DataFrame, text: str, size: int = SHINGLE) -> DataFrame:
    """node and set (shingles as numbered() has them) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off, firsts, h in _read_pieces(batches, 0):
            owner, element = numbered(*shingles(firsts, h, size))
            edges = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_binary16(_node_keys(data, off, firsts, h)), pa.ListArray.from_arrays(edges, pa.array(element.view(np.int64)))], names=["node", "set"])

    return docs.select(F.col(text).alias("_text_")).mapInArrow(run, "node binary, set array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node it is linked to, through any number of edges (a, b)).

    Labels spread along edges and then jump to their label's label; each round is written to the shared folder."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "cc-labels")
    while True:
        spread = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(spread, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialize(nearer.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), "cc-labels")
        changed = new.where("label <> old").limit(1).count()
        release(labels)
        labels = new
        if not changed:
            release(both)
            return labels.select("node", "label")


def verified(pairs: DataFrame, sets: DataFrame, at: float) -> DataFrame:
    """a, b, similarity of the pairs (a, b)."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity"))


def links_in_blocks(asking: DataFrame, asked: DataFrame, sets: DataFrame, at: float) -> DataFrame:
    """a, b, similarity of linked nodes of the same ``unit``: every asking one with every asked one, in blocks of both
    sides, so that no task holds a whole unit and only links come out. With a column ``d`` (distance to a common node)
    pairs that the triangle inequality rules out are left out."""
    count = lambda df, name: df.groupBy("unit").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias(name))
    blocks = count(asking, "m").join(count(asked, "n"), "unit")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    d = [c for c in asking.columns if c == "d"]
    columns = ["unit", "i", "j", "node", "set", *d]
    left = asking.join(blocks, "unit").withColumn("i", own("m")).withColumn("j", every("n")).join(sets, "node").select([F.col(c).alias(f"x_{c}") for c in columns])
    right = asked.join(blocks, "unit").withColumn("j", own("n")).withColumn("i", every("m")).join(sets, "node").select([F.col(c).alias(f"y_{c}") for c in columns])

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = {"a": [], "b": [], "similarity": []}
        x, y = (t.rename(columns=lambda c: c[2:]) for t in (x, y))
        if len(x) and len(y):
            size = np.array([len(v) for v in y["set"]])
            flat = np.concatenate(y["set"].to_list())
            heads = np.cumsum(size) - size
            names = y["node"].to_list()
            for k, (node, mine) in enumerate(zip(x["node"], x["set"], strict=True)):
                mine = np.sort(mine)  # the hashes were sorted as unsigned numbers
                place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                common = np.add.reduceat((mine[place] == flat).astype(np.int64), heads)
                similar = common / (size + len(mine) - common)
                ok = similar >= at
                if d:
                    ok &= np.abs(y["d"].to_numpy() - x["d"].iloc[k]) <= 1 - at + 1e-9
                for j in np.flatnonzero(ok).tolist():
                    if names[j] != node:
                        out["a"].append(max(node, names[j]))
                        out["b"].append(min(node, names[j]))
                        out["similarity"].append(float(similar[j]))
        return pd.DataFrame(out).drop_duplicates(["a", "b"])

    keys = lambda side: [f"{side}_{c}" for c in ("unit", "i", "j")]
    return left.groupBy(*keys("x")).cogroup(right.groupBy(*keys("y"))).applyInPandas(compare, "a binary, b binary, similarity double").dropDuplicates(["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, at: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (smallest non-null doc_id of the class) and class_docs (rows in the class), one row per row of ``docs``.

    Words are maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased. A text of one to four words is one
    shingle. Texts without words match only texts of the same bytes; null and empty texts match none. Rows that repeat
    are copies of one another. A row with null id has the class of its text; a class (or a single row) of null ids only has a null
    class_id. Candidates agree in one of ``bands`` bands (a pair of similarity 0.8 is missed with probability 7e-5);
    every link is verified by the exact similarity. Shingles weigh as often as they occur: the similarity of two texts is
    the sum of the smaller counts by the sum of the larger ones.
    """
    sig = materialize(signatures(docs, doc_id, text, size, bands, rows), "near-signatures")
    members = sig.where("size(bands) > 0").select("node", F.posexplode("bands").alias("band", "h")).groupBy("band", "h", "node").agg(F.lit(1).alias("one"))
    crowd = members.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1")
    active = members.join(crowd, ["band", "h"]).select("band", "h", "node", "n")
    central = active.groupBy("node").agg(F.sum("n").alias("degree"))  # nodes that share most come first as pivots
    active = materialize(active.join(central, "node").select("band", "h", "node", "degree"), "near-buckets")
    wanted = active.select("node").distinct()
    rep = sig.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text_")).join(rep.select("doc_id").distinct(), "doc_id", "left_semi")
    lonely = sig.where("doc_id is null").select("node").join(wanted, "node", "left_semi").limit(1).count()
    if lonely:  # texts that only rows without an id hold
        texts = texts.unionByName(docs.where(F.col(doc_id).isNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text_")))
    sets = materialize(shingle_sets(texts, "_text_", size).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")), "near-sets")
    found: list[DataFrame] = []
    pivots = 1
    while True:
        place = Window.partitionBy("band", "h").orderBy(F.desc("degree"), "node")
        ranked = materialize(active.withColumn("rank", F.row_number().over(place)), "near-ranked")
        release(active)
        heads = ranked.where(F.col("rank") <= pivots).select("band", "h", F.col("node").alias("pivot"), F.col("rank").alias("head"))
        meet = ranked.join(heads, ["band", "h"]).where("head < rank")
        pairs = meet.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
        fresh = tidy(materialize(verified(pairs, sets, at).where(F.col("similarity") >= 2 * at - 1 - 1e-9), "near-pairs"))
        found.append(fresh)  # pairs that met in an earlier round are looked at again: cheaper than a plan that grows by all rounds
        rest = ranked.where(F.col("rank") > pivots)
        if not rest.limit(1).count():
            break
        link = fresh.where(F.col("similarity") >= at).select("a", "b")
        either = link.select(F.col("a").alias("node"), F.col("b").alias("pivot")).union(link.select(F.col("b").alias("node"), F.col("a").alias("pivot")))
        settled = meet.where(F.col("rank") > pivots).join(either, ["node", "pivot"], "left_semi").select("band", "h", "node").distinct()
        left = rest.join(settled, ["band", "h", "node"], "left_anti")
        several = left.groupBy("band", "h").count().where("count > 1")
        active = materialize(left.join(several, ["band", "h"], "left_semi").select("band", "h", "node", "degree"), "near-buckets")
        release(ranked)
        pivots *= 4
        largest = active.groupBy("band", "h").count().agg(F.max("count")).first()[0]
        if largest is None:
            break
        if pivots > 4 and largest <= OPEN:  # few are left, none linked to a pivot: all of them with all, within the tasks
            rest = active.select(F.concat_ws(":", "band", "h").alias("unit"), "node").distinct()
            found.append(materialize(links_in_blocks(rest, rest, sets, at), "near-pairs"))
            break
    edges = tidy(materialize(reduce(DataFrame.unionByName, found).dropDuplicates(["a", "b"]), "near-edges"))
    for df in found:
        release(df)
    links = edges.where(F.col("similarity") >= at).select("a", "b")
    labels = components(links)
    if edges.where((F.col("similarity") < at) & (F.col("similarity") >= 2 * at - 1 - 1e-9)).limit(1).count():
        # y is no neighbour of pivot p but near enough to be one of x, a neighbour of p: d(x, y) >= d(y, p) - d(x, p)
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        near = edges.where((F.col("similarity") < at) & (F.col("similarity") >= 2 * at - 1 - 1e-9)).select(F.col("a").alias("y"), F.col("b").alias("p"), (1 - F.col("similarity")).alias("dy"))
        near = near.union(near.select(F.col("p").alias("y"), F.col("y").alias("p"), "dy"))
        near = near.join(of("y"), "y", "left").join(of("p"), "p").where("y_label is null or y_label <> p_label")
        star = edges.where(F.col("similarity") >= at).select("a", "b", (1 - F.col("similarity")).alias("dx"))
        star = star.select(F.col("a").alias("x"), F.col("b").alias("p"), "dx").union(star.select(F.col("b").alias("x"), F.col("a").alias("p"), "dx"))
        ask = near.select(F.hex("p").alias("unit"), F.col("y").alias("node"), F.col("dy").alias("d"))
        asked = star.join(near.select("p").distinct(), "p", "left_semi").select(F.hex("p").alias("unit"), F.col("x").alias("node"), F.col("dx").alias("d"))
        more = materialize(links_in_blocks(ask, asked, sets, at), "near-pairs")
        if more.limit(1).count():
            labels = components(links.unionByName(more.select("a", "b")))
    release(sets)
    node = F.when(F.col("filled"), F.col("node")).otherwise(F.lit(None))
    known = sig.select("doc_id", node.alias("node"))
    full = known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = full.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_docs"))
    classed = full.select("node", "label").join(classes, "label").select("node", "class_id", "class_docs")
    out = known.where("node is not null").join(classed, "node").select("doc_id", "class_id", "class_docs")
    return out.unionByName(known.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_docs")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
