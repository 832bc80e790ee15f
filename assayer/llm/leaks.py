"""Benchmark decontamination with a distributed positional inverted index.

The index is written once as a table and partitioned by documents: a segment is a block of texts, a row of the table is
one term of one segment with its sorted positions, so a frequent word is many rows and never one group. The windows of
the benchmark are a table as well. Their terms are ranked by their number in the corpus; a window goes only to the
segments that hold its rarest term, where the positions of that term, moved back by its offset, are intersected with
the moved lists of the next rarer terms until none or only occurrences are left. Proximity matches take the terms in
order with a bounded number of words between. Neither texts nor benchmark pass through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit as bk
from .store import materialize, read, release

WINDOW = 10
#: Foreign words that a proximity match of op6_decontaminate may hold.
SLACK = 2
SEGMENT_BYTES = 16_000_000
PIECE_BYTES = 1_000_000
#: Rows of an Arrow batch that the tasks give back.
BATCH = 10_000
#: Windows that one task searches in a segment; more of them are dealt into blocks.
WINDOWS = 200_000

RESULTS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "n_near")


class Segment:
    """Positional index of a block of texts. Documents lie one gap apart, so no phrase crosses."""

    def __init__(self, terms: np.ndarray, lists: list[np.ndarray]) -> None:
        order = np.argsort(terms)
        self.terms, self.lists = terms[order], [lists[k] for k in order]
        self.counts = np.array([len(at) for at in self.lists], np.int64)

    def numbers(self, window: np.ndarray) -> np.ndarray | None:
        """Where the terms of a window stand in the index; None where one is missing."""
        at = np.minimum(np.searchsorted(self.terms, window), len(self.terms) - 1)
        return at if len(self.terms) and (self.terms[at] == window).all() else None

    def phrase(self, window: np.ndarray) -> np.ndarray:
        """Start positions of exact occurrences."""
        order = np.argsort(self.counts[window], kind="stable")
        found = self.lists[window[order[0]]] - order[0]
        for k in order[1:]:
            if not len(found):
                break
            other = self.lists[window[k]]
            at = np.minimum(np.searchsorted(other, found + k), len(other) - 1)
            found = found[other[at] == found + k]
        return found

    def near(self, window: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last position of the matches of the terms in order with at most ``slack`` foreign words between: the
        shortest one from each place of the first term. Only places near the rarest term are tried."""
        rare = int(np.argmin(self.counts[window]))
        found, anchors = self.lists[window[0]], self.lists[window[rare]]
        if rare:
            tried = np.unique((anchors[:, None] - rare - np.arange(slack + 1)).ravel())
            found = tried[found[np.minimum(np.searchsorted(found, tried), len(found) - 1)] == tried]
        reach = found
        for k, term in enumerate(window[1:], 1):
            if not len(found):
                break
            other = self.lists[term]
            at = np.searchsorted(other, reach, "right")
            ok = at < len(other)
            found, reach = found[ok], other[at[ok]]
            ok = reach - found <= k + slack
            found, reach = found[ok], reach[ok]
        return found, reach


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words of every text."""
    ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in bk.pieces(offsets, PIECE_BYTES):
        _, _, first, h = bk.word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        ids.append(h.view(np.int64))
        counts.append(np.diff(first))
    return np.concatenate(ids), np.concatenate(counts)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs`` (text first, columns to carry behind): for every segment one row per term (``term``,
    ``n``, ``at``), one row per text (``row``, its words as ``n``, the carried columns) and one frame with the first
    position of every text. Segments have random numbers; all rows of one are written by one task."""
    carried = docs.columns[1:]
    # many small files would make many small segments, each with most of the vocabulary
    total = docs.select(F.sum(F.octet_length(docs.columns[0]))).first()[0] or 0
    docs = docs.coalesce(max(-(-total // SEGMENT_BYTES), docs.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seg: int, size: int, kinds: list[pa.DataType], **given) -> pa.RecordBatch:
            columns = {"seg": np.full(size, seg, np.int64), "row": pa.nulls(size, pa.int32()), "term": pa.nulls(size, pa.int64()), "n": pa.nulls(size, pa.int64()), "at": pa.nulls(size, pa.binary())}
            columns |= {c: pa.nulls(size, kind) for c, kind in zip(carried, kinds, strict=True)} | given
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            seg, kinds = int.from_bytes(os.urandom(8), "little") >> 1, [f.type for f in table.schema][1:]
            ids, counts = word_ids(*bk.binary(table.column(0)))
            order = np.argsort(ids, kind="stable")
            at = (order + np.repeat(np.arange(len(counts)), counts)[order]).astype("<i4")
            ids = ids[order]
            edges = np.concatenate((np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)), [len(ids)])) if len(ids) else np.zeros(1, np.int64)
            for lo in range(0, len(edges) - 1, BATCH):
                cut = edges[lo : lo + BATCH + 1]
                lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer((cut - cut[0]) * 4), pa.py_buffer(at[cut[0] : cut[-1]].tobytes())])
                yield rows(seg, len(cut) - 1, kinds, term=ids[cut[:-1]], n=np.diff(cut), at=lists.cast(pa.binary()))
            firsts = np.concatenate(([0], np.cumsum(counts))) + np.arange(len(counts) + 1)
            yield rows(seg, 1, kinds, at=pa.array([firsts.astype("<i4").tobytes()], pa.binary()))
            yield rows(seg, len(counts), kinds, row=np.arange(len(counts), dtype=np.int32), n=counts, **{c: table.column(1 + k) for k, c in enumerate(carried)})

        held, size_held = [], 0
        for batch in batches:
            _, offsets = bk.binary(batch.column(0))
            for lo, hi in bk.pieces(offsets, SEGMENT_BYTES // 4):
                held.append(batch.slice(lo, hi - lo))
                size_held += int(offsets[hi] - offsets[lo])
                if size_held >= SEGMENT_BYTES:
                    yield from flush(held)
                    held, size_held = [], 0
        if held:
            yield from flush(held)

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return materialize(docs.mapInArrow(run, f"seg long, row int, term long, n long, at binary{kinds}"), "leaks-index")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """The windows of every item: their terms, a hash of these as ``window``, and the item's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = word_ids(*bk.binary(batch.column(1)))
            ends = np.cumsum(counts)
            for k, (lo, hi) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                if lo == hi:
                    continue
                views = np.lib.stride_tricks.sliding_window_view(ids[lo:hi], min(size, hi - lo))
                for some in range(0, len(views), BATCH):
                    part = views[some : some + BATCH]
                    terms = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(part), pa.string()), terms], names=["item", "terms"])

    return items.mapInArrow(run, "item string, terms array<long>").distinct().withColumn("window", F.xxhash64("terms"))


def search(left: pa.Table, right: pa.Table, slack: int | None) -> pa.Table:
    """Occurrences of windows (``right``) in a segment (``left``: its lists and frame): a row per text that has any."""
    kinds = pa.schema([("seg", pa.int64()), ("row", pa.int32()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), ("near", pa.int64()), ("windows", pa.list_(pa.int64()))])
    if not right.num_rows:
        return kinds.empty_table()
    lists = {t: np.frombuffer(at, "<i4") for t, at in zip(left["term"].to_pylist(), left["at"].to_pylist(), strict=True)}
    firsts = lists.pop(None).astype(np.int64)
    index = Segment(np.array(list(lists), np.int64), [at.astype(np.int64) for at in lists.values()])
    edge, near, held = np.zeros(firsts[-1] + 1, np.int32), np.zeros(len(firsts) - 1, np.int64), {}
    text_of = lambda at: np.searchsorted(firsts, at, "right") - 1
    for name, terms in zip(right["window"].to_pylist(), right["terms"].to_pylist(), strict=True):
        window = index.numbers(np.array(terms, np.int64))
        if window is None:
            continue
        starts = index.phrase(window)
        if len(starts):
            np.add.at(edge, starts, 1)
            np.subtract.at(edge, starts + len(window), 1)
            for d in np.unique(text_of(starts)).tolist():
                held.setdefault(d, []).append(name)
        if slack is not None:
            at, last = index.near(window, slack)
            inside = text_of(at)
            np.add.at(near, inside[inside == text_of(last)], 1)
    turns = np.flatnonzero(np.diff(np.cumsum(edge) > 0, prepend=False, append=False))
    lo, hi = turns[::2], turns[1::2]
    found = np.union1d(np.flatnonzero(near), np.array(list(held), np.int64)).astype(np.int64)
    at = np.searchsorted(lo, firsts)
    spans = [[{"lo": a, "hi": b} for a, b in zip(lo[at[d] : at[d + 1]].tolist(), hi[at[d] : at[d + 1]].tolist(), strict=True)] for d in found.tolist()]
    columns = [np.full(len(found), left["seg"][0].as_py(), np.int64), found.astype(np.int32), spans, near[found], [held.get(d, []) for d in found.tolist()]]
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds.types, strict=True)], schema=kinds)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, slack: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items (ids, sorted as strings);
    ``carry`` columns stay, but for those with a result's name; with ``slack`` also n_near, the proximity matches of windows.

    Null texts have no words; items without words never occur; equal item ids count once. An item
    without id counts in n_hit, n_near and contaminated, not in n_items, the digest and items. Repeated rows, null ids and
    extra columns are kept apart; empty tables give an empty or clean result. A text above SEGMENT_BYTES is a segment of
    its own. ``docs`` is read twice, for its size and for the index; the result reads the written index, which also holds
    the carried columns.
    """
    carry = tuple(c for c in dict.fromkeys(carry) if c not in (doc_id, *RESULTS))
    kept = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id"), *(F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry)))
    index = build_index(kept)
    listed = materialize(windows_of(items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")), size), "leaks-windows")

    windows = listed.select("window", "terms").dropDuplicates(["window"])
    places = windows.select("window", "terms", F.explode(F.array_distinct("terms")).alias("term"))
    lists = index.where("term is not null").select("seg", "term", "n", "at")
    counts = lists.join(places.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("total"))
    # a window with a term that the corpus lacks can't occur
    ranked = places.join(counts, "term").groupBy("window").agg(F.first("terms").alias("terms"), F.count("*").alias("known"), F.min(F.struct("total", "term"))["term"].alias("term"))
    ranked = materialize(ranked.where("known = size(array_distinct(terms))").drop("known"), "leaks-ranked")

    blocks = max(1, -(-ranked.count() // WINDOWS))
    routed = ranked.join(lists.select("seg", "term"), "term").select(F.col("seg").alias("into"), F.pmod("window", F.lit(blocks)).cast("int").alias("block"), "window", "terms")
    needed = lists.join(ranked.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").select("seg", "term", "at")
    frames = index.where("term is null and row is null").select("seg", "term", "at")
    dealt = needed.unionByName(frames).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = "seg long, row int, spans array<struct<lo: int, hi: int>>, near long, windows array<long>"
    found = dealt.groupBy("seg", "block").cogroup(routed.groupBy("into", "block")).applyInArrow(lambda a, b: search(a, b, slack), kind)
    found = materialize(found, "leaks-found")
    release(ranked)

    # spans of different blocks may overlap: the length of their union
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    step = lambda seen, x: F.struct(F.greatest(seen["end"], x["hi"]).alias("end"), (seen["sum"] + F.greatest(F.lit(0), x["hi"] - F.greatest(seen["end"], x["lo"]))).alias("sum"))
    hits = found.groupBy("seg", "row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.sum("near").alias("near"))
    hits = hits.select("seg", "row", F.aggregate("spans", start, step, lambda seen: seen["sum"]).alias("hit"), "near")
    named = found.select("seg", "row", F.explode("windows").alias("window")).join(listed.where("item is not null").select("window", "item"), "window")
    named = named.select("seg", "row", "item").distinct().groupBy("seg", "row").agg(F.sort_array(F.collect_list("item")).alias("ids"))
    texts = index.where("row is not null").drop("term", "at")
    n_hit, ids = F.coalesce("hit", F.lit(0).cast("long")), F.coalesce("ids", F.array().cast("array<string>"))
    columns = [F.col("_id").alias("doc_id"), F.col("n").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), ids.alias("items")]
    columns += [] if slack is None else [F.coalesce("near", F.lit(0).cast("long")).alias("n_near")]
    columns += [F.col(f"_carry{k}").alias(c) for k, c in enumerate(carry)]
    return texts.join(hits.join(named, ["seg", "row"], "left"), ["seg", "row"], "left").select(*columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slack=SLACK).drop("items")
