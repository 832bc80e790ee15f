"""Suffix-array deduplication of long repeats across documents.

Every start of a window (the ``length`` bytes that must repeat) selects the earliest smallest hash of the K-byte strings
inside its window: its anchor. Equal windows have equal anchors at the same place, so starts only need to be compared
within an anchor's group. Consecutive starts with one anchor are a segment.

1. Count segments by (anchor, content). A content that occurs twice is repeated as a whole; an anchor with several
   contents is open.
2. One copy of each content of an open anchor is fetched and meets the others of its group. Blocks of whole groups are
   sorted as suffix arrays in two stages, and adjacent common prefixes of ``length`` mark their starts. Groups that no
   block can hold are first cut into slices of starts, grouped anew by the bytes that all windows of a slice share, for
   which a digest stands from then on. Equal slices repeat as a whole and go on as one; the last are single windows.
3. Marked starts go back to every document that holds the segment; the bytes they cover are removed.

Two lengths are found in one go: a long repeat lies within the ranges that short repeats cover, so its search needs to
read only those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit as bk
from .store import materialize, read, release, tidy
from .suffixes import common_prefixes, suffix_array

LENGTH = 400
#: A passage: bytes that every text of more than 50 words has (51 words of the documents here have 245 or more), and words.
PASSAGE_BYTES, PASSAGE_WORDS = 240, 51
GRAM = 48
PIECE_BYTES = 1 << 20
#: The largest block; groups are put together up to FILL_BYTES only, as smaller blocks are sorted faster for each byte.
BLOCK_BYTES, FILL_BYTES = 2_000_000, 500_000
#: Groups of more contents than this, or of more bytes than a block, are cut into slices of so many starts.
CROWD, SLICES = 1 << 14, (64, 8, 1)
#: Bytes of the digest that stands for what all windows of a slice share (hex, as a block needs bytes of UTF-8).
DIGEST = 32


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of all segments of some texts: row, begin and end (of starts, within the row), distance from the first start to the
    anchor, anchor hash and two content hashes."""
    n, total = len(offsets) - 1, int(offsets[-1])
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 3
    size = np.diff(offsets)
    if total < length or size.max(initial=0) < length:
        return none
    one, two = bk.prefix(data), bk.prefix(data, bk._TABLE2)
    grams = np.arange(total - gram + 1)
    width = length - gram + 1
    bits = max(int(total - 1).bit_length(), 1)
    low = np.uint64((1 << bits) - 1)
    h = bk.span_hash(one, grams, grams + gram)
    least = h & ~low | grams.astype(np.uint64)  # the earliest of equals
    done = 1
    while done < width:  # minimum over a window that doubles
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    starts = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(n), starts)
    start = np.arange(len(row)) + np.repeat(offsets[:-1] - np.cumsum(starts) + starts, starts)
    where = (least[start] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (where[1:] != where[:-1]))))
    last = np.append(first[1:], len(row)) - 1
    lo, hi, own, anchor = start[first], start[last] + 1, row[first], where[first]
    # the anchor's place in the segment belongs to the content
    shift = (anchor - lo).astype(np.uint64)
    a, b = bk.span_hash(one, lo, hi - 1 + length), bk.span_hash(two, lo, hi - 1 + length)
    return own, lo - offsets[own], hi - offsets[own], anchor - lo, h[anchor], bk.mix(a + shift), bk.mix(b + shift)


def _parts(batches: Iterator[pa.RecordBatch], column: int, overlap: int):
    """Pieces of texts with the offset of each in its row; a very long text comes in pieces that overlap by a window."""
    for batch in batches:
        data, offsets = bk.binary(batch.column(column))
        for lo, hi in bk.pieces(offsets, PIECE_BYTES):
            size = int(offsets[hi] - offsets[lo])
            if size <= 4 * PIECE_BYTES:
                yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], 0
            else:
                for at in range(0, size, PIECE_BYTES):
                    part = data[offsets[lo] + at : min(offsets[lo] + at + PIECE_BYTES + overlap, offsets[hi])]
                    yield batch.slice(lo, 1), part, np.array([0, len(part)]), at


def _keyed(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a key; equal rows (id and text) share it, and get the same result."""
    bytes_ = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(doc_id).alias("_id_"), *(F.col(c).alias(f"_c_{c}") for c in carry), bytes_.alias("_text_"), F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary"), F.lit(b"\x00"), bytes_))).alias("_key_"))


def _window_segments(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets, at in _parts(batches, 1, length - 1):
            row, lo, hi, shift, anchor, a, b = segments(data, offsets, length)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(lo + at), pa.array((hi - lo).astype(np.int32)), pa.array(shift.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (anchor, a, b))], names=["_key_", "lo", "n", "shift", "anchor", "a", "b"])

    return keyed.select("_key_", "_text_").mapInArrow(run, "_key_ binary, lo long, n int, shift int, anchor long, a long, b long")


#: A content (or a slice of it from start ``at`` on) in its group; ``shift`` is the distance from its first start to the anchor.
_ROWS = "group binary, a long, b long, at int, shift int, bytes binary"
_COLUMNS = [c.split()[0] for c in _ROWS.split(", ")]


def _slices(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Cuts rows where the distance to the anchor is a multiple of ``width``. The digest of what all windows of a slice
    share is its group and its new anchor, and stands in its bytes: windows are ``width - 1 + DIGEST`` long from here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for group, a, b, at, shift, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, i = len(raw) - length + 1, 0
                while i < n:
                    far = shift - i  # distance of start i; those down to near share a slice
                    near = far // width * width
                    end = min(i + far - near + 1, n)
                    # all windows at distances near to near + width - 1 hold these bytes
                    lo, hi = shift - near, shift - near - width + 1 + length
                    key = hashlib.md5(group + near.to_bytes(4, "big") + raw[lo:hi]).hexdigest().encode()
                    out.append((key, a, b, at + i, far - near, raw[i:lo] + key + raw[hi : end - 1 + length]))
                    i = end
                    if len(out) >= 4096:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    return rows.mapInArrow(run, _ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["group", "a", "b", "at", "shift", "bytes"])


def mark_block(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Per text, which starts have a window that occurs at another start of these texts too."""
    symbols = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)  # 0xFF is in no UTF-8
    symbols = np.where(symbols == 0xFF, 1, np.minimum(symbols.astype(np.int16) + 2, 254)).astype(np.uint8)
    sa = suffix_array(symbols)
    plcp = common_prefixes(symbols, sa)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size + 1) - size - 1
    room = np.repeat(begin + size, size + 1) - np.arange(len(symbols))
    # neither window of a common prefix that begins in one text's room has an end mark in it
    long = np.flatnonzero((plcp >= length) & (room >= length))
    before = np.zeros(len(symbols), np.int64)
    before[sa[1:]] = sa[:-1]
    mark = np.zeros(len(symbols), bool)
    mark[long] = True
    mark[before[long]] = True
    return [mark[b : b + max(s - length + 1, 0)] for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


def _runs(mark: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0])))).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def _mark(rows: DataFrame, length: int) -> DataFrame:
    """a, b, lo, hi: runs of starts (within the content) that occur elsewhere in their group. ``rows`` (with ``weight``,
    the bytes of their group) has to be a written table: behind a join on the group Spark would leave the repartition
    out, and then split a large group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            marks = mark_block([raw for _, raw in kept], length)
            out = []
            for a, b, at, key in names:
                k, seen = kept[key]
                mark = marks[k] if seen == 1 else np.ones(len(marks[k]), bool)
                out += [(a, b, at + lo, at + hi) for lo, hi in _runs(mark)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["a", "b", "lo", "hi"])

        kept: dict[tuple[bytes, bytes], list[int]] = {}  # equal contents of a group stand once, with their number
        names, size, last = [], 0, None
        for batch in batches:
            for group, a, b, at, _, raw, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if names and group != last and size + weight > FILL_BYTES:
                    yield flush()
                    kept, names, size = {}, [], 0
                last = group
                if (group, raw) not in kept:
                    kept[group, raw] = [len(kept), 0]
                    size += len(raw)
                kept[group, raw][1] += 1
                names.append((a, b, at, (group, raw)))
        if names:
            yield flush()

    return rows.select(*_COLUMNS, "weight").repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long, lo int, hi int")


def _crowds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose group fits a block, and those that have to be cut."""
    fits = (F.col("kinds") <= CROWD) & (F.col("weight") <= BLOCK_BYTES)
    return rows.where(fits), rows.where(~fits).select(*_COLUMNS)


def repeated_ranges(keyed: DataFrame, length: int) -> DataFrame:
    """_key_ and covered: ranges of bytes (begin, end) that a repeated window covers. Written; its helpers are deleted."""
    segs = materialize(_window_segments(keyed, length), "repeat-segments")
    # most anchors stand once: only numbers are shuffled to find that out; a left join, so one row for each segment
    often = materialize(segs.groupBy("anchor").agg(F.count("*").alias("often")).where("often > 1"), "repeat-often")  # written, so that a hot anchor's side can be split
    asked = segs.join(often, "anchor", "left").where(F.coalesce("often", F.least(F.col("lo"), F.lit(0))) > 1).drop("often")
    asked = tidy(materialize(asked, "repeat-asked"))
    contents = asked.groupBy("anchor", "a", "b").agg(F.count("*").alias("n"), F.min(F.struct("_key_", "lo", F.col("n").alias("starts"), "shift")).alias("one"))
    kinds = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("one.starts") + length - 1).alias("weight"))
    shared = tidy(materialize(contents.join(kinds, "anchor"), "repeat-contents"))
    release(asked)
    # one copy of every content that has to be compared; those that repeat as a whole are partners of the others
    fetch = shared.where("kinds > 1").select("one.*", "anchor", "a", "b", "kinds", "weight")
    by_text = fetch.groupBy("_key_").agg(F.collect_list(F.struct("lo", "starts", "shift", "anchor", "a", "b", "kinds", "weight")).alias("want"))
    one = keyed.select("_key_", "_text_").join(by_text, "_key_").select("_text_", F.explode("want").alias("w"))
    raw = F.col("_text_").substr((F.col("w.lo") + 1).cast("int"), F.col("w.starts") + length - 1)
    open_ = one.select(F.col("w.anchor").cast("string").cast("binary").alias("group"), "w.a", "w.b", F.lit(0).alias("at"), "w.shift", raw.alias("bytes"), "w.kinds", "w.weight")
    rows = tidy(materialize(open_.dropDuplicates(["a", "b"]), "repeat-open"))
    used = [segs, often, shared, rows]
    block, level = _crowds(rows)
    found, window = materialize(_mark(block, length), "repeat-marks"), length
    used.append(found)
    for width in SLICES:
        if not level.limit(1).count():
            break
        cut = materialize(_slices(level, width, window), "repeat-slices")
        window = width - 1 + DIGEST
        # the bytes of a slice tell its group; of equal ones, all repeated as a whole, one goes on as partner of the others
        equal = materialize(cut.groupBy("bytes").agg(F.count("*").alias("n"), F.min(F.struct("group", "a", "b", "at", "shift")).alias("one")), "repeat-kinds")
        kinds = equal.select("bytes", "one.*")
        sizes = kinds.groupBy("group").agg(F.count("*").alias("kinds"), F.sum(F.length("bytes")).alias("weight")).where("kinds > 1")
        sized = materialize(kinds.join(sizes, "group"), "repeat-sized")
        block, level = _crowds(sized)
        marks = materialize(_mark(block, window), "repeat-marks")
        whole = cut.join(equal.where("n > 1").select("bytes"), "bytes").select("a", "b", F.col("at").alias("lo"), (F.col("at") + F.length("bytes") - window + 1).alias("hi"))
        found = found.unionByName(marks).unionByName(whole)
        used += [cut, equal, sized, marks]
    runs = content_runs(shared, found)
    # a left join on contents that are unique in ``runs``: one row for each segment, whatever repeats
    joined = segs.select("_key_", "lo", "a", "b").join(runs, ["a", "b"], "left")
    hit = joined.where(F.coalesce(F.size("runs"), F.least(F.col("lo"), F.lit(0))) > 0).dropDuplicates(["_key_", "lo", "a", "b"])
    each = F.transform("runs", lambda r: F.struct((F.col("lo") + r.lo).alias("begin"), (F.col("lo") + r.hi - 1 + length).alias("end")))
    covered = materialize(hit.groupBy("_key_").agg(F.flatten(F.collect_list(each)).alias("covered")), "repeat-covered")
    for df in used:
        release(df)
    return covered


def content_runs(shared: DataFrame, found: DataFrame) -> DataFrame:
    """a, b (unique) and runs of repeated starts: all starts of a content that occurs twice, else those marked."""
    whole = F.when(F.max("n") > 1, F.array(F.struct(F.lit(0).alias("lo"), F.max("starts").alias("hi"))))
    both = shared.select("a", "b", "n", F.col("one.starts").alias("starts"), F.lit(None).cast("struct<lo:int,hi:int>").alias("run"))
    both = both.unionByName(found.select("a", "b", F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("starts"), F.struct("lo", "hi").alias("run")))
    return both.groupBy("a", "b").agg(F.coalesce(whole, F.collect_list("run")).alias("runs")).where("size(runs) > 0")


def _merged(begins: list[int] | None, ends: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the ranges cover; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(zip(begins or (), ends or (), strict=True)):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _words(raw: bytes, begin: int, end: int) -> int:
    """Words (between blanks) that lie within a run as a whole."""
    inside = len(raw[begin:end].split())
    torn_head = begin > 0 and not raw[begin - 1 : begin].isspace() and not raw[begin : begin + 1].isspace()
    torn_tail = end < len(raw) and not raw[end - 1 : end].isspace() and not raw[end : end + 1].isspace()
    return inside - torn_head - torn_tail


_RANGES = "begins array<long>, ends array<long>"
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def _split(ranges: str) -> list:
    return [F.transform(ranges, lambda r: r.begin).alias("begins"), F.transform(ranges, lambda r: r.end).alias("ends")]


def _fragments(runs: DataFrame, length: int) -> DataFrame:
    """The ranges of ``length`` bytes or more as texts of their own, keyed by text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, texts = [], []
                for key, raw, begins, ends in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    for b, e in zip(begins, ends, strict=True):
                        if e - b >= length:
                            keys.append(key + b.to_bytes(8, "big"))
                            texts.append(raw[b:e])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], names=["_key_", "_text_"])

    return runs.select("_key_", "_text_", "begins", "ends").mapInArrow(run, "_key_ binary, _text_ binary")


def dedupe_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_kept: bool = False, carry: tuple[str, ...] = (), words: int = 0, passage: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row, with ``carry`` columns before and, if asked
    for, the kept text (``kept``; a character cut in two goes) behind.

    A byte goes if some window of ``length`` bytes over it also starts anywhere else, in this or another row; with
    ``words`` only in runs of so many whole words. ``passage`` (bytes not above ``length``, words) also counts such runs,
    without removing them: n_passages and n_passage_bytes. Null texts are empty, shorter ones keep all. Rows that repeat
    an id and a text are texts of their own that repeat each other. Text is cut by bytes, so a kept rest can begin inside
    a character. A carried column with a result's name is left out. An empty table gives an empty result; texts of any
    length are read in pieces that overlap by a window.
    """
    counts = ("n_passages", "n_passage_bytes") if passage else ()
    carry = tuple(c for c in dict.fromkeys(carry) if c not in (doc_id, text, *RESULTS, *counts, "kept"))
    if passage and passage[0] > length:
        raise ValueError("a passage is not longer than a removed repeat")
    short, least = passage or (length, words)
    keyed, more = _keyed(docs, doc_id, text), _keyed(docs, doc_id, text, carry)
    names = ["_id_", *(f"_c_{c}" for c in carry)]
    own = [F.col(c) for c in names]
    # rows without repeats are judged at once; of the others the text goes on
    both = more.join(repeated_ranges(keyed, short), "_key_", "left").select(*own, "_key_", "_text_", *_split("covered"))
    n_own = len(names)
    fields = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in names)

    def judge(min_words: int, passages: bool):
        """Takes own columns, key, text, ranges (and passages); gives own columns and results."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    out: list[tuple] = []
                    for raw, begins, ends in zip(*(c.to_pylist() for c in part.columns[n_own + 1 : n_own + 4]), strict=True):
                        spans = [(b, e) for b, e in _merged(begins, ends) if not min_words or _words(raw, b, e) >= min_words]
                        edges = [0, *(x for s in spans for x in s), len(raw)]
                        rest = b"".join(raw[b:e] for b, e in zip(edges[::2], edges[1::2], strict=True))
                        out.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_kept else None))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    results = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
                    yield pa.RecordBatch.from_arrays([*part.columns[:n_own], *(part.columns[n_own + 4 :] if passages else ()), *results[: 4 + with_kept]], names=out_names)

        out_names = [*names, *(counts if passages else ()), *RESULTS, *(["kept"] if with_kept else [])]
        kinds = "".join(f", {c} long" for c in counts if passages) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_kept else "")
        return run, fields + kinds

    if passage:
        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    out = []
                    for raw, begins, ends in zip(*(c.to_pylist() for c in part.columns[n_own + 1 :]), strict=True):
                        spans = _merged(begins, ends)
                        long = [s for s in spans if _words(raw, *s) >= least]
                        out.append(([b for b, _ in spans], [e for _, e in spans], len(long), sum(e - b for b, e in long)))
                    kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
                    results = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
                    yield pa.RecordBatch.from_arrays([*part.columns[: n_own + 2], *results], names=[*names, "_key_", "_text_", "begins", "ends", *counts])

        marked = materialize(both.mapInArrow(mark, f"{fields}, _key_ binary, _text_ binary, {_RANGES}, n_passages long, n_passage_bytes long"), "repeat-runs")
        fragments = _fragments(marked, length)
        found = repeated_ranges(fragments, length)
        found = found.select(F.substring("_key_", 1, 16).alias("key"), F.conv(F.hex(F.substring("_key_", 17, 8)), 16, 10).cast("long").alias("place"), "covered")
        found = found.select(F.col("key").alias("_key_"), F.transform("covered", lambda r: F.struct((r.begin + F.col("place")).alias("begin"), (r.end + F.col("place")).alias("end"))).alias("covered"))
        found = found.groupBy("_key_").agg(F.flatten(F.collect_list("covered")).alias("covered"))
        both = marked.drop("begins", "ends").join(found, "_key_", "left").select(*own, "_key_", "_text_", *_split("covered"), *counts)
    run, schema = judge(0 if passage else words, bool(passage))
    out = both.mapInArrow(run, schema)
    return out.select(*(F.col(c).alias(n) for c, n in zip(names, [doc_id, *carry], strict=True)), *RESULTS, *(["kept"] if with_kept else []), *counts)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_repeats(read(spark, sf_dir, "documents"), passage=(PASSAGE_BYTES, PASSAGE_WORDS))
