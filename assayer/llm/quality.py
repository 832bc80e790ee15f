"""Quality scores of whole texts by an additive model with pairwise interactions over surface features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit as bk
from .additive import AdditiveModel, fit_additive
from .store import read

#: At most so many labelled rows are learned from.
SAMPLE_ROWS = 12_000
PIECE_BYTES = 500_000

_CLASSES = {
    "lower": range(0x61, 0x7B), "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "space": b" ", "newline": b"\n", "tab": b"\t",
    "stop": b".!?", "comma": b",;:", "quote": b"\"'`()-", "bar": b"|", "mark": b"#$%&*+=@^_~\\", "bracket": b"<>[]{}/", "beyond": range(0x80, 0x100),
    "control": [*range(9), *range(11, 32), 127],
}
_CLASS = np.zeros(256, np.int64)
for _k, _v in enumerate(_CLASSES.values()):
    _CLASS[list(_v)] = _k
_ALNUM = bk.WORD
_MARK = np.zeros(256, bool)
_MARK[list(b"#$%&*+=@^_~\\|<>[]{}/")] = True
FEATURES = [*_CLASSES, "bytes", "words", "word_bytes", "short_words", "long_words", "marked_words", "bare_words", "distinct_words", "distinct_pairs", "top_word", "lines", "line_bytes", "distinct_lines", "short_lines", "ends_stop", "caps_words", "repeats"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text, of shares (0 to 1) and logarithms of counts; an empty text has zeros."""
    n = len(offsets) - 1
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    k = len(_CLASSES)
    chars = np.bincount(row * k + _CLASS[data], minlength=n * k).reshape(n, k)
    per = lambda x, by: x / np.maximum(by, 1)
    out = {name: per(chars[:, i], size) for i, name in enumerate(_CLASSES)}
    sums = bk.prefix(bk.LOWER[data])

    def distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of distinct values and largest count of one value per owner."""
        key = np.sort(owner.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))  # 44 bits tell apart what one text holds
        o = (key >> np.uint64(44)).astype(np.int64)
        new = np.ones(len(o), bool)
        new[1:] = key[1:] != key[:-1]
        top = np.zeros(n, np.int64)
        if len(o):
            np.maximum.at(top, o[new], np.diff(np.append(np.flatnonzero(new), len(o))))
        return np.bincount(o[new], minlength=n), top

    starts, ends, firsts = bk.spans(bk.SOLID[data], offsets)
    words, owner = np.diff(firsts), np.repeat(np.arange(n), np.diff(firsts))
    length = ends - starts
    mean = lambda flag: per(np.bincount(owner, flag, n), words)
    marks, plain = np.concatenate(([0], np.cumsum(_MARK[data]))), np.concatenate(([0], np.cumsum(_ALNUM[data])))
    caps = np.concatenate(([0], np.cumsum((data >= 0x41) & (data <= 0x5A))))
    h = bk.span_hash(sums, starts, ends)
    unique, top = distinct(owner, h)
    inside = owner[1:] == owner[:-1]
    pairs, _ = distinct(owner[1:][inside], bk.mix(h[1:] * np.uint64(3) + h[:-1])[inside])
    out |= {"bytes": np.log1p(size), "words": np.log1p(words), "word_bytes": per(np.bincount(owner, length, n), words), "short_words": mean(length <= 3), "long_words": mean(length > 14)}
    out |= {"marked_words": mean(marks[ends] > marks[starts]), "bare_words": mean(plain[ends] == plain[starts]), "distinct_words": per(unique, words), "distinct_pairs": per(pairs, words - 1), "top_word": per(top, words)}
    starts, ends, firsts = bk.spans(data != 10, offsets)
    lines, owner = np.diff(firsts), np.repeat(np.arange(n), np.diff(firsts))
    kinds, most = distinct(owner, bk.span_hash(sums, starts, ends))
    mean_line = lambda flag: per(np.bincount(owner, flag, n), lines)
    last = data[ends - 1] if len(ends) else data[:0]
    out |= {"lines": np.log1p(lines), "line_bytes": np.log1p(per(size, lines)), "distinct_lines": per(kinds, lines), "short_lines": mean_line(ends - starts < 30), "ends_stop": mean_line(np.isin(last, list(b".!?\"")))}
    starts, ends, firsts = bk.spans(bk.SOLID[data], offsets)
    owner = np.repeat(np.arange(n), np.diff(firsts))
    out |= {"caps_words": per(np.bincount(owner, (caps[ends] - caps[starts]) * 2 > ends - starts, n), words), "repeats": per(np.bincount(owner[1:][inside], h[1:][inside] == h[:-1][inside], n), words)}
    return np.stack([out[f].astype(float) for f in FEATURES], axis=1)


def _text_features(batches: Iterator[pa.RecordBatch], text: int):
    for batch in batches:
        data, offsets = bk.binary(batch.column(text))
        for lo, hi in bk.pieces(offsets, PIECE_BYTES):
            yield batch.slice(lo, hi - lo), features(data, offsets[lo : hi + 1])


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_text_ and y of at most ``rows`` labelled documents, chosen by a hash of the id so that any size gives a fair
    sample. ``rows`` bounds what is broadcast and what later goes to the driver: of rows that repeat a labelled id the
    smallest text counts, of labels that contradict each other the largest."""
    chosen = labels.where(learn & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id_")).agg(F.max(label).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_id_"), "_id_").limit(rows)
    return docs.select(F.col(doc_id).alias("_id_"), F.col(text).alias("_text_")).join(F.broadcast(chosen), "_id_").groupBy("_id_", "y").agg(F.min("_text_").alias("_text_"))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Learned from texts alone, of any length. Without usable labels, or from empty tables, the model scores one half."""
    sample = labelled_sample(docs, labels, learn, label, rows).select("_text_", F.col("y").cast("double"), F.xxhash64("_id_").alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _text_features(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1), part.column(2)], names=["x", "y", "o"])

    got = sample.mapInArrow(run, "x array<double>, y double, o long").toPandas().sort_values("o", kind="stable")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit_additive(x, got["y"].to_numpy(float))


def keep_text(docs: DataFrame, text: str) -> tuple[DataFrame, list[str], int]:
    """``docs`` without columns that bear a result's name, the names that stay, and the place of the text, which stands
    behind them if it had such a name itself."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    if text in names:
        return docs.select(*names), names, names.index(text)
    return docs.select(*names, F.col(text).alias("_text_")), names, len(names)


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text", at: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with score and predicted; columns of these names are replaced.

    Null texts are scored as empty ones, long ones as a whole; repeated rows get equal scores; an empty table gives an empty
    result; no shuffle."""
    docs, names, at_text = keep_text(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _text_features(batches, at_text):
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(score), pa.array((score >= at).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[: len(names)])
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


FOLDS, HELD_OUT = 5, 0


def quality_model(docs: DataFrame, labels: DataFrame) -> AdditiveModel:
    return fit_quality(docs, labels, bk.crc_fold("doc_id", FOLDS) != HELD_OUT)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, quality_model(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(bk.crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
