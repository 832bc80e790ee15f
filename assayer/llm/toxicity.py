"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon (words and stems of inflected words with weights) is learned from labelled texts. Its trie is intersected
with the Levenshtein automaton of each entry by walking both at once; the reachable sets of (trie node, edits) become
the states of one deterministic table over UTF-8 bytes, which then reads all words of a batch in step. Around every
hit a window of words tells quotation (quote marks, reporting words) from address; a small additive score combines them.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit as bk
from .additive import AdditiveModel, fit_additive
from .quality import keep_text, labelled_sample
from .store import materialize, read

SAMPLE_ROWS = 12_000
STEMS = (4, 5, 6)
WINDOW = 6
PIECE_BYTES = 500_000
#: Words that report speech and words that address someone (plain lists).
REPORTING = "said says wrote writes called quoted quote cited reported according dit dijo sagte schrieb".split()
ADDRESS = "you your you're u ur du dich dir tu te toi vous".split()


@dataclasses.dataclass
class Entry:
    text: bytes
    stem: bool
    weight: float


class Automaton:
    """Trie of entries x Levenshtein automata, determinised. ``accept[state]`` is 0 or 1 + number of the best outcome;
    outcomes are (entry, edits). Entries of ``long`` bytes or more allow one edit, shorter ones none; a stem accepts any
    continuation and is matched exactly."""

    def __init__(self, entries: list[Entry], long: int = 5) -> None:
        trie: list[dict[int, int]] = [{}]
        ends: dict[int, list[int]] = {}
        most = [0]
        for k, e in enumerate(entries):
            node = 0
            edits = 0 if e.stem or len(e.text) < long else 1
            most[0] = max(most[0], edits)
            for b in e.text:
                if b not in trie[node]:
                    trie[node][b] = len(trie)
                    trie.append({})
                    most.append(0)
                node = trie[node][b]
                most[node] = max(most[node], edits)  # edits that some entry below allows
            ends.setdefault(node, []).append(k)
        letters = sorted({b for e in entries for b in e.text})
        self.classes = np.zeros(256, np.int64)
        for i, b in enumerate(letters):
            self.classes[b] = i + 1
        self.width = len(letters) + 1
        self.entries = entries
        self.outcomes = [(k, d) for k in range(len(entries)) for d in (0, 1)]

        def closed(items: dict[tuple[int, bool], int]) -> frozenset:
            """Skipping a letter of an entry (deletion) costs an edit; keep the fewest edits of each node."""
            todo = list(items.items())
            while todo:
                (node, stem), d = todo.pop()
                if not stem and d < most[node]:
                    for child in trie[node].values():
                        if d + 1 <= most[child] and items.get((child, False), 9) > d + 1:
                            items[child, False] = d + 1
                            todo.append(((child, False), d + 1))
            return frozenset((n, s, d) for (n, s), d in items.items())

        def step(state: frozenset, letter: int | None) -> frozenset:
            out: dict[tuple[int, bool], int] = {}

            def put(node: int, stem: bool, d: int) -> None:
                if out.get((node, stem), 9) > d:
                    out[node, stem] = d

            for node, stem, d in state:
                if stem:
                    put(node, True, d)
                    continue
                if letter in trie[node]:
                    child = trie[node][letter]
                    put(child, False, d)
                    if d == 0 and any(entries[k].stem for k in ends.get(child, ())):
                        put(child, True, 0)
                if d < most[node]:
                    put(node, False, d + 1)  # an extra letter
                    for child in trie[node].values():
                        if d + 1 <= most[child]:
                            put(child, False, d + 1)  # another letter
            return closed(out)

        def outcome(state: frozenset) -> int:
            best = (0.0, 0)
            for node, stem, d in state:
                for k in ends.get(node, ()):
                    if entries[k].stem and not stem or not entries[k].stem and (stem or d > (len(entries[k].text) >= long)):
                        continue
                    best = max(best, (entries[k].weight - d, 1 + 2 * k + d))
            return best[1]

        states = {frozenset(): 0, (start := closed({(0, False): 0})): 1}
        table: list[list[int]] = [[0] * self.width]
        queue, accept = [start], [0, outcome(start)]
        for state in queue:
            row = []
            for letter in [None, *letters]:
                to = step(state, letter)
                if to not in states:
                    states[to] = len(states)
                    queue.append(to)
                    accept.append(outcome(to))
                row.append(states[to])
            table.append(row)
        self.table = np.array(table, np.int32).ravel()
        self.accept = np.array(accept, np.int64)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Outcome (0: none) of every word; words whose state is dead leave the race."""
        out = np.zeros(len(starts), np.int64)
        live, state, at = np.arange(len(starts)), np.ones(len(starts), np.int64), starts.copy()
        while len(live):
            over = at == ends[live]
            if over.any():
                out[live[over]] = self.accept[state[over]]
                live, state, at = live[~over], state[~over], at[~over]
            state = self.table[state * self.width + self.classes[data[at]]].astype(np.int64)
            at = at + 1
            alive = state > 0
            live, state, at = live[alive], state[alive], at[alive]
        return out


def learn_lexicon(sample: DataFrame, support: int = 4, precision: float = 0.8) -> list[Entry]:
    """Words and stems that are far more frequent in toxic texts: counted by documents, in the cluster; all that
    have the support and precision come to the driver, so their number is bounded by the sample. A stem must be more than the words that begin with it taken alone."""
    lower = F.translate("_text_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: (w != "") & (F.length(w) <= 40)))
    stem = lambda n: F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))
    forms = F.array_distinct(F.concat(words, *(stem(n) for n in STEMS)))
    counts = sample.select("y", F.explode(forms).alias("form")).groupBy("form").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    weight = F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 0.5))
    good = counts.where((F.col("bad") >= support) & (F.col("bad") / F.col("n") >= precision)).withColumn("w", weight).orderBy(F.desc(F.col("w") * F.sqrt("bad")), "form")
    rows = [(r.form, float(r.w), int(r.bad)) for r in good.collect()]
    by = {f: (w, n) for f, w, n in rows}
    out, covered = [], set()
    for f, w, n in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        if f.endswith("*") and not any(f[:-1].startswith(c) for c in covered):
            own = max((m for g, (_, m) in by.items() if not g.endswith("*") and g.startswith(f[:-1])), default=0)
            if n > 1.5 * own:  # many forms share it, so it is a stem and not one word's beginning
                covered.add(f[:-1])
                out.append((f, w, n))
    out += [(f, w, n) for f, w, n in rows if not f.endswith("*") and not any(f.startswith(c) for c in covered)]
    out.sort(key=lambda r: (-r[1] * r[2] ** 0.5, r[0]))
    return [Entry(f.rstrip("*").encode(), f.endswith("*"), w) for f, w, _ in out]


FEATURES = ["hits", "strongest", "sum", "density", "exact", "near", "best_near", "quoted", "bare", "reported", "addressed", "words"]


def features(data: np.ndarray, offsets: np.ndarray, automaton: Automaton, weights: np.ndarray) -> np.ndarray:
    """One row per text; an empty text, or one without hits, has zeros (but for its length)."""
    n = len(offsets) - 1
    data, offsets = bk.LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    starts, ends, firsts = bk.spans(bk.WORD[data], offsets)
    words, owner = np.diff(firsts), np.repeat(np.arange(n), np.diff(firsts))
    kind = automaton.run(data, starts, ends)
    at = np.flatnonzero(kind)
    row, w, near = owner[at], weights[kind[at]], kind[at] % 2 == 0
    out = np.zeros((n, len(FEATURES)))
    out[:, 11] = np.log1p(words)
    if not len(at):
        return out
    quotes = np.concatenate(([0], np.cumsum((data == 0x22) | (data == 0x60))))
    lo, hi = np.maximum(at - WINDOW, firsts[row]), np.minimum(at + WINDOW, firsts[row + 1] - 1)

    quoted = (quotes[starts[at]] - quotes[starts[lo]] > 0) & (quotes[ends[hi]] - quotes[ends[at]] > 0)

    def listed(vocabulary: list[str]) -> np.ndarray:
        is_one = np.zeros(len(starts) + 1, np.int64)
        h = bk.span_hash(bk.prefix(data), starts, ends)
        raw = "\n".join(vocabulary).encode()
        d = np.frombuffer(raw, np.uint8)
        s, e, _ = bk.spans(d != 10, np.array([0, len(d)]))
        is_one[1:] = np.cumsum(np.isin(h, bk.span_hash(bk.prefix(d), s, e)))
        return is_one[hi + 1] - is_one[lo] > 0

    reported, addressed = listed(REPORTING), listed(ADDRESS)
    total = lambda x: np.bincount(row, x, n)
    top = np.zeros((n, 2))
    np.maximum.at(top[:, 0], row, w)
    np.maximum.at(top[:, 1], row[near], w[near])
    out[:, :11] = np.stack([np.log1p(total(np.ones(len(at)))), top[:, 0], np.log1p(total(np.maximum(w, 0))), total(np.maximum(w, 0)) / np.maximum(words, 1), np.log1p(total(~near)), np.log1p(total(near)), top[:, 1], np.log1p(total(quoted)), np.log1p(total(~quoted)), np.log1p(total(reported)), np.log1p(total(addressed))], axis=1)
    return out


@dataclasses.dataclass
class ToxicityModel:
    automaton: Automaton
    weights: np.ndarray
    model: AdditiveModel

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.model.score(features(data, offsets, self.automaton, self.weights))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Without usable labels, or from empty tables, every text scores one half. The labelled sample is written once and read
    for the lexicon, for its outcomes and for the features. Words of more than 40 letters are in no lexicon."""
    sample = materialize(labelled_sample(docs, labels, learn, label, rows), "toxicity-sample")
    automaton = Automaton(learn_lexicon(sample))
    size = 1 + 2 * len(automaton.entries)

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the automaton finds in each labelled text, to weigh outcomes (exact or misspelled) by their precision."""
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            bad, seen = np.zeros(size), np.zeros(size)
            data, offsets = bk.binary(batch.column(0))
            for lo, hi in bk.pieces(offsets, PIECE_BYTES):
                part = bk.LOWER[data[offsets[lo] : offsets[hi]]]
                starts, ends, firsts = bk.spans(bk.WORD[part], offsets[lo : hi + 1] - offsets[lo])
                kind = automaton.run(part, starts, ends)
                both = np.unique(np.repeat(np.arange(lo, hi), np.diff(firsts)) * size + kind)
                seen += np.bincount(both % size, minlength=size)
                bad += np.bincount(both % size, y[both // size].astype(float), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(bad), pa.array(seen)], names=["k", "bad", "seen"])

    text = sample.select("_text_", F.col("y").cast("double"), F.xxhash64("_id_").alias("o"))
    weights = np.full(size, np.log(1.4 / 0.6) + 2)  # of an outcome that no labelled text has
    for r in text.mapInArrow(outcomes, "k long, bad double, seen double").groupBy("k").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")).collect():
        weights[r.k] = np.log((r.bad + 1.4) / (r.seen - r.bad + 0.6)) + 2
    weights[0] = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bk.binary(batch.column(0))
            for lo, hi in bk.pieces(offsets, PIECE_BYTES):
                x = features(data, offsets[lo : hi + 1], automaton, weights)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)], names=["x", "y", "o"])

    got = text.mapInArrow(run, "x array<double>, y double, o long").toPandas().sort_values("o", kind="stable")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return ToxicityModel(automaton, weights, fit_additive(x, got["y"].to_numpy(float), pairs=3))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", at: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with score and predicted; columns of these names are replaced.

    Null texts are scored as empty ones, long ones as a whole; repeated rows get equal scores; an empty table gives an empty
    result; no shuffle."""
    docs, names, at_text = keep_text(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bk.binary(batch.column(at_text))
            for lo, hi in bk.pieces(offsets, PIECE_BYTES):
                score = model.score(data, offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(names)], pa.array(score), pa.array((score >= at).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[: len(names)])
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


FOLDS, HELD_OUT = 4, 2


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), bk.crc_fold("doc_id", FOLDS) != HELD_OUT)
    return score_toxicity(docs, model).select("doc_id", F.coalesce(bk.crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
