"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch become ragged arrays of symbol ids. Every round looks up the rank of each adjacent
pair, finds each sequence's lowest, applies that pair everywhere in its sequence (left to right, not overlapping) and
closes the gaps; sequences without a known pair are done. What is left are the tokens. A long sequence takes many
rounds, so it keeps the places of every rank and a round touches only those of the lowest.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read

#: Pre-token pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Letters from which a pre-token is merged on its own.
LONG = 1024


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class RankMerger:
    """Merge ranks of one vocabulary file, with a bounded memory of counted pre-tokens."""

    def __init__(self, path: str, remember: int = 400_000) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[s] for _, s in sorted(_byte_symbols().items())], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, made = (np.array([vocab[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], "".join))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made, self.made_by = keys[order], order.astype(np.int64), made[order], made
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.remember, self.known = remember, {}

    def merge(self, words: list[str]) -> np.ndarray:
        """Number of symbols that survive in each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        ids = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        counts = sizes.copy()
        while len(ids) > 1:
            pair = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            ok = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(ok, self.rank[at], len(self.keys))
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            low = np.minimum.reduceat(np.append(rank, len(self.keys)), heads)
            live = low < len(self.keys)
            if not live.any():
                break
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(ids))))
            hit = ok & (rank == low[group[:-1]])
            where = np.flatnonzero(hit)
            run = np.concatenate(([True], np.diff(where) > 1))  # in a run of overlapping pairs every second one merges
            begin = where[run][np.cumsum(run) - 1]
            where = where[(where - begin) % 2 == 0]
            ids[where] = self.made[at[where]]
            keep = np.ones(len(ids), bool)
            keep[where + 1] = False
            np.subtract.at(counts, owner[where], 1)
            keep &= live[group]  # finished sequences leave
            ids, owner = ids[keep], owner[keep]
        return counts

    def merge_long(self, word: str) -> int:
        """Number of symbols that survive in one long word: the rounds of merge(), in which only changed pairs are ranked
        anew. A pair made by a merge ranks behind it, so every place is moved a bounded number of times per merge."""
        ids = self.first[np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)]
        n, none = len(ids), len(self.keys)
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        rank = np.full(n, none, np.int64)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            """Rank the pairs that begin at ``at`` and keep their places."""
            at = at[after[at] < n]
            pair = ids[at] << 32 | ids[after[at]]
            k = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            rank[at] = np.where(self.keys[k] == pair, self.rank[k], none)
            order = np.argsort(rank[at], kind="stable")
            order = order[: np.searchsorted(rank[at][order], none)]
            if len(order):
                at = at[order]
                cuts = np.flatnonzero(np.diff(rank[at])) + 1
                for some, r in zip(np.split(at, cuts), rank[at][np.append(0, cuts)].tolist(), strict=True):
                    if r not in places:
                        heapq.heappush(ranks, r)
                    places.setdefault(r, []).append(some)

        note(np.arange(n))
        left = n
        while ranks:
            low = heapq.heappop(ranks)
            where = np.unique(np.concatenate(places.pop(low)))
            where = where[rank[where] == low]
            if not len(where):
                continue
            run = np.concatenate(([True], after[where[:-1]] != where[1:]))
            begin = np.flatnonzero(run)[np.cumsum(run) - 1]
            where = where[(np.arange(len(where)) - begin) % 2 == 0]
            gone = after[where]
            ids[where], rank[where], rank[gone] = self.made_by[low], none, none
            after[where] = after[gone]
            before[after[where]] = where
            left -= len(where)
            changed = np.union1d(where, before[where])
            rank[changed[changed >= 0]] = none
            note(changed[changed >= 0])
        return left

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts; strings of special tokens count one each, as the library does by default."""
        extra, parts = [], []
        for text in texts:
            if self.split and any(s in text for s in self.special):
                plain = self.split.split(text)
                extra.append(len(plain) - 1)
                parts.append([w for p in plain for w in self.find(p)])
            else:
                extra.append(0)
                parts.append(self.find(text))
        known = self.known
        if new := list({w for p in parts for w in p if w not in known}):
            if len(known) > self.remember:
                known.clear()
                new = list({w for p in parts for w in p})
            known.update((w, self.merge_long(w)) for w in new if len(w) >= LONG)
            new = [w for w in new if len(w) < LONG]
            for lo in range(0, len(new), 20_000):
                some = new[lo : lo + 20_000]
                known.update(zip(some, self.merge(some).tolist(), strict=True))
        get = known.__getitem__
        return [e + sum(map(get, p)) for e, p in zip(extra, parts, strict=True)]


_MERGERS: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """One merger per Python worker and file."""
    if path not in _MERGERS:
        _MERGERS[path] = RankMerger(path)
    return _MERGERS[path]


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """``keep`` columns (but for those with a result's name), n_bytes, n_tokens and over_limit for every row.

    Null and empty texts have no bytes and no tokens. Rows are independent: repeats, null ids and extra columns
    change nothing; an empty table gives an empty result. No shuffle. ``vocabulary`` is a path that every executor has.
    """
    keep = tuple(c for c in dict.fromkeys(keep) if c not in ("n_bytes", "n_tokens", "over_limit"))
    kept = df.select(*keep, F.col(text).alias("_text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column(len(keep)).to_pylist()]
                n = np.array(m.count(texts), np.int64)
                size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(size), pa.array(n), pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["n_bytes long", "n_tokens long", "over_limit boolean"])
    return kept.mapInArrow(run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
