"""Interpolated modified Kneser-Ney of any order from 2 (operator 5), one table of n-grams a level.

The highest level counts occurrences, a lower one the kinds of words before an n-gram; n-grams
that start a text have none before them and count occurrences. A level's tasks write a shard of
its n-grams and hand on what the level below needs: by context how often and by how many kinds it
is continued, by suffix one kind more. An n-gram's key is a 64-bit hash of its words' numbers.

Edge cases are those of `kneser_ney`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordIds, in_chunks, mix
from .kneser_ney import CHUNK, Model, Shards, discounts, numbered, of_counts, put, shard_of, stream

UNKNOWN = 0xFFFFFFFF
ROWS = "level int, shard int, a binary, b binary"
COLUMNS = {"key": np.uint64, "count": np.uint32, "total": np.uint64, "gamma": np.float32}


def further(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of n-grams made longer by a word each."""
    return mix(keys * np.uint64(0x9E3779B97F4A7C15) + words.astype(np.uint64) + np.uint64(1))


def key_of(words: np.ndarray) -> np.ndarray:
    keys = np.zeros(len(words), np.uint64)
    for column in words.T:
        keys = further(keys, column)
    return keys


def summed(words: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted keys of distinct n-grams, their words, and their values added up."""
    keys = key_of(words)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], words[order[first]], np.add.reduceat(values[order].astype(np.int64), first, axis=0) if len(keys) else values


def rows_of(words: np.ndarray, values: np.ndarray, bits: int) -> list[tuple]:
    """(level, shard, words, values) of n-grams, cut by shard."""
    keys, words, values = summed(words, values)
    at = np.searchsorted(shard_of(keys, bits), np.arange((1 << bits) + 1))
    part = lambda x, s: np.ascontiguousarray(x[at[s] : at[s + 1]], np.uint32).tobytes()
    return [(words.shape[1], int(s), part(words, s), part(values, s)) for s in np.flatnonzero(np.diff(at))]


def batch(rows: list[tuple], kind=pa.RecordBatch):
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return kind.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["level", "shard", "a", "b"])


class LongModel(Model):
    """Model of an order above 2; `levels` holds (shards, discounts) by n."""

    def __init__(self, order: int, plain: Model):
        self.__dict__ |= plain.__dict__
        self.order, self.levels, self.kinds = order, {}, 0

    def look(self, level: int, keys: np.ndarray, *columns: str) -> list[np.ndarray]:
        """Values of n-grams by key; 0 where there is none."""
        order = np.argsort(keys)
        there = keys[order]
        out = [np.zeros(len(keys)) for _ in columns]
        shards = self.levels[level][0]
        for part, s in shards.parts(there):
            at, hit = shards.find(there[part], s)
            for o, c in zip(out, columns, strict=True):
                if hit.any():
                    o[order[part]] = np.where(hit, shards.column(s, c)[at], 0)
        return out

    def score(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(sizes)
        if not self.tokens:
            return np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        distinct, inverse = numbered(self.vocabulary, hashes)
        known = distinct >= 0
        count = self._spread(known, self.vocabulary.values(distinct[known], "count", 0.0), 0.0)[inverse]
        number = np.where(known, distinct, UNKNOWN).astype(np.uint32)[inverse]
        text = np.repeat(np.arange(n), sizes + 1)
        place = np.arange(len(number)) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        keys = further(np.zeros(len(number), np.uint64), number)
        c = self.look(1, keys, "count")[0]
        p = (c - self.discount(self.levels[1][1], c)) / max(self.kinds, 1) + self.back_off / (self.words + 1)
        for level in range(2, self.order + 1):
            at = np.flatnonzero(place >= level - 1)
            total, gamma = self.look(level - 1, keys[at - 1], "total", "gamma")
            longer = np.zeros(len(keys), np.uint64)
            longer[at] = further(keys[at - 1], number[at])
            keys = longer
            c = self.look(level, keys[at], "count")[0]
            own = (c - self.discount(self.levels[level][1], c)) / np.maximum(total, 1)
            p[at] = np.where(total > 0, own + gamma * p[at], p[at])
        token = place > 0
        sums = lambda x: np.bincount(text[token], x[token], n)
        return sums(count > 0).astype(np.int64), sums(base), sums(np.log10(np.maximum(p, 1e-300)))


def train_long(texts: DataFrame, folder: str, order: int, plain: Model, size: int) -> Model:
    """Counts n-grams of all levels; `plain` has the words already."""
    model = LongModel(order, plain)
    if not model.tokens:
        return model
    vocabulary = model.vocabulary
    bits = max(2, int(np.ceil(np.log2(max(size, 1) / 12e6 + 1))))

    def ngrams(levels: list[int]):
        """Whole n-grams of the highest level, or those of lower levels that start a text."""

        def run(batches):
            words = WordIds()
            for _, t in in_chunks(batches, "text", CHUNK // 4):
                hashes, n = stream(words, t)
                distinct, inverse = numbered(vocabulary, hashes)
                number = distinct[inverse].astype(np.uint32)
                place = np.arange(len(number)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
                rows = []
                for level in levels:
                    at = np.flatnonzero(place >= level - 1 if level == order else place == level - 1)
                    grams = np.column_stack([number[at - k] for k in range(level - 1, -1, -1)])
                    ones = np.zeros((len(at), 1 if level == order else 5), np.uint32)
                    ones[:, 0] = 1
                    rows += rows_of(grams, ones, bits)
                yield batch(rows)

        return run

    def writer(level: int, above: np.ndarray | None):
        def write(group: pa.Table) -> pa.Table:
            shard = group["shard"][0].as_py()
            words = np.frombuffer(b"".join(group["a"].to_pylist()), np.uint32).reshape(-1, level)
            values = np.frombuffer(b"".join(group["b"].to_pylist()), np.uint32).reshape(len(words), -1)
            keys, words, values = summed(words, values)
            counts = values[:, 0]
            put(folder, f"level{level}-{shard}.key", keys)
            put(folder, f"level{level}-{shard}.count", counts.astype(np.uint32))
            if above is not None:
                put(folder, f"level{level}-{shard}.total", values[:, 1].astype(np.uint64))
                put(folder, f"level{level}-{shard}.gamma", (values[:, 2:] @ above / np.maximum(values[:, 1], 1)).astype(np.float32))
            facts = np.array([shard, len(keys), counts.sum(), *of_counts(counts), (counts >= 3).sum()], np.int64).tobytes()
            rows = [(0, 0, facts, b"")]
            real = counts > 0  # others are contexts only
            if level > 1:
                w, c = words[real], counts[real]
                zero = np.zeros(len(c), np.int64)
                rows += rows_of(w[:, :-1], np.column_stack([zero, c, c == 1, c == 2, c >= 3]), bits)
                rows += rows_of(w[:, 1:], np.column_stack([zero + 1, zero, zero, zero, zero]), bits)
            return batch(rows, pa.Table)

        return write

    scratch = Scratch(texts.sparkSession)
    short = scratch.table(texts.mapInArrow(ngrams(list(range(2, order))), ROWS), "short") if order > 2 else None
    found, above, last = texts.mapInArrow(ngrams([order]), ROWS), None, None
    for level in range(order, 0, -1):
        if 1 < level < order:
            found = found.unionByName(short.where(F.col("level") == level))
        out = scratch.table(found.groupBy("shard").applyInArrow(writer(level, above), ROWS), f"level{level}")
        sizes, seen = [0] * (1 << bits), np.zeros(6, np.int64)
        for r in out.where("level = 0").collect():
            shard, n, *facts = np.frombuffer(r["a"], np.int64)
            sizes[shard] = int(n)
            seen += facts
        above = discounts(seen[1:5])
        model.levels[level] = (Shards(folder, f"level{level}", sizes, bits, COLUMNS), above)
        if last:
            scratch.drop(last)
        last, found = f"level{level}", out.where(F.col("level") == level - 1)
    scratch.drop(last)
    model.kinds = int(seen[0])
    model.back_off = float((above * [seen[1], seen[2], seen[5]]).sum() / max(model.kinds, 1))
    return model
