"""LM scoring (operator 5): an interpolated modified Kneser-Ney model, of bigrams unless an order is given.

Orders above 2 are in `ngram_model`; what follows is the bigram model.

Words are counted first; a word's number is its place among the sorted word hashes. A bigram is
the two numbers in 64 bits, scrambled by a bijection, so its key is exact. Each task counts
what its texts hold, shards the sums by key, and one task a shard merges them into sorted arrays
(Chen and Goodman 1999 for discounts and back-off). The arrays are files in the shared folder,
which scoring tasks map into memory and search with sorted queries.

The shared folder must be a path that executors mount; from another store each task copies a
shard to its own temp folder, maps it and unlinks it at once.

Edge cases: a null or empty text is the end token alone; a text never seen has all tokens
unknown, which share one more word's probability; with no training text every token has
probability 1; repeated rows are counted each; a null id trains; an empty table gives no rows;
columns beside the id and the text play no part.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import Scratch, WordIds, distinct_counts, in_chunks, mix

END = xxh3_64_intdigest(b" end") >> 1  # no word holds a blank
BEGIN = xxh3_64_intdigest(b" begin") >> 1
CHUNK = 16_000_000  # bytes of text; orders above 2 count a quarter of it at a time
PART = 2_000_000  # bytes of text that are words and arrays by token at a time
KEYS = 3_000_000  # keys that a task counts together, at most a part's more: about 16 MB of text
MOST_WORDS = 1 << 32  # words have numbers of 32 bits in the keys of pairs; with more, keys would clash
BLOB = "shard int, a binary, b binary"


def local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Writes a file under a name of its own, then renames it: a task that runs twice does no harm."""
    path = local(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        array.tofile(part)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(array.tobytes())


def mapped(folder: str, name: str, dtype, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, dtype)
    path = local(folder)
    if path is not None:
        return np.memmap(f"{path}/{name}", dtype, "r", shape=(n,))
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(f"{base}/{name}") as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype, "r", shape=(n,))


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def split_blobs(keys: np.ndarray, values: np.ndarray, bits: int):
    """Sorted 64-bit keys and values, cut by shard: rows of (shard, key bytes, value bytes)."""
    at = np.searchsorted(shard_of(keys, bits), np.arange((1 << bits) + 1))
    filled = np.flatnonzero(np.diff(at))
    ends = np.append(at[filled], len(keys))
    cut = lambda x: pa.Array.from_buffers(pa.binary(), len(filled), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])  # noqa: E731  not copied
    return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), cut(keys), cut(values)], ["shard", "a", "b"])


def count_blobs(batches, keys_of, value_type, bits: int):
    """Blobs of the distinct keys that keys_of() gives for texts, with their counts. Until KEYS keys are there, nothing but keys is kept."""

    held: list[np.ndarray] = []

    def taken() -> np.ndarray:
        together = np.concatenate(held)
        held.clear()
        return together

    def blobs() -> pa.RecordBatch:
        keys, counts = distinct_counts(taken())
        return split_blobs(keys, counts.astype(value_type, copy=False), bits)

    for _, t in in_chunks(batches, "text", PART):
        held.append(keys_of(t))
        if sum(map(len, held)) >= KEYS:
            yield blobs()
    if held:
        yield blobs()


def merged(keys: list[bytes], values: list[bytes], value_type) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(b"".join(keys), np.uint64)
    v = np.frombuffer(b"".join(values), value_type).reshape(len(k), -1) if len(k) else np.empty((0, 1), value_type)
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(v, first, axis=0) if len(k) else v


class Shards:
    """Sorted arrays in files, by the leading bits of the key."""

    def __init__(self, folder: str, name: str, sizes: list[int], bits: int, columns: dict):
        self.folder, self.name, self.sizes, self.bits, self.columns = folder, name, sizes, bits, columns
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self._open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def column(self, shard: int, column: str) -> np.ndarray:
        key = (shard, column)
        if key not in self._open:
            self._open[key] = mapped(self.folder, f"{self.name}-{shard}.{column}", self.columns[column], self.sizes[shard])
        return self._open[key]

    def parts(self, keys: np.ndarray):
        """(slice of the sorted keys, shard) for all shards that the keys touch."""
        at = np.searchsorted(shard_of(keys, self.bits), np.arange(len(self.sizes) + 1))
        for s in np.flatnonzero(np.diff(at)):
            yield slice(at[s], at[s + 1]), int(s)

    def find(self, keys: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys in a shard, and which are there."""
        there = self.column(shard, "key")
        if not len(there):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(there, keys), len(there) - 1)
        return at, there[at] == keys

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Global places of sorted keys, -1 where absent."""
        out = np.full(len(keys), -1, np.int64)
        for part, s in self.parts(keys):
            at, there = self.find(keys[part], s)
            out[part] = np.where(there, at + self.starts[s], -1)
        return out

    def values(self, numbers: np.ndarray, column: str, default) -> np.ndarray:
        """Values at sorted global places."""
        out = np.full(len(numbers), default, np.float64)
        at = np.searchsorted(numbers, self.starts)
        for s in np.flatnonzero(np.diff(at)):
            part = slice(at[s], at[s + 1])
            out[part] = self.column(int(s), column)[numbers[part] - self.starts[s]]
        return out


def stream(words: WordIds, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of begin, words, end of each text, one after the other, scrambled so that they spread over shards; and the number of tokens (words and end) of each."""
    parts, sizes = [], np.empty(len(texts), np.int64)
    head, tail = np.array([BEGIN]), np.array([END])
    for i, t in enumerate(texts):
        ids = words.of(t)
        sizes[i] = len(ids) + 1
        parts += (head, ids, tail)
    return (mix(np.concatenate(parts)) if parts else np.empty(0, np.uint64)), sizes


def numbered(vocabulary: Shards, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct numbers, -1 first if any is unknown; the place of each token's number among them)."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    # hash order is number order, so distinct numbers come sorted but for the unknown
    return vocabulary.numbers(distinct), inverse


def discounts(counts: np.ndarray) -> np.ndarray:
    """D for a count of 1, 2, and 3 or more, from the numbers of things counted 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    if not n1 or not n2:
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5])
    return np.clip(d, 0.05, [0.95, 1.95, 2.95])


def of_counts(values: np.ndarray) -> list[int]:
    return [int((values == c).sum()) for c in (1, 2, 3, 4)]


class Model:
    """What scoring needs: files' places and a few numbers."""

    def __init__(self):
        self.vocabulary: Shards | None = None
        self.bigrams: Shards | None = None
        self.tokens = self.words = self.pairs = 0
        self.d2 = self.d1 = np.zeros(3)
        self.back_off = 0.0

    def discount(self, d: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, d[np.clip(counts, 1, 3).astype(np.int64) - 1], 0.0)

    def score(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(n_known, base, log10 probability) of texts as stream() gives them."""
        n = len(sizes)
        ends = np.cumsum(sizes + 1)
        begins = np.concatenate(([0], ends[:-1]))
        token = np.ones(len(hashes), bool)
        token[begins] = False  # a begin is context only
        text = np.repeat(np.arange(n), sizes + 1)[token]
        if not self.tokens:
            return np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        distinct, inverse = numbered(self.vocabulary, hashes)
        known = distinct >= 0
        places = distinct[known]
        pick = lambda column, default: self._spread(known, self.vocabulary.values(places, column, default), default)
        count, gamma, before = pick("count", 0.0), pick("gamma", 1.0), pick("before", 0.0)
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        lower = (before - self.discount(self.d1, before)) / max(self.pairs, 1) + self.back_off / (self.words + 1)
        w = inverse[token]
        v = inverse[np.flatnonzero(token) - 1]

        key = mix((distinct[v].astype(np.uint64) << np.uint64(32)) | distinct[w].astype(np.uint64))
        both = np.flatnonzero((distinct[v] >= 0) & (distinct[w] >= 0))
        order = both[np.argsort(key[both])]
        sorted_keys = key[order]
        found = np.zeros(len(order))
        for part, s in self.bigrams.parts(sorted_keys):
            at, there = self.bigrams.find(sorted_keys[part], s)
            c = np.where(there, self.bigrams.column(s, "count")[at] if len(at) else 0, 0).astype(np.float64)
            over = np.flatnonzero(c == 255)
            if len(over):
                many, exact = self.bigrams.column(s, "many"), self.bigrams.column(s, "exact")
                c[over] = exact[np.searchsorted(many, sorted_keys[part][over])]
            found[part] = c
        c = np.zeros(len(w))
        c[order] = found
        total = count[v]
        p = np.where(total > 0, (c - self.discount(self.d2, c)) / np.maximum(total, 1), 0) + np.where(total > 0, gamma[v], 1.0) * lower[w]
        sums = lambda x: np.bincount(text, x, n)
        return sums(count[w] > 0).astype(np.int64), sums(base[w]), sums(np.log10(np.maximum(p, 1e-300)))

    @staticmethod
    def _spread(known: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(known), default, np.float64)
        out[known] = values
        return out


def train(texts: DataFrame, folder: str, order: int = 2) -> Model:
    """Counts the column `text` of all rows. The driver sees a few numbers a shard; shards follow the input."""
    if order < 2:
        raise ValueError("order is 2 at least")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    vbits = max(2, int(np.ceil(np.log2(max(size, 1) / 100e6 + 1))) + 1)
    bbits = max(2, int(np.ceil(np.log2(max(size, 1) / 24e6 + 1))))
    model = Model()

    def count_words(batches):
        words = WordIds()
        yield from count_blobs(batches, lambda t: stream(words, t)[0], np.int64, vbits)

    begin, end = (int(mix(np.array([x]))[0]) for x in (BEGIN, END))

    def write_words(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        keys, counts = merged(group["a"].to_pylist(), group["b"].to_pylist(), np.int64)
        counts = counts[:, 0]
        put(folder, f"words-{shard}.key", keys)
        put(folder, f"words-{shard}.count", counts)
        real = keys != np.uint64(begin)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "words": pa.array([int(real.sum())], pa.int64()), "tokens": pa.array([int(counts[real].sum())], pa.int64())})

    rows = texts.mapInArrow(count_words, BLOB).groupBy("shard").applyInArrow(write_words, "shard int, n long, words long, tokens long").collect()
    sizes = [0] * (1 << vbits)
    for r in rows:
        sizes[r["shard"]] = r["n"]
        model.words += r["words"]
        model.tokens += r["tokens"]
    if sum(sizes) > MOST_WORDS:
        raise ValueError(f"{sum(sizes)} distinct words: the keys of longer grams number {MOST_WORDS} at most")
    model.vocabulary = vocabulary = Shards(folder, "words", sizes, vbits, {"key": np.uint64, "count": np.int64, "gamma": np.float32, "before": np.uint32})
    if order > 2:
        from .ngram_model import train_long

        return train_long(texts, folder, order, model, size)
    if not rows:
        return model

    def count_pairs(batches):
        words = WordIds()

        def pairs(t: list) -> np.ndarray:
            hashes, n = stream(words, t)
            distinct, inverse = numbered(vocabulary, hashes)
            numbers = distinct[inverse].astype(np.uint64)
            second = np.ones(len(numbers), bool)
            second[np.concatenate(([0], np.cumsum(n + 1)[:-1]))] = False
            at = np.flatnonzero(second)
            return mix((numbers[at - 1] << np.uint64(32)) | numbers[at])

        yield from count_blobs(batches, pairs, np.uint32, bbits)

    starts = vocabulary.starts

    def write_pairs(group: pa.Table) -> pa.Table:
        """Writes a shard's bigrams; returns, by shard of the vocabulary, how many kinds of bigrams each word begins (counted once, twice, more) and ends."""
        shard = group["shard"][0].as_py()
        keys, counts = merged(group["a"].to_pylist(), group["b"].to_pylist(), np.uint32)
        counts = counts[:, 0]
        put(folder, f"pairs-{shard}.key", keys)
        put(folder, f"pairs-{shard}.count", np.minimum(counts, 255).astype(np.uint8))
        many = counts >= 255
        put(folder, f"pairs-{shard}.many", keys[many])
        put(folder, f"pairs-{shard}.exact", counts[many].astype(np.uint64))
        pair = unmix(keys)
        first, second = pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)
        kinds = np.stack([counts == 1, counts == 2, counts >= 3], axis=1)
        order = np.argsort(first, kind="stable")
        v, at = np.unique(first[order], return_index=True)
        begun = np.add.reduceat(kinds[order].astype(np.uint32), at, axis=0) if len(v) else np.empty((0, 3), np.uint32)
        w, ended = np.unique(second, return_counts=True)
        shards, a, b = [], [], []
        for kind, numbers, values in ((0, v, np.column_stack([begun, np.zeros(len(v), np.uint32)])), (1, w, np.column_stack([np.zeros((len(w), 3), np.uint32), ended]))):
            cut = np.searchsorted(numbers, starts.astype(np.uint64))
            for s in np.flatnonzero(np.diff(cut)):
                shards.append(int(s))
                a.append(numbers[cut[s] : cut[s + 1]].tobytes())
                b.append(values[cut[s] : cut[s + 1]].astype(np.uint32).tobytes())
        facts = np.array([shard, len(keys), int(many.sum()), *of_counts(counts)], np.int64).tobytes()
        return pa.table({"shard": pa.array([*shards, -1], pa.int32()), "a": pa.array([*a, facts], pa.binary()), "b": pa.array([*b, b""], pa.binary())})

    scratch = Scratch(texts.sparkSession)
    ends = scratch.table(texts.mapInArrow(count_pairs, BLOB).groupBy("shard").applyInArrow(write_pairs, BLOB), "ends")
    sizes, over, total = [0] * (1 << bbits), [0] * (1 << bbits), np.zeros(4, np.int64)
    for r in ends.where("shard = -1").collect():
        shard, n, many, *counted = np.frombuffer(r["a"], np.int64)
        sizes[shard], over[shard] = int(n), int(many)
        total += counted
    model.pairs = sum(sizes)
    model.bigrams = Pairs(folder, "pairs", sizes, bbits, {"key": np.uint64, "count": np.uint8, "many": np.uint64, "exact": np.uint64}, over)
    model.d2 = d2 = discounts(total)

    def write_ends(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        numbers, values = merged(group["a"].to_pylist(), group["b"].to_pylist(), np.uint32)
        n = vocabulary.sizes[shard]
        dense = np.zeros((n, 4), np.int64)
        dense[numbers.astype(np.int64) - vocabulary.starts[shard]] = values
        count = np.maximum(vocabulary.column(shard, "count"), 1)
        put(folder, f"words-{shard}.gamma", (dense[:, :3] @ d2 / count).astype(np.float32))
        put(folder, f"words-{shard}.before", dense[:, 3].astype(np.uint32))
        kinds = of_counts(dense[:, 3])
        more = int((dense[:, 3] >= 3).sum())
        return pa.table({f"n{i}": pa.array([x], pa.int64()) for i, x in enumerate([*kinds, more])})

    seen = np.zeros(5, np.int64)
    for r in ends.where("shard >= 0").groupBy("shard").applyInArrow(write_ends, "n0 long, n1 long, n2 long, n3 long, n4 long").collect():
        seen += list(r)
    scratch.drop("ends")
    model.d1 = discounts(seen[:4])
    model.back_off = float((model.d1 * [seen[0], seen[1], seen[4]]).sum() / max(model.pairs, 1))
    return model


class Pairs(Shards):
    """Bigram shards, with the exact counts of those counted 255 times or more."""

    def __init__(self, folder, name, sizes, bits, columns, over):
        super().__init__(folder, name, sizes, bits, columns)
        self.over = over

    def column(self, shard: int, column: str) -> np.ndarray:
        if column in ("many", "exact") and (shard, column) not in self._open:
            self._open[shard, column] = mapped(self.folder, f"{self.name}-{shard}.{column}", self.columns[column], self.over[shard])
        return super().column(shard, column)


def unmix(a: np.ndarray) -> np.ndarray:
    """The inverse of mix()."""
    a = a.astype(np.uint64, copy=True)
    undo = lambda x, k: x ^ (x >> np.uint64(k)) ^ (x >> np.uint64(2 * k))
    a = undo(a, 31)
    a *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    a = undo(a, 27)
    a *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return undo(a, 30)


def score_texts(docs: DataFrame, training: Column, id_column: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of all rows, by a model of that order of the rows in `training`."""
    scratch = Scratch(docs.sparkSession)
    folder = scratch.path("model")
    model = train(docs.where(training).select(F.col(text).alias("text")), folder, order)

    def run(batches):
        words = WordIds()
        for b, t in in_chunks(batches, "text", PART):
            hashes, sizes = stream(words, t)
            known, base, score = model.score(hashes, sizes)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(sizes), pa.array(known), pa.array(np.full(len(t), model.tokens)), pa.array(base), pa.array(score)], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *T._parse_datatype_string("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op5_kneser_ney(spark, sf_dir: str, order: int = 2) -> DataFrame:
    """Log-probabilities of all documents, learned from those outside fold 0 of 10."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(10)) == 0, F.lit(False))
    out = score_texts(docs, ~held, order=order)
    held_id = F.coalesce(F.pmod(F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")), F.lit(10)) == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_id.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_kneser_ney_trigram(spark, sf_dir: str) -> DataFrame:
    """As op5_kneser_ney, by a trigram model."""
    return op5_kneser_ney(spark, sf_dir, 3)
