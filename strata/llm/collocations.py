"""Phrase collocation mining (operator 11).

Grams of 1 to max_n words become DataFrame rows and are counted by a hash aggregate per language;
phrases are joined with the counts of their beginnings and ends, scored in Decimal by their
lowest cut, freed of what stands in a one-word extension as often, and ranked per language.

A gram is no more frequent than any gram inside it, so only grams that can reach the least count are
exploded: hashes of all words are counted first, then those of pairs of frequent words, of triples
of frequent pairs and so on. What is frequent at a length is told to the following passes by a bitmap of bounded
size, in which a wrong bit only costs rows: phrases are counted by themselves, not by hashes. With more
frequent grams than the bitmap can tell apart, all are exploded.

If a longer phrase holds a candidate nearly as often as the candidate stands anywhere, so does the
extension by one word between them, which is a candidate too: looking at these is enough.

Edge cases: null and empty texts have no words and give nothing; a null language is `und` and is one
with a language so named; rows without an id, repeated rows and copies count each; long texts are
read in parts of whole texts, a text being one at least; ties in rank go to the larger a, then to
the phrase in byte order; without candidates, as of an empty table, there are no rows; columns
beside text and lang, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from xxhash import xxh3_64_intdigest

from .common import MAX_SENT, Scratch, distinct_counts, in_chunks, mix, small_batches
from .kneser_ney import split_blobs

#: Bytes that end a piece, all read as one of them, and what parts words inside a piece.
_TO_BREAK = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
BREAK = b"."
#: The bitmap of frequent grams has so many bits (16 MB), whatever the input.
BITS = 1 << 27
#: Bytes of text whose words are Python objects at a time, and hashes that a task adds up before it gives them.
PART, HELD = 1_000_000, 2_000_000
#: Bytes of text whose hashes one task adds up.
SHARD_BYTES = 24_000_000
#: Phrases are sent to all executors up to so many bytes; more are joined by a shuffle.
SENT_BYTES = 24_000_000
#: Parts that the phrases of a language are dealt over before they are ranked together.
SALTS = 64


class Numbers(dict):
    """Words to numbers from 0, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


class Words:
    """The words of some texts of one language: `at` numbers them in order, with a break wherever a piece ends."""

    def __init__(self, lang: str, texts: list[str]):
        data = "\n".join(texts).encode("utf-8", "surrogatepass").lower()  # bytes know only ASCII letters
        numbers = Numbers({BREAK: 0})
        tokens = data.translate(_TO_BREAK).replace(BREAK, b" . ").split()
        self.at = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        self.words = [*numbers]
        self.seed = xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))

    def keys(self) -> np.ndarray:
        """A hash of each distinct word and the language."""
        return np.fromiter((xxh3_64_intdigest(w, self.seed) for w in self.words), np.uint64, len(self.words))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def by_language(batches):
    """Words of parts of the input, by language."""
    for part, texts in in_chunks(batches, "text", PART):
        groups: dict[str, list[str]] = {}
        for lang, text in zip(part["lang"].to_pylist(), texts, strict=True):
            if text:
                groups.setdefault("und" if lang is None else lang, []).append(text)
        del texts
        for lang, group in groups.items():
            yield lang, Words(lang, group)


class Frequent:
    """A bitmap of keys; without one, everything may be frequent."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(keys), bool)
        at = (keys & np.uint64(BITS - 1)).astype(np.int64)
        return (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def frequent(keys: DataFrame) -> Frequent:
    """The bitmap of `key`: at most BITS / 64 numbers come to the driver, however many keys there are."""
    bit = F.col("key").bitwiseAND(F.lit(BITS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.select(F.shiftright(bit, 6).alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    found = rows.toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[np.array(found["at"], dtype=np.int64)] = np.array(found["bits"], dtype=np.int64).view(np.uint64)
    return Frequent(None if len(found) > BITS // 128 else bits)  # half full of numbers: most keys would pass


class Levels:
    """Places of a text's grams that may be frequent, length by length. seen: bitmaps of the lengths from 1 that are known."""

    def __init__(self, words: Words, seen: list):
        self.words, self.seen = words, seen
        self.of_words = words.keys()
        self.size = 1
        self.at = np.flatnonzero(words.at)  # the places where a gram of `size` words begins
        self.keys = self.of_words[words.at[self.at]]

    def sift(self) -> np.ndarray:
        """Drops the grams that are not frequent; of those before, which stayed."""
        stays = self.seen[self.size - 1].value.may_hold(self.keys)
        self.at, self.keys = self.at[stays], self.keys[stays]
        return stays

    def longer(self) -> np.ndarray:
        """Goes on to grams of one word more, both of whose parts are here; of those before, which are their beginnings."""
        follows = np.zeros(len(self.at), bool)
        follows[:-1] = self.at[1:] == self.at[:-1] + 1
        at = self.at[follows]
        self.keys = pair_keys(self.keys[follows], self.of_words[self.words.at[at + self.size]])
        self.at, self.size = at, self.size + 1
        return follows


def hash_rows(size: int, seen: list, bits: int):
    """(shard, keys, counts): hashes of the grams of `size` words whose parts may be frequent, added up and cut by their leading bits."""

    def rows(held):
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, back = np.unique(keys, return_inverse=True)
        counts = np.bincount(back, counts, len(keys)).astype(np.int64)
        return split_blobs(keys, counts, bits)

    def run(batches):
        held, n = [], 0
        for _, words in by_language(batches):
            grams = Levels(words, seen)
            for _ in range(size - 1):
                grams.sift()
                grams.longer()
            held.append(distinct_counts(grams.keys))
            n += len(held[-1][0])
            if n > HELD:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    return run


def often(least: int):
    """key: of a shard's hashes those found `least` times or more."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["a"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["b"]])
        keys, back = np.unique(keys, return_inverse=True)
        found = keys[np.bincount(back, counts, len(keys)) >= least]
        return pa.table({"key": pa.array(found.view(np.int64))})

    return run


def phrase_rows(seen: list):
    """(lang, size, phrase, n): the grams that may be frequent, by part of the text, and all words as the phrase of size 0."""

    def grams(words: Words):
        """(size, gram, count); grams are told apart by numbers, not by hashes."""
        levels = Levels(words, seen)
        number = words.at[levels.at]
        yield 0, b"", len(number)
        for size in range(1, len(seen) + 1):
            number = number[levels.sift()]
            _, first, number, n = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
            for i, c in zip(levels.at[first].tolist(), n.tolist(), strict=True):
                yield size, b" ".join([words.words[w] for w in words.at[i : i + size].tolist()]), c
            if size < len(seen):
                begins = number[levels.longer()]
                number = begins * len(words.words) + words.at[levels.at + size]

    def run(batches):
        for lang, words in by_language(batches):
            size, phrase, n = zip(*grams(words), strict=True)
            text = [p.decode("utf-8", "replace") for p in phrase]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(size, pa.int32()), pa.array(text), pa.array(n, pa.int64())], ["lang", "size", "phrase", "n"])

    return run


def phrase_counts(docs: DataFrame, max_n: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all grams of 1 to max_n words found `least` times or more, and (lang, total) of all words."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select("text", "lang")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // SHARD_BYTES).bit_length())
    seen: list = []
    with small_batches(spark):
        for n in range(1, max_n + 1):
            hashes = rows.mapInArrow(hash_rows(n, list(seen), bits), "shard int, a binary, b binary")
            keys = scratch.table(hashes.groupBy("shard").applyInArrow(often(least), "key long"), f"frequent{n}")
            seen.append(spark.sparkContext.broadcast(frequent(keys)))
        grams = rows.mapInArrow(phrase_rows(list(seen)), "lang string, size int, phrase string, n long")
        counts = grams.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f"))
        counts = scratch.table(counts.where((F.col("f") >= least) | (F.col("size") == 0)), "counts")
    for n, b in enumerate(seen):
        b.unpersist()
        scratch.drop(f"frequent{n + 1}")
    return counts.where("size > 0"), counts.where("size = 0").select("lang", F.col("f").alias("total"))


def best_cuts(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, size, phrase, a, k, l, r, n, score) of phrases of two words or more, at the cut of the lowest score; of equal ones the first."""
    size = counts.agg(F.count(F.lit(1)), F.sum(F.octet_length("phrase"))).first()
    small = size[0] <= MAX_SENT and (size[1] or 0) <= SENT_BYTES
    side = lambda df: F.broadcast(df) if small else df
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cut = counts.where("size > 1").withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "size", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cut = cut.join(side(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))), ["lang", "first"])
    cut = cut.join(side(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))), ["lang", "rest"])
    cut = cut.join(totals.select("lang", F.col("total").alias("n")), "lang")
    exact = lambda c: F.col(c).cast(T.DecimalType(38, 0))
    scored = cut.withColumn("score", F.call_function("div", F.lit(1000).cast(T.DecimalType(38, 0)) * exact("a") * exact("n"), exact("l") * exact("r")))
    best = scored.groupBy("lang", "size", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "size", "phrase", "a", "cut.k", "cut.l", "cut.r", "n", "cut.score")


def without_parts(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """phrases (lang, size, phrase, a, ...) that are not inside an extension by one word found `percent` of their times or more."""
    words = F.split("phrase", " ")
    inner = F.array(F.slice(words, F.lit(1), F.col("size") - 1), F.slice(words, F.lit(2), F.col("size") - 1))
    within = phrases.where("size > 2").select("lang", F.explode(inner).alias("words"), F.col("a").alias("longer"))
    within = within.select("lang", F.array_join("words", " ").alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    p, x = phrases.alias("p"), within.alias("x")
    inside = (F.col("p.lang") == F.col("x.lang")) & (F.col("p.phrase") == F.col("x.phrase")) & (100 * F.col("x.longer") >= percent * F.col("p.a"))
    return p.join(x, inside, "left_anti")


def first_of_each_language(phrases: DataFrame, most: int, salts: int = SALTS) -> DataFrame:
    """phrases with rank, from 1, up to `most` a language: the first of `salts` parts of each language, then the first of these."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int")
    some = phrases.withColumn("part", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return some.drop("part").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, max_n: int = 5, least: int = 100, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, size, a, k, l, r, n, score) of docs (text, lang): phrases of 2 to max_n words found `least` times or more, `most` a language."""
    counts, totals = phrase_counts(docs, max_n, least)
    phrases = Scratch(docs.sparkSession).table(best_cuts(counts, totals), "phrases")
    return first_of_each_language(without_parts(phrases), most)


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    out = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
