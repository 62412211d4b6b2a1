"""Deduplication in which the first of its kind wins.

Exact copies: the first row of each content hash. Near copies: row i stays iff no kept earlier
row is similar, which is the lexicographically first maximal independent set of the similarity
graph; it is found in parallel rounds (Blelloch, Fineman, Shun 2012), from pairs or from lists of
rows that may be similar.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import content_hash, tokens
from ..scratch import Scratch, small_batches

#: Shingles whose order is sent to all executors, at most. None of these numbers changes a result.
MAX_SENT = 500_000
#: Ids of sets to be compared that are sent to all executors, at most; of more the sets are joined by a shuffle.
MOST_NAMED = 2_000_000
#: Members of a family of near copies that are dealt into one bucket, about.
FAMILY = 128
#: Shingles that are counted together, and how often one of them is there to be told.
CHUNK, AGAIN = 4_000_000, 4


def first_of_each(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key. The order must be unique for the result to be."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def exact_dedup(df: DataFrame, text: str, *order: Column) -> DataFrame:
    """The first row of each normalised text; only hashes and order columns are compared."""
    return first_of_each(df.withColumn("content_hash", content_hash(F.col(text))), F.col("content_hash"), *order)


def exact_dedup_in_place(df: DataFrame, id_column: str, text: str, order: str) -> DataFrame:
    """exact_dedup() of a table that is read without work: its texts are read twice and not moved, only their hashes and the ids of copies are."""
    own = df.select(F.col(id_column).alias("id"), F.col(order).alias("ord"), F.xxhash64(text).alias("raw"), F.unhex(content_hash(F.col(text))).alias("hash"))
    w = W.partitionBy("hash").orderBy("ord", "id")
    later = own.withColumn("rn", F.row_number().over(w)).withColumn("first", F.first("id").over(w)).where("rn > 1")
    copies, n, twins = Scratch(df.sparkSession).counted(later.select(F.col("id").alias("_id"), F.col("raw").alias("_raw"), F.col("id").eqNullSafe(F.col("first")).alias("twin")), "copies", "twin")
    if twins:  # rows of one id and one text: the id does not tell which of them stays
        return exact_dedup(df, text, F.col(order), F.col(id_column))
    copies = copies.drop("twin")
    copy = F.col(id_column).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_raw"))  # an id may have other texts too
    return df.join(F.broadcast(copies) if n <= MOST_NAMED else copies, copy, "left_anti").withColumn("content_hash", content_hash(F.col(text)))


def shingle_sets(df: DataFrame, id_column: str, text: str, k: int = 5) -> DataFrame:
    """(id, n, set): sorted distinct 64-bit hashes of the k-word shingles."""
    words = df.select(F.col(id_column).alias("id"), tokens(F.col(text)).alias("words"))  # a column of its own: a lambda would work it out for each shingle
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (k - 1), F.lit(1)))
    # As of shingles(), but made distinct as hashes; sort_array orders numbers without calling a lambda for each two.
    hashes = F.sort_array(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("words", i, F.lit(k)), " ")))))
    return words.select("id", hashes.alias("set")).withColumn("n", F.size("set"))


def common_shingles(sets: DataFrame) -> np.ndarray:
    """The most frequent shingles, rarest first, as far as chunks of the sets tell: at most MAX_SENT.

    Each chunk of CHUNK shingles tells those that it holds AGAIN times or more. So one that more than (AGAIN - 1)
    times the number of chunks of sets hold is told for sure, and what is shuffled is not all shingles but the repeated ones.
    """

    def told(batches):
        held, size = np.empty(CHUNK, np.int64), 0  # filled and sorted in place: what a chunk takes is this array, and marks of a byte

        def counts():
            h = held[:size]
            h.sort()
            again = h[AGAIN - 1 :] == h[: max(size - AGAIN + 1, 0)]  # a run of AGAIN begins here
            again[1:] &= h[1 : len(again)] != h[: max(len(again) - 1, 0)]  # and its shingle too
            begins = np.flatnonzero(again)
            n = np.searchsorted(h, h[begins], "right") - begins
            return pa.RecordBatch.from_arrays([pa.array(h[begins], pa.int64()), pa.array(n, pa.int64())], ["h", "df"])

        for b in batches:
            h = b.column(0).flatten().to_numpy(zero_copy_only=False)
            while len(h):
                part, h = h[: CHUNK - size], h[CHUNK - size :]
                held[size : size + len(part)] = part
                size += len(part)
                if size == CHUNK:
                    yield counts()
                    size = 0
        if size:
            yield counts()

    found = sets.select("set").mapInArrow(told, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))
    with small_batches(sets.sparkSession):  # or a worker holds the sets of 10,000 texts beside its chunk
        most = found.orderBy(F.desc("df"), "h").limit(MAX_SENT).toArrow()
    return most.column("h").to_numpy()[::-1]


def prefix_lists(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, h): shingles under which each set is looked for, so that any two sets of Jaccard similarity of threshold or more share one.

    Prefix filtering: in any one order of all shingles, two such sets share a shingle among the
    first n - ceil(threshold * n) + 1 of each. Here the common ones come last, the most frequent at the end, and
    the others by their hashes, which needs no count of all shingles; the order changes no result. A shingle that only one
    set is looked for under meets nothing and is left out. `sets` should be a written table: it is read twice. So is what is returned.
    """
    spark = sets.sparkSession
    common = common_shingles(sets)
    by_hash = np.argsort(common)
    known = spark.sparkContext.broadcast((common[by_hash], by_hash + 1))

    def first(batches):
        sorted_hashes, places = known.value
        for b in (whole.slice(k, 100) for whole in batches for k in range(0, whole.num_rows, 100)):
            lists, n = b.column(2), b.column(1).to_numpy()
            h, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(sorted_hashes, h), max(len(sorted_hashes) - 1, 0))
            place = np.where(sorted_hashes[at] == h, places[at], 0) if len(sorted_hashes) else np.zeros(len(h), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((h, place, row))
            rank = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            needed = np.ceil(threshold * n - 1e-9).astype(np.int64)
            keep = rank < (n - needed + 1)[row]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[keep])), pa.array(n[row[keep]], pa.int32()), pa.array(h[order][keep], pa.int64())], schema=pa.schema([("id", b.schema.field(0).type), ("n", pa.int32()), ("h", pa.int64())]))

    kind = T.StructType([sets.schema["id"], T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType())])
    entries = sets.select("id", "n", "set").mapInArrow(first, kind).withColumn("sets", F.count(F.lit(1)).over(W.partitionBy("h")))  # moved once: counted where they are brought together
    with small_batches(spark):
        return Scratch(spark).table(entries.where("sets > 1").select("id", "n", "h"), "prefixes")


def sizes_allow(threshold: float) -> Callable[[str, str], Column]:
    """Whether the sizes of two sets leave room for the similarity."""
    return lambda a, b: F.least(f"{a}.n", f"{b}.n") >= F.lit(threshold) * F.greatest(f"{a}.n", f"{b}.n") - 1e-9


def shared_at_least(threshold: float) -> Callable[[str, str], Column]:
    """How many entries of prefix_lists() two similar sets share at least.

    Of the two prefixes, take the one that ends first in the order of all shingles. What the sets share up to there both prefixes hold; what
    they share beyond is in the rest of its set, which has ceil(threshold * n) - 1 shingles.
    """

    def least(a: str, b: str) -> Column:
        common = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col(f"{a}.n") + F.col(f"{b}.n")) - 1e-9)
        return common - (F.ceil(F.lit(threshold) * F.greatest(f"{a}.n", f"{b}.n") - 1e-9) - 1)

    return least


def _placed(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the cell (place, i, j) where they are compared, so that a set goes to few cells and a cell holds few sets.

    A row's home is the least id among it and its partners; a pair's place is the lesser of its two homes. So the sets of a family
    meet in one place, whatever pairs it has. The members of a place of more than FAMILY are dealt into buckets, and its pairs into cells by two buckets each.
    """
    scratch = Scratch(pairs.sparkSession)
    sides = pairs.select(F.col("a").alias("id"), F.least("a", "b").alias("home")).unionAll(pairs.select("b", F.least("a", "b")))
    homes = scratch.table(sides.groupBy("id").agg(F.min("home").alias("home")), "homes")
    named = lambda c: homes.select(F.col("id").alias(c), F.col("home").alias(f"home_{c}"))
    placed = scratch.table(pairs.select("a", "b").join(named("a"), "a").join(named("b"), "b").select("a", "b", F.least("home_a", "home_b").alias("place")), "placed")
    members = placed.select("place", F.col("a").alias("id")).unionAll(placed.select("place", "b")).distinct()
    large = scratch.table(members.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / FAMILY).cast("int").alias("buckets")).where("buckets > 1"), "large")
    dealt = placed.join(large, "place", "left").withColumn("buckets", F.coalesce("buckets", F.lit(1)))
    bucket = lambda c: F.pmod(F.xxhash64(c), "buckets").cast("int")
    return scratch.table(dealt.select("a", "b", "place", F.least(bucket("a"), bucket("b")).alias("i"), F.greatest(bucket("a"), bucket("b")).alias("j")), "cells")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of those pairs (a, b) whose whole sets are similar. Of `sets`, which may be many, only those of the pairs are moved, and not once a pair."""
    scratch = Scratch(sets.sparkSession)
    pairs = _placed(scratch.table(pairs.select("a", "b"), "met"))
    cell = ("place", "i", "j")
    wanted, n = scratch.counted(pairs.select(F.col("a").alias("id"), *cell).unionAll(pairs.select("b", *cell)).distinct(), "wanted")
    ids = wanted.select("id").distinct()
    there = sets.select("id", "set").join(F.broadcast(ids) if n <= MOST_NAMED else ids, "id", "left_semi").join(F.broadcast(wanted) if n <= MOST_NAMED // 4 else wanted, "id")

    def compared(pairs: pa.Table, there: pa.Table) -> pa.Table:
        names = there["id"].combine_chunks()
        x, y = (pc.index_in(pairs[c], names).to_numpy() for c in ("a", "b"))
        held = there["set"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
        ends, h = np.cumsum(sizes), held.flatten().to_numpy(zero_copy_only=False)
        own = lambda k: h[ends[k] - sizes[k] : ends[k]]
        common = np.array([len(np.intersect1d(own(i), own(j), assume_unique=True)) for i, j in zip(x, y, strict=True)], np.int64)
        jaccard = common / np.maximum(sizes[x] + sizes[y] - common, 1)
        return pairs.select(["a", "b"]).append_column("jaccard", pa.array(jaccard)).filter(pa.array(jaccard >= threshold))

    kind = T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("jaccard", T.DoubleType())])
    return pairs.groupBy(*cell).cogroup(there.groupBy(*cell)).applyInArrow(compared, kind)


def _met_enough(met: DataFrame, x: str, y: str, shared: Callable[[str, str], Column] | None) -> DataFrame:
    """Different pairs (a, b) of met entries x and y, of those that met often enough to be similar."""
    pairs = met.select(F.col(f"{x}.id").alias("a"), F.col(f"{y}.id").alias("b"), *([shared(x, y).alias("least")] if shared else []))
    if shared is None:
        return pairs.distinct()
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("least").alias("least")).where("shared >= least").select("a", "b")


def similar_pairs(sets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, jaccard) with a < b of different sets with Jaccard similarity of threshold or more: all pairs, as a report of them is. Sets should be distinct."""
    sets = Scratch(sets.sparkSession).table(sets, "sets")  # read three times; and a filter pushed below would work the sets out again
    prefixes = prefix_lists(sets, threshold)
    a, b = prefixes.alias("a"), prefixes.alias("b")
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id")) & sizes_allow(threshold)("a", "b"))
    return verified(_met_enough(met, "a", "b", shared_at_least(threshold)), sets, threshold)


#: Constants of the 64-bit xxHash.
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P[1]
    x = (x ^ (x >> np.uint64(29))) * _P[2]
    return x ^ (x >> np.uint64(32))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hashed_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """xxhash64(x) of longs."""
    start = np.uint64(seed) + _P[4] + np.uint64(8)
    return _mixed(_turned(start ^ (_turned(x.view(np.uint64) * _P[1], 31) * _P[0]), 27) * _P[0] + _P[3])


def _hashed_int(k: int, seeds: np.ndarray) -> np.ndarray:
    """xxhash64(..., k) after columns that gave the seeds."""
    return _mixed(_turned((seeds + (_P[4] + np.uint64(4))) ^ (np.uint64(k) * _P[0]), 23) * _P[1] + _P[2])


def minhash_signatures(sets: DataFrame, permutations: int = 128) -> DataFrame:
    """(id, signature): the least xxhash64(h, k) of the set under each permutation k; hashed by arrays, as lambdas are not compiled."""

    def signed(batches):
        with np.errstate(over="ignore"):
            for b in (whole.slice(k, 100) for whole in batches for k in range(0, whole.num_rows, 100)):
                h = b.column(1).flatten().to_numpy(zero_copy_only=False)
                sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
                full = np.flatnonzero(sizes)
                starts, seeds = (np.cumsum(sizes) - sizes)[full], _hashed_long(np.ascontiguousarray(h))
                least = np.empty((permutations, len(full)), np.int64)
                for k in range(permutations if len(full) else 0):
                    least[k] = np.minimum.reduceat(_hashed_int(k + 1, seeds).view(np.int64), starts)
                rows = np.zeros((len(sizes), permutations), np.int64)
                rows[full] = least.T
                none = np.repeat(sizes == 0, permutations)  # an empty set has no least hash
                values = pa.array(rows.ravel(), pa.int64(), mask=none)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sizes) * permutations + 1, permutations), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "signature"])

    return sets.select("id", "set").mapInArrow(signed, T.StructType([sets.schema["id"], T.StructField("signature", T.ArrayType(T.LongType()))]))


def bands_for(threshold: float, permutations: int = 128) -> tuple[int, int]:
    """(bands, rows) that make false positives and false negatives fewest, by the area under the S-curve."""
    best, chosen = math.inf, (1, permutations)
    steps = [(i + 0.5) / 200 for i in range(200)]
    for bands in range(1, permutations + 1):
        for rows in range(1, permutations // bands + 1):
            p = [1 - (1 - s**rows) ** bands for s in steps]
            error = sum(x if s < threshold else 1 - x for x, s in zip(p, steps, strict=True))
            if error < best:
                best, chosen = error, (bands, rows)
    return chosen


def lsh_candidates(sets: DataFrame, threshold: float = 0.85, permutations: int = 128) -> DataFrame:
    """(a, b): pairs whose signatures agree in all rows of a band."""
    bands, rows = bands_for(threshold, permutations)
    banded = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("signature", b * rows + 1, rows)).alias("key")))
    scratch = Scratch(sets.sparkSession)
    sets = scratch.table(sets, "sets")  # else each permutation would work the set out again
    signatures = scratch.table(minhash_signatures(sets, permutations), "signatures")
    buckets = signatures.select("id", F.explode(banded).alias("b")).select("id", "b.band", "b.key")
    x, y = buckets.alias("x"), buckets.alias("y")
    return x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def first_wins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of `nodes` (id, ord) that stay: greedy in the order of ord, with `edges` (a, b) between similar ones."""
    scratch = Scratch(nodes.sparkSession)
    order = nodes.select("id", "ord")
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    linked = both.join(order.select(F.col("id").alias("a"), F.col("ord").alias("ord_a")), "a").join(order.select(F.col("id").alias("b"), F.col("ord").alias("ord_b")), "b")
    left = scratch.table(linked.where("ord_a < ord_b").select("a", "b"), "edges0")  # a comes before b
    dropped = scratch.table(left.select(F.col("b").alias("id")).where("false"), "dropped0")
    k = 0
    while left.limit(1).count():
        k += 1
        # A node with no undecided predecessor stays; its successors go, and with them their edges.
        sure = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = scratch.table(left.join(sure, "a", "left_semi").select(F.col("b").alias("id")).distinct(), f"gone{k}")
        dropped = scratch.table(dropped.unionAll(gone), f"dropped{k}")
        rest = left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        left = scratch.table(rest, f"edges{k}")
        scratch.drop(f"edges{k - 1}", f"dropped{k - 1}", f"gone{k}")
    return order.join(dropped, "id", "left_anti").select("id")


def first_wins_in_lists(nodes: DataFrame, entries: DataFrame, close: Callable[[str, str], Column], similar: Callable[[DataFrame], DataFrame] | None = None, worth: float = 4.0, most_rounds: int = 40, least_shared: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Ids of `nodes` (id, ord) that stay, as first_wins() would tell from all similar pairs, which are not made.

    entries (h, id, ...): any two similar rows share an h. close(a, b) is a condition on two entries that
    all similar rows meet; similar() keeps the similar ones of pairs (a, b), all if it is left out. least_shared(a, b), if given, tells how many h any two similar rows share at least.

    A row that comes first in each of its lists has no similar row before it: it stays, and the rest of its
    lists is compared with it alone. What is like it goes, and the lists are shorter in the next round. So a
    family of copies costs one link a member, not all its pairs. Once lists are so short that
    all pairs are at most `worth` times the entries, or rounds no longer shorten them, the pairs that are left are made.
    """
    scratch = Scratch(nodes.sparkSession)
    columns = [c for c in entries.columns if c != "ord"]
    left = scratch.table(entries.select(*columns).join(nodes.select("id", "ord"), "id"), "left0")
    dropped = scratch.table(nodes.select("id").where("false"), "gone0")
    keep_similar = similar or (lambda pairs: pairs)
    before = None
    for k in range(1, most_rounds + 1):
        lists = scratch.table(left.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("first")).where("size > 1"), f"lists{k}")
        size = lists.agg(F.sum("size"), F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()
        if not size[0] or size[1] <= worth * size[0] or before is not None and size[1] > 0.9 * before:
            break
        before = size[1]
        shared = scratch.table(left.join(lists.select("h", "first"), "h"), f"shared{k}")  # lists of one row decide nothing
        sure = shared.groupBy("id").agg(F.min(F.col("ord") == F.col("first")).alias("leads")).where("leads").select("id")
        sure = scratch.table(sure, f"sure{k}")
        heads = scratch.table(shared.join(sure, "id", "left_semi").drop("first"), f"heads{k}")  # one a list
        x, y = heads.alias("x"), shared.alias("y")
        met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.ord") < F.col("y.ord")) & close("x", "y"))
        gone = keep_similar(_met_enough(met, "x", "y", least_shared)).select(F.col("b").alias("id")).distinct()
        gone = scratch.table(gone, f"gone{k}")
        dropped = dropped.unionAll(gone)
        left = scratch.table(shared.drop("first").join(sure, "id", "left_anti").join(gone, "id", "left_anti"), f"left{k}")
        scratch.drop(f"left{k - 1}", f"shared{k}", f"heads{k}", f"sure{k}", f"lists{k}")
    x, y = left.alias("x"), left.alias("y")
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.ord") < F.col("y.ord")) & close("x", "y"))
    pairs = scratch.table(keep_similar(_met_enough(met, "x", "y", least_shared)).select("a", "b"), "pairs")
    undecided = nodes.join(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))), "id", "left_semi")
    stays = first_wins(undecided, pairs)
    dropped = dropped.unionAll(undecided.select("id").join(stays, "id", "left_anti"))
    return nodes.select("id").join(dropped, "id", "left_anti")


def dedup_text(df: DataFrame, id_column: str, text: str, order: str, enabled: bool = True, threshold: float = 0.85, approximate: bool = False, hashed: str | None = None, stored: bool = False) -> DataFrame:
    """df without exact copies and, if enabled, without near copies of kept rows. hashed: the column that holds content_hash() of the text, if one does. stored: df is a table that is read without work, so it is read again instead of moved and written."""
    if stored and not hashed:
        unique = exact_dedup_in_place(df, id_column, text, order)
    else:
        unique = first_of_each(df, F.col(hashed), F.col(order), F.col(id_column)) if hashed else exact_dedup(df, text, F.col(order), F.col(id_column))
    if not enabled:
        return unique
    if not stored:
        unique = Scratch(df.sparkSession).table(unique, "unique")
    sets = shingle_sets(unique.where(F.length(F.trim(F.col(text))) > 0), id_column, text)
    sets = Scratch(df.sparkSession).table(sets, "sets")
    # Of rows with equal sets (the same words, but repeated otherwise) only the first can stay: what is like it is like them.
    ords = unique.select(F.col(id_column).alias("id"), F.struct(order, id_column).alias("ord"))
    digests = sets.where("n > 0").select("id", "n", F.xxhash64("set").alias("x"), F.hash("set").alias("y")).join(ords, "id")
    later = digests.join(digests.groupBy("n", "x", "y").agg(F.min("ord").alias("first")), ["n", "x", "y"]).where("ord != first").select("id")
    later = Scratch(df.sparkSession).table(later, "later")
    ords = ords.join(later, "id", "left_anti")
    if approximate:  # pairs that meet in a band, if they are similar
        sets = sets.join(later, "id", "left_anti")
        both = lsh_candidates(sets, threshold).join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        pairs = both.where(common >= F.lit(threshold) * (F.size("x") + F.size("y") - common)).select("a", "b")
        kept = first_wins(ords, pairs)
    else:
        entries = prefix_lists(sets, threshold).join(later, "id", "left_anti")  # the sets themselves are neither moved nor written again
        kept = first_wins_in_lists(ords, entries, sizes_allow(threshold), lambda pairs: verified(pairs, sets, threshold), least_shared=shared_at_least(threshold))
    return unique.join(kept.withColumnRenamed("id", id_column), id_column, "left_semi")
