"""What the operators of this subpackage share: shared-folder tables, salted ranks, word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import Scratch, during, shared_dir, small_batches

__all__ = ["MAX_SENT", "NOT_SPACE", "SPACE", "Scratch", "WordIds", "distinct_counts", "during", "few_rows", "in_chunks", "in_one", "mix", "passed", "ranked", "row_hash", "shared_dir", "small_batches"]

#: Rows of a few numbers that are sent to all executors, at most (some tens of MB); more are joined by shuffles.
MAX_SENT = 500_000

#: White space of every contract here: space and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def ranked(df: DataFrame, keys: list[str], order: list[Column], unique: Column, name: str, salts: int = 64) -> DataFrame:
    """df with `name`: a gapless rank from 0 within keys, and `name_n`: the rows of the key.

    A key may hold any share of all rows: its rows are dealt over `salts` parts by a
    hash of `unique`, ranked within the part by `order`, and shifted by the counts of
    the parts before it. Only counts (at most `salts` rows a key) meet at one place.
    """
    salt = f"{name}_salt"
    df = df.withColumn(salt, F.pmod(F.xxhash64(unique), F.lit(salts)).cast("int"))
    counts = df.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*keys, salt, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy(*keys)).alias(f"{name}_n"))
    within = F.row_number().over(W.partitionBy(*keys, salt).orderBy(*order)) - 1
    left = df.withColumn("_within", within)
    on = [left[k].eqNullSafe(counts[k]) for k in [*keys, salt]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = left.join(counts.hint("merge"), cond, "left")
    keep = [left[c] for c in df.columns if c != salt]
    return out.select(*keep, (F.col("_within") + F.col("_before")).cast("long").alias(name), F.col(f"{name}_n"))


def in_one(df: DataFrame, *beside: str) -> DataFrame:
    """(row, beside...): the other columns in a struct, so that no name of theirs can meet another."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in beside]
    return df.select((F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))).alias("row"), *beside)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns: equal for repeated rows. Maps, which have no order, are hashed as JSON."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*map(plain, df.schema.fields)) if df.columns else F.lit(0).cast("long")


def few_rows(spark, rows: int = 128):
    """Parquet read `rows` rows at a time by the jobs run inside: a reader's arrays hold that many whole texts, and the heap grows with them."""
    return during(spark, "spark.sql.parquet.columnarReaderBatchSize", str(rows))


def passed(borders: list, value: Column, strictly: bool = False) -> Column:
    """How many of the borders are at most (strictly: below) the value."""
    if not borders:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b < value if strictly else b <= value))


class WordIds(dict):
    """63-bit hashes of words (bytes), remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.LIMIT:
            self.clear()
        out = self[word] = xxh3_64_intdigest(word) >> 1
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, A-Z lower-cased; bytes.split() and lower() know only ASCII, as the contracts do."""
        if not text:
            return np.empty(0, np.int64)
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser published with splitmix64)."""
    a = a.astype(np.uint64, copy=True)
    a ^= a >> np.uint64(30)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(27)
    a *= np.uint64(0x94D049BB133111EB)
    a ^= a >> np.uint64(31)
    return a


def distinct_counts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts."""
    if not len(a):
        return a, np.empty(0, np.int64)
    a = np.sort(a)
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    return a[first], np.diff(np.append(first, len(a)))


def in_chunks(batches, column: str, limit: int = 8_000_000):
    """(slice of an Arrow batch, its texts): parts of at most about `limit` bytes of text, one row at least; only a part is Python strings at a time."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(b[column]), 0), dtype=np.int64))
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = b.slice(start, stop - start)
            yield part, part[column].to_pylist()
            start = stop
