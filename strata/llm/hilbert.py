"""Sharding along a Hilbert curve (operator 1), in DataFrame expressions only.

Several metadata dimensions are quantised by their quantiles, the cell's index on the
Hilbert curve orders all rows, and the order is cut into runs. A file written from a run
covers a small box of the metadata space, so range filters on any dimension skip files.

Edge cases: a null text counts as empty (size 1, crc 0); a null dimension falls in the
lowest cell; an empty table gives no rows; tied and repeated rows get slots of their own;
columns beside the named ones are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import passed

#: Runs into which the distinct values of a string dimension are dealt for ordering, less one. It changes no result.
MOST_RUNS = 255


def curve_states(n: int) -> tuple[list[int], list[int]]:
    """Tables of the n-dimensional Hilbert curve: for state * 2**n + corner, the corner's rank and the next state.

    A state is (entry corner, direction) of a cell; after Hamilton, "Compact Hilbert indices" (2006).
    """
    full = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(full + 1)]
    rank_of = {g: i for i, g in enumerate(gray)}
    ones = lambda i: len(bin(i + 1)) - len(bin(i + 1).rstrip("0"))  # noqa: E731  trailing set bits of i
    entry = [0] + [gray[2 * ((w - 1) // 2)] for w in range(1, full + 1)]
    axis = [0] + [ones(w if w % 2 else w - 1) % n for w in range(1, full + 1)]
    left = lambda x, k: ((x << k) | (x >> (n - k))) & full
    right = lambda x, k: ((x >> k) | (x << (n - k))) & full
    rank, following = [], []
    for state in range((full + 1) * n):
        e, d = state // n, state % n
        for corner in range(full + 1):
            w = rank_of[right(corner ^ e, d + 1)]
            rank.append(w)
            following.append((e ^ left(entry[w], d + 1)) * n + (d + axis[w] + 1) % n)
    return rank, following


def curve_index(coordinates: list[Column], bits: int) -> Column:
    """The Hilbert index of integer coordinates below 2**bits."""
    n = len(coordinates)
    rank, following = curve_states(n)
    ranks, nexts = F.array(*map(F.lit, rank)), F.array(*map(F.lit, following))
    corners = []
    for level in range(bits - 1, -1, -1):
        corner = F.lit(0)
        for j, c in enumerate(coordinates):
            corner = corner + F.shiftleft(F.shiftright(c.cast("int"), level).bitwiseAND(F.lit(1)), j)
        corners.append(corner)
    step = lambda acc, corner: F.struct(
        F.get(nexts, acc["state"] * (1 << n) + corner).alias("state"),
        (acc["h"] * (1 << n) + F.get(ranks, acc["state"] * (1 << n) + corner)).alias("h"),
    )
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.array(*corners), start, step, lambda acc: acc["h"])


def string_borders(values: DataFrame, parts: int, most: int = MOST_RUNS) -> list[str]:
    """Strings that cut the rows of `value` into `parts` of equal counts as nearly as values allow, in code-point order.

    The counts of all distinct values are ordered, in at most `most` + 1 runs of the order that are
    tasks of their own and are shifted by the counts of the runs before them. The values that part
    the runs are those of the smallest hashes; the borders are the same whatever they are.
    """
    counts = values.where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    edges = [r["value"] for r in counts.orderBy(F.xxhash64("value"), "value").select("value").limit(most).collect()]
    counts = counts.withColumn("run", passed(edges, F.col("value")))
    in_run = {r["run"]: r["n"] for r in counts.groupBy("run").agg(F.sum("n").alias("n")).collect()}
    if not in_run:
        return []
    starts = list(accumulate((in_run.get(k, 0) for k in range(len(edges) + 1)), initial=0))
    within = F.coalesce(F.sum("n").over(W.partitionBy("run").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("value", (F.get(F.array(*(F.lit(n).cast("long") for n in starts)), F.col("run")) + within).alias("before"))
    cut = counts.groupBy(F.expr(f"{parts} * before div {starts[-1]}L").alias("part")).agg(F.min("value").alias("border"))
    return sorted((r["border"] for r in cut.where("part > 0").collect()), key=lambda s: s.encode("utf-8", "surrogatepass"))


def hilbert_shards(docs: DataFrame, id_column: str, size: Column, digest: Column, dimensions: list[Column], shards: int, bits: int = 5, salts: int = 256) -> DataFrame:
    """(id, size, digest, cell, curve, shard, slot): runs of the Hilbert order whose row counts differ by one at most.

    What meets in one place: the quantiles (2**bits - 1 borders a dimension), one count for each run
    of strings, and one for each cell (at most 2**(bits * dimensions)); rows
    of a cell, which may be a third of all, are dealt over `salts` parts. Each row is moved once, without its text.
    """
    n = len(dimensions)
    rows = docs.select(F.col(id_column).alias("id"), size.cast("long").alias("size"), digest.alias("digest"), *(d.alias(f"d{j}") for j, d in enumerate(dimensions)))
    strings = {name for name, kind in rows.dtypes if kind == "string"}
    at = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [f"d{j}" for j in range(n) if f"d{j}" not in strings]
    cuts = rows.agg(*(F.percentile_approx(F.col(d).cast("long"), at, 2000).alias(d) for d in numbers)).first() if numbers else {}
    cell = F.lit(0)
    for j in range(n):
        d = f"d{j}"
        if d in strings:
            borders = string_borders(rows.select(F.col(d).alias("value")), 1 << bits)
            in_part = passed(borders, F.col(d))
        else:
            in_part = passed(sorted(set(cuts[d] or [])), F.col(d).cast("long"), strictly=True)
        cell = cell + F.shiftleft(F.when(F.col(d).isNull(), F.lit(0)).otherwise(in_part), j * bits)
    rows = rows.select("id", "size", "digest", cell.alias("cell"), F.pmod(F.xxhash64("id", "size", "digest"), F.lit(salts)).cast("int").alias("salt"))

    parts = rows.groupBy("cell", "salt").agg(F.count(F.lit(1)).alias("n"))
    mask = (1 << bits) - 1
    curve = curve_index([F.shiftright(F.col("cell"), j * bits).bitwiseAND(F.lit(mask)) for j in range(n)], bits)
    cells = parts.groupBy("cell").agg(F.sum("n").alias("in_cell")).withColumn("curve", curve)
    in_order = W.orderBy("curve").rowsBetween(W.unboundedPreceding, -1)  # over at most 2**(bits * n) cells
    cells = cells.select("cell", "curve", F.coalesce(F.sum("in_cell").over(in_order), F.lit(0)).alias("start"), F.sum("in_cell").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    before = W.partitionBy("cell").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(cells), "cell")
    parts = parts.select("cell", "salt", "curve", "total", (F.col("start") + F.col("before")).alias("first"))

    within = F.row_number().over(W.partitionBy("cell", "salt").orderBy("id", "size", "digest")) - 1
    placed = rows.withColumn("within", within).join(parts.hint("merge"), ["cell", "salt"])
    r, total, k = F.col("first") + F.col("within"), F.col("total"), F.lit(shards).cast("long")
    placed = placed.select("id", "size", "digest", "cell", "curve", r.alias("r"), F.expr(f"total div {shards}L").alias("base"), (total % k).alias("extra"))
    long = F.col("extra") * (F.col("base") + 1)
    early = F.col("r") < long
    shard = F.when(early, F.expr("r div (base + 1)")).otherwise(F.col("extra") + F.expr("(r - extra * (base + 1)) div greatest(base, 1L)"))
    placed = placed.withColumn("shard", shard.cast("int"))
    start = F.col("shard") * F.col("base") + F.least(F.col("shard").cast("long"), F.col("extra"))
    return placed.select("id", "size", "digest", "cell", "curve", "shard", (F.col("r") - start).alias("slot"))


def op1_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of equal row counts (law `rows`), along source, language and size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text) + 1
    out = hilbert_shards(docs, "doc_id", size, F.crc32(F.encode(text, "UTF-8")), [F.col("source"), F.col("lang"), size], 8)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("digest").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("curve").alias("curve_index"))
