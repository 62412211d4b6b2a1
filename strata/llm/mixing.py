"""Mixing sources to target weights (operator 3) by entropy balancing.

Rates r of documents minimise the sum of r log(r/1) + (2-r) log((2-r)/1), the relative entropy
to taking each once that stays below two, under one token constraint a source. The convex
dual has one multiplier a source, and the rates are exponentially tilted by size:
r = 2 / (1 + exp(-lambda * size / scale)). Newton steps solve all sources at once; each step is
one aggregation over counts by (source, size). Rates then become whole copies, 0 to 2.

Edge cases: a null text has size 0 and is never taken; a null source is a source, last in
order; sources without words have target 0; a source at twice its size takes all twice; ties
go by a hash of the id, then by the id, then by a hash of the text; repeated rows are rows, and so are rows without an id or of one
id; empty tables give no rows; columns beside the named ones, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import MAX_SENT, Scratch, row_hash

#: Weights by the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: A column name that documents do not use.
KEY = "__mixing_key"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def with_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, docs) -> the same with target: shares by weight, stopped at `most` times the size, the excess dealt again.

    The level at which all shares stop is found in closed form: in the order of
    most * size / weight, the sources before a point are full, the others share the rest.
    The table has one row a source, however many documents it has, and is ordered as a whole.
    """
    # Code-point order is byte order of UTF-8, which is how Spark compares strings.
    whole = W.orderBy(F.col("source").asc_nulls_last())
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    upto, after = by_level.rowsBetween(W.unboundedPreceding, 0), by_level.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = sources.withColumn("w", F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(whole) - 1, F.lit(len(weights)))).cast("double"))
    out = out.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("w"))
    out = out.withColumn("wanted", share * F.sum("source_size").over(every))
    # If this source and those after it were open, their level would be:
    out = out.withColumn("open_level", (F.col("wanted") - F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(after))
    out = out.withColumn("stands", F.when(F.col("level") > F.col("open_level"), F.col("open_level")))
    out = out.withColumn("final", F.min_by("stands", F.when(F.col("stands").isNotNull(), F.col("level"))).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("w"), F.col("cap")))
    return out.select(*sources.columns, F.greatest(target, F.lit(0.0)).alias("target"))


def solve(spark, scratch: Scratch, counts: DataFrame, sources: DataFrame, tolerance: float = 1e-7, most_steps: int = 60) -> DataFrame:
    """(source key, lambda): safeguarded Newton steps on the dual, one aggregation over all counts each.

    Each source keeps a bracket of its multiplier; a step that leaves it is replaced by its middle.
    The driver sees one number a step: how far the worst source is from its target.
    """
    scale = F.col("source_size") / F.greatest("docs", F.lit(1))
    state = sources.where((F.col("source_size") > 0) & (F.col("target") < 2 * F.col("source_size") * (1 - 1e-12))).select("sid", "source_size", "target", scale.alias("scale"), F.lit(0.0).alias("lam"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"))
    state = scratch.table(state, "dual0")
    for step in range(1, most_steps + 1):
        rows = counts.join(state, "sid")
        x = F.col("size") / F.col("scale")
        rate = 2 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * x))))
        slope = F.col("n") * F.col("size") * x * rate * (1 - rate / 2)
        keys = ["sid", "source_size", "target", "scale", "lam", "lo", "hi"]
        got = rows.groupBy(*keys).agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(slope).alias("slope"))
        gap = F.col("target") - F.col("got")
        got = got.withColumn("gap", gap).withColumn("lo", F.when(gap > 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap <= 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") + F.col("gap") / F.greatest(F.col("slope"), F.lit(1e-300))
        middle = F.when(F.col("hi") >= 1e9, F.greatest(2 * F.col("lo"), F.lit(1.0))).when(F.col("lo") <= -1e9, F.least(2 * F.col("hi"), F.lit(-1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) < 50)
        off = F.abs("gap") / F.greatest("target", F.lit(1.0))
        done = off < tolerance
        following = F.when(done, F.col("lam")).when(inside, newton).otherwise(middle)
        state = scratch.table(got.select("sid", "source_size", "target", "scale", following.alias("lam"), "lo", "hi", off.alias("off")), f"dual{step}")
        scratch.drop(f"dual{step - 1}")
        worst = state.agg(F.max("off")).first()[0]
        state = state.drop("off")
        if worst is None or worst < tolerance:
            break
    return state.select("sid", "lam", "scale")


def whole_copies(sizes: np.ndarray, n: np.ndarray, rates: np.ndarray, target: float) -> np.ndarray:
    """Copies taken of the n documents of each size, 0 to 2n: nearest to the rates, with what rounding leaves carried from large sizes to small."""
    order = np.argsort(-sizes, kind="stable")
    taken = np.zeros(len(n), np.int64)
    owed = 0.0
    for i in order:
        if sizes[i] <= 0:
            continue
        ideal = n[i] * rates[i] * sizes[i] + owed
        k = int(min(max(round(ideal / sizes[i]), 0), 2 * n[i]))
        taken[i] = k
        owed = ideal - k * sizes[i]
    return taken


def balanced_copies(docs: DataFrame, salts: int = 64) -> DataFrame:
    """(id, size, source, source_size, target, rate, copies) of docs (id, source, size), and `mark` and `row` if they have these.

    All stages but the last work on counts by (source, size). One source may hold a third of
    all rows and one size of it as many: counts add up before any shuffle, and documents are
    dealt over `salts` parts of each (source, size), by id and mark, as many may have one id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    marks = [c for c in ("mark", "row") if c in docs.columns]
    salt = F.pmod(F.xxhash64("id", *marks[:1]), F.lit(salts)).cast("int")
    # A key without nulls, so that joins on the source are plain equalities.
    sid = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    parts = scratch.table(docs.groupBy(sid.alias("sid"), "size", salt.alias("salt")).agg(F.count(F.lit(1)).alias("n")), "parts")
    counts = scratch.table(parts.groupBy("sid", "size").agg(F.sum("n").alias("n")), "counts")
    sources = counts.groupBy("sid").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sources = sources.withColumn("source", F.when(F.col("sid") != "0", F.expr("substring(sid, 2)")))
    sources = scratch.table(with_targets(sources), "sources")
    solved = scratch.table(solve(spark, scratch, counts, sources), "solved")

    known = counts.join(sources.select("sid", "source_size", "target"), "sid").join(solved, "sid", "left")
    tilt = 2 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * F.col("size") / F.col("scale")))))
    full = F.when(F.col("size") == 0, 0.0).otherwise(2.0)
    known = known.select("sid", "size", "n", "source_size", "target", F.coalesce(tilt, full).alias("rate"))

    def round_source(pdf: pd.DataFrame) -> pd.DataFrame:
        """Over the distinct sizes of one source: as many rows as documents have lengths, not as there are documents."""
        pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
        pdf["taken"] = whole_copies(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy(), float(pdf["target"].iloc[0]))
        return pdf

    rounded = scratch.table(known.groupBy("sid").applyInPandas(round_source, "sid string, size long, n long, source_size long, target double, rate double, taken long"), "rounded")
    before = W.partitionBy("sid", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("sid", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(rounded.hint("merge"), ["sid", "size"])
    ranks = docs.select("id", "source", "size", *marks, sid.alias("sid"), salt.alias("salt"))
    ranks = ranks.withColumn("within", F.row_number().over(W.partitionBy("sid", "size", "salt").orderBy(F.xxhash64("id"), "id", *marks)) - 1)
    out = ranks.join(parts.hint("merge"), ["sid", "size", "salt"])
    extra = F.when(F.col("before") + F.col("within") < F.col("taken") % F.col("n"), 1).otherwise(0)
    return out.select("id", "size", "source", *marks, "source_size", "target", "rate", (F.expr("taken div n") + extra).cast("long").alias("copies"))


def op3_entropy_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken of each."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = scratch.table(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")), "sized")
    out = balanced_copies(sized)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it.

    Rows are known by a hash of all their columns. Where the numbers of copies are few enough
    they are sent to the rows, and the texts stay in place; else the texts are dealt out once.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.table(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), row_hash(docs).alias("row")), "sized")
    copies = balanced_copies(sized).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"))
    copies = scratch.table(copies.select(F.col("row").alias(KEY), F.col("n").alias(f"{KEY}_n"), F.col("copies").alias(f"{KEY}_copies")).where(f"{KEY}_copies > 0"), "copies")
    sent = lambda df: F.broadcast(df) if df.count() <= MAX_SENT else df.hint("merge")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(KEY, row_hash(docs))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{KEY}_copies"))).alias(f"{KEY}_time")
    out = keyed.join(sent(copies.where(f"{KEY}_n = 1")), KEY).select(*columns, times).select(*columns)
    repeated = copies.where(f"{KEY}_n > 1")
    if repeated.limit(1).count():  # repeated rows share their copies: one stands for all
        one = keyed.join(sent(repeated.select(KEY)), KEY, "left_semi").groupBy(KEY).agg(F.first(F.struct(*columns)).alias(f"{KEY}_row"))
        out = out.unionByName(one.join(repeated, KEY).select(f"{KEY}_row.*", times).select(*columns))
    return out
