"""Quality rules (operator 10): a learned decision list over text statistics, in DataFrame expressions only.

Edge cases: a null text counts as empty: every statistic is 0 and the base rule fails; a
ratio over nothing is 0; without labels the list is empty and keeps what the base keeps;
repeated label rows count each; a row without an id has no label; columns beside the named ones,
whatever their names, pass through untouched; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_SENT, NOT_SPACE, SPACE, Scratch, few_rows, in_one, passed

WINDOW = 8
#: The statistics that rules may test, from the base columns.
FEATURES = ("f_symbols", "f_upper", "f_marks", "f_dup_lines", "f_repeats", "f_word_chars", "f_words")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def add_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with structs `_q` of the base statistics and `_f` of the ratios; df has no columns that begin with `_`.

    Repeated windows are found without leaving the row: window hashes, with the position in
    their low bits, are sorted, and equal neighbours mark the windows that occur again.
    """
    had = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_w", F.filter(F.split(t, SPACE, -1), lambda w: w != ""))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("_n", F.size("_h"))
    for span in (1, 2, 4):  # hashes of 2, 4 and 8 words, each from two of half as many
        m = F.greatest(F.size("_h") - span, F.lit(0))
        df = df.withColumn("_h", F.zip_with(F.slice("_h", F.lit(1), m), F.slice("_h", F.lit(span + 1), m), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_b", F.length(F.bin("_n")))
    b = F.col("_b")
    df = df.withColumn("_s", F.sort_array(F.transform("_h", lambda h, i: call("shiftleft", call("shiftright", h, b), b).bitwiseOR(i.cast("long")))))
    df = df.withColumn("_g", F.transform("_s", lambda x: call("shiftright", x, b)))
    same = lambda i: F.coalesce(F.get("_g", i - 1) == F.get("_g", i), F.lit(False)) | F.coalesce(F.get("_g", i + 1) == F.get("_g", i), F.lit(False))
    mask = call("shiftleft", F.lit(1).cast("long"), b) - 1
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, i: same(i)), lambda x: x.bitwiseAND(mask))))
    gaps = F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), lambda a, c: F.coalesce(F.least(c - a, F.lit(WINDOW).cast("long")), F.lit(WINDOW).cast("long")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    df = df.withColumn("_lines", lines)
    df = df.withColumn(
        "_q",
        F.struct(
            F.col("_n").cast("long").alias("n_words"),
            (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(t, F.lit("[!?]")).cast("long").alias("n_marks"),
        ),
    )
    q = F.col("_q")
    share = lambda a, c: F.when(c > 0, a / c).otherwise(F.lit(0.0))
    ratios = F.struct(
        share(q["n_symbols"], q["word_chars"]).alias("f_symbols"),
        share(q["n_upper"], q["word_chars"]).alias("f_upper"),
        share(q["n_marks"], q["word_chars"]).alias("f_marks"),
        share(q["n_dup_lines"], q["n_lines"]).alias("f_dup_lines"),
        share(q["n_repeat_words"], q["n_words"]).alias("f_repeats"),
        share(q["word_chars"], q["n_words"]).alias("f_word_chars"),
        q["n_words"].cast("double").alias("f_words"),
    )
    return df.select(*(F.col(f"`{c}`") for c in had), "_q", ratios.alias("_f"))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


@dataclass(frozen=True)
class Test:
    """feature >= border, or below it."""

    feature: int
    border: float
    above: bool

    def column(self, f: Column) -> Column:
        value = f[FEATURES[self.feature]]
        return value >= self.border if self.above else value < self.border

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<'} {self.border:.4g}"


class Cells:
    """Counts of good and bad labelled documents by binned features: all that learning sees."""

    def __init__(self, rows: list[tuple], borders: list[list[float]]):
        """rows: (bins, bad, good, part), where part 0 grows rules and part 1 prunes them."""
        self.borders = borders
        self.bins = np.array([r[0] for r in rows], np.int16).reshape(len(rows), len(borders))
        self.counts = np.array([r[1:3] for r in rows], np.int64).reshape(len(rows), 2)
        self.part = np.array([r[3] for r in rows], np.int8)

    def holds(self, test: Test) -> np.ndarray:
        return (self.bins[:, test.feature] > self.borders[test.feature].index(test.border)) == test.above

    def covered(self, tests: list[Test]) -> np.ndarray:
        out = np.ones(len(self.part), bool)
        for t in tests:
            out &= self.holds(t)
        return out

    def sums(self, rows: np.ndarray) -> tuple[int, int]:
        """(bad, good) of chosen cells."""
        bad, good = self.counts[rows].sum(0) if len(rows) else (0, 0)
        return int(bad), int(good)


def grow(cells: Cells, rows: np.ndarray, longest: int) -> list[Test]:
    """Adds the test of the largest information gain until no good document is covered or nothing is gained. rows: a mask of cells."""
    tests: list[Test] = []
    while len(tests) < longest:
        bad, good = cells.sums(rows)
        if not bad or not good and tests:
            break
        had, best, chosen = math.log2(bad / (bad + good)), 0.0, None
        for j, borders in enumerate(cells.borders):
            by_bin = np.stack([np.bincount(cells.bins[rows, j], cells.counts[rows, i], len(borders) + 1) for i in (0, 1)])
            for k, border in enumerate(borders):
                up = by_bin[:, k + 1 :].sum(1)
                for above, (b, g) in ((True, up), (False, (bad - up[0], good - up[1]))):
                    if b and (gain := b * (math.log2(b / (b + g)) - had)) > best + 1e-9:
                        best, chosen = gain, Test(j, border, above)
        if not chosen:
            break
        tests.append(chosen)
        rows = rows & cells.holds(chosen)
    return tests


def prune(cells: Cells, tests: list[Test], rows: np.ndarray) -> list[Test]:
    """The beginning of the rule that is worth most on the documents kept aside."""

    def worth(part: list[Test]) -> float:
        bad, good = cells.sums(rows & cells.covered(part))
        return (bad - good) / (bad + good) if bad + good else -1.0

    return max((tests[:k] for k in range(len(tests), 0, -1)), key=worth, default=[])


def cover(cells: Cells, precision: float = 0.95, least: int = 3, most_rules: int = 16, longest: int = 4) -> list[list[Test]]:
    """Sequential covering: grow a rule for bad documents, prune it, take what it covers away, until a rule is no longer sure."""
    left = np.ones(len(cells.part), bool)
    rules: list[list[Test]] = []
    while len(rules) < most_rules:
        tests = prune(cells, grow(cells, left & (cells.part == 0), longest), left & (cells.part == 1))
        if not tests:
            break
        hit = left & cells.covered(tests)
        bad, good = cells.sums(hit)
        if bad < least or bad < precision * (bad + good):
            break
        rules.append(tests)
        left &= ~hit
    return rules


def best_cuts(cuts: list[float], bad: list[int], good: list[int], most: int) -> list[float]:
    """At most `most` of the cuts, each in turn the one that takes most entropy out of the labels. bad and good: counts between the cuts."""

    def entropy(lo: int, hi: int) -> float:
        b, g = sum(bad[lo:hi]), sum(good[lo:hi])
        return -sum(x * math.log2(x / (b + g)) for x in (b, g) if x)

    chosen: list[int] = []
    while len(chosen) < min(most, len(cuts)):
        edges = [0, *sorted(k + 1 for k in chosen), len(cuts) + 1]
        gains = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            gains += [(entropy(lo, hi) - entropy(lo, k + 1) - entropy(k + 1, hi), -k) for k in range(lo, hi - 1)]
        gain, k = max(gains)
        if gain <= 1e-9:
            break
        chosen.append(-k)
    return [cuts[k] for k in sorted(chosen)]


def learn_rules(featured: DataFrame, labels: DataFrame, id_column: str = "doc_id", bins: int = 6) -> list[list[Test]]:
    """Rules from `_f` of labelled documents. The driver gets quantiles, counts by feature, and at most 2 * bins ** features counts by cell."""
    scratch = Scratch(featured.sparkSession)
    rows = scratch.table(with_labels(featured.select(F.col(id_column).alias("_id"), "_f"), labels, id_column).select("_id", "_y", "_f.*"), "labelled")
    at = [0.02, 0.1, 0.5, 0.9, 0.98]
    asked = [F.percentile_approx(F.when(F.col("_y") == y, F.col(f)), at, 1000).alias(f"{f}_{y}") for f in FEATURES for y in (0, 1)]
    found = rows.agg(*asked).first()
    borders = []
    for j in range(len(FEATURES)):
        # Between the classes' quantiles lie the cuts that can part them.
        both = sorted({*(found[2 * j] or []), *(found[2 * j + 1] or [])})
        borders.append(sorted({(a + b) / 2 for a, b in zip(both, both[1:], strict=False)}))
    number = lambda b: [passed(cuts, F.col(f)).alias(f"b_{f}") for f, cuts in zip(FEATURES, b, strict=True)]
    by_label = lambda g: g.agg(F.count_if(F.col("_y") == 0).alias("bad"), F.count_if(F.col("_y") == 1).alias("good"))
    single = rows.select(F.explode(F.array(*(F.struct(F.lit(j).alias("j"), c.alias("bin")) for j, c in enumerate(number(borders))))).alias("at"), "_y")
    seen = {(r["j"], r["bin"]): (r["bad"], r["good"]) for r in by_label(single.groupBy("at.j", "at.bin")).collect()}
    for j, cuts in enumerate(borders):
        bad, good = ([seen.get((j, k), (0, 0))[i] for k in range(len(cuts) + 1)] for i in (0, 1))
        borders[j] = best_cuts(cuts, bad, good, bins - 1)
    part = F.when(F.pmod(F.xxhash64("_id"), F.lit(3)) == 0, 1).otherwise(0).alias("_part")
    counted = by_label(rows.select(*number(borders), part, "_y").groupBy(*(f"b_{f}" for f in FEATURES), "_part"))
    return cover(Cells([(tuple(r[: len(FEATURES)]), r["bad"], r["good"], r["_part"]) for r in counted.orderBy(*counted.columns).collect()], borders))


def with_labels(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """rows (_id, ...) that have a label, with `_y`. Labels are sent to the rows if they are few enough."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col("quality").alias("_y"))
    return rows.join(F.broadcast(known) if known.count() <= MAX_SENT else known.hint("merge"), "_id")


def verdict(rules: list[list[Test]], f: Column) -> Column:
    """The list as one ordered conditional expression: true if the document stays."""
    out = F.when(F.lit(False), F.lit(True))
    for tests in rules:
        condition = tests[0].column(f)
        for t in tests[1:]:
            condition = condition & t.column(f)
        out = out.when(condition, F.lit(False))
    return out.otherwise(F.lit(True))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics of all documents and the verdict of rules learned from all labelled ones."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with few_rows(spark):
        featured = scratch.table(add_statistics(docs).drop("text"), "statistics")
    rules = learn_rules(featured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    q = F.col("_q")
    failed = base_failed(q)
    return featured.select("doc_id", *(q[c].alias(c) for c in BASE), failed.alias("base_failed"), (~failed & verdict(rules, F.col("_f"))).alias("kept"))


def keep_by_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base nor the learned rules reject, with their columns as they were. Rules are learned from the labelled documents alone."""
    few = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    texts = docs.select("doc_id", "text")
    # Many labels would be joined by a shuffle of texts; then the statistics of all are the lesser cost.
    learned_from = texts.join(F.broadcast(few), "doc_id", "left_semi") if few.count() <= MAX_SENT else texts
    with few_rows(docs.sparkSession):
        rules = learn_rules(add_statistics(learned_from).drop("text"), labels)
    featured = add_statistics(in_one(docs, "text"))
    # Catalyst does not push a filter below the generator, where it would copy the statistics' expressions into every condition.
    told = featured.select("row", "text", F.explode_outer(F.array(F.struct("_q", "_f"))).alias("_told"))
    kept = told.where(~base_failed(F.col("_told._q")) & verdict(rules, F.col("_told._f")))
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
