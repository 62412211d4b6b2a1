"""Filter interaction audit (operator 12): what each filter removes in every order of all filters.

The orders form a trie whose nodes, as sets of filters already applied, are states: 2^n of them
instead of n! paths. The trie is walked depth first. A state's survivors are the rows of its parent
that pass one more filter, persisted while its children are visited; a state met again on another
path is not run again. At every state one aggregation counts, for each filter to come, the rows it
removes: the edges of the trie. Each order is then read off the edges.

Filters are conditions on whole texts and are worked out once a row; survivors carry their truth
values, not texts. Persisted rows that are lost with an executor are filtered again from the
written table.

Edge cases: a null text counts as empty and is a copy of other empty texts; a null part is the empty
string and is one with a part so named; a row without an id is no copy of any other, nor are others of it,
and has no labels; rows that share id and text are no copies of each other; repeated rows count each;
of repeated labels one that says 1 is enough; long texts are taken whole; an empty table has no
parts and gives no rows; columns beside doc_id, text and lang, whatever their names, play no part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_SENT, SPACE, Scratch, few_rows

#: The conditions under which a text fails, by the letter of the filter; E is told from all texts.
COPY = "E"


def text_conditions(text: Column, words: Column) -> dict[str, Column]:
    """Filters A to D: too few words, too few distinct ones, too many capitals, symbols. words: those of the text."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of docs (doc_id, text, lang): truth values only."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE, -1), ""))
    flags = [c.alias(k) for k, c in text_conditions(F.col("text"), F.col("words")).items()]
    with few_rows(spark):
        slim = scratch.table(rows.select("id", "part", F.unhex(F.md5("text")).alias("digest"), *flags), "slim")
    # The smallest id of each text that has more than one; one row a text, however many copies it has.
    firsts = slim.where(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    firsts = scratch.table(firsts.where("first < last").select("digest", "first"), "firsts")
    out = slim.join(_sent(firsts), "digest", "left")
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    marks = scratch.table(marks.where("id IS NOT NULL AND (q = 1 OR t = 1)"), "marks")
    out = out.join(_sent(marks), "id", "left")
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return out.select("part", "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias(COPY), is_one("q").alias("good"), is_one("t").alias("toxic"))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_SENT else df


class Trie:
    """Counts at every edge of the trie of `filters` over `rows` (part, a truth value a filter, and outcomes)."""

    def __init__(self, rows: DataFrame, filters: str, outcomes: tuple[str, ...]):
        self.scratch = Scratch(rows.sparkSession)
        self.filters, self.outcomes = filters, outcomes
        self.seen: set[str] = set()
        self.rows = rows

    def edges(self) -> DataFrame:
        """(part, state, filter, kept, removed, and removed rows by outcome); a state names the filters before, sorted."""
        self.visit(self.scratch.table(self.rows, "rows"), "")
        return self.rows.sparkSession.read.schema(self.schema).parquet(self.scratch.path("edges"))

    def visit(self, survivors: DataFrame, state: str) -> None:
        self.seen.add(state)
        left = [f for f in self.filters if f not in state]
        deeper = len(left) > 1
        if deeper and state:  # the root is a written table
            survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        self.count(survivors, state, left)
        if deeper:
            for f in left:
                following = "".join(sorted(state + f))
                if following not in self.seen:
                    self.visit(survivors.where(~F.col(f)), following)
            if state:
                survivors.unpersist()

    def count(self, survivors: DataFrame, state: str, left: list[str]) -> None:
        """One aggregation for all edges that leave the state; parts without survivors are added when orders are read."""
        asked = [F.count(F.lit(1)).alias("rows")]
        for f in left:
            asked += [F.count_if(F.col(f)).alias(f), *(F.count_if(F.col(f) & F.col(o)).alias(f"{f}_{o}") for o in self.outcomes)]
        got = survivors.groupBy("part").agg(*asked)
        rows = F.array(*(F.struct(F.lit(state).alias("state"), F.lit(f).alias("filter"), (F.col("rows") - F.col(f)).alias("kept"), F.col(f).alias("removed"), *(F.col(f"{f}_{o}").alias(f"{o}_lost") for o in self.outcomes)) for f in left))
        edges = got.select("part", F.explode(rows).alias("edge")).select("part", "edge.*")
        self.schema = edges.schema
        edges.write.mode("append").parquet(self.scratch.path("edges"))


def orders(edges: DataFrame, filters: str, outcomes: tuple[str, ...]) -> DataFrame:
    """(part, filter_order, step, counts) of every order of the filters, from the counts at the edges (part, state, filter, ...)."""
    spark = edges.sparkSession
    n = len(filters)
    steps = [("".join(p), k + 1, "".join(sorted(p[:k])), p[k]) for p in permutations(filters) for k in range(n)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, state string, filter string")
    counts = ["kept", "removed", *(f"{o}_lost" for o in outcomes)]
    # The last filter of an order stands alone with what only it removes; the first removes all that fail it.
    paths = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.length("state") + 1)
    totals = edges.groupBy("part", "filter").agg(
        F.max(F.when(F.col("state") == "", F.col("removed"))).alias("fails"),
        F.coalesce(F.max(F.when(F.length("state") == n - 1, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * paths).alias("shapley"),
    )
    rows = totals.join(F.broadcast(steps), "filter").join(edges, ["part", "state", "filter"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    lost = [zero(F.col(c)).alias(c) for c in counts]
    redundant = zero(F.col("fails")) - zero(F.col("removed"))
    return rows.select("part", "filter_order", "step", *lost[:2], redundant.alias("redundant"), zero(F.col("unique_fails")).alias("unique_fails"), *lost[2:], zero(F.col("shapley")).alias("shapley"))


def audit(rows: DataFrame, filters: str, outcomes: tuple[str, ...] = ()) -> DataFrame:
    """Every order of the filters (one letter each) over rows (part, a truth value a filter that is true where it fails, a truth value an outcome)."""
    return orders(Trie(rows, filters, outcomes).edges(), filters, outcomes)


def op12_filter_interactions(spark, sf_dir: str) -> DataFrame:
    """All 120 orders of five filters over all documents, by language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(flagged(docs.select("doc_id", "text", "lang"), labels), "ABCDE", ("good", "toxic"))
