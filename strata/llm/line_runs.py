"""Line dedup by levelled sorted runs (operator 13), in DataFrame and SQL expressions only.

The index of all lines seen is a set of runs: tables of line keys, bucketed and sorted by key. A
new batch of documents is aggregated to its keys and merge-anti-joined with every run; keys that no
run holds are new, and their documents here keep the line. The batch's keys become a run of level
0. Whenever a level has `fanout` runs, these are merged to one run of the level above, so a key is
rewritten once a level and a batch meets few runs. Runs are joined bucket by bucket where they lie:
only the batch's own keys are shuffled.

A run's row is (key, docs, keeper, fresh): how many documents of the batch hold the line, and the
largest id among them, which keeps it if the key was new. Runs merge like counts. The first batch
to hold a line keeps it; batches are therefore given in the order of falling ids.

A line's key is the MD5 digest of the line, stripped and lower-cased: 16 bytes whatever the line.

Edge cases: a null or empty text is one empty line; lines of fewer than `shortest` code points are
never dropped; rows that share an id are one document, and all of them keep the lines that the id
keeps; rows without an id are one document that comes before all others; a line repeated in its keeper stays as
often as it stands there; a document that loses all lines is empty; long texts are taken whole; an
empty table gives no rows; columns beside the id and the text, whatever their names, play no part
and pass through drop_lines().
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_SENT, Scratch, during, few_rows, passed

#: Stripped from both ends of a line, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Column names that documents do not use.
ID, MARK, AT = "__line_id", "__line_mark", "__line_at"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), CAPITALS, CAPITALS.lower())


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, id_column: str, text: str, shortest: int) -> DataFrame:
    """(id, mark, at, key): the places of lines whose keys have `shortest` code points or more. mark tells texts of one id apart."""
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("mark"), F.posexplode(lines_of(F.col(text))).alias("at", "line"))
    rows = rows.where(F.length("line") >= shortest).withColumn("line", line_key(F.col("line"))).where(F.length("line") >= shortest)
    return rows.select("id", "mark", "at", F.unhex(F.md5("line")).alias("key"))


class LineRuns:
    """Levelled runs of line keys in the shared folder. add() takes a batch; found() tells the keys of many documents."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark)
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.written = 0

    def write(self, rows: DataFrame) -> str:
        """A run: each bucket in one file, sorted by key."""
        name = f"{self.name}_{self.written}"
        self.written += 1
        # Dealt by the expression that buckets are dealt by, so each task writes the files of its own buckets.
        rows.write.format("parquet").option("path", self.scratch.path(name)).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def merging(self):
        """Runs of one file a bucket are read in their order: joins of runs neither shuffle nor sort."""
        return during(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def new_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (key, ...) that no run holds."""
        for level in self.levels:
            for name in level:
                keys = keys.join(self.run(name).select("key").hint("merge"), "key", "left_anti")
        return keys

    def add(self, lines: DataFrame) -> None:
        """A batch of (id, key): what no run holds is new and kept by the largest id of the batch; of the rest, documents are counted."""
        held = lines.groupBy("key").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("keeper"), F.max(F.col("id").isNull().cast("int")).alias("unnamed"))
        held = held.select("key", (F.col("docs") + F.col("unnamed")).alias("docs"), "keeper")
        with self.merging():
            if not self.levels:
                self.push(self.write(held.withColumn("fresh", F.lit(True))), 0)
                return
            batch = self.write(held)
            fresh = self.new_keys(self.run(batch).select("key")).withColumn("fresh", F.lit(True))
            own = self.run(batch).join(fresh.hint("merge"), "key", "left").select("key", "docs", "keeper", F.coalesce("fresh", F.lit(False)).alias("fresh"))
            self.push(self.write(own), 0)
            self.remove(batch)

    def push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            runs = self.levels[level]
            merged = self.write(self.merged(runs))
            self.levels[level] = []
            for old in runs:
                self.remove(old)
            self.push(merged, level + 1)

    def merged(self, names: list[str]) -> DataFrame:
        """Runs in one: documents add up, and the keeper is that of the run in which the key was new. Two runs are joined bucket by bucket where they lie."""
        out = self.run(names[0])
        for name in names[1:]:
            a, b = out.alias("a"), self.run(name).alias("b")
            new = lambda x: F.coalesce(F.col(f"{x}.fresh"), F.lit(False))
            docs = lambda x: F.coalesce(F.col(f"{x}.docs"), F.lit(0))
            keeper = F.when(new("a"), F.col("a.keeper")).when(new("b"), F.col("b.keeper"))
            out = a.join(b.hint("merge"), "key", "full_outer").select("key", (docs("a") + docs("b")).alias("docs"), keeper.alias("keeper"), (new("a") | new("b")).alias("fresh"))
        return out

    def found(self, least: int) -> DataFrame:
        """(key, keeper) of the keys that `least` documents or more hold, written. The runs stay."""
        names = [name for level in reversed(self.levels) for name in level]
        with self.merging():
            return self.scratch.table(self.merged(names).where(F.col("docs") >= least).select("key", "keeper"), f"found{self.written}")

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self.remove(name)
        self.levels = []


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shortest: int = 40, least: int = 5, batches: int = 6, fanout: int = 2) -> DataFrame:
    """(id, mark, at): of each text that loses lines, their places.

    Batches are ranges of ids of about equal row counts; where they are cut changes no result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ids = docs.select(F.col(id_column).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    # The largest ids first; rows without an id are in the last batch.
    batch = F.when(F.col("id").isNull(), len(cuts)).otherwise(len(cuts) - passed(cuts, F.col("id")))
    path = scratch.path("lines")
    lines = long_lines(docs, id_column, text, shortest).withColumn("batch", batch)
    with few_rows(spark):
        lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, fanout)
    for k in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == k).select("id", "key"))
    common = runs.found(least)
    runs.close()
    joined = lines.join(F.broadcast(common) if common.count() <= MAX_SENT else common, "key")
    lost = joined.where(~F.col("id").eqNullSafe(F.col("keeper")))
    return scratch.table(lost.groupBy("id", "mark").agg(F.collect_set("at").alias("at")), "lost")


def without_lines(docs: DataFrame, lost: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `text` without its lost lines, and __line_n and __line_dropped: the lines before, and those dropped."""
    places = lost.agg(F.sum(F.size("at"))).first()[0] or 0
    named = lost.select(F.col("id").alias(ID), F.col("mark").alias(MARK), F.col("at").alias(AT))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(ID)) & (F.xxhash64(text) == F.col(MARK))
    joined = docs.join(F.broadcast(named) if places <= MAX_SENT else named, same, "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.regexp_count(whole, F.lit("\n")) + 1
    rest = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), AT))
    left = F.array_join(F.transform(rest, lambda i: F.get("__lines", i)), "\n")
    joined = joined.withColumn("__lines", F.when(F.col(AT).isNotNull(), lines_of(F.col(text))))
    kept = F.when(F.col(AT).isNull(), F.col(text) if text in docs.columns else whole).otherwise(left)
    columns = [kept.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, n.cast("long").alias("__line_n"), F.coalesce(F.size(AT), F.lit(0)).cast("long").alias("__line_dropped"))


def drop_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shortest: int = 40, least: int = 5, batches: int = 6, fanout: int = 2) -> DataFrame:
    """docs, each text without the lines of `shortest` code points or more that `least` documents or more hold, but for the document of the largest id."""
    return without_lines(docs, repeated_lines(docs, id_column, text, shortest, least, batches, fanout), id_column, text).select(*(F.col(f"`{c}`") for c in docs.columns))


def op13_line_runs(spark, sf_dir: str) -> DataFrame:
    """All documents without lines that five or more hold: what stays, by digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = without_lines(docs, repeated_lines(docs))
    return out.select("doc_id", F.col("__line_n").alias("n_lines"), F.col("__line_dropped").alias("n_dropped"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
