"""Relational forms of block-wise Markdown repairs: stat cards and section headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import SPACE, blocks, headings, is_stat_label, is_stat_value, lines, norm, signature


def lost_headings(sequence: Column, markdown: Column) -> Column:
    """Whether a heading of the sequence is none of the Markdown's: inject_headings() leaves all other pages as they are."""
    told = F.transform(F.filter(sequence, lambda e: e["kind"] == "h"), lambda e: norm(e["text"]))
    return F.coalesce(F.size(F.array_except(told, headings(markdown))) > 0, F.lit(False))


def may_hold_cards(markdown: Column) -> Column:
    """Whether a block may be a value, as one begins with a number: pair_stat_cards() gives all other pages their blocks back."""
    return F.coalesce(markdown.rlike(rf"(?:\A|\n){SPACE}*[~<>≈]?{SPACE}*\p{{Nd}}"), F.lit(False))


def pair_stat_cards(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, text) with neighbouring value and label blocks joined as 'Label: Value', left to right.

    A block is a value, a label or neither. Where neighbours are of both kinds a pair can
    begin; in each unbroken run of such places, pairs begin at every second.
    """
    rows = df.select(F.col(id_column).alias("id"), F.posexplode_outer(blocks(F.col(text))).alias("pos", "block"))
    kind = F.when(is_stat_value(F.col("block")), "v").when(is_stat_label(F.col("block")), "l")
    w = W.partitionBy("id").orderBy("pos")
    rows = rows.withColumn("kind", kind).withColumn("next", F.lead("block").over(w)).withColumn("next_kind", F.lead("kind").over(w))
    rows = rows.withColumn("can", F.coalesce(F.col("kind") != F.col("next_kind"), F.lit(False)))
    rows = rows.withColumn("breaks", F.count_if(~F.col("can")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    place = F.row_number().over(W.partitionBy("id", "breaks", "can").orderBy("pos")) - 1
    rows = rows.withColumn("begins", F.col("can") & (place % 2 == 0))
    rows = rows.withColumn("taken", F.coalesce(F.lag("begins").over(w), F.lit(False)))
    label = F.when(F.col("kind") == "v", F.concat_ws(": ", "next", "block")).otherwise(F.concat_ws(": ", "block", "next"))
    rows = rows.where(~F.col("taken")).select("id", "pos", F.when(F.col("begins"), label).otherwise(F.col("block")).alias("block"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n")
    return rows.groupBy("id").agg(joined.alias("text")).withColumnRenamed("id", id_column)


def inject_headings(pages: DataFrame, id_column: str, sequence: str, markdown: str, longest: int = 60, shortest: int = 12) -> DataFrame:
    """(id, text): headings of the page's sequence that the Markdown lost, put back before the first kept block of their section.

    `sequence` holds structs (pos, kind 'h' or 'c', level, text). A block is kept if its
    signature is a line's, or if one begins as the other does for thirty characters; the
    heading returns only where a line has exactly the block's signature.
    """
    base = pages.select(F.col(id_column).alias("id"), F.col(markdown).alias("md"), F.col(sequence).alias("seq"))
    base = base.withColumn("lines", lines(F.col("md"))).withColumn("sigs", F.transform("lines", lambda x: signature(x, longest)))
    base = base.withColumn("kept", F.filter(F.array_distinct("sigs"), lambda s: F.length(s) >= shortest)).withColumn("already", headings(F.col("md")))
    # Lines of thirty characters or more begin alike if their heads are equal: only shorter ones are tried one by one.
    base = base.withColumn("short", F.filter("kept", lambda k: F.length(k) < 30)).withColumn("heads", F.array_distinct(F.transform(F.filter("kept", lambda k: F.length(k) >= 30), lambda k: F.substring(k, 1, 30))))
    facts = ("id", "short", "heads", "already")
    rows = base.select(*facts, F.explode("seq").alias("e")).select(*facts, "e.*").withColumn("sig", signature(F.col("text"), longest))
    s = F.col("sig")
    begins_short = F.exists("short", lambda k: s.startswith(k) | k.startswith(s))
    by_head = F.when(F.length(s) >= 30, F.array_contains("heads", F.substring(s, 1, 30)) | begins_short).otherwise(begins_short | F.exists("heads", lambda k: k.startswith(s)))
    rows = rows.withColumn("holds", (F.col("kind") == "c") & (F.length("sig") >= shortest) & by_head)
    section = F.count_if(F.col("kind") == "h").over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("section", section).where("section > 0")
    sections = rows.groupBy("id", "section").agg(
        F.min_by(F.struct("level", F.col("text").alias("heading"), F.array_contains("already", norm(F.col("text"))).alias("there")), F.when(F.col("kind") == "h", F.col("pos"))).alias("h"),
        F.min_by("sig", F.when(F.col("holds"), F.col("pos"))).alias("target"),
    )
    wanted = sections.where(F.col("target").isNotNull() & ~F.col("h.there")).groupBy("id", "target").agg(F.array_sort(F.collect_list(F.struct("section", "h.level", "h.heading"))).alias("hs"))
    groups = wanted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("target", "hs"))).alias("groups"))
    joined = base.join(groups, "id", "left")

    def with_headings(line, i):
        sig = F.get("sigs", i)
        first = F.array_position("sigs", sig) == i + 1
        found = F.try_element_at("groups", sig)
        marks = F.transform(found, lambda h: F.concat(F.repeat(F.lit("#"), F.least(h["level"], F.lit(6))), F.lit(" "), h["heading"]))
        return F.when(first & found.isNotNull(), F.concat(marks, F.array(F.lit(""), line))).otherwise(F.array(line))

    rebuilt = F.array_join(F.flatten(F.transform("lines", with_headings)), "\n")
    return joined.select(F.col("id").alias(id_column), F.when(F.col("groups").isNull(), F.col("md")).otherwise(rebuilt).alias("text"))
