"""Breadth-first expansion in levels: one join and one anti-join a level, order by the links that lead to a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def bfs_depths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) reachable from seeds (node) over edges (src, dst) in at most max_depth steps; cycles and self-loops are borne."""
    scratch = Scratch(edges.sparkSession)
    seen = scratch.table(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "seen0")
    for d in range(1, max_depth + 1):
        level = seen.where(F.col("depth") == d - 1).select(F.col("node").alias("src"))
        found = edges.join(level, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        grown = scratch.table(seen.unionByName(found.withColumn("depth", F.lit(d))), f"seen{d}")
        scratch.drop(f"seen{d - 1}")
        if not grown.where(F.col("depth") == d).limit(1).count():
            return grown
        seen = grown
    return seen


def next_level(emitted: DataFrame, links: DataFrame, seen: DataFrame) -> DataFrame:
    """(url, ord): first occurrences, in the order of pages and links, of links (src, pos, dst) of emitted pages (url, ord) that were never queued.

    A page's `ord` is the list of link places that lead to it: lists of a level order as a queue
    does, and no page needs to know how many come before it.
    """
    from_pages = links.join(emitted.select(F.col("url").alias("src"), F.col("ord").alias("parent")), "src")
    fresh = from_pages.groupBy(F.col("dst").alias("url")).agg(F.min(F.concat("parent", F.array(F.col("pos").cast("int")))).alias("ord"))
    return fresh.join(seen.select("url"), "url", "left_anti")


def first_unlike(level: DataFrame, kept: DataFrame, edges: DataFrame | None, budget: int) -> DataFrame:
    """Rows of a level (url, ord, content_hash) that a greedy crawl emits: no hash or near copy of a kept or earlier emitted page, `budget` at most."""
    from .dedup import first_of_each, first_wins

    fresh = level.join(kept.select("content_hash"), "content_hash", "left_anti")
    fresh = first_of_each(fresh, F.col("content_hash"), F.col("ord"))
    if edges is not None:
        near_kept = edges.join(kept.select(F.col("url").alias("a")), "a", "left_semi").select(F.col("b").alias("url"))
        near_kept = near_kept.unionAll(edges.join(kept.select(F.col("url").alias("b")), "b", "left_semi").select(F.col("a").alias("url")))
        fresh = fresh.join(near_kept.distinct(), "url", "left_anti")
        here = fresh.select(F.col("url").alias("id"), "ord")
        within = edges.join(here.select(F.col("id").alias("a")), "a", "left_semi").join(here.select(F.col("id").alias("b")), "b", "left_semi")
        fresh = fresh.join(first_wins(here, within).withColumnRenamed("id", "url"), "url", "left_semi")
    return fresh.orderBy("ord").limit(budget)
