"""Lines that stand at the top of many pages of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_lines, top_lines
from ..scratch import Scratch


def boilerplate_lines(pages: DataFrame, site: str, text: str, k: int = 3, fraction: float = 0.5) -> DataFrame:
    """(site, line, pages): lines among the first k of at least half of a site's pages, and of two; sites of fewer than three pages have none."""
    tops = pages.select(F.col(site).alias("site"), F.array_distinct(top_lines(F.col(text), k)).alias("tops"))
    sizes = tops.groupBy("site").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    # explode() would have the lines worked out once more, to leave pages without any out before.
    counts = tops.select("site", F.explode_outer("tops").alias("line")).where("line IS NOT NULL").groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages"))
    least = F.greatest(F.lit(2), F.ceil(F.round(F.lit(fraction) * F.col("n"), 6)))
    return counts.join(sizes, "site").where(F.col("pages") >= least).select("site", "line", "pages")


def strip_boilerplate(pages: DataFrame, site: str | None, text: str, k: int = 3, fraction: float = 0.5) -> DataFrame:
    """pages with the boilerplate lines of their site, or of all pages if no site is named, taken out of the text. A site has few such lines: k / fraction at most."""
    if site is None:
        found = boilerplate_lines(pages.select(F.lit("").alias("site"), text), "site", text, k, fraction)
        drop = F.array(*(F.lit(r["line"]) for r in found.orderBy("line").collect())).cast("array<string>")
        return pages.select(*(strip_lines(F.col(text), drop).alias(c) if c == text else F.col(c) for c in pages.columns))
    drops = boilerplate_lines(pages, site, text, k, fraction).groupBy("site").agg(F.collect_list("line").alias("_drop"))
    drops = Scratch(pages.sparkSession).table(drops, "drops")  # its size tells how to join it; texts are not dealt out for a few lines
    joined = pages.join(drops.withColumnRenamed("site", site), site, "left")
    cleaned = strip_lines(F.col(text), F.col("_drop"))
    return joined.select(*(cleaned.alias(c) if c == text else F.col(c) for c in pages.columns))
