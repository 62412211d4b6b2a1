"""A consumer: crawls a site into a tree of files, then walks the tree page by page with the records of its images.

    python examples/read_a_site.py https://site.example/ OUTPUT [PAGES.parquet]
"""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strata import Engine, load_config
from strata.operators.emit import image_records, read_sidecars, read_tree, write_tree
from strata.sources.fetch import pages_table


def crawl(spark: SparkSession, seed: str, root: str, table: str | None = None) -> int:
    engine = Engine(spark, load_config())
    if table:
        return write_tree(engine.crawl(seed, pages_table(spark, table)), root)
    kept = engine.crawled(seed)
    images = engine.keep_images(kept, engine.image_files(kept))
    return write_tree(engine.emit(kept, images), root, image_records(images))


def walk(spark: SparkSession, root: str):
    """(page, its images) of a written tree; images are found by their identifiers in the front matter."""
    pages = read_tree(spark, root)
    shown = pages.select("path", "site", F.explode("front.images.image_id").alias("image_id"))
    records = shown.join(read_sidecars(spark, root).drop("path"), ["site", "image_id"]).groupBy("path").agg(F.collect_list(F.struct("image_id", "alt", "caption", "width", "height", "src_url")).alias("records"))
    return pages.join(records, "path", "left").orderBy("front.crawl_depth", "front.source_url")


def main(seed: str, root: str, table: str | None = None) -> None:
    spark = SparkSession.builder.getOrCreate()
    crawl(spark, seed, root, table)
    for page in walk(spark, root).toLocalIterator():
        front = page["front"]
        print(f"{front['crawl_depth']} {front['status']:8} {front['source_url']}: {front['title']} ({len(page['body'])} characters)")
        for image in page["records"] or []:
            print(f"    {image['alt'] or image['caption']}: {image['width']} x {image['height']}, {image['src_url']}")


if __name__ == "__main__":
    main(*sys.argv[1:4])
