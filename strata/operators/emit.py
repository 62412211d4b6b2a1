"""Output tables and files: pages with front matter, image records, and the Markdown tree."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import after_front_matter, image_title, strip
from ..functions.urls import site_dir, slug

#: Keys of an image record, in order.
SIDECAR = ("image_id", "s3_url", "page_url", "src_url", "alt", "caption", "surrounding_text", "width", "height", "phash", "status", "drop_reason")


def timestamp_text(t: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def image_ref(site: Column, image_id: Column, ext: Column, base_url: str = "") -> Column:
    name = F.concat(image_id, F.lit("."), ext)
    base = base_url.rstrip("/")
    return F.concat(F.lit(f"{base}/"), site, F.lit("/images/"), name) if base else F.concat(F.lit("images/"), name)


def image_records(images: DataFrame, base_url: str = "") -> DataFrame:
    """The record of each kept image (page_url, image_id, ext, src_url, alt, caption, surrounding_text, width, height, phash) and its JSON."""
    ref = image_ref(site_dir(F.col("page_url")), F.col("image_id"), F.col("ext"), base_url)
    out = images.withColumn("s3_url", ref).withColumn("status", F.lit("kept")).withColumn("drop_reason", F.lit(None).cast("string"))
    out = out.withColumn("label", image_title(F.col("alt"), F.col("caption"), F.col("surrounding_text")))
    return out.withColumn("sidecar", F.to_json(F.struct(*SIDECAR), {"ignoreNullFields": "false"}))


def page_body(markdown: Column, images: Column) -> Column:
    """The Markdown and, if there are images (structs with label and url), the appendix that shows them."""
    shown = F.array_join(F.transform(images, lambda i: F.concat(F.lit("!["), i["label"], F.lit("]("), i["url"], F.lit(")"))), "\n\n")
    return F.concat(strip(markdown), F.when(F.coalesce(F.size(images), F.lit(0)) > 0, F.concat(F.lit("\n\n## Images\n\n"), shown)).otherwise(F.lit("")))


def emit_pages(pages: DataFrame, fetched_at: Column, *own: str) -> DataFrame:
    """pages (url, title, lang, markdown, content_hash, status, depth, images array<struct<image_id,url,label>>) as the output table.

    Two pages of a site with one slug would share a file: `collision` counts those before, by URL, and goes into the file's name.
    `own` columns of the pages, such as a number of theirs, stay beside; an address may be that of several pages.
    """
    title = F.coalesce(F.col("title"), F.lit("Untitled"))
    images = F.transform("images", lambda i: F.struct(i["image_id"].alias("image_id"), i["url"].alias("url"), i["label"].alias("alt")))
    out = pages.select(
        *own,
        F.col("url").alias("source_url"),
        title.alias("title"),
        timestamp_text(fetched_at).alias("fetched_at"),
        "content_hash",
        F.lit("").alias("section_path"),
        F.when(F.coalesce(F.col("lang"), F.lit("")) == "", "en").otherwise(F.col("lang")).alias("lang"),
        "status",
        F.col("depth").alias("crawl_depth"),
        images.alias("images"),
        site_dir(F.col("url")).alias("site"),
        slug(F.col("url"), title).alias("slug"),
        F.concat(F.lit("# "), title, F.lit("\n\n"), page_body(F.col("markdown"), F.col("images")), F.lit("\n")).alias("body"),
    )
    same_name = W.partitionBy("site", "slug").orderBy("source_url", "content_hash")
    return out.withColumn("collision", F.row_number().over(same_name) - 1)


def file_name(row: dict) -> str:
    return f"{row['slug']}-{row['collision'] + 1}.md" if row["collision"] else f"{row['slug']}.md"


def front_matter(row: dict) -> str:
    """The YAML of a page's record, keys in order."""
    import yaml

    keys = ("source_url", "title", "fetched_at", "content_hash", "section_path", "lang", "status", "crawl_depth", "images")
    return yaml.safe_dump({k: row[k] for k in keys}, sort_keys=False, allow_unicode=True).strip()


#: The front matter of a page's file.
FRONT = "source_url string, title string, fetched_at string, content_hash string, section_path string, lang string, status string, crawl_depth int, images array<struct<image_id:string,url:string,alt:string>>"
SIDECAR_TYPES = ", ".join(f"{k} {'int' if k in ('width', 'height') else 'string'}" for k in SIDECAR)


def front_of(text: Column) -> Column:
    """The front matter of a file as a record; nulls where there is none."""
    return F.pandas_udf(_fronts, FRONT)(text)


def _fronts(text: pd.Series) -> pd.DataFrame:
    import yaml

    keys = [c.split()[0] for c in FRONT.split(", ")]

    def one(t: str | None) -> list:
        try:
            found = yaml.safe_load(t[4:].partition("\n---")[0]) if t and t.startswith("---\n") else None
        except yaml.YAMLError:
            found = None
        if not isinstance(found, dict):
            return [None] * len(keys)
        return [found.get(k) if k in ("crawl_depth", "images") or found.get(k) is None else str(found[k]) for k in keys]

    return pd.DataFrame([one(t) for t in text], columns=keys, dtype=object)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, site, slug, front, body) of a written tree: the Markdown files, their front matter as a record."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.input_file_name().alias("path"), "value")
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)\.md$", k)
    return files.select("path", part(1).alias("site"), part(2).alias("slug"), front_of(F.col("value")).alias("front"), F.regexp_replace(after_front_matter(F.col("value")), r"\A\n+", "").alias("body"))


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path, site, and the keys of image records) of a written tree."""
    rows = spark.read.schema(SIDECAR_TYPES).json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.input_file_name().alias("path"), *SIDECAR)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)/images/[^/]+$", 1).alias("site"), *SIDECAR)


def page_files(pages: DataFrame) -> DataFrame:
    """(path, content) of pages: `<site>/<slug>.md`, `<slug>-2.md` for the second page of that name."""

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            paths = [f"{r['site']}/{file_name(r)}" for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([f"---\n{front_matter(r)}\n---\n\n{r['body']}".encode() for r in rows], pa.binary())], ["path", "content"])

    return pages.mapInArrow(run, "path string, content binary")


def image_files(images: DataFrame) -> DataFrame:
    """(path, content) of images (site, image_id, ext, data, sidecar): each beside its record, once a site."""

    def pretty(batches):
        for b in batches:
            records = [json.dumps(json.loads(x), ensure_ascii=False, indent=2).encode() for x in b["sidecar"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(records, pa.binary())], ["path", "content"])

    once = images.groupBy("site", "image_id").agg(F.min_by(F.struct("ext", "data", "sidecar"), "sidecar").alias("i"))
    name = lambda ext: F.concat("site", F.lit("/images/"), "image_id", F.lit("."), ext)
    records = once.select(name(F.lit("json")).alias("path"), F.col("i.sidecar").alias("sidecar")).mapInArrow(pretty, "path string, content binary")
    return once.select(name(F.col("i.ext")).alias("path"), F.col("i.data").alias("content")).unionByName(records)


def write_tree(pages: DataFrame, root: str, images: DataFrame | None = None) -> int:
    """Writes pages, and images beside them, as a tree of files; returns the number of pages. Nothing is there before all is (sources.tree)."""
    from ..sources import tree

    tree.register(pages.sparkSession)
    written = Observation()
    files = page_files(pages.observe(written, F.count(F.lit(1)).alias("n")))
    if images is not None:
        files = files.unionByName(image_files(images.select("site", "image_id", "ext", "data", "sidecar")))
    files.write.format("strata_tree").mode("append").save(root)
    return written.get["n"]
