"""The engine: pages in, a deduplicated table of Markdown pages and images out.

A crawl is a loop of levels. Over a table of fetched pages, extraction runs once over all of
them; over the web, each level is fetched as far as the page budget can need it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..functions.suffixes import SuffixRules
from ..log import get_logger
from ..operators import blocks, boilerplate, dedup, emit, frontier, media
from ..scratch import Scratch, small_batches
from ..sources import fetch, robots
from .config import Config, load_config

_log = get_logger("engine")
_SHOWN = "array<struct<image_id:string,url:string,label:string>>"


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (url, final_url, html, ok) with title, lang, markdown, text_len, links, images and spa. Pages are parsed once, into a table in the shared folder."""
    rows = html.read_pages(pages.where("ok").select("url", "final_url", "html"), "final_url")
    shell = ("has_body", "body_text", "ids")
    rows = rows.withColumn("spa", html.spa_shell(F.struct(*shell))).drop(*shell)
    with small_batches(pages.sparkSession):
        rows = Scratch(pages.sparkSession).table(rows, "parsed")
    # Few pages lost a heading or hold a stat card: only these are taken apart into rows, and told to be few by the size of their table.
    broken = rows.select("url", "sequence", "markdown").where(blocks.lost_headings(F.col("sequence"), F.col("markdown")) | blocks.may_hold_cards(F.col("markdown")))
    repaired = blocks.pair_stat_cards(blocks.inject_headings(broken, "url", "sequence", "markdown"), "url", "text").withColumnRenamed("text", "repaired")
    joined = rows.drop("sequence").join(Scratch(pages.sparkSession).table(repaired, "repaired"), "url", "left")
    base = F.col("final_url")
    links = F.array_distinct(F.filter(F.transform("links", lambda h: urls.resolve(base, h)), urls.is_web))
    images = F.transform("images", lambda i: F.struct(urls.resolve(base, i["src"]).alias("src_url"), i["alt"].alias("alt"), i["caption"].alias("caption"), i["surrounding_text"].alias("surrounding_text")))
    md = F.coalesce("repaired", F.array_join(text.blocks(F.col("markdown")), "\n\n"), F.lit(""))
    return joined.select("url", "final_url", text.clean(F.when(F.col("title") != "", F.col("title")).otherwise("Untitled")).alias("title"), "lang", text.strip(md).alias("markdown"), F.length(md).alias("text_len"), links.alias("links"), images.alias("images"), "spa")


def render_due(cfg: Config, text_len: Column, spa: Column) -> Column:
    """A render is due for every page if asked for, else where there is no page, little text, or a shell."""
    due = F.lit(cfg.crawl.render_mode == "always") | text_len.isNull() | (text_len < cfg.crawl.dynamic_min_chars) | spa
    return F.lit(bool(cfg.crawl.dynamic_fallback)) & F.coalesce(due, F.lit(True))


def with_rendered(pages: DataFrame, rendered: DataFrame | None, cfg: Config) -> DataFrame:
    """The richer of the static and the rendered extraction where a render is due; links of both."""
    if rendered is None or not cfg.crawl.dynamic_fallback:
        return pages
    due = render_due(cfg, F.col("s.text_len"), F.col("s.spa"))
    both = pages.alias("s").join(rendered.alias("r"), "url", "full_outer")
    richer = due & F.col("r.text_len").isNotNull() & (F.col("s.text_len").isNull() | (F.col("r.text_len") > F.col("s.text_len")))
    columns = [F.when(richer, F.col(f"r.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in ("final_url", "title", "lang", "markdown", "text_len", "images", "spa")]
    none = F.array().cast("array<string>")
    links = F.when(due & F.col("r.links").isNotNull(), F.array_distinct(F.concat(F.coalesce("s.links", none), F.col("r.links")))).otherwise(F.coalesce("s.links", "r.links"))
    return both.select("url", *columns, links.alias("links"))


class Engine:
    """Engine(spark).crawl(seed): the emitted pages of a crawl over the web, or over a table of fetched pages if one is given.

    render: what gives (url, html, and when it asked) of (url) and the clock of hosts, as
    `sources.render.rendered_pages` does with a browser; without it, or without the browser, pages stay
    as they were fetched. clock: (netloc, last), when hosts were last asked, over all stages of this
    engine; policies: the robots rules of the hosts met.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, render: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None):
        self.spark, self.config, self.render = spark, config or load_config(), render
        self.clock: DataFrame | None = None
        self.policies: DataFrame | None = None

    def status(self) -> Column:
        return F.when(F.col("text_len") >= self.config.extract.min_text_chars, "ok").otherwise("partial")

    def content(self, pages: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
        """Extracted pages that have text, with status and content_hash."""
        rows = with_rendered(extract_pages(pages), extract_pages(rendered) if rendered is not None else None, self.config)
        return self._told(rows)

    def _told(self, rows: DataFrame) -> DataFrame:
        return rows.where("text_len > 0").withColumn("status", self.status()).withColumn("content_hash", text.content_hash(F.col("markdown")))

    def _asked(self, rows: DataFrame) -> None:
        """Moves the clock of hosts on by what a written table of requests (url, asked) tells."""
        self.clock = Scratch(self.spark).table(fetch.later(self.clock, rows), "clock")

    def judged(self, level: DataFrame) -> DataFrame:
        """level (url) with `allowed`. Robots files of hosts not met before are fetched, parsed and kept as a table."""
        c = self.config.crawl
        if not c.obey_robots:
            return level.withColumn("allowed", F.lit(True))
        scratch = Scratch(self.spark)
        hosts = level.select("url", urls.netloc(F.col("url")).alias("netloc"))
        if self.policies is not None:
            hosts = hosts.join(self.policies.select("netloc"), "netloc", "left_anti")
        files = scratch.table(fetch.fetch_robots(hosts, c.user_agent, c.timeout, 1, c.rate_limit_per_domain, self.clock), "robots")
        self._asked(files)
        new = robots.policies(files, c.user_agent)
        self.policies = scratch.table(new if self.policies is None else new.unionByName(self.policies), "policies")
        return robots.judge(level, self.policies)

    def fetched(self, level: DataFrame) -> DataFrame:
        """Content of the web pages of a level (url): fetched with the pauses, retries and robots rules asked for, and rendered where due."""
        c = self.config.crawl
        scratch = Scratch(self.spark)
        judged = scratch.table(self.judged(level.select("url")), "judged")
        pages = scratch.table(fetch.fetch_pages(judged, c.user_agent, c.timeout, c.max_retries, c.rate_limit_per_domain, self.clock), "fetched")
        self._asked(pages)
        static = scratch.table(extract_pages(pages), "static")
        if self.render is None or not c.dynamic_fallback:
            return self._told(static)
        due = pages.where("allowed").select("url", "final_url").join(static.select("url", "text_len", "spa"), "url", "left").where(render_due(self.config, F.col("text_len"), F.col("spa")))
        shown = scratch.table(self.render(due.select(F.col("final_url").alias("url")).distinct(), self.clock), "shown")
        if "asked" in shown.columns:
            self._asked(shown)
        shown = shown.where("html IS NOT NULL").select(F.col("url").alias("final_url"), "html")
        shown = scratch.table(due.select("url", "final_url").join(shown, "final_url").withColumn("ok", F.lit(True)), "rendered")
        return self._told(with_rendered(static, extract_pages(shown), self.config))

    def similar(self, content: DataFrame) -> DataFrame | None:
        """(x, y): content hashes of similar pages, if near copies are looked for."""
        if not self.config.dedup.text_near_dup:
            return None
        distinct = dedup.first_of_each(content, F.col("content_hash"), F.col("url"))
        sets = dedup.shingle_sets(distinct.where(F.length("markdown") > 0), "url", "markdown")
        pairs = dedup.similar_pairs(sets, self.config.dedup.minhash_threshold).select("a", "b")
        named = distinct.select("url", "content_hash")
        hashes = pairs.join(named.select(F.col("url").alias("a"), F.col("content_hash").alias("x")), "a").join(named.select(F.col("url").alias("b"), F.col("content_hash").alias("y")), "b")
        return hashes.select("x", "y")

    def process(self, pages: DataFrame, images: DataFrame | None = None) -> DataFrame:
        """All pages, without a crawl: extract, deduplicate in URL order, strip boilerplate by site, emit."""
        content = self.content(pages).drop("links", "images", "spa", "text_len")  # of a crawl; images come as a table of their own
        content = Scratch(self.spark).table(content.withColumn("depth", F.lit(0)).withColumn("ord", F.col("url")), "content")
        kept = dedup.dedup_text(content, "url", "markdown", "ord", self.config.dedup.text_near_dup, self.config.dedup.minhash_threshold, hashed="content_hash")
        return self.emit(kept, images, "site")

    def crawl(self, seed: str, pages: DataFrame | None = None, rendered: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
        """Pages reached from the seed, level by level, as a queue would emit them; by request, or from `pages` (and `rendered`) alone."""
        if pages is None:
            kept = self.crawled(seed)
            if images is None and self.config.images.enabled:
                images = self.keep_images(kept, self.image_files(kept))
            return self.emit(kept, images)
        scratch = Scratch(self.spark)
        content = scratch.table(self.content(pages, rendered), "content")
        near = self.similar(content)
        near = scratch.table(near, "near") if near is not None else None
        return self.emit(self.crawled(seed, content, near), images)

    def crawled(self, seed: str, content: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
        """The content of emitted pages, with depth and ord."""
        c = self.config.crawl
        scratch = Scratch(self.spark)
        rules = SuffixRules.read(self.spark, c.suffix_rules) if c.suffix_rules else None
        home = self.spark.range(1).select(urls.registered_domain(F.lit(seed), rules).alias("d")).first()["d"]

        def links_of(rows: DataFrame) -> DataFrame:
            links = rows.select(F.col("url").alias("src"), F.posexplode("links").alias("pos", "link")).select("src", "pos", urls.normalize(F.col("link")).alias("dst"))
            return links.where(urls.registered_domain(F.col("dst"), rules) == home) if c.same_domain_only else links

        links = scratch.table(links_of(content), "links") if content is not None else None
        seen = scratch.table(self.spark.range(1).select(urls.normalize(F.lit(seed)).alias("url"), F.array().cast("array<int>").alias("ord")), "seen")
        level, kept, emitted, part = seen, None, 0, 0
        for depth in range(c.max_depth + 1):
            open_urls = level.where(urls.in_scope(F.col("url"), c.include, c.exclude))
            fresh = None
            while emitted < c.max_pages:
                # Of the web no more is fetched at a time than can still be emitted.
                batch = open_urls if content is not None else scratch.table(open_urls.orderBy("ord").limit(c.max_pages - emitted), f"batch{part}")
                if content is None and not batch.limit(1).count():
                    break
                rows = content if content is not None else scratch.table(self.fetched(batch.select("url")), f"content{part}")
                found = batch.join(rows, "url")
                done = kept if kept is not None else found.where("false").withColumn("depth", F.lit(0))
                pairs = near if content is not None else self.similar(done.drop("depth", "ord").unionByName(found.drop("ord")))
                new = frontier.first_unlike(found, done, self.edges(pairs, found, done), c.max_pages - emitted).withColumn("depth", F.lit(depth))
                new = scratch.table(new, f"new{part}")
                emitted += new.count()
                kept = scratch.table(done.unionByName(new), f"kept{part}")
                fresh = new if fresh is None else fresh.unionByName(new)
                part += 1
                if content is not None:
                    break
                open_urls = scratch.table(open_urls.join(batch.select("url"), "url", "left_anti"), f"open{part}")
            _log.info("depth %d: %d pages emitted so far", depth, emitted)
            if emitted >= c.max_pages or depth == c.max_depth or fresh is None:
                break
            level = scratch.table(frontier.next_level(fresh, links if links is not None else links_of(fresh), seen), f"queue{depth}")
            if not level.limit(1).count():
                break
            seen = scratch.table(seen.unionByName(level), f"seen{depth}")
        return kept

    @staticmethod
    def edges(near: DataFrame | None, found: DataFrame, done: DataFrame) -> DataFrame | None:
        """(a, b): URLs of similar pages. Near copies are named by content, so that a page stands for its exact copies."""
        if near is None:
            return None
        by_hash = found.select("url", "content_hash").unionByName(done.select("url", "content_hash"))
        side = lambda c, h: by_hash.select(F.col("url").alias(c), F.col("content_hash").alias(h))
        return near.join(side("a", "x"), "x").join(side("b", "y"), "y").select("a", "b")

    def emit(self, kept: DataFrame, images: DataFrame | None = None, site: str | None = None) -> DataFrame:
        """The output table, with the boilerplate lines of each site, or of all pages, taken out of the bodies."""
        rows = kept
        none = F.array().cast(_SHOWN)
        if images is not None and self.config.images.enabled:
            records = emit.image_records(images, self.config.output.image_base_url)
            shown = records.groupBy("page_url").agg(F.array_sort(F.collect_list(F.struct("pos", "image_id", F.col("s3_url").alias("url"), "label"))).alias("i"))
            shown = shown.select(F.col("page_url").alias("final_url"), F.transform("i", lambda x: F.struct(x["image_id"].alias("image_id"), x["url"].alias("url"), x["label"].alias("label"))).alias("shown"))
            rows = rows.drop("images").join(shown, "final_url", "left").withColumn("images", F.coalesce("shown", none))
        else:
            rows = rows.withColumn("images", none)
        pages = emit.emit_pages(rows.withColumn("key", F.col("url")).withColumn("url", F.col("final_url")), F.current_timestamp())
        pages = Scratch(self.spark).table(pages, "pages")  # read twice: for the lines to take out, and to take them out
        return boilerplate.strip_boilerplate(pages, site, "body")

    def image_files(self, content: DataFrame) -> DataFrame:
        """The images that pages show, fetched and decoded: (src_url, content, ext, width, height, channels, data, decoded)."""
        c = self.config.crawl
        folder = Scratch(self.spark).path("images")
        wanted = content.select(F.explode("images.src_url").alias("url")).where(urls.is_web(F.col("url"))).distinct()
        stored = Scratch(self.spark).table(fetch.fetch_files(wanted, folder, c.user_agent, c.timeout, c.max_retries, c.rate_limit_per_domain, self.clock), "stored")
        self._asked(stored)
        if not stored.where("name is not null").limit(1).count():
            return stored.selectExpr("url as src_url", "binary(null) as content", "string(null) as ext", "int(null) as width", "int(null) as height", "int(null) as channels", "binary(null) as data", "false as decoded")
        files = fetch.image_files(self.spark, folder).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).withColumn("ext", media.extension(F.col("content")))
        return stored.join(files, "name", "left").select(F.col("url").alias("src_url"), "content", "ext", "width", "height", "channels", "data", "decoded")

    def judged_images(self, content: DataFrame, files: DataFrame) -> DataFrame:
        """All images of pages (final_url, ord, images) with drop_reason: a gate's, `duplicate`, or null for those that stay."""
        i = self.config.images
        scratch = Scratch(self.spark)
        found = content.select(F.col("final_url").alias("page_url"), "ord", F.posexplode("images").alias("pos", "i")).select("page_url", "ord", "pos", "i.*")
        found = dedup.first_of_each(found, F.struct("page_url", "src_url"), F.col("pos")).join(files, "src_url", "left")
        reason = media.gate(F.octet_length("content"), F.col("decoded"), F.col("ext"), F.col("width"), F.col("height"), F.col("content").isNotNull(), i.min_bytes, i.min_width, i.min_height, i.max_aspect_ratio, tuple(x.lower() for x in i.allowed_types))
        found = found.withColumn("image_id", F.sha2("content", 256)).withColumn("gate", reason).withColumn("id", F.struct("page_url", "pos"))
        found = found.withColumn("bits", F.when(F.col("gate").isNull(), media.phash("height", "width", "channels", "data"))).withColumnRenamed("content", "bytes").drop("data")
        found = scratch.table(found, "found")
        kept = media.dedup_images(found.where("gate is null").select("id", F.struct("ord", "pos").alias("ord"), F.col("image_id").alias("sha"), "bits"), i.phash_hamming_threshold)
        out = found.join(kept.select("id", F.lit(True).alias("stays")), "id", "left")
        return out.withColumn("drop_reason", F.when(F.col("gate").isNotNull(), F.col("gate")).when(F.col("stays").isNull(), F.lit("duplicate"))).drop("gate", "stays", "id")

    def keep_images(self, content: DataFrame, files: DataFrame) -> DataFrame:
        """Images of pages (url, final_url, ord, images) that pass the gates and are no copies. files: (src_url, content, ext, width, height, channels, data, decoded)."""
        judged = Scratch(self.spark).table(self.judged_images(content, files), "judged")
        n = image_counts(judged).agg(F.sum("kept").alias("k"), F.sum("discovered").alias("d")).first()
        _log.info("images: %s kept of %s", n["k"] or 0, n["d"] or 0)
        return judged.where(F.col("drop_reason").isNull()).withColumn("phash", F.lower(F.lpad(F.hex("bits"), 16, "0"))).withColumn("site", urls.site_dir(F.col("page_url"))).withColumnRenamed("bytes", "data")


def image_counts(judged: DataFrame) -> DataFrame:
    """(page_url, discovered, kept) of judged images."""
    return judged.groupBy("page_url").agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("drop_reason").isNull()).alias("kept"))
