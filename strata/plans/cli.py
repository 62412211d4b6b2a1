"""strata SEED [--pages TABLE] [--config FILE] [--max-pages N] [--max-depth N] [--render-mode MODE]: a crawl over the web, or over a table of pages."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..log import setup_logging
from ..operators.emit import image_records, write_tree
from ..sources.fetch import pages_table
from ..sources.render import rendered_pages
from .config import load_config
from .pipeline import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strata", description="Crawl a site, or a table of its pages, into Markdown.")
    p.add_argument("seed")
    p.add_argument("--pages", help="Parquet table with url and html, in place of requests")
    p.add_argument("--config")
    p.add_argument("--max-pages", type=int)
    p.add_argument("--max-depth", type=int)
    p.add_argument("--render-mode", choices=("auto", "always"))
    return p


def main(argv: list[str] | None = None) -> int:
    """Writes the tree under the output root; 0 if it holds a page."""
    args = parser().parse_args(argv)
    setup_logging()
    cfg = load_config(args.config).with_values("crawl", max_pages=args.max_pages, max_depth=args.max_depth, render_mode=args.render_mode)
    spark = SparkSession.builder.appName("strata").getOrCreate()
    c = cfg.crawl
    engine = Engine(spark, cfg, lambda urls, clock: rendered_pages(urls, c.user_agent, c.timeout, c.dynamic_wait_ms, c.rate_limit_per_domain, clock))
    images = None
    if args.pages:
        pages = engine.crawl(args.seed, pages_table(spark, args.pages))
    else:
        kept = engine.crawled(args.seed)
        if cfg.images.enabled:
            images = engine.keep_images(kept, engine.image_files(kept))
        pages = engine.emit(kept, images)
    n = write_tree(pages, cfg.output.root, image_records(images, cfg.output.image_base_url) if images is not None else None)
    print(f"Done. {n} markdown file(s) written.")
    return 0 if n else 1


if __name__ == "__main__":
    raise SystemExit(main())
