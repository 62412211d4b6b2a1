import glob
import os

import pytest
from pyspark.sql import functions as F

from strata import Config, Engine, load_config
from strata.operators.emit import read_tree, write_tree
from strata.plans.cli import parser


def test_config_defaults_merge_and_missing_file(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("STRATA_CONFIG", raising=False)
    cfg = load_config()
    assert (cfg.crawl["max_pages"], cfg.crawl["max_depth"], cfg.crawl["dynamic_fallback"], cfg.crawl["dynamic_min_chars"], cfg.crawl["render_mode"]) == (50, 2, True, 200, "auto")
    (tmp_path / "c.yaml").write_text("crawl:\n  max_pages: 7\n  exclude: ['*/x']\n  render_mode: always\n")
    cfg = load_config(tmp_path / "c.yaml")
    assert (cfg.crawl["max_pages"], cfg.crawl["max_depth"], cfg.crawl["exclude"], cfg.crawl["render_mode"]) == (7, 2, ["*/x"], "always")
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")
    monkeypatch.setenv("STRATA_CONFIG", str(tmp_path / "c.yaml"))
    assert load_config().crawl["max_pages"] == 7
    assert Config().with_values("crawl", max_pages=3, max_depth=None).crawl["max_depth"] == 2


def test_cli_arguments():
    a = parser().parse_args(["http://s/", "--pages", "t", "--max-pages", "3"])
    assert (a.seed, a.pages, a.max_pages, a.max_depth) == ("http://s/", "t", 3, None)


def site(spark, links, texts, extra=""):
    rows = [(f"http://s.example/{n}", f"<html lang='en'><head><title>{n}</title></head><body><p>{t}</p>{''.join(f'<a href=/{x}>{x}</a>' for x in links.get(n, []))}{extra}</body></html>", True) for n, t in texts.items()]
    return spark.createDataFrame(rows, "url string, html string, ok boolean").withColumn("final_url", F.col("url"))


def test_crawl_is_a_queue(spark):
    texts = {n: f"{n} " + " ".join(f"{n}{i}" for i in range(30)) for n in "abcdefg"}
    texts["c"] = texts["b"]  # a copy: not emitted, so its links are not followed
    texts["f"] = ""
    links = {"a": ["b", "c", "login", "d"], "b": ["e", "a"], "c": ["g"], "d": ["f", "http://other.example/x"], "e": ["a"]}
    pages = site(spark, links, texts)
    crawl = lambda **k: [(r["source_url"][-1], r["crawl_depth"]) for r in Engine(spark, Config().with_values("crawl", **k)).crawl("http://s.example/a", pages).orderBy("crawl_depth", "source_url").collect()]
    assert crawl() == [("a", 0), ("b", 1), ("d", 1), ("e", 2)]
    assert crawl(max_depth=1) == [("a", 0), ("b", 1), ("d", 1)]
    assert crawl(max_pages=2) == [("a", 0), ("b", 1)]
    assert crawl(exclude=["*/b"]) == [("a", 0), ("c", 1), ("d", 1), ("g", 2)]


def test_rendered_pages_win_when_richer(spark):
    pages = site(spark, {}, {"a": "thin"}, '<div id="app"></div>')
    rendered = site(spark, {"a": ["b"]}, {"a": "much richer text " * 20, "b": "second page with its own text"})
    out = Engine(spark, Config()).crawl("http://s.example/a", pages, rendered).collect()
    assert {r["source_url"][-1]: "richer" in r["body"] for r in out} == {"a": True, "b": False}


def test_tree_is_written(spark, tmp_path):
    out = Engine(spark, Config()).process(site(spark, {}, {"a": "text one two", "b": "other words here"}))
    assert write_tree(out, str(tmp_path)) == 2
    names = sorted(os.path.relpath(p, tmp_path) for p in glob.glob(f"{tmp_path}/**/*.md", recursive=True))
    assert names == ["s.example/a.md", "s.example/b.md"]
    text = (tmp_path / names[0]).read_text()
    assert text.startswith("---\nsource_url: http://s.example/a\ntitle: a\n") and text.endswith("---\n\n# a\n\ntext one two\n")
    assert {(r["site"], r["slug"], r["body"]) for r in read_tree(spark, str(tmp_path)).collect()} == {(r["site"], r["slug"], r["body"]) for r in out.collect()}


def test_streams(spark, tmp_path):
    from strata.streaming import ingest

    src = str(tmp_path / "in")
    rows = [(1, "http://h/1?x", "<title>T</title><p>same</p>"), (2, "http://h/2", "<p>same</p>"), (3, "http://h/3", "<p>other</p>")]
    schema = "page_id long, url string, html string"
    spark.createDataFrame(rows[1:], schema).coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.keep_first(ingest.page_stream(read()), out, state).awaitTermination(120)
    spark.createDataFrame([(4, "http://h/4", "<p>other</p>"), (5, "http://h/5", "<p>new</p>")], schema).coalesce(1).write.mode("append").parquet(src)
    ingest.keep_first(ingest.page_stream(read()), out, state).awaitTermination(120)
    assert sorted(r["page_id"] for r in spark.read.parquet(out).collect()) == [2, 3, 5]


def test_window_counts_close_with_the_watermark(spark, tmp_path):
    from strata.streaming import ingest

    src = str(tmp_path / "in")
    schema = "url string, at timestamp"
    for k, minute in enumerate((1, 30)):
        spark.sql(f"select 'http://h/x' as url, timestamp'2020-01-01 00:{minute:02d}:00' as at").coalesce(1).write.mode("append").parquet(src)
        del k
    stream = ingest.site_counts(spark.readStream.schema(schema).parquet(src), "at")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["netloc"], r["pages"]) for r in spark.table("counts").collect()] == [("h", 1)]


@pytest.fixture
def web():
    """A server of (status, content type, body) by path, and the paths asked for."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    files, asked = {}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            code, kind, body = files.get(self.path, (404, "text/html", b""))
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body if isinstance(body, bytes) else body.encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", files, asked
    server.shutdown()


def page(title, links=(), more=""):
    words = " ".join(f"{title}{i}" for i in range(40))
    return 200, "text/html; charset=utf-8", f"<html lang=en><head><title>{title}</title></head><body><h1>Common head</h1><p>{words}.</p>{''.join(f'<a href={x}>{x}</a>' for x in links)}{more}</body></html>"


def test_crawl_of_the_web(spark, web, tmp_path):
    from tests.test_operators import png

    root, files, asked = web
    show = "".join(f'<figure><img src="/i/{n}.png" alt="{n}"></figure>' for n in ("one", "copy", "tiny", "none", "two"))
    files |= {
        "/": page("start", ["dir/a?x=1", "/b", "/login", "http://elsewhere.example/"]),
        "/dir/a": page("aa", ["../c", "./d", "/b#part"]),
        "/b": page("bb", ["/secret/e", "/c"], show),
        "/c": page("aa"),  # a copy
        "/dir/d": (500, "text/html", "no"),
        "/secret/e": page("ee"),
        "/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /secret"),
        "/i/one.png": (200, "image/png", png(200, 200)), "/i/copy.png": (200, "image/png", png(200, 200)),
        "/i/tiny.png": (200, "image/png", png(20, 20)), "/i/two.png": (200, "image/png", png(200, 200, noise=3)),
    }
    cfg = Config().with_values("crawl", rate_limit_per_domain=0.0, max_retries=1, timeout=5.0, obey_robots=True).with_values("images", min_bytes=50).with_values("output", root=str(tmp_path))
    engine = Engine(spark, cfg)
    kept = engine.crawled(f"{root}/")
    assert sorted((r["url"].removeprefix(root), r["depth"]) for r in kept.collect()) == [("/", 0), ("/b", 1), ("/dir/a", 1)]
    pages_asked = [p for p in asked if p != "/robots.txt"]
    assert sorted(pages_asked) == ["/", "/b", "/c", "/dir/a", "/dir/d"]
    judged = engine.judged_images(kept, engine.image_files(kept)).collect()
    assert {r["alt"]: r["drop_reason"] for r in judged} == {"one": None, "copy": "duplicate", "tiny": "too_small", "none": "fetch_failed", "two": None}
    out = engine.crawl(f"{root}/")
    bodies = {r["source_url"].removeprefix(root): r["body"] for r in out.collect()}
    assert set(bodies) == {"/", "/b", "/dir/a"} and all("Common head" not in b for b in bodies.values())
    assert bodies["/b"].count("![") == 2 and "## Images" not in bodies["/"]


def test_crawl_asks_for_no_more_than_it_can_emit(spark, web):
    root, files, asked = web
    files |= {"/": page("start", [f"/p{i}" for i in range(9)]), **{f"/p{i}": page(f"p{i // 2}x") for i in range(9)}}
    cfg = Config().with_values("crawl", rate_limit_per_domain=0.0, max_retries=1, max_pages=4)
    kept = Engine(spark, cfg).crawled(f"{root}/")
    assert sorted(r["url"].removeprefix(root) for r in kept.collect()) == ["/", "/p0", "/p2", "/p4"]
    assert asked == ["/", "/p0", "/p1", "/p2", "/p3", "/p4"]


def test_renders_are_asked_for_where_due(spark, web):
    root, files, _ = web
    files |= {"/": (200, "text/html", '<body><div id="app"></div><a href="/full">x</a></body>'), "/full": page("full")}
    wanted = []

    def render(urls, clock):
        wanted.extend(r["url"].removeprefix(root) for r in urls.collect())
        return urls.where(F.col("url").endswith("/")).withColumn("html", F.lit(page("shown", ["/full"])[2]))

    cfg = Config().with_values("crawl", rate_limit_per_domain=0.0, max_retries=1, dynamic_min_chars=100).with_values("dedup", text_near_dup=False)
    kept = {r["url"].removeprefix(root): r["title"] for r in Engine(spark, cfg, render).crawled(f"{root}/").collect()}
    assert kept == {"/": "shown", "/full": "full"} and wanted == ["/"]


def test_pages_of_one_name_get_files_of_their_own(spark, tmp_path):
    pages = site(spark, {}, {"a b": "text one two", "a-b": "other words here"})
    assert write_tree(Engine(spark, Config()).process(pages), str(tmp_path)) == 2
    assert sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/**/*.md", recursive=True)) == ["a-b-2.md", "a-b.md"]


def test_settings_keep_what_they_do_not_know(tmp_path):
    (tmp_path / "c.yaml").write_text("crawl:\n  speed: 3\n  max_depth: 5\nother:\n  a: 1\nimages:\n")
    cfg = load_config(tmp_path / "c.yaml")
    assert (cfg.crawl["speed"], cfg.crawl.max_depth, cfg.more, cfg.images.min_width) == (3, 5, {"other": {"a": 1}}, 100)


def test_command_line_over_a_table_and_the_web(spark, web, tmp_path):
    from strata.plans.cli import main

    root, files, _ = web
    files |= {"/": page("start", ["/b"]), "/b": page("bb")}
    (tmp_path / "c.yaml").write_text(f"crawl:\n  rate_limit_per_domain: 0.0\n  max_retries: 1\noutput:\n  root: {tmp_path}/out\n")
    assert main([f"{root}/", "--config", str(tmp_path / "c.yaml"), "--max-depth", "1"]) == 0
    assert len(glob.glob(f"{tmp_path}/out/**/*.md", recursive=True)) == 2
    site(spark, {}, {"a": "text one two"}).write.parquet(f"{tmp_path}/pages")
    assert main(["http://s.example/none", "--pages", f"{tmp_path}/pages", "--config", str(tmp_path / "c.yaml")]) == 1
