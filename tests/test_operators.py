import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions import html
from strata.operators import blocks, boilerplate, dedup, emit, frontier, media

SHORT, LONG = "<p>Loading</p>", "<p>" + "many words of text " * 100 + "</p>"


@pytest.mark.parametrize(("page", "expected"), [('<body><div id="__next"></div></body>', True), ('<body><nav>a b</nav><div id="app"></div></body>', True), (f'<body><div id="root">{LONG}</div></body>', False), (f"<body><article>{SHORT}</article></body>", False), ("", False)])
def test_spa_shell(spark, page, expected):
    assert spark.createDataFrame([(page,)], "h string").select(html.spa_shell(html.parse_page("h"))).first()[0] is expected


def test_page_is_read_once_for_all():
    page = html.read_page('<html lang="fr"><head><title> T &amp; U </title></head><body><nav><a href="/n">N</a></nav><main><h1>Head</h1><p>One <a href="x">two</a>.<li><p>Item</p></li><figure><img data-src="i.png" alt=" A "><figcaption>Cap</figcaption></figure><script>var p = "<p>no</p>"</script></main></body></html>')
    assert (page["title"], page["lang"], page["links"]) == ("T & U", "fr", ["/n", "x"])
    assert [(s["kind"], s["level"], s["text"].strip()) for s in page["sequence"]] == [("h", 1, "Head"), ("c", None, "One two."), ("c", None, "Item"), ("c", None, "Item"), ("c", None, "Cap")]
    assert page["images"] == [{"src": "i.png", "alt": "A", "caption": "Cap", "surrounding_text": "Cap"}]
    assert page["markdown"].startswith("# Head\n\nOne [two](x).\n\n- Item") and "no" not in page["markdown"]


def test_heading_injection(spark):
    page = "<body><h2>Menu</h2><nav><li>x</li></nav><h1>Title</h1><p>The first paragraph is here.</p><h2>Second part</h2><p>Short</p><p>The second paragraph is there.</p><h2>There</h2><p>Third one is in the text too.</p><footer><h2>Legal</h2><p>All rights are reserved by us.</p></footer></body>"
    md = "The first paragraph is here.\n\nThe second paragraph is there.\n\n## There\n\nThird one is in the text too."
    df = spark.createDataFrame([(1, page, md), (2, page, "")], "id int, h string, md string").withColumn("s", html.parse_page("h")["sequence"])
    got = {r["id"]: r["text"] for r in blocks.inject_headings(df, "id", "s", "md").collect()}
    assert got[1] == "# Title\n\nThe first paragraph is here.\n\n## Second part\n\nThe second paragraph is there.\n\n## There\n\nThird one is in the text too."
    assert got[2] == ""


def greedy_cards(items, value, label):
    out, i = [], 0
    while i < len(items):
        pair = items[i : i + 2]
        if len(pair) == 2 and pair[0] in value and pair[1] in label:
            out.append(f"{pair[1]}: {pair[0]}")
            i += 2
        elif len(pair) == 2 and pair[0] in label and pair[1] in value:
            out.append(f"{pair[0]}: {pair[1]}")
            i += 2
        else:
            out.append(items[i])
            i += 1
    return "\n\n".join(out)


def test_stat_cards_equal_the_greedy_walk(spark):
    r = random.Random(3)
    value, label, other = ["5 kW", "9 mm"], ["Power", "Total Width"], ["A sentence of prose that ends here."]
    docs = [[r.choice(value + label + other) for _ in range(r.randint(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, "\n\n".join(d)) for i, d in enumerate(docs)], "id int, md string")
    got = {x["id"]: x["text"] for x in blocks.pair_stat_cards(df, "id", "md").collect()}
    assert got == {i: greedy_cards(d, value, label) for i, d in enumerate(docs)}


def test_boilerplate(spark):
    rows = [("a", f"Site\n\nOwn {i}\nBody") for i in range(4)] + [("b", "Two\nx"), ("b", "Two\nx")]
    df = spark.createDataFrame(rows, "site string, md string")
    assert [(r["site"], r["line"]) for r in boilerplate.boilerplate_lines(df, "site", "md", 2).collect()] == [("a", "Site")]
    got = {r["md"] for r in boilerplate.strip_boilerplate(df, "site", "md", 2).collect()}
    assert got == {f"Own {i}\nBody\n" for i in range(4)} | {"Two\nx"}


def greedy(n, edges):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    kept = []
    for i in range(n):
        if not near[i] & set(kept):
            kept.append(i)
    return kept


def test_first_wins_keeps_the_end_of_a_chain(spark):
    nodes = spark.createDataFrame([(i, i) for i in range(4)], "id long, ord long")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    assert sorted(r[0] for r in dedup.first_wins(nodes, edges).collect()) == [0, 2, 3]


def test_first_wins_equals_greedy_on_random_graphs(spark):
    r = random.Random(5)
    edges = [(a, b) for a in range(60) for b in range(a) if r.random() < 0.05]
    got = dedup.first_wins(spark.createDataFrame([(i, i) for i in range(60)], "id long, ord long"), spark.createDataFrame(edges, "a long, b long"))
    assert sorted(x[0] for x in got.collect()) == greedy(60, edges)


def test_near_copies(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(words)), (1, " ".join([*words, "more"])), (2, "something else, quite different from it"), (3, " ".join(words).upper() + "!"), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("ord", F.col("id"))
    kept = lambda **k: sorted(r["id"] for r in dedup.dedup_text(df, "id", "text", "ord", **k).collect())
    assert kept(threshold=0.6) == [0, 2, 4]
    assert kept(enabled=False) == [0, 1, 2, 4]
    assert kept(threshold=0.6, approximate=True) == [0, 2, 4]


def test_similar_pairs_equal_brute_force(spark):
    r = random.Random(1)
    base = [[r.choice("abcdefgh") for _ in range(30)] for _ in range(8)]
    docs = []
    for b in base:
        for _ in range(4):
            d = list(b)
            for _ in range(r.randint(0, 2)):
                d[r.randrange(30)] = r.choice("xyz")
            docs.append(" ".join(d))
    docs = list(dict.fromkeys(docs))
    sets = [{tuple(d.split()[i : i + 5]) for i in range(26)} for d in docs]
    expected = {(i, j) for j in range(len(docs)) for i in range(j) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, t string")
    assert {(x["a"], x["b"]) for x in dedup.similar_pairs(dedup.shingle_sets(df, "id", "t"), 0.7).collect()} == expected and expected


def test_bands():
    assert dedup.bands_for(0.85) == (8, 16)
    assert dedup.bands_for(0.6) == (18, 7)


def png(width, height, colour=(200, 30, 30), noise=None):
    rows = b""
    r = random.Random(noise)
    for y in range(height):
        rows += b"\0" + b"".join(bytes(colour if noise is None else (r.randrange(256),) * 3 if (x // 8 + y // 8) % 2 else colour) for x in range(width))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_files_gates_and_copies(spark, tmp_path):
    from strata.sources.fetch import image_files

    files = {"a_small": png(50, 50), "b_thin": png(1100, 100), "c_one": png(300, 300), "d_same": png(300, 300), "e_larger": png(320, 320), "f_other": png(300, 300, noise=1), "g_broken": b"\x89PNG\r\n\x1a\n" + b"x" * 300, "h_tiny": b"GIF8", "i_text": b"plain text " * 30}
    for name, content in files.items():
        (tmp_path / f"{name}.png").write_bytes(content)
    df = image_files(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", r"([^/]+)\.png$", 1)).withColumn("ext", media.extension(F.col("content")))
    df = df.withColumn("drop", media.gate(F.octet_length("content"), F.col("decoded"), F.col("ext"), F.col("width"), F.col("height"), min_bytes=100)).cache()
    assert {r["name"]: r["drop"] for r in df.collect()} == {"a_small": "too_small", "b_thin": "bad_aspect", "c_one": None, "d_same": None, "e_larger": None, "f_other": None, "g_broken": "decode_error", "h_tiny": "too_few_bytes", "i_text": "decode_error"}
    passed = df.where("drop is null").select(F.col("name").alias("id"), F.col("name").alias("ord"), F.sha2("content", 256).alias("sha"), media.phash("height", "width", "channels", "data").alias("bits"))
    assert sorted(r["id"] for r in media.dedup_images(passed).collect()) == ["c_one", "f_other"]


def test_hamming_bands_find_all_at_the_border(spark):
    r = random.Random(2)
    rows = []
    for i in range(40):
        x = r.getrandbits(63)
        y = x
        for b in r.sample(range(64), 5 + i % 3):
            y ^= 1 << b
        rows += [(2 * i, x), (2 * i + 1, y - (1 << 64) if y >= 1 << 63 else y)]
    got = {(a, b): d for a, b, d in media.hamming_pairs(spark.createDataFrame(rows, "id long, bits long")).collect()}
    assert got == {(2 * i, 2 * i + 1): 5 + i % 3 for i in range(40) if i % 3 < 2}


def test_perceptual_hash_survives_scaling():
    x = np.add.outer(np.arange(64) % 13, np.arange(64) % 29).astype(np.uint8) * 6
    assert bin((media.perceptual_hash(x) ^ media.perceptual_hash(np.kron(x, np.ones((3, 3), np.uint8)))) & (2**64 - 1)).count("1") <= 6


def test_bfs_depths(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 2), (2, 3), (3, 4), (9, 8)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["depth"] for r in frontier.bfs_depths(edges, seeds, 3).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_image_records_and_body(spark):
    df = spark.createDataFrame([("http://h:1/p", "id1", "png", "http://h/i", "", "", "ctx", 3, 4, "ff")], "page_url string, image_id string, ext string, src_url string, alt string, caption string, surrounding_text string, width int, height int, phash string")
    r = emit.image_records(df, "https://cdn/").first()
    assert r["sidecar"] == '{"image_id":"id1","s3_url":"https://cdn/h_1/images/id1.png","page_url":"http://h:1/p","src_url":"http://h/i","alt":"","caption":"","surrounding_text":"ctx","width":3,"height":4,"phash":"ff","status":"kept","drop_reason":null}'
    images = F.array(F.struct(F.lit("L").alias("label"), F.lit("u").alias("url")))
    assert spark.range(1).select(emit.page_body(F.lit(" md\n"), images)).first()[0] == "md\n\n## Images\n\n![L](u)"


def test_politeness_and_retries():
    from strata.sources.fetch import Client, retry_delays

    c = Client("bot", spacing=0.2)
    c.wait("http://h.example:80/a")
    start = time.monotonic()
    c.wait("http://other.example/a")
    assert time.monotonic() - start < 0.1
    c.wait("http://h.example:80/b")
    assert time.monotonic() - start >= 0.18
    assert retry_delays(4) == [0.5, 1.0, 2.0] and retry_delays(0) == []


def test_web_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from strata.sources.fetch import fetch_bytes, fetch_pages

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            code, kind, body = {"/ok": (200, "text/html; charset=utf-8", "<p>é</p>".encode()), "/bin": (200, "image/png", b"\x01\x02")}.get(self.path, (404, "text/html", b"no"))
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{root}/ok",), (f"{root}/bin",), (f"{root}/none",), ("http://127.0.0.1:1/x",)], "url string")
    got = {r["url"].rsplit("/", 1)[1]: (r["status"], r["html"], r["ok"]) for r in fetch_pages(urls, "bot", 2.0, 1, spacing=0.0).collect()}
    assert got == {"ok": (200, "<p>é</p>", True), "bin": (200, "", False), "none": (404, "", False), "x": (None, "", False)}
    files = {r["url"].rsplit("/", 1)[1]: r["content"] for r in fetch_bytes(urls, "bot", 2.0, 1, spacing=0.0).collect()}
    assert files == {"ok": bytearray("<p>é</p>".encode()), "bin": bytearray(b"\x01\x02"), "none": None, "x": None}
    server.shutdown()


def test_odd_pages_are_read_in_time_that_grows_as_they_do():
    for page in ("<div>x" * 100_000, "<span>" * 100_000 + "<p>y</p>" * 3000, "<img src=i>" * 50_000 + "<figure>" * 1000, "<p>some words</p>" * 200_000):
        start = time.monotonic()
        html.read_page(page)
        assert time.monotonic() - start < 20
