"""The committing tree sink, its readers, and the stream that keeps first pages."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from strata import Config, Engine
from strata.operators.emit import image_records, read_sidecars, read_tree, write_tree
from strata.sources import tree
from strata.streaming import ingest


def files_under(root):
    return sorted(os.path.relpath(p, root) for p in glob.glob(f"{root}/**/*", recursive=True) if os.path.isfile(p))


def test_a_tree_is_there_after_the_commit_alone(tmp_path):
    import pyarrow as pa

    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

    root = str(tmp_path / "t")
    writer = tree.TreeWriter(root)
    first = writer.write(iter([batch(("a/x.md", b"one"), ("a/b/y.md", None))]))
    again = writer.write(iter([batch(("a/x.md", b"half"))]))  # an attempt that does not count
    other = writer.write(iter([batch(("z.md", b"z"))]))
    assert first.files == 2 and again.attempt != first.attempt and all(f.startswith("_staging-") for f in files_under(root))
    writer.commit([first, None, other])
    assert files_under(root) == ["a/b/y.md", "a/x.md", "z.md"] and (tmp_path / "t/a/x.md").read_bytes() == b"one" and os.path.getsize(f"{root}/a/b/y.md") == 0
    second = tree.TreeWriter(root)
    second.write(iter([batch(("a/x.md", b"two"))]))
    second.abort([None])
    assert files_under(root) == ["a/b/y.md", "a/x.md", "z.md"] and (tmp_path / "t/a/x.md").read_bytes() == b"one"
    third = tree.TreeWriter(root)
    third.commit([third.write(iter([batch(("a/x.md", b"three"))]))])
    assert (tmp_path / "t/a/x.md").read_bytes() == b"three"


@pytest.mark.parametrize("path", ["", "/x", "../x", "a//b", "a/../b", "_staging/x", "a/."])
def test_paths_outside_the_tree_are_refused(path):
    with pytest.raises(ValueError):
        tree.safe_path(path)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    tree.register(spark)
    root = str(tmp_path / "t")
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("s/"), "id", F.lit(".md")).alias("path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    rows.write.format("strata_tree").mode("append").save(root)
    assert len(files_under(root)) == 40 and open(f"{root}/s/7.md").read() == "7"
    bad = rows.select(F.when(F.col("path") == "s/11.md", F.lit("../out")).otherwise(F.concat(F.lit("new/"), "path")).alias("path"), "content")
    with pytest.raises(Exception, match="no path inside a tree"):
        bad.write.format("strata_tree").mode("append").save(root)
    assert len(files_under(root)) == 40 and not glob.glob(f"{root}/new") and not glob.glob(f"{root}/_staging*")
    with pytest.raises(Exception, match="only appended"):
        rows.write.format("strata_tree").mode("overwrite").save(root)


def test_a_tree_is_read_with_its_records(spark, tmp_path):
    html = "<html lang='en'><head><title>{0}: \"x\"</title></head><body><p>{0} text one two</p></body></html>"
    pages = spark.createDataFrame([(f"http://s.example/{n}", html.format(n), True) for n in "ab"], "url string, html string, ok boolean").withColumn("final_url", F.col("url"))
    engine = Engine(spark, Config())
    kept = engine.content(pages).withColumn("depth", F.lit(1)).withColumn("ord", F.array(F.lit(0)))
    images = spark.createDataFrame([("http://s.example/a", "i1", "png", "http://s.example/i.png", "é", "", "", 3, 4, "ff", "s.example", bytearray(b"\x01\x02"), 0)], "page_url string, image_id string, ext string, src_url string, alt string, caption string, surrounding_text string, width int, height int, phash string, site string, data binary, pos int")
    out = engine.emit(kept, images)
    root = str(tmp_path / "t")
    assert write_tree(out, root, image_records(images)) == 2
    assert files_under(root) == ["s.example/a.md", "s.example/b.md", "s.example/images/i1.json", "s.example/images/i1.png"]
    want = {r["slug"]: r for r in out.collect()}
    for r in read_tree(spark, root).collect():
        w = want[r["slug"]]
        assert r["body"] == w["body"] and r["site"] == "s.example"
        assert all(r["front"][k] == w[k] for k in ("source_url", "title", "content_hash", "section_path", "lang", "status", "crawl_depth"))
        assert [tuple(i) for i in r["front"]["images"]] == [tuple(i) for i in w["images"]]
    s = read_sidecars(spark, root).collect()
    assert [(x["site"], x["image_id"], x["alt"], x["width"], x["drop_reason"]) for x in s] == [("s.example", "i1", "é", 3, None)]
    from examples.read_a_site import walk

    assert [(p["slug"], [i["image_id"] for i in p["records"] or []]) for p in walk(spark, root).collect()] == [("a", ["i1"]), ("b", [])]


def test_files_without_front_matter_are_read(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/plain.md").write_text("only text")
    (tmp_path / "s/odd.md").write_text("---\n: [\n---\n\nbody")
    got = {r["slug"]: (r["front"]["title"], r["body"]) for r in read_tree(spark, str(tmp_path)).collect()}
    assert got["plain"] == (None, "only text") and got["odd"][0] is None


def test_a_stream_keeps_the_first_of_each_content(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "page_id long, url string, html string"
    batches = [[(5, "a"), (3, "a"), (4, "b"), (None, "n")], [(1, "a"), (9, "c"), (8, "c")], [(2, "b"), (7, None), (6, "d")]]
    kept = []
    for rows in batches:
        pages = [(i, f"http://h/{i}", None if t is None else f"<p>text {t}</p>") for i, t in rows]
        spark.createDataFrame(pages, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        query = ingest.keep_first(ingest.page_stream(stream), out, state)
        query.awaitTermination(180)
        kept.append(sorted((r["page_id"] or 0) for r in spark.read.parquet(out).collect()))
        assert query.lastProgress["stateOperators"][0]["customMetrics"].get("rocksdbCommitFlushLatency") is not None
    assert kept == [[0, 3, 4], [0, 3, 4, 8], [0, 3, 4, 6, 7, 8]]
    assert "HDFSBacked" in spark.conf.get(ingest.PROVIDER)
