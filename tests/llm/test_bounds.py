"""Bounds on labelled rows, rows of one id in searches, and plans of packing that are never above best fit alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import gam, kneser_ney, mih, packing, toxicity


def distributions():
    r = np.random.default_rng(41)
    whole = lambda x: np.clip(np.rint(x), 1, 2048).astype(int)
    draws = [r.lognormal(m, s, 20_000) for m in (4.0, 5.5, 6.7, 7.2) for s in (0.3, 1.0)]
    draws += [r.uniform(a, b, 20_000) for a, b in ((300, 900), (400, 1024), (1, 2048), (600, 1100), (900, 1100), (1000, 2048))]
    draws += [r.choice([700, 650, 1348, 20, 33], 5000), r.geometric(0.01, 20_000), r.normal(1024, 100, 20_000), r.integers(1, 12, 3000) * 150, r.pareto(1.2, 20_000) * 100, 2048 - r.geometric(0.02, 5000)]
    for x in draws:
        lengths, counts = np.unique(whole(x), return_counts=True)
        yield dict(zip(lengths.tolist(), counts.tolist(), strict=True))


def test_plans_are_never_above_best_fit_alone():
    n = 0
    for counts in distributions():
        made = packing.plan(counts, 2048)
        used: dict[int, int] = {}
        for lengths, often in made:
            assert sum(lengths) <= 2048 and often > 0
            for x in lengths:
                used[x] = used.get(x, 0) + often
        assert used == counts
        full = counts.get(2048, 0)
        alone = sum(k for _, k in packing.best_fit({k: v for k, v in counts.items() if k < 2048}, 2048)) + full
        total = sum(k for _, k in made)
        assert -(-sum(k * v for k, v in counts.items()) // 2048) <= total <= alone
        n += 1
    assert n == 20


def test_rows_of_one_id_are_searched_for_each_and_found_each(spark):
    r = np.random.default_rng(42)
    x = r.normal(size=(120, 16))
    ids = [i // 3 for i in range(120)]  # three rows an id
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in zip(ids, x, strict=True)]
    vectors = np.array([v for _, v in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    for shard_rows in (1000, 30):
        got = mih.search(df, F.col("id") % 20 == 0, 5, shard_rows=shard_rows).collect()
        lists: dict = {}
        for g in got:
            lists.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
        assert sorted(lists) == [0, 20] and all(sorted(p[0] for p in v) == sorted([1, 2, 3, 4, 5] * 3) for v in lists.values())
        best = {}
        for q in (k for k, i in enumerate(ids) if i % 20 == 0):
            scores = sorted(((-(vectors[q] * vectors[j]).sum(), ids[j]) for j in range(120) if j != q))[:5]
            best.setdefault(ids[q], []).extend((i, round(-s, 6)) for s, i in scores)
        if shard_rows == 1000:  # few rows: nearly all are retrieved
            found = sum(len(set(best[q]) & {(i, round(s, 6)) for _, i, s in lists[q]}) for q in best)
            assert found >= 0.9 * sum(len(set(v)) for v in best.values())


@pytest.fixture(scope="module")
def crowded():
    """Texts of few words, most of them under one labelled id."""
    r = random.Random(43)
    word = lambda: r.choice(("good", "fine", "kind", "bad", "vile", "rude", "calm", "plain")) + str(r.randrange(9))
    return [(1 if i % 4 else i, " ".join(word() for _ in range(12)) + f" n{i}") for i in range(800)]


def test_one_label_on_many_rows_fits_on_no_more_than_the_bound(spark, crowded, monkeypatch):
    docs = spark.createDataFrame(crowded, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(4, 800, 4)], "doc_id long, quality int")
    seen = []
    fit = gam.fit
    monkeypatch.setattr(gam, "fit", lambda x, y: (seen.append((x.tolist(), y.tolist())), fit(x, y))[1])
    for n in (1, 6):
        gam.fit_quality(gam.with_features(docs.repartition(n)), labels, most=50)
    assert len(seen[0][0]) == 50 and seen[0] == seen[1]
    seen.clear()
    counted = toxicity.label_counts
    monkeypatch.setattr(toxicity, "label_counts", lambda rows, pieces: (seen.append(sorted(r["text"] for r in rows.collect())), counted(rows, pieces))[1])
    toxic = labels.withColumnRenamed("quality", "toxic")
    for n in (1, 6):
        toxicity.learn(docs.repartition(n), toxic, most=60)
    assert seen and all(len(s) == 60 for s in seen) and seen[0] == seen[-1]


def test_more_words_than_numbers_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MOST_WORDS", 3)
    texts = spark.createDataFrame([("one two three four five",)], "text string")
    with pytest.raises(ValueError, match="distinct words"):
        kneser_ney.train(texts, f"file://{tmp_path}/m")


def test_near_duplicates_count_rows_by_the_jobs_that_write_them(spark, monkeypatch):
    """Each count was a job with a plan of its own, half of all: the driver's memory grew with them."""
    from pyspark.sql.classic.dataframe import DataFrame

    from strata.llm import ngram_join

    asked, count = [], DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda self: asked.append(1) or count(self))
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join([*words[:20], f"x{i % 3}", *words[20:]] if i % 2 else [f"y{i}_{k}" for k in range(30)])) for i in range(24)] + [(None, "a b c"), (3, ""), (5, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in ngram_join.keep_first_of_each(docs, 2, 60).collect()}
    assert kept == {*range(0, 24, 2), None, 1, 3}
    assert len(asked) <= 2  # whether any class is there twice, in each round that compares whole sets


def test_a_written_table_tells_its_rows(spark):
    from strata.scratch import Scratch

    rows = spark.range(100).selectExpr("id", "if(id % 10 = 0, null, id % 3 = 1) as odd")
    table, n, odd = Scratch(spark).counted(rows, "rows", "odd")
    assert (n, odd) == (100, table.where("odd").count()) and table.count() == 100
    table, n, odd = Scratch(spark).counted(rows.where("id < 0"), "none", "odd")
    assert (n, odd) == (0, 0) and table.count() == 0 and table.columns == ["id", "odd"]
