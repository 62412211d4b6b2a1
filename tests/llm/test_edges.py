"""Nulls, repeated and clashing rows and columns, odd texts: cases that every operator and stage must stand."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import gam, hilbert, html_crf, mixing, ngram_join, packing, rules, toxicity

from .test_operators import brute_components, words

CLASHING = ["_q", "_f", "_n", "_w", "_key", "_size", "row", "id", "mark", "copies", "salt", "class", "__odd"]


def prose(r, n=60):
    return " ".join(r.choice(("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa")) + str(r.randrange(50)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null ids, ids and rows that repeat, null and empty texts, and columns whose names operators might use."""
    r = random.Random(11)
    same = prose(r)
    rows = [(None, prose(r), "en", "a"), (None, prose(r), "en", "a"), (None, same, "en", "b"), (7, same, "en", "a"), (7, same, "en", "a"), (7, prose(r), "de", None), (8, None, None, None), (8, "", "en", "b"), (8, "", "en", "b"), (9, " \n\t", "en", "a"), (10, same + " one more", "en", "c")]
    rows += [(100 + i, prose(r, r.randint(20, 90)), "en", r.choice("abc")) for i in range(40)]
    df = spark.createDataFrame([(*x, len(x[1] or ""), k) for k, x in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, place int")
    return df.select("*", *(F.concat(F.lit(c), "place").alias(c) for c in CLASHING), F.create_map(F.lit("k"), "place").alias("map"))


@pytest.fixture(scope="module")
def odd_labels(spark):
    return spark.createDataFrame([(100 + i, int(i % 3 > 0), int(i % 2)) for i in range(40)] + [(None, 1, 0), (7, None, None), (100, 1, 1), (5000, 0, 1)], "doc_id long, quality int, toxic int")


def untouched(before, after):
    """Rows that come out are rows that went in, with all their columns."""
    assert after.columns == before.columns and after.schema == before.schema
    went = {r["place"]: r for r in before.collect()}
    came = after.collect()
    assert all(went[r["place"]] == r for r in came)
    return Counter(r["place"] for r in came)


def test_rules_stage_leaves_columns_alone(odd_docs, odd_labels):
    kept = untouched(odd_docs, rules.keep_by_rules(odd_docs, odd_labels))
    assert set(kept.values()) == {1} and not {6, 7, 8, 9} & set(kept) and len(kept) > 20


def test_classifier_stage_leaves_columns_alone(odd_docs, odd_labels):
    assert set(untouched(odd_docs.drop("map"), gam.keep_by_quality(odd_docs.drop("map"), odd_labels)).values()) <= {1}


def test_one_of_each_group_stays_whatever_the_ids(odd_docs):
    docs = odd_docs.drop("map")
    kept = untouched(docs, ngram_join.keep_first_of_each(docs))
    # 2, 3, 4 and 10 are near copies: one of the repeated rows 3 and 4 stays. Texts without words all stay.
    assert set(kept.values()) == {1} and len({2, 3, 4, 10} & set(kept)) == 1 and {3, 4} & set(kept)
    assert {0, 1, 5, 6, 7, 8, 9} <= set(kept) and len(kept) == odd_docs.count() - 3


def test_mix_takes_whole_rows_whatever_the_ids(odd_docs):
    taken = untouched(odd_docs.drop("map"), mixing.mixed(odd_docs.drop("map")))
    assert max(taken.values()) <= 2 and not {6, 7, 8, 9} & set(taken)
    sizes = {r["place"]: len(words(r["text"])) for r in odd_docs.collect()}
    assert abs(sum(sizes[k] * n for k, n in taken.items()) - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())
    assert mixing.mixed(odd_docs).count() == sum(taken.values())  # a map is hashed as JSON


def test_repeated_rows_share_their_copies(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s")] * 5 + [(None, "x y", "s")] * 4 + [(i, "w " * (i % 9 + 1), "t") for i in range(2, 40)], "doc_id long, text string, source string")
    out = Counter(tuple(r) for r in mixing.mixed(docs).collect())
    copies = mixing.balanced_copies(docs.select(F.col("doc_id").alias("id"), "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")))
    want = Counter()
    for r in copies.collect():
        want[r["id"], r["size"]] += r["copies"]
    got = Counter()
    for (i, t, _), n in out.items():
        got[i, len(words(t))] += n
    assert got == +want


def test_join_of_repeated_and_null_ids(odd_docs):
    rows = ngram_join.components(odd_docs.select("doc_id", "text"), 4, 85).collect()
    assert len(rows) == odd_docs.count()
    seven = [(r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] == 7]
    assert sorted(seven) == [(57, 7)] * 3
    assert sorted(r["component_id"] or -1 for r in rows if r["doc_id"] is None) == [-1, -1, 7]
    assert {(r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] in (8, 9)} == {(0, 8), (0, 9)}


def test_a_large_family_around_the_threshold(spark):
    """Thousands of near copies without a middle: most pairs lie just below the threshold."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = {}
    for i in range(1200):
        w = list(base)
        for at in r.sample(range(100), r.choice((2, 2, 2, 3))):
            w[at] = f"x{r.randrange(3)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.components(docs, 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)


def test_sketches_never_tell_more_than_there_is():
    r = np.random.default_rng(4)
    for _ in range(200):
        n = int(r.integers(1, 900))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 2**63, int(r.integers(0, 50))).astype(np.uint64)]))
        if not len(b):
            continue
        x, y = ngram_join.sketch(a), ngram_join.sketch(b)
        k = min(len(x), len(y))
        for longs in {k, 4}:
            differ = int(np.bitwise_count((ngram_join.folded(x, longs) ^ ngram_join.folded(y, longs)).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(a, b))


def test_shards_of_one_hot_and_null_id(spark):
    docs = spark.createDataFrame([(None, f"t{i}", "en", f"https://one.example/{i % 7}") for i in range(300)] + [(5, "same", None, None)] * 300, "doc_id long, text string, lang string, source string")
    text = F.coalesce("text", F.lit(""))
    rows = hilbert.hilbert_shards(docs, "doc_id", F.octet_length(text) + 1, F.crc32(F.encode(text, "UTF-8")), [F.col("source"), F.col("lang")], 8).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(map(len, by.values())) == [75] * 8 and all(sorted(s) == list(range(75)) for s in by.values())
    assert len({r["cell"] for r in rows}) >= 7  # sources that begin alike are told apart


def test_string_borders_cut_rows_evenly(spark):
    r = random.Random(3)
    values = [f"common_{r.randrange(500):05d}" for _ in range(4000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "value string")
    borders = hilbert.string_borders(df, 8)
    parts = Counter(sum(b <= v for b in borders) for v in values if v)
    assert len(parts) == 8 and max(parts.values()) - min(parts.values()) < 100
    assert len(hilbert.string_borders(df, 8, most=100)) == 7 and hilbert.string_borders(df.where("value is null"), 8) == []


@pytest.mark.parametrize("most", [0, 1, 10, 255])
def test_string_borders_come_from_all_counts(spark, most):
    """However few runs the values are dealt into, the borders are those of all rows."""
    r = random.Random(5)
    values = [f"{r.choice(('http://x/', 'é', 'Z', '🙂'))}{int(r.paretovariate(0.5)) % 3000:05d}" for _ in range(3000)] + ["http://x/00007"] * 400
    counts, before, expected = Counter(values), 0, {}
    for v in sorted(counts):
        expected.setdefault(8 * before // len(values), v)
        before += counts[v]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value string").repartition(5)
    assert hilbert.string_borders(df, 8, most=most) == [expected[k] for k in sorted(expected) if k]


def test_added_tokens_in_texts_get_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    texts = ["a<|endoftext|>b", *added, *(f"x {t}{t} y\n{t}" for t in added), "<|endoftext", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pieces(docs, path, 2048).collect():
        ids = np.array([*tokenizer.encode(texts[r["id"]] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (r["length"], r["ids_crc32"]) == (len(ids) // 4, zlib.crc32(ids))


def test_exact_quadruples_are_found_among_many_lengths():
    left = {500: 1, 31: 1, 33: 1, 36: 1} | {600 + i: 1 for i in range(200)}
    groups = packing.exact_groups(left, 600)
    assert groups == [((500, 31, 36, 33), 1)] or (len(groups) == 1 and sorted(groups[0][0]) == [31, 33, 36, 500])


@pytest.mark.parametrize("page", ["<p a=" + "\"'" * 50_000 + ">x</p>", '<a href="' * 50_000, "<div>x" * 50_000, "<ul><li>x" * 50_000, "< <a " * 50_000, "<!x" * 50_000, "<dl>" * 50_000 + "<p>z</p>" * 50_000, "<p>some words here.</p>" * 450_000])
def test_pages_of_any_shape_are_read_in_time(page):
    start = time.monotonic()
    blocks = html_crf.leaf_blocks(page)
    html_crf.describe(blocks)
    assert time.monotonic() - start < 30


def test_quotes_in_tags():
    text = lambda p: [b.text for b in html_crf.leaf_blocks(p)]
    assert text("<p title=\"a > b\">one</p><p title='<x>'>two</p>") == ["one", "two"]
    assert text('<p title="never closed>one</p>') == ["one"]
    assert text("<p title=it's>one</p><b>don't</b>") == ["one", "don't"]
    assert text("1 < 2 and <b>3</b> <") == ["1 < 2 and 3 <"]


def test_toxicity_does_not_depend_on_the_layout(spark):
    r = random.Random(9)
    docs = [(i, " ".join(r.choice(("grublox", "vexmorp", "plain", "quiet", "words", "stone", "river")) if i % 4 == 0 else r.choice(("plain", "quiet", "words", "stone", "river", "saint grublox")) for _ in range(12))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    found = [toxicity.learn(df.repartition(n), labels) for n in (1, 8, 60)]
    assert found[0].weights and all((x.weights, x.exceptions) == (found[0].weights, found[0].exceptions) for x in found)
    assert len({tuple(round(x.score(t), 12) for _, t in docs) for x in found}) == 1


def test_matching_equals_a_naive_search():
    r = random.Random(2)
    for _ in range(200):
        entries = {"".join(r.choice("abe") for _ in range(r.randint(2, 4))) + r.choice(("", " ")): r.random() for _ in range(6)}
        phrases = [" " + " ".join("".join(r.choice("abe") for _ in range(r.randint(1, 4))) for _ in range(2)) for _ in range(3)]
        text = toxicity.folded(" ".join("".join(r.choice("abe") for _ in range(r.randint(1, 6))) for _ in range(30)))
        spared = [(i, i + len(p) - 1) for p in phrases for i in range(len(text)) if text.startswith(p, i)]
        want = []
        for i in range(len(text)):
            hits = [e for e in entries if text.startswith(" " + e, i)]
            if hits:
                e = max(hits, key=len)
                if not any(a <= i and i + len(e) - 1 <= b for a, b in spared):
                    want.append((i, e))
        assert sorted(toxicity.Lexicon(entries, phrases).matches(text)) == want


def test_many_exceptions_cost_little():
    lexicon = toxicity.Lexicon({"grub": 2.0}, [" saint grub"])
    start = time.monotonic()
    assert lexicon.matches(toxicity.folded("saint grub " * 20_000)) == [] and time.monotonic() - start < 5


def test_additions_equal_a_naive_sum():
    r = np.random.default_rng(1)
    x = r.random((500, 3))
    model = gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    for row, got in zip(x[:50], model.logit(x[:50]), strict=True):
        bin_of = lambda borders, v: sum(b <= v for b in borders)
        want = model.base + sum(t[bin_of(b, v)] for t, b, v in zip(model.tables, model.borders, row, strict=True))
        want += sum(t[bin_of(model.pair_borders[a], row[a]), bin_of(model.pair_borders[b], row[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert got == pytest.approx(want)


def test_null_ids_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "some words of text"), (1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for op in (toxicity.op6_toxicity_lexicon, gam.op9_quality_gam):
        assert {r["doc_id"]: r["held_out"] for r in op(spark, str(tmp_path)).collect()}[None] is False


def test_the_conditional_equals_the_list(spark):
    r = random.Random(6)
    listed = [[rules.Test(r.randrange(7), r.random(), r.random() < 0.5) for _ in range(r.randint(1, 3))] for _ in range(5)]
    rows = [tuple(r.random() for _ in rules.FEATURES) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in rules.FEATURES))
    got = [x[0] for x in df.select(rules.verdict(listed, F.struct(*rules.FEATURES))).collect()]
    holds = lambda t, row: (row[t.feature] >= t.border) == t.above
    assert got == [not any(all(holds(t, row) for t in tests) for tests in listed) for row in rows] and len(set(got)) == 2


def test_cuts_are_those_that_part_the_labels():
    assert rules.best_cuts([1.0, 2.0, 3.0, 4.0], [9, 9, 0, 0, 9], [0, 0, 9, 9, 0], 5) == [2.0, 4.0]
    assert rules.best_cuts([1.0, 2.0, 3.0], [9, 0, 5, 0], [0, 9, 0, 9], 1) == [1.0]
    assert rules.best_cuts([], [3], [2], 5) == [] and rules.best_cuts([1.0], [0, 0], [2, 2], 5) == []


def test_pipeline_of_empty_tables(spark, empty_dir):
    docs = spark.read.parquet(f"{empty_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, empty_dir)
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)
        docs = out if k < 4 else docs
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_pipeline_of_odd_rows(spark, odd_docs, odd_labels, tmp_path):
    odd_docs.drop("map").write.parquet(f"{tmp_path}/documents.parquet")
    odd_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 10
