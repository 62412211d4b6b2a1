"""First-wins near copies without pairs, and keys of near hashes."""

import random
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.operators import dedup, media


def greedy_texts(rows, threshold):
    """Ids that stay of (id, words), by order of id."""
    kept = []
    for i, words in sorted(rows):
        s = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
        if all(len(s & k) < threshold * len(s | k) for _, k in kept):
            kept.append((i, s))
    return [i for i, _ in kept]


def family(r, n, changes, size=60):
    """n texts of one base with up to `changes` words changed in each, so that some are like others but not like the first."""
    base = [f"b{r.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, changes)):
            w[r.randrange(size)] = f"c{r.randrange(30)}"
        out.append(w)
    return out


def test_families_at_the_border_equal_the_greedy_walk(spark):
    r = random.Random(8)
    texts = [w for _ in range(4) for w in family(r, 15, 4)] + [[f"w{r.randrange(50)}" for _ in range(r.randint(1, 40))] for _ in range(30)]
    r.shuffle(texts)
    seen, rows = set(), []
    for i, w in enumerate(texts):
        if (key := tuple(w)) not in seen:
            seen.add(key)
            rows.append((i, w))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id long, text string")
    sets = dedup.shingle_sets(df, "id", "text")
    nodes = df.select("id", F.col("id").alias("ord"))
    for worth in (0.0, 1e9):  # rounds as long as they help, all pairs
        kept = dedup.first_wins_in_lists(nodes, dedup.prefix_lists(sets, 0.7), dedup.sizes_allow(0.7), lambda pairs: dedup.verified(pairs, sets, 0.7), worth)
        assert sorted(x["id"] for x in kept.collect()) == greedy_texts(rows, 0.7)


def test_lists_decide_as_pairs_do_on_random_graphs(spark):
    r = random.Random(9)
    edges = sorted({tuple(sorted(r.sample(range(80), 2))) for _ in range(200)})
    ord_of = {i: r.random() for i in range(80)}
    nodes = spark.createDataFrame([(i, ord_of[i]) for i in range(80)], "id long, ord double")
    entries = spark.createDataFrame([(n, h) for h, e in enumerate(edges) for n in e] + [(n, 10_000) for n in range(80)], "id long, h long")
    real = spark.createDataFrame(edges, "a long, b long")
    both = real.unionAll(real.select("b", "a"))
    want = sorted(x["id"] for x in dedup.first_wins(nodes, real).collect())
    for worth in (0.0, 1e9):
        got = dedup.first_wins_in_lists(nodes, entries, lambda a, b: F.lit(True), lambda p: p.join(both, ["a", "b"]), worth)
        assert sorted(x["id"] for x in got.collect()) == want


def test_a_large_family_costs_a_link_a_member(spark):
    r = random.Random(10)
    base = [f"b{i}" for i in range(200)]
    n = 6000
    texts = [" ".join(w if j != i % 200 else f"x{i}" for j, w in enumerate(base)) for i in range(n)]
    r.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    sets = dedup.shingle_sets(df, "id", "text")
    made = []

    def similar(pairs):
        made.append(pairs.count())
        return dedup.verified(pairs, sets, 0.8)

    kept = dedup.first_wins_in_lists(df.select("id", F.col("id").alias("ord")), dedup.prefix_lists(sets, 0.8), dedup.sizes_allow(0.8), similar)
    assert [x["id"] for x in kept.collect()] == [0] and sum(made) < 3 * n


@pytest.mark.parametrize("n", [1, 1000, 20_000, 10**6, 10**9])
def test_random_hashes_rarely_share_a_key(n):
    keys = media.HammingKeys(n)
    met = len(keys.choices) * n / 2 ** (64 * (keys.parts - 6) / keys.parts)
    assert sum(m.bit_count() for m in keys.masks) == 64 and len(keys.choices) <= 924
    assert met < 1 if n <= 10**6 else met < len(keys.choices)
    assert keys.parts == media.parts_for(n, 6) and media.parts_for(n, 6) >= media.parts_for(n // 2, 6)


def test_near_hashes_share_a_key_whatever_bits_differ(spark):
    r = random.Random(11)
    for n in (10, 20_000, 10**6):
        keys = media.HammingKeys(n)
        for _ in range(300):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), r.randint(0, 6)):
                y ^= 1 << b
            assert any(all((x ^ y) & keys.masks[i] == 0 for i in c) for c in keys.choices)


def test_hamming_pairs_equal_brute_force(spark):
    r = random.Random(12)
    hashes = {}
    for i in range(300):
        x = r.choice([*hashes.values()]) if i % 2 and hashes else r.getrandbits(64)
        for b in r.sample(range(64), r.randint(0, 4)):
            x ^= 1 << b
        hashes[i] = x
    hashes[300] = hashes[0]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(x)) for i, x in hashes.items()] + [(999, None)], "id long, bits long")
    want = {(a, b): (hashes[a] ^ hashes[b]).bit_count() for a, b in combinations(sorted(hashes), 2) if (hashes[a] ^ hashes[b]).bit_count() <= 6}
    got = [((x["a"], x["b"]), x["distance"]) for x in media.hamming_pairs(df).collect()]
    assert len(got) == len(want) and dict(got) == want


@pytest.mark.parametrize("given, dealt, bits", [(1 << 16, 1 << 20, 12), (2, 7, 3)])
def test_hashes_are_moved_once_a_part_and_compared_in_groups(monkeypatch, given, dealt, bits):
    """Rows for each key of a hash were 210 times the hashes, on both sides of a join."""
    for name, value in (("GIVEN", given), ("DEALT", dealt), ("GROUP_BITS", bits)):
        monkeypatch.setattr(media, name, value)
    r = random.Random(14)
    hashes = [r.getrandbits(60) for _ in range(150)]  # the highest bits are alike
    for _ in range(250):
        x = r.choice(hashes)
        for b in r.sample(range(64), r.randint(0, 7)):
            x ^= 1 << b
        hashes.append(x)
    groups = media.HammingGroups(6)
    rows = [x for batch in groups.dealt([pa.record_batch({"bits": pa.array(np.array(hashes, np.uint64).view(np.int64))})]) for x in batch.to_pylist()]
    assert sum(len(x["held"]) for x in rows) <= 7 * 8 * len(hashes)
    rows.sort(key=lambda x: x["group"])
    batch = pa.record_batch({"group": pa.array([x["group"] for x in rows], pa.int32()), "held": [x["held"] for x in rows]})
    found = [(x["xb"] % 2**64, x["yb"] % 2**64, x["distance"]) for b in groups.met([batch.slice(0, 50), batch.slice(50)]) for x in b.to_pylist()]
    want = {(x, y): (x ^ y).bit_count() for x, y in combinations(sorted(set(hashes)), 2) if (x ^ y).bit_count() <= 6}
    assert len(found) == len(want) and {(min(x, y), max(x, y)): d for x, y, d in found} == want


def test_images_keep_the_first_of_each_family(spark):
    r = random.Random(13)
    rows, kept = [], []
    bases = [r.getrandbits(63) for _ in range(4)]
    for i in range(400):
        x = r.choice(bases)
        for b in r.sample(range(63), r.randint(0, 5)):
            x ^= 1 << b
        rows.append((f"i{i}", i, f"s{i}", x))
        if all((x ^ k).bit_count() > 6 for k in kept):
            kept.append(x)
    rows += [("n1", 500, "sx", None), ("n2", 501, "sx", None), ("n3", 502, "sy", None)]
    got = media.dedup_images(spark.createDataFrame(rows, "id string, ord long, sha string, bits long"))
    assert got.columns == ["id", "ord", "sha", "bits"]
    assert sorted(x["bits"] for x in got.where("bits is not null").collect()) == sorted(kept)
    assert sorted(x["id"] for x in got.where("bits is null").collect()) == ["n1", "n3"]


@pytest.mark.parametrize("sent, chunk, again", [(500_000, 4_000_000, 4), (3, 200, 2), (0, 1, 1)])
def test_pairs_do_not_hang_on_what_is_known_of_common_shingles(spark, monkeypatch, sent, chunk, again):
    monkeypatch.setattr(dedup, "MAX_SENT", sent)
    monkeypatch.setattr(dedup, "CHUNK", chunk)
    monkeypatch.setattr(dedup, "AGAIN", again)
    r = random.Random(4)
    texts = [*family(r, 12, 3), *family(r, 12, 6), ["one"], ["one", "two"], *([f"w{r.randrange(9)}" for _ in range(r.randint(5, 30))] for _ in range(20))]
    common = [f"p{k}" for k in range(12)]
    texts = list({tuple(w): common + w if k % 2 else w for k, w in enumerate(texts)}.values())
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in texts]
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "id long, text string")
    got = {(x["a"], x["b"]) for x in dedup.similar_pairs(dedup.shingle_sets(df, "id", "text"), 0.8).collect() if sets[x["a"]] != sets[x["b"]]}
    assert got == want and len(got) >= 3


def test_only_sets_of_pairs_are_moved(spark):
    sets = spark.createDataFrame([(k, list(range(k, k + 20)), 20) for k in range(50)], "id long, set array<long>, n int")
    pairs = spark.createDataFrame([(0, 1), (0, 30)], "a long, b long")
    df = dedup.verified(pairs, sets, 0.85)
    assert [tuple(x) for x in df.collect()] == [(0, 1, 19 / 21)]
    assert "LeftSemi" in df._jdf.queryExecution().executedPlan().toString()


def test_a_set_goes_to_few_cells_and_a_cell_holds_few(spark, monkeypatch):
    """Sets were moved once a pair: of a family of 150, 149 times."""
    monkeypatch.setattr(dedup, "FAMILY", 20)
    family = [*combinations(range(150), 2)]
    chain = [(f, f + 1) for f in range(1000, 1200)]
    df = spark.createDataFrame([(b, a) if (a + b) % 2 else (a, b) for a, b in family + chain], "a long, b long")
    rows = dedup._placed(df).collect()
    assert sorted((min(x["a"], x["b"]), max(x["a"], x["b"])) for x in rows) == sorted(family + chain)
    cells, held = {}, {}
    for x in rows:
        for i in (x["a"], x["b"]):
            cells.setdefault(i, set()).add((x["place"], x["i"], x["j"]))
            held.setdefault((x["place"], x["i"], x["j"]), set()).add(i)
    assert max(map(len, cells.values())) <= 8 and max(map(len, held.values())) <= 80 and {len(cells[i]) for i in range(1000, 1201)} <= {1, 2}


def test_sets_that_share_too_little_of_their_prefixes_are_not_compared(spark, monkeypatch):
    given, action = [], dedup.verified
    monkeypatch.setattr(dedup, "verified", lambda pairs, *a: given.append(sorted(map(tuple, pairs.collect()))) or action(pairs, *a))
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    texts = [words("a", 200), words("a", 195) + words("b", 5), *(words(f"c{k}", 150) + words("common", 50) for k in range(6))]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "id long, text string")
    got = dedup.similar_pairs(dedup.shingle_sets(df, "id", "text"), 0.85).collect()
    assert [(x["a"], x["b"]) for x in got] == [(0, 1)] and given == [[(0, 1)]]


def test_entries_that_meet_nothing_are_not_written(spark, monkeypatch):
    written, action = [], dedup.Scratch.table

    def noted(self, df, name):
        out = action(self, df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(dedup.Scratch, "table", noted)
    df = spark.createDataFrame([(k, " ".join(f"w{k % 8}-{j}" for j in range(40))) for k in range(10)], "id long, text string")
    got = dedup.prefix_lists(dedup.shingle_sets(df, "id", "text"), 0.85).collect()
    assert {x["id"] for x in got} == {0, 1, 8, 9} and sum(written) == len(got)


def test_copies_go_without_moving_texts(spark, tmp_path):
    rows = [(5, "a B"), (3, "a b"), (3, "other"), (4, None), (2, ""), (None, "null's own"), (None, "a, b"), (7, "c"), (8, "C!"), (8, "d")]
    for name, more in (("one", []), ("twins", [(3, "a b"), (8, "D.")])):
        spark.createDataFrame(rows + more, "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        got = dedup.exact_dedup_in_place(df, "id", "text", "id")
        want = dedup.exact_dedup(df, "text", F.col("id"), F.col("id"))
        key = lambda f: sorted((x["id"] is None, x["id"], x["content_hash"]) for x in f.collect())
        assert key(got) == key(want)
        if not more:
            assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_for_each_key_of_a_hash_are_never_collected(spark):
    df = media.hamming_pairs(spark.createDataFrame([(k, k * 2654435761) for k in range(40)], "id long, bits long"))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_signatures_are_least_hashes_of_sparks_own(spark):
    r = random.Random(3)
    rows = [(0, []), (1, [0]), (2, [-1, 2**63 - 1, -(2**63)]), *((k, [r.randrange(-(2**63), 2**63) for _ in range(r.randint(1, 40))]) for k in range(3, 150))]
    df = spark.createDataFrame(rows, "id long, set array<long>").coalesce(1)
    native = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.array_min(F.transform("set", lambda h: F.xxhash64(h, k))))
    want = {x["id"]: x["s"] for x in df.select("id", native.alias("s")).collect()}
    signed = dedup.minhash_signatures(df, 8)
    assert {x["id"]: x["signature"] for x in signed.collect()} == want
    assert "MapInArrow" in signed._jdf.queryExecution().executedPlan().toString()


def test_sets_are_moved_to_workers_in_small_batches(spark, monkeypatch):
    """A worker holds a chunk of shingles and a batch of sets: of 10,000 rows they could be any size."""
    sizes, action = [], dedup.small_batches

    def noted(session):
        held = action(session)
        sizes.append(session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
        return held

    monkeypatch.setattr(dedup, "small_batches", noted)
    sets = dedup.shingle_sets(spark.createDataFrame([(k, "a b c d e f g h") for k in range(3)], "id int, text string"), "id", "text")
    assert {r["id"] for r in dedup.prefix_lists(sets, 0.85).collect()} == {0, 1, 2}
    assert len(sizes) == 2 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == sizes[0]


def test_a_chunk_of_shingles_is_counted_where_it_lies(monkeypatch):
    """Counting a chunk takes little more than its numbers: copies of it for sorting and marks made a worker five times as large."""
    held = {}

    class Sets:
        def select(self, *_):
            return self

        def mapInArrow(self, told, schema):  # noqa: N802
            held["told"] = told
            raise InterruptedError

    monkeypatch.setattr(dedup, "CHUNK", 1_000_000)
    with pytest.raises(InterruptedError):
        dedup.common_shingles(Sets())
    rng = np.random.default_rng(1)
    hashes = rng.integers(-300_000, 300_000, 2_500_000)
    whole = pa.ListArray.from_arrays(pa.array(range(0, len(hashes) + 1, 500), pa.int32()), pa.array(hashes))
    batches = [pa.RecordBatch.from_arrays([whole.slice(k, 700)], ["set"]) for k in range(0, len(whole), 700)]
    want = []
    for k in range(0, len(hashes), dedup.CHUNK):  # also of chunks that end inside a batch
        h, n = np.unique(hashes[k : k + dedup.CHUNK], return_counts=True)
        want += [*zip(h[n >= dedup.AGAIN].tolist(), n[n >= dedup.AGAIN].tolist(), strict=True)]
    got, most = [], 0
    tracemalloc.start()
    for told in held["told"](iter(batches)):
        most = max(most, tracemalloc.get_traced_memory()[1])
        got.append(told)
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert most < 20 * dedup.CHUNK
    assert [x for told in got for x in zip(told["h"].to_pylist(), told["df"].to_pylist(), strict=True)] == want
