"""N-gram Jaccard join (operator 4): adaptive multi-match prefixes.

Documents are sets of word shingles. All sets list their shingles in one global order, rare
ones first. Two sets with Jaccard similarity t or more share at least l shingles among the
first n - ceil(t * n) + l of each, for every l (Wang, Li, Feng 2012). Each document takes the l
of the least estimated cost: a longer prefix costs probes, but a pair is verified only if it
shares l prefix shingles. A pair may use the smaller l of its two documents.

Equal sets are one class from the start. In long posting lists classes are first compared with
leaders, so a group of thousands of near copies is joined by about one link a member and never
spelt out as pairs. Then each list gives the pairs of different components, but a list is
skipped for a pair whose members share the list before it too: there the pair has been given.
What such pairs have in common is bounded by their sizes, by the shingles that no other prefix
holds, by what their prefixes share, and by parity sketches (a set's shingles toggle bits, so
two sketches differ in no more bits than the sets do in shingles); what passes all bounds is
verified on whole sets. So every link between different components is found.

Edge cases: a null text, or one without words, is an empty set and linked with nothing; a text
of fewer words than a shingle is one shingle, its whole sequence; repeated rows are equal sets;
rows of one id with different texts are documents of their own, all under that id; rows without
an id link others, and are a component without an id if no other row is in it; long texts are
taken whole; an empty table gives no rows; columns beside the id and the text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from xxhash import xxh3_64_intdigest

from .common import MAX_SENT, Scratch, WordIds, distinct_counts, in_chunks, mix, row_hash, small_batches

#: Frequent shingles whose counts order the others, at most; fewer or more change speed, never results.
MAX_FREQUENT = 1 << 19
#: A list of so many classes is first compared with leaders.
LONG_LIST = 12
LEADER_ROUNDS, LEADERS = 3, 3
#: Classes that a task remembers having given, at most.
MAX_SEEN = 200_000
#: Shingles among which a task looks for repeated ones at a time; more tell more of how frequent they are.
MAX_HELD = 3_000_000
#: Longs of the short sketch that lists carry. Sets of more shingles than NARROW go without: it bounds nothing for them.
SHORT_SKETCH, NARROW = 4, 800
#: A column name that documents do not use.
ROW = "__ngram_join_row"
#: Matches a prefix may ask for, what verifying a candidate costs in units of one probe, and
#: how many other documents a shingle of unknown count is expected to meet.
MOST_MATCHES, VERIFY_COST, MEETS = 8, 8.0, 0.1
BLOOM_BITS = 1 << 24


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    a = ids.view(np.uint64)
    m, k = (n - k + 1, k) if n >= k else (1, n)
    h = np.full(m, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[j : j + m]
    h = np.sort(mix(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def signed(a) -> np.ndarray:
    return np.asarray(a, dtype=np.uint64).view(np.int64)


def prefix(s: np.ndarray, percent: int, frequent: np.ndarray, often: np.ndarray) -> tuple[int, np.ndarray, int]:
    """(l, the first shingles of the global order that l asks for, how many of them have no known count). The order: by known count, then by hash."""
    n = len(s)
    count = np.ones(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        count = np.where(frequent[at] == s, often[at], 1)
    order = np.argsort(count, kind="stable")  # s is sorted by hash
    s, count = s[order], count[order]
    least = n - -(-percent * n // 100)  # the prefix that asks for l is longer by l
    matches = np.arange(1, min(MOST_MATCHES, n - least) + 1)
    meets = np.cumsum(count - 1 + MEETS)[least + matches - 1]
    chosen = int(matches[np.argmin(least + matches + VERIFY_COST * meets / matches)])
    return chosen, s[: least + chosen], int((count[: least + chosen] == 1).sum())


def frequent_shingles(docs: DataFrame, k: int, most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in many documents, and counts. Each task reports, of every few million shingles that it reads, those that two different sets hold."""

    def repeated(sets):
        value, count = distinct_counts(np.concatenate(sets))
        return pa.RecordBatch.from_arrays([pa.array(signed(value[count > 1])), pa.array(count[count > 1])], ["s", "n"])

    def run(batches):
        words, sets, held = WordIds(), {}, 0
        for _, texts in in_chunks(batches, "text", 4_000_000):
            for t in texts:
                s = shingles(words.of(t), k)
                if (c := class_of(s)) is not None and c not in sets:
                    sets[c] = s
                    held += len(s)
            if held > MAX_HELD:
                yield repeated([*sets.values()])
                sets, held = {}, 0
        if sets:
            yield repeated([*sets.values()])

    counted = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "s").limit(most).toArrow()
    s, n = np.array(top["s"], dtype=np.int64).view(np.uint64), np.array(top["n"], dtype=np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles by their low bits, two to four bits a shingle."""
    bits = max(64 * SHORT_SKETCH, 1 << (2 * len(s) - 1).bit_length())
    parity = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def folded(x: np.ndarray, longs: int) -> np.ndarray:
    """A sketch of as many longs as asked for, or more, halves laid over each other until it has as many."""
    while len(x) > longs:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def lists(parts: list[np.ndarray | None]) -> pa.ListArray:
    """An Arrow array of lists of longs; None is null."""
    ends = np.cumsum([0, *(0 if p is None else len(p) for p in parts)], dtype=np.int32)
    flat = np.concatenate([p for p in parts if p is not None] or [np.empty(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([p is None for p in parts], pa.bool_()))


def signatures(docs: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """(doc_id, row, n, class, matches, rare, prefix, sketch, short) of (doc_id, text): row is a hash of both, class a digest of the set, null if empty. A task gives the others with the first of its rows of a class."""

    def run(batches):
        words, seen = WordIds(), set()
        often = frequent.value
        for b, texts in in_chunks(batches, "text"):
            if len(seen) > MAX_SEEN:
                seen.clear()
            sizes, classes, matches, rare, parts, bits, few = [], [], [], [], [], [], []
            for t in texts:
                s = shingles(words.of(t), k)
                c = class_of(s)
                m = unknown = p = x = y = None
                if c is not None and c not in seen:
                    seen.add(c)
                    m, p, unknown = prefix(s, percent, *often)
                    p, x = signed(p), sketch(s)
                    y = folded(x, SHORT_SKETCH) if len(s) <= NARROW else None
                for column, value in zip((sizes, classes, matches, rare, parts, bits, few), (len(s), c, m, unknown, p, x, y), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(matches, pa.int32()), pa.array(rare, pa.int32()), lists(parts), lists(bits), lists(few)], ["doc_id", "row", "n", "class", "matches", "rare", "prefix", "sketch", "short"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("row long, n long, class long, matches int, rare int, prefix array<long>, sketch array<long>, short array<long>").fields])
    return docs.select("doc_id", "text", row_of("doc_id", "text")).mapInArrow(run, schema)


def row_of(*columns: str) -> Column:
    """Repeated rows have one number."""
    return F.xxhash64(*columns).alias("row")


def class_of(s: np.ndarray) -> int | None:
    return int(signed([xxh3_64_intdigest(s.tobytes())])[0]) if len(s) else None


def bloom(rows: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over row numbers, made by tasks and joined here."""

    def run(batches):
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        some = False
        for b in batches:
            at = np.array(b["row"]).view(np.uint64) % np.uint64(BLOOM_BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in rows.select("row").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int, k: int) -> DataFrame:
    """(class, set) of the `n` rows that `wanted` (row) names: 48 bits of each shingle hash, sorted, as bytes. Texts that the bitmap does not take for one of them go no further; a task gives repeated rows once."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom(wanted))

    def run(batches):
        words, seen = WordIds(), set()
        for b in batches:
            at = np.array(b["row"]).view(np.uint64) % np.uint64(BLOOM_BITS)
            hit = (bits.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            rows = np.flatnonzero(hit)
            for start in range(0, len(rows), 500):
                if len(seen) > MAX_SEEN:
                    seen.clear()
                part, found = b.take(pa.array(rows[start : start + 500])), []
                for row, t in zip(part["row"].to_pylist(), part["text"].to_pylist(), strict=True):
                    if row not in seen:
                        seen.add(row)
                        s = shingles(words.of(t), k)
                        if len(s):
                            found.append((row, class_of(s), pack(s)))
                columns = list(zip(*found, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["row", "class", "set"])

    sets = docs.select("text", row_of("doc_id", "text")).mapInArrow(run, "row long, class long, set binary")
    return sets.join(sent(wanted, n), "row", "left_semi").select("class", "set")


def pack(s: np.ndarray) -> bytes:
    return np.unique((s >> np.uint64(16)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def verify(pairs: DataFrame, n: int, sets: DataFrame) -> DataFrame:
    """(a, b, common, size_a, size_b) of `n` pairs (a, b) of classes, on whole sets."""

    def run(batches):
        last, left = None, None
        for b in batches:
            common, na, nb = [], [], []
            for x, y in zip(b["x"], b["y"], strict=True):
                raw = y.as_py()
                if raw != last:  # often the same as before
                    last, left = raw, unpack(raw)
                right = unpack(x.as_py())
                common.append(len(np.intersect1d(left, right, assume_unique=True)))
                na.append(len(right))
                nb.append(len(left))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], *(pa.array(c, pa.int64()) for c in (common, na, nb))], ["a", "b", "common", "size_a", "size_b"])

    both = with_both(pairs, n, sets, "class", ["set"]).select("a", "b", F.col("a_set").alias("x"), F.col("b_set").alias("y"))
    return both.mapInArrow(run, "a long, b long, common long, size_a long, size_b long")


def sent(df: DataFrame, n: int) -> DataFrame:
    """df, marked to be sent to all executors if its `n` rows are few."""
    return F.broadcast(df) if n <= MAX_SENT else df


def with_both(pairs: DataFrame, n: int, facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(a, b, a_..., b_...): `n` pairs and the facts of both. Few pairs are sent to the facts, which stay in place; more are dealt out."""
    side = lambda end: facts.select(F.col(key).alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
    if n > MAX_SENT:
        return pairs.join(side("a"), "a").join(side("b"), "b")
    few = F.broadcast(pairs)
    return side("a").join(few, "a").join(side("b").join(few, "b"), ["a", "b"])


def connected(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(node, root) for all nodes of edges (a, b), and how many they are: the least node of each component, by hooking larger roots to smaller ones and halving paths."""
    edges, left = scratch.counted(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    roots, nodes = scratch.counted(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "roots0")
    k = 0
    while left:
        k += 1
        hooks = scratch.table(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), f"hooks{k}_0")
        j = 0
        while True:  # until every hook leads to a root
            j += 1
            up = hooks.select(F.col("node").alias("up"), F.col("up").alias("further"))
            hooks, _, moved = scratch.counted(hooks.join(up, "up", "left").select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), f"hooks{k}_{j}", "moved")
            hooks = hooks.drop("moved")
            scratch.drop(f"hooks{k}_{j - 1}")
            if not moved:
                break
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        roots = scratch.table(roots.join(to("root"), "root", "left").select("node", F.coalesce("root_up", "root").alias("root")), f"roots{k}")
        moved_edges = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        edges, left = scratch.counted(moved_edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges{k}")
        scratch.drop(f"roots{k - 1}", f"edges{k - 1}", f"hooks{k}_{j}")
    return roots, nodes


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text): links are pairs with 100 * common >= percent * union."""
    with small_batches(docs.sparkSession):
        return _components(docs.select("doc_id", "text"), k, percent).select("doc_id", "n_shingles", "component_id")


class Bounds:
    """What pairs of classes can have in common at most, as conditions on columns of the one and the other."""

    def __init__(self, percent: int):
        self.percent = percent

    def enough(self, common, both: Column) -> Column:
        """So many common shingles, of `both` sizes added up, make the similarity."""
        return (100 + self.percent) * common >= self.percent * both

    def fits(self, x, y) -> Column:
        """Sizes, and the rests if both are known, leave the similarity possible. x and y give columns by name."""
        rests = F.when(x("rest").isNotNull() & y("rest").isNotNull(), self.enough(F.least(x("rest"), y("rest")), x("n") + y("n")))
        return (100 * F.least(x("n"), y("n")) >= self.percent * F.greatest(x("n"), y("n"))) & F.coalesce(rests, F.lit(True))

    def apart(self, differ: Column, x, y) -> Column:
        """The similarity is possible for sets that differ in so many shingles at least; null tells nothing."""
        both = x("n") + y("n")
        return F.coalesce(self.enough(both - differ, 2 * both), F.lit(True))

    def sketches(self, x, y) -> Column:
        """The longer sketch is folded to the shorter's length."""
        xor = lambda p, q: p.bitwiseXOR(q)
        half = lambda s: F.floor(F.size(s) / 2).cast("int")
        fold = lambda s: F.zip_with(F.slice(s, F.lit(1), half(s)), F.slice(s, half(s) + 1, half(s)), xor)
        p, q = x("sketch"), y("sketch")
        short = lambda s, o: F.when(F.size(s) > F.size(o), fold(s)).otherwise(s)
        return self.apart(F.aggregate(F.zip_with(short(p, q), short(q, p), xor), F.lit(0), lambda n, v: n + F.bit_count(v)), x, y)

    def short_sketches(self, x, y) -> Column:
        bits = [F.bit_count(F.get(x("short"), i).bitwiseXOR(F.get(y("short"), i))) for i in range(SHORT_SKETCH)]
        differ = bits[0]
        for c in bits[1:]:
            differ = differ + c
        return self.apart(differ, x, y)

    def prefixes(self, x, y) -> Column:
        """As many shared listed shingles as the smaller of both asks for. Prefixes that hold all their rare shingles have no more of these in common than are listed in both."""
        both = lambda c: F.size(F.array_intersect(x(c), y(c)))
        rare = both("rare_tokens")
        shared = both("known_tokens") + rare
        room = F.when(x("known").isNotNull() & y("known").isNotNull(), F.least(x("known"), y("known")) + rare)
        return (shared >= F.least(x("matches"), y("matches"))) & F.coalesce(self.enough(room, x("n") + y("n")), F.lit(True))


def of(prefix: str):
    return lambda name: F.col(prefix + name)


def class_records(marked: DataFrame, percent: int) -> DataFrame:
    """A row for each class that shares a prefix shingle with another: its numbers, sketch and listed shingles.

    `known` is how many of its shingles have a known count, and `rest` how many may be in others
    at all: null where the prefix does not reach the known ones, so that more rare ones may follow.
    """
    own = W.partitionBy("token")
    entries = marked.where(F.col("prefix").isNotNull()).select("class", "rare", F.posexplode("prefix").alias("pos", "token")).select("token", "class", (F.col("pos") < F.col("rare")).alias("is_rare"))
    shared = entries.withColumn("low", F.min("class").over(own)).withColumn("high", F.max("class").over(own)).where("low != high").select("token", "class", "is_rare").distinct()
    listed = shared.groupBy("class").agg(F.sort_array(F.collect_list(F.when(~F.col("is_rare"), F.col("token")))).alias("known_tokens"), F.sort_array(F.collect_list(F.when(F.col("is_rare"), F.col("token")))).alias("rare_tokens"))
    once = lambda c: F.first(c, ignorenulls=True).alias(c)
    facts = marked.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("row").alias("row"), *map(once, ("n", "matches", "rare", "sketch", "short")))
    out = listed.join(facts, "class")
    least = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)
    known = F.when(F.col("rare") < least + F.col("matches"), F.col("n") - F.col("rare"))
    out = out.withColumn("known", known).withColumn("rest", F.col("known") + F.size("rare_tokens"))
    # A list of a known shingle holds only prefixes with all their rare ones. What stands alone of a
    # class's rare shingles is in none of them: if the rest cannot reach the similarity, the class
    # has nothing to look for in the lists of known shingles.
    can = Bounds(percent).enough(F.col("rest"), F.col("n") + F.ceil(F.lit(percent) * F.col("n") / 100))
    out = out.withColumn("known_tokens", F.when(F.coalesce(can, F.lit(True)), F.col("known_tokens")).otherwise(F.array().cast("array<long>")))
    listed_tokens = F.size("known_tokens") + F.size("rare_tokens")
    share = listed_tokens / (least + F.col("matches"))
    return out.where(listed_tokens > 0).select("class", "row", "n", "matches", "known", "rest", share.alias("share"), "sketch", "short", "known_tokens", "rare_tokens")


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, row, class, root, n_shingles, component_id); root is the class that names the component."""
    spark = docs.sparkSession
    scratch, bounds = Scratch(spark), Bounds(percent)
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, k))
    marked = scratch.table(signatures(docs, k, percent, frequent), "signatures")
    records = scratch.table(class_records(marked, percent), "records")
    own = W.partitionBy("token")
    tokens = F.array_sort(F.concat("known_tokens", "rare_tokens")).alias("tokens")
    before = F.explode(F.transform("tokens", lambda t, i: F.struct(t.alias("token"), F.get("tokens", i - 1).alias("before"))))
    links, roots, n_roots, seen, n_seen = None, None, 0, None, 0

    def with_roots(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("class"))
        return rows.join(sent(roots.withColumnRenamed("node", "class"), n_roots), "class", "left").withColumn("root", F.coalesce("root", "class"))

    def checked(pairs: DataFrame, name: str) -> tuple[DataFrame, int, int]:
        """(a, b, linked) of the pairs that pass the bounds and have not been seen, how many and how many linked; those alone need whole sets."""
        if seen is not None:
            pairs = pairs.join(sent(seen.select("a", "b"), n_seen), ["a", "b"], "left_anti")
        # Sketches leave few pairs, which alone need the shingles of prefixes.
        both = with_both(*scratch.counted(pairs, f"new_{name}"), records, "class", ["n", "sketch"]).where(bounds.sketches(of("a_"), of("b_")))
        both = with_both(*scratch.counted(both.select("a", "b"), f"near_{name}"), records, "class", ["row", "n", "matches", "known", "known_tokens", "rare_tokens"])
        both, n = scratch.counted(both.where(bounds.prefixes(of("a_"), of("b_"))).select("a", "b", "a_row", "b_row"), f"pairs_{name}")
        if not n:  # no text need be read
            return both.select("a", "b", F.lit(False).alias("linked")), 0, 0
        rows, n_rows = scratch.counted(both.select(F.explode(F.array("a_row", "b_row")).alias("row")).distinct(), f"wanted_{name}")
        sets = scratch.table(whole_sets(docs, rows, n_rows, k), f"sets_{name}")
        of_class = sets.groupBy("class").count()
        if of_class.where("count > 1").limit(1).count():  # repeated rows in several tasks
            sets = sets.dropDuplicates(["class"])
        linked = 100 * F.col("common") >= percent * (F.col("size_a") + F.col("size_b") - F.col("common"))
        out = scratch.counted(verify(both.select("a", "b"), n, sets).select("a", "b", linked.alias("linked")), f"seen_{name}", "linked")
        scratch.drop(f"new_{name}", f"near_{name}", f"pairs_{name}", f"wanted_{name}", f"sets_{name}")
        return out

    def join_links(found: DataFrame, linked: int, name: str) -> bool:
        """Components with the links found; False if there are none."""
        nonlocal links, roots, n_roots
        if not linked:
            return False
        found = found.where("linked").select("a", "b")
        links = found if links is None else links.unionAll(found)
        own_scratch = Scratch(spark)
        roots, n_roots = connected(links, own_scratch)
        roots = scratch.table(roots, name)
        own_scratch.drop(own_scratch.root)
        return True

    # Long lists: classes against leaders, those with the largest shared part of their prefix first, then others.
    sizes = records.select(F.explode(F.concat("known_tokens", "rare_tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    names, n_names = scratch.counted(sizes.where(F.col("size") >= LONG_LIST).select("token"), "names")
    flat = records.select("class", "n", "rest", "share", "short", tokens).select("class", "n", "rest", "share", "short", before.alias("at")).select("class", "n", "rest", "share", "short", "at.*")
    long = scratch.table(flat.join(sent(names, n_names), "token", "left_semi"), "long")
    for r in range(LEADER_ROUNDS):
        mixed = with_roots(long.drop("short", "before")).withColumn("low", F.min("root").over(own)).withColumn("high", F.max("root").over(own)).where("low != high").drop("low", "high")
        drawn = F.struct((-F.col("share")).alias("w") if r == 0 else F.xxhash64("class", F.lit(r)).alias("w"), "class")
        heads = mixed.withColumn("k", F.row_number().over(W.partitionBy("token").orderBy(drawn))).where(F.col("k") <= LEADERS).select("token", F.struct("class", "n", "rest", "root").alias("leader"))
        led = mixed.join(heads, "token").where((F.col("class") != F.col("leader.class")) & (F.col("root") != F.col("leader.root")) & bounds.fits(of(""), of("leader.")))
        pairs, n = scratch.counted(led.select(F.least("class", "leader.class").alias("a"), F.greatest("class", "leader.class").alias("b")).distinct(), f"led{r}")
        if not n:
            break
        found, n, linked = checked(pairs, f"round{r}")
        seen, n_seen = found if seen is None else seen.unionAll(found), n_seen + n
        scratch.drop(f"led{r}")
        if not join_links(found, linked, f"joined{r}"):
            break  # other leaders would hardly find more; what is left is looked for below

    # Pairs of different components. A list's largest component is only met by the others.
    def met(rows: DataFrame, more) -> DataFrame:
        # The windows over tokens come first: what they deal out serves all that follows.
        rows = rows.withColumn("low", F.min("root").over(own)).withColumn("high", F.max("root").over(own)).where("low != high").drop("low", "high")
        rows = rows.withColumn("c", F.count(F.lit(1)).over(W.partitionBy("token", "root")))
        rows = rows.withColumn("main", F.max(F.struct("c", "root")).over(own)["root"]).drop("c")
        l, r = of("l."), of("r.")
        given = F.coalesce(l("before") == r("before"), F.lit(False))
        differ = (l("token") == r("token")) & (l("root") != r("root")) & ((r("root") == r("main")) | (l("class") < r("class"))) & ~given & bounds.fits(l, r) & more(l, r)
        pairs = rows.where("root != main").alias("l").join(rows.alias("r"), differ)
        return pairs.select(F.least(l("class"), r("class")).alias("a"), F.greatest(l("class"), r("class")).alias("b"))

    rooted = with_roots(records.select("class", "n", "rest", tokens)).select("class", "root", "n", "rest", before.alias("at")).select("class", "root", "n", "rest", "at.*")
    short_lists, sketched = rooted.join(sent(names, n_names), "token", "left_anti"), with_roots(long.drop("share"))
    pairs = met(short_lists, lambda l, r: F.lit(True)).unionAll(met(sketched, bounds.short_sketches)).distinct()
    found, _, linked = checked(scratch.table(pairs, "met"), "met")
    join_links(found, linked, "joined")

    firsts = with_roots(marked.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first")))
    parts = firsts.groupBy("root").agg(F.min("first").alias("component"))
    named = firsts.select("class", "root").join(parts, "root")
    out = marked.select("doc_id", "row", "n", "class").join(named, "class", "left")
    out = out.select("doc_id", "row", "class", "root", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
    out = Scratch(spark).table(out, "components")
    scratch.drop(scratch.root)
    return out


def op4_adaptive_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 4-word shingles with Jaccard similarity of 0.85 or more."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


def keep_first_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (rows without an id come last; ties go by a hash of the text). Rows without words all stay, each of repeated rows of them too.

    The rows that go are named; where their names are few enough to be sent to all executors
    (MAX_SENT), the texts stay in place, else they are dealt out by name once.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        rows = _components(docs.select("doc_id", "text"), k, percent).where(F.col("root").isNotNull())
    firsts = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row"))["row"].alias("kept"))
    # A row number is a hash of id and text: repeated rows share one.
    numbers = rows.groupBy("root", "row").agg(F.count(F.lit(1)).alias("n")).join(firsts, "root")
    scratch = Scratch(spark)
    odd, n_odd, n_repeated = scratch.counted(numbers.where((F.col("row") != F.col("kept")) | (F.col("n") > 1)).select(F.col("row").alias(ROW), (F.col("row") == F.col("kept")).alias(f"{ROW}_kept")), "odd", f"{ROW}_kept")
    numbered = docs.withColumn(ROW, F.xxhash64("doc_id", "text"))
    out = numbered.join(sent(odd.select(ROW), n_odd), ROW, "left_anti").drop(ROW)
    repeated = odd.where(f"{ROW}_kept").select(ROW)
    if n_repeated:
        again = numbered.join(sent(repeated, n_repeated), ROW, "left_semi")
        columns = [F.col(f"`{c}`") for c in docs.columns]
        one = again.groupBy(ROW).agg(F.min_by(F.struct(*columns), row_hash(docs)).alias(f"{ROW}_one"))
        out = out.unionByName(one.select(f"{ROW}_one.*"))
    return out
