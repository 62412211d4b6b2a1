"""Nearest neighbours by multi-index hashing (operator 2).

Several learned rotations (iterative quantisation: Gong and Lazebnik 2011) turn a vector into a
binary code. A code is split into substrings, each indexed in a table of its own; codes that
differ in fewer than m * (r + 1) bits agree within r bits in one of m substrings (Norouzi et al.
2012), so probing the buckets within r bits of a query's substrings retrieves every code within
that radius, and of the codes further away those that agree well somewhere. What is retrieved
and lies within a second, wider radius is reranked by inner products in double precision. The
number of tables, r and the second radius are the least that give the wanted recall on a sample.

Vectors are dealt to shards by the beginning of their code, and a query goes to the shards near
its own beginning only. Vectors of unequal norm either get one more coordinate that makes the norms
equal (Bachrach et al. 2014), so that near codes mean large inner products, or are told apart by
direction alone, whichever finds more on the sample; those longer than nearly all of the sample
are retrieved for every query.

Edge cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; ties go to the smaller id; equal vectors are neighbours
like any; a table with fewer candidates than asked returns all; repeated ids are rows each; an
empty table gives no rows; columns beside the named ones play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Scratch

#: Vectors that the rotations and radii are learned from, those of the smallest id hashes.
MAX_SAMPLE = 10_000
WORD = 16  # bits of a substring
MAX_ROTATIONS, MAX_PROBED = 16, 4


@dataclass
class Coder:
    norm: float
    lift: bool
    mean: np.ndarray
    rotations: list[np.ndarray]  # each dimensions x 64
    radius: int = 0  # of whole codes
    probed: int = WORD  # bits in which a substring may differ
    routed: int = 64  # bits in which the beginnings of codes may differ; learned for `route_bits`
    route_bits: int = 0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        if not self.lift:
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        return np.column_stack([x, rest]) / self.norm

    def long(self, x: np.ndarray) -> np.ndarray:
        return (x**2).sum(1) > self.norm**2 * (1 + 1e-12)

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Substrings (uint16) of the codes of rows; a query's extra coordinate is 0."""
        if query:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            x = np.column_stack([x, np.zeros((len(x), int(self.lift)))])
        else:
            x = self.lifted(x)
        bits = np.concatenate([(x - self.mean) @ r > 0 for r in self.rotations], axis=1)
        return np.packbits(bits, axis=1).view(np.uint16)

    def cells(self, codes: np.ndarray) -> np.ndarray:
        """The beginnings of codes."""
        return (codes[:, 0].byteswap() >> np.uint16(WORD - self.route_bits)).astype(np.int64) if self.route_bits else np.zeros(len(codes), np.int64)


def learn_rotation(x: np.ndarray, bits: int, rng: np.random.Generator, steps: int = 15) -> np.ndarray:
    """A projection on leading directions, rotated so that signs lose least."""
    d = x.shape[1]
    _, vectors = np.linalg.eigh(x.T @ x)
    base = vectors[:, ::-1][:, :bits]
    if base.shape[1] < bits:  # more bits than dimensions: further directions at random
        base = np.column_stack([base, np.linalg.qr(rng.normal(size=(d, d)))[0][:, np.arange(bits - base.shape[1]) % d]])
    v = x @ base
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(steps):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return base @ r


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes of a to all of b."""
    x, y = (np.ascontiguousarray(c).view(np.uint64) for c in (a, b))
    out = np.zeros((len(x), len(y)), np.uint16)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def fit(x: np.ndarray, k: int, route_bits: int = 0, recall: float = 0.93, queries: int = 200, seed: int = 7) -> Coder:
    """Rotations from the sample, and the fewest tables and smallest radii that find `recall` of the k nearest of some of its rows.

    In a larger table the k nearest are nearer, so what is found on a sample holds more there.
    """
    rng = np.random.default_rng(seed)
    norms = np.sqrt((x**2).sum(1))
    longest = float(np.quantile(norms, 0.99)) if len(x) else 1.0
    coder = Coder(longest, False, np.zeros(x.shape[1]), [], route_bits=route_bits)
    if len(x) <= k + 1:
        coder.rotations = [learn_rotation(coder.lifted(x), 64, rng)]
        coder.radius, coder.route_bits = 64, 0
        return coder
    asked = rng.permutation(len(x))[:queries]
    q = x[asked]
    products = q @ x.T
    products[np.arange(len(q)), asked] = -np.inf
    nearest = np.argpartition(-products, k, axis=1)[:, :k]
    best = np.inf
    for lift in (False, True)[: 1 + bool(longest > 1.001 * norms.min())]:
        tried = Coder(longest, lift, np.zeros(0), [], route_bits=route_bits)
        z = tried.lifted(x)
        tried.mean = z.mean(0)
        if lift:
            tried.mean[-1] = 0.0  # as queries have there
        tried.rotations = [learn_rotation(z - tried.mean, 64, rng) for _ in range(MAX_ROTATIONS)]
        of, to = tried.codes(q, True), tried.codes(x)
        shares = table_choice(of, to, nearest, tried.long(x), recall + 0.02)
        share, rotations, tried.probed = min(shares, default=(1.0, MAX_ROTATIONS, MAX_PROBED + 1))
        if share < best:
            tried.rotations = tried.rotations[:rotations]
            coder, best, codes = tried, share, (of[:, : rotations * 64 // WORD], to[:, : rotations * 64 // WORD])
    near = np.take_along_axis(distances(*codes), nearest, 1)
    coder.radius = int(np.quantile(near, recall + 0.05, method="higher"))
    if route_bits:
        a, b = map(coder.cells, codes)
        coder.routed = int(np.quantile(np.bitwise_count(a[:, None] ^ b[nearest]), recall + 0.05, method="higher"))
    return coder


def table_choice(of: np.ndarray, to: np.ndarray, nearest: np.ndarray, always: np.ndarray, recall: float) -> list[tuple[float, int, int]]:
    """(share of rows retrieved, rotations, bits probed) of all choices that find `recall` of the nearest."""
    low = np.full((len(of), len(to)), WORD, np.uint8)  # the best agreement of any substring so far
    low[:, always] = 0
    out = []
    for r in range(1, MAX_ROTATIONS + 1):
        for j in range((r - 1) * 64 // WORD, r * 64 // WORD):
            np.minimum(low, np.bitwise_count(of[:, j, None] ^ to[None, :, j]), out=low)
        found = np.take_along_axis(low, nearest, 1)
        out += [(float((low <= probed).mean()), r, probed) for probed in range(MAX_PROBED + 1) if (found <= probed).mean() >= recall]
    return out


def masks(bits: int, most: int) -> np.ndarray:
    """All numbers of `bits` bits with at most `most` ones."""
    out = np.arange(1 << bits, dtype=np.int64)
    return out[np.bitwise_count(out) <= most]


class Index:
    """Tables of substrings over some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder, rows: np.ndarray | None = None):
        """rows: numbers of the rows, which many may share an id; the ids if left out."""
        self.ids, self.vectors, self.coder = ids, vectors, coder
        self.rows = ids if rows is None else rows
        self.codes = coder.codes(vectors)
        self.always = np.flatnonzero(coder.long(vectors))
        self.tables = []
        for j in range(self.codes.shape[1]):
            order = np.argsort(self.codes[:, j], kind="stable")
            starts = np.concatenate(([0], np.cumsum(np.bincount(self.codes[:, j], minlength=1 << WORD))))
            self.tables.append((order, starts))

    def probe(self, codes: np.ndarray, probed: int) -> np.ndarray:
        """(query, row) as booleans: rows of the buckets within `probed` bits of any substring."""
        near = np.zeros((len(codes), len(self.ids)), bool)
        near[:, self.always] = True
        if probed >= WORD:
            near[:] = True
            return near
        flips = masks(WORD, probed)
        for j, (order, starts) in enumerate(self.tables):
            keys = codes[:, j, None].astype(np.int64) ^ flips[None, :]
            first, n = starts[keys].ravel(), (starts[keys + 1] - starts[keys]).ravel()
            some = np.flatnonzero(n)
            first, n = first[some], n[some]
            upto = np.cumsum(n)
            rows = order[np.repeat(first - (upto - n), n) + np.arange(upto[-1] if len(n) else 0)]
            near[np.repeat(some // len(flips), n), rows] = True
        return near

    def search(self, query_rows: np.ndarray, queries: np.ndarray, k: int):
        """For each query, of which its own row alone is no candidate: its number, ids and scores of its k nearest of those retrieved, and how many were; probes widen until k are found or all are seen."""
        codes, step = self.coder.codes(queries, True), max(1, 8_000_000 // max(len(self.ids), 1))
        for start in range(0, len(codes), step):
            near = self.probe(codes[start : start + step], self.coder.probed)
            for i, row in enumerate(near, start):
                others, probed, radius = int((self.rows != query_rows[i]).sum()), self.coder.probed, self.coder.radius
                while True:
                    rows = np.flatnonzero(row)
                    retrieved = len(rows)
                    rows = rows[self.rows[rows] != query_rows[i]]
                    far = distances(codes[i][None, :], self.codes[rows])[0] > radius
                    rows = rows[~far | self.coder.long(self.vectors[rows])]
                    if len(rows) >= min(k, others):
                        break
                    probed, radius = probed + 1, radius + 16
                    if probed > WORD // 2:
                        probed, radius = WORD, 64 * len(self.coder.rotations)
                    row = self.probe(codes[i : i + 1], probed)[0]
                scores = (self.vectors[rows] * queries[i]).sum(1)
                best = np.lexsort((self.ids[rows], -scores))[:k]
                yield i, self.ids[rows[best]], scores[best], retrieved


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(v.isNotNull() & F.col(id_column).isNotNull() & fine).select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.array(flat, dtype=np.float64).reshape(n, -1)


def search(vectors: DataFrame, queries: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = 16384, block_rows: int = 4096, most: int = MAX_SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score, retrieved). `queries` is a condition on `id`; retrieved: how many rows the tables gave for the query.

    Vectors with codes of one beginning are dealt, by a hash of the id, into as many shards as
    hold about `shard_rows` each, so a beginning that many share is split. A shard is indexed in
    one task; the queries whose beginning is near come to it in blocks and give one list of k
    each, which are merged. A group holds one shard and one block of queries, whatever the table's size.
    """
    spark = vectors.sparkSession
    # A row's number is fixed where it is written: rows of one id are rows each.
    table = Scratch(spark).table(usable(vectors, id_column, vector_column).withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = table.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double, retrieved long"
    if not lengths:
        return spark.createDataFrame([], result)
    table, n = table.where(F.size("v") == lengths[0]["d"]), lengths[0]["count"]
    sample = table.orderBy(F.xxhash64("id"), "id", "row").limit(most).toArrow()
    route_bits = int(min(WORD, max(0, np.floor(np.log2(max(n, 1) / shard_rows)))))
    coder = spark.sparkContext.broadcast(fit(matrix(sample["v"], sample.num_rows), k, route_bits))
    bits, routed = coder.value.route_bits, coder.value.routed

    def with_cells(rows: DataFrame, query: bool) -> DataFrame:
        def run(batches):
            c = coder.value
            for b in batches:
                if b.num_rows:
                    x = matrix(b["v"], b.num_rows)
                    cells = c.cells(c.codes(x, query))
                    if not query:  # long vectors have a place of their own, where all queries go
                        cells = np.where(c.long(x), 1 << bits, cells)
                    yield pa.RecordBatch.from_arrays([b["id"], b["v"], b["row"], pa.array(cells, pa.int32())], ["id", "v", "row", "cell"])

        return rows.mapInArrow(run, "id long, v array<double>, row long, cell int") if bits else rows.withColumn("cell", F.lit(0))

    # A count for each beginning, n / shard_rows of them at most.
    indexed = with_cells(table, False)
    sizes = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}
    shards = {c: max(1, -(-count // shard_rows)) for c, count in sizes.items()}
    first = dict(zip(sorted(shards), np.cumsum([0, *(shards[c] for c in sorted(shards))]).tolist(), strict=False))
    asked = with_cells(table.where(queries), True)
    blocks = max(1, -(-asked.count() // block_rows))
    places = spark.createDataFrame([(c, first[c], shards[c]) for c in sorted(shards)], "cell int, first int, shards int")
    part = F.pmod(F.xxhash64("id", "row", F.lit(1)), F.col("shards")).cast("int")
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = indexed.join(F.broadcast(places), "cell").select((F.col("first") + part).alias("shard"), "id", "v", "row").select("shard", number(blocks).alias("block"), "id", "v", "row")
    roads = places.select(F.col("cell").alias("to"), F.col("first"), F.col("shards"))
    flips = F.array(*(F.lit(int(m)) for m in masks(bits, routed)))
    visits = asked.select(F.struct("row", "id").alias("asked"), F.col("v").alias("q"), F.explode(F.concat(F.transform(flips, lambda m: F.col("cell").bitwiseXOR(m)), F.array(F.lit(1 << bits)) if bits else F.array().cast("array<int>"))).alias("to")).join(F.broadcast(roads), "to")
    sent = visits.select("asked", "q", F.explode(F.expr("sequence(first, first + shards - 1)")).alias("shard"), F.pmod(F.xxhash64("asked", F.lit(2)), F.lit(blocks)).cast("int").alias("block"))

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64())), "retrieved": pa.array([], pa.int64())})
        index = Index(np.array(left["id"]), matrix(left["v"], left.num_rows), coder.value, np.array(left["row"]))
        asked = right["asked"].combine_chunks()
        numbers, ids = np.array(asked.field("row")), np.array(asked.field("id"))
        i, found, scores, retrieved = zip(*index.search(numbers, matrix(right["q"], len(ids)), k), strict=True)
        return pa.table({"query": pa.array(numbers[list(i)]), "query_id": pa.array(ids[list(i)]), "ids": pa.array(found, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64())), "retrieved": pa.array(retrieved, pa.int64())})

    lists = placed.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(run, "query long, query_id long, ids array<long>, scores array<double>, retrieved long")
    pair = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("i")))
    merged = lists.groupBy("query", "query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pair))), 1, k).alias("best"), F.sum("retrieved").alias("retrieved"))
    return merged.select("query_id", F.posexplode("best").alias("pos", "b"), "retrieved").select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"), "retrieved")


def op2_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20, among all."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, 20).drop("retrieved")
