"""Image gates and deduplication."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import aspect
from ..scratch import Scratch, small_batches
from .dedup import first_of_each, first_wins_in_lists

#: What files begin with, and the extension they get.
MAGIC = (("89504E470D0A1A0A", "png"), ("FFD8FF", "jpg"), ("47494638", "gif"))


def extension(content: Column) -> Column:
    """By magic bytes: png, jpg, gif, webp; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("webp"))
    for magic, ext in MAGIC:
        out = out.when(head.startswith(magic), F.lit(ext))
    return out


def gate(content_bytes: Column, decoded: Column, ext: Column, width: Column, height: Column, fetched: Column | None = None, min_bytes: int = 2048, min_width: int = 100, min_height: int = 100, max_aspect: float = 10.0, allowed: tuple[str, ...] = ("jpeg", "jpg", "png", "webp", "gif")) -> Column:
    """The first gate that an image fails, null if none: one conditional expression, cheap tests first."""
    known = ext.isNotNull()
    if allowed:
        known = known & (ext.isin(*allowed) | (F.when(ext == "jpg", F.lit("jpeg")).otherwise(ext)).isin(*allowed))
    return (
        F.when(~(fetched if fetched is not None else content_bytes.isNotNull()), F.lit("fetch_failed"))
        .when(content_bytes < min_bytes, F.lit("too_few_bytes"))
        .when(~F.coalesce(decoded, F.lit(False)), F.lit("decode_error"))
        .when(~F.coalesce(known, F.lit(False)), F.lit("bad_type"))
        .when((width < min_width) | (height < min_height), F.lit("too_small"))
        .when(aspect(width, height) > max_aspect, F.lit("bad_aspect"))
    )


def perceptual_hash(pixels: np.ndarray) -> int:
    """64 bits of an image (height x width [x channels]): grey, 32 x 32, cosine transform, the lowest 8 x 8 against their median."""
    grey = pixels.astype(float)
    if grey.ndim == 3:
        grey = grey[:, :, :3] @ [0.114, 0.587, 0.299] if grey.shape[2] >= 3 else grey[:, :, 0]  # Spark's images are blue first
    small = _resample(_resample(grey, 32).T, 32).T
    k = np.arange(32)
    cosines = 2 * np.cos(np.pi * np.outer(k, 2 * k + 1) / 64)
    low = np.round((cosines @ small @ cosines.T)[:8, :8], 6)  # what rounding leaves of a flat image is nothing
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def _resample(a: np.ndarray, n: int) -> np.ndarray:
    """Rows averaged over n equal spans."""
    edges = np.linspace(0, len(a), n + 1)
    total = np.vstack([np.zeros(a.shape[1]), np.cumsum(a, axis=0)])
    whole = np.minimum(edges.astype(int), len(a))
    at = total[whole] + (edges - whole)[:, None] * a[np.minimum(whole, len(a) - 1)]
    return np.diff(at, axis=0) * n / len(a)


@F.pandas_udf(T.LongType())
def phash(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Of the columns of Spark's image source; null for what it could not decode."""

    def one(h, w, c, d):
        if d is None or not (h > 0 and w > 0):  # numbers are NaN beside nulls
            return None
        h, w, c = int(h), int(w), int(c)
        return perceptual_hash(np.frombuffer(d, np.uint8)[: h * w * c].reshape(h, w, c))

    return pd.Series([one(*x) for x in zip(height, width, channels, data, strict=True)], dtype="Int64")


#: Parts of a hash, at most: 924 keys a hash of within 6 bits.
MOST_PARTS = 12


def parts_for(n: int, most: int, meets: float = 1.0) -> int:
    """The fewest parts of 64 bits at which a random hash meets fewer than `meets` of n others; beyond what MOST_PARTS can do, those of the least keys and meetings together."""
    keys = {p: math.comb(p, most) for p in range(most + 1, max(MOST_PARTS, most + 1) + 1)}
    met = {p: k * n / 2.0 ** (64 * (p - most) / p) for p, k in keys.items()}
    few = [p for p in keys if met[p] < meets]
    return few[0] if few else min(keys, key=lambda p: keys[p] + met[p])


class HammingKeys:
    """Keys of 64-bit hashes, one of which any two hashes within `most` bits share.

    Of p parts of the bits, two such hashes agree on p - most at least. A key is the bits of p - most parts;
    there is one for each choice of them. More parts make keys longer and more: p follows the number of
    hashes, so that up to a million a hash meets less than one other by chance.
    """

    def __init__(self, n: int, most: int = 6, meets: float = 1.0):
        self.most, self.parts = most, parts_for(n, most, meets)
        edges = [64 * i // self.parts for i in range(self.parts + 1)]
        self.masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        self.choices = [*combinations(range(self.parts), self.parts - most)]

    @staticmethod
    def _longs(values: list[int]) -> Column:
        return F.array(*(F.lit(v - (1 << 64) if v >> 63 else v).cast("long") for v in values))

    def entries(self, hashes: DataFrame, bits: str = "bits") -> DataFrame:
        """hashes with choice and key, a row for each choice of parts."""
        masks = self._longs([sum(self.masks[i] for i in c) for c in self.choices])
        keys = F.transform(masks, lambda m: F.col(bits).bitwiseAND(m))
        return hashes.select(*hashes.columns, F.posexplode(keys).alias("choice", "key"))

    def first_met(self, a: Column, b: Column, choice: Column) -> Column:
        """True at the first of the choices in which two hashes agree: each pair is given once, however many keys it shares."""
        differ = a.bitwiseXOR(b)
        agreed = F.lit(0)
        for i, m in enumerate(self.masks):
            agreed = agreed + F.when(differ.bitwiseAND(self._longs([m])[0]) == 0, F.lit(1 << i)).otherwise(F.lit(0))
        chosen = F.array(*(F.lit(sum(1 << i for i in c)) for c in self.choices))
        upto = F.array(*(F.lit((2 << max(c)) - 1) for c in self.choices))
        return agreed.bitwiseAND(F.get(upto, choice)) == F.get(chosen, choice)


#: Hashes that a task deals into groups together, and pairs that it gives together. Neither changes a result.
DEALT, GIVEN = 1 << 20, 1 << 16
#: Bits of a part that tell groups apart, at most.
GROUP_BITS = 12


def _split(places: list[int], parts: int) -> list[int]:
    """Masks of so many parts of these bits."""
    return [sum(1 << b for b in places[len(places) * i // parts : len(places) * (i + 1) // parts]) for i in range(parts)]


def _choices(n: int, most: int, places: list[int]) -> np.ndarray:
    """Masks of bits, of which any two hashes within `most` bits agree on one: so many that n random hashes are sorted and compared in the least time."""
    parts = range(most + 1, max(MOST_PARTS, most + 1) + 1)
    p = min(parts, key=lambda p: math.comb(p, most) * (4 + n / 2.0 ** (len(places) * (p - most) / p)))
    masks = _split(places, p)
    return np.array([sum(masks[i] for i in c) for c in combinations(range(p), p - most)], np.uint64)


def _near(h: np.ndarray, most: int, choices: np.ndarray, apart: np.ndarray):
    """(x, y, distance) of different hashes h that agree on one of the choices, differ in `most` bits or fewer, and on each of the masks `apart`. Each pair is given once."""
    for c, mask in enumerate(choices):
        h = h[np.argsort(h & mask)]
        key = h & mask
        at, d = np.flatnonzero(key[1:] == key[:-1]), 1
        while len(at):  # pairs that lie d places apart
            for k in range(0, len(at), GIVEN):
                x, y = h[at[k : k + GIVEN]], h[at[k : k + GIVEN] + d]
                distance = np.bitwise_count(x ^ y)
                near = distance <= most
                x, y, distance = x[near], y[near], distance[near]
                differ, new = x ^ y, np.ones(len(x), bool)
                for other in (*apart, *choices[:c]):
                    new &= differ & other != 0
                if new.any():
                    yield x[new], y[new], distance[new]
            d += 1
            at = at[at + d < len(h)]
            at = at[key[at + d] == key[at]]


class HammingGroups:
    """Groups of 64-bit hashes, in one of which any two hashes within `most` bits meet: of most + 1 parts of the bits they agree on one at least.

    So a hash is moved for each part, not for each choice of parts that HammingKeys has; choices of the other
    bits are made inside a group, where they take no room.
    """

    def __init__(self, most: int):
        edges = [64 * i // (most + 1) for i in range(most + 2)]
        self.most = most
        self.parts = [(a, min(b - a, GROUP_BITS)) for a, b in zip(edges, edges[1:], strict=False)]

    def dealt(self, batches):
        """(group, held): hashes of (bits), each different one once in each of its groups, as bytes."""
        held, size = np.empty(DEALT, np.int64), 0

        def groups():
            h = np.unique(held[:size]).view(np.uint64)
            for i, (start, width) in enumerate(self.parts):
                value = (h >> np.uint64(start)) & np.uint64((1 << width) - 1)
                counts = np.bincount(value.astype(np.int64), minlength=1 << width)
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends]).astype(np.int32) * 8
                content = pa.Array.from_buffers(pa.binary(), 1 << width, [None, pa.py_buffer(offsets), pa.py_buffer(h[np.argsort(value, kind="stable")])])
                there = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array((i << GROUP_BITS) + there, pa.int32()), content.take(pa.array(there))], ["group", "held"])

        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            while len(h):
                part, h = h[: DEALT - size], h[DEALT - size :]
                held[size : size + len(part)] = part
                size += len(part)
                if size == DEALT:
                    yield from groups()
                    size = 0
        if size:
            yield from groups()

    def pairs(self, group: int, h: np.ndarray):
        """Batches (xb, yb, distance) of a group's pairs that have met in no group of an earlier part."""
        masks = [((1 << width) - 1) << start for start, width in self.parts]
        i = group >> GROUP_BITS
        places = [b for b in range(64) if not masks[i] >> b & 1]
        h = np.unique(h)
        told, size = [], 0
        for found in _near(h, self.most, _choices(len(h), self.most, places), np.array(masks[:i], np.uint64)) if len(h) > 1 and places else ():
            told.append(found)
            size += len(found[0])
            if size >= GIVEN:
                yield self._batch(told)
                told, size = [], 0
        if told:
            yield self._batch(told)

    @staticmethod
    def _batch(told: list) -> pa.RecordBatch:
        x, y, distance = (np.concatenate(t) for t in zip(*told, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(distance, pa.int32())], ["xb", "yb", "distance"])

    def met(self, batches):
        """pairs() of all groups of (group, held), whose rows come one group after the other."""
        group, held = None, []
        for b in batches:
            for g, h in zip(b.column(0).to_numpy(), b.column(1), strict=True):
                if g != group and held:
                    yield from self.pairs(int(group), np.concatenate(held))
                    held = []
                group = g
                held.append(np.frombuffer(h.as_py(), np.uint64))
        if held:
            yield from self.pairs(int(group), np.concatenate(held))


def hamming_pairs(hashes: DataFrame, most: int = 6) -> DataFrame:
    """(a, b, distance) with a < b of (id, bits) that differ in `most` bits or fewer. Hashes are compared, whoever has them, and then named."""
    groups = HammingGroups(most)
    with small_batches(hashes.sparkSession):
        dealt = hashes.where(F.col("bits").isNotNull()).select("bits").mapInArrow(groups.dealt, "group int, held binary")
        # Compared as one table: each join below would compare them again.
        pairs = Scratch(hashes.sparkSession).table(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(groups.met, "xb long, yb long, distance int"), "pairs")
    named = lambda i, b: hashes.select(F.col("id").alias(i), F.col("bits").alias(b))
    unlike = pairs.join(named("i", "xb").hint("merge"), "xb").join(named("j", "yb").hint("merge"), "yb").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")
    equal = named("a", "xb").join(named("b", "yb").hint("merge"), F.col("xb") == F.col("yb")).where("a < b").select("a", "b", F.lit(0).alias("distance"))
    return unlike.unionByName(equal)


def dedup_images(images: DataFrame, most: int = 6) -> DataFrame:
    """images (id, ord, sha, bits) that passed the gates, without those equal to a kept earlier one by content or within `most` bits of its hash. Those without a hash are compared by content."""
    scratch = Scratch(images.sparkSession)
    unique = first_of_each(images, F.col("sha"), F.col("ord"), F.col("id"))
    unhashed, unique = unique.where(F.col("bits").isNull()), first_of_each(unique.where(F.col("bits").isNotNull()), F.col("bits"), F.col("ord"), F.col("id"))
    # A hash names its image from here on, so that ids of any size are not copied for each key.
    nodes = scratch.table(unique.select(F.col("bits").alias("id"), F.struct("ord", F.col("id").alias("own")).alias("ord")), "nodes")
    keys = HammingKeys(nodes.count(), most)
    entries = keys.entries(nodes.select("id"), "id").select(F.xxhash64("choice", "key").alias("h"), "id")
    near = lambda a, b: F.bit_count(F.col(f"{a}.id").bitwiseXOR(F.col(f"{b}.id"))) <= most
    kept = first_wins_in_lists(nodes, entries, near)
    return unique.join(kept.withColumnRenamed("id", "bits"), "bits", "left_semi").select(*images.columns).unionByName(unhashed)
