"""Best-fit packing (operator 7) by exact-complement hashing.

Only the counts of pieces by length decide which lengths share a sequence. Full pieces fill a
sequence alone; then pairs, triples and quadruples of lengths that fill one exactly are found
through the sums of one, two and three lengths and consumed as often as their counts allow; what is left
goes largest first into the open sequence with the least room that holds it, many equal
sequences at a time. The plan is a few thousand runs of ranks, whatever the number of pieces;
each piece finds its run by its rank among the pieces of its length.

Edge cases: a null or empty text is one piece of one token, id 0; a long text is cut into
pieces of the full length, the first one shorter; ties go by a hash of (id, piece), then by
id and piece; repeated rows are packed each; empty tables give no rows; columns beside the
named ones play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_chunks, ranked

#: Fixed value: the pre-token pattern of byte-level vocabularies of this kind, as published with GPT-2.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a blank or a line break has a neighbour that is white space too, or stands at an end.
_ODD = re.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]$")


def ranked_encoding(path: str):
    """The tokenizer file's vocabulary as byte ranks, if it is byte-level BPE with ids in merge order; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told.get("model", {}), told.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or told.get("normalizer"):
        return None
    # Byte-level vocabularies write bytes as characters: printable ones as themselves, the others, in order, from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in told.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [i for pair in model["merges"] if (i := model["vocab"].get("".join(pair.split(" ") if isinstance(pair, str) else pair))) is not None]
    if merged != sorted(merged):
        return None
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def ids_of(path: str) -> "Ids":
    """One cache a worker process, bounded by Ids.LIMIT."""
    return Ids(path)


class Ids(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, of the chunks between blanks.

    A blank or line break between two other characters ends a pre-token of this byte-level
    vocabulary's pattern, so the chunks' ids joined are the text's ids; any other white space,
    and any added token written in the text, sends the whole text to the tokenizer. The merges of Latin letters, digits and signs are
    done by the same vocabulary's ranks, which takes a fifth of the time; other scripts go to
    the tokenizer itself.
    """

    LIMIT = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = ranked_encoding(path)
        # The tokenizer finds these in the text before it splits it.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        out = self[chunk] = array("I", self.ranks.encode_ordinary(chunk)).tobytes() if self.ranks and max(chunk, default="") < "\u0250" else self.encode(chunk)
        return out

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text) or any(t in text for t in self.added):
            return self.encode(text)
        parts = text.replace("\n", " \n ").split(" ")
        # Every chunk but the first takes its blank along; a line break stands alone, and what follows it has none.
        if "\n" in text:
            out, bare = [], True
            for p in parts:
                if p == "\n":
                    out.append(p)
                    bare = True
                else:
                    out.append(p if bare else " " + p)
                    bare = False
            return b"".join(map(self.__getitem__, out))
        return b"".join(map(self.__getitem__, [parts[0], *(" " + p for p in parts[1:])]))


def pieces(docs: DataFrame, tokenizer_path: str, most: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and a closing 0, cut where longer than `most`."""

    def run(batches):
        ids = ids_of(tokenizer_path)
        for b, texts in in_chunks(batches, "text"):
            rows: list[tuple[int, ...]] = []
            for i, t in enumerate(texts):
                raw = ids.of(t) + b"\0\0\0\0"
                n = len(raw) // 4
                first = n % most or most
                start, end, piece = 0, min(first, n), 0
                while start < n:
                    rows.append((i, piece, start, end - start, zlib.crc32(raw[4 * start : 4 * end])))
                    start, end, piece = end, end + most, piece + 1
            at = np.array(rows, dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at[:, 0])), pa.array(at[:, 1], pa.int32()), *(pa.array(at[:, k]) for k in (2, 3, 4))], ["id", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def exact_groups(left: dict[int, int], most: int, largest: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Takes from `left` groups of two to `largest` lengths that fill `most` exactly: (lengths, how often)."""
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> bool:
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        often = min(left.get(x, 0) // k for x, k in need.items())
        if often > 0:
            plan.append((lengths, often))
            for x, k in need.items():
                left[x] -= k * often
        return often > 0

    # One length and its complement.
    for a in sorted(left, reverse=True):
        if 2 * a >= most and most - a in left:
            take((a, most - a))
    # A large length and the hashed sums of two, then of three lengths, that fill its gap. The rarer, larger lengths choose first.
    for members in range(2, largest):
        for a in sorted((x for x, n in left.items() if n > 0), reverse=True):
            gap = most - a
            small = [x for x, n in left.items() if n > 0 and x < gap]
            if not small or left[a] <= 0:
                continue
            small.sort(key=lambda x: (-left[x], x))
            if members == 2:
                there = set(small)
                for b in small:
                    if left[a] <= 0:
                        break
                    if gap - b in there and b <= gap - b:
                        take((a, gap - b, b))
                continue
            # All sums of two lengths that there are: those that leave a third one fill the gap.
            there = np.zeros(gap + 1, np.int64)
            there[small] = 1
            sums = np.convolve(there, there)[: gap + 1]
            for d in small:
                if left[a] <= 0:
                    break
                if left[d] <= 0 or not sums[gap - d]:
                    continue
                half = np.arange((gap - d) // 2 + 1)
                for b in half[(there[half] & there[gap - d - half]) > 0].tolist():
                    if take((a, d, gap - d - b, b)) and (left[a] <= 0 or left[d] <= 0):
                        break
    return plan


def best_fit(left: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Places what is left, largest lengths first, each into the open sequences of least room that hold it; equal sequences move together."""
    rooms: list[int] = []
    by_room: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, how often]

    def add(lengths: tuple[int, ...], often: int) -> None:
        room = most - sum(lengths)
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append([lengths, often])

    for a in sorted(left, reverse=True):
        n = left[a]
        while n > 0:
            i = bisect_left(rooms, a)
            if i == len(rooms):
                k = most // a
                if n >= k:
                    add((a,) * k, n // k)
                if n % k:
                    add((a,) * (n % k), 1)
                break
            room = rooms[i]
            group = by_room[room][-1]
            k = min(room // a, n)
            often = min(group[1], n // k)
            group[1] -= often
            if not group[1]:
                by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(i)
            add(group[0] + (a,) * k, often)
            n -= k * often
    return [(lengths, often) for groups in by_room.values() for lengths, often in groups]


def plan(counts: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Groups of lengths and how often each is made: of the plans with exact groups of up to four, three or two lengths, or none, the one of the fewest sequences.

    Groups of many short lengths can take those that long ones need, which only the whole plan shows.
    """
    whole = {k: v for k, v in sorted(counts.items()) if v > 0}
    full = [((most,), whole.pop(most))] if most in whole else []
    least = -(-sum(k * v for k, v in whole.items()) // most)
    best, fewest = [], None
    for largest in (4, 3, 2, 1):
        left = dict(whole)
        groups = exact_groups(left, most, largest) if largest > 1 else []
        groups += best_fit({k: v for k, v in left.items() if v > 0}, most)
        made = sum(often for _, often in groups)
        if fewest is None or made < fewest:
            best, fewest = groups, made
        if fewest == least:
            break
    return full + best


def runs_of(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: the first rank, first sequence and offset of each run; the ranks of a run go to sequences one after the other."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, often in groups:
        offset = 0
        for x in lengths:
            runs[x].append((used[x], sequence, offset))
            used[x] += often
            offset += x
        sequence += often
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def packed(spark, piece_table: DataFrame, most: int) -> DataFrame:
    """piece_table (with id, piece, length) and sequence_id, offset. The driver holds a count for each length, `most` at most."""
    counts = {r["length"]: r["count"] for r in piece_table.groupBy("length").count().collect()}
    runs = spark.sparkContext.broadcast(runs_of(plan(counts, most)))
    key = F.struct("id", "piece", "ids_crc32") if "ids_crc32" in piece_table.columns else F.struct("id", "piece")
    placed = ranked(piece_table, ["length"], [F.xxhash64("id", "piece"), F.col("id"), F.col("piece")], key, "rank").drop("rank_n")
    names = [f.name for f in piece_table.schema.fields]

    def run(batches):
        for b in batches:
            lengths, ranks = np.array(b["length"]), np.array(b["rank"])
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(part):
                    first, start, at = runs.value[int(lengths[part[0]])]
                    k = np.searchsorted(first, ranks[part], "right") - 1
                    sequence[part] = start[k] + ranks[part] - first[k]
                    offset[part] = at[k]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*piece_table.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return placed.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, most: int = 2048) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    table = Scratch(spark).table(pieces(docs, tokenizer_path, most), "pieces")
    return packed(spark, table, most).withColumnRenamed("id", "doc_id")


def op7_complement_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
