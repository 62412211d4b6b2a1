"""Toxicity (operator 6): a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents, reads homoglyphs and digit substitutions as the letters
they stand for, and turns all else into single spaces. Entries are beginnings of words; their
weights, and the phrases in which an entry does not count, are learned from labelled rows.
The weights found, normalised by the length of the text, give the score.

Edge cases: a null or empty text has no match and scores as matchless texts do; without
labelled rows the lexicon is empty and every score is the smoothed share of label 1; copies of a
text with the same label count once, labels without a document not at all; a null id is not held
out; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_chunks
from .gam import fold as fold_of

#: Labelled rows that the fit sees at most, those of the smallest id hashes.
MAX_LABELLED = 30_000
#: Toxic texts that an entry must stand in, however many there are; rarer stems are chance.
SUPPORT = 4
#: The logarithm of how much likelier an entry is in toxic texts, at least.
TOLD = 2.0
#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
#: l and 1 both read as i, in texts and in entries.
LOOKALIKES = dict(zip("аеорсухіјѕԁһկոսցαεικνορτυχωеВАЕКМНОРСТХ", "aeopcyxijsdhynugaeiknoptuxweBAEKMHOPCTX", strict=False)) | {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i", "ß": "ss", "ı": "i"}


class Folder(dict):
    """A str.translate table that works out each character when it is first met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if c not in LOOKALIKES:
            c = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        c = "".join(LOOKALIKES.get(x, x) for x in c).lower().replace("l", "i")
        out = self[point] = "".join(x if "a" <= x <= "z" else " " for x in c)
        return out


_FOLDER = Folder()
_GAPS = re.compile(" {2,}")


def folded(text: str | None) -> str:
    """Lower-case words of a to z with a space before and after each."""
    return _GAPS.sub(" ", f" {(text or '').translate(_FOLDER)} ")


def stems(word: str) -> list[str]:
    return [word[:k] for k in range(4, min(len(word), 10) + 1)] + ([word + " "] if len(word) > 2 else [])


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)
    _automaton: object = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"} | {"_automaton": None}

    def automaton(self):
        if self._automaton is None and self.weights:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for e in self.weights:
                self._automaton.add_word(" " + e, (True, " " + e))
            for e in self.exceptions:
                self._automaton.add_word(e, (False, e))
            self._automaton.make_automaton()
        return self._automaton

    def matches(self, text: str) -> list[tuple[int, str]]:
        """(place, entry) in a folded text: the longest entry at each place, unless an exception phrase covers it."""
        found: dict[int, str] = {}
        spared: list[tuple[int, int]] = []
        for end, (entry, what) in self.automaton().iter(text) if self.weights else ():
            start = end + 1 - len(what)
            if not entry:
                spared.append((start, end))
            elif len(what) > len(found.get(start, "")):
                found[start] = what
        if not spared:
            return [(s, w[1:]) for s, w in found.items()]
        spared.sort()
        starts = [a for a, _ in spared]
        reach = list(accumulate((b for _, b in spared), max))  # how far phrases reach that begin at or before a start
        covered = lambda s, end: (k := bisect_right(starts, s)) and end <= reach[k - 1]
        return [(s, w[1:]) for s, w in found.items() if not covered(s, s + len(w) - 2)]

    def measures(self, text: str | None) -> tuple[float, float]:
        t = folded(text)
        weight = sum(self.weights[e] for _, e in self.matches(t))
        return math.log1p(weight), math.log1p(100 * weight / (t.count(" ") + 20))

    def score(self, text: str | None) -> float:
        a, b = self.measures(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slopes[0] * a + self.slopes[1] * b))))


def label_counts(rows: DataFrame, pieces) -> DataFrame:
    """(piece, toxic, clean): in how many labelled texts of each label a piece of toxic texts occurs. A chunk counts all its pieces: which of them stand in a toxic text is known only of the whole."""

    def run(batches):
        for b, texts in in_chunks(batches, "text"):
            by = {0: Counter(), 1: Counter()}
            for t, y in zip(texts, b["y"].to_pylist(), strict=True):
                by[y].update(pieces(folded(t)))
            keys = list(by[1].keys() | by[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([by[1][k] for k in keys], pa.int64()), pa.array([by[0][k] for k in keys], pa.int64())], ["piece", "toxic", "clean"])

    return rows.mapInArrow(run, "piece string, toxic long, clean long").groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0")


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Lexicon:
    """Fits on at most `most` labelled rows. The driver gets the counts of all stems that pass, so many as these rows hold, and three numbers a row."""
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    rows = Scratch(docs.sparkSession).table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y").dropDuplicates(["text", "y"]), "labelled")  # copies of a text would vouch for all its words
    if rows.count() > most:  # many texts of one id: those of the smallest hashes
        rows = rows.withColumn("h", F.xxhash64("text"))
        last = rows.select("h", "y").orderBy("h", "y").limit(most).agg(F.max(F.struct("h", "y")).alias("m")).first()["m"]
        rows = rows.where((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("y") <= last["y"])).drop("h")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    lexicon = Lexicon(bias=math.log((bad + 0.5) / (good + 0.5)))
    if not bad or not good:
        return lexicon

    surprise = (F.col("toxic") / bad) / ((F.col("clean") + 0.5) / good)
    stem_counts = label_counts(rows, lambda t: {s for w in set(t.split()) for s in stems(w)})
    top = stem_counts.where((F.col("toxic") >= SUPPORT) & (surprise >= 3)).orderBy(F.desc(F.col("toxic") * F.log(surprise)), "piece").collect()
    # The stem worth most comes first; longer and shorter ones of the same word add nothing to it,
    # but longer ones stay beside one that may yet go for telling too little.
    sure, begun = set(), set()
    for r in top:
        s = r["piece"]
        starts = [s[:k] for k in range(3, len(s))]
        if s in begun or any(e in sure for e in starts):
            continue
        lexicon.weights[s] = math.log((r["toxic"] + 0.5) / bad / ((r["clean"] + 0.5) / good))
        begun.update(starts)
        if lexicon.weights[s] >= TOLD:
            sure.add(s)

    def phrases(t: str) -> set[str]:
        out = set()
        for at, entry in lexicon.matches(t):
            end = t.index(" ", at + 1)
            before, after = t.rfind(" ", 0, at), t.find(" ", end + 1)
            if before >= 0:
                out.add(t[before : at + len(entry) + 1])
            if after >= 0:
                out.add(t[at : after + 1])
        return out

    swapped = rows.select("text", (1 - F.col("y")).alias("y"))  # here phrases of clean texts are sought
    spared = label_counts(swapped, phrases).where((F.col("toxic") >= 3) & (F.col("toxic") / good >= 8 * (F.col("clean") + 0.5) / bad)).orderBy(F.desc("toxic"), "piece").collect()
    lexicon.exceptions = [r["piece"] for r in spared]
    lexicon._automaton = None

    # What an entry tells where no exception spares it; entries that tell little go.
    hits = label_counts(rows, lambda t: {e for _, e in lexicon.matches(t)}).collect()
    told = {r["piece"]: math.log((r["toxic"] + 0.5) / bad / ((r["clean"] + 0.5) / good)) for r in hits if r["toxic"] >= SUPPORT}
    lexicon.weights = {e: told[e] for e in lexicon.weights if told.get(e, 0.0) >= TOLD}
    lexicon._automaton = None

    def measure(batches):
        for b, texts in in_chunks(batches, "text"):
            m = [lexicon.measures(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in m]), pa.array([x[1] for x in m]), b["y"].cast(pa.int64())], ["a", "b", "y"])

    seen = rows.mapInArrow(measure, "a double, b double, y long").groupBy("a", "b", "y").count().toArrow()
    a, b, y, n = (np.array(seen[c], dtype=float) for c in ("a", "b", "y", "count"))
    lexicon.bias, *slopes = logistic(np.column_stack([np.ones(len(a)), a, b]), y, n)
    lexicon.slopes = (slopes[0], slopes[1])
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Weighted logistic regression by Newton steps; slopes stay at or above 0, so that more weight never scores lower."""
    order = np.lexsort((*x.T, y))
    x, y, n = x[order], y[order], n[order]
    free = np.ones(x.shape[1], bool)
    while True:
        w, keep = np.zeros(x.shape[1]), np.diag(ridge * (np.arange(x.shape[1]) > 0))[np.ix_(free, free)]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = (x.T @ (n * (y - p)))[free] - keep @ w[free]
            h = (x.T * (n * np.maximum(p * (1 - p), 1e-9))) @ x
            step = np.linalg.solve(h[np.ix_(free, free)] + keep + 1e-9 * np.eye(free.sum()), g)
            w[free] += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            return [float(v) for v in w]
        free[1:] &= w[1:] > 0


def scored(docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for b, texts in in_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([lexicon.score(t) for t in texts], pa.float64())], ["id", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op6_toxicity_lexicon(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a lexicon fitted on the labelled ones outside fold 1 of 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of(F.col("doc_id"), 3) != 1)
    out = scored(docs, learn(docs, labels))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold_of(F.col("id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
