"""Quality classifier (operator 9): a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn and adds a shallow tree on one binned feature at
a time, so what is learned is one lookup table a feature (Lou et al. 2012, 2013); the pairs
that still explain most of what is left get two-dimensional tables in the same way. A score is
a sum of table entries.

Edge cases: a null text counts as empty and has all features 0; without labelled rows, or with
one class only, the score is the smoothed share of that class; repeated label rows count each;
a null id is not held out; empty tables give no rows; columns beside the named ones play no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_chunks

#: Labelled rows that the fit sees at most, those of the smallest id hashes.
MAX_LABELLED = 20_000
FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digits", "marks", "symbols", "punctuation", "space", "newlines",
    "non_ascii", "distinct_words", "repeated_lines", "longest_word", "symbol_words", "short_words",
)
_CLASSES = [
    range(ord("A"), ord("Z") + 1), range(ord("0"), ord("9") + 1), b"!?", b"#*$%&|<>", b".,;:'\"()-", b" \t\n\x0b\x0c\r", b"\n", range(128, 256),
]
_OF = np.zeros((256, len(_CLASSES)))
for _j, _c in enumerate(_CLASSES):
    _OF[list(_c), _j] = 1


def text_features(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        if not words:
            continue
        n, m = len(raw), len(words)
        upper, digits, marks, symbols, stops, space, newlines, high = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _OF / n
        lines = [x for x in raw.split(b"\n") if x.strip()]
        lengths = np.fromiter(map(len, words), np.int64, m)
        ends = sum(1 for w in words if w[-1] in b"#*$%&|<>!")
        out[i] = (
            np.log1p(n), np.log1p(m), lengths.mean(), upper, digits, marks, symbols, stops, space, newlines,
            high, len(set(words)) / m, 1 - len(set(lines)) / len(lines), np.log1p(lengths.max()), ends / m, (lengths < 3).mean(),
        )
    return out


@dataclass
class Gam:
    base: float = 0.0
    borders: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_borders: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.borders[j], x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_borders[j], x[:, j], "right") for p in self.pairs for j in p}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def borders_of(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.empty(0)


def split_gain(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best cut of bins into two leaves: its gain, and the first bin to the right."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gains = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gains))
    return float(gains[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Newton steps of a tree over bins, as a table over bins."""
    gain, k = split_gain(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([shallow_tree(g[:k], h[:k], ridge, depth - 1), shallow_tree(g[k:], h[k:], ridge, depth - 1)])


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The cross cut of a two-dimensional histogram of the largest gain, and its table."""
    cg, ch = (np.cumsum(np.cumsum(np.pad(x, ((1, 0), (1, 0))), 0), 1) for x in (g, h))
    tg, th = cg[-1, -1], ch[-1, -1]
    parts = lambda c, t: (c, c[:, -1:] - c, c[-1:, :] - c, t - c[:, -1:] - c[-1:, :] + c)
    values = [(a**2 / (b + ridge), a / (b + ridge)) for a, b in zip(parts(cg, tg), parts(ch, th), strict=True)]
    total = sum(v[0] for v in values) - tg**2 / (th + ridge)
    total[0, :] = total[-1, :] = total[:, 0] = total[:, -1] = -1
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    table = np.empty_like(g)
    table[:i, :j], table[:i, j:], table[i:, :j], table[i:, j:] = (v[1][i, j] for v in values)
    return float(total[i, j]), table


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3, bins: int = 32, pairs: int = 6, coarse: int = 8, ridge: float = 5.0) -> Gam:
    n, good = len(y), float(y.sum())
    model = Gam(float(np.log((good + 0.5) / (n - good + 0.5))))
    if not n or good in (0.0, float(n)):
        return model
    d = x.shape[1]
    model.borders = [borders_of(x[:, j], bins) for j in range(d)]
    model.tables = [np.zeros(len(b) + 1) for b in model.borders]
    binned = [np.searchsorted(model.borders[j], x[:, j], "right") for j in range(d)]
    logit = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(binned[j], g, size), np.bincount(binned[j], h, size), ridge)
            model.tables[j] += step
            logit += step[binned[j]]

    model.pair_borders = [borders_of(x[:, j], coarse) for j in range(d)]
    rough = [np.searchsorted(model.pair_borders[j], x[:, j], "right") for j in range(d)]
    sizes = [len(b) + 1 for b in model.pair_borders]

    def histogram(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[a] * sizes[b] + rough[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    ranked = sorted(((quadrants(histogram(a, b, g), histogram(a, b, h), ridge)[0], a, b) for a in range(d) for b in range(a + 1, d) if min(sizes[a], sizes[b]) > 1), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(rounds // 2):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            _, table = quadrants(histogram(a, b, g), histogram(a, b, h), ridge)
            model.pair_tables[k] += rate * table
            logit += rate * table[rough[a], rough[b]]
    return model


def with_features(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, features): one vector a document, over its whole text."""

    def run(batches):
        for b, texts in in_chunks(batches, "text"):
            x = text_features(texts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b["id"], flat], ["id", "features"])

    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("features", T.ArrayType(T.DoubleType()))])
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def fold(id_column: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.encode(id_column.cast("string"), "UTF-8")), F.lit(folds))


def fit_quality(features: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> Gam:
    """Fits on labelled rows, at most `most` of them, chosen by the hash of the id and, where many rows have one id, of the features."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("id"), F.col(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    rows = features.join(F.broadcast(chosen), "id").select("id", "y", "features").orderBy(F.xxhash64("id"), "id", "y", F.xxhash64("features")).limit(most).toArrow()
    if not rows.num_rows:
        return Gam()
    x = np.array(rows["features"].combine_chunks().flatten()).reshape(rows.num_rows, -1)
    order = np.lexsort((*x.T, np.array(rows["y"]), np.array(rows["id"].cast("string").to_pylist())))
    return fit(x[order], np.array(rows["y"], dtype=float)[order])


def scored(features: DataFrame, model: Gam) -> DataFrame:
    """(id, score) by vectorised bin additions."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b["features"].flatten()).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(model.score(x))], ["id", "score"])

    schema = T.StructType([features.schema["id"], T.StructField("score", T.DoubleType())])
    return features.select("id", "features").mapInArrow(run, schema)


def op9_quality_gam(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents by a model fitted on the labelled ones outside fold 2 of 4."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)
    features = scratch.table(with_features(docs), "features")
    out = scored(features, fit_quality(features, labels))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep_by_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score at least `least`, with their columns as they were."""
    chosen = labels.where(F.col("quality").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MAX_LABELLED).select("doc_id").distinct()
    model = fit_quality(with_features(docs.join(F.broadcast(chosen), "doc_id", "left_semi")), labels)
    schema = docs.schema

    def run(batches):
        for b, texts in in_chunks(batches, "text"):
            good = model.score(text_features(texts)) >= least
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, schema)
