"""A quality classifier: histogram gradient-boosted trees over statistics of texts.

Statistics come from vectorised passes over the bytes of each Arrow batch. Trees are grown on
histograms of binned statistics and flattened into arrays of one complete tree each, which numpy
walks level by level for all rows at once. Training takes a bounded sample of labelled rows, a
parameter; scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import _text

#: Classes of bytes whose shares are statistics.
CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "symbol": [*b"#*$%&<>"],
    "bar": [*b"|"],
    "strong": [*b"!?"],
    "stop": [*b".,;:"],
    "other": [*b"'\"()-/@[]{}_=+~^`\\"],
    "space": [*b" \t\r\x0b\x0c"],
    "line": [*b"\n"],
    "wide": [*range(192, 256)],
}
NAMES = [
    "log_bytes", "log_words", *(f"share_{c}" for c in CLASSES), "word_bytes", "long_words", "one_byte_words", "distinct_words", "repeated_next", "repeated_pairs", "top_word",
    "line_words", "distinct_lines", "sign_ends",
]
_CODE = np.full(256, len(CLASSES), np.uint8)
for _i, _bytes in enumerate(CLASSES.values()):
    _CODE[_bytes] = _i
_LINES = np.zeros(256, bool)
_LINES[10] = True


def _distinct(values: np.ndarray, of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the count of the most frequent one, of each row."""
    if not len(values):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((values, of))
    v, o = values[order], of[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(v)))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, o[at], size)
    return np.bincount(o[at], minlength=rows).astype(float), most.astype(float)


def statistics(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of NAMES per text; an empty text has zeros."""
    rows = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    code = _CODE[raw]
    shares = np.zeros((rows, len(CLASSES)))
    full = np.flatnonzero(size)
    for i in range(len(CLASSES)):
        if len(full):
            shares[full, i] = np.add.reduceat(code == i, bounds[:-1][full], dtype=np.int64)
    w = _text.words(raw, bounds)
    n = w.counts.astype(float)
    some = np.maximum(n, 1)
    of = np.repeat(np.arange(rows), w.counts)
    length = (w.ends - w.starts).astype(float)
    per = lambda x: np.bincount(of, weights=x, minlength=rows) / some
    next_ = np.zeros(len(of), bool)
    next_[1:] = of[1:] == of[:-1]
    same = next_.copy()
    same[1:] &= w.hashes[1:] == w.hashes[:-1]
    distinct, top = _distinct(w.hashes, of, rows)
    pairs = _text.windows(w.hashes, 2)
    inner = next_[1:]
    distinct_pairs, _ = _distinct(pairs[inner], of[1:][inner], rows) if len(of) > 1 else (np.zeros(rows), None)
    lines = _text.words(raw, bounds, _LINES)
    n_lines = lines.counts.astype(float)
    distinct_lines, _ = _distinct(lines.hashes, np.repeat(np.arange(rows), lines.counts), rows)
    last = code[w.ends - 1] if len(of) else np.zeros(0, np.uint8)
    columns = [
        np.log1p(size), np.log1p(n), *(shares / np.maximum(size, 1)[:, None]).T, per(length), per(length > 12), per(length == 1), distinct / some, per(same), 1 - (distinct_pairs + 1) / some, top / some,
        n / np.maximum(n_lines, 1), np.where(n_lines > 0, distinct_lines / np.maximum(n_lines, 1), 1), per(np.isin(last, (3, 4, 5))),
    ]
    out = np.stack(columns, 1)
    out[size == 0] = 0
    return out.astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth, one row a tree: nodes in heap order."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # values above it go right; infinite where a node doesn't split
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > limit[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 1.0, least: float = 5.0) -> Trees:
    """Trees for the log loss; without rows, or with rows of one label only, a constant."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))), depth, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)  # bin b: above edge b - 1
    count, width = x.shape[1], bins
    margin = np.full(len(y), model.base)
    rows = np.arange(len(y))
    features, limits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.full(inner, bins)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            flat = (((node - first)[:, None] * count + np.arange(count)) * width + binned).ravel()
            shape = (n, count, width)
            hist_g = np.bincount(flat, np.repeat(g, count), n * count * width).reshape(shape)
            hist_h = np.bincount(flat, np.repeat(h, count), n * count * width).reshape(shape)
            left_g, left_h = hist_g.cumsum(2), hist_h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g**2 / (all_h + penalty)
            gain[(left_h < least) | (all_h - left_h < least)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            best = gain.reshape(n, -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                if gain.reshape(n, -1)[k, b] > 1e-6:
                    f, c = divmod(b, width)
                    feature[first + k], limit[first + k], cut[first + k] = f, edges[f][c], c
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + penalty)
        margin += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    model.feature, model.limit, model.leaf = np.stack(features), np.stack(limits), np.stack(values)
    return model


def fold(key: Column, folds: int = 3) -> Column:
    """crc32 of a key as text, modulo folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def _numbers(docs: DataFrame, key: str, text: str, extra: str | None = None) -> DataFrame:
    """(key, extra, x: array<float>) of each row."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in [key, *([extra] if extra else [])]}

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for rows, raw, bounds in _text.batches(batch, "__text"):
                x = statistics(raw, bounds)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], values], names=[*kinds, "x"])

    source = docs.select(*[docs[c] for c in kinds], docs[text].alias("__text"))
    return source.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", x array<float>")


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = 12_000, held_out: int = 1) -> Trees:
    """Trees fitted to at most sample labelled rows, those of the least key hashes.

    Rows whose fold() is held_out, and those with a null key or label, are never used; a key that
    is labelled twice counts once, with its least label; of rows that repeat a key the one of the
    least statistics counts. The sample and its bound don't
    depend on the size of docs.
    """
    known = labels.select(F.col(key), F.col(label).cast("int").alias("__y")).filter(F.col(key).isNotNull() & F.col("__y").isNotNull() & (fold(F.col(key)) != held_out))
    chosen = known.groupBy(key).agg(F.min("__y").alias("__y")).orderBy(F.xxhash64(key), key).limit(sample)
    # at most sample pairs of numbers: a bound that holds at any size of the tables
    used = docs.select(key, text).join(F.broadcast(chosen), key)
    one = _numbers(used, key, text, "__y").groupBy(key, "__y").agg(F.min("x").alias("x"))  # of rows that repeat a key
    rows = one.select(F.xxhash64(key).alias("o"), key, "__y", "x").collect()
    rows.sort(key=lambda r: (r["o"], r[key]))
    x = np.array([r["x"] for r in rows], np.float32).reshape(len(rows), len(NAMES))
    return train(x, np.array([r["__y"] for r in rows], np.int64))


def score(docs: DataFrame, model: Trees, *, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the probability of label 1, from the text alone. A null text scores as an empty one.

    Repeated rows score alike; a column named as the result is replaced; an empty table gives
    an empty result.
    """
    kept = docs.drop(to)
    names = kept.columns

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for rows, raw, bounds in _text.batches(batch, text):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.probability(statistics(raw, bounds)), pa.float64())], names=[*names, to])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{kinds}, `{to}` double")
