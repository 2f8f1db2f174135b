"""Removal of documents that contain benchmark items.

A document is compared with an item through windows as long as the item. Windows get a SimHash
fingerprint of their weighted five-word shingles; fingerprints are cut into blocks, and an index
of all block values within a block's share of the radius finds every item within the radius.
Candidates are verified by exact weighted Jaccard similarity. Windows whose shingles in common
with items of their size can't reach the threshold are never fingerprinted: that bound is exact.

The benchmark goes to the tasks in blocks of bounded size, one pass over the documents each;
documents are never shuffled. Weights are those of the whole benchmark: each block is sent the
shingles of several items, and all others weigh the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import _text

_U = np.uint64

#: Bits of the fingerprint's blocks, and the radius that the index guarantees.
BLOCK_BITS = (13, 13, 13, 13, 12)
RADIUS = 20
#: Items and characters of a benchmark block that is sent to the tasks.
ITEMS, CHARS = 5_000, 16_000_000


def tokens(texts: pa.Array) -> tuple[_text.Words, np.ndarray, np.ndarray]:
    """Words for matching: lower case, split at everything in ASCII but letters and digits."""
    raw, bounds = _text.texts(pc.utf8_lower(texts))
    return _text.words(raw, bounds, _text.PUNCTUATION), raw, bounds


def simhash(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of windows: grams (windows x shingles) and their weights."""
    out = np.zeros(len(grams), _U)
    for bit in range(64):
        up = ((grams >> _U(bit)) & _U(1)).astype(np.float64) * 2 - 1
        out |= ((up * weights).sum(1) > 0).astype(_U) << _U(bit)
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class HammingIndex:
    """Fingerprints within RADIUS of a query, through tables of block values."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        share, shift = RADIUS // len(BLOCK_BITS), 0
        for bits in BLOCK_BITS:
            own = (prints >> _U(shift)) & _U((1 << bits) - 1)
            values = np.arange(1 << bits, dtype=np.uint16)
            near = _popcount(values[:, None] ^ own.astype(np.uint16)[None, :]) <= share
            value, item = np.nonzero(near)
            self.tables.append((shift, bits, np.searchsorted(value, np.arange((1 << bits) + 1)), item))
            shift += bits

    def query(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs within the radius, each once."""
        found = []
        for shift, bits, edge, item in self.tables:
            v = ((prints >> _U(shift)) & _U((1 << bits) - 1)).astype(np.int64)
            n = edge[v + 1] - edge[v]
            q = np.repeat(np.arange(len(prints)), n)
            i = item[np.repeat(edge[v] - (np.cumsum(n) - n), n) + np.arange(len(q))]
            ok = _popcount(prints[q] ^ self.prints[i]) <= RADIUS
            found.append(q[ok] * len(self.prints) + i[ok])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


#: Number of a benchmark's items; shingles of several items, sorted, and the number of items of each.
Whole = tuple[int, np.ndarray, np.ndarray]


@dataclass
class SizeClass:
    """Items of one number of words."""

    words: int
    ids: np.ndarray
    grams: np.ndarray  # items x shingles
    weights: np.ndarray
    index: HammingIndex
    known: np.ndarray  # all shingles, sorted, and their weights
    known_weights: np.ndarray
    least: float  # weight of the lightest item


class Benchmark:
    """A block of items, ready to be looked up."""

    def __init__(self, ids: list[int], texts: list[str], n: int = 5, whole: Whole | None = None):
        """whole: of the benchmark that the block is a part of; None if the block is all of it."""
        self.n = n
        w, _, _ = tokens(pa.array(texts, pa.string()))
        grams, offsets = _text.shingles(w, n)
        sets = [grams[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.every, items = np.unique(np.concatenate([np.unique(s) for s in sets]) if sets else np.zeros(0, _U), return_counts=True)
        total, common, items = whole or (len(sets), self.every[items > 1], items[items > 1])
        #: A shingle's weight falls with the number of items that have it; those of one item weigh as much as unknown ones, most.
        self.common, self.rarity = common, np.log1p(total / items)
        self.unknown = float(np.log1p(total))
        self.classes: list[SizeClass] = []
        sizes = w.counts
        for m in np.unique(sizes[sizes > 0]):
            own = np.flatnonzero(sizes == m)
            g = np.stack([sets[i] for i in own])
            weights = self.weigh(g)
            known = np.unique(g)
            self.classes.append(SizeClass(int(m), np.array(ids)[own], g, weights, HammingIndex(simhash(g, weights)), known, self.weigh(known), float(weights.sum(1).min())))

    def weigh(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.common, grams), max(0, len(self.common) - 1))
        return np.where(self.common[at] == grams, self.rarity[at], self.unknown) if len(self.common) else np.full(grams.shape, self.unknown)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles; equal shingles weigh the same."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    weight = dict(zip(a.tolist(), wa.tolist(), strict=True))
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = sum(weight[g] * min(p, q) for g, p, q in zip(both.tolist(), nx[i].tolist(), ny[j].tolist(), strict=True))
    return shared / (float(wa.sum()) + float(wb.sum()) - shared)


def matches(texts: pa.Array, bench: Benchmark, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(row, item, first word, words, similarity): the best window of each row for each item found."""
    w, _, _ = tokens(texts)
    n = bench.n
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    every = _text.windows(w.hashes, n)
    ends = np.repeat(w.first[1:], w.counts)
    hit_any = np.isin(every, bench.every, kind="sort") & (np.arange(len(every)) + n <= ends[: len(every)]) if len(every) else np.zeros(0, bool)
    of = np.repeat(np.arange(len(texts)), w.counts)
    rows = np.unique(of[np.flatnonzero(hit_any)])
    if any(c.words < n for c in bench.classes):
        rows = np.arange(len(texts))  # items of few words have shingles of another length
    for row in rows.tolist():
        a, b = int(w.first[row]), int(w.first[row + 1])
        own = w.hashes[a:b]
        for c in bench.classes:
            m = c.words
            k = min(n, m)
            if b - a < k:
                continue
            grams = _text.windows(own, k)
            per = m - k + 1
            at = np.minimum(np.searchsorted(c.known, grams), len(c.known) - 1)
            gain = np.where(c.known[at] == grams, c.known_weights[at], 0.0)
            if not gain.any():
                continue
            per = min(per, len(grams))
            total = np.concatenate([[0.0], np.cumsum(gain)])
            starts = np.flatnonzero(total[per:] - total[:-per] >= threshold * c.least - 1e-9)
            if not len(starts):
                continue
            for at in range(0, len(starts), 20_000):
                some = starts[at : at + 20_000]
                g = grams[some[:, None] + np.arange(per)[None, :]]
                weights = bench.weigh(g)
                for q, i in zip(*c.index.query(simhash(g, weights)), strict=True):
                    s = similarity(g[q], weights[q], c.grams[i], c.weights[i])
                    if s >= threshold - 1e-9:
                        key = (row, int(c.ids[i]))
                        if key not in out or (s, -out[key][1]) > (out[key][0], -int(some[q])):
                            out[key] = (s, int(some[q]), min(m, b - a))
    return [(row, item, start, size, s) for (row, item), (s, start, size) in out.items()]


def shared_shingles(items: DataFrame, n: int = 5) -> DataFrame:
    """(gram, items) of shingles that several rows of items (t) have."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for rows, _, _ in _text.batches(batch, "t"):
                grams, offsets = _text.shingles(tokens(rows.column(0))[0], n)
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(_text.signed(np.unique(grams[a:b])))], names=["gram"])

    return items.select("t").mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("items")).filter("items > 1")


def blocks(benchmark: DataFrame, *, key: str = "item_id", text: str = "text") -> Iterator[tuple[list[int], list[str], Whole | None]]:
    """The benchmark's items with a key and a text, in blocks of bounded size, and what holds for all blocks."""
    items = benchmark.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    count = max(1, -(-n // ITEMS), -(-chars // CHARS))
    whole = None
    if count > 1:
        shared = shared_shingles(items).toArrow()
        grams = shared["gram"].to_numpy().astype(np.int64).view(_U)
        order = np.argsort(grams)
        whole = (n, grams[order], shared["items"].to_numpy()[order])
    for b in range(count):
        rows = items.filter(F.pmod(F.xxhash64("i"), F.lit(count)) == b).collect()
        rows.sort()
        yield [r["i"] for r in rows], [r["t"] for r in rows], whole


def find_items(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """(key, item_id, start, n_words, similarity): each item found in each row, with its best window.

    start counts words (lower-case runs of ASCII letters, digits and non-ASCII characters) from 0.
    A row shorter than an item is one window. An item of fewer than five words is one shingle.
    Null or empty texts and items match nothing; items with a null id are left out, equal ones
    count once; a null key stays null; repeated rows match each; ties take the first window. An empty table
    on either side gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("__key"), docs[text].alias("__text"))
    found = None
    for ids, texts, whole in blocks(benchmark):

        def run(stream: Iterable[pa.RecordBatch], ids=ids, texts=texts, whole=whole) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(ids, texts, whole=whole)
            for batch in stream:
                for rows, _, _ in _text.batches(batch, "__text"):
                    hits = matches(pc.fill_null(rows.column(1), ""), bench, threshold)
                    row, item, start, size, sim = zip(*hits, strict=True) if hits else ((),) * 5
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(sim, pa.float64())],
                        names=[key, "item_id", "start", "n_words", "similarity"],
                    )

        part = source.mapInArrow(run, f"`{key}` {kind}, item_id long, start long, n_words long, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of docs in which find_items() finds no item, unchanged.

    Rows are judged each by their own text; nulls, empty texts and repeated rows as in find_items().
    """
    names = docs.columns
    for ids, texts, whole in blocks(benchmark):

        def run(stream: Iterable[pa.RecordBatch], ids=ids, texts=texts, whole=whole) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(ids, texts, whole=whole)
            for batch in stream:
                for rows, _, _ in _text.batches(batch, text):
                    hit = {h[0] for h in matches(pc.fill_null(rows.column(names.index(text)), ""), bench, threshold)}
                    yield rows.filter(pa.array([i not in hit for i in range(len(rows))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
