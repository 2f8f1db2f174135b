"""Removal of passages that occur more than once, by seed and extend.

Seeds: winnowing picks, in each run of `window` words, the k-gram with the least hash, so
every window has exactly one anchor, at the same place wherever the window's words occur.
Documents meet on anchors. Extension: an occurrence is extended both ways to all windows
that its anchor answers for. Occurrences with the same words all along are one context; a
context met twice is a repeat in full, and only anchors with several contexts need a
comparison window by window, between contexts and not between occurrences. Overlapping
repeated windows merge into maximal repeats, each at least `window` words long.

Nothing is grouped by occurrence: hot passages are counted with map-side sums, joins on
anchors have one row per anchor on one side, and no pair of occurrences is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import _text
from rasterloom.llm._session import half, saved

_U = np.uint64


def _row_ends(w: _text.Words, size: int) -> np.ndarray:
    """For each word of the batch, the first word after its row."""
    return np.repeat(w.first[1:], w.counts)[:size]


def _anchors(w: _text.Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, place and first and last window start of each anchor, by place in the batch."""
    n = len(w.hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return np.zeros(0, _U), none, none, none
    grams = _text.windows(w.hashes, k)
    span = window - k + 1
    starts = np.flatnonzero(np.arange(n - window + 1) + window <= _row_ends(w, n - window + 1))
    # of each window, the last place of the least gram: sparse-table minimum over (hash, -place)
    level, width = grams.copy(), 1
    place = np.arange(len(grams))
    while 2 * width <= span:
        left, right = slice(None, -width), slice(width, None)
        take = level[right] <= level[left]
        level, place = np.where(take, level[right], level[left]), np.where(take, place[right], place[left])
        width *= 2
    a, b = starts, starts + span - width
    least = np.where(level[b] <= level[a], place[b], place[a])
    if not len(starts):
        return np.zeros(0, _U), none, none, none
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return grams[least[first]], least[first], starts[first], starts[last]


def _context(w: _text.Words, place: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """A hash of all words of each anchor's windows, and of the anchor's place among them."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(w.hashes) + 1, _U)
        np.cumsum(w.hashes * _text.powers(_text._WORD_BASE, len(w.hashes))[:-1], out=total[1:])
        inverse = _text.powers(pow(_text._WORD_BASE, -1, 2**64), len(w.hashes))
        h = (total[last + window] - total[first]) * inverse[first]
        return _text.mix(h + (place - first).astype(_U) * _U(0x9FB21C651E98DF25) + (last - first).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def _occurrences(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(anchor, context, row, first, last): each anchor of each row, its windows' first and last start."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for rows, raw, bounds in _text.batches(batch, "__text"):
                w = _text.words(raw, bounds)
                anchor, place, first, last = _anchors(w, window, k)
                row = np.searchsorted(w.first, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_text.signed(anchor)), pa.array(_text.signed(_context(w, place, first, last, window))), rows.column(0).take(pa.array(row)), pa.array((first - w.first[row]).astype(np.int32)), pa.array((last - w.first[row]).astype(np.int32))],
                    names=["anchor", "context", "row", "first", "last"],
                )

    return docs.mapInArrow(run, "anchor long, context long, row long, first int, last int")


def _windows(texts: DataFrame, text: str, window: int) -> DataFrame:
    """texts (__row, d: a struct with the text; want: array of context, first, last, many) to (context, many, hashes: array<long>), the windows' own."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            told = pa.RecordBatch.from_arrays([batch.column(1).field(text), batch.column(2)], names=["text", "want"])
            for rows, raw, bounds in _text.batches(told, "text"):
                w = _text.words(raw, bounds)
                want = rows.column(1)
                of = np.repeat(np.arange(len(rows)), np.asarray(want.value_lengths()))
                flat = want.flatten()
                first = np.asarray(flat.field("first")).astype(np.int64)
                size = np.asarray(flat.field("last")).astype(np.int64) - first + 1
                edges = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(w.first[of] + first - edges[:-1], size) + np.arange(edges[-1])
                hashes = _text.windows(w.hashes, window)[at] if len(at) else np.zeros(0, _U)
                yield pa.RecordBatch.from_arrays(
                    [flat.field("context"), flat.field("many"), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(_text.signed(hashes)))],
                    names=["context", "many", "hashes"],
                )

    return texts.select("__row", "d", "want").mapInArrow(run, "context long, many boolean, hashes array<long>")


def repeats(docs: DataFrame, *, text: str, window: int = 35, k: int = 10) -> DataFrame:
    """docs: (__row long, equal only where texts are; d: a struct with the text). Result: (__row, starts: array<struct<first, last>>).

    Each struct is a run of starts of repeated windows, counted in words from 0. What is read of
    docs is dealt by __row as a whole, so a join of docs with the result deals the texts no second time.
    """
    every = _occurrences(docs.select(F.col("__row").alias("row"), F.col("d")[text].alias("__text")), window, k)
    shared = every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", half("anchor"))
    seeds = saved(every.select("*", half("anchor")).join(shared, ["anchor", "half"]).drop("half"))
    # the words of a context include its anchor's: contexts are told apart by their own hash
    several = seeds.groupBy("anchor").agg(F.min("context").alias("least"), F.max("context").alias("most")).filter("least < most").select("anchor", half("anchor"))
    contexts = seeds.groupBy("anchor", "context").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("row", "first", "last")])
    contexts = contexts.select("*", half("anchor")).join(several.withColumn("open", F.lit(True)), ["anchor", "half"], "left")
    contexts = saved(contexts.select("context", (F.col("n") > 1).alias("many"), "row", "first", "last", F.coalesce("open", F.lit(False)).alias("open")))
    # contexts met twice are repeats in full
    full = contexts.filter("many").select("context", F.array(F.struct(F.lit(0).alias("a"), F.lit(-1).alias("b"))).alias("runs"))
    # windows that several contexts of one anchor share
    want = contexts.filter("open").groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("context", "first", "last", "many")).alias("want"))
    seen = _windows(docs.select("__row", "d").join(want, "__row"), text, window)
    seen = seen.select("context", "many", F.posexplode("hashes").alias("nth", "hash"))
    twice = seen.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash", half("hash"))
    some = seen.filter("NOT many").select("context", "nth", "hash", half("hash")).join(twice, ["hash", "half"])
    some = some.groupBy("context").agg(F.transform(F.sort_array(F.collect_list("nth")), lambda i: F.struct(i.alias("a"), i.alias("b"))).alias("runs"))
    found = seeds.select("context", "row", "first", "last").join(full.unionByName(some), "context")
    runs = F.transform("runs", lambda r: F.struct((F.col("first") + r["a"]).alias("first"), F.when(r["b"] < 0, F.col("last")).otherwise(F.col("first") + r["b"]).alias("last")))
    return found.select(F.col("row").alias("__row"), F.explode(runs).alias("run")).groupBy("__row").agg(F.collect_list("run").alias("starts"))


def _cut(column: str, window: int, names: list[str]):
    """Takes the repeated windows out of each text."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            told = pa.RecordBatch.from_arrays([*batch.column(0).flatten(), batch.column(1)], names=[*names[:-3], "__starts"])
            for rows, raw, bounds in _text.batches(told, column):
                w = _text.words(raw, bounds)
                runs = rows.column(rows.num_columns - 1)
                marks = np.zeros(len(w.hashes) + 1, np.int64)
                flat = runs.flatten()
                of = np.repeat(np.arange(len(rows)), np.asarray(runs.value_lengths().fill_null(0)))
                base = w.first[of]
                np.add.at(marks, base + np.asarray(flat.field("first")), 1)
                np.add.at(marks, base + np.asarray(flat.field("last")) + window, -1)
                gone = np.cumsum(marks[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[w.first[1:]] - total[w.first[:-1]]
                texts = rows.column(names.index(column)).to_pylist()
                spans: list[list[dict]] = [[] for _ in texts]
                for i in np.flatnonzero(removed):
                    a, b = w.first[i], w.first[i + 1]
                    own = gone[a:b]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    spans[i] = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    texts[i] = b" ".join(compress(raw[bounds[i] : bounds[i + 1]].tobytes().split(), ~own)).decode()
                out = {**dict(zip(names[:-3], rows.columns[:-1], strict=True)), column: pa.array(texts, pa.string()), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return run


def dedup_substrings(docs: DataFrame, *, text: str = "text", window: int = 35, k: int = 10, key: str = "doc_id") -> DataFrame:
    """docs without the words that lie in a window of `window` words found anywhere else too.

    Words are what lies between \x20 and \x09-\x0D, compared unchanged. Windows are judged on
    the input: each copy of a passage goes, also of one that recurs inside a document. Adds
    n_words, n_removed and spans (word ranges taken out); a text that loses words becomes its
    other words joined by one space, any other text stays as it is. A null text has no words and
    stays null; texts under `window` words never change; an empty table gives an empty result.
    Repeated rows are copies of each other, so their windows go. Columns named as a result are
    replaced. The key, which may be null or repeat, only deals rows out: rows with the same key
    and the same text lose the same words, so no numbers for rows are needed.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed", "spans")]
    rows = docs.select(F.xxhash64(docs[key], docs[text]).alias("__row"), F.struct(*[docs[c] for c in kept]).alias("d"))
    found = repeats(rows, text=text, window=window, k=k)
    names = [*kept, "n_words", "n_removed", "spans"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    schema = f"{kinds}, n_words long, n_removed long, spans array<struct<start:int,end:int>>"
    return rows.join(found, "__row", "left").select("d", "starts").mapInArrow(_cut(text, window, names), schema)
