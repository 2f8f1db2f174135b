"""Similarity join of texts on word n-gram sets, by MinHash banding.

Texts with the same n-gram set are one class and go on as one representative with its number
of copies. Bands and rows of the signature are chosen for a target recall at the threshold.
Representatives meet on band hashes. A small bucket gives its pairs; members of large buckets
are joined into clusters first (components over buckets, linear in members), and each cluster
is compared in blocks, block against block, so that no pair is ever a row. Every candidate is
verified on full n-gram sets. Blocks report per text how many rows it links to, and of the
links only a spanning forest, which is all that classes need.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import _text
from rasterloom.llm._session import half, saved
from rasterloom.llm.components import components

_U = np.uint64

#: Members of a bucket that still gives pairs.
PAIRED = 8
#: Texts in a block of a cluster, and n-grams in it at most unless a single text has more.
BLOCK, BLOCK_GRAMS = 512, 400_000


def choose_bands(threshold: float, recall: float, most: int = 100) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall at the threshold with at most so many hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def band_hashes(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band hashes per text; texts without grams get zeros."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, bands), _U)
    if not len(full):
        return out
    seeds = np.random.default_rng(20240229).integers(1, 2**63, 2 * bands * rows, dtype=np.int64).astype(_U) | _U(1)
    at = offsets[:-1][full]
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(full), b + 1, _U)
            for r in range(rows):
                i = b * rows + r
                v = grams * seeds[2 * i]
                v ^= v >> _U(32)
                v *= seeds[2 * i + 1]
                h = _text.mix(h * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, at))
            out[full, b] = h
    return out


def _sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(row, key, same: a hash of the n-gram set, null without words; grams: its size; bands: array<long>) of docs (__row, __key, __text)."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part, raw, bounds in _text.batches(batch, "__text"):
                grams, offsets = _text.shingles(_text.words(raw, bounds), n)
                # the set: each gram once in its text
                of = np.repeat(np.arange(len(part)), np.diff(offsets))
                order = np.lexsort((grams, of))
                grams, of = grams[order], of[order]
                new = np.ones(len(grams), bool)
                new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
                grams, of = grams[new], of[new]
                offsets = np.searchsorted(of, np.arange(len(part) + 1))
                hashed = band_hashes(grams, offsets, bands, rows)
                size = np.diff(offsets)
                same = np.zeros(len(part), _U)
                with np.errstate(over="ignore"):
                    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_text.mix(grams ^ _U(0x5851F42D4C957F2D)), dtype=_U)])
                    same = _text.mix(sums[offsets[1:]] - sums[offsets[:-1]] + size.astype(_U))
                values = pa.array(_text.signed(hashed).ravel())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(_text.signed(same), mask=size == 0), pa.array(size), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * bands), values)],
                    names=["row", "key", "same", "grams", "bands"],
                )

    kind = docs.schema["__key"].dataType.simpleString()
    return docs.select("__row", "__key", "__text").mapInArrow(run, f"row long, key {kind}, same long, grams long, bands array<long>")


def gram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The n-gram set of each text, as sorted hashes."""
    raw, bounds = _text.texts(pa.array(texts, pa.string()))
    grams, offsets = _text.shingles(_text.words(raw, bounds), n)
    return [np.unique(grams[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verified(pairs: DataFrame, threshold: float, n: int) -> DataFrame:
    """pairs (a, b, text_a, text_b) whose n-gram sets are similar enough."""

    def run(stream: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in stream:
            for at in range(0, len(rows), 64):
                part = rows.iloc[at : at + 64]
                left, right = gram_sets(part["text_a"].tolist(), n), gram_sets(part["text_b"].tolist(), n)
                ok = [jaccard(x, y) >= threshold for x, y in zip(left, right, strict=True)]
                yield part.loc[ok, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def _block_links(ids: list[np.ndarray], sets: list[list[np.ndarray]], copies: list[np.ndarray], threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For one block, or two: per text of all of them, the copies it links to; forest edges (positions).

    Intersections come from products of 0/1 matrices over slices of the n-grams.
    """
    one = len(sets) == 1
    a, b = sets[0], sets[-1]
    sizes = [np.array([len(s) for s in x]) for x in (a, b)]
    grams = np.concatenate([*a, *([] if one else b)]) if a else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(a) + (0 if one else len(b))), [len(s) for s in [*a, *([] if one else b)]])
    names, code, n = np.unique(grams, return_inverse=True, return_counts=True)
    many = n[code] > 1  # a gram of one text is in no intersection
    rank = np.cumsum(n > 1) - 1
    code, owner = rank[code[many]], owner[many]
    inter = np.zeros((len(a), len(b)), np.float32)
    step = 8192
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        lo, hi = np.searchsorted(code, [at, at + step])
        m = np.zeros((len(a) + (0 if one else len(b)), step), np.float32)
        m[owner[lo:hi], code[lo:hi] - at] = 1
        inter += m[: len(a)] @ (m if one else m[len(a) :]).T
    union = sizes[0][:, None] + sizes[1][None, :] - inter
    linked = inter >= threshold * union - 1e-9
    if one:
        np.fill_diagonal(linked, False)
        count = linked @ copies[0]
        i, j = np.nonzero(np.triu(linked))
        place = (i, j)
    else:
        count = np.concatenate([linked @ copies[1], linked.T @ copies[0]])
        i, j = np.nonzero(linked)
        place = (i, j + len(a))
    parent = list(range(len(count)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for x, y in zip(place[0].tolist(), place[1].tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            forest.append((x, y))
    return count, forest


def _compared(blocks: DataFrame, threshold: float, n: int) -> DataFrame:
    """blocks (cluster, x, y, block, id, copies, __text), dealt by (cluster, x, y): (a, b, n).

    A row with b null: text a links to n rows in this pair of blocks. Other rows: forest edges.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "id"], ignore_index=True)
        parts = [g for _, g in rows.groupby("block", sort=True)]
        if len(parts) == 1 and rows["x"].iloc[0] != rows["y"].iloc[0]:
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("Int64")
        ids = [g["id"].to_numpy() for g in parts]
        count, forest = _block_links(ids, [gram_sets(g["__text"].tolist(), n) for g in parts], [g["copies"].to_numpy() for g in parts], threshold)
        every = np.concatenate(ids)
        out = pd.DataFrame({"a": every, "b": pd.array([None] * len(every), "Int64"), "n": count.astype(np.int64)})
        edges = pd.DataFrame({"a": every[[x for x, _ in forest]], "b": pd.array(every[[y for _, y in forest]], "Int64"), "n": 0})
        return pd.concat([out[out["n"] > 0], edges], ignore_index=True)

    return blocks.groupBy("cluster", "x", "y").applyInPandas(run, "a long, b long, n long")


def _keyed(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, Column]:
    """(__row, __key, __text) of the rows with a key, and __row, which is the same for rows of one key and one text."""
    row = F.xxhash64(docs[key], docs[text])
    return docs.select(row.alias("__row"), docs[key].alias("__key"), docs[text].alias("__text")).filter("__key IS NOT NULL"), row


def _classes(named: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Sketches of named (__row, __key, __text), one row each, and the kinds of n-gram sets that they have.

    kinds: (same, key: the least of its rows', row: one that has it, copies, root: a number for
    the class, links: how many rows of other kinds it is linked to).
    """
    bands, rows = choose_bands(threshold, recall)
    sketches = saved(_sketches(named, n, bands, rows))
    kinds = sketches.filter("same IS NOT NULL").groupBy(F.col("same").alias("id")).agg(F.min(F.struct("key", "row")).alias("one"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    kinds = saved(kinds.select("id", "one.key", "one.row", "copies", "grams", "bands"))

    # buckets with several kinds
    met = kinds.select("id", F.explode("bands").alias("band"))
    shared = met.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("least")).filter("size > 1")
    members = saved(met.select("*", half("band")).join(shared.select("*", half("band")), ["band", "half"]).drop("half"))
    clusters = components(members.filter(F.col("size") > PAIRED).select(F.col("id").alias("a"), F.col("least").alias("b")))
    clusters = saved(clusters.select("id", F.col("root").alias("cluster")))

    # pairs from small buckets, but for those inside one cluster
    small = members.filter(F.col("size") <= PAIRED).select("band", "id").join(clusters, "id", "left")
    small = small.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("id", "cluster"))).alias("m"))
    pair = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, PAIRED), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"), F.coalesce(x["cluster"] == y["cluster"], F.lit(False)).alias("known")))))
    pairs = small.select(F.explode(pair).alias("p")).select("p.*").filter("NOT known").select("a", "b").distinct()
    pairs = saved(pairs)
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(clusters.select("id")).distinct()
    wanted = kinds.select("id", F.col("row").alias("__row")).join(wanted, "id")
    # rows that repeat a key and a text are all found by their __row: one of them is enough
    texts = saved(named.select("__row", "__text").join(wanted, "__row").groupBy("id").agg(F.first("__text").alias("__text")))
    left = texts.select(F.col("id").alias("a"), F.col("__text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("__text").alias("text_b"))
    links = saved(_verified(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), threshold, n))

    # clusters in blocks of bounded size: block x against each block y >= x
    member = clusters.join(kinds.select("id", "copies", "grams"), "id")
    sized = member.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    member = member.select("*", half("cluster")).join(sized.select("*", half("cluster")), ["cluster", "half"])
    member = member.select("cluster", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "copies").join(texts, "id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = member.withColumn("o", other).select("cluster", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "id", "copies", "__text")
    compared = saved(_compared(dealt, threshold, n))

    root = components(links.unionByName(compared.filter("b IS NOT NULL").select("a", "b")))
    copies = kinds.select("id", "copies")
    weighed = links.join(copies.withColumnsRenamed({"id": "b", "copies": "n"}), "b").select("a", "n")
    weighed = weighed.unionByName(links.join(copies.withColumnsRenamed({"id": "a", "copies": "n"}), "a").select(F.col("b").alias("a"), "n"))
    weighed = weighed.unionByName(compared.filter("b IS NULL").select("a", "n")).groupBy("a").agg(F.sum("n").alias("n"))
    out = kinds.select("id", "key", "row", "copies").join(weighed.withColumnRenamed("a", "id"), "id", "left").join(root, "id", "left")
    return sketches, saved(out.select(F.col("id").alias("same"), "key", "row", "copies", F.coalesce("root", "id").alias("root"), F.coalesce("n", F.lit(0)).alias("links")))


def jaccard_join(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """Per row of docs: key, class_id, n_links, n_copies.

    Rows are linked when the Jaccard similarity of their n-word shingle sets is at least the
    threshold. class_id: the least key of all rows that links join, directly or not; n_links:
    to how many other rows this row is linked; n_copies: how many of these have the same shingle
    set. Words lie between \x20 and \x09-\x0D and are compared unchanged; a text of fewer than
    n words has one shingle, of all of them. A text that is null or without words is linked to
    nothing, and so is a row with a null key, whose class_id is null; rows that repeat a key
    are copies like others. Other columns don't matter. An empty table gives an empty result.
    recall: of the candidate search for pairs right at the threshold; it is higher above it. A
    key column that is named as a result is an error.
    """
    if key in ("class_id", "n_links", "n_copies"):
        raise ValueError(f"the key can't be called {key}: a result is")
    named, _ = _keyed(docs, text, key)
    sketches, kinds = _classes(named, threshold, n, recall)
    least = kinds.groupBy("root").agg(F.min("key").alias("class_id"))
    kinds = kinds.select("same", "root", "links", "copies", half("root")).join(least.select("*", half("root")), ["root", "half"]).select("same", "class_id", "links", "copies", half("same"))
    out = sketches.select("key", "same", half("same")).join(kinds, ["same", "half"], "left")
    zero = F.lit(0).cast("long")
    out = out.select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, zero).alias("n_links"), F.coalesce(F.col("copies") - 1, zero).alias("n_copies"))
    null = F.lit(None).cast(docs.schema[key].dataType)
    return out.unionByName(docs.filter(docs[key].isNull()).select(null.alias(key), null.alias("class_id"), zero.alias("n_links"), zero.alias("n_copies")))


def without_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """docs with one row of each class of jaccard_join(): that of the least key.

    Rows are judged by their own text, whatever their key: of rows with the least key but
    different texts in one class one stays, and of rows that repeat a key and a text one stays.
    Rows with a null key all stay, and texts without words are copies of nothing else.
    Columns named __row or __rest can't be kept. An empty table gives an empty result.
    """
    named, row = _keyed(docs, text, key)
    sketches, kinds = _classes(named, threshold, n, recall)
    first = kinds.groupBy("root").agg(F.min(F.struct("key", "row")).alias("first")).select("first.row")
    bare = sketches.filter("same IS NULL").select("row").distinct()
    stay = first.unionByName(bare).select(F.col("row").alias("__row"))
    every = docs.filter(docs[key].isNotNull()).select(row.alias("__row"), F.struct(*docs.columns).alias("__rest"))
    kept = every.join(stay, "__row").groupBy("__row").agg(F.first("__rest").alias("__rest")).select("__rest.*")
    return kept.unionByName(docs.filter(docs[key].isNull()))
