"""Packing of tokenised documents into sequences of fixed length.

Documents become pieces of at most `length` tokens. Full pieces are sequences already.
The others are dealt at random over shards of bounded size, each packed by itself: best fit
in decreasing size, then a swap-based local search that moves documents, exchanges one for
one, or two for one between underfull sequences, always from a sequence to a fuller one, so
the sum of squared fills rises until sequences run empty. What the shards leave in their
poorly filled sequences meets again in a second round, in shards of the same size. Only sizes
and keys are shuffled, never token ids.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import _text
from rasterloom.llm._session import saved

#: Chunks between white space, and parts of chunks, whose ids a worker keeps: what comes first is frequent.
KNOWN, PARTS = 500_000, 150_000


class ChunkIds:
    """Ids of chunks between white space.

    Only for tokenizers that lower the case, never join text across white space and drop it.
    Each distinct chunk is made of words and signs; each distinct one of these is encoded once.
    Chunks are known by 64-bit hashes; their ids lie one after another in a pool.
    """

    #: Chunks that Python lowers and splits just as the tokenizer does; others are encoded whole.
    _PLAIN = re.compile("[!-~\xa1-\xac\xae-\u012f\u0131-\u024f]+")
    _PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = ["Ab", "ab", "a b", "a", "b", " \n\ta\x0b\x0c\r"]
        upper, lower, both, a, b, spaced = (e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False))
        if upper != lower or both != [*a, *b] or spaced != a:
            raise ValueError(f"{path}: not a tokenizer that lowers the case and drops white space")
        # hashes of known chunks, sorted, each with its place in edges; edges of its ids in the pool
        self.known, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.edges, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, as unsigned 32-bit."""
        fullmatch = self._PLAIN.fullmatch
        out: list[bytes] = [b""] * len(chunks)
        whole = [i for i, c in enumerate(chunks) if not fullmatch(c) or "<|" in c]
        for i, ids in zip(whole, self.encode([chunks[i] for i in whole]), strict=True):
            out[i] = ids
        apart = set(whole)
        find = self._PARTS.findall
        plain = [(i, find(c.lower())) for i, c in enumerate(chunks) if i not in apart]
        new = list({x for _, p in plain for x in p} - self.parts.keys())
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            word = np.array(e.word_ids, np.int64)
            edges = np.searchsorted(word, np.arange(len(some) + 1))
            if len(word) and word[-1] == len(some) - 1 and (np.diff(edges) > 0).all():
                raw, edges = array("I", e.ids).tobytes(), (edges * 4).tolist()
                self.parts.update((w, raw[a:b]) for w, a, b in zip(some, edges, edges[1:], strict=False))
            else:  # a part that the tokenizer splits again
                self.parts.update(zip(some, self.encode(some), strict=True))
        get = self.parts.__getitem__
        for i, p in plain:
            out[i] = get(p[0]) if len(p) == 1 else b"".join(map(get, p))
        if len(self.parts) > PARTS:
            for k in new:
                del self.parts[k]
        return out

    def ids(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after another, and where each text's begin and the last one's end."""
        w = _text.words(raw, bounds)
        distinct, at, of = np.unique(w.hashes, return_index=True, return_inverse=True)
        had, edges, pool = len(self.known), self.edges, self.pool
        near = np.searchsorted(self.known, distinct)
        here = np.minimum(near, max(0, had - 1))
        missing = np.flatnonzero(self.known[here] != distinct) if had else np.arange(len(distinct))
        place = self.places[here].astype(np.int64) if had else np.zeros(len(distinct), np.int64)
        if len(missing):
            whole = raw.tobytes()
            new = self.learn([whole[a:b].decode() for a, b in zip(w.starts[at[missing]].tolist(), w.ends[at[missing]].tolist(), strict=True)])
            place[missing] = had + np.arange(len(missing))
            edges = np.concatenate([edges, edges[-1] + np.cumsum([len(x) // 4 for x in new])])
            pool = np.concatenate([pool, np.frombuffer(b"".join(new), np.uint32)])
            if had + len(missing) <= KNOWN:
                self.known = np.insert(self.known, near[missing], distinct[missing])
                self.places = np.insert(self.places, near[missing], place[missing].astype(np.int32))
                self.edges, self.pool = edges, pool
        place = place[of]
        size = edges[place + 1] - edges[place]
        total = np.concatenate([[0], np.cumsum(size)])
        return pool[np.repeat(edges[place] - total[:-1], size) + np.arange(total[-1])], total[w.first]


_tokenizers: dict[str, ChunkIds] = {}


def tokenizer_for(path: str) -> ChunkIds:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = ChunkIds(path)
    return _tokenizers[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", length: int = 4096, end: int = 1) -> DataFrame:
    """(key, piece, start, length, ids) per piece; ids: little-endian unsigned 32-bit.

    A null or empty text is the end token alone. Texts longer than a sequence are cut into
    full pieces and a rest; a very long one costs memory for its bytes and ids once. Other
    columns are dropped; null keys and repeated rows are kept. The tokenizer must be one of
    those that ChunkIds is for, else a ValueError tells.
    """
    source = docs.select(docs[key].alias("__key"), docs[text].alias("__text"))

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokenizer_for(tokenizer)
        for batch in stream:
            for rows, raw, bounds in _text.batches(batch, "__text", 1_000_000):
                ids, edges = of.ids(raw, bounds)
                ids = np.insert(ids, edges[1:], np.uint32(end)).astype("<u4")  # the end token after each text
                size = np.diff(edges) + 1
                cut = -(-size // length)
                row = np.repeat(np.arange(len(rows)), cut)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cut) - cut, cut)
                part = np.minimum(size[row] - piece * length, length)
                where = np.concatenate([[0], np.cumsum(part)]) * 4
                data = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * length, pa.int64()), pa.array(part, pa.int64()), data],
                    names=[key, "piece", "start", "length", "ids"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids binary")


def best_fit(sizes: np.ndarray, cap: int) -> list[list[int]]:
    """Bins of indexes: each size, the largest first, into the fullest bin that can take it."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(rooms, (s, -1))
        if at == len(rooms):
            room, b = cap, len(bins)
            bins.append([])
        else:
            room, b = rooms.pop(at)
        bins[b].append(i)
        if room > s:
            insort(rooms, (room - s, b))
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, cap: int) -> list[list[int]]:
    """Empties bins by moves and exchanges between underfull bins until none helps.

    Each step carries weight from a bin to one at least as full, so the sum of squared fills
    grows strictly and the search ends: at the bound ceil(total / cap), or when no underfull bin
    can take a step. Passes begin at the least filled bin; a bin that was stuck is tried again
    only with bins that have changed since.
    """
    bins = [list(b) for b in bins if b]
    least = -(-int(sizes.sum()) // cap)
    fills = np.array([int(sizes[b].sum()) for b in bins], np.int64)
    where = np.full(len(sizes), -1, np.int64)  # bin of each index
    for k, own in enumerate(bins):
        where[own] = k
    left, now, moved = len(bins), 0, True
    changed, tried = np.zeros(len(bins), np.int64), np.full(len(bins), -1, np.int64)  # steps made by then
    while left > least and moved:
        moved = False
        for src in np.argsort(fills, kind="stable").tolist():
            while left > least and 0 < fills[src] < cap:
                # equally full bins: the first gives
                fuller = (fills > fills[src]) | (fills == fills[src]) & (np.arange(len(fills)) > src)
                fresh = fuller & (fills < cap) & (changed > (-1 if changed[src] > tried[src] else tried[src]))
                step = _step(src, fresh, bins, fills, where, sizes, cap) if fresh.any() else None
                if step is None:
                    tried[src] = now
                    break
                to, give, take = step
                bins[src] = [i for i in bins[src] if i not in give] + take
                bins[to] = [i for i in bins[to] if i not in take] + give
                where[give], where[take] = to, src
                fills[[src, to]] = sizes[bins[src]].sum(), sizes[bins[to]].sum()
                now, moved = now + 1, True
                changed[[src, to]] = now
                left -= not bins[src]
    return [b for b in bins if b]


def _step(src: int, open_: np.ndarray, bins: list[list[int]], fills: np.ndarray, where: np.ndarray, sizes: np.ndarray, cap: int) -> tuple[int, list[int], list[int]] | None:
    """The largest gain with the bins of a mask: (bin, indexes given, indexes taken), or None."""
    mine = bins[src]
    room = np.where(open_, cap - fills, -1)
    # a move: the largest of mine that fits, into the bin it fills best
    most = int(room.max())
    if fit := [i for i in mine if sizes[i] <= most]:
        i = max(fit, key=lambda i: sizes[i])
        return int(np.argmin(np.where(room >= sizes[i], room, cap + 1))), [i], []
    theirs = np.flatnonzero(open_[where] & (where >= 0))
    theirs = theirs[np.lexsort((sizes[theirs], where[theirs]))]
    have, spare = sizes[theirs], room[where[theirs]]
    best: tuple[int, int, list[int], list[int]] | None = None
    gifts = [([i], int(sizes[i])) for i in mine] + [([i, j], int(sizes[i] + sizes[j])) for n, i in enumerate(mine) for j in mine[n + 1 :]]
    for give, s in gifts:  # one for one, two for one
        gain = s - have
        gain[(gain <= 0) | (gain > spare)] = 0
        at = int(np.argmax(gain))
        if gain[at] > (best[0] if best else 0):
            best = (int(gain[at]), int(where[theirs[at]]), give, [int(theirs[at])])
    if best is None:
        base = where[theirs] * (cap + 1)
        for i in mine:  # one for two
            # the largest partner in the same bin that leaves a gain
            other = np.searchsorted(base + have, base + np.maximum(sizes[i] - have, 0), "left") - 1
            gain = np.where(other > np.arange(len(theirs)), sizes[i] - have - have[other], 0)
            gain[(gain <= 0) | (gain > spare)] = 0
            at = int(np.argmax(gain))
            if gain[at] > (best[0] if best else 0):
                best = (int(gain[at]), int(where[theirs[at]]), [i], [int(theirs[at]), int(theirs[other[at]])])
    return best and best[1:]


def pack_sizes(sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it, and the bin's fill for each size."""
    bins = local_search(best_fit(sizes, cap), sizes, cap)
    which, offset, fill = (np.zeros(len(sizes), np.int64) for _ in range(3))
    for b, own in enumerate(bins):
        which[own] = b
        offset[own] = np.cumsum(sizes[own]) - sizes[own]
        fill[own] = sizes[own].sum()
    return which, offset, fill


def pack(pieces: DataFrame, *, size: str = "length", length: int = 4096, shard: int = 8000, poor: float = 0.98) -> DataFrame:
    """pieces with sequence_id and offset: every row once, no sequence longer than length.

    Rows of a null size or one outside 1..length get null for both. Equal sizes, repeated rows
    and null keys don't matter: rows are told apart by place. Columns named as a result are
    replaced; an empty table gives an empty result. shard: about how many pieces are packed
    together, in both rounds; pieces of sequences filled less than poor meet in the second one.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    base = saved(pieces.select(kept).withColumn("__row", F.monotonically_increasing_id()))
    good = F.coalesce(F.col(size).between(1, length), F.lit(False))
    null = F.lit(None).cast("long")
    full = base.filter(F.col(size) == length).withColumns({"sequence_id": -F.col("__row") - 1, "offset": F.lit(0).cast("long")})
    bad = base.filter(~good).withColumns({"sequence_id": null, "offset": null})
    small = base.filter(good & (F.col(size) < length)).select("__row", F.col(size).cast("long").alias("__size"))

    def bins(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__row", ignore_index=True)
        which, offset, fill = pack_sizes(rows["__size"].to_numpy(), length)
        return rows.assign(__bin=which, __offset=offset, __fill=fill)

    def packed(rows: DataFrame, groups: int, turn: int) -> DataFrame:
        dealt = rows.select("__row", "__size", F.pmod(F.xxhash64("__row", F.lit(turn)), F.lit(groups)).alias("__shard"))
        return dealt.groupBy("__shard").applyInPandas(bins, "__row long, __size long, __shard long, __bin long, __offset long, __fill long")

    shards = max(1, -(-small.count() // shard))
    first = saved(packed(small, shards, 1))
    rich = F.col("__fill") >= poor * length
    rest = first.filter(~rich).select("__row", "__size")
    second = packed(rest, max(1, -(-rest.count() // shard)), 2)
    wide = F.lit(1 << 31)  # more sequences than a task can hold
    placed = first.filter(rich).select("__row", "__offset", (F.col("__shard") * wide + F.col("__bin")).alias("__id"))
    placed = placed.unionByName(second.select("__row", "__offset", ((F.lit(shards) + F.col("__shard")) * wide + F.col("__bin")).alias("__id")))
    placed = base.join(placed.select("__row", F.col("__id").alias("sequence_id"), F.col("__offset").alias("offset")), "__row")
    return placed.unionByName(full).unionByName(bad).drop("__row")
