"""Token counts without token ids.

Each distinct pre-token of the corpus is encoded once and its number of pieces kept; this table
is joined to the pre-token frequencies of each document. Pre-tokens are runs between places
where the tokenizer's own pattern always splits (before a single space that leads a word), so a
sum over them is exact.

Frequent pre-tokens would be hot keys of that join, so it has two halves: the most frequent
ones, at most `frequent` of them, go to all tasks, and only the frequencies of the others are
dealt by pre-token. Both halves come from the one table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import _text
from rasterloom.llm._session import half, saved

_U = np.uint64

#: Unicode White_Space, as the tokenizer's pattern means \s; Python's \s has four more.
_WS = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Bytes that white space beyond ASCII can start with.
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = re.compile("[\x85\xa0  -     　]")
#: Distinct pre-tokens that a task holds at once while it counts.
HELD = 400_000
#: Bytes of texts that a task looks at together.
SLICE = 1_500_000


class PieceCounts:
    """A tokenizer that counts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[int]:
        """Which texts hold special strings: their pre-tokens aren't between white space."""
        return [i for i, t in enumerate(texts) if any(s in t for s in self.special)]


_counters: dict[str, PieceCounts] = {}


def counter(path: str) -> PieceCounts:
    if path not in _counters:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _counters[path] = PieceCounts(path)
    return _counters[path]


def pre_tokens(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the pre-tokens of some texts, in order; they cover the texts."""
    n = len(raw)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not n:
        return (np.zeros(0, np.int64),) * 3
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    full = bounds[:-1] < bounds[1:]
    head[bounds[:-1][full]], tail[bounds[1:][full] - 1] = True, True
    ws = _text.SPACE[raw]
    after_ws, after_space, before_word = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    after_ws[1:], after_space[1:], before_word[:-1] = ws[:-1], raw[:-1] == 0x20, ~ws[1:]
    after_ws &= ~head
    after_space &= ~head
    before_word &= ~tail
    # the last of several spaces leads the word after it; another last white space stands alone
    start = head | ws & (before_word | ~after_ws) | ~ws & after_ws & ~after_space
    wide = np.unique(row[_WIDE_LEAD[raw]])
    for i in wide.tolist():
        a, b = int(bounds[i]), int(bounds[i + 1])
        text = raw[a:b].tobytes().decode()
        if _WIDE.search(text):
            start[a:b] = False
            start[a + np.cumsum([0, *(len(c.encode()) for c in _CHUNK.findall(text))][:-1])] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), row[starts]


def _told(batch: pa.RecordBatch, of: PieceCounts) -> Iterator[tuple]:
    """For slices of a batch (..., __text): rows, byte bounds, whole rows, the pre-tokens of the others as hashes, rows, starts, ends, and the bytes."""
    for rows, raw, bounds in _text.batches(batch, "__text", SLICE):
        texts = pc.fill_null(rows.column(rows.num_columns - 1), "")
        whole: list[int] = []
        if any(pc.any(pc.match_substring(texts, s)).as_py() for s in of.special):
            whole = of.whole(texts.to_pylist())
        starts, ends, row = pre_tokens(raw, bounds)
        hashes = _text.span_hashes(raw, starts, ends)
        if whole:
            other = ~np.isin(row, whole)
            starts, ends, row, hashes = starts[other], ends[other], row[other], hashes[other]
        yield rows, bounds, texts, whole, hashes, row, starts, ends, raw


def vocabulary(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(hash, n: how often it occurs, pieces) of each distinct pre-token of texts (__text), encoded once."""

    def found(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer)
        count: dict[int, int] = {}
        piece: dict[int, bytes] = {}
        told = lambda: pa.RecordBatch.from_arrays([pa.array([piece[h] for h in count], pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64())], names=["piece", "n"])
        for batch in stream:
            for _, _, _, _, hashes, _, starts, ends, raw in _told(batch, of):
                new, at, n = np.unique(hashes, return_index=True, return_counts=True)
                for h, c, a, b in zip(new.tolist(), n.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True):
                    if h in count:
                        count[h] += c
                    else:
                        count[h], piece[h] = c, raw[a:b].tobytes()
                if len(count) > HELD:  # sums go on after the exchange
                    yield told()
                    count, piece = {}, {}
        yield told()

    def encoded(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer)
        for batch in stream:
            raw, bounds = _text.texts(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(_text.signed(_text.span_hashes(raw, bounds[:-1], bounds[1:]))), batch.column(1), pa.array(of.encode(batch.column(0).to_pylist()), pa.int32())], names=["hash", "n", "pieces"])

    distinct = texts.mapInArrow(found, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(encoded, "hash long, n long, pieces int")


def most_frequent(words: DataFrame, most: int) -> int:
    """The least count that at most so many rows of words (n) have or exceed."""
    classes = words.groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).collect()  # some 500 at most
    total, cut = 0, 2**62
    for r in sorted(classes, key=lambda r: -r["c"]):
        total += r["rows"]
        if total > most:
            break
        cut = r["n"]
    return cut


def token_counts(docs: DataFrame, tokenizer: str, *, text: str = "text", limit: int = 1024, keep: list[str] | None = None, frequent: int = 1 << 18) -> DataFrame:
    """keep (all columns but the text, if None), n_bytes, n_tokens and over_limit of each row.

    A null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text count as
    the tokenizer's file says; such a text is encoded whole. Columns named as a result are
    replaced by it; an empty table gives an empty result; repeated rows are counted each. A very
    long text costs memory for its bytes and its pre-tokens once. Pre-tokens are told apart by
    64-bit hashes. frequent: of how many pre-tokens at most the table goes to all tasks.
    """
    new = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in new]
    source = docs.select(F.struct(*[docs[c] for c in keep]).alias("d") if keep else F.lit(0).alias("d"), docs[text].alias("__text"))
    words = saved(vocabulary(source.select("__text"), tokenizer))
    cut = most_frequent(words, frequent)
    head = words.filter(F.col("n") >= cut).select("hash", "pieces").toArrow()  # at most `frequent` rows
    known = head["hash"].to_numpy().astype(np.int64).view(_U)
    order = np.argsort(known)
    known, pieces = known[order], head["pieces"].to_numpy().astype(np.int32)[order]

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer)
        for batch in stream:
            for rows, bounds, texts, whole, hashes, row, _, _, _ in _told(batch, of):
                n = np.zeros(len(rows), np.int64)
                if whole:
                    n[whole] = of.encode(texts.take(pa.array(whole)).to_pylist())
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                ok = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                n += np.bincount(row[ok], weights=pieces[at[ok]], minlength=len(rows)).astype(np.int64) if len(known) else 0
                # the others, with how often each row has them
                hashes, row = hashes[~ok], row[~ok]
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(row)))
                edges = pa.array(np.searchsorted(row[first], np.arange(len(rows) + 1)).astype(np.int32))
                rest = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(_text.signed(hashes[first])), pa.array(times.astype(np.int32))], names=["hash", "times"]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(n), rest], names=["d", "n_bytes", "n", "rest"])

    kind = source.schema["d"].dataType.simpleString()
    told = source.mapInArrow(run, f"d {kind}, n_bytes long, n long, rest array<struct<hash: long, times: int>>")
    told = saved(told.withColumn("row", F.monotonically_increasing_id()))
    rest = told.select("row", F.inline("rest")).select("row", "times", "hash", half("hash"))
    rest = rest.join(words.filter(F.col("n") < cut).select("hash", "pieces", half("hash")), ["hash", "half"])
    rest = rest.groupBy("row").agg(F.sum(F.col("times").cast("long") * F.col("pieces")).alias("more"))
    out = told.select("row", "d", "n_bytes", "n").join(rest, "row", "left")
    out = out.select(*(["d.*"] if keep else []), "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0).cast("long"))).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
