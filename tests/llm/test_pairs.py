"""Jaccard join, components, substring dedup and decontamination against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import _text, decontaminate, jaccard_join, substring_dedup
from rasterloom.llm.components import components


def brute_links(texts: dict, n: int = 5, threshold: float = 0.8):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    root = {d: d for d in sets}
    for _ in sets:
        for a in links:
            for b in links[a]:
                root[a] = root[b] = min(root[a], root[b])
    return {d: (root[d], len(links[d])) for d in sets}


def brute_repeats(texts: list, size: int = 35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def near_texts(seed: int) -> dict:
    """Groups of near copies, one of them large, among other texts."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(5000)}"
    out, k = {}, 0
    for size, length in ((40, 150), (5, 60), (2, 300), (3, 20), *[(1, 80)] * 20):
        base = [word() for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, length // 40) + 1)):
                w[rng.randrange(length)] = word()
            out[k] = " ".join(w)
            k += 1
    return out


def test_join_equals_brute_force(ready, corpus):
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(corpus).collect()}
    assert got == brute_links(texts)


def test_join_of_near_copies_in_blocks(ready, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    texts = near_texts(3)
    docs = ready.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == brute_links(texts)


def test_join_with_null_and_repeated_keys(ready):
    docs = ready.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "z")], "doc_id long, text string")
    got = sorted(((r[0], r[1], r[2]) for r in jaccard_join.jaccard_join(docs).collect()), key=repr)
    assert got == [(1, 1, 1), (1, 1, 1), (2, 2, 0), (None, None, 0)]


def test_empty_tables(ready):
    none = ready.createDataFrame([], "doc_id long, text string")
    bench = ready.createDataFrame([], "item_id long, text string")
    assert jaccard_join.jaccard_join(none).count() == 0
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert decontaminate.find_items(none, bench).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = jaccard_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(5, 9), (9, 7), (2, 3), (3, 2), (2, 2)]])
def test_components(ready, edges):
    root = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r["id"]: r["root"] for r in components(ready.createDataFrame(edges, "a long, b long")).collect()} == root


def test_substrings_equal_brute_force(ready, corpus):
    rows = corpus.orderBy("doc_id").collect()
    expected = brute_repeats([r["text"] for r in rows])
    got = sorted(substring_dedup.dedup_substrings(corpus).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["n_removed"], " ".join((r["text"] or "").encode().decode().split(" ")) if r["n_removed"] else e[2]) for r, e in zip(got, expected, strict=True)] == expected
    assert [r["text"] for r in got if not r["n_removed"]] == [o["text"] for o, r in zip(rows, got, strict=True) if not r["n_removed"]]
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert "row" in got[0].asDict() and got[0]["__text"] is not None


def test_substrings_of_random_texts(ready):
    rng = random.Random(5)
    pool = [[f"u{rng.randrange(40)}" for _ in range(rng.randrange(20, 60))] for _ in range(12)]
    texts = [" ".join(w for _ in range(rng.randrange(1, 5)) for w in rng.choice(pool)) for _ in range(150)]
    docs = ready.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(substring_dedup.dedup_substrings(docs, window=12, k=5).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["n_removed"], r["text"]) for r in got] == brute_repeats(texts, 12)


def test_substrings_of_repeated_rows(ready):
    text = " ".join(f"q{i}" for i in range(40))
    docs = ready.createDataFrame([(1, text), (1, text), (None, "x")], "doc_id long, text string")
    assert sorted((r["n_removed"] for r in substring_dedup.dedup_substrings(docs).collect())) == [0, 40, 40]


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(1)
    raw = " ".join(f"{x}" for x in rng.integers(0, 30, 500)).encode()
    w = _text.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    _, place, first, last = substring_dedup._anchors(w, 35, 10)
    assert (last - first + 1).sum() == len(w.hashes) - 34
    assert (place >= last).all() and (place <= first + 25).all()


def brute_items(texts: dict, items: dict, threshold: float = 0.8):
    import re

    words = lambda s: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (s or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    spread = Counter(g for t in items.values() for g in grams(words(t)))
    weight = lambda g: np.log1p(len(items) / max(1, spread[g]))
    out = {}
    for d, t in texts.items():
        w = words(t)
        for i, x in items.items():
            m = len(words(x))
            if not m or not w:
                continue
            theirs, best = grams(words(x)), 0.0
            for s in range(max(1, len(w) - m + 1)):
                mine = grams(w[s : s + m])
                both = sum(weight(g) * min(n, theirs[g]) for g, n in mine.items())
                best = max(best, both / (sum(weight(g) * n for g, n in mine.items()) + sum(weight(g) * n for g, n in theirs.items()) - both))
            if best >= threshold:
                out[d, i] = round(best, 9)
    return out


def test_items_equal_brute_force(ready):
    rng = random.Random(9)
    word = lambda: f"b{rng.randrange(3000)}"
    items = {i: " ".join(word() for _ in range(rng.randrange(8, 50))) for i in range(40)} | {90: None, 91: "", 92: "just Three words"}
    texts = {}
    for d in range(120):
        w = [word() for _ in range(rng.randrange(0, 80))]
        if d % 2:
            item = items[rng.randrange(40)].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                item[rng.randrange(len(item))] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "!!" for x in item]
        texts[d] = " ".join(w)
    texts |= {500: None, 501: "so: just three, WORDS here", 502: "just three words"}
    docs = ready.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = ready.createDataFrame([*items.items(), (None, "lost"), (3, items[3])], "item_id long, text string")
    expected = brute_items(texts, {i: t for i, t in items.items() if t is not None})
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.find_items(docs, bench).collect()}
    assert got == expected and len(got) > 20
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in expected}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    queries = prints[:100].copy()
    for q in range(100):
        for bit in rng.choice(64, rng.integers(0, 25), replace=False):
            queries[q] ^= np.uint64(1) << np.uint64(bit)
    near = np.bitwise_count(queries[:, None] ^ prints[None, :]) <= decontaminate.RADIUS
    q, i = decontaminate.HammingIndex(prints).query(queries)
    assert set(zip(q.tolist(), i.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


def test_words_of_sliced_columns():
    texts = ["a b", None, "", " c  d\n", "é f g"]
    col = pa.array(["x", *texts, "y"]).slice(1, 5)
    raw, bounds = _text.texts(col.fill_null(""))
    w = _text.words(raw, bounds)
    assert w.counts.tolist() == [len((t or "").encode().split()) for t in texts]
