"""Rules, classifier, tokens, packing, chats, pages and archives."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import chat_format, html_text, packing, quality_classifier, quality_rules, token_counts, warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "  a  b", "A\n b", " a", "a ", "a\x1cb \x1f c", "a　 b", "\xa0x y", "don't We're  \n\n x", "<|endoftext|> a<|endoftext|>", "\0a \0", "a\t b\tc", " ", "", "\n", "é è  12345 ,.;'s 's", "ΑΣ ΟΔΟΣ. İ", "é ́a",
    "a\x85b", "x²½¼ 'S''S !'s _a_ ªº Ǆ soft\xadhyph", "naïve'll'LL", None, "long " * 9000,
]


def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def brute_rules(text):
    words = (text or "").encode().split()
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    n = len(words)
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_rules(ready, corpus):
    more = [(100, "a b c d e f g h " * 4 + " ".join(f"k{i}" for i in range(90))), (101, "x # y\nx # y\n\n \nz|<>"), (102, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 " + " ".join(map(str, range(50)))), (None, "n " * 30)]
    docs = corpus.select("doc_id", "text", F.lit("mine").alias("kept"), "row").unionByName(ready.createDataFrame([(i, t, "k", "r") for i, t in more], "doc_id long, text string, kept string, row string"))
    target = ready.createDataFrame([(1,), (9,), (None,), (777,)], "doc_id long")
    got = quality_rules.quality_rules(docs, target, buckets=256).collect()
    assert len(got) == 20
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(texts[r["doc_id"]]), r["doc_id"]
        assert r["kept"] == (not r["base_failed"] and r["score"] >= -0.1)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["score"] > by[12]["score"] and by[4]["score"] == 0
    assert quality_rules.quality_rules(docs.limit(0), target, buckets=16).count() == 0
    assert quality_rules.quality_rules(docs, target.limit(0), buckets=16).count() == 20


def brute_scores(texts, trusted, buckets):
    """Mean log ratio of each text's hashed uni- and bigrams."""
    token = quality_rules.TOKEN.replace(r"\s", r" \t-\r")  # Java's white space

    def grams(text):
        t = [x.encode() for x in regex.findall(token, text or "")]
        one = [xxhash.xxh64_intdigest(x, 42) for x in t]
        two = [xxhash.xxh64_intdigest(x, h) for h, x in zip(one, [*t[1:], b""], strict=False)]
        return [h % buckets for h in one + two]  # 2**64 is a multiple of the buckets

    raw, target = Counter(), Counter()
    for d, text in texts:
        raw.update(grams(text))
        if d in trusted:
            target.update(grams(text))
    share = lambda c, b: np.log((c[b] + 1) / (c.total() + buckets))
    return [float(np.mean([share(target, b) - share(raw, b) for b in g])) if (g := grams(text)) else 0.0 for _, text in texts]


def test_scores_equal_brute_force(ready, corpus):
    docs = corpus.select("doc_id", "text").unionByName(ready.createDataFrame([(1, "zwölf Köche; 3 Äpfel!"), (None, "x y")], "doc_id long, text string"))
    rows = [(r[0], r[1]) for r in docs.collect()]
    target = ready.createDataFrame([(1,), (9,), (None,), (777,), (9,)], "doc_id int")
    expected = sorted((str(d), round(s, 9)) for (d, _), s in zip(rows, brute_scores(rows, {1, 9}, 256), strict=True))
    for bits in (1 << 25, 8):  # a table too small to spare anything changes no result
        got = quality_rules.quality_rules(docs, target, buckets=256, filter_bits=bits, threshold=-0.02).collect()
        assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got) == expected
        assert all(r["kept"] == (not r["base_failed"] and r["score"] >= -0.02) for r in got)


def test_ratios_are_those_of_the_counts(ready):
    docs = ready.createDataFrame([(1, "a b a"), (2, "b b"), (3, None)], "doc_id long, text string")
    ratios = quality_rules.log_ratios(docs, docs.filter("doc_id = 1").select("doc_id"), text="text", key="doc_id", buckets=8, smoothing=1.0).first()[0]
    pairs = quality_rules._tokens(docs, "text", ["doc_id"]).select("doc_id", "a", "b", quality_rules._bucket(8, "a").alias("x"), quality_rules._bucket(8, "a", "b").alias("y")).collect()
    assert [(r["a"], r["b"]) for r in pairs if r["doc_id"] == 1] == [("a", "b"), ("b", "a"), ("a", "")]
    grams = {d: [v for r in pairs if r["doc_id"] == d and r["a"] is not None for v in (r["x"], r["y"])] for d in (1, 2, 3)}
    raw, target = np.bincount(grams[1] + grams[2] + grams[3], minlength=8), np.bincount(grams[1], minlength=8)
    expected = np.log((target + 1) / (target.sum() + 8)) - np.log((raw + 1) / (raw.sum() + 8))
    assert len(grams[1]) == 6 and not grams[3] and np.allclose(ratios, expected)


def test_classifier_on_held_out_rows(ready):
    docs, labels = (ready.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").filter(quality_classifier.fold(F.col("doc_id")) == 1)
    right, n = scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 50 and right > 0.95
    assert ready.range(50).filter(quality_classifier.fold(F.col("id")) == 1).count() == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50))


def test_classifier_on_odd_rows(ready, corpus):
    labels = ready.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(corpus, labels)
    got = quality_classifier.score(corpus, model).collect()
    assert len(got) == corpus.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.score(corpus.limit(0), model).count() == 0
    assert quality_classifier.fit(corpus, labels.limit(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_trees_walk_as_they_grew():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 3] > 0.2)).astype(int)
    model = quality_classifier.train(x[:2000], y[:2000], trees=60)
    assert ((model.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93

    def walk(row):
        total = model.base
        for f, limit, leaf in zip(model.feature, model.limit, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > limit[node] else 1)
            total += leaf[node - len(f)]
        return total

    assert np.allclose([walk(r) for r in x[:50]], model.margin(x[:50]))


def test_token_counts(ready):
    rng = random.Random(0)
    texts = [*ODD, *["".join(rng.choice(" \n\t'aébZ1!. ") for _ in range(40)) for _ in range(300)]]
    docs = ready.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    t = tokenizer(BYTE)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, BYTE).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((x or "").encode()), n > 1024), repr(x)
    assert token_counts.token_counts(docs.limit(0), BYTE).count() == 0


def test_pieces_and_sequences(ready):
    docs = ready.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(0, ODD[0], "x")], "doc_id long, text string, piece string")
    t = tokenizer(WORD)
    pieces = packing.tokenize_pieces(docs, WORD, length=64)
    packed = packing.pack(pieces, length=64).collect()
    whole = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["length"] * 4 == len(r["ids"]) and r["start"] == 64 * r["piece"]
        whole.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    for i, x in enumerate(ODD):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(whole[i]) == ids * (2 if i == 0 else 1), repr(x)
    used = {}
    for r in packed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 64
    assert packing.pack(pieces.limit(0)).count() == 0


def test_packing_of_many_shards(ready):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 200) for _ in range(3000)] + [500, 0, 501, None]
    rows = ready.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, length int")
    got = packing.pack(rows, length=500, shard=200).collect()
    fills = {}
    for r in got:
        if r["sequence_id"] is not None:
            fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert len(got) == 3004 and sum(r["sequence_id"] is None for r in got) == 3 and max(fills.values()) <= 500
    assert len(fills) <= 1.01 * sum(fills.values()) / 500 + 3


def test_local_search_empties_bins():
    sizes = np.array([6, 6, 4, 4, 5, 5])
    bins = packing.local_search([[0], [1], [2, 3], [4], [5]], sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(6)) and len(bins) == 3 and all(sizes[b].sum() <= 10 for b in bins)
    swapped = packing.local_search([[0, 1], [2, 3], [4]], np.array([5, 3, 6, 2, 4]), 10)
    assert len(swapped) == 2


HOSTILE = {
    "deep": ("<div>x" * 100_000, "\n".join("x" * 100_000)),
    "deep inline": ("<b>" * 50_000 + "x<hr>" * 50_000, "\n".join("x" * 50_000)),
    "no end": ("<p>x</p>" + "<a " * 100_000, "x\n" + " ".join(["<a"] * 100_000)),
    "no end of quotes": ("<p>x" + "<a b='>' " * 100_000 + '"', None),
    "no end of scripts": ("<p>x</p><script>" + "</script " * 100_000, "x"),
    "comments": ("<p>x<!-- y -->" * 50_000, "\n".join("x" * 50_000)),
    "long": ("<div><p>" + "word, " * 1_700_000 + "</p></div>", " ".join(["word,"] * 1_700_000)),
    "reference": ("<p>&#" + "9" * 10_000 + "; &#00000000000065;</p>", "\ufffd A"),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_in_linear_time(name):
    page, expected = HOSTILE[name]
    began = time.process_time()
    got = html_text.main_text(page)
    assert time.process_time() - began < 10
    assert expected is None or got == expected


def test_each_step_raises_squared_fill(monkeypatch):
    sizes = np.random.default_rng(4).integers(700, 1001, 300)
    start = [[i] for i in range(300)]
    squares, step = [], packing._step

    def seen(src, open_, bins, fills, *rest):
        squares.append(int((fills.astype(object) ** 2).sum()))
        return step(src, open_, bins, fills, *rest)

    monkeypatch.setattr(packing, "_step", seen)
    bins = packing.local_search(start, sizes, 4096)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert squares == sorted(squares) and squares[-1] > squares[0]
    assert len(bins) <= 1.05 * -(-int(sizes.sum()) // 4096)


def test_search_beats_best_fit_where_sizes_pack_badly():
    for n in (500, 2000):
        sizes = np.random.default_rng(n).integers(700, 1001, n)
        start = packing.best_fit(sizes, 4096)
        bins = packing.local_search(start, sizes, 4096)
        assert len(bins) <= 0.96 * len(start) and sorted(i for b in bins for i in b) == list(range(n))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        packing.ChunkIds(BYTE)


CONTROL = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> </s>", "[[INST]INST]", "<<SYS>>x<</SYS>>", "<</TEXT>>", "\\", "<", "", None, "é\n\n"]


def test_chats(ready):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "a<</ROLE>>"]), rng.choice(CONTROL)) for c in (0, 1, 2, -7, None) for t in (0, 1, 1, 2, None)]
    turns = ready.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    formatted = chat_format.format_chats(turns)
    got = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    texts = {}
    for r in formatted.collect():
        texts.setdefault(r["conv_id"], []).append((r["start"], r["formatted"]))
    for c in (0, 1, 2, -7, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        all_ = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        said = "".join(x for _, _, r, x in own if r == "assistant")
        whole = "".join(s for _, s in sorted(texts[c]))
        assert [p[:2] for p in chat_format.parse(whole)] == [(r, x) for _, _, r, x in own]
        assert got[c][1:] == (5, hashlib.sha256(all_.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(whole))
    assert chat_format.digests(chat_format.format_chats(turns.limit(0))).count() == 0


@pytest.mark.parametrize("bad", ["x", "[INST]a", "[INST]a</s>", "<<ROLE>>r<</ROLE>>", "[/INST]"])
def test_parser_refuses_what_is_not_in_the_grammar(bad):
    with pytest.raises(ValueError):
        chat_format.parse(bad)


PAGES = {
    "<html><body><nav>menu</nav><article><h1>A &amp; b</h1><p><b>one,\n two<br><p>three <span class=ad>buy</span> four</article><footer>f</footer>": "A & b\none, two\nthree four",
    "<body><div id=sidebar><p>side</p></div><div class='post'><p>first, text</p>tail<ul><li>x<li>y</ul></div><div class='comments'><p>nice, one</p></div>": "first, text\ntail\nx\ny",
    "<article><p>a</p><form><p>name</p></form><script>if (a</b) '<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>b&nbsp;&#233;&lt;c</p></article>": "a\nb é<c",
    "": "", "no markup at all": "no markup at all", "<<<>": "<<<>", "<nav>only menu</nav>": "", "<p>unclosed <b>bold": "unclosed bold", "<div class='cookie-notice'>ok</div><main><p>m</p></main>": "m",
}


def test_pages(ready):
    rows = [(i, f"u{i}", h, "mine") for i, h in enumerate([*PAGES, None])]
    got = html_text.extract_text(ready.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r["text"] for r in sorted(got, key=lambda r: r["page_id"])] == [*PAGES.values(), ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract_text(ready.createDataFrame([], "page_id long, html string")).count() == 0


def test_pages_of_the_tables_keep_their_article(ready):
    import re
    from html import unescape

    for r in ready.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1])
        plain = [" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks]
        assert html_text.main_text(r["html"]) == "\n".join(b for b in plain if b)


def test_archives(ready, tmp_path):
    same, other = "é" * 600, "x" * 1500
    rows = [(1, "u\r\n1", same), (2, None, same), (3, "u3", other), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u7", ""), (9, "u9", same), (None, "n", other), (3, "u3", other)]
    pages = ready.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/a"
    warc.write_warc(warc.as_records(pages), path)
    got = warc.read_warc(ready, path).collect()
    assert len(got) == 10
    for r in got:
        if r["record_type"] == "response":
            assert warc.sha1(bytes(r["payload"])) == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
        else:
            assert r["payload"] is None
    by = {r["page_id"]: r for r in got}
    assert {k: (by[k]["record_type"], by[k]["refers_to"]) for k in by} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 3: ("response", None), None: ("revisit", 3), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert by[1]["payload_bytes"] == 1200 and by[1]["payload_digest"] == by[9]["payload_digest"] and by[1]["url"] == "u%0D%0A1" and by[2]["url"] is None
    pushed = warc.read_warc(ready, path, payload=False).filter("record_type = 'revisit' AND payload_bytes > 1300")
    assert [(r["page_id"], r["payload"]) for r in pushed.collect()] == [(None, None)]
    warc.write_warc(warc.as_records(pages.limit(0)), f"file://{tmp_path}/b")
    assert warc.read_warc(ready, f"file://{tmp_path}/b").count() == 0


def test_archives_of_other_writers(tmp_path):
    import gzip

    rows = [{"page_id": i, "url": "u", "record_type": "response", "refers_to": None, "payload_digest": "d", "payload_bytes": 700 * i, "payload": b"\r\n\r\n" * (175 * i)} for i in range(5)]
    data = [warc.record(r, "2020-01-01T00:00:00Z") for r in rows]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    for name in ("a.warc", "b.warc.gz"):
        reader = warc.WarcReader({"path": str(tmp_path / name)})
        got = [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
        assert [(r["page_id"], r["payload"]) for r in got] == [(r["page_id"], r["payload"]) for r in rows]
