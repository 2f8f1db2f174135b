"""Cases in which nothing of the whole may be lost."""

import random

import numpy as np
import pytest

import corpus_pipeline
from rasterloom.llm import decontaminate, html_text, packing


def test_near_duplicates_judges_rows_not_ids(ready):
    words = lambda p: " ".join(f"{p}{i}" for i in range(40))
    rows = [(1, words("a")), (3, words("a")), (3, words("b")), (3, words("b")), (4, words("c")), (4, words("d")), (5, words("d") + " x"), (6, None), (6, ""), (6, None), (7, None), (None, words("a"))]
    docs = ready.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in corpus_pipeline.near_duplicates(ready, docs, "").collect())
    assert got == sorted([(0, words("a")), (1, words("a")), (3, words("b")), (4, words("c")), (4, words("d")), (6, ""), (6, ""), (7, "")])


def test_local_search_goes_on_past_stuck_bins():
    sizes = np.array([60] * 20 + [5] * 13 + [62, 33] * 13)
    bins = packing.local_search([*[[i] for i in range(20)], list(range(20, 33)), *[[i, i + 1] for i in range(33, 59, 2)]], sizes, 100)
    assert len(bins) == 33 and sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert max(int(sizes[b].sum()) for b in bins) <= 100


LONG = "words, and more words, of an article that goes on, " * 12
OUTSIDE = {
    "<body><h1>T</h1><div class=post><p>one, a</p><p>two, b</p><p>three</p></div></body>": "T\none, a\ntwo, b\nthree",
    f"<body><p>Lead.</p><div><p>{LONG}</p><p>{LONG}</p></div><div><p>Short end.</p></div></body>": f"Lead.\n{LONG.strip()}\n{LONG.strip()}\nShort end.",
    f"<body>Bare lead.<div><h2><a href=x>Head</a></h2></div><div><h1><a href=x>T</a></h1><div><p>{LONG}</p></div><ul><li><a href=a>one</a></li></ul></div></body>": f"Bare lead.\nT\n{LONG.strip()}",
    f"<article><h1>T</h1><div><p>Lead.</p><div><p>{LONG}</p><p>{LONG}</p></div></div></article><div>No part.</div>": f"T\nLead.\n{LONG.strip()}\n{LONG.strip()}",
}


@pytest.mark.parametrize("page", OUTSIDE)
def test_pages_keep_text_beside_the_best_element(page):
    assert html_text.main_text(page) == OUTSIDE[page]


def test_similarity_does_not_depend_on_blocks(ready, monkeypatch):
    r = random.Random(3)
    phrase = [" ".join(f"p{p}x{i}" for i in range(12)) for p in range(6)]
    items = [[*" ".join(r.sample(phrase, 2)).split(), *[f"i{n}x{i}" for i in range(30)]] for n in range(24)]
    docs = []
    for own in items:
        for change in range(1, 5):
            words = list(own)
            for at in r.sample(range(len(words)), change):
                words[at : at + 1] = [f"new{r.random()}"]
            docs.append(" ".join(words))
            docs.append(" ".join([*phrase[r.randrange(6)].split(), *own[12:]]))
    bench = ready.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(30, "")], "item_id long, text string")
    frame = ready.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = lambda: sorted((*r[:4], round(r[4], 12)) for r in decontaminate.find_items(frame, bench).collect())
    one = found()
    kept = decontaminate.decontaminate(frame, bench).count()
    assert one and kept
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    assert found() == one
    assert decontaminate.decontaminate(frame, bench).count() == kept
