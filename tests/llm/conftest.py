import pytest

from rasterloom.llm._session import prepared


@pytest.fixture(scope="session")
def ready(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def corpus(ready):
    """Small documents with copies, shared passages, nulls, long texts, repeated rows and clashing columns."""
    words = [f"w{i * 7919 % 991}" for i in range(4000)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, " ".join(words[:120])), (2, " ".join(words[:120])), (3, " ".join([*words[:119], "other"])), (4, None), (5, ""), (6, " \n\t "), (7, "one two three"), (8, "one two three"),
        (9, " ".join([*words[200:260], passage, *words[300:340]])), (10, passage + " " + " ".join(words[400:430])), (11, " ".join(words[500:560]) + "\n" + passage), (12, " ".join(words * 5)),
        (13, f"{passage} x {passage}"), (14, "é" * 50), (15, "a\x1cb c  d"), (16, " ".join(["same"] * 100)),
    ]
    return ready.createDataFrame([(i, t, f"r{i}", i * 1.5, i % 3) for i, t in rows], "doc_id long, text string, row string, n_words double, __text int")
