"""Queries that show every row of their input."""

from rasterloom.plans import library

FOLDER = "/root/testdata/sf0.001"


def test_every_search_has_its_trials(spark):
    log = library.QUERIES["trial_log"](spark, FOLDER).collect()
    found = {r["id"]: r for r in library.QUERIES["search_linear"](spark, FOLDER).collect()}
    of = {}
    for r in sorted(log, key=lambda r: r["n"]):
        of.setdefault(r["id"], []).append(r)
    assert of.keys() == found.keys()
    for i, trials in of.items():
        assert [t["n"] for t in trials] == list(range(1, found[i]["iterations"] + 1))
        assert (found[i]["value"], found[i]["score"]) in [(t["value"], t["score"]) for t in trials]
        assert [t["low"] for t in trials] == [max([1.0, *[u["value"] for u in trials[:n] if u["score"] < 69]]) for n in range(len(trials))]
    assert any(r["reached"] for r in found.values()) and any(not r["reached"] and i % 97 >= 20 for i, r in found.items())


def test_every_order_has_its_change(spark):
    change = dict(library.QUERIES["size_change"](spark, FOLDER).collect())
    orders = [r["o_orderkey"] for r in spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey").collect()]
    assert len(change) == len(orders) == len(set(orders))
    assert {k for k, v in change.items() if v == "n/a"} == {k for k in orders if k % 7 == 0} != set()
