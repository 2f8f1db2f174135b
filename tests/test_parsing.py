"""Numbers spelled for people."""

import pytest

from rasterloom.functions import parsing


def _spelled(n):
    return f"{n} B" if n < 1000 else f"{n / 1e3:.1f} KB" if n < 10**6 else f"{n / 1e6:.1f} MB" if n < 10**9 else f"{n / 1e9:.2f} GB"


@pytest.mark.parametrize("unit, step", [(10**3, 50), (10**6, 50_000), (10**9, 5_000_000)])
def test_halves_of_byte_sizes(spark, unit, step):
    """A half goes by the double's exact value, and to even where it is exact."""
    n = [unit + step * i + d for i in range(1000) for d in (-1, 0, 1)]
    rows = spark.createDataFrame([(x,) for x in n], "n long")
    assert [r for r in rows.select("n", parsing.byte_size(rows["n"])).collect() if r[1] != _spelled(r[0])] == []


def test_byte_sizes(spark):
    of = {0: "0 B", 999: "999 B", 1000: "1.0 KB", 1150: "1.1 KB", 45_250: "45.2 KB", 45_350: "45.4 KB", 999_999: "1000.0 KB", 110_250_000: "110.2 MB", 1_005_000_000: "1.00 GB", 2**63 - 1: "9223372036.85 GB", None: None}
    rows = spark.createDataFrame([(n,) for n in of], "n long")
    assert dict(rows.select("n", parsing.byte_size(rows["n"])).collect()) == of
