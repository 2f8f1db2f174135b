"""Codecs, probes, inputs and the streaming mode."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators.search import search
from rasterloom.sources import codecs, inputs, probe
from rasterloom.streaming import files


def image(color: str, kind=np.uint8, width: int = 13, height: int = 7) -> codecs.Image:
    most = 255 if kind is np.uint8 else 65535
    return codecs.Image(width, height, color, np.random.default_rng(1).integers(0, most + 1, width * height * codecs.CHANNELS[color]).astype(kind))


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("color", codecs.CHANNELS)
def test_round_trips(color, kind):
    r, i = codecs.standard(), image(color, kind)
    for fmt in ("png", *(["pnm"] if color in ("gray", "rgb") else [])):
        got, back = r.decode(r.encoder(fmt).encode(i))
        assert (got, back.color, back.depth) == (fmt, color, i.depth) and (back.samples == i.samples).all()


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    w, h, n = 5, 4, 3
    v = np.random.default_rng(kind).integers(0, 256, (h, w * n))
    rows = b""
    for y in range(h):
        line = []
        for x in range(w * n):
            a, b, c = (v[y, x - n] if x >= n else 0), (v[y - 1, x] if y else 0), (v[y - 1, x - n] if y and x >= n else 0)
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((v[y, x] - [0, a, b, (a + b) // 2, near][kind]) & 255)
        rows += bytes([kind, *line])
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    data = codecs.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (codecs.decode_png(data).samples == v.ravel()).all() and not codecs.png_animated(data)


def test_small_formats():
    assert codecs.decode_pnm(b"P3\n# c\n2 1\n255\n1 2 3 # x\n4 5 6\n").samples.tolist() == [1, 2, 3, 4, 5, 6]
    assert codecs.decode_pnm(b"P1\n3 1\n1 0 1").samples.tolist() == [0, 255, 0]
    assert codecs.decode_tga(bytes([0, 0, 2, *[0] * 9, 1, 0, 1, 0, 24, 0, 1, 2, 3])).samples.tolist() == [3, 2, 1]
    qoi = b"qoif" + struct.pack(">IIBB", 3, 1, 3, 0) + bytes([0xFE, 10, 20, 30, 0x6A | 0x01, 0xC0])
    assert codecs.decode_qoi(qoi).pixels[0, 0].tolist() == [10, 20, 30]


def test_bad_rows_fail_alone(spark):
    good = codecs.encode_png(image("rgb"))
    rows = [("a", good), ("b", good[:60]), ("c", b"\xff\xd8\xff"), ("d", b"what"), ("e", None), ("f", b"")]
    df = spark.createDataFrame([(n, bytearray(b) if b is not None else None) for n, b in rows], "name string, content binary")
    got = {r["name"]: r for r in df.withColumn("i", codecs.decoded(F.col("content"))).withColumn("o", codecs.encoded(F.col("i"), "pnm")).collect()}
    assert {n: r["i"]["error_kind"] for n, r in got.items()} == {"a": None, "b": "decode", "c": "unavailable", "d": "unknown", "e": "unknown", "f": "unknown"}
    assert bytes(got["a"]["o"]["content"]).startswith(b"P6\n13 7\n255\n") and got["b"]["o"]["error_kind"] == "decode"
    small = df.filter("name = 'a'").select(codecs.decoded(F.col("content"), limit=50).alias("i")).first()
    assert small["i"]["error_kind"] == "too_large"


def test_search_with_a_codec():
    source = image("rgb")

    def run(quality):
        out = codecs.quantise(source, quality)
        return out, 100 - float(np.abs(out.samples.astype(int) - source.samples).mean()) * 4, 0

    found = search(run, 80, tolerance=2)
    assert found.reached and found.score >= 78 and found.output.color == "rgb"


@pytest.mark.parametrize(
    ("score", "more", "tries", "value", "capped"),
    [
        (lambda q: 0.9 * q, {"target": 70, "seed": 75, "step": 5}, [75, 80, 78], 78, False),
        (lambda q: 0.5 * q, {"target": 70}, None, 100, True),
        (lambda q: 0.5 * q, {"target": 70, "seed": 98, "step": 5}, [98, 100], 100, True),
        (lambda q: float("nan"), {"target": 70}, None, 51, True),
        (lambda q: 99.0, {"target": 70}, [51, 26, 14, 8, 5, 3], 3, False),
        (lambda c: 10 + 10 * np.log2(c), {"target": 40, "floor": 2, "ceiling": 256, "geometric": True}, [23, 7, 13, 10, 8], 8, False),
        (lambda q: 10.0, {"target": 70, "floor": 42, "ceiling": 42}, [42], 42, True),
    ],
)
def test_search_traces(score, more, tries, value, capped):
    found = search(lambda v: (None, score(v), 0), more.pop("target"), **more)
    assert (found.value, found.capped) == (value, capped)
    assert tries is None or [t[0] for t in found.trials] == tries


def test_column_search_equals_the_loop(spark):
    from rasterloom.operators.search import search_column

    rows = spark.range(300).select("id", ((F.col("id") % 60) / 40.0 + 0.1).alias("k"), F.when(F.col("id") % 3 > 0, (F.col("id") % 120).cast("double")).alias("seed"), (1 + F.col("id") % 9).cast("double").alias("step"))
    curve = lambda v: F.when(F.col("id") % 50 == 7, F.lit(float("nan"))).otherwise(F.col("k") * v)
    got = rows.withColumn("f", search_column(curve, F.lit(70.0), seed=F.col("seed"), step=F.col("step"))).collect()
    for r in got:
        one = (lambda v: (None, float("nan"), 0)) if r["id"] % 50 == 7 else (lambda v, k=r["k"]: (None, k * v, 0))
        e = search(one, 70.0, seed=r["seed"], step=r["step"])
        assert (r["f"]["value"], r["f"]["iterations"], r["f"]["reached"], r["f"]["capped"]) == (e.value, len(e.trials), e.reached, e.capped), r


def test_resolution(spark):
    made = [("a/x.png", False), ("a/y.txt", False), ("a/.h.png", False), ("b.JPG", False), ("a", True), ("empty", True)]
    listing = spark.createDataFrame(made, "path string, is_folder boolean")
    args = spark.createDataFrame(list(enumerate(["b.JPG", "*.png", "a", "B.jpg", "none.png", "b.jp?", "empty"])), "position int, argument string")
    found, failed = inputs.resolve(args, listing, ["png", "jpg"], True)
    assert sorted((r["path"], r["position"]) for r in found.collect()) == [("a/.h.png", 1), ("a/x.png", 1), ("b.JPG", 0)]
    assert sorted((r["argument"], r["reason"]) for r in failed.collect()) == [("B.jpg", "no such file or match"), ("empty", "nothing to read in it"), ("none.png", "no such file or match")]
    _, failed = inputs.resolve(args, listing, ["png", "jpg"], False)
    assert ("a", "is a folder") in [(r["argument"], r["reason"]) for r in failed.collect()]


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.png").write_bytes(codecs.encode_png(image("rgba")))
    (tmp_path / "in" / "deep" / "b.ppm").write_bytes(codecs.encode_pnm(image("rgb")))
    (tmp_path / "in" / "c.bin").write_bytes(b"?")
    read = inputs.binary_files(spark, str(tmp_path / "in"))
    assert sorted(r["f"] or "" for r in read.select(probe.identify(F.col("content")).alias("f")).collect()) == ["", "png", "pnm"]
    stages = lambda df: df.select("path", codecs.decoded(F.col("content")).alias("i")).select("path", "i.*")
    query = files.run(files.arriving(spark, str(tmp_path / "in")), stages, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["width"] or 0, r["error_kind"]) for r in out) == [(0, "unknown"), (13, None), (13, None)]
    assert inputs.from_bytes(spark, b"P6\n").select(probe.identify(F.col("content"))).first()[0] == "pnm"
