"""Files from rows."""

from pathlib import Path

from rasterloom.operators import output


def test_rows_become_files(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    Path(at("old")).write_bytes(b"before")
    Path(at("file")).write_bytes(b"x")
    rows = [(at("a/b/new"), b"1"), (at("old"), b"after"), (at("empty"), b""), (None, b"2"), (at("none"), None), (at("file/below"), b"3"), (at("a\0"), b"4")]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c), 0) for p, c in rows], "path string, content binary, bytes int")
    for _ in range(2):  # the second time is a task that runs again
        got = {r["path"]: (r["bytes"], r["status"], r["reason"]) for r in output.write_files(df).collect()}
        assert got[at("a/b/new")] == (1, "written", None) and got[at("empty")] == (0, "written", None)
        assert got[at("old")] == (5, "failed", "output exists") and got[None][1:] == ("failed", "no path") and got[at("none")] == (None, "failed", "no content")
        assert got[at("file/below")][1] == got[at("a\0")][1] == "failed"
    assert Path(at("old")).read_bytes() == b"before" and Path(at("a/b/new")).read_bytes() == b"1" and Path(at("empty")).read_bytes() == b""
    assert output.write_files(df.limit(0)).count() == 0
    assert not list(tmp_path.rglob("*.tmp"))


def test_backup_and_force(tmp_path):
    p = tmp_path / "f"
    assert output.put(str(p), b"1") == ("written", None) and output.put(str(p), b"1") == ("written", None)
    assert output.put(str(p), b"2", backup=True) == ("written", None) and (tmp_path / "f.bak").read_bytes() == b"1"
    assert output.put(str(p), b"3", backup=True) == ("failed", "backup exists")
    assert output.put(str(p), b"3", force=True) == ("written", None) and p.read_bytes() == b"3"
    assert output.put(str(p), b"4", force=True, backup=True) == ("written", None) and (tmp_path / "f.bak").read_bytes() == b"3"


def test_one_path_twice(spark, tmp_path):
    rows = [(str(tmp_path / "same"), bytearray([n % 2])) for n in range(6)]
    got = output.write_files(spark.createDataFrame(rows, "path string, content binary").coalesce(1)).collect()
    assert sorted(r["status"] for r in got) == ["failed"] * 3 + ["written"] * 3
