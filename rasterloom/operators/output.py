"""Files written from rows: each whole or not at all."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "path string, bytes long, status string, reason string"


def put(path: str, content: bytes, *, force: bool = False, backup: bool = False) -> tuple[str, str | None]:
    """(status, reason) of one file, written beside its place and renamed into it.

    A file that already holds these bytes counts as written, so a task that runs again after a
    lost executor says what the first one said. Another file in the place is a failure without
    force or backup; backup keeps it as path.bak, which must not be there yet unless forced.
    """
    try:
        there = os.path.exists(path)
        if there and os.path.getsize(path) == len(content):
            with open(path, "rb") as f:
                if f.read() == content:
                    return "written", None
        kept = f"{path}.bak"
        if there and backup and os.path.exists(kept) and not force:
            return "failed", "backup exists"
        if there and not force and not backup:
            return "failed", "output exists"
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        beside = f"{path}.{os.getpid()}.{os.urandom(6).hex()}.tmp"
        try:
            with open(beside, "wb") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
            if there and backup:
                os.replace(path, kept)
            if force or backup:
                os.replace(beside, path)
            else:
                try:
                    os.link(beside, path)  # fails where another task was faster
                except FileExistsError:
                    return "failed", "output exists"
                except OSError:  # a file system without links
                    os.replace(beside, path)
        finally:
            if os.path.exists(beside):
                os.remove(beside)
    except (OSError, ValueError) as e:
        return "failed", str(e)
    return "written", None


def write_files(rows: DataFrame, path: str = "path", content: str = "content", *, force: bool = False, backup: bool = False) -> DataFrame:
    """(path, bytes, status, reason) per row, in a folder that all executors share.

    Files are written when the result is evaluated; save it once rather than evaluate it twice.
    A null path or content fails that row alone; an empty content is an empty file. Of rows with
    one path and different contents, without force, one is written and the others fail (forced:
    one of them stays); geometry's collisions find such rows beforehand.
    """

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for p, c in zip(batch.column(0), batch.column(1), strict=True):
                p, c = p.as_py(), c.as_py()
                status = ("failed", "no path" if p is None else "no content") if p is None or c is None else put(p, c, force=force, backup=backup)
                out.append((p, None if c is None else len(c), *status))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "bytes", "status", "reason"])

    return rows.select(F.col(path).cast("string"), F.col(content).cast("binary")).mapInArrow(run, RECORD)
