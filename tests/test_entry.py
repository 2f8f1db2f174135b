"""The driver's contract."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 6


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_subpackage():
    for path in (ROOT / "rasterloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            names = [a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Import) for a in n.names] + [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any(n.startswith(("rasterloom.llm", "corpus_pipeline")) for n in names), path
