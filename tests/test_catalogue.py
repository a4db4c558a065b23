"""Every query with an oracle against DuckDB, on the smallest test data; and what the package may import."""

from __future__ import annotations

import ast
import math
from pathlib import Path

import pytest

from marketloom.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(rows, columns, order):
    cell = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else str(x)
    return sorted(tuple(cell(r[order.index(c)]) for c in columns) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    result = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    assert shown(df.collect(), columns, df.columns) == shown(result.fetchall(), columns, names)


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0


def test_the_core_never_imports_the_llm_subpackage():
    for path in (ROOT / "marketloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("marketloom.llm") for n in names), path


def test_no_local_checkpoint_anywhere():
    assert not [p for p in (ROOT / "marketloom").rglob("*.py") if "localCheckpoint" in p.read_text()]
