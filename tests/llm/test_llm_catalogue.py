"""Every query of the subpackage on the smallest test data: with an oracle against DuckDB, else for form and order."""

from __future__ import annotations

from pathlib import Path

import pytest

from marketloom.llm import catalogue

DATA = Path("/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": {"record_a": "bigint", "record_b": "bigint"},
    "p1_classes": {"record": "bigint", "name_class": "bigint", "links": "bigint"},
    "p3_found": {"field_name": "string", "record_id": "bigint", "ref_id": "bigint"},
    "p4_found": {"keep_obs_id": "bigint", "obs_id": "bigint"},
    "p4_copies": {"keep_obs_id": "bigint", "copies": "bigint"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p9_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p9_reparameterised": {"doc_id": "bigint", "item_id": "bigint"},
    "p10_found": {"doc_id": "bigint", "restored_md5": "string"},
}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = catalogue.QUERIES[name](spark, str(DATA))
    result = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(result.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_form(spark, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    assert dict(df.dtypes) == COLUMNS[name]
    rows = [str(tuple(r)) for r in df.collect()]
    assert len(rows) == len(set(rows)) and (rows or name == "p9_reparameterised")


def test_all_queries_are_described():
    assert set(COLUMNS) == set(catalogue.QUERIES) and set(catalogue.ORACLES) <= set(COLUMNS)
