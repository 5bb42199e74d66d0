"""The registered queries: against their SQL where they have one."""

import pytest

import __spark_entry__ as entry
from tabloom.llm.catalog import ORACLES, QUERIES
from tests.compare import connect, differences


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op11_packing", "op13_whitening"}))
def test_has_a_row_per_document(spark, sf, name):
    ids = [r["doc_id"] for r in QUERIES[name](spark, sf).select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
