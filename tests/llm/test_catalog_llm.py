"""Registered queries of the folder at the smallest scale: SQL where there is some, else the rows it must have."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chainwitness.llm import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = entry.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    expected = duck.sql(entry.oracle_sql()[name]).select(*columns).fetchall()
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expected) and expected


@pytest.mark.parametrize("name", ["op1_token_files", "op4_language_id"])
def test_query_has_a_row_per_document(spark, name):
    found = entry.queries()[name](spark, SMALL)
    assert found.select("doc_id").distinct().count() == found.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
