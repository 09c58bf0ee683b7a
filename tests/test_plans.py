"""Pushdown, top-k and map-side combining in physical plans.

``test_catalog`` checks the plan of every registered query for cross products and for
windows over raw sessions.
"""

import re

from plan_checks import physical

import __spark_entry__ as entry
from chainwitness.catalog import registry
from chainwitness.operators import audit
from chainwitness.sources import ledger as src
from chainwitness.testing import fixtures as X

SMALL = "/root/testdata/sf0.001"


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "ledger")
    X.conv_ledger(spark, SMALL).write.parquet(path)
    stored = spark.read.parquet(path)
    text = physical(src.session_rows(stored, "x").select("seq", "id"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(session_id,x\)", text)
    assert re.search(r"ReadSchema: struct<(seq:int|id:string|session_id:string|,)+>", text)
    text = physical(audit.check_links(stored).select("link_ok"))
    assert "signature" not in text and "latitude" not in text


def test_newest_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in physical(src.newest(X.conv_ledger(spark, SMALL)).select("id"))


def test_every_query_has_sql_or_a_reason():
    without = set(registry.QUERIES) - set(registry.ORACLES)
    assert without == {"review_report", "ssdeep_digest", "ssdeep_similarity", "ssdeep_near_dups", "metric_comparison", "perturb_noise"}
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())


def test_aggregates_combine_before_the_shuffle(spark):
    text = physical(src.one_record_per_hash(X.conv_ledger(spark, SMALL)))
    assert "partial_max_by" in text
