"""Pages made from narrow rows are made and read in all tasks, whatever the row groups of the table."""

import os

import pytest

import __spark_entry__ as entry
from workload.views import Tables

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def test_dealt_rows_are_the_tables_rows(spark):
    t = Tables(spark, SF_DIR)
    rows = t.dealt("v_profile_pages")
    assert rows.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    assert sorted(rows.collect()) == sorted(t["v_profile_pages"].collect())


@pytest.mark.parametrize("name", [
    "nested_jsonld", "character_references", "deterministic_extraction", "quoted_tags", "grounded_extraction", "page_parse_hints"])
def test_rows_are_dealt_before_pages_are_read(spark, name):
    """One row group was one task."""
    rows = entry.queries()[name](spark, SF_DIR)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_profiles_are_dealt_before_they_are_prepared(spark):
    """Wide rows of all profiles left one task for the ranking's shuffle."""
    from workload.ranking import ranked_profiles

    plan = ranked_profiles(Tables(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({3 * spark.sparkContext.defaultParallelism})" in plan
