import pytest
from tracewell.plans.registry import ORACLES, QUERIES

from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLES[name], SF)


#: Run, and compared row by row, by test_replays and test_online_gallery.
REPLAYED = {"v15_merge_identities", "v15_merged_gallery", "v18_assign_identities", "v18_online_gallery", "t6_stream_alerts"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - REPLAYED))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
