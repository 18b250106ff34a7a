"""Every registered query against its SQL twin on the small tables."""

import pytest

import __spark_entry__ as entry_points
from gristmill.queries import REGISTRY
from oracle import compare, connect


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, small, db, name):
    query = REGISTRY[name]
    df = query(spark, small)
    if query.sql is None:
        assert len(df.limit(5).collect()) > 0
    else:
        assert compare(df, db, query.sql) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", ["compare_stats", "dedup_most_complete", "facet_table", "match_stats"])
def test_partition_count_does_not_matter(spark, small, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append(sorted(map(str, REGISTRY[name](spark, small).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
