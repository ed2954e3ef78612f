"""Every registered query of the engine against its DuckDB form."""

import pytest
from conftest import DATA

import cairn.store_queries  # noqa: F401
import cairn.tree_queries  # noqa: F401
from cairn.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, same_rows, name):
    assert name in ORACLES
    same_rows(QUERIES[name](spark, DATA), duck, ORACLES[name])


def test_partition_counts_do_not_matter(spark, duck, same_rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for name in ("delta_by_hash", "restore_plan", "archive_offsets"):
                same_rows(QUERIES[name](spark, DATA), duck, ORACLES[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
