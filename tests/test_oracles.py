"""Every query that has SQL equals it on the smallest tables; the others give the same rows however these are divided."""

from collections import Counter

import oracle
import pytest

import __spark_entry__ as entry

CORE = sorted(n for m in entry._MODULES if not m.__name__.endswith("llm.queries") for n in m.queries())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        oracle.compare(spark, query, sql)
        return
    told = []
    for partitions in ("4", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        told.append(Counter(map(str, query(spark, oracle.DATA).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert told[0] == told[1] and told[0]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
