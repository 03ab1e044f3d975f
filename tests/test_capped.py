"""First rows per key for any number, without a task that holds a key."""
import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators.ordered import first_per_key


@pytest.fixture(scope="module")
def rows():
    random.seed(6)
    return [(random.choice(["hot", "hot", "hot", "b", None]), random.randrange(300), i) for i in range(2000)]


@pytest.mark.parametrize("n", [1, 7, 400, 100_000])
@pytest.mark.parametrize("width", [1, 40, 1000])
def test_first_rows_equal_a_plain_sort(spark, rows, n, width):
    df = spark.createDataFrame(rows, "k string, at long, id long").withColumn("place", F.struct("at", "id"))
    found = first_per_key(df, ["k"], [F.col("place")], F.struct(F.floor(F.col("at") / width)), n)
    assert found.columns == ["k", "at", "id", "place", "position"]
    want = set()
    for key in {k for k, _, _ in rows}:
        want |= {(key, at, i, p) for p, (at, i) in enumerate(sorted((at, i) for k, at, i in rows if k == key)[:n], 1)}
    got = found.collect()
    assert len(got) == len(want) and {(r.k, r.at, r.id, r.position) for r in got} == want


def test_nothing_for_an_empty_table_or_none_asked(spark, rows):
    df = spark.createDataFrame(rows, "k string, at long, id long")
    assert first_per_key(df.where("false"), ["k"], [F.col("id")], F.col("id"), 5).count() == 0
    assert first_per_key(df, ["k"], [F.col("id")], F.col("id"), 0).count() == 0


def test_one_key_is_spread_over_tasks(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would be put together here
    was = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")
        df = spark.range(0, 200_000, 1, 8).select(F.lit("one").alias("k"), F.col("id").alias("at"))
        found = first_per_key(df, ["k"], [F.col("at")], F.floor(F.col("at") / 1000), 50_000)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.set(name, was)
    assert sum(sizes) == 50_000 and max(sizes) < 25_000
