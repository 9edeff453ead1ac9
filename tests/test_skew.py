import pytest
from pyspark.sql import functions as F

from feedskein.operators.skew import SALTS, spread_join


@pytest.mark.parametrize("joins", ["salted"], indirect=True)
def test_a_hot_key_takes_many_tasks(spark, joins):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("n"))
    lookup = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        joined = spread_join(rows, lookup, "key")
        hot = joined.filter("key = 0").groupBy(F.spark_partition_id()).count().collect()
        assert joined.columns == ["key", "n", "twice"] and joined.count() == 3000
        assert len(hot) > SALTS // 2 and max(r["count"] for r in hot) < 2000 // 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("how, expected", [
    ("inner", [(1, "a"), (1, "b")]), ("left", [(1, "a"), (1, "b"), (2, "c")]),
    ("left_semi", [(1, "a"), (1, "b")]), ("left_anti", [(2, "c")]),
])
def test_kinds_of_join(spark, joins, how, expected):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "key int, x string")
    lookup = spark.createDataFrame([(1,), (3,)], "key int")
    got = spread_join(rows, lookup, "key", how)
    assert got.columns == ["key", "x"]
    assert sorted(tuple(r) for r in got.collect()) == expected
