"""Joins with hot keys: the same pairs as a plain join, over many tasks."""

import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quantspark.operators import joins as jn


@pytest.fixture
def small_tasks(spark):
    held = {k: spark.conf.get(k, None) for k in ("quantspark.pairsPerTask", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("quantspark.pairsPerTask", "500")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sides(spark):
    """Half of the left rows under one key, a third of the right rows under another."""
    left = spark.range(40_000).select(
        F.col("id").alias("doc"), F.when(F.col("id") % 2 == 0, F.lit("the")).otherwise(F.concat(F.lit("w"), (F.col("id") % 4001).cast("string"))).alias("word"))
    names = spark.range(4001).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), F.col("id").alias("symbol"))
    hot = spark.range(2000).select(F.lit("w7").alias("word"), (F.col("id") + 10_000).alias("symbol"))
    few = spark.createDataFrame([("the", -1), ("the", -2), (None, -3)], "word string, symbol long")
    return left.union(spark.createDataFrame([(-1, None)], left.schema)), names.union(hot).union(few)


def test_hot_keys_give_the_same_pairs(spark, small_tasks):
    left, right = sides(spark)
    plain = Counter(map(tuple, left.join(right, "word").select("doc", "word", "symbol").collect()))
    found = jn.spread_join(left, right, "word").select("doc", "word", "symbol")
    assert Counter(map(tuple, found.collect())) == plain and sum(plain.values()) > 50_000


def test_no_task_far_above_the_median(spark, small_tasks):
    left, right = sides(spark)
    rows = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    spread, plain = rows(jn.spread_join(left, right, "word")), rows(left.join(right, "word"))
    assert max(plain) > 5 * statistics.median(plain)  # the case is a hard one
    assert len(spread) == 16 and max(spread) <= 3 * statistics.median(spread)


def test_without_hot_keys_the_join_is_plain(spark):
    left, right = sides(spark)
    out = jn.spread_join(left, right, "word")
    assert "down_" not in out._jdf.queryExecution().optimizedPlan().toString()
    empty = jn.spread_join(left.limit(0), right, "word")
    assert empty.count() == 0 and empty.columns == ["word", "doc", "symbol"]


def test_mentions_with_one_word_in_every_text(spark, small_tasks):
    posts = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("acmecorp rises "), F.col("id").cast("string")).alias("text"))
    aliases = spark.createDataFrame([("A", "acmecorp"), ("B", "acme"), ("C", "zeta")], "symbol string, alias string")
    for limit in ("1000", "1"):  # the words known to hold an alias are broadcast, or spread
        spark.conf.set("quantspark.maxBroadcastRows", limit)
        try:
            found = jn.mentions(posts, aliases).groupBy("symbol").count().collect()
        finally:
            spark.conf.unset("quantspark.maxBroadcastRows")
        assert {tuple(r) for r in found} == {("A", 3000), ("B", 3000)}
