"""Trees by doubling against the walks of one task."""

import datetime as dt
import random

from pyspark.sql import functions as F

from talkmill.operators import tree

SCHEMA = "conv_uuid string, uuid string, parent_uuid string, created_at timestamp, seq int, text string"


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_doubling_equals_the_walks(spark):
    rng = random.Random(8)
    rows = []
    for c in range(12):
        n = rng.randrange(1, 60)
        for i in range(n):
            parent = rng.choice([None, f"c{c}.{rng.randrange(n)}", *[f"c{c}.{max(0, i - 1 - rng.randrange(3))}"] * 6, "missing"])
            parent = None if parent == f"c{c}.{i}" and i % 2 else parent  # some are their own parents
            rows.append((f"c{c}", f"c{c}.{i}", parent, dt.datetime(2024, 1, 1 + rng.randrange(20)) if i % 5 else None, i, "t"))
    df = spark.createDataFrame(rows, SCHEMA).cache()
    wanted = df.select("conv_uuid", F.col("uuid").alias("leaf")).unionByName(spark.createDataFrame([("c1", "c2.0"), ("c1", "nothing")], "conv_uuid string, leaf string"))
    leaf, paths = rows_of(tree.newest_leaf_per_node(df)), rows_of(tree.paths_to(df, wanted))
    assert leaf and paths
    for large in (0, 20):
        assert rows_of(tree.newest_leaf_per_node(df, large)) == leaf
        assert rows_of(tree.paths_to(df, wanted, large)) == paths


def test_a_chain_of_many_messages(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("c").alias("conv_uuid"), F.col("id").cast("string").alias("uuid"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_uuid"), F.lit(None).cast("timestamp").alias("created_at"), F.col("id").cast("int").alias("seq"), F.lit("t").alias("text"))
    path = tree.paths_to(df, spark.createDataFrame([("c", str(n - 1))], "conv_uuid string, leaf string"))
    assert path.filter(F.col("depth").cast("string") == F.col("uuid")).count() == path.count() == n
    newest = tree.newest_leaf_per_node(df)
    assert newest.filter(F.col("leaf") == str(n - 1)).count() == newest.count() == n
