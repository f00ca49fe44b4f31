import random

import pytest
from pyspark.sql import functions as F

from catalift.operators import cleanup_candidates, inventory_profile, owned_not_marked, sample_head, top_n

CATALOGS = "catalog_name STRING, catalog_owner STRING"
TAGS = "catalog_name STRING, tag_name STRING"


def survivors(spark, keys, tags):
    catalogs = spark.createDataFrame([(k, "me") for k in keys] + [("theirs", "other")], CATALOGS)
    marks = spark.createDataFrame(tags, TAGS)
    kept = owned_not_marked(catalogs, marks, owner="me").collect()
    return sorted((r.catalog_name for r in kept), key=lambda k: (k is not None, k))


def test_marked_in_any_case_and_repeatedly(spark):
    tags = [("a", "Remove_x"), ("a", "REMOVE"), ("b", "keep"), ("c", "to_remove"), ("b", None)]
    assert survivors(spark, ["a", "b", "c"], tags) == ["b", "c"]


def test_a_null_mark_removes_every_row(spark):
    assert survivors(spark, ["a", None], [(None, "remove"), ("b", "remove")]) == []


def test_a_null_mark_with_another_tag_does_not_count(spark):
    assert survivors(spark, ["a", None], [(None, "keep")]) == [None, "a"]


def test_a_null_key_is_removed_if_anything_is_marked(spark):
    assert survivors(spark, ["a", None], [("b", "remove")]) == ["a"]


def test_nothing_marked_keeps_every_row(spark):
    assert survivors(spark, ["a", None], []) == [None, "a"]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_equals_not_in_on_random_frames(spark, rows, broadcast):
    rng = random.Random(7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", broadcast)
    try:
        for _ in range(12):
            keys = ["k1", "k2", "k3", "k4"] + ([None] if rng.random() < 0.5 else [])
            marked = ["k1", "k2"] + ([None] if rng.random() < 0.3 else [])
            catalogs = spark.createDataFrame(
                [(rng.choice(keys), rng.choice(["me", "other"])) for _ in range(20)], CATALOGS
            )
            marks = spark.createDataFrame(
                [(rng.choice(marked), rng.choice(["Remove", "keep"])) for _ in range(rng.randint(0, 4))],
                TAGS,
            )
            catalogs.createOrReplaceTempView("catalogs")
            marks.createOrReplaceTempView("catalog_tags")
            expected = spark.sql(
                """SELECT * FROM catalogs WHERE catalog_owner = 'me' AND catalog_name NOT IN
                   (SELECT catalog_name FROM catalog_tags WHERE lower(tag_name) LIKE 'remove%')"""
            )
            assert rows(owned_not_marked(catalogs, marks, owner="me")) == rows(expected)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.catalog.dropTempView("catalogs")
        spark.catalog.dropTempView("catalog_tags")


def test_hot_key_is_split(spark, tmp_path):
    """A third of the rows share a key, and the marked keys are too many to broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    n = 300_000
    hot = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
    spark.range(0, n, 1, 8).select(hot.alias("key"), "id", F.lit("me").alias("owner")).write.parquet(
        f"{tmp_path}/left"
    )
    spark.range(0, n, 1, 8).select(F.col("id").alias("key"), F.lit("remove").alias("tag_name")).where(
        "key % 2 = 1"
    ).write.parquet(f"{tmp_path}/marks")
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        kept = owned_not_marked(
            spark.read.parquet(f"{tmp_path}/left"),
            spark.read.parquet(f"{tmp_path}/marks"),
            key="key",
            owner_col="owner",
            owner="me",
        )
        assert len(kept.collect()) == n // 3 + n // 3
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
        assert "ReusedExchange" in plan
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_cleanup_candidates(spark, rows):
    inventory = spark.createDataFrame(
        [("app_old", "t1"), ("app_old", "t2"), ("tmp_x", "t"), ("prod", "t")], "db STRING, `table` STRING"
    )
    assert rows(cleanup_candidates(inventory, ["old", "tmp"])) == [("app_old",), ("tmp_x",)]
    assert cleanup_candidates(inventory, []).count() == 0


def test_profile_counts_labels_and_order(spark):
    inventory = spark.createDataFrame(
        [("MANAGED", "HIVE")] * 2 + [("VIEW", None)] + [("EXTERNAL", "delta")] * 2 + [("EXTERNAL", "HIVE")],
        "type STRING, format STRING",
    )
    assert [tuple(r) for r in inventory_profile(inventory).collect()] == [
        ("EXTERNAL", "delta", 2, "null"),
        ("MANAGED", "HIVE", 2, "difficult"),
        ("EXTERNAL", "HIVE", 1, "difficult"),
        ("VIEW", None, 1, "null"),
    ]


def test_previews(spark):
    df = spark.createDataFrame([("b",), ("c",), ("a",)], "name STRING")
    assert [r.name for r in sample_head(df, 2, ["name"]).collect()] == ["a", "b"]
    assert sample_head(df, 2).count() == 2
    assert [r.name for r in top_n(df, "name").collect()] == ["c"]
    assert "TakeOrderedAndProject" in top_n(df, "name")._jdf.queryExecution().executedPlan().toString()
