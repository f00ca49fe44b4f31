import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalift import plans
from catalift.plans import compare

SCHEMA = "k INT, part STRING, v DOUBLE, tags ARRAY<STRING>"


def _expected(a, b):
    """By bags of rows."""
    a, b = Counter((r[0], r[1], r[2], tuple(r[3] or ["<null>"])) for r in a), Counter((r[0], r[1], r[2], tuple(r[3] or ["<null>"])) for r in b)
    out = {}
    for row in {*a, *b}:
        more = a[row] - b[row]
        gone, new = out.get(row[:2], (0, 0))
        out[row[:2]] = (gone + max(more, 0), new + max(-more, 0))
    kind = lambda gone, new: "REMOVED" if not new else "ADDED" if not gone else "CHANGED"
    return {(*key, kind(*n), *n) for key, n in out.items() if n != (0, 0)}


@pytest.mark.parametrize("bucket_rows", [20, 100_000])
@pytest.mark.parametrize("keys", [["k", "part"], ["part", "k"]])
def test_planted_changes_are_found(spark, keys, bucket_rows):
    rng = random.Random(7)
    rows = [(rng.choice([i, i, None]), rng.choice("abc"), rng.choice([0.5, None, float(i)]), rng.choice([None, ["x"], ["y", None]])) for i in range(600)]
    other = [r for r in rows if rng.random() > 0.02]
    other = [(r[0], r[1], 9.25, r[3]) if rng.random() < 0.02 else r for r in other] + rows[:3] + [(-5, "z", 1.0, None)]
    a, b = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (rows, other))
    found = plans.differences(a, b.select("v", "tags", "part", "k"), keys, bucket_rows)
    assert found.columns == [*keys, "change", "source_rows", "target_rows"]
    assert {tuple(r) for r in found.select("k", "part", "change", "source_rows", "target_rows").collect()} == _expected(rows, other)


def test_equal_and_empty_tables(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    assert plans.differences(df, df.repartition(5), ["k"], 50).count() == 0
    none = df.where("k < 0")
    assert plans.differences(none, none, ["k"]).count() == 0
    assert {r.change for r in plans.differences(none, df, ["k"], 50).collect()} == {"ADDED"}
    assert plans.differences(df, none, ["k"], 50).where("change = 'REMOVED' AND source_rows = 1").count() == 1000
    with pytest.raises(ValueError, match="other columns"):
        plans.differences(df, df.withColumn("v", F.col("v").cast("int")), ["k"])


def test_only_ranges_that_differ_are_read(spark, tmp_path, monkeypatch):
    df = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    df.repartitionByRange(20, "k").sortWithinPartitions("k").write.parquet(f"{tmp_path}/a")
    df.withColumn("v", F.expr("IF(k IN (17, 25000), -1, v)")).repartitionByRange(20, "k").write.parquet(f"{tmp_path}/b")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    seen = []
    spans = compare._spans
    monkeypatch.setattr(compare, "_spans", lambda *args: seen.append(spans(*args)) or seen[-1])
    found = plans.differences(a, b, ["k"], 500)
    assert {tuple(r) for r in found.collect()} == {(17, "CHANGED", 1, 1), (25000, "CHANGED", 1, 1)}
    read = a.where(seen[0])
    assert len(read.collect()) < 2_500
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numOutputRows").get().value() <= 3 * 2_000  # of 20 files, row groups of 2 or 3
    assert "PushedFilters: [Or(" in read._jdf.queryExecution().executedPlan().toString()


def test_the_tree_is_followed_where_it_differs(spark):
    columns = "bucket INT, rows BIGINT, sum0 BIGINT, sum1 BIGINT, sum2 BIGINT, sum3 BIGINT"
    a = [(i, 10, i, 2, 3, 4) for i in range(3000)]
    b = [(i, 10, i + (i in (5, 2999)), 2, 3, 4) for i in range(3000) if i != 70]
    found = compare._differing(*(spark.createDataFrame(side, columns) for side in (a, b)))
    assert sorted(r.bucket for r in found.collect()) == [5, 70, 2999]
    assert compare._differing(*(spark.createDataFrame(a, columns) for _ in range(2))).count() == 0


def test_keys_that_come_twice_are_dropped_before_they_are_gathered(spark, monkeypatch):
    """An array of structs finds equal ones by comparing all with all."""
    plans_seen, stored = [], compare.stored
    monkeypatch.setattr(compare, "stored", lambda df: plans_seen.append(df._jdf.queryExecution().analyzed().toString()) or stored(df))
    keys = spark.range(9_000).select((F.col("id") % 6_000).alias("k"))
    cuts = compare._cuts(keys, ["k"], 60).first()["_cuts"]
    assert [c.k for c in cuts] == sorted({c.k for c in cuts}) and len(cuts) == 6_000 // 60
    assert "array_distinct" not in plans_seen[0]
