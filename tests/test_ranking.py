import bisect
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalift.operators import number_within, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group; keys of each group distinct, with gaps and signs."""
    rng = random.Random(3)
    keys = rng.sample(range(-2_000, 10_000), 3_000)
    return spark.createDataFrame(
        [("hot" if i % 3 == 0 else f"g{i % 17}", k, str(i)) for i, k in enumerate(keys)],
        "g STRING, k BIGINT, payload STRING",
    ).repartition(7)


@pytest.mark.parametrize("span", [10, 300, 1 << 20])
@pytest.mark.parametrize("groups", [["g"], []])
def test_equals_a_window(skewed, rows, groups, span):
    plain = F.row_number().over(Window.partitionBy(*groups).orderBy("k")).cast("bigint")
    expected = skewed.withColumn("n", plain)
    found = number_within(skewed, groups, "k", "n", span)
    assert found.schema == expected.schema or found.dtypes == expected.dtypes
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("span", [10, 300, 1_000_000])
def test_follows_on_a_start(skewed, span):
    after = skewed.sparkSession.createDataFrame([("hot", 500), ("none", 7)], "g STRING, start BIGINT")
    found = number_within(skewed, ["g"], "k", "n", span, after=after).groupBy("g").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("rows")
    )
    for r in found.collect():
        start = 500 if r.g == "hot" else 0
        assert (r.low, r.high) == (start + 1, start + r.rows)


def test_sparse_order(spark, rows):
    """Keys spread over the whole BIGINT range."""
    rng = random.Random(5)
    low = -(1 << 63)
    keys = [low + rng.getrandbits(64) for _ in range(500)] + [low, -low - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k BIGINT").repartition(4)
    found = number_within(df, [], "k", "n", span=100)
    assert rows(found) == [(k, i) for i, k in enumerate(sorted(keys), start=1)]


def test_null_groups_and_no_rows(spark, rows):
    df = spark.createDataFrame([(None, k) for k in range(500)] + [("a", 1)], "g STRING, k INT").repartition(3)
    found = number_within(df, ["g"], "k", "n", span=40)
    assert rows(found) == rows(df.withColumn("n", F.when(F.col("g") == "a", 1).otherwise(F.col("k") + 1)))
    assert number_within(df.where("k < 0"), ["g"], "k", span=1).count() == 0


def test_orders_need_not_be_integers(spark, rows):
    df = spark.range(2000).select(F.expr("timestamp_seconds(id * 7)").alias("t"), "id", F.lit(None).alias("void"))
    found = number_within(df, [], "t", "n", span=90)
    assert found.columns == ["t", "id", "void", "n"]
    assert found.where("n <> id + 1 OR n IS NULL OR void IS NOT NULL").count() == 0


def test_the_input_is_evaluated_once(spark, skewed):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(value):
        seen.add(1)
        return value

    counted = skewed.withColumn("payload", noted("payload"))
    found = number_within(counted, ["g"], "k", "n", 300)
    assert found.count() == found.agg(F.count("payload")).first()[0] == 3000
    assert seen.value == 3000


def test_whole_rows_are_shuffled_once_and_large_groups_cut(skewed):
    found = number_within(skewed, ["g"], "k", "n", 300)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if " Exchange " in line]
    assert len(exchanges) == 1 and "hashpartitioning(g#" in exchanges[0] and "_piece" in exchanges[0]
    whole = number_within(skewed, ["g"], "k", "n")._jdf.queryExecution().executedPlan().toString()
    assert whole.count(" Exchange ") == 1 and "_piece" not in whole


def test_pieces_are_even(skewed):
    pieces = []
    for bound in (100, 700):
        cuts = ranking._cuts(skewed, ["g"], "k", bound)
        cut = ranking.with_few(skewed, cuts, ["g"], "_cuts").where("_cuts IS NOT NULL")
        sizes = cut.groupBy("g", ranking.piece_of(F.col("_cuts"), F.col("k"))).count()
        pieces.append([r["count"] for r in sizes.collect()])
    assert len(pieces[0]) > 25 and max(pieces[0]) <= 250
    assert {r.g for r in ranking._cuts(skewed, ["g"], "k", 700).collect()} == {"hot"}


def test_a_row_meets_short_arrays_however_many_cuts(spark, monkeypatch):
    """A joined array is copied into every row: 3,000 cuts of one group and 10 of another."""
    bounds = {"a": [7 * i for i in range(3_000)], "b": list(range(10)), "c": []}
    cuts = spark.createDataFrame([*bounds.items()], "g STRING, _cuts ARRAY<BIGINT>")
    rows = spark.createDataFrame([(g, k) for g in "abcd" for k in (-1, *range(0, 22_000, 3), None)], "g STRING, k BIGINT")
    longest, with_few = [], ranking.with_few

    def noted(rows, few, keys, value):
        longest.append(few.agg(F.max(F.size(value))).first()[0])
        return with_few(rows, few, keys, value)

    monkeypatch.setattr(ranking, "with_few", noted)
    found = ranking.with_piece(rows, cuts, ["g"], F.col("k"), "n")
    assert all(r.n == (0 if r.k is None else bisect.bisect_left(bounds.get(r.g, []), r.k)) for r in found.collect())
    assert found.count() == rows.count() and max(longest) <= ranking.BLOCK
