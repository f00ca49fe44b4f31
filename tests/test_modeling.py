import math
import re

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from catalift import operators as ops
from catalift.operators import forest as cells
from catalift.operators import modeling


@pytest.fixture(scope="module")
def data(spark):
    x = F.col("id") % 100
    return spark.range(2_000).select(
        "id",
        x.cast("double").alias("x"),
        ((F.col("id") * 7) % 13).cast("double").alias("z"),
        (x * 3 + 5).cast("double").alias("y"),
    )


def test_linear_fit_is_exact(data):
    model = ops.fit_linear(data, ["x", "z"], "y")
    scored = ops.score(model, data, ["id", "y"])
    assert scored.columns == ["id", "y", "prediction"]
    assert ops.mse(scored, "y").first().mse < 1e-18
    assert scored.count() == 2_000


def test_mse_per_group(spark, rows):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 1.0, 1.0), ("b", 2.0, 5.0)], "g STRING, y DOUBLE, prediction DOUBLE")
    assert rows(ops.mse(df, "y", by=["g"])) == [("a", 2.0, 0), ("b", 9.0, 0)]
    more = df.unionAll(df.sparkSession.createDataFrame([("b", 1.0, None)], df.schema))
    assert rows(ops.mse(more, "y", by=["g"])) == [("a", 2.0, 0), ("b", 9.0, 1)]
    assert ops.mse(df, "y").first().mse == pytest.approx(13 / 3)


def test_forest_repeats_with_a_key(data, rows):
    fit = dict(features=["x", "z"], label="y", trees=7, key=["id"], partitions=3)
    first = ops.score(ops.fit_forest(data, **fit), data, ["id"])
    second = ops.score(ops.fit_forest(data.repartition(5), **fit), data, ["id"])
    assert rows(first) == rows(second)
    other = ops.score(ops.fit_forest(data, seed=9, **fit), data, ["id"])
    assert rows(other) != rows(first)


def test_more_rows_make_more_partitions(data, rows, monkeypatch):
    """What a task reads of the rows does not grow with them, and no place is stored per tree."""
    dealt, fit = [], modeling.RandomForestRegressor.fit
    monkeypatch.setattr(modeling.RandomForestRegressor, "fit", lambda self, df: dealt.append((df.rdd.getNumPartitions(), self.getCacheNodeIds())) or fit(self, df))
    few = ops.fit_forest(data, ["x", "z"], "y", trees=2, key=["id"])
    assert dealt == [(modeling.FIT_PARTITIONS, False)]
    fixed = ops.fit_forest(data, ["x", "z"], "y", trees=2, key=["id"], partitions=modeling.FIT_PARTITIONS)
    assert rows(ops.score(few, data, ["id"])) == rows(ops.score(fixed, data, ["id"]))
    monkeypatch.setattr(modeling, "FIT_ROWS", 33)
    ops.fit_forest(data, ["x", "z"], "y", trees=2, key=["id"])
    assert dealt[-1] == (-(-2_000 // 33), False)


def test_forest_learns(data):
    forest = ops.fit_forest(data, ["x", "z"], "y", trees=20, key=["id"])
    scored = ops.score(forest, data, ["y"])
    variance = data.agg(F.var_pop("y")).first()[0]
    assert ops.mse(scored, "y").first().mse < 0.02 * variance


def test_groups_of_trees_make_one_forest(data, tmp_path):
    """The forest predicts the mean of its trees, whatever the groups."""
    forest = ops.fit_forest(data, ["x"], "y", trees=7, trees_per_fit=3)
    groups = forest.stages[1:-1]
    assert [g.getNumTrees for g in groups] == [3, 3, 1]
    row = data.where("id = 42")
    vector = forest.stages[0].transform(row).first()["_features"]
    trees = [tree.predict(vector) for group in groups for tree in group.trees]
    assert ops.score(forest, row, []).first().prediction == pytest.approx(sum(trees) / 7)
    forest.save(f"{tmp_path}/forest")
    again = PipelineModel.load(f"{tmp_path}/forest")
    assert ops.score(again, row, []).first() == ops.score(forest, row, []).first()


def test_forest_looks_at_all_features(data):
    forest = ops.fit_forest(data, ["x", "z"], "y", trees=2)
    assert forest.stages[1].getFeatureSubsetStrategy() == "all"


def test_trees_from_sums_are_those_of_spark(data):
    """Where no row is drawn at random, splits and predictions equal those of Spark's fit."""
    noisy = data.withColumn("y", F.col("y") + F.col("z") * F.col("z") + F.pmod(F.xxhash64("id"), F.lit(50))).repartition(3)
    assembler = modeling._assembler(["x", "z"])
    spark_own = modeling.RandomForestRegressor(featuresCol="_features", labelCol="y", numTrees=2, featureSubsetStrategy="all", bootstrap=False)
    expected = spark_own.fit(assembler.transform(noisy))
    found = cells.fit_by_cells(noisy, 2_000, ["x", "z"], "y", [(2, 0)], 5, "_features", "_prediction", bootstrap=False)[0]
    nodes = lambda model: [line for line in model.toDebugString.split("\n")[1:] if "Predict" not in line]
    leaves = lambda model: [float(line.split(":")[1]) for line in model.toDebugString.split("\n") if "Predict" in line]
    assert len(leaves(expected)) > 40
    assert nodes(found) == nodes(expected)
    assert leaves(found) == pytest.approx(leaves(expected), rel=1e-9)
    assert list(found.featureImportances) == pytest.approx(list(expected.featureImportances))


def test_bounds_of_a_feature():
    assert cells.bounds([3.0] * 9) == []
    assert cells.bounds([1.0, 4.0, 4.0, 2.0]) == [1.5, 3.0]
    assert cells.bounds(range(64)) == [2 * i + 1.5 for i in range(31)]
    # after a value of most rows the next ones are parted
    hot = cells.bounds([0.0] * 900 + list(range(1, 101)))
    assert len(hot) <= 31 and hot[:3] == [0.5, 1.5, 2.5]


def test_draws_are_poisson_and_follow_from_row_and_seed():
    rows = np.arange(20_000)
    times = cells.draws(rows, 7, 3)
    assert (cells.draws(rows[5_000:6_000], 7, 3) == times[5_000:6_000]).all()
    assert (cells.draws(rows, 7, 4) != times).any()
    assert np.abs(np.corrcoef(times.T) - np.eye(7)).max() < 0.04
    for n in range(5):
        assert (times == n).mean() == pytest.approx(math.exp(-1) / math.factorial(n), abs=0.005)
    assert times.mean() == pytest.approx(1, abs=0.01) and times.var() == pytest.approx(1, abs=0.03)


@pytest.fixture
def by_cells(monkeypatch):
    """Forests of the small tables here are grown from sums, as those of many rows are."""
    monkeypatch.setattr(modeling, "SPARK_FIT_ROWS", 1_000)
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 1)

    def refused(self, df):
        raise AssertionError("a pass for every level")

    monkeypatch.setattr(modeling.RandomForestRegressor, "fit", refused)


def test_many_rows_are_read_once_for_all_levels(by_cells, spark, data, tmp_path):
    noisy = data.withColumn("y", F.col("y") + F.pmod(F.xxhash64("id"), F.lit(50)))
    forest = ops.fit_forest(noisy, ["x", "z"], "y", trees=20, key=["id"], trees_per_fit=8)
    groups = forest.stages[1:-1]
    assert [g.getNumTrees for g in groups] == [8, 8, 4]
    scored = forest.transform(noisy)
    mean = (F.col("_prediction_0") * 8 + F.col("_prediction_1") * 8 + F.col("_prediction_2") * 4) / 20
    assert scored.where(F.abs(F.col("_prediction") - mean) > 1e-9).count() == 0
    assert len({tree.toDebugString for group in groups for tree in group.trees}) == 20
    # every tree drew about as many rows as there are
    roots = [spark.read.parquet(f"{path}/data").where("nodeData.id = 0") for path in saved(groups, tmp_path)]
    drawn = [row[0] for df in roots for row in df.select("nodeData.rawCount").collect()]
    assert len(set(drawn)) > 10 and all(abs(n - 2_000) < 250 for n in drawn)
    variance = noisy.agg(F.var_pop("y")).first()[0]
    result = ops.score(forest, noisy, ["id", "y"])
    assert ops.mse(result, "y").first().mse < 0.05 * variance
    # the trees are not walked for a score
    assert result._jdf.queryExecution().optimizedPlan().toString().count("UDF(") == 0
    forest.save(f"{tmp_path}/forest")
    again = PipelineModel.load(f"{tmp_path}/forest")
    row = noisy.where("id = 42")
    assert ops.score(again, row, []).first() == ops.score(forest, row, []).first()


def saved(groups, tmp_path):
    for number, group in enumerate(groups):
        group.save(f"{tmp_path}/{number}")
        yield f"{tmp_path}/{number}"


def test_forest_from_sums_repeats(by_cells, data, rows):
    """Also where keys come twice, or are NULL."""
    twice = data.withColumn("id", F.when(F.col("id") > 100, F.col("id") % 50))
    fit = dict(features=["x", "z"], label="y", trees=5, key=["id"], partitions=6)
    first = ops.score(ops.fit_forest(twice, **fit), data, ["id"])
    second = ops.score(ops.fit_forest(twice.repartition(5), **fit), data, ["id"])
    assert rows(first) == rows(second)
    assert rows(ops.score(ops.fit_forest(twice, seed=9, **fit), data, ["id"])) != rows(first)


def test_trees_do_not_depend_on_passes(by_cells, data, rows, monkeypatch):
    """What a task holds is bounded; more trees or cells take more passes."""
    groups = [(3, 0), (3, 1), (3, 2), (1, 3)]
    assert cells.passes(groups, 2**15) == [groups]
    fit = dict(features=["x", "z"], label="y", trees=10, key=["id"], partitions=6, trees_per_fit=3)
    expected = rows(ops.score(ops.fit_forest(data, **fit), data, ["id"]))
    monkeypatch.setattr(cells, "HELD_SUMS", 32 * 13 * 6)
    assert cells.passes(groups, 32 * 13) == [groups[:2], groups[2:]]
    assert cells.passes(groups, 2**15) == [[group] for group in groups]
    assert rows(ops.score(ops.fit_forest(data, **fit), data, ["id"])) == expected


def test_forest_from_sums_refuses_what_it_does_not_know(by_cells, data):
    for value in (None, float("nan")):
        for name in ("x", "y"):
            holed = data.withColumn(name, F.when(F.col("id") != 7, F.col(name)).otherwise(F.lit(value).cast("double")))
            with pytest.raises(Exception, match="without a NULL"):
                ops.fit_forest(holed, ["x", "z"], "y", trees=2, key=["id"])
        forest = ops.fit_forest(data, ["x", "z"], "y", trees=2, key=["id"])
        with pytest.raises(Exception, match="without a NULL"):
            ops.score(forest, data.limit(1).withColumn("z", F.lit(value).cast("double")), ["id"]).collect()


def test_forest_of_one_value(by_cells, data):
    forest = ops.fit_forest(data.withColumn("x", F.lit(1.0)), ["x"], "y", trees=2, key=["id"])
    assert ops.score(forest, data, ["x"]).distinct().count() == 100
    assert ops.score(forest, data, []).distinct().count() == 1


def test_too_many_cells_are_left_to_spark(data, rows, monkeypatch):
    fit = dict(features=["x", "z"], label="y", trees=3, key=["id"], partitions=3)
    expected = rows(ops.score(ops.fit_forest(data, **fit), data, ["id"]))
    monkeypatch.setattr(modeling, "SPARK_FIT_ROWS", 1_000)
    monkeypatch.setattr(cells, "MAX_CELLS", 32 * 13 - 1)
    assert rows(ops.score(ops.fit_forest(data, **fit), data, ["id"])) == expected


@pytest.fixture(scope="module")
def models(data):
    return {
        ("a", 1): ops.fit_linear(data, ["x"], "y"),
        ("a", 2): ops.fit_linear(data.withColumn("y", F.col("x") * 0 + 1), ["x"], "y"),
        ("b", 1): ops.fit_forest(data.withColumn("y", F.lit(7.0)), ["x", "z"], "y", trees=2),
    }


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame(
        [
            ("a", "Champion", "1"),
            ("a", "Challenger", "2"),
            ("b", "Champion", "1"),
            ("b", "Challenger", "10"),
            ("c", "Champion", "1"),
        ],
        "name STRING, alias STRING, version STRING",
    )


def scored_by_name(df):
    return {r.id: (r.version, r.prediction and round(r.prediction, 6)) for r in df.collect()}


def test_score_by_one_alias(spark, data, aliases, models):
    rows = data.where("id < 4").withColumn("model", F.array(*map(F.lit, "abcd"))[F.col("id").cast("int")])
    champions = ops.score_by_alias(rows, aliases, models, ["id"], alias="Champion")
    assert champions.columns == ["id", "version", "prediction"]
    assert scored_by_name(champions) == {0: (1, 5.0), 1: (1, 7.0), 2: (None, None), 3: (None, None)}
    challengers = ops.score_by_alias(rows, aliases, models, ["id"], alias="Challenger")
    assert scored_by_name(challengers) == {0: (2, 1.0), 1: (None, None), 2: (None, None), 3: (None, None)}


def test_score_by_alias_per_row(data, aliases, models):
    rows = data.where("id IN (5, 6)").withColumn("model", F.lit("a")).withColumn(
        "alias", F.when(F.col("id") == 5, "Champion").otherwise("Challenger")
    )
    found = ops.score_by_alias(rows, aliases, models, ["id"])
    # rows and aliases were joined once, before; a model meets the rows of its version only
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "Join" not in plan
    assert plan.count("UDF(") == 6  # to assemble and to predict, for three models with an alias
    assert len(re.findall(r"PartitionFilters: \[isnotnull\(_model#\d+\), \(_model#\d+ = -?\d+\)\]", plan)) == 4
    assert len(found.inputFiles()) == 2
    assert scored_by_name(found) == {5: (1, 20.0), 6: (2, 1.0)}


def test_rows_are_read_once_for_any_number_of_versions(spark, data, models):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(value):
        seen.add(1)
        return value

    many = {(f"m{n}", 1): models["a", 1 + n % 2] for n in range(12)}
    aliases = spark.createDataFrame([(name, "Champion", 1) for name, _ in many], "name STRING, alias STRING, version INT")
    rows = data.withColumn("model", noted(F.concat(F.lit("m"), F.col("id") % 13)))
    found = ops.score_by_alias(rows, aliases, many, ["id", "x"], "Champion").collect()
    assert len(found) == seen.value == data.count()
    assert all((r.prediction is None) == (r.id % 13 == 12) for r in found)
    assert all(r.id % 13 % 2 or r.prediction is None or abs(r.prediction - ops.score(models["a", 1], data.where(f"id = {r.id}"), []).first()[0]) < 1e-9 for r in found[:5])


def test_promotion_is_a_change_of_alias(spark, data, aliases, models):
    rows = data.where("id < 10").withColumn("model", F.lit("a"))
    keys = ["id", "y"]
    both = ops.score_by_alias(rows, aliases, models, keys, "Champion").unionAll(
        ops.score_by_alias(rows, aliases, models, keys, "Challenger")
    )
    compared = {r.version: r.mse for r in ops.compare_versions(both, "y").collect()}
    assert compared[1] < 1e-12 < compared[2]
    promoted = aliases.where("alias = 'Champion'").withColumn("version", F.lit("2"))
    after = ops.score_by_alias(rows, promoted, models, keys, "Champion")
    assert {r.version for r in after.collect()} == {2}


SIGNATURE = StructType(
    [
        StructField("sepal length (cm)", DoubleType(), False),
        StructField("petal.width", DoubleType(), False),
        StructField("class", StringType(), True),
        StructField("count", LongType(), True),
    ]
)


def test_conform(spark):
    df = spark.createDataFrame(
        [(1, 2.5, 9, "x")], "`petal.width` INT, `sepal length (cm)` DOUBLE, count INT, extra STRING"
    )
    out = ops.conform(df, SIGNATURE)
    assert out.dtypes == [(f.name, f.dataType.simpleString()) for f in SIGNATURE]
    assert tuple(out.first()) == (2.5, 1.0, None, 9)


def test_conform_rejects(spark):
    with pytest.raises(ValueError, match="sepal length"):
        ops.conform(spark.createDataFrame([(1.0,)], "`petal.width` DOUBLE"), SIGNATURE)
    text = spark.createDataFrame([("1", 1.0)], "`petal.width` STRING, `sepal length (cm)` DOUBLE")
    with pytest.raises(ValueError, match="petal.width"):
        ops.conform(text, SIGNATURE)
    wide = spark.createDataFrame([(1.0, 1.0, 1.5)], "`petal.width` DOUBLE, `sepal length (cm)` DOUBLE, count DOUBLE")
    with pytest.raises(ValueError, match="count"):
        ops.conform(wide, SIGNATURE)


def test_holdout_depends_on_the_key_alone(data, rows):
    first = ops.holdout(data, ["id"])
    assert rows(first) == rows(ops.holdout(data.repartition(11), ["id"]))
    share = first.agg(F.avg(F.col("held_back").cast("int"))).first()[0]
    assert abs(share - 0.2) < 0.04


@pytest.mark.parametrize("n, fraction", [(10, 0.2), (11, 0.2), (7, 0.5), (1, 0.2), (0, 0.2)])
def test_holdout_tail_holds_back_the_last_rows(spark, n, fraction):
    df = spark.range(n).select((F.col("id") * 10).alias("k")).repartition(3)
    held = [r.k for r in ops.holdout_tail(df, "k", fraction, span=25).where("held_back").collect()]
    kept = math.floor(n * (1 - fraction))
    assert sorted(held) == [i * 10 for i in range(kept, n)]
