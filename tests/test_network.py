import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from catalift import operators as ops
from catalift.operators import network


@pytest.fixture(scope="module")
def data(spark):
    x = F.col("id") % 101
    return spark.range(3_000).select(
        "id",
        x.alias("x"),
        ((F.col("id") * 7) % 13 - 6).cast("float").alias("z z"),
        (F.abs(x - 50) * 2 + (F.col("id") * 7) % 13).alias("y"),
    )


def plain_fit(x, y, hidden, epochs, seed, rate):
    """Predictions of a network fitted to whole arrays."""
    center, spread = x.mean(axis=0), x.std(axis=0)
    low, wide = y.mean(), y.std()
    x, y = (x - center) / spread, (y - low) / wide
    w, b, v, c = network.first_weights(x.shape[1], hidden, seed)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b, v, c)]
    for epoch in range(1, epochs + 1):
        a = x @ w + b
        u = a * (a > 0)
        e = 2 * (u @ v + c[0] - y) / len(y)
        d = e[:, None] * v[None, :] * (a > 0)
        new = []
        for p, g, s in zip((w, b, v, c), (x.T @ d, d.sum(0), u.T @ e, e.sum(keepdims=True)), state):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            new.append(p - rate * s[0] / (1 - 0.9**epoch) / (np.sqrt(s[1] / (1 - 0.999**epoch)) + 1e-8))
        w, b, v, c = new
    return (np.maximum(x @ w + b, 0) @ v + c) * wide + low


@pytest.mark.parametrize("key", [["id"], []])
def test_equals_a_fit_in_one_place(data, key):
    rows = data.orderBy("id").collect()
    x = np.array([[r.x, r["z z"]] for r in rows], float)
    y = np.array([r.y for r in rows], float)
    want = plain_fit(x, y, 20, 15, 3, 0.05)
    model = ops.fit_network(data.repartition(5), ["x", "z z"], "y", hidden=20, epochs=15, seed=3, key=key, partitions=4)
    got = {r.id: r.prediction for r in ops.score(model, data, ["id"]).collect()}
    assert np.allclose([got[r.id] for r in rows], want, rtol=1e-9, atol=1e-9)


def test_a_network_bends_and_is_saved(spark, data, tmp_path):
    model = ops.fit_network(data, ["x"], "y", hidden=30, epochs=60, key=["id"], partitions=3)
    line = ops.fit_linear(data, ["x"], "y")
    errors = [ops.mse(ops.score(m, data, ["id", "y"]), "y").first().mse for m in (model, line)]
    assert errors[0] * 10 < errors[1]
    model.save(f"{tmp_path}/network")
    again = PipelineModel.load(f"{tmp_path}/network")
    assert ops.mse(ops.score(again, data, ["id", "y"]), "y").first().mse == errors[0]
    plan = ops.score(model, data, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nulls_constants_and_no_rows(spark, data):
    with pytest.raises(ValueError, match="NULL"):
        ops.fit_network(data.withColumn("x", F.when(F.col("id") > 3, F.col("x"))), ["x"], "y", epochs=1)
    with pytest.raises(ValueError, match="NULL"):
        ops.fit_network(data.where("id < 0"), ["x"], "y", epochs=1)
    flat = data.withColumn("x", F.lit(4.0))
    model = ops.fit_network(flat, ["x"], "y", hidden=5, epochs=2, partitions=2)
    assert ops.score(model, flat, ["id"]).where("prediction IS NULL OR isnan(prediction)").count() == 0


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    weights = [rng.normal(size=s) for s in ((3, 4), (4,), (4,), (1,))]
    x, y = rng.normal(size=(50, 3)), rng.normal(size=50)

    def loss(parts):
        w, b, v, c = parts
        return ((np.maximum(x @ w + b, 0) @ v + c - y) ** 2).sum()

    for i, slope in enumerate(network.gradient(weights, x, y)):
        for at in np.ndindex(slope.shape):
            moved = [p.copy() for p in weights]
            moved[i][at] += 1e-6
            assert slope[at] == pytest.approx((loss(moved) - loss(weights)) / 1e-6, rel=1e-3, abs=1e-3)


def test_equal_rows_are_one_row_of_the_matrix(spark, data, monkeypatch):
    """An epoch costs what the different rows cost, and the network is that of all rows."""
    sizes, epoch = [], network._epoch
    monkeypatch.setattr(network, "_epoch", lambda matrix, weights: sizes.append(matrix.count()) or epoch(matrix, weights))
    some = data.where("id < 300").select("x", "y")
    often = some.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("x") % 5 + 1)))
    model = ops.fit_network(often, ["x"], "y", hidden=10, epochs=6, seed=2, partitions=2)
    rows = often.orderBy("x", "y").collect()
    want = plain_fit(np.array([[r.x] for r in rows], float), np.array([r.y for r in rows], float), 10, 6, 2, network.RATE)
    got = [r.prediction for r in ops.score(model, often, ["x", "y"]).orderBy("x", "y").collect()]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
    assert set(sizes) == {some.distinct().count()} and some.distinct().count() < often.count()
