"""A network of one hidden layer, fitted by gradients that partitions sum up."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalift.functions.frames import stored
from catalift.functions.names import quoted_parts

# the gradient travels with the tasks: executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Units of the hidden layer, and passes over the training rows.
HIDDEN = 100
EPOCHS = 100

# Step of the optimiser on standardised columns, and its decays.
RATE = 0.05
_DECAY, _DECAY_SQUARES, _EPSILON = 0.9, 0.999, 1e-8

# Partitions of the stored matrix: so many gradients reach the driver in an epoch.
MATRIX_PARTITIONS = 32


def first_weights(features: int, hidden: int, seed: int) -> list:
    """Weights and biases of the two layers before the first epoch: uniform within
    sqrt(6 / (inputs + outputs)) of a layer, biases 0."""
    import numpy as np

    rng = np.random.default_rng(seed)
    sizes = ((features, hidden), (hidden, 1))
    layers = [rng.uniform(-1, 1, size) * np.sqrt(6 / sum(size)) for size in sizes]
    return [layers[0], np.zeros(hidden), layers[1][:, 0], np.zeros(1)]


def gradient(weights: list, x, y, times=1) -> list:
    """Sums over rows, each taken so many times, of the derivatives of the squared error, one array
    for each of the weights."""
    import numpy as np

    w, b, v, c = weights
    inner = x @ w + b
    units = np.maximum(inner, 0)
    error = 2 * (units @ v + c - y) * times
    back = np.outer(error, v) * (inner > 0)
    return [x.T @ back, back.sum(axis=0), units.T @ error, np.array([error.sum()])]


def _epoch(matrix: DataFrame, weights: list) -> list:
    """The gradient over all rows: one array of numbers from each partition."""

    def summed(batches):
        import numpy as np
        import pyarrow as pa

        total = [np.zeros_like(part) for part in weights]
        for batch in batches:
            values = np.column_stack([batch.column(i).to_numpy() for i in range(batch.num_columns)])
            for part, more in zip(total, gradient(weights, values[:, :-2], values[:, -2], values[:, -1])):
                part += more
        flat = np.concatenate([part.ravel() for part in total])
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], ["sums"])

    import numpy as np

    # sorted, so that the order in which partitions end does not count
    parts = sorted(tuple(row["sums"]) for row in matrix.mapInArrow(summed, "sums array<double>").collect())
    flat, out = np.sum(np.array(parts), axis=0), []
    for part in weights:
        out.append(flat[: part.size].reshape(part.shape))
        flat = flat[part.size :]
    return out


def fit_network(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    hidden: int = HIDDEN,
    epochs: int = EPOCHS,
    seed: int = 0,
    key: Sequence[str] = (),
    rate: float = RATE,
    partitions: int = MATRIX_PARTITIONS,
) -> PipelineModel:
    """Least squares by a network of one hidden layer of rectified units.

    Equal rows of features and label are one row with their number, which the gradient takes so
    many times. These rows are standardised and stored once, dealt and sorted by their values, so
    that a `key` is not needed to fix their order. In each
    epoch every partition sums the gradient over its rows; their sum moves the weights, by
    steps that adapt to each of them (Adam). What reaches the driver in an epoch is an array
    of about (features + 2) * hidden numbers for each partition, however many rows there are.
    The same rows, seed and session settings give the same network up to the order of sums.

    A NULL feature or label, or no rows, is an error. The model is one of expressions: it is
    scored without Python, and saved and loaded like the others of this package.
    """
    import numpy as np

    columns = [F.col(quoted_parts(name)).cast("double") for name in (*features, label)]
    facts = df.select(*(c.alias(f"_{i}") for i, c in enumerate(columns))).agg(
        F.count("*").alias("rows"),
        *(f(f"_{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("known", F.count), ("mean", F.mean), ("spread", F.stddev_pop))),
    ).first()
    rows = facts["rows"]
    if not rows or any(facts[f"known{i}"] != rows for i in range(len(columns))):
        raise ValueError("a network is fitted to rows without a NULL")
    mean = [facts[f"mean{i}"] for i in range(len(columns))]
    spread = [facts[f"spread{i}"] or 1.0 for i in range(len(columns))]

    names = [f"_{i}" for i in range(len(columns))]
    matrix = df.select(*(c.alias(name) for c, name in zip(columns, names)))
    matrix = matrix.groupBy(*names).agg(F.count("*").cast("double").alias("_times"))
    matrix = matrix.repartition(partitions, *names).sortWithinPartitions(*names)
    scaled = [((F.col(name) - m) / s).alias(name) for name, m, s in zip(names, mean, spread)]
    matrix = stored(matrix.select(*scaled, "_times"))

    weights = first_weights(len(features), hidden, seed)
    slow, squares = ([np.zeros_like(part) for part in weights] for _ in range(2))
    for epoch in range(1, epochs + 1):
        for i, more in enumerate(_epoch(matrix, weights)):
            more = more / rows
            slow[i] = _DECAY * slow[i] + (1 - _DECAY) * more
            squares[i] = _DECAY_SQUARES * squares[i] + (1 - _DECAY_SQUARES) * more**2
            ahead, size = slow[i] / (1 - _DECAY**epoch), squares[i] / (1 - _DECAY_SQUARES**epoch)
            weights[i] = weights[i] - rate * ahead / (np.sqrt(size) + _EPSILON)
    return _model(weights, features, mean, spread)


def _model(weights: list, features: Sequence[str], mean: list[float], spread: list[float]) -> PipelineModel:
    """The network on the columns as they are: standardising goes into the weights."""
    import numpy as np

    w, b, v, c = weights
    w = w / np.array(spread[:-1])[:, None]
    b = b - np.array(mean[:-1]) @ w
    v, c = v * spread[-1], c * spread[-1] + mean[-1]
    number = lambda x: f"{float(x)!r}D"
    units = ", ".join(
        f"struct({', '.join(map(number, w[:, h]))}, {number(b[h])} AS bias, {number(v[h])} AS weight)" for h in range(len(v))
    )
    inner = " + ".join(
        ["u.bias", *(f"u.col{i + 1} * CAST({quoted_parts(name)} AS DOUBLE)" for i, name in enumerate(features))]
    )
    output = f"aggregate(array({units}), {number(c[0])}, (a, u) -> a + u.weight * greatest(0D, {inner}))"
    return PipelineModel(
        [
            VectorAssembler(inputCols=list(features), outputCol="_features"),
            SQLTransformer(statement=f"SELECT *, {output} AS _prediction FROM __THIS__"),
        ]
    )
