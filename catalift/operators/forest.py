"""A random forest from sums over cells of binned features: no pass over the rows for each level."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence
from functools import reduce
from math import exp, factorial, prod

from pyspark import cloudpickle
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalift.functions.names import quoted_parts, scratch_dir
from catalift.functions.pool import on_pool

# the sums travel with the tasks: executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values, as in Spark's fit: bins of a feature at most, and rows whose values place their bounds.
BINS = 32
SAMPLE_ROWS = 10_000

# Cells at most, and cells times trees in the sums of a task: 79 MB. More take more passes.
MAX_CELLS = 2**15
HELD_SUMS = 100 * MAX_CELLS

# Rows for each cell that a task takes at least on average, so that the sums it hands on are small
# beside what it read: up to about 33 bytes a row for 300 trees.
ROWS_PER_CELL = 256

# Rows sorted by cell at once, rows weighted at once, and cells in a row of sums.
_BLOCK_ROWS = 2**18
_WEIGHTED_ROWS = 1024
_SLICE_CELLS = 256

# Models that are made at once.
_THREADS = 4

# Below it the impurity of a child counts as none.
_EPSILON = sys.float_info.epsilon

# How often a row is drawn for a tree is Poisson of mean 1; from these 32-bit numbers on it is 1, 2, ...
_ENOUGH = [
    bound
    for bound in (round(2**32 * sum(exp(-1) / factorial(k) for k in range(n + 1))) for n in range(16))
    if bound < 2**32
]

_SUMS = "tree INT, cells BINARY, sums BINARY"
_NODES = (
    "tree INT, id INT, weight DOUBLE, total DOUBLE, squares DOUBLE, gain DOUBLE, "
    "left INT, right INT, feature INT, bin INT"
)
_SAVED = (
    "treeID INT, nodeData STRUCT<id INT, prediction DOUBLE, impurity DOUBLE, impurityStats ARRAY<DOUBLE>, "
    "rawCount BIGINT, gain DOUBLE, leftChild INT, rightChild INT, "
    "split STRUCT<featureIndex INT, leftCategoriesOrThreshold ARRAY<DOUBLE>, numCategories INT>>"
)


def bounds(values, bins: int = BINS) -> list[float]:
    """Where a feature is cut, by a sample of its values: between all of them if they are few, else
    between values at about equal numbers of rows. A value equal to a bound lies below it."""
    import numpy as np

    distinct, counts = np.unique(values, return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middle) < bins:
        return middle.tolist()
    found, before = [], np.cumsum(counts)
    step = target = len(values) / bins
    for i, cut in enumerate(middle.tolist()):
        if abs(before[i] - target) < abs(before[i + 1] - target):
            found.append(cut)
            target += step
    return found


def _mixed(x):
    """The finisher of SplitMix64, in place."""
    import numpy as np

    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def draws(rows, trees: int, seed: int):
    """How often each tree of a group draws each row: a matrix that follows from the numbers of the
    rows and the seed alone."""
    import numpy as np

    gamma, words = 0x9E3779B97F4A7C15, -(-trees // 2)
    start = _mixed(np.array([seed % 2**64], np.uint64))
    first = rows.astype(np.uint64) * np.uint64(words * gamma % 2**64) + start
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(gamma)
    random = _mixed(first[:, None] + steps).view(np.uint32)
    times = np.zeros(random.shape, np.uint8)
    for bound in _ENOUGH:
        more = random >= np.uint32(bound)
        if not more.any():
            break
        times += more.view(np.uint8)
    return times[:, :trees]


def _add_block(total, cells, rows, labels, groups: Sequence[tuple[int, int]], bootstrap: bool) -> None:
    """Add rows to the sums of weight, weight * label and weight * label^2 by cell and tree."""
    import numpy as np

    order = np.argsort(cells, kind="stable")
    cells, rows, labels = cells[order], rows[order], labels[order]
    moments = np.stack([np.ones(len(labels)), labels, labels * labels])
    for start in range(0, len(cells), _WEIGHTED_ROWS):
        part = slice(start, start + _WEIGHTED_ROWS)
        own, known = cells[part], moments[:, part]
        edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        runs = list(zip(own[edges[:-1]].tolist(), edges[:-1], edges[1:]))
        done = 0
        for size, seed in groups:
            weights = draws(rows[part], size, seed).astype(float) if bootstrap else np.ones((len(own), size))
            for cell, a, b in runs:
                total[cell, :, done : done + size] += known[:, a:b] @ weights[a:b]
            done += size


def passes(groups: Sequence[tuple[int, int]], cells: int) -> list[list[tuple[int, int]]]:
    """The groups in lists whose sums a task can hold, one group at least in each."""
    found: list[list[tuple[int, int]]] = []
    for group in groups:
        if found and cells * sum(size for size, _ in (*found[-1], group)) <= HELD_SUMS:
            found[-1].append(group)
        else:
            found.append([group])
    return found


def cell_sums(
    data: DataFrame, cuts: list[list[float]], groups: Sequence[tuple[int, int]], bootstrap: bool, first: int = 0
) -> DataFrame:
    """Rows of sums by tree and cell, several from every task; the trees are numbered from `first`. `data`
    has the number of a row, its features and its label."""
    shape = [len(cut) + 1 for cut in cuts]
    trees = sum(size for size, _ in groups)

    def summed(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((prod(shape), 3, trees))
        held, size = [], 0

        def add():
            cells, rows, labels = (np.concatenate(part) for part in zip(*held))
            _add_block(total, cells, rows, labels, groups, bootstrap)

        for batch in batches:
            rows, *values, labels = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            cells = np.zeros(len(rows), np.int64)
            for cut, value in zip(cuts, values):
                cells = cells * (len(cut) + 1) + np.searchsorted(cut, value, side="left")
            if not all(np.isfinite(column).all() for column in (*values, labels)):
                raise ValueError("a forest is fitted to rows without a NULL, NaN or infinite value")
            held.append((cells.astype(np.uint16), rows, labels))
            size += len(rows)
            if size >= _BLOCK_ROWS:
                add()
                held, size = [], 0
        if held:
            add()
        present = np.flatnonzero(total[:, 0].any(axis=1)).astype(np.int32)
        slices = [present[a : a + _SLICE_CELLS] for a in range(0, len(present), _SLICE_CELLS)]
        for tree in range(trees if slices else 0):
            columns = [
                pa.array([first + tree] * len(slices), pa.int32()),
                pa.array([cells.tobytes() for cells in slices], pa.binary()),
                pa.array([total[cells, :, tree].tobytes() for cells in slices], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "cells", "sums"])

    return data.mapInArrow(summed, _SUMS)


def _impurity(sums):
    """Variance from sums of weight, weight * label and weight * label^2 in the last axis."""
    weight, total, squares = (sums[..., i] for i in range(3))
    return (squares - total * total / weight) / weight


def grow(sums, max_depth: int) -> list[list]:
    """The nodes of one tree from its sums by bins of the features, parents first: id, the three sums,
    gain, children, feature and bin of the split. A leaf has -1 for the last five.

    A node is a box of bins. As in Spark's fit it is split where the variance falls most, of equal
    splits at the first; leaves of one parent with equal predictions are joined.
    """
    import numpy as np

    features = range(sums.ndim - 1)

    def split(box):
        whole = box.reshape(-1, 3).sum(axis=0)
        best = (0.0, -1, -1)
        for feature in features:
            by_bin = box.sum(axis=tuple(f for f in features if f != feature))
            left = by_bin.cumsum(axis=0)[:-1]
            right = whole - left
            valid = np.flatnonzero((left[:, 0] >= 1) & (right[:, 0] >= 1))
            if not len(valid):
                continue
            left, right = left[valid], right[valid]
            kept = left[:, 0] / whole[0] * _impurity(left) + right[:, 0] / whole[0] * _impurity(right)
            gains = _impurity(whole) - kept
            first = int(np.argmax(gains))
            if gains[first] > best[0]:
                best = (float(gains[first]), feature, int(valid[first]))
        return whole, best

    def subtree(box, depth: int, first: int) -> list[list]:
        whole = box.reshape(-1, 3).sum(axis=0)
        leaf = [[first, *whole.tolist(), -1.0, -1, -1, -1, -1]]
        if depth == max_depth or not whole[0] or (depth and abs(_impurity(whole)) < _EPSILON):
            return leaf
        whole, (gain, feature, at) = split(box)
        if feature < 0:
            return leaf
        cut = lambda part: box[(slice(None),) * feature + (part,)]
        left = subtree(cut(slice(None, at + 1)), depth + 1, first + 1)
        right = subtree(cut(slice(at + 1, None)), depth + 1, first + 1 + len(left))
        if len(left) == len(right) == 1 and left[0][2] / left[0][1] == right[0][2] / right[0][1]:
            return leaf
        # a child's bins are counted from the first of its box
        for node in right:
            if node[7] == feature:
                node[8] += at + 1
        return [[first, *whole.tolist(), gain, first + 1, first + 1 + len(left), feature, at], *left, *right]

    return subtree(sums, 0, 0)


def grown(sums: DataFrame, trees: int, shape: list[int], max_depth: int) -> DataFrame:
    """The nodes of all trees; the sums of a tree meet in one task."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        whole: dict = {}
        for batch in batches:
            for tree, cells, part in zip(*(column.to_pylist() for column in batch.columns)):
                if tree not in whole:
                    whole[tree] = np.zeros((prod(shape), 3))
                whole[tree][np.frombuffer(cells, np.int32)] += np.frombuffer(part).reshape(-1, 3)
        schema = pa.schema(
            [(name, pa.float64() if kind == "DOUBLE" else pa.int32()) for name, kind in (c.split() for c in _NODES.split(", "))]
        )
        for tree, part in sorted(whole.items()):
            nodes = [[tree, *node] for node in grow(part.reshape(*shape, 3), max_depth)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes), schema)], schema=schema)

    return sums.repartition(trees, "tree").mapInArrow(of, _NODES)


def _predictions(nodes: list, shape: list[int]):
    """The prediction of a tree for each cell."""
    import numpy as np

    table = np.zeros(shape)

    def fill(node, box):
        if node["left"] < 0:
            table[box] = node["total"] / node["weight"] if node["weight"] else 0.0
            return
        feature, part = node["feature"], box[node["feature"]]
        for child, own in (("left", slice(part.start, node["bin"] + 1)), ("right", slice(node["bin"] + 1, part.stop))):
            fill(nodes[node[child]], (*box[:feature], own, *box[feature + 1 :]))

    fill(nodes[0], tuple(slice(0, size) for size in shape))
    return table


def _saved_node(node, cuts: list[list[float]]) -> tuple:
    stats = [node["weight"], node["total"], node["squares"]]
    mean = node["total"] / node["weight"] if node["weight"] else 0.0
    impurity = (node["squares"] - node["total"] * mean) / node["weight"] if node["weight"] else 0.0
    leaf = node["left"] < 0
    split = (-1, [], -1) if leaf else (node["feature"], [cuts[node["feature"]][node["bin"]]], -1)
    return (node["id"], mean, impurity, stats, round(node["weight"]), node["gain"], node["left"], node["right"], split)


def _loaded(spark: SparkSession, trees: list[list], cuts: list[list[float]], params: dict) -> RandomForestRegressionModel:
    """A model of Spark from nodes, by the format in which Spark saves one."""
    path = scratch_dir(spark)
    about = {"timestamp": 0, "sparkVersion": spark.version, "defaultParamMap": {}}
    package = "org.apache.spark.ml.regression"
    one = {name: params[name] for name in ("featuresCol", "labelCol", "impurity", "maxDepth", "seed")}
    uid = f"forest_{path.rsplit('-', 1)[-1][:12]}"
    whole = about | {"class": f"{package}.RandomForestRegressionModel", "uid": uid, "paramMap": params}
    whole |= {"numFeatures": len(cuts), "numTrees": len(trees)}
    part = about | {"class": f"{package}.DecisionTreeRegressionModel", "paramMap": one}
    spark.createDataFrame([(json.dumps(whole),)], "value STRING").coalesce(1).write.text(f"{path}/metadata")
    parts = [(i, json.dumps(part | {"uid": f"{uid}_{i}"}), 1.0) for i in range(len(trees))]
    spark.createDataFrame(parts, "_1 INT, _2 STRING, _3 DOUBLE").write.parquet(f"{path}/treesMetadata")
    nodes = [(i, _saved_node(node, cuts)) for i, tree in enumerate(trees) for node in tree]
    spark.createDataFrame(nodes, _SAVED).write.parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)


def _bin(value: str, cut: list[float], first: int = 0) -> str:
    """The bin of a value as SQL: how many bounds are below it, found by halving."""
    if not cut:
        return str(first)
    half = len(cut) // 2
    below, above = _bin(value, cut[:half], first), _bin(value, cut[half + 1 :], first + half + 1)
    return f"IF({value} <= {cut[half]!r}D, {below}, {above})"


def _lookup(table, features: Sequence[str], cuts: list[list[float]], prediction: str) -> SQLTransformer:
    """Scoring by the cell of a row: what the trees of all groups predict on average, looked up."""
    values = [f"CAST({quoted_parts(name)} AS DOUBLE)" for name in features]
    cell = "0"
    for value, cut in zip(values, cuts):
        cell = f"({cell}) * {len(cut) + 1} + {_bin(value, cut)}"
    # one text, as an array of so many literals is slow to plan
    means = f"CAST(split('{','.join(map(repr, table.ravel().tolist()))}', ',') AS ARRAY<DOUBLE>)"
    unknown = " OR ".join(f"{value} IS NULL OR isnan({value})" for value in values)
    refused = "CAST(raise_error('a forest scores rows without a NULL or NaN feature') AS DOUBLE)"
    return SQLTransformer(
        statement=f"SELECT *, IF({unknown}, {refused}, {means}[{cell}]) AS {prediction} FROM __THIS__"
    )


def fit_by_cells(
    df: DataFrame,
    rows: int,
    features: Sequence[str],
    label: str,
    groups: Sequence[tuple[int, int]],
    max_depth: int,
    features_col: str,
    prediction: str,
    bootstrap: bool = True,
) -> list | None:
    """The stages after the assembler for groups of trees, each a size and a seed; None if the bins of
    the features make more cells than :data:`MAX_CELLS`.

    Every tree draws every row as often as the row's place and the seed say, by a Poisson distribution
    of mean 1. As trees cut features between bins only, all that decides a tree are the sums of its draws
    by cell, a cell being a bin of each feature. Tasks add them up in one pass (or a few side by side, see
    :func:`passes`), and those of a tree meet in one task, which grows it. What a task holds depends on
    cells and trees alone.

    The groups become models of Spark. The mean of all trees is a table by cell, which the last stage
    looks predictions up in; the columns of the groups are there, but cost nothing if nobody reads them.
    """
    spark = df.sparkSession
    values = [F.col(quoted_parts(name)).cast("double") for name in features]
    named: list[Column] = [value.alias(f"_{i}") for i, value in enumerate(values)]
    numbered = df.select(
        F.monotonically_increasing_id().alias("_row"), *named, F.col(quoted_parts(label)).cast("double").alias("_label")
    ).persist()
    try:
        sample = numbered
        if rows > SAMPLE_ROWS:
            share = round(SAMPLE_ROWS / rows * 2**40)
            sample = sample.where(F.pmod(F.xxhash64(F.lit(groups[0][1]), "_row"), F.lit(2**40)) < share)
        sampled = [list(row) for row in sample.select(*(f"_{i}" for i in range(len(features)))).collect()]
        if not sampled or any(value is None or value != value for row in sampled for value in row):
            raise ValueError("a forest is fitted to rows without a NULL, NaN or infinite value")
        cuts = [bounds(column) for column in zip(*sampled)]
        shape = [len(cut) + 1 for cut in cuts]
        if prod(shape) > MAX_CELLS:
            return None
        tasks = max(1, rows // (ROWS_PER_CELL * prod(shape)))
        parts, count = [], 0
        for some in passes(groups, prod(shape)):
            parts.append(cell_sums(numbered.coalesce(tasks), cuts, some, bootstrap, count))
            count += sum(size for size, _ in some)
        sums = reduce(DataFrame.unionAll, parts)
        found = grown(sums, count, shape, max_depth).collect()  # at most 2^(depth + 1) nodes a tree
    finally:
        numbered.unpersist()

    trees: list[list] = [[] for _ in range(count)]
    for node in sorted(found, key=lambda node: (node["tree"], node["id"])):
        trees[node["tree"]].append(node)

    def model(number):
        size, seed = groups[number]
        done = sum(size for size, _ in groups[:number])
        params = {
            "featuresCol": features_col, "labelCol": label, "predictionCol": f"{prediction}_{number}", "numTrees": size,
            "maxDepth": max_depth, "featureSubsetStrategy": "all", "seed": seed, "bootstrap": bootstrap, "impurity": "variance",
        }
        return _loaded(spark, trees[done : done + size], cuts, params)

    models = list(on_pool(model, range(len(groups)), _THREADS))
    table = sum(_predictions(tree, shape) for tree in trees) / len(trees)
    return [*models, _lookup(table, features, cuts, prediction)]
