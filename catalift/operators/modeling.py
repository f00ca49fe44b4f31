"""Fit, score and compare regression models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructType

from catalift.functions.frames import stored
from catalift.functions.names import quoted_parts
from catalift.functions.sizes import broadcast_if_small
from catalift.operators.forest import fit_by_cells
from catalift.operators.ranking import SPAN, number_stored

# Fixed value: trees of the forest.
TREES = 300

# Fixed value: share of the training rows held back while fitting.
HELD_BACK = 0.2

# While it fits, Spark keeps with every row one 4-byte sample count per tree: 400 bytes a row
# for a group of so many trees, against 1.2 kB for a forest at once.
TREES_PER_FIT = 100

# Partitions that rows are dealt to by their key before a fit, at least, and rows that one takes on
# average at most: more rows make more partitions.
FIT_PARTITIONS = 32
FIT_ROWS = 500_000

# Rows that Spark's own fit is given at most, if the features have few enough bins for sums by cell: it
# visits every row for every tree and level.
SPARK_FIT_ROWS = 1_000_000

# Number of the rows that no model scores.
UNSCORED = -1

# Columns that exist only while a model is applied.
_FEATURES = "_features"
_PREDICTION = "_prediction"


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=_FEATURES)


def _cut_in_bins(df: DataFrame, features: Sequence[str]) -> bool:
    """Whether Spark cuts all features between bins: they are numbers, and not marked as categories."""
    fields = [df.select(name).schema[0] for name in features]
    return all(isinstance(f.dataType, (NumericType, BooleanType)) and "ml_attr" not in f.metadata for f in fields)


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    trees: int = TREES,
    max_depth: int = 5,
    seed: int = 0,
    key: Sequence[str] = (),
    partitions: int | None = None,
    trees_per_fit: int = TREES_PER_FIT,
) -> PipelineModel:
    """Random forest; every split of every tree looks at all features.

    A forest depends on how rows are spread over partitions and on their order. Naming a
    unique `key` fixes both, for one shuffle of the key, the features and the label: the
    same rows, seed, key and `partitions` then give the same forest, whatever the session's
    settings. By default the rows are counted, and there are :data:`FIT_PARTITIONS` partitions or as
    many as leave :data:`FIT_ROWS` rows for each, so that what a task reads does not grow with them.
    Without a key the rows stay in the partitions they come in.

    The trees are always fitted in groups of `trees_per_fit`, each with a seed of its own. The
    forest predicts the mean over all trees.

    Above :data:`SPARK_FIT_ROWS` rows, trees are grown from sums by cell (:mod:`.forest`) unless the
    features have too many bins for it or are no plain numbers: the same method with other random draws.
    """
    data = df.select(*dict.fromkeys([*key, *features, label]))
    rows = df.count()
    by_key = [F.col(name) for name in key]
    if key:
        if partitions is None:
            partitions = max(FIT_PARTITIONS, -(-rows // FIT_ROWS))
        data = data.repartition(partitions, *by_key)
    assembler = _assembler(features)
    sizes = [min(trees_per_fit, trees - done) for done in range(0, trees, trees_per_fit)]
    if rows > SPARK_FIT_ROWS and _cut_in_bins(df, features):
        # rows of one key in a fixed order too
        ordered = data.sortWithinPartitions(*dict.fromkeys([*key, *features, label])) if key else data
        seeded = [(size, seed + number) for number, size in enumerate(sizes)]
        stages = fit_by_cells(ordered, rows, features, label, seeded, max_depth, _FEATURES, _PREDICTION)
        if stages is not None:
            return PipelineModel([assembler, *stages])

    data = data.sortWithinPartitions(*by_key) if key else data
    data = assembler.transform(data).select(_FEATURES, label)

    data = data.persist()
    try:
        groups = [
            RandomForestRegressor(
                featuresCol=_FEATURES,
                labelCol=label,
                predictionCol=f"{_PREDICTION}_{number}",
                numTrees=size,
                maxDepth=max_depth,
                featureSubsetStrategy="all",
                seed=seed + number,
                # walking down a few levels costs less than a stored place per row and tree
                cacheNodeIds=False,
            ).fit(data)
            for number, size in enumerate(sizes)
        ]
    finally:
        data.unpersist()
    total = " + ".join(f"{size} * {_PREDICTION}_{n}" for n, size in enumerate(sizes))
    mean = SQLTransformer(statement=f"SELECT *, ({total}) / {trees} AS {_PREDICTION} FROM __THIS__")
    return PipelineModel([assembler, *groups, mean])


def fit_linear(df: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Least squares by the normal equations: one pass, nothing cached."""
    regressor = LinearRegression(
        featuresCol=_FEATURES, labelCol=label, predictionCol=_PREDICTION, solver="normal"
    )
    return Pipeline(stages=[_assembler(features), regressor]).fit(df.select(*features, label))


def _with_prediction(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    applied = model.transform(df)
    kept = (F.col(quoted_parts(column)) for column in df.columns)
    return applied.select(*kept, F.col(_PREDICTION).alias(name))


def score(
    model: PipelineModel, df: DataFrame, keys: Sequence[str], prediction: str = "prediction"
) -> DataFrame:
    """The keys of every row with the model's prediction."""
    return _with_prediction(model, df, prediction).select(*keys, prediction)


def score_by_alias(
    df: DataFrame,
    aliases: DataFrame,
    models: Mapping[tuple[str, int], PipelineModel],
    keys: Sequence[str],
    alias: str | None = None,
    name_col: str = "model",
    alias_col: str = "alias",
) -> DataFrame:
    """Score every row with the version its model's alias points at.

    `aliases` has ``name, alias, version``; `models` maps (name, version) to a fitted model of
    this module. The alias is one text for all rows or, by default, a column of `df`. Rows
    whose alias points at no version, or at one without a model, keep a NULL prediction.

    The rows are read once, when this is called: their keys and the features of the models go to
    the scratch folder, a folder for each version. A model then reads the rows of its own
    version only, and models that no alias points at are left out, so that any number of
    versions costs one pass over the rows and one over what was stored.
    """
    wanted = F.col(alias_col) if alias is None else F.lit(alias)
    spark = df.sparkSession
    numbers = {pair: number for number, pair in enumerate(models)}
    known = spark.createDataFrame(
        [(*pair, number) for pair, number in numbers.items()], "_name STRING, _version BIGINT, _model INT"
    )
    targets = aliases.groupBy(F.col("name").alias("_name"), F.col("alias").alias("_alias")).agg(
        F.max(F.col("version").cast("bigint")).alias("_version")
    )
    targets = stored(targets.join(F.broadcast(known), ["_name", "_version"]))
    used = {row["_model"] for row in targets.select("_model").distinct().collect()}  # one per model at most
    own = {number: models[pair] for pair, number in numbers.items() if number in used}

    rows = df.join(
        broadcast_if_small(targets),
        (F.col(name_col) == F.col("_name")) & (wanted == F.col("_alias")),
        "left",
    )
    features = dict.fromkeys(name for model in own.values() for name in model.stages[0].getInputCols())
    # a feature may be a key too
    named = [F.col(quoted_parts(name)).alias(f"_feature{n}") for n, name in enumerate(features)]
    rows = rows.select(
        F.struct(*keys, F.col("_version").alias("version")).alias("_kept"),
        *named,
        F.coalesce("_model", F.lit(UNSCORED)).alias("_model"),
    )
    # rows of a version lie together, those of a frequent one in several files
    rows = stored(rows.hint("rebalance", F.col("_model")), partition_by=["_model"])

    nothing = F.lit(None).cast("double").alias("prediction")
    parts = [rows.where(F.col("_model") == UNSCORED).select("_kept.*", nothing)]
    for number, model in own.items():
        named = [F.col(f"_feature{n}").alias(name) for n, name in enumerate(features)]
        scored = model.transform(rows.where(F.col("_model") == number).select("_kept", *named))
        parts.append(scored.select("_kept.*", F.col(_PREDICTION).alias("prediction")))
    return reduce(DataFrame.unionAll, parts)


def mse(
    df: DataFrame,
    label: str,
    prediction: str = "prediction",
    by: Sequence[str | Column] = (),
) -> DataFrame:
    """Mean squared error, per group if any are named, as ``mse``, over the rows that have a label
    and a prediction; ``unscored`` counts the others."""
    error = F.col(label) - F.col(prediction)
    return df.groupBy(*by).agg(
        F.avg(error * error).alias("mse"), F.count_if(error.isNull()).alias("unscored")
    )


def compare_versions(
    scored: DataFrame, label: str, prediction: str = "prediction", version: str = "version"
) -> DataFrame:
    """Error of every version over the union of their scored rows."""
    return mse(scored, label, prediction, by=[version])


# Numeric types from narrow to wide. A column may widen to its declared type.
_WIDENING = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _fits(actual: str, declared: str) -> bool:
    if actual == declared:
        return True
    if actual in _WIDENING and declared in _WIDENING:
        return _WIDENING.index(actual) < _WIDENING.index(declared)
    return False


def conform(df: DataFrame, signature: StructType) -> DataFrame:
    """The declared columns in declared order and type.

    Nullable columns are optional and come out as NULL where absent; other columns of `df`
    are dropped. A missing required column, or a type that does not widen to the declared
    one, is an error.
    """
    actual = {field.name: field.dataType.simpleString() for field in df.schema}
    missing = [f.name for f in signature if f.name not in actual and not f.nullable]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    wrong = [
        f"{f.name}: {actual[f.name]} is not {f.dataType.simpleString()}"
        for f in signature
        if f.name in actual and not _fits(actual[f.name], f.dataType.simpleString())
    ]
    if wrong:
        raise ValueError(f"columns have other types: {wrong}")
    return df.select(
        *(
            (F.col(quoted_parts(f.name)) if f.name in actual else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in signature
        )
    )


_HASH_BUCKETS = 10_000


def holdout(df: DataFrame, key: Sequence[str], fraction: float = HELD_BACK) -> DataFrame:
    """Add ``held_back``, true for a share of the rows that depends on their key alone, so
    that it is the same in every run and for every partitioning."""
    bucket = F.pmod(F.xxhash64(*key), F.lit(_HASH_BUCKETS))
    return df.withColumn("held_back", bucket >= round((1 - fraction) * _HASH_BUCKETS))


def holdout_tail(
    df: DataFrame, order: str, fraction: float = HELD_BACK, span: int = SPAN
) -> DataFrame:
    """Add ``held_back``, true for the last share of the rows by an integer column."""
    rows = stored(df)
    numbered = number_stored(rows, [], order, "_number", span)
    fitted = F.floor(F.lit(rows.count()) * F.lit(1.0 - fraction))
    return numbered.select(*df.columns, (F.col("_number") > fitted).alias("held_back"))
