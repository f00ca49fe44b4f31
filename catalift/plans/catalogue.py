"""A model registry as files: plans are put into it, aliases move, readers see one state at a time."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = (
    "dest_name STRING, version BIGINT, source_version BIGINT, source STRING, run_id STRING, "
    "description STRING, model_description STRING"
)
ALIASES = "name STRING, alias STRING, version BIGINT"

_POINTER = "number BIGINT, state STRING"


class Registry(NamedTuple):
    """One state of a registry: its number, 0 for none, and its two tables."""

    number: int
    versions: DataFrame
    aliases: DataFrame

    def existing(self) -> DataFrame:
        """``dest_name, latest_version``, as a plan wants them."""
        return self.versions.groupBy("dest_name").agg(F.max("version").alias("latest_version"))

    def migrated(self) -> DataFrame:
        """``dest_name, source_version`` of the versions that were moved."""
        return self.versions.select("dest_name", "source_version")


def read_registry(spark: SparkSession, path: str) -> Registry:
    """The latest state of the registry at a path; an empty one if there is none. A state is
    never changed, so what was read stays as it is while others write."""
    try:
        pointers = spark.read.schema(_POINTER).json(f"{path.rstrip('/')}/pointers/*")
        # one row, however many states there are
        row = pointers.agg(F.max(F.struct("number", "state")).alias("last")).first()["last"]
    except AnalysisException:
        row = None
    if row is None:
        return Registry(0, spark.createDataFrame([], VERSIONS), spark.createDataFrame([], ALIASES))
    folder = f"{path.rstrip('/')}/{row['state']}"
    return Registry(
        row["number"],
        spark.read.schema(VERSIONS).parquet(f"{folder}/versions"),
        spark.read.schema(ALIASES).parquet(f"{folder}/aliases"),
    )


def apply_plan(spark: SparkSession, plan: DataFrame, path: str, aliases: DataFrame | None = None) -> Registry:
    """Put the READY versions of a plan (:func:`upgrade_plan`) into the registry at a path, and
    return its new state.

    A version of the source that the registry has is left as it is, so that a plan may be
    applied again. `aliases`, ``name, alias, version`` as :func:`stage_alias` gives them, name
    versions of the source; each alias of a model then points at what that version became. An
    alias of a version that was not moved stays where it was.

    The new tables are written to a folder of their own and the pointer to them last, under the
    next number: readers see the old state or the new one, and what a run left that died is
    seen by none. Of two runs at once the second to end is refused, as its number is taken.
    """
    state = read_registry(spark, path)
    ready = plan.where("status = 'READY'").select(
        "dest_name", F.col("dest_version").alias("version"), F.col("version").alias("source_version"),
        "source", "run_id", "description", "model_description",
    )
    new = ready.join(state.migrated(), ["dest_name", "source_version"], "left_anti").select(*state.versions.columns)
    folder = f"state-{uuid.uuid4().hex}"
    base = f"{path.rstrip('/')}/{folder}"
    state.versions.unionAll(new).write.parquet(f"{base}/versions")
    versions = spark.read.schema(VERSIONS).parquet(f"{base}/versions")

    pointed = state.aliases
    if aliases is not None:
        names = plan.select(F.col("name").alias("_name"), "dest_name").where("dest_name IS NOT NULL").distinct()
        moved = (
            aliases.select(F.col("name").alias("_name"), "alias", F.col("version").cast("bigint").alias("source_version"))
            .join(names, "_name")
            .join(versions.select("dest_name", "source_version", "version"), ["dest_name", "source_version"])
            .groupBy(F.col("dest_name").alias("name"), "alias")
            .agg(F.max("version").alias("_moved"))
        )
        pointed = pointed.join(moved, ["name", "alias"], "full").select(
            "name", "alias", F.coalesce("_moved", "version").alias("version")
        )
    pointed.write.parquet(f"{base}/aliases")
    _point(spark, path, state.number + 1, folder)
    return read_registry(spark, path)


def _point(spark: SparkSession, path: str, number: int, folder: str) -> None:
    """The pointer of a number is written once; an error if it is there."""
    pointer = spark.createDataFrame([(number, folder)], _POINTER).coalesce(1)
    pointer.write.mode("errorifexists").json(f"{path.rstrip('/')}/pointers/{number:012d}")
