"""Move of registered models, their versions and their stages to a new registry."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalift.functions.frames import stored
from catalift.operators.ranking import SPAN, number_stored

# The alias that replaces each stage. Other stages have none.
STAGE_ALIASES = {"Production": "Champion", "Staging": "Challenger"}

# Fixed value: a model name that is a valid identifier at the destination.
VALID_NAME = r"^[^./ \x00-\x1F\x7F]{1,255}$"

# Columns of a version that the move carries to the destination, where `versions` has them.
_CARRIED = {"source": "string", "run_id": "string", "description": "string"}


def _number(version: Column) -> Column:
    """Versions are text but compare as integers: '10' is later than '9'."""
    return version.try_cast("bigint")


def latest_version(versions: DataFrame, name: str = "name") -> DataFrame:
    """Greatest version number of every model as ``latest_version``."""
    return versions.groupBy(name).agg(F.max(_number(F.col("version"))).alias("latest_version"))


def stage_alias(versions: DataFrame, name: str = "name") -> DataFrame:
    """The alias of every model's latest version in a stage that maps to one."""
    alias = F.coalesce(
        *(
            F.when(F.col("current_stage") == stage, F.lit(alias))
            for stage, alias in STAGE_ALIASES.items()
        )
    )
    return (
        versions.where(F.col("current_stage").isin(*STAGE_ALIASES))
        .groupBy(name, alias.alias("alias"))
        .agg(F.max(_number(F.col("version"))).alias("version"))
    )


def upgrade_plan(
    versions: DataFrame,
    dest_catalog: str,
    dest_schema: str,
    models: DataFrame | None = None,
    existing: DataFrame | None = None,
    signatures: DataFrame | None = None,
    migrated: DataFrame | None = None,
    span: int = SPAN,
    upgrade_versions: bool = True,
) -> DataFrame:
    """What happens to every version: ``name, version, dest_name, status, dest_version`` and
    what a version carries, ``source, run_id, description, model_description``.

    versions    ``name, version, has_signature`` and, if known, ``source, run_id,
                description``; (name, version) is unique
    models      ``name`` and, if known, ``description``; adds a row with no version for a
                model that has none
    existing    ``dest_name, latest_version`` of models at the destination; they are kept,
                and new versions follow on their latest
    signatures  ``name, version`` of versions whose signature is supplied
    migrated    ``dest_name, source_version`` of versions moved before

    Status, the first that applies: INVALID_NAME (a NULL name too, or a destination that is no
    name), INVALID_VERSION, EXISTS (moved before), NO_SIGNATURE, READY; NO_VERSIONS for a model
    without any. Versions that are READY take the next destination versions of their model in
    numeric order. The others do not stop them.

    The versions are read once, when this is called, and judged into the scratch folder.

    With `upgrade_versions` off only the models move: one row for each, of `models` and
    `versions` together, with status READY, EXISTS or INVALID_NAME and no version.
    """
    prefix = f"{dest_catalog}.{dest_schema}."
    valid = F.coalesce(F.col("name").rlike(VALID_NAME), F.lit(False)) & F.lit(
        _is_name(dest_catalog) and _is_name(dest_schema)
    )
    dest_name = F.concat(F.lit(prefix), "name").alias("dest_name")
    told = None
    if models is not None:
        text = F.max("description") if "description" in models.columns else F.max(F.lit(None).cast("string"))
        told = models.groupBy("name").agg(text.alias("model_description"))
    latest = None
    if existing is not None:
        there, name = _at(existing, prefix)
        latest = there.groupBy(name.alias("name")).agg(
            F.max(F.col("latest_version").cast("bigint")).alias("start")
        )
    if not upgrade_versions:
        names = versions.select("name") if told is None else versions.select("name").union(told.select("name"))
        plan = names.distinct()
        if latest is not None:
            plan = plan.join(latest, "name", "left")
        else:
            plan = plan.withColumn("start", F.lit(None).cast("bigint"))
        status = F.when(~valid, "INVALID_NAME").when(F.col("start").isNotNull(), "EXISTS").otherwise("READY")
        plan = plan.select("name", *_nulls(("version", "bigint")), dest_name, status.alias("status"),
                           *_nulls(("dest_version", "bigint"), *_CARRIED.items()))
        return _described(plan, told)

    base = versions.select(
        "name",
        _number(F.col("version")).alias("version"),
        F.col("version").cast("string").alias("_text"),
        F.coalesce("has_signature", F.lit(False)).alias("_signed"),
        *(
            F.col(c).cast(kind).alias(c) if c in versions.columns else F.lit(None).cast(kind).alias(c)
            for c, kind in _CARRIED.items()
        ),
    )
    signed, moved = F.col("_signed"), F.lit(False)
    if signatures is not None:
        supplied = _marked(signatures, F.col("name"), F.col("version"), "_supplied")
        base = base.join(supplied, ["name", "version"], "left")
        signed = signed | F.col("_supplied").isNotNull()
    if migrated is not None:
        done = _marked(*_at(migrated, prefix), F.col("source_version"), "_moved")
        base = base.join(done, ["name", "version"], "left")
        moved = F.col("_moved").isNotNull()

    status = (
        F.when(~valid, "INVALID_NAME")
        .when(F.col("version").isNull(), "INVALID_VERSION")
        .when(moved, "EXISTS")
        .when(~signed, "NO_SIGNATURE")
        .otherwise("READY")
    )
    judged = base.select(
        "name",
        "version",
        dest_name,
        status.alias("status"),
        *_CARRIED,
        (status == "READY").alias("_ready"),
        # text that is no number is spread by its hash; such rows take no number
        F.coalesce("version", F.crc32("_text"), F.lit(0)).cast("bigint").alias("_order"),
    )
    judged = stored(judged)
    plan = number_stored(judged, ["name", "_ready"], "_order", "_number", span, after=latest).select(
        "name",
        "version",
        "dest_name",
        "status",
        F.when(F.col("_ready"), F.col("_number")).alias("dest_version"),
        *_CARRIED,
    )
    if told is None:
        return _described(plan, None)
    named = judged.select(F.col("name").alias("_has")).distinct()
    without = told.join(named, F.col("name").eqNullSafe(F.col("_has")), "left_anti").select(
        "name",
        *_nulls(("version", "bigint")),
        dest_name,
        F.when(valid, "NO_VERSIONS").otherwise("INVALID_NAME").alias("status"),
        *_nulls(("dest_version", "bigint"), *_CARRIED.items()),
    )
    return _described(plan.unionByName(without), told)


def _is_name(part: str) -> bool:
    return re.fullmatch(VALID_NAME[1:-1], part or "") is not None


def _nulls(*columns: tuple[str, str]) -> list[Column]:
    return [F.lit(None).cast(kind).alias(name) for name, kind in columns]


def _described(plan: DataFrame, told: DataFrame | None) -> DataFrame:
    if told is None:
        return plan.withColumn("model_description", F.lit(None).cast("string"))
    return plan.join(told, "name", "left")


def _at(df: DataFrame, prefix: str) -> tuple[DataFrame, Column]:
    """Rows of destination models below the prefix, and their plain model name."""
    name = F.col("dest_name")
    return df.where(name.startswith(prefix)), F.expr(f"substring(dest_name, {len(prefix) + 1})")


def _marked(df: DataFrame, name: Column, version: Column, mark: str) -> DataFrame:
    return df.select(
        name.alias("name"), _number(version).alias("version"), F.lit(True).alias(mark)
    ).distinct()
