"""Predicates over names, owners, formats and storage locations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table in this format is hard to move; the two labels of `complexity`.
HARD_FORMAT = "hive"
HARD_LABEL = "difficult"
EASY_LABEL = "null"

# Path prefixes of the storage root, and the mounts below it that are not root.
ROOT_PREFIXES = ("dbfs:/", "wasb")
MOUNT_PREFIX = "dbfs:/mnt/"


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions; false when there is none."""
    return reduce(or_, conditions, F.lit(False))


def name_contains_any(df: DataFrame, column: str, needles: Iterable[str]) -> DataFrame:
    """Rows whose name contains any of the needles, case-sensitive; none for no needles."""
    return df.where(any_of(F.col(column).contains(F.lit(needle)) for needle in needles))


def glob_match(column: Column, pattern: str) -> Column:
    """Case-insensitive match of the whole name: ``*`` is any run, ``|`` separates
    alternatives, every other character stands for itself."""
    alternatives = []
    for part in pattern.split("|"):
        escaped = part.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        alternatives.append(column.ilike(escaped.replace("*", "%")))
    return any_of(alternatives)


def name_glob(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose name matches the glob, see :func:`glob_match`."""
    return df.where(glob_match(F.col(column), pattern))


def owned_by(df: DataFrame, owner_col: str, owner: str | None = None) -> DataFrame:
    """Rows owned by `owner`, by default the user running the query."""
    wanted = F.current_user() if owner is None else F.lit(owner)
    return df.where(F.col(owner_col) == wanted)


def complexity(df: DataFrame, format_col: str = "format") -> DataFrame:
    """Add ``complexity``: the hard label for the hard format in any case, else the easy
    label, which is the text 'null' and never a NULL."""
    hard = F.lower(F.col(format_col)) == HARD_FORMAT
    return df.withColumn("complexity", F.when(hard, HARD_LABEL).otherwise(F.lit(EASY_LABEL)))


def is_root_storage(location: Column) -> Column:
    """True for a path on the storage root outside the mounts; false for NULL."""
    on_root = any_of(location.startswith(prefix) for prefix in ROOT_PREFIXES)
    return F.coalesce(on_root & ~location.startswith(MOUNT_PREFIX), F.lit(False))
