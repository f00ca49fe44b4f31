"""Who owns what, and what may be removed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalift.functions.predicates import name_contains_any, owned_by

# Fixed value: a tag that starts with this text, in any case, marks its object for removal.
REMOVAL_PREFIX = "remove"


def owned_not_marked(
    df: DataFrame,
    marks: DataFrame,
    key: str = "catalog_name",
    mark_key: str | None = None,
    tag: str = "tag_name",
    prefix: str = REMOVAL_PREFIX,
    owner_col: str = "catalog_owner",
    owner: str | None = None,
) -> DataFrame:
    """Rows of an owner whose key is NOT IN the marked keys, with SQL's rules for NULL:

    - a NULL among the marked keys removes every row;
    - a NULL key is removed unless nothing at all is marked;
    - with nothing marked every row stays.

    Spark can run a NOT IN subquery only by broadcasting all marked keys to every executor.
    Here a one-row subquery decides the rules and the rest is an ordinary anti join, which
    Spark broadcasts when the marked keys turn out small and shuffles otherwise.
    """
    marked = F.col(mark_key or key).alias("_marked")
    keys = marks.where(F.lower(F.col(tag)).startswith(prefix)).select(marked).distinct()
    # NULL keys among the marked ones, and NULL if nothing is marked at all
    nulls = keys.agg(F.sum(F.col("_marked").isNull().cast("int"))).scalar()
    allowed = nulls.isNull() | ((nulls == 0) & F.col(key).isNotNull())

    # The rules above leave no NULL where the join matters. A null-safe comparison adds no
    # filter to the marked keys, so the join and the subquery share one scan and shuffle of
    # them; and it shuffles both sides directly below the join, which is where adaptive
    # execution can split a hot key.
    kept = owned_by(df, owner_col, owner).where(allowed)
    return kept.join(keys, kept[key].eqNullSafe(keys["_marked"]), "left_anti")


def cleanup_candidates(
    inventory: DataFrame, needles: Iterable[str], column: str = "db"
) -> DataFrame:
    """Distinct names that contain any needle. Reports only; nothing is dropped."""
    return name_contains_any(inventory, column, needles).select(column).distinct()
