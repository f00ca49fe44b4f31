"""What differs between two tables, found by a tree of hashes over ranges of their keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType, StringType, TimestampNTZType, TimestampType

from catalift.functions.frames import stored
from catalift.functions.names import quoted_parts
from catalift.operators.ranking import PIECES, SAMPLES, with_piece
from catalift.plans.migrate import hash_sums, row_hash

# Rows of a range of keys that has a hash of its own, if there are not too many ranges.
BUCKET_ROWS = 100_000

# Ranges below a node of the tree.
FANOUT = 32

# Ranges that a scan is told to look at; more are told as their hull, which holds them.
SCANNED = 200

# Types of a first key whose bounds files can be skipped by.
_SKIPPABLE = (IntegralType, StringType, DateType, TimestampType, TimestampNTZType, DecimalType)

_SUMS = ("rows", "sum0", "sum1", "sum2", "sum3")


def differences(
    source: DataFrame, target: DataFrame, keys: Sequence[str], bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Keys whose rows are not the same in both tables: the keys, ``change`` and how many rows of
    the key only the one or the other has, ``source_rows`` and ``target_rows``.

    ``change`` is REMOVED or ADDED for a key that only the source or the target has a row too
    many of, CHANGED where both have. Rows count as often as they occur; NULL equals NULL, in
    keys too. The tables have the same columns and types, in any order.

    Both tables are read once into one row for each range of keys: the rows and the summed
    pieces of their hashes. These add up to the nodes of a tree. From its root down only nodes
    that differ are followed; then the rows of the ranges that differ are read, by bounds of the
    first key that files are skipped by, and compared. Equal tables are not read again.
    """
    _same_columns(source, target)
    cuts = _cuts(source, keys, bucket_rows)
    leaves = [_leaves(side, keys, cuts) for side in (source, target)]
    differ = _differing(*leaves)
    found = differ.orderBy("bucket").limit(PIECES * 2).collect()  # numbers of ranges, bounded
    buckets = [row["bucket"] for row in found]
    bounds = cuts.first()["_cuts"] if buckets else []
    near = _spans(source, keys[0], bounds, buckets)
    sides = []
    for sign, side in ((1, source), (-1, target)):
        rows = side.where(near) if buckets else side.where(F.lit(False))
        rows = _bucketed(rows, keys, cuts).join(F.broadcast(differ), "bucket", "left_semi")
        both = [row_hash(side).alias("_h"), row_hash(side, 1).alias("_g")]
        sides.append(rows.select(*(F.col(quoted_parts(k)) for k in keys), *both, F.lit(sign).alias("_side")))
    rows = sides[0].unionAll(sides[1])
    names = [F.col(quoted_parts(k)) for k in keys]
    rows = rows.groupBy(*names, "_h", "_g").agg(F.sum("_side").alias("_more")).where("_more <> 0")
    more = lambda sign: F.sum(F.greatest(F.col("_more") * sign, F.lit(0)))
    told = rows.groupBy(*names).agg(more(1).alias("source_rows"), more(-1).alias("target_rows"))
    change = F.when(F.col("target_rows") == 0, "REMOVED").when(F.col("source_rows") == 0, "ADDED").otherwise("CHANGED")
    return told.select(*names, change.alias("change"), "source_rows", "target_rows")


def _same_columns(source: DataFrame, target: DataFrame) -> None:
    columns = [{f.name.lower(): f.dataType.simpleString() for f in side.schema} for side in (source, target)]
    if columns[0] != columns[1]:
        raise ValueError(f"the tables have other columns: {columns[0]} and {columns[1]}")


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*(F.col(quoted_parts(k)) for k in keys))


def _cuts(source: DataFrame, keys: Sequence[str], bucket_rows: int) -> DataFrame:
    """One row with ``_cuts``, the last keys of all ranges but one, from a sample of bounded size."""
    total = source.count()
    limit = max(bucket_rows, -(-total // PIECES))
    share = min(1.0, SAMPLES / limit)
    every = max(1, round(share * limit))
    # equal keys go before they are gathered: within an array of structs each would meet all others
    seen = source.select(_key(keys).alias("_key")).sample(share, seed=1).distinct()
    seen = seen.agg(F.sort_array(F.collect_list("_key")).alias("_seen"))
    cuts = F.filter("_seen", lambda value, place: (place + 1) % every == 0)
    return stored(seen.select(cuts.alias("_cuts")))


def _bucketed(rows: DataFrame, keys: Sequence[str], cuts: DataFrame) -> DataFrame:
    """Add the number of the range that a key lies in."""
    rows = rows.withColumn("_of", F.lit(0))  # all rows look into the one row of cuts
    return with_piece(rows, cuts.withColumn("_of", F.lit(0)), ["_of"], _key(keys), "bucket").drop("_of", "_tops")


def _leaves(side: DataFrame, keys: Sequence[str], cuts: DataFrame) -> DataFrame:
    """Rows and summed hashes of every range: the lowest level of the tree."""
    sums = [c.alias(n) for c, n in zip([F.count("*"), *hash_sums(side)], _SUMS)]
    return stored(_bucketed(side, keys, cuts).groupBy("bucket").agg(*sums))


def _differing(source: DataFrame, target: DataFrame) -> DataFrame:
    """Ranges whose hashes differ, from the root of the tree down: the children of a node that
    is the same on both sides are not looked at."""
    levels = [(source, target)]
    height = 1
    while FANOUT**height < 2 * PIECES:
        height += 1
    for _ in range(height):
        levels.append(tuple(_above(side) for side in levels[-1]))
    differ = None
    for a, b in reversed(levels):
        sides = a.alias("a").join(b.alias("b"), "bucket", "full")
        same = reduce(and_, (F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in _SUMS))
        nodes = sides.where(~same).select("bucket")
        if differ is not None:
            parents = differ.select(F.col("bucket").alias("_parent"))
            nodes = nodes.join(parents, F.expr(f"bucket div {FANOUT}") == F.col("_parent"), "left_semi")
        differ = stored(nodes)
        if not differ.head(1):
            return differ
    return differ


def _above(level: DataFrame) -> DataFrame:
    """The level above: the hashes of a node are the sums of those below it."""
    parent = F.expr(f"CAST(bucket div {FANOUT} AS INT)").alias("bucket")
    return stored(level.groupBy(parent).agg(*(F.sum(n).alias(n) for n in _SUMS)))


def _spans(source: DataFrame, first: str, bounds: Sequence, buckets: Sequence[int]) -> Column:
    """Where the first key may be that of a row in the ranges. Neighbours are one span."""
    column = F.col(quoted_parts(first))
    kind = source.select(column).schema[0].dataType
    if not isinstance(kind, _SKIPPABLE):
        return F.lit(True)
    spans: list[list[int]] = []
    for bucket in buckets:
        if spans and spans[-1][1] + 1 == bucket:
            spans[-1][1] = bucket
        else:
            spans.append([bucket, bucket])
    if len(spans) > SCANNED:
        spans = [[spans[0][0], spans[-1][1]]]

    def inside(low: int, high: int) -> Column:
        """NULL sorts first, so it may lie in any span that begins with a NULL or at the start."""
        ends = [F.lit(True)]
        least = bounds[low - 1][0] if low else None
        if least is not None:
            ends.append(column >= F.lit(least).cast(kind))
        if high < len(bounds):
            most = bounds[high][0]
            ends.append(column <= F.lit(most).cast(kind) if most is not None else column.isNull())
        within = reduce(and_, ends)
        return within if least is not None else within | column.isNull()

    return reduce(or_, (inside(low, high) for low, high in spans), F.lit(False))
