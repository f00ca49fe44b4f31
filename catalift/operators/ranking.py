"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalift.functions.frames import stored
from catalift.functions.sizes import broadcast_if_small

# Rows of a group that one task sorts; a larger group is cut.
SPAN = 1 << 20

# Groups are cut into so many pieces at most, all together: what the cuts need stays small
# whatever the number of rows, and a piece is never more than this part of them.
PIECES = 10_000

# Rows looked at for each piece to find where to cut.
SAMPLES = 64

# Cuts that lie together: a row meets the last of each such block, and then one block of them.
BLOCK = 142

# The group of a frame that is numbered as a whole.
_ALL = "_all"


def number_within(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    out: str = "number",
    span: int = SPAN,
    after: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in ascending `order`, as BIGINT.

    `order` is distinct within a group and holds no NULL; with no groups the whole frame is
    numbered, and NULL is a group like any other. `after` holds some of the group columns,
    unique, and a column ``start``: numbers of such a group follow on its start.

    The frame is evaluated once, into the scratch folder, when this is called. A window sorts
    each group in one task, so groups of over `span` rows are cut into ranges of the order
    that are numbered apart, each moved up by the rows of the ranges before it. The whole rows
    are shuffled once, by group and range.
    """
    return number_stored(stored(df), groups, order, out, span, after)


def number_stored(
    rows: DataFrame,
    groups: Sequence[str],
    order: str,
    out: str = "number",
    span: int = SPAN,
    after: DataFrame | None = None,
) -> DataFrame:
    """:func:`number_within` of a frame that lies in files, which is read several times: its
    keys to find and cut large groups, if it has more than `span` rows, and then whole."""
    columns = rows.columns
    if not groups:
        rows, groups = rows.withColumn(_ALL, F.lit(0)), [_ALL]
    total = rows.count()
    limit = max(span, -(-total // PIECES))
    cuts = _cuts(rows, groups, order, limit) if total > limit else None
    number = F.row_number().over(Window.partitionBy(*groups, *(["_piece"] if cuts else [])).orderBy(order))
    number = number.cast("bigint")
    if cuts:
        rows = with_piece(rows, cuts, groups, F.col(order), "_piece")
        starts = _starts(rows.where(F.col("_tops").isNotNull()), groups)
        numbered = with_few(rows.withColumn("_number", number), starts, [*groups, "_piece"], "_start")
        number = F.col("_number") + F.coalesce("_start", F.lit(0))
    else:
        numbered = rows
    numbered = numbered.select(*columns, number.alias(out))
    if after is None:
        return numbered
    known = [name for name in after.columns if name != "start"]
    # the name of the number may be that of a column of the frame
    begun = broadcast_if_small(stored(after.withColumnRenamed("start", "_begin")))
    return numbered.join(begun, known, "left").select(
        *columns, (F.col(out) + F.coalesce("_begin", F.lit(0))).alias(out)
    )


def with_few(rows: DataFrame, few: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add a value of the keys from a frame whose rows number :data:`PIECES` twice at most."""
    renamed = few.select(*(F.col(k).alias(f"_few_{k}") for k in keys), value)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_few_{k}"))
    return rows.join(F.broadcast(renamed), same, "left").drop(*(f"_few_{k}" for k in keys))


def _cuts(rows: DataFrame, groups: Sequence[str], order: str, limit: int) -> DataFrame | None:
    """The group columns and ``_cuts``, the last orders of all ranges but one, of each group of
    over `limit` rows; None if there is no such group.

    At most :data:`PIECES` groups are so large. The cuts are found in a sample, as they decide
    nothing but how the work is spread.
    """
    large = stored(rows.groupBy(*groups).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit))
    if not large.head(1):
        return None
    share = min(1.0, SAMPLES / limit)
    every = max(1, round(share * limit))
    seen = with_few(rows.select(*groups, order).sample(share, seed=1), large, groups, "_rows")
    seen = seen.where(F.col("_rows").isNotNull()).groupBy(*groups)
    seen = seen.agg(F.sort_array(F.collect_list(order)).alias("_seen"))
    cuts = F.filter("_seen", lambda value, place: (place + 1) % every == 0)
    return stored(seen.select(*groups, cuts.alias("_cuts")))


def with_piece(rows: DataFrame, cuts: DataFrame, keys: Sequence[str], order: Column, out: str) -> DataFrame:
    """Add the number of cuts of the keys below a value, and ``_tops``, NULL for keys without cuts.

    An array that is joined is copied into every row, so a row meets two short arrays instead of all
    cuts: what it costs does not grow with their number.
    """
    tops = F.filter("_cuts", lambda value, place: (place + 1) % BLOCK == 0)
    rows = with_few(rows, cuts.select(*keys, tops.alias("_tops")), keys, "_tops")
    rows = rows.withColumn("_block", piece_of(F.col("_tops"), order, 2 * BLOCK))
    numbers = F.sequence(F.lit(0), F.floor(F.size("_cuts") / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda number: F.slice("_cuts", number * BLOCK + 1, BLOCK))
    blocks = cuts.select(*keys, F.posexplode(blocks).alias("_block", "_within"))
    rows = with_few(rows, blocks, [*keys, "_block"], "_within")
    below = F.col("_block") * BLOCK + piece_of(F.col("_within"), order, BLOCK)
    # never NULL, which a join by it would else find out first
    return rows.withColumn(out, F.coalesce(below, F.lit(0))).drop("_block", "_within")


def piece_of(cuts: Column, order: Column, most: int = 2 * PIECES) -> Column:
    """Number of cuts, `most` at most, below a value, found by halving; 0 without cuts."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))

    def step(low, wide):
        return F.when((low + wide <= F.size(cuts)) & (F.get(cuts, low + wide - 1) < order), low + wide).otherwise(low)

    return F.when(cuts.isNotNull(), F.aggregate(steps, F.lit(0), step)).otherwise(0)


def _starts(cut: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows before each range of a group that is cut, as ``_start``."""
    counts = cut.groupBy(*groups, "_piece").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    return stored(counts.select(*groups, "_piece", start.alias("_start")))
