"""Slices of a time series and the forecast window around a day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalift.functions.predicates import any_of

# Days on each side of the anchor, and the rows below which the tail of the
# series stands in for the window.
WINDOW_DAYS = 5
MIN_ROWS = 10

# Days after and before all days of a series.
NEVER, ALWAYS = "9999-12-31", "0001-01-01"


def slice_inclusive(df: DataFrame, ts: str, low, high) -> DataFrame:
    """Rows from `low` to `high`, both included. A bound without a time of day is midnight,
    so later samples of the last day fall outside."""
    return df.where(F.col(ts).between(low, high))


def time_split(
    df: DataFrame, ts: str, spans: Mapping[str, tuple], split: str = "split"
) -> DataFrame:
    """Rows of every named span, tagged with its name. Spans may overlap; a row in two
    spans comes out twice. One scan serves all spans."""
    inside = {name: F.col(ts).between(*bounds) for name, bounds in spans.items()}
    names = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in inside.items())))
    return df.where(any_of(inside.values())).select(F.explode(names).alias(split), "*")


def label_split(
    df: DataFrame, label: str, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Features without the label, and the label; both with the keys, if any are named."""
    return df.drop(label), df.select(*keys, label)


def forecast_window(
    df: DataFrame,
    ts: str,
    anchor: date | str | Column | None = None,
    days: int = WINDOW_DAYS,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Rows within `days` of the anchor day (default today), with ``has_actual`` true up to
    the anchor.

    The tail of the series is bounded by a day that a subquery finds: beyond all days when
    the window suffices, so that files and row groups can be skipped.

    With fewer than `min_rows` such rows the last `min_rows` of the series come out
    instead, and ``has_actual`` is true for all but the last `days` of them. The choice is
    a one-row subquery that stops counting at `min_rows`.
    """
    if anchor is None:
        anchor = F.current_date()
    elif not isinstance(anchor, Column):
        anchor = F.lit(anchor)
    anchor = anchor.cast("date")

    around = df.where(F.col(ts).between(F.date_sub(anchor, days), F.date_add(anchor, days)))
    enough = around.limit(min_rows).agg(F.count("*")).scalar() >= min_rows

    # the first day to look at: none if the window is enough
    seen = df.where(F.col(ts).between(F.date_sub(anchor, days), F.date_add(anchor, days))).limit(min_rows)
    first = F.when(F.count("*") >= min_rows, F.lit(NEVER)).otherwise(F.lit(ALWAYS)).cast("date")
    since = seen.agg(first.alias("since")).scalar()
    # At most min_rows rows reach the window: the limit is a top-k on every partition.
    from_end = F.row_number().over(Window.orderBy(F.col(ts).desc()))
    tail = (
        df.where((F.col(ts) >= since) & ~enough)
        .orderBy(F.col(ts).desc())
        .limit(min_rows)
        .withColumn("has_actual", from_end > days)
    )
    return around.where(enough).withColumn("has_actual", F.col(ts) <= anchor).unionByName(tail)


def forecast_vs_actual(
    predictions: DataFrame, actuals: DataFrame, on: str | Sequence[str]
) -> DataFrame:
    """Every prediction with the actual of the same key, NULL where there is none yet."""
    return predictions.join(actuals, on, "left")
