"""Metastore inventory as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# The columns of an inventory file, in file order.
INVENTORY_SCHEMA = StructType(
    [
        StructField("db", StringType()),
        StructField("table", StringType()),
        StructField("format", StringType()),
        StructField("type", StringType()),
        StructField("table_location", StringType()),
        StructField("created_version", StringType()),
        StructField("created_time", LongType()),
        StructField("last_access", LongType()),
        StructField("lib", StringType()),
        StructField("inputformat", StringType()),
        StructField("outputformat", StringType()),
    ]
)

# What stands in a file for an attribute that is missing, for the location of
# a table that has none, and for the location of a table that could not be described.
MISSING = "Unknown"
NO_LOCATION = "None"
FAILED_LOCATION = "NONE"

# Fixed value: a table that could not be described has only this many fields.
FAILED_WIDTH = 5

_CLASS_COLUMNS = ("lib", "inputformat", "outputformat")


def read_inventory(
    spark: SparkSession, path: str, infer: bool = False, nulls: bool = False
) -> DataFrame:
    """Inventory files with a header. Short lines are padded with NULL.

    The eleven columns are always bound by their place, as the header of a file of failed
    tables is short. `infer=True` derives the types of the whole lines in an extra pass.
    `nulls=True` turns the stand-ins for a missing location or class name into NULL; format
    and type keep theirs, as they are group labels.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    df = reader.schema(INVENTORY_SCHEMA).csv(path)
    if infer:
        texts = StructType([StructField(name, StringType()) for name in INVENTORY_SCHEMA.names])
        df = reader.schema(texts).csv(path)
        whole = [name for name in INVENTORY_SCHEMA.names if name not in ("created_time", "last_access")]
        kinds = {c: _integer_kind(df, c) for c in ("created_time", "last_access")}
        df = df.select(*(F.col(c) if c in whole else F.col(c).cast(kinds[c]).alias(c) for c in df.columns))
    if not nulls:
        return df
    cleared = {name: F.nullif(F.col(name), F.lit(MISSING)) for name in _CLASS_COLUMNS}
    location = F.col("table_location")
    cleared["table_location"] = F.when(
        ~location.isin(NO_LOCATION, FAILED_LOCATION), location
    )
    return df.withColumns(cleared)


def _integer_kind(df: DataFrame, name: str) -> str:
    """INT, BIGINT or STRING, whichever holds every value of a text column."""
    value = F.col(name)
    wide, narrow = (F.bool_and(value.isNull() | value.try_cast(t).isNotNull()) for t in ("bigint", "int"))
    row = df.agg(narrow.alias("int"), wide.alias("bigint")).first()
    return "int" if row["int"] in (True, None) else "bigint" if row["bigint"] else "string"


def failed(df: DataFrame) -> Column:
    """True for a table that could not be described."""
    return F.coalesce(df["type"], F.lit(MISSING)) == MISSING


def write_inventory(df: DataFrame, path: str) -> None:
    """Write an inventory as CSV, header first, one line per table, commas quoted.

    A table that could not be described is written short. Lines of different width cannot
    share a CSV writer, so lines are built as text; one pass and one commit write them all.
    """
    stand_ins = {
        "format": F.coalesce("format", F.lit(MISSING)),
        "table_location": F.coalesce("table_location", F.lit(NO_LOCATION)),
        **{name: F.coalesce(name, F.lit(MISSING)) for name in _CLASS_COLUMNS},
    }
    whole = F.to_csv(F.struct(*INVENTORY_SCHEMA.names))
    short_values = (MISSING, MISSING, FAILED_LOCATION)
    assert len(short_values) + 2 == FAILED_WIDTH
    short = F.to_csv(F.struct("db", "table", *map(F.lit, short_values)))
    lines = df.withColumn("_failed", failed(df)).withColumns(stand_ins)
    line = F.when(F.col("_failed"), short).otherwise(whole)
    # each task writes one file, and the first row of a task brings the header
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = F.lit(",".join(INVENTORY_SCHEMA.names) + "\n")
    lines.select(F.concat(F.when(first, header).otherwise(""), line).alias("value")).write.option(
        "maxRecordsPerFile", 0
    ).text(path)
