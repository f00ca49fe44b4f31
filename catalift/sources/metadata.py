"""Catalogue metadata as DataFrames.

Spark has no distributed reader for a metastore: each listing or description is a call made
by the driver. The calls run on a bounded pool of threads and only metadata passes through
the driver; everything after that is a plan over the resulting frame. The answer of a SHOW
or DESCRIBE command is on the driver already, so collecting it runs no job.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalift.functions.frames import frame_of
from catalift.functions.names import literal, quoted, quoted_parts
from catalift.functions.pool import on_pool
from catalift.sources.inventory_csv import MISSING

# Key of the row that stands for a description that failed.
FAILED_KEY = "# Error"

# What is read of a description.
_TABLE_JSON = """
    provider STRING, type STRING, location STRING, created_by STRING, created_time STRING,
    last_access STRING, serde_library STRING, input_format STRING, output_format STRING
"""


def list_catalogs(spark: SparkSession) -> list[str]:
    """Names of the catalogues this session has loaded."""
    return [row["catalog"] for row in spark.sql("SHOW CATALOGS").collect()]


def catalog_inventory(spark: SparkSession) -> DataFrame:
    """``catalog`` of every catalogue this session has loaded, as rows for the filters."""
    return frame_of(spark, ((name,) for name in list_catalogs(spark)), "catalog STRING")


def _databases(
    spark: SparkSession, db_glob: str, catalogs: Sequence[str] | None
) -> Iterator[tuple[str, str]]:
    for catalog in catalogs or [spark.catalog.currentCatalog()]:
        listed = spark.sql(f"SHOW DATABASES IN {quoted_parts(catalog)} LIKE {literal(db_glob)}")
        for row in listed.collect():
            yield catalog, row["namespace"]


def _tables(
    spark: SparkSession, db_glob: str, catalogs: Sequence[str] | None, threads: int
) -> Iterator[tuple[str, str, str]]:
    def of_database(place):
        listed = spark.sql(f"SHOW TABLES IN {quoted_parts(*place)}").where("NOT isTemporary")
        return [(*place, row["tableName"]) for row in listed.collect()]

    databases = _databases(spark, db_glob, catalogs)
    for tables in on_pool(of_database, databases, threads):
        yield from tables


def database_inventory(
    spark: SparkSession, db_glob: str = "*", catalogs: Sequence[str] | None = None
) -> DataFrame:
    """``catalog, db`` of every database that matches the glob, tables or not."""
    return frame_of(spark, _databases(spark, db_glob, catalogs), "catalog STRING, db STRING")


def table_inventory(
    spark: SparkSession,
    db_glob: str = "*",
    catalogs: Sequence[str] | None = None,
    threads: int = 16,
) -> DataFrame:
    """One row per table and view: ``catalog`` and the columns of an inventory file.

    Times are epoch milliseconds, -1 for never. A table that cannot be described becomes a
    row with an unknown format and type, and the walk goes on.
    """

    def described(place):
        try:
            name = quoted_parts(*place)
            return (*place, spark.sql(f"DESCRIBE EXTENDED {name} AS JSON").first()[0])
        except Exception:  # whatever the catalogue raises, the other tables count
            return (*place, None)

    places = _tables(spark, db_glob, catalogs, threads)
    raw = frame_of(
        spark,
        on_pool(described, places, threads),
        "catalog STRING, db STRING, `table` STRING, meta STRING",
    )
    told = raw.withColumn("m", F.from_json("meta", _TABLE_JSON))
    accessed = F.unix_millis(F.try_to_timestamp("m.last_access"))
    never = F.when(F.col("meta").isNotNull(), F.lit(-1))
    return told.select(
        "catalog",
        "db",
        "table",
        F.coalesce("m.provider", F.lit(MISSING)).alias("format"),
        F.coalesce("m.type", F.lit(MISSING)).alias("type"),
        F.col("m.location").alias("table_location"),
        F.regexp_replace("m.created_by", "^Spark ", "").alias("created_version"),
        F.unix_millis(F.try_to_timestamp("m.created_time")).alias("created_time"),
        F.coalesce(accessed, never).cast("bigint").alias("last_access"),
        F.col("m.serde_library").alias("lib"),
        F.col("m.input_format").alias("inputformat"),
        F.col("m.output_format").alias("outputformat"),
    )


def column_inventory(
    spark: SparkSession,
    db_glob: str = "*",
    catalogs: Sequence[str] | None = None,
    threads: int = 16,
) -> DataFrame:
    """One row per column of every table; `position` counts from 1. A table whose columns
    cannot be listed is one row with position 0, no column and type ``Unknown``; a table without
    columns gives none."""

    def columns_of(place):
        try:
            listed = spark.catalog.listColumns(quoted_parts(*place))
        except Exception:  # as in table_inventory
            return [(*place, 0, None, MISSING, None, None)]
        return [
            (*place, position, c.name, c.dataType, c.nullable, c.isPartition)
            for position, c in enumerate(listed, start=1)
        ]

    places = _tables(spark, db_glob, catalogs, threads)
    rows = (row for table in on_pool(columns_of, places, threads) for row in table)
    return frame_of(
        spark,
        rows,
        "catalog STRING, db STRING, `table` STRING, position INT, `column` STRING, "
        "data_type STRING, nullable BOOLEAN, is_partition BOOLEAN",
    )


def describe_tables(spark: SparkSession, names: Iterable[str], threads: int = 16) -> DataFrame:
    """Key/value rows of every named table: ``table_id, seq, col_name, data_type``, with
    `seq` giving the order of the rows of a table. A table that cannot be described is one
    row with seq -1 and key ``# Error``."""

    def rows_of(name):
        try:
            told = spark.sql(f"DESCRIBE EXTENDED {quoted(name)}").collect()
        except Exception as error:  # as in table_inventory
            return [(name, -1, FAILED_KEY, str(error))]
        return [(name, seq, r["col_name"], r["data_type"]) for seq, r in enumerate(told)]

    rows = (row for table in on_pool(rows_of, names, threads) for row in table)
    return frame_of(
        spark, rows, "table_id STRING, seq INT, col_name STRING, data_type STRING"
    )


def describe_databases(
    spark: SparkSession, names: Iterable[str], threads: int = 16
) -> DataFrame:
    """Key/value rows of every named database: ``db, info_name, info_value``. A database that
    cannot be described is one row with name ``# Error``."""

    def rows_of(name):
        try:
            told = spark.sql(f"DESCRIBE DATABASE EXTENDED {quoted(name)}").collect()
        except Exception as error:  # as in table_inventory
            return [(name, FAILED_KEY, str(error))]
        return [(name, r["info_name"], r["info_value"]) for r in told]

    rows = (row for db in on_pool(rows_of, names, threads) for row in db)
    return frame_of(spark, rows, "db STRING, info_name STRING, info_value STRING")
