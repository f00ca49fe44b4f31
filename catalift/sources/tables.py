"""Files by path, tables by name, and the link between the two."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from catalift.functions.names import literal, quoted, quoted_parts


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a database unless it exists, optionally with its own location."""
    clause = f" LOCATION {literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}{clause}")


def read_path(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None
) -> DataFrame:
    """Table at a path. A given schema saves the inference step."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_path(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> None:
    """Write files at a path. An existing path is an error unless `mode` says otherwise."""
    writer = df.write.format(fmt).mode(mode).options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


# File formats whose partitions Spark keeps in the catalogue, not in the files.
_CATALOGUED = ("parquet", "orc", "csv", "json", "text", "avro")


def register_external(
    spark: SparkSession,
    name: str,
    path: str,
    fmt: str = "parquet",
    schema: StructType | None = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Register an external table on existing files; a no-op if the table exists.

    A given schema, with its partition columns, saves the inference step and keeps the type
    of partition columns, which files do not tell.

    A partitioned table shows no rows until its partitions are listed. That is done under
    a name of its own, and the table takes its final name last, so that a registration
    that died half way never looks finished.
    """
    final = quoted(name)
    columns = f"({schema.toDDL()})" if schema is not None else ""
    parts = f"PARTITIONED BY ({', '.join(map(quoted_parts, partition_by))})" if partition_by else ""
    clauses = f"{columns} USING {fmt} {parts} LOCATION {literal(path)}"
    if fmt.lower() not in _CATALOGUED:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {final} {clauses}")
        return
    _name_last(spark, final, clauses)


def _name_last(spark: SparkSession, final: str, clauses: str, comment: str | None = None) -> None:
    if spark.catalog.tableExists(final):
        return
    staged = f"{final[:-1]}_{uuid.uuid4().hex}`"
    spark.sql(f"CREATE TABLE {staged} {clauses}")
    if comment is not None:
        spark.sql(f"COMMENT ON TABLE {staged} IS {literal(comment)}")
    if partition_columns(spark, staged):
        spark.catalog.recoverPartitions(staged)
    try:
        spark.sql(f"ALTER TABLE {staged} RENAME TO {final}")
    except AnalysisException:
        spark.sql(f"DROP TABLE {staged}")  # external: the files stay
        if not spark.catalog.tableExists(final):
            raise


def table_details(spark: SparkSession, name: str) -> dict:
    """What the catalogue tells of a table: provider, options, properties, comment and more."""
    return json.loads(spark.sql(f"DESCRIBE EXTENDED {quoted(name)} AS JSON").first()[0])


def register_like(
    spark: SparkSession, source: str, name: str, path: str, fmt: str | None = None
) -> None:
    """Register an external table on files, defined as `source` is; a no-op if it exists.

    Columns keep the types and comments they were declared with (CHAR and VARCHAR too), and
    partitions, options or Hive serde and formats, table comment and properties are kept. In
    another format `fmt` the options, which belong to the old one, are left out.
    """
    details = table_details(spark, source)
    provider = (details.get("provider") or "").lower()
    if provider == "hive" and not details.get("serde_library"):
        raise ValueError(f"{source} is a Hive table whose serde is not known")
    kept = details.get("table_properties") or {}
    pairs = ", ".join(f"{literal(k)} = {literal(v)}" for k, v in sorted(kept.items()))
    other = f"USING {fmt}" if fmt and fmt.lower() != provider else ""
    properties = f"TBLPROPERTIES ({pairs})" if pairs else ""
    clauses = f"LIKE {quoted(source)} {other} {properties} LOCATION {literal(path)}"
    _name_last(spark, quoted(name), clauses, details.get("comment"))


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    """Names of the columns a table is partitioned by."""
    columns = spark.catalog.listColumns(quoted(name))
    return [column.name for column in columns if column.isPartition]


def save_table(
    df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Save as a managed table, replacing an older one by default."""
    df.write.format(fmt).mode(mode).saveAsTable(quoted(name))


def read_series(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Labelled series from CSV with a header. The index is an ordinary typed column. A header
    with other columns, or a cell that is not of its type, is an error."""
    reader = spark.read.option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.csv(path, schema=schema, header=True)
