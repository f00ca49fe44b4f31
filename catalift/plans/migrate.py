"""Decide, plan, run and check the move of tables to another database."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from catalift.functions.frames import frame_of
from catalift.functions.names import quoted, quoted_parts
from catalift.functions.pool import on_pool
from catalift.functions.predicates import is_root_storage
from catalift.sources.inventory_csv import failed
from catalift.sources.tables import (
    create_database,
    partition_columns,
    register_external,
    register_like,
    table_details,
    write_path,
)

# The row that ends the data columns of a description, and the keys after it
# that matter here.
DETAIL_MARKER = "# Detailed Table Information"
PROVIDER, KIND, MANAGED_FLAG, LOCATION = "Provider", "Type", "Is_managed_location", "Location"


def pivot_description(description: DataFrame) -> DataFrame:
    """Fold description rows into ``table_id, location, is_view, is_delta, managed``.

    Only rows after the detail marker count, so that a data column named like a key is not
    taken for it; without a marker every row counts. Of several locations the last one
    wins. One aggregate does it all: it keeps the last position of each fact and compares
    that with the position of the marker.
    """
    key, value, seq = F.col("col_name"), F.col("data_type"), F.col("seq")

    def last(condition: Column) -> Column:
        return F.max(F.when(condition, seq))

    # tables with none of the keys are in the result too, so the keys are no filter
    facts = (
        description.groupBy("table_id")
        .agg(
            last(key == DETAIL_MARKER).alias("_marker"),
            last((key == PROVIDER) & (value == "delta")).alias("_delta"),
            last((key == KIND) & (value == "VIEW")).alias("_view"),
            last(
                ((key == MANAGED_FLAG) & (value == "true")) | ((key == KIND) & (value == "MANAGED"))
            ).alias("_managed"),
            F.max(F.when(key == LOCATION, F.struct(seq, value))).alias("_location"),
        )
    )

    def told(position: Column) -> Column:
        return position.isNotNull() & (position > F.coalesce("_marker", F.lit(-1)))

    return facts.select(
        "table_id",
        F.when(told(F.col("_location.seq")), F.col("_location.data_type")).alias("location"),
        told(F.col("_view")).alias("is_view"),
        told(F.col("_delta")).alias("is_delta"),
        told(F.col("_managed")).alias("managed"),
    )


def should_copy(location: Column, managed: Column) -> Column:
    """Managed tables and tables on root storage are copied; the rest is registered."""
    return is_root_storage(location) | F.coalesce(managed, F.lit(False))


def classify_copy(description: DataFrame) -> DataFrame:
    """``table_id, location, is_view, is_delta, should_copy`` of every described table."""
    return pivot_description(description).select(
        "table_id",
        "location",
        "is_view",
        "is_delta",
        should_copy(F.col("location"), F.col("managed")).alias("should_copy"),
    )


def _place(inventory: DataFrame, database: str) -> DataFrame:
    """Rows of one database, ``db`` or ``catalog.db``, with their full ``_name``."""
    catalog, _, db = database.rpartition(".")
    rows = inventory.where(F.col("db") == db)
    parts = ["db", "table"]
    if catalog:
        rows = rows.where(F.col("catalog") == catalog)
        parts = ["catalog", *parts]
    return rows.withColumn("_name", F.concat_ws(".", *parts))


def plan_sync(
    source: DataFrame,
    target: DataFrame,
    source_db: str,
    target_db: str,
    tables: Sequence[str] | None = None,
) -> DataFrame:
    """Dry run of moving a database, or the named tables of it: one row per source table.

    `source` and `target` are table inventories; databases are named ``db`` or
    ``catalog.db``, the second if the inventory has a column ``catalog``. Status: ERROR for a
    table that could not be described or has no files, for two sources that would share a
    target or two targets of one name, and where the target's name is taken by something else (a view, or for tables
    registered in place files elsewhere or of another format); VIEW_SKIPPED; EXISTS at the
    target; NEEDS_COPY; READY to be registered in place. ``message`` tells the error.
    """
    source = _place(source, source_db)
    if tables is not None:
        source = source.where(F.col("table").isin(*tables))
    # one target of each name, but for inventories of several catalogues; its facts stay together
    facts = F.struct(
        F.rtrim(F.col("table_location"), F.lit("/")).alias("location"),
        F.lower("format").alias("format"),
        "type",
    )
    there = _place(target, target_db).groupBy("table").agg(F.max(facts).alias("_there"), (F.min(facts) != F.max(facts)).alias("_several"))
    there = there.select(
        "table",
        "_several",
        F.col("_there.location").alias("_location"),
        F.col("_there.format").alias("_format"),
        F.col("_there.type").alias("_type"),
    )
    copy = should_copy(F.col("table_location"), F.col("type") == "MANAGED")
    elsewhere = ~F.col("_location").eqNullSafe(F.rtrim(F.col("table_location"), F.lit("/"))) | ~F.col(
        "_format"
    ).eqNullSafe(F.lower("format"))
    taken = (F.col("_type") == "VIEW") | (~F.col("should_copy") & elsewhere)
    message = (
        F.when(failed(source), "not described")
        .when(F.col("type") == "VIEW", None)
        .when(F.col("_sources") > 1, "two sources have this target")
        .when(F.col("_several"), "two targets have this name")
        .when(F.col("_type").isNotNull() & F.coalesce(taken, F.lit(False)), "the target is another table")
        .when(F.col("_type").isNull() & F.col("table_location").isNull(), "no files")
    )
    status = (
        F.when(F.col("message").isNotNull(), "ERROR")
        .when(F.col("type") == "VIEW", "VIEW_SKIPPED")
        .when(F.col("_type").isNotNull(), "EXISTS")
        .when(F.col("should_copy"), "NEEDS_COPY")
        .otherwise("READY")
    )
    # one table of each name, but for inventories of several catalogues
    sources = source.groupBy("table").agg(F.count("*").alias("_sources"))
    return (
        source.withColumn("should_copy", copy)
        .join(sources, "table")
        .join(there, "table", "left")
        .withColumn("message", message)
        .select(
            F.col("_name").alias("source_name"),
            F.concat_ws(".", F.lit(target_db), F.col("table")).alias("target_name"),
            "type",
            "format",
            F.col("table_location").alias("location"),
            "should_copy",
            status.alias("status"),
            "message",
        )
    )


def _register(spark: SparkSession, row: Row, path: str, fmt: str) -> None:
    """Register as the source is defined; a format with a log of its own brings its columns."""
    if fmt.lower() == "delta":
        register_external(spark, row["target_name"], path, fmt)
    else:
        register_like(spark, row["source_name"], row["target_name"], path, fmt)


def _file_options(spark: SparkSession, source: str, fmt: str) -> dict[str, str]:
    """Options of a table, with which files of its own format are written and read."""
    details = table_details(spark, source)
    if fmt.lower() != (details.get("provider") or "").lower():
        return {}
    options = details.get("storage_properties") or {}
    return {k: v for k, v in options.items() if k.lower() not in ("path", "serialization.format")}


def _copy(spark: SparkSession, source: str, path: str, fmt: str) -> None:
    """Copy into a folder of its own."""
    parts, options = partition_columns(spark, source), _file_options(spark, source, fmt)
    write_path(spark.table(quoted(source)), path, fmt, partition_by=parts, options=options)


def run_sync(
    spark: SparkSession,
    plan: DataFrame,
    location: str,
    fmt: str | None = None,
    allow_managed: bool = False,
    threads: int = 4,
    register: bool = True,
) -> DataFrame:
    """Carry out a plan: ``source_name, target_name, action, status, message``.

    READY tables are registered in place. NEEDS_COPY tables are copied by Spark into a
    folder below `location`, in format `fmt` or their own, and registered there; managed
    ones only with `allow_managed`. Both end as EXISTS and may be run again. A table that
    fails ends as ERROR and the others go on. Up to `threads` tables move at once; only
    their names pass through the driver.

    Every copy is told to the journal of `location` (:func:`sync_journal`) when it begins, when
    its files are complete and when it is registered. A run that finds a complete copy in
    another run's record, of the same rows as the source holds now, registers that: its action
    is RESUMED. A copy that was begun and not completed, or that is out of date, stays where it
    is; the table is copied anew and the message names the folder. With `register` off tables
    are copied only, and a later run puts them in place.
    """
    made: set[str] = set()
    known = {
        (row["source_name"], row["target_name"]): row for row in sync_journal(spark, location).collect()
    }  # a row for each table that was ever copied there

    def copied(row, form):
        """A complete copy, the action that made it, and what was found on the way."""
        pair = row["source_name"], row["target_name"]
        before = known.get(pair)
        left = before["folder"] if before and before["state"] != REGISTERED else None
        if left and before["state"] == COMPLETE and before["format"] == form:
            if _same_rows(spark.table(quoted(pair[0])), read_copy(spark, pair[0], left, form)):
                return left, "RESUMED", None
        path = f"{location.rstrip('/')}/{pair[1]}/{uuid.uuid4().hex}"
        _note(spark, location, pair, BEGUN, path, form)
        _copy(spark, pair[0], path, form)
        _note(spark, location, pair, COMPLETE, path, form)
        return path, "COPIED", f"left behind: {left}" if left else None

    def moved(row):
        pair = row["source_name"], row["target_name"]
        status, action, message = row["status"], None, None
        if status == "NEEDS_COPY" and row["type"] == "MANAGED" and not allow_managed:
            return *pair, None, status, "managed tables not allowed"
        try:
            if status == "READY" and register:
                _register(spark, row, row["location"], row["format"])
                status, action = "EXISTS", "REGISTERED"
            elif status == "NEEDS_COPY":
                form = fmt or row["format"]
                path, action, message = copied(row, form)
                if register:
                    _register(spark, row, path, form)
                    _note(spark, location, pair, REGISTERED, path, form)
                    status = "EXISTS"
        except Exception as error:  # whatever a table raises, the others count
            return *pair, None, "ERROR", str(error)
        return *pair, action, status, message

    def rows():
        for row in plan.toLocalIterator():
            database = row["target_name"].rpartition(".")[0]
            if database not in made:
                create_database(spark, database)
                made.add(database)
            yield row

    return frame_of(
        spark,
        on_pool(moved, rows(), threads),
        "source_name STRING, target_name STRING, action STRING, status STRING, message STRING",
    )


# States of a copy in the journal, in the order in which they are reached.
BEGUN, COMPLETE, REGISTERED = "BEGUN", "COMPLETE", "REGISTERED"

_EVENT = "source_name STRING, target_name STRING, state STRING, folder STRING, format STRING, at TIMESTAMP"


def _note(spark: SparkSession, location: str, pair: tuple[str, str], state: str, folder: str, form: str) -> None:
    """Append an event to the journal: a folder of its own that appears whole or not at all, so
    that threads and runs do not get into each other's way."""
    event = spark.createDataFrame([(*pair, state, folder, form)], _EVENT.rpartition(",")[0])
    path = f"{location.rstrip('/')}/{JOURNAL}/{uuid.uuid4().hex}"
    event.withColumn("at", F.current_timestamp()).coalesce(1).write.json(path)


# The folder of the journal, next to those of the copies.
JOURNAL = "sync-journal"


def sync_journal(spark: SparkSession, location: str) -> DataFrame:
    """The latest copy of every table that runs have made at a location: ``source_name,
    target_name, state, folder, format, at``, and ``half_made``, the folders of earlier copies that
    were begun and neither completed nor registered, this one included. Nothing is deleted."""
    try:
        events = spark.read.schema(_EVENT).json(f"{location.rstrip('/')}/{JOURNAL}/*")
    except AnalysisException:  # no run has copied anything
        events = spark.createDataFrame([], _EVENT)
    rank = F.array_position(F.array(F.lit(BEGUN), F.lit(COMPLETE), F.lit(REGISTERED)), F.col("state"))
    copies = events.groupBy("source_name", "target_name", "folder").agg(
        F.max(F.struct(rank.alias("rank"), "state", "format", "at")).alias("last"), F.min("at").alias("begun")
    )
    return copies.groupBy("source_name", "target_name").agg(
        F.max(F.struct("begun", "last", "folder")).alias("latest"),
        F.array_sort(F.collect_list(F.when(F.col("last.state") == BEGUN, F.col("folder")))).alias("half_made"),
    ).select(
        "source_name", "target_name", "latest.last.state", "latest.folder", "latest.last.format", "latest.last.at", "half_made"
    )


def read_copy(spark: SparkSession, source: str, path: str, fmt: str) -> DataFrame:
    """The files of a copy with the columns of its source."""
    reader = spark.read.format(fmt).options(**_file_options(spark, source, fmt))
    return reader.load(path) if fmt.lower() == "delta" else reader.schema(spark.table(quoted(source)).schema).load(path)


def _same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.agg(*content_hash(a)).first() == b.agg(*content_hash(b)).first()


# Width of the pieces of a 64-bit hash that are summed apart. A sum of 16-bit numbers in a
# BIGINT overflows only beyond 2^47 rows, and needs no wide decimal.
_PIECE = 16


def _parts(value: Column, kind: DataType) -> list[Column]:
    """Columns that tell values of a type apart, NULL at any depth included, none of them NULL
    but where the flag before it says so. Arrays are hashed with their size and in order, maps
    by their sorted entries."""
    null = value.isNull()
    if isinstance(kind, StructType):
        inner = (part for f in kind for part in _parts(value.getField(f.name), f.dataType))
        return [null, *inner]
    if isinstance(kind, ArrayType):
        items = F.transform(value, lambda x: F.xxhash64(*_parts(x, kind.elementType)))
        return [null, F.size(value), items]
    if isinstance(kind, MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                F.xxhash64(*_parts(e["key"], kind.keyType)).alias("k"),
                F.xxhash64(*_parts(e["value"], kind.valueType)).alias("v"),
            ),
        )
        return [null, F.size(value), F.array_sort(entries)]
    return [null, value]


def content_hash(df: DataFrame) -> list[Column]:
    """Aggregates that identify the rows of a frame whatever their order: the row count as
    ``rows`` and a text of the schema and the summed row hashes as ``hash``.

    Sums, unlike XOR, also tell apart frames that differ in how often a row occurs. NULL is
    hashed by its place, in structs, arrays and maps too; the order of map entries is not.
    """
    fields = sorted(df.schema.fields, key=lambda field: field.name.lower())
    schema = ",".join(f"{field.name.lower()}:{field.dataType.simpleString()}" for field in fields)
    return [
        F.count("*").alias("rows"),
        F.concat_ws("-", F.md5(F.lit(schema)), *(F.coalesce(p, F.lit(0)) for p in hash_sums(df))).alias("hash"),
    ]


def row_hash(df: DataFrame, seed: int | None = None) -> Column:
    """64 bits of a whole row, columns in the order of their names; other seeds give other bits."""
    fields = sorted(df.schema.fields, key=lambda field: field.name.lower())
    parts = [p for f in fields for p in _parts(F.col(quoted_parts(f.name)), f.dataType)]
    return F.xxhash64(*([] if seed is None else [F.lit(seed)]), *parts)


def hash_sums(df: DataFrame) -> list[Column]:
    """Sums of the pieces of row hashes: those of parts of a frame add up to those of the whole."""
    return [
        F.sum(F.shiftrightunsigned(row_hash(df), shift).bitwiseAND(F.lit((1 << _PIECE) - 1)))
        for shift in range(0, 64, _PIECE)
    ]


def reconcile(
    spark: SparkSession, pairs: Iterable[tuple[str, str]], threads: int = 4
) -> DataFrame:
    """Compare every source table with its target: ``source_name, target_name, source_rows,
    target_rows, source_hash, target_hash, matches, message``.

    Each table is one scan into one row, a job of its own on a bounded pool, so that any
    number of pairs is planned one by one. Nothing is joined. A table that is not there or
    cannot be read has NULL rows, does not match, and is named in the message.
    """

    def side(name):
        try:
            df = spark.table(quoted(name))
            row = df.agg(*content_hash(df)).first()
            return row["rows"], row["hash"], None
        except Exception as error:  # whatever a table raises, the others count
            return None, None, f"{name}: {error}"

    def compared(pair):
        (rows, digest, wrong), (other_rows, other_digest, other_wrong) = map(side, pair)
        matches = wrong is None and other_wrong is None and (rows, digest) == (other_rows, other_digest)
        message = "; ".join(filter(None, (wrong, other_wrong))) or None
        return (*pair, rows, other_rows, digest, other_digest, matches, message)

    return frame_of(
        spark,
        on_pool(compared, pairs, threads),
        "source_name STRING, target_name STRING, source_rows BIGINT, target_rows BIGINT, "
        "source_hash STRING, target_hash STRING, matches BOOLEAN, message STRING",
    )
