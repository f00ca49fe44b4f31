"""Every operator as a query over the test tables.

Each query reads its tables whole. Queries that write use a fresh folder and database per
call, so that they may run again and side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from catalift import operators as ops
from catalift import plans, sources
from catalift.functions import name_contains_any, name_glob, scratch_dir
from catalift.functions import owned_by as owned
from catalift.functions.frames import stored
from catalift.functions.pool import on_pool

TRAINING = ("1995-01-01", "1999-01-01")
VALIDATION = ("1999-01-01", "2000-01-01")
ANCHOR = date(2001, 6, 15)
LATE_ANCHOR = date(2030, 1, 1)
MODEL = "price"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sources.read_path(spark, f"{sf_dir}/{name}.parquet")


def _new_database(spark: SparkSession) -> str:
    name = f"catalift_{uuid.uuid4().hex}"
    sources.create_database(spark, name, scratch_dir(spark))
    return name


# Inventory and names


def inventory_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    inventory = _read(spark, sf_dir, "part").select(
        F.col("p_type").alias("type"),
        F.when(kind == 0, "HIVE")
        .when(kind == 1, "parquet")
        .when(kind == 2, "delta")
        .otherwise("Unknown")
        .alias("format"),
    )
    return ops.inventory_profile(inventory)


def inventory_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    told = key % 7 != 0
    inventory = _read(spark, sf_dir, "part").select(
        F.concat(F.lit("db"), key % 10).alias("db"),
        F.concat(F.lit("t"), key).alias("table"),
        F.when(told, F.col("p_brand")).alias("format"),
        F.when(told, F.lit("EXTERNAL")).alias("type"),
        F.when(told, F.concat(F.lit("file:/a,b/"), key)).alias("table_location"),
        F.lit("4.1").alias("created_version"),
        F.when(told, key * 1000).alias("created_time"),
        F.lit(-1).cast("bigint").alias("last_access"),
        *(F.lit(None).cast("string").alias(c) for c in ("lib", "inputformat", "outputformat")),
    )
    path = scratch_dir(spark)
    sources.write_inventory(inventory, path)
    return reduce(
        DataFrame.unionAll,
        (
            sources.read_inventory(spark, path, infer=infer)
            .withColumn("last_access", F.col("last_access").cast("bigint"))
            .withColumn("created_time", F.col("created_time").cast("bigint"))
            .withColumn("created_version", F.col("created_version").cast("string"))
            .withColumnRenamed("table", "table_name")
            .withColumn("inferred", F.lit(infer))
            .withColumns({c: F.coalesce(c, F.lit("absent")) for c in ("lib", "inputformat", "outputformat")})
            for infer in (False, True)
        ),
    )


def _registered(spark: SparkSession, sf_dir: str) -> str:
    database = _new_database(spark)

    def register(name):
        sources.register_external(spark, f"{database}.{name}", f"{sf_dir}/{name}.parquet")

    list(on_pool(register, TABLES, 8))
    return database


def _rows_of(spark: SparkSession, database: str) -> DataFrame:
    counts = (
        spark.table(f"{database}.{name}").agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n_rows")
        )
        for name in TABLES
    )
    return reduce(DataFrame.unionAll, counts)


def table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = _registered(spark, sf_dir)
    inventory = sources.table_inventory(spark, database).select(
        F.col("table").alias("table_name"), "format", "type", "last_access"
    )
    return inventory.join(_rows_of(spark, database), "table_name")


def column_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = _registered(spark, sf_dir)
    inventory = sources.column_inventory(spark, database).select(
        F.col("table").alias("table_name"),
        F.col("column").alias("column_name"),
        "position",
        "data_type",
    )
    return inventory.join(_rows_of(spark, database), "table_name")


def database_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases named after the segments of customers, found again by a glob."""
    prefix = f"catalift_{uuid.uuid4().hex}"
    segments = _read(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    for row in segments.toLocalIterator():
        sources.create_database(spark, f"{prefix}_{row[0].lower()}", scratch_dir(spark))
    found = sources.database_inventory(spark, f"{prefix}_*")
    return found.select(F.upper(F.substring_index("db", "_", -1)).alias("segment"), "catalog")


def describe_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A described database for every 5,000 order keys, and one that is not there, beside the
    orders of these keys."""
    batch = F.floor(F.col("o_orderkey") / 5000).alias("batch")
    orders = _read(spark, sf_dir, "orders").groupBy(batch).agg(F.count("*").alias("n_orders"))
    names = {f"catalift_{uuid.uuid4().hex}": r.batch for r in orders.toLocalIterator()}
    for name in names:
        sources.create_database(spark, name, scratch_dir(spark))
    told = sources.describe_databases(spark, [*names, f"catalift_{uuid.uuid4().hex}"])
    known = spark.createDataFrame(list(names.items()), "db STRING, batch LONG")
    facts = F.count_if(F.col("info_name").isin("Catalog Name", "Namespace Name", "Location"))
    described = (
        told.join(known, "db", "left")
        .groupBy(F.coalesce("batch", F.lit(-1).cast("long")).alias("batch"))
        .agg(facts.alias("facts"), F.count_if(F.col("info_name") == "# Error").alias("errors"))
    )
    return described.join(orders, "batch", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0).cast("long")))


def catalog_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues as rows fit the clean-up filter; those of the session, marked by name,
    against the parts of a type."""
    catalogs = sources.catalog_inventory(spark).select(F.col("catalog").alias("db"))
    types = _read(spark, sf_dir, "part").select(F.col("p_type").alias("db"))
    return ops.cleanup_candidates(catalogs.union(types), ["spark_cat", "ECO"])


def contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return name_contains_any(parts, "p_name", ["ring", "small"])


def glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return name_glob(customers, "c_name", "CUSTOMER*0001*")


def cleanup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = _read(spark, sf_dir, "part").select(F.col("p_type").alias("db"))
    return ops.cleanup_candidates(inventory, ["AN", "ECO"])


def owned_not_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.owned_not_marked(
        _read(spark, sf_dir, "customer"),
        _read(spark, sf_dir, "orders"),
        key="c_custkey",
        mark_key="o_custkey",
        tag="o_orderpriority",
        prefix="1-",
        owner_col="c_mktsegment",
        owner="BUILDING",
    ).select("c_custkey", "c_name")


def owned_by_me(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default owner is the user of the session."""
    mine = F.when(F.col("c_custkey") % 3 == 0, F.current_user()).otherwise("someone else")
    customers = _read(spark, sf_dir, "customer").select("c_custkey", mine.alias("owner"))
    return owned(customers, "owner").select("c_custkey")


def owned_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return owned(customers, "c_mktsegment", "BUILDING")


# Table migration


def describe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables in place, and their classes from their own descriptions."""
    database = _registered(spark, sf_dir)
    described = sources.describe_tables(spark, [f"{database}.{name}" for name in TABLES])
    classes = plans.classify_copy(described).select(
        F.substring_index("table_id", ".", -1).alias("table_name"),
        "is_view",
        "is_delta",
        "should_copy",
    )
    return classes.join(_rows_of(spark, database), "table_name")


def classify_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 5
    bare = F.col("p_partkey") % 7 == 3
    view = kind == 4
    location = (
        F.when(kind == 0, "dbfs:/user/hive/warehouse/a")
        .when(kind == 1, "dbfs:/mnt/a")
        .when(kind == 2, "dbfs:/mnt/b")
        .when(kind == 3, "wasbs://c@a/t")
    )
    managed = F.when(kind.isin(0, 2), "MANAGED").otherwise("EXTERNAL")
    # a data column named like a key, the marker, then the keys
    described = F.array(
        _pair("id", F.lit("bigint")),
        F.when(~bare, _pair("Location", F.lit("string"))),
        F.when(~bare, _pair("# Detailed Table Information", F.lit(""))),
        F.when(~bare, _pair("Type", F.when(view, "VIEW").otherwise(managed))),
        F.when(~bare & ~view, _pair("Provider", F.lit("delta"))),
        F.when(~bare & ~view, _pair("Location", location)),
    )
    description = (
        _read(spark, sf_dir, "part")
        .select(F.col("p_partkey").alias("table_id"), F.posexplode(F.array_compact(described)))
        .select("table_id", F.col("pos").alias("seq"), "col.*")
    )
    return plans.classify_copy(description)


def _pair(key: str, value) -> F.Column:
    return F.struct(F.lit(key).alias("col_name"), value.alias("data_type"))


def path_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    sources.write_path(_read(spark, sf_dir, "nation"), path)
    name = f"{_new_database(spark)}.nation"
    sources.register_external(spark, name, path)
    sources.register_external(spark, name, path)
    return ops.sample_head(spark.table(name), 10, ["n_nationkey"])


def table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{_new_database(spark)}.customer"
    customers = _read(spark, sf_dir, "customer")
    sources.save_table(customers.where("c_acctbal < 0"), name)
    sources.save_table(customers, name)
    return spark.table(name)


def _moved(spark: SparkSession, source: str) -> DataFrame:
    """Walk, dry-run, move and check a database."""
    target = _new_database(spark)
    plan = plans.plan_sync(
        sources.table_inventory(spark, source),
        sources.table_inventory(spark, target),
        source,
        target,
    )
    moved = plans.run_sync(spark, plan, scratch_dir(spark), allow_managed=True)
    pairs = (
        (row["source_name"], row["target_name"])
        for row in moved.where("status = 'EXISTS'").toLocalIterator()
    )
    return plans.reconcile(spark, pairs).select(
        F.substring_index("source_name", ".", -1).alias("table_name"),
        "source_rows",
        "target_rows",
        "matches",
    )


def sync_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All given tables: customer is managed and copied, the others are registered in place,
    a view is left."""
    source = _registered(spark, sf_dir)
    spark.sql(f"DROP TABLE {source}.customer")  # external: the files stay
    sources.save_table(_read(spark, sf_dir, "customer"), f"{source}.customer")
    spark.sql(f"CREATE VIEW {source}.names AS SELECT c_name FROM {source}.customer")
    return _moved(spark, source)


def sync_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV tables with options and declared types: one in place, one managed and copied."""
    source, path = _new_database(spark), scratch_dir(spark)
    nations = _read(spark, sf_dir, "nation")
    sources.write_path(nations, path, "csv", options={"header": "true", "sep": "|"})
    columns = "(n_nationkey INT, n_name VARCHAR(25) COMMENT 'name', n_regionkey INT)"
    form = "USING csv OPTIONS (header 'true', sep '|')"
    spark.sql(f"CREATE TABLE {source}.placed {columns} {form} LOCATION '{path}' TBLPROPERTIES ('k' = 'v')")
    spark.sql(f"CREATE TABLE {source}.kept {columns} {form}")
    nations.write.insertInto(f"{source}.kept")
    return _moved(spark, source)


def sync_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables are copied by a run that does not put them in place; one changes; the next run takes
    up the copies that are still right."""
    source, target, location = _new_database(spark), _new_database(spark), scratch_dir(spark)
    for name in ("customer", "orders", "supplier"):
        sources.save_table(_read(spark, sf_dir, name), f"{source}.{name}")
    inventory = sources.table_inventory(spark, source)

    def run(register):
        plan = plans.plan_sync(inventory, sources.table_inventory(spark, target), source, target)
        return plans.run_sync(spark, plan, location, allow_managed=True, register=register)

    run(False)
    _read(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").write.insertInto(f"{source}.supplier")
    done = run(True)
    pairs = [(r["source_name"], r["target_name"]) for r in done.collect()]
    checked = plans.reconcile(spark, pairs).select("source_name", "source_rows", "target_rows", "matches")
    return done.join(checked, "source_name").select(
        F.substring_index("source_name", ".", -1).alias("table_name"), "action", "status", "source_rows", "target_rows", "matches"
    )


def reconcile_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy with some left out, changed, doubled and added."""
    orders, key = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.col("o_totalprice") + F.when(key % 89 == 7, 1).otherwise(0)
    times = F.when(key % 101 == 3, 2).otherwise(1)
    copy = orders.where(key % 97 != 5).withColumn("o_totalprice", price).withColumn("n", F.explode(F.sequence(F.lit(1), times)))
    added = orders.where(key % 103 == 9).withColumn("o_orderkey", -key)
    copy = stored(copy.drop("n").unionAll(added))
    return plans.differences(orders, copy, ["o_orderkey"], bucket_rows=1_000)


def plan_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues with tables of one name: planned one by one, and without naming one."""
    key = F.col("p_partkey")
    parts = _read(spark, sf_dir, "part").select(
        F.explode(F.when(key % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("catalog"),
        F.lit("d").alias("db"),
        F.concat(F.lit("t"), key).alias("table"),
        F.lit("delta").alias("format"),
        F.when(key % 11 == 0, "VIEW").otherwise("EXTERNAL").alias("type"),
        F.concat(F.lit("dbfs:"), F.when(key % 5 > 0, "/mnt/").otherwise("/"), key).alias("table_location"),
        (key % 7).alias("_known"),
    )
    there = F.concat("table_location", F.when(F.col("_known") == 1, "x").otherwise(""))
    target = (
        parts.where("_known IN (0, 1) AND catalog = 'a'")
        .withColumn("table_location", there)
        .withColumn("catalog", F.lit("main"))
        .withColumn("db", F.lit("s"))
    )
    return reduce(
        DataFrame.unionAll,
        (
            plans.plan_sync(parts, target, source, "main.s").select(
                F.lit(source).alias("source"), "source_name", "target_name", "status"
            )
            for source in ("a.d", "b.d", "d")
        ),
    )


# Series


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ops.time_split(orders, "o_orderdate", {"train": TRAINING, "validation": VALIDATION})


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date").alias("day")
    return _read(spark, sf_dir, "orders").groupBy(day).agg(F.count("*").alias("n"))


def read_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    _daily(spark, sf_dir).write.option("header", True).csv(path)
    return sources.read_series(spark, path, "day DATE, n BIGINT")


def forecast_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.forecast_window(_daily(spark, sf_dir), "day", ANCHOR)


def forecast_window_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.forecast_window(_daily(spark, sf_dir), "day", LATE_ANCHOR)


def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and label apart, joined again by their key."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    features, label = ops.label_split(orders, "o_totalprice", ["o_orderkey"])
    return features.join(label, "o_orderkey")


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the orders within a hundredth, and all lines of an order on one side."""
    held = ops.holdout(_read(spark, sf_dir, "lineitem"), ["l_orderkey"])
    share = F.abs(F.avg(F.col("held_back").cast("int")) - 0.2) < 0.05
    sides = held.groupBy("l_orderkey").agg(
        F.count("*").alias("lines"), F.count_distinct("held_back").alias("sides"), F.max("held_back").alias("held_back")
    )
    return sides.agg(F.sum("lines").alias("lines"), F.max("sides").alias("sides"), share.alias("about_a_fifth"))


def forecast_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = ops.forecast_window(_daily(spark, sf_dir), "day", ANCHOR)
    predictions = window.select("day", (F.col("n") * 2).alias("prediction"))
    actuals = window.where("has_actual").select("day", F.col("n").alias("actual"))
    return ops.forecast_vs_actual(predictions, actuals, "day")


# Models


def _lineitem(spark: SparkSession, sf_dir: str, span: tuple[str, str]) -> DataFrame:
    return ops.slice_inclusive(_read(spark, sf_dir, "lineitem"), "l_shipdate", *span)


def _linear(spark: SparkSession, sf_dir: str):
    training = _lineitem(spark, sf_dir, TRAINING)
    return ops.fit_linear(training, ["l_quantity"], "l_extendedprice")


def validation_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    validation = _lineitem(spark, sf_dir, VALIDATION)
    scored = ops.score(_linear(spark, sf_dir), validation, ["l_extendedprice"])
    return ops.mse(scored, "l_extendedprice").select(
        F.round("mse").cast("bigint").alias("mse"), F.round("mse", 2).alias("exact"), "unscored"
    )


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir, VALIDATION).withColumn("model", F.lit(MODEL))
    aliases = spark.createDataFrame(
        [(MODEL, "Champion", 2), (MODEL, "Challenger", 3)], "name STRING, alias STRING, version INT"
    )
    scored = ops.score_by_alias(
        rows,
        aliases,
        {(MODEL, 2): _linear(spark, sf_dir)},
        ["l_orderkey", "l_linenumber"],
        alias="Champion",
    )
    return scored.select(
        "l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction")
    )


def compare_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = "l_extendedprice"
    mean = _lineitem(spark, sf_dir, TRAINING).agg(F.avg(label)).scalar()
    validation = _lineitem(spark, sf_dir, VALIDATION)
    scored = ops.score(_linear(spark, sf_dir), validation, [label]).select(
        label,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("version"), mean.alias("prediction")),
                F.struct(F.lit(2).alias("version"), "prediction"),
            )
        ).alias("v"),
    )
    return ops.compare_versions(scored.select(label, "v.*"), label).select(
        "version", F.round("mse").cast("bigint").alias("mse")
    )


def champion_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fitted models behind two aliases score the same rows and are compared; then the
    better one is promoted and scores as Champion."""
    label, keys = "l_extendedprice", ["l_orderkey", "l_linenumber", "l_extendedprice"]
    training = _lineitem(spark, sf_dir, TRAINING)
    validation = _lineitem(spark, sf_dir, VALIDATION).withColumn("model", F.lit(MODEL))
    models = {
        (MODEL, version): ops.fit_linear(training, [feature], label)
        for version, feature in ((1, "l_discount"), (2, "l_quantity"))
    }
    kind = "name STRING, alias STRING, version INT"
    aliases = spark.createDataFrame([(MODEL, "Champion", 1), (MODEL, "Challenger", 2)], kind)
    names = F.explode(F.array(F.lit("Champion"), F.lit("Challenger"))).alias("alias")
    both = ops.score_by_alias(validation.select("*", names), aliases, models, keys)
    compared = stored(ops.compare_versions(both, label))
    best = compared.orderBy("mse").limit(1).select(F.lit(MODEL).alias("name"), F.lit("Champion").alias("alias"), "version")
    promoted = ops.score_by_alias(validation, best, models, keys, "Champion")
    after = ops.compare_versions(promoted, label)
    stages = [compared.withColumn("stage", F.lit("compared")), after.withColumn("stage", F.lit("promoted"))]
    return reduce(DataFrame.unionAll, stages).select("stage", "version", F.round("mse", 2).alias("mse"), "unscored")


def network_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line and a network, versions 1 and 2, on a label that bends: the errors of the line, and
    whether the network's are below a twentieth of them."""
    bent = F.abs(F.col("l_quantity") - 25).alias("bent")
    training, validation = (
        _lineitem(spark, sf_dir, span).select("l_orderkey", "l_linenumber", "l_quantity", bent) for span in (TRAINING, VALIDATION)
    )
    keys = ["l_orderkey", "l_linenumber"]
    models = {
        (MODEL, 1): ops.fit_linear(training, ["l_quantity"], "bent"),
        (MODEL, 2): ops.fit_network(training, ["l_quantity"], "bent", epochs=40, key=keys),
    }
    kind = "name STRING, alias STRING, version INT"
    aliases = spark.createDataFrame([(MODEL, "Champion", 1), (MODEL, "Challenger", 2)], kind)
    names = F.explode(F.array(F.lit("Champion"), F.lit("Challenger"))).alias("alias")
    rows = validation.select("*", F.lit(MODEL).alias("model"), names)
    scored = ops.score_by_alias(rows, aliases, models, [*keys, "bent"])
    compared = ops.compare_versions(scored, "bent")
    of = lambda version: F.max(F.when(F.col("version") == version, F.col("mse")))
    return compared.agg(F.round(of(1), 4).alias("line"), (of(2) * 20 < of(1)).alias("network_better"), F.sum("unscored").alias("unscored"))


def score_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each line number, fitted on its lines; all lines are scored at once, but for
    those of a number whose alias points at a version that is not there."""
    label, keys = "l_extendedprice", ["l_orderkey", "l_linenumber"]
    training = stored(_lineitem(spark, sf_dir, TRAINING).select("l_linenumber", "l_quantity", label))
    numbers = [row[0] for row in training.select("l_linenumber").distinct().orderBy("l_linenumber").collect()]
    models = {
        (f"line{n}", 1): ops.fit_linear(training.where(F.col("l_linenumber") == n), ["l_quantity"], label) for n in numbers
    }
    aliases = spark.createDataFrame(
        [(name, "Champion", 1 if name != "line3" else 9) for name, _ in models], "name STRING, alias STRING, version INT"
    )
    rows = _lineitem(spark, sf_dir, VALIDATION).withColumn("model", F.concat(F.lit("line"), "l_linenumber"))
    scored = ops.score_by_alias(rows, aliases, models, keys, alias="Champion")
    return scored.select(*keys, "version", F.round("prediction", 4).alias("prediction"))


def forest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, label = ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
    keys = ["l_orderkey", "l_linenumber"]
    forest = ops.fit_forest(_lineitem(spark, sf_dir, TRAINING), features, label, key=keys)
    return ops.score(forest, _lineitem(spark, sf_dir, VALIDATION), keys)


def forest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest of `forest_score` on a label that a feature of few values decides: every leaf
    is pure, whatever sample a tree saw, so the prediction of every row is known."""
    features, label = ["l_linenumber", "l_discount"], "label"
    keys = ["l_orderkey", "l_linenumber"]
    line = F.col("l_linenumber")
    training = _lineitem(spark, sf_dir, TRAINING).withColumn(label, 3.0 * line * line + 1)
    forest = ops.fit_forest(training, features, label, key=keys)
    return ops.score(forest, _lineitem(spark, sf_dir, VALIDATION), keys)


def holdout_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ops.holdout_tail(orders, "o_orderkey")


SIGNATURE = StructType(
    [
        StructField("c_acctbal", DoubleType(), False),
        StructField("c_nationkey", LongType(), False),
        StructField("c_custkey", LongType(), False),
        StructField("c_comment", StringType(), True),
    ]
)


def conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column widens, one is optional and absent, two are not declared."""
    conformed = ops.conform(_read(spark, sf_dir, "customer"), SIGNATURE)
    return conformed.fillna("absent", ["c_comment"])


# Registry


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select(
        F.concat(F.lit("m"), F.col("o_custkey") % 50).alias("name"),
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
    )
    numbered = ops.number_within(orders, ["name"], "o_orderkey", "_version")
    status = F.col("o_orderstatus")
    return numbered.select(
        "name",
        F.col("_version").cast("string").alias("version"),
        F.when(status == "P", "Production")
        .when(status == "O", "Staging")
        .otherwise("Archived")
        .alias("current_stage"),
        (F.col("o_orderpriority") != "5-LOW").alias("has_signature"),
    )


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.latest_version(_versions(spark, sf_dir)).withColumnRenamed("name", "model")


def stage_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.stage_alias(_versions(spark, sf_dir)).withColumnRenamed("name", "model")


def upgrade_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plans.upgrade_plan(_versions(spark, sf_dir), "main", "migrated_models")
    return _planned(plan)


def _planned(plan: DataFrame) -> DataFrame:
    return plan.select(F.col("name").alias("model"), "version", "dest_name", "status", "dest_version")


def upgrade_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid and missing names, models without versions, and what versions carry; then the
    models alone."""
    key = F.col("o_custkey") % 50
    name = F.when(key == 7, "in.valid").when(key != 8, F.concat(F.lit("m"), key))
    orders = _read(spark, sf_dir, "orders")
    versions = orders.select(
        name.alias("name"),
        F.col("o_orderkey").cast("string").alias("version"),
        (F.col("o_orderpriority") != "5-LOW").alias("has_signature"),
        F.concat(F.lit("s3://runs/"), "o_orderkey").alias("source"),
        F.concat(F.lit("r"), "o_custkey").alias("run_id"),
        F.col("o_orderpriority").alias("description"),
    )
    models = orders.select(F.explode(F.array(name, F.concat(F.lit("bare"), key))).alias("name")).distinct()
    models = models.select("name", F.concat(F.lit("about "), "name").alias("description"))
    whole = plans.upgrade_plan(versions, "main", "migrated_models", models=models)
    alone = plans.upgrade_plan(versions, "main", "migrated_models", models=models, upgrade_versions=False)
    return reduce(
        DataFrame.unionAll,
        (
            plan.withColumnRenamed("name", "model").select(
                F.lit(run).alias("run"), "model", "version", "dest_name", "status", "dest_version",
                "source", "run_id", "description", "model_description",
            )
            for run, plan in (("versions", whole), ("models", alone))
        ),
    )


def upgrade_plan_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run: ten versions of every model are there, and models with an even number
    get a signature for what lacks one."""
    versions = stored(_versions(spark, sf_dir))
    number = F.col("version").cast("int")
    dest_name = F.concat(F.lit("main.migrated_models."), "name").alias("dest_name")
    moved = versions.where(number <= 10).select(dest_name, F.col("version").alias("source_version"))
    existing = moved.groupBy("dest_name").agg(F.lit(10).alias("latest_version"))
    even = F.substring("name", 2, 10).cast("int") % 2 == 0
    plan = plans.upgrade_plan(
        versions,
        "main",
        "migrated_models",
        existing=existing,
        signatures=versions.where(even & ~F.col("has_signature")),
        migrated=moved,
    )
    return _planned(plan)


def registry_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty versions of every model are moved, then all that have a signature; aliases
    follow; a further plan finds them all."""
    path = scratch_dir(spark)
    versions = stored(_versions(spark, sf_dir).where("has_signature"))
    for part in (versions.where("CAST(version AS INT) <= 20"), versions):
        state = plans.read_registry(spark, path)
        plan = plans.upgrade_plan(part, "main", "models", existing=state.existing(), migrated=state.migrated())
        state = plans.apply_plan(spark, plan, path, plans.stage_alias(part))
    again = plans.upgrade_plan(versions, "main", "models", existing=state.existing(), migrated=state.migrated())
    again = again.select("dest_name", F.col("version").alias("source_version"), F.col("status").alias("again"))
    aliases = state.aliases.withColumnRenamed("name", "dest_name")
    return (
        state.versions.select("dest_name", "version", "source_version")
        .join(aliases, ["dest_name", "version"], "left")
        .join(again, ["dest_name", "source_version"], "full")
    )


def preview_top_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_n(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "inventory_profile": inventory_profile,
    "inventory_csv": inventory_csv,
    "table_inventory": table_inventory,
    "column_inventory": column_inventory,
    "database_inventory": database_inventory,
    "describe_databases": describe_databases,
    "catalog_cleanup": catalog_cleanup,
    "name_contains_any": contains_any,
    "name_glob": glob,
    "cleanup_candidates": cleanup_candidates,
    "owned_by": owned_by,
    "owned_by_me": owned_by_me,
    "owned_not_marked": owned_not_marked,
    "classify_copy": classify_copy,
    "describe_tables": describe_tables,
    "path_roundtrip": path_roundtrip,
    "table_overwrite": table_overwrite,
    "sync_reconcile": sync_reconcile,
    "sync_options": sync_options,
    "sync_resume": sync_resume,
    "reconcile_differences": reconcile_differences,
    "plan_catalogs": plan_catalogs,
    "slice_inclusive": time_split,
    "read_series": read_series,
    "forecast_window": forecast_window,
    "forecast_window_fallback": forecast_window_fallback,
    "forecast_vs_actual": forecast_vs_actual,
    "validation_mse": validation_mse,
    "score_rows": score_rows,
    "compare_versions": compare_versions,
    "champion_challenger": champion_challenger,
    "network_challenger": network_challenger,
    "score_segments": score_segments,
    "forest_score": forest_score,
    "forest_exact": forest_exact,
    "label_split": label_split,
    "holdout": holdout,
    "holdout_tail": holdout_tail,
    "conform": conform,
    "latest_version": latest_version,
    "stage_alias": stage_alias,
    "upgrade_plan": upgrade_plan,
    "upgrade_plan_again": upgrade_plan_again,
    "upgrade_carried": upgrade_carried,
    "registry_applied": registry_applied,
    "preview_top_name": preview_top_name,
}
