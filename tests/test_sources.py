import uuid
from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from catalift import plans, sources
from catalift.operators import inventory_profile

TEMPS = StructType(
    [
        StructField(name, kind, nullable=False)
        for name, kind in [
            ("AirportCode", StringType()),
            ("Date", DateType()),
            ("TempHighF", IntegerType()),
            ("TempLowF", IntegerType()),
        ]
    ]
)


@pytest.fixture(scope="module")
def temps(spark):
    """Three airports on three days."""
    data = [
        (code, date(2021, 4, day), 50 + place + day, 40 + place - day)
        for place, code in enumerate(["AAA", "BBB", "CCC"])
        for day in (1, 2, 3)
    ]
    return spark.createDataFrame(data, TEMPS)


@pytest.fixture
def database(spark, tmp_path):
    name = f"db_{uuid.uuid4().hex}"
    sources.create_database(spark, name, str(tmp_path / "db"))
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_literal_rows_keep_their_schema(temps):
    assert temps.schema == TEMPS
    assert temps.count() == 9


def test_create_database_again_is_a_no_op(spark, database, tmp_path):
    sources.create_database(spark, database)
    located = {r.info_name: r.info_value for r in sources.describe_databases(spark, [database]).collect()}
    assert located["Location"].endswith(str(tmp_path / "db"))


def test_write_path_fails_on_an_existing_path(spark, temps, rows, tmp_path):
    path = str(tmp_path / "t")
    sources.write_path(temps, path)
    with pytest.raises(AnalysisException):
        sources.write_path(temps, path)
    sources.write_path(temps, path, mode="overwrite")
    assert rows(sources.read_path(spark, path)) == rows(temps)
    assert rows(sources.read_path(spark, path, schema=TEMPS)) == rows(temps)


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_register_external_is_idempotent_and_leaves_files(spark, temps, rows, database, tmp_path, fmt):
    path, name = str(tmp_path / fmt), f"{database}.ext"
    sources.write_path(temps, path, fmt)
    sources.register_external(spark, name, path, fmt)
    sources.register_external(spark, name, path, fmt)
    assert rows(spark.table(name)) == rows(temps)
    spark.sql(f"DROP TABLE {name}")
    assert sources.read_path(spark, path, fmt).count() == 9


def tables_in(spark, database):
    return [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]


def test_register_external_finds_partitions(spark, temps, rows, database, tmp_path):
    path, name = str(tmp_path / "parts"), f"{database}.parts"
    sources.write_path(temps, path, partition_by=["AirportCode"])
    sources.register_external(spark, name, path)
    assert rows(spark.table(name).select(temps.columns)) == rows(temps)
    assert tables_in(spark, database) == ["parts"]


def test_register_external_loses_a_race(spark, temps, rows, database, tmp_path, monkeypatch):
    """Another registration finishes between the check and the rename."""
    path, name = str(tmp_path / "t"), f"{database}.raced"
    sources.write_path(temps, path)
    sources.register_external(spark, name, path)
    answers = iter([False])
    exists = type(spark.catalog).tableExists
    monkeypatch.setattr(
        type(spark.catalog), "tableExists", lambda *a: next(answers, None) is not False and exists(*a)
    )
    sources.register_external(spark, name, path)
    assert tables_in(spark, database) == ["raced"]
    assert spark.table(name).count() == 9


def test_path_with_a_quote(spark, temps, database, tmp_path):
    path = str(tmp_path / "it's")
    sources.write_path(temps, path)
    sources.register_external(spark, f"{database}.quoted", path)
    assert spark.table(f"{database}.quoted").count() == 9


def test_save_table_overwrites(spark, temps, rows, database):
    sources.save_table(temps.limit(2), f"{database}.temps")
    sources.save_table(temps, f"{database}.temps")
    assert rows(spark.table(f"{database}.temps")) == rows(temps)


def test_read_series(spark, tmp_path):
    (tmp_path / "s.csv").write_text("day,wind_speed,power\n2014-01-01,1.5,10\n2014-01-02,,20\n")
    df = sources.read_series(spark, str(tmp_path / "s.csv"), "day DATE, wind_speed DOUBLE, power DOUBLE")
    assert [tuple(r) for r in df.orderBy("day").collect()] == [
        (date(2014, 1, 1), 1.5, 10.0),
        (date(2014, 1, 2), None, 20.0),
    ]


@pytest.fixture
def populated(spark, temps, database, tmp_path):
    sources.save_table(temps, f"{database}.managed")
    sources.write_path(temps, str(tmp_path / "files"), partition_by=["AirportCode"])
    sources.register_external(spark, f"{database}.ext", str(tmp_path / "files"))
    spark.sql(f"CREATE TABLE {database}.odd (Location STRING, `a b` INT) USING csv")
    spark.sql(f"CREATE VIEW {database}.seen AS SELECT * FROM {database}.managed")
    temps.createOrReplaceTempView("temporary")
    yield database
    spark.catalog.dropTempView("temporary")


def test_table_inventory(spark, populated, tmp_path):
    inventory = sources.table_inventory(spark, populated)
    assert inventory.columns == ["catalog", *sources.INVENTORY_SCHEMA.names]
    assert [f.dataType for f in inventory.schema][1:] == [f.dataType for f in sources.INVENTORY_SCHEMA]
    found = {r.table: r for r in inventory.collect()}
    assert {t: (r.type, r.format) for t, r in found.items()} == {
        "managed": ("MANAGED", "parquet"),
        "ext": ("EXTERNAL", "parquet"),
        "odd": ("MANAGED", "csv"),
        "seen": ("VIEW", "Unknown"),
    }
    assert found["ext"].table_location.endswith(str(tmp_path / "files"))
    assert found["seen"].table_location is None
    assert {r.db for r in found.values()} == {populated}
    assert {r.catalog for r in found.values()} == {"spark_catalog"}
    assert all(r.created_version == spark.version for r in found.values())
    assert all(r.created_time > 1_600_000_000_000 and r.last_access == -1 for r in found.values())


def test_inventory_of_named_catalogs(spark, populated):
    assert "spark_catalog" in sources.list_catalogs(spark)
    listed = sources.table_inventory(spark, populated, catalogs=["spark_catalog"])
    assert listed.count() == 4
    found = sources.database_inventory(spark, populated.upper()[:-3] + "*", ["spark_catalog"])
    assert [tuple(r) for r in found.collect()] == [("spark_catalog", populated)]


def test_a_table_that_cannot_be_described_is_unknown(spark, populated, monkeypatch):
    from catalift.sources import metadata

    places = [("spark_catalog", populated, "managed"), ("spark_catalog", populated, "gone")]
    monkeypatch.setattr(metadata, "_tables", lambda *_: iter(places))
    found = {r.table: r for r in metadata.table_inventory(spark).collect()}
    assert found["managed"].type == "MANAGED"
    assert tuple(found["gone"])[3:] == ("Unknown", "Unknown") + (None,) * 7
    columns = [tuple(r)[2:] for r in metadata.column_inventory(spark).where("position = 0").collect()]
    assert columns == [("gone", 0, None, "Unknown", None, None)]


def test_inventory_of_nothing(spark):
    assert sources.table_inventory(spark, "no_such_database").count() == 0
    assert sources.column_inventory(spark, "no_such_database").count() == 0


def test_inventory_is_made_of_bounded_relations(spark, populated, rows, monkeypatch):
    from catalift.functions import frames

    whole = rows(sources.column_inventory(spark, populated))
    monkeypatch.setattr(frames, "ROWS_IN_PLAN", 3)
    assert rows(sources.column_inventory(spark, populated)) == whole


def test_column_inventory(spark, populated):
    columns = sources.column_inventory(spark, populated)
    found = {(r.table, r.position): (r.column, r.data_type, r.is_partition) for r in columns.collect()}
    assert found["odd", 1] == ("Location", "string", False)
    assert found["odd", 2] == ("a b", "int", False)
    assert found["ext", 4] == ("AirportCode", "string", True)
    assert found["seen", 2] == ("Date", "date", False)
    assert len(found) == 4 + 4 + 2 + 4


def test_describe_tables(spark, populated):
    names = [f"{populated}.odd", f"{populated}.seen"]
    told = sources.describe_tables(spark, names)
    assert told.columns == ["table_id", "seq", "col_name", "data_type"]
    of_odd = [tuple(r)[1:] for r in told.where(told.table_id == names[0]).orderBy("seq").collect()]
    assert of_odd[0] == (0, "Location", "string")
    assert ("Type", "MANAGED") in [r[1:] for r in of_odd]
    assert [r[0] for r in of_odd] == list(range(len(of_odd)))
    gone = sources.describe_tables(spark, [*names, f"{populated}.gone"]).where("seq = -1").collect()
    assert [(r.table_id, r.col_name) for r in gone] == [(f"{populated}.gone", "# Error")]
    found = plans.classify_copy(sources.describe_tables(spark, [f"{populated}.gone"])).collect()
    assert [tuple(r) for r in found] == [(f"{populated}.gone", None, False, False, False)]


def test_describe_databases_goes_on(spark, populated):
    told = sources.describe_databases(spark, [populated, "no_such_database"]).collect()
    assert {r.db for r in told} == {populated, "no_such_database"}
    assert [r.info_name for r in told if r.db == "no_such_database"] == ["# Error"]


def test_catalogues_as_rows(spark):
    assert "spark_catalog" in [r.catalog for r in sources.catalog_inventory(spark).collect()]


def test_series_are_read_strictly(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.csv").write_text("n,day\n1,2020-01-01\n")
    with pytest.raises(Exception, match="(?i)header"):
        sources.read_series(spark, str(tmp_path / "s"), "day DATE, n INT").collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_series(spark, str(tmp_path / "s"), "n INT, day INT").collect()


@pytest.mark.parametrize("infer", [False, True])
def test_failed_tables_hide_no_columns(spark, tmp_path, infer):
    """However many files hold failed tables only."""
    broken = [("d", f"x{i}") + ("Unknown",) * 2 + (None,) * 7 for i in range(200)]
    good = ("d", "z", "csv", "EXTERNAL", "file:/a", "3.5", 1700000000000, -1, "serde", "in", "out")
    df = spark.createDataFrame([*broken, good], sources.INVENTORY_SCHEMA).repartition(20)
    sources.write_inventory(df, str(tmp_path / "csv"))
    back = sources.read_inventory(spark, str(tmp_path / "csv"), infer=infer)
    assert back.columns == sources.INVENTORY_SCHEMA.names and back.count() == 201
    assert tuple(back.where("`table` = 'z'").first()) == good
    types = dict(back.dtypes)
    assert (types["created_time"], types["last_access"]) == ("bigint", "int" if infer else "bigint")


@pytest.fixture
def inventory(spark):
    known = ("d", "t,1", "HIVE", "MANAGED", "file:/a,b", "3.5", 1700000000000, -1, "serde", "in", "out")
    bare = ("d", "v", None, "VIEW", None, "3.5", 1700000000000, -1, None, None, None)
    broken = ("d", "x") + ("Unknown",) * 2 + (None,) * 7
    return spark.createDataFrame([known, bare, broken], sources.INVENTORY_SCHEMA)


def test_inventory_csv_is_short_for_failed_tables(spark, inventory, tmp_path):
    path = tmp_path / "csv"
    sources.write_inventory(inventory, str(path))
    lines = [line for f in path.glob("part-*") for line in f.read_text().splitlines()]
    header = ",".join(sources.INVENTORY_SCHEMA.names)
    assert header in lines
    assert "d,x,Unknown,Unknown,NONE" in lines
    assert "d,v,Unknown,VIEW,None,3.5,1700000000000,-1,Unknown,Unknown,Unknown" in lines
    assert 'd,"t,1",HIVE,MANAGED,"file:/a,b",3.5,1700000000000,-1,serde,in,out' in lines


def test_inventory_csv_roundtrip(spark, inventory, rows, tmp_path):
    sources.write_inventory(inventory, str(tmp_path / "csv"))
    read = sources.read_inventory(spark, str(tmp_path / "csv"))
    assert read.schema == sources.INVENTORY_SCHEMA
    found = {r.table: tuple(r)[2:] for r in read.collect()}
    assert found["x"] == ("Unknown", "Unknown", "NONE") + (None,) * 6
    assert found["v"][2] == "None" and found["v"][-1] == "Unknown"
    cleared = sources.read_inventory(spark, str(tmp_path / "csv"), nulls=True)
    assert rows(cleared) == rows(inventory.fillna("Unknown", ["format"]))
    assert rows(inventory_profile(cleared)) == rows(inventory_profile(read))


def test_read_inventory_pads_short_lines(spark, tmp_path):
    header = "db,table,format,type,table_location,created_version,created_time,last_access,lib,inputformat,outputformat"
    (tmp_path / "i.csv").write_text(
        f"{header}\na,t,parquet,MANAGED,file:/t,3.5,1700000000000,-1,s,i,o\na,u,Unknown,Unknown,NONE\n"
    )
    for infer in (False, True):
        found = {r.table: tuple(r) for r in sources.read_inventory(spark, str(tmp_path), infer).collect()}
        assert found["u"] == ("a", "u", "Unknown", "Unknown", "NONE") + (None,) * 6
        assert found["t"][6:8] == (1700000000000, -1)
