"""Every query against its SQL on the same files, run by another engine."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from catalift.acceptance.oracle import ORACLE
from catalift.acceptance.queries import QUERIES, TABLES

SF_DIR = os.environ.get("ACCEPTANCE_SF_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "FLOAT": "float",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF_DIR)
    result = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert dict(df.dtypes) == types
    assert len(expected) > 0
    assert _bag(df.columns, df.collect()) == _bag(columns, expected)


def test_every_query_is_checked_or_known():
    assert set(QUERIES) - set(ORACLE) == {"forest_score"}
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["type", "format", "count", "complexity"]
    assert df.count() == 24
