"""Every query with SQL against another engine, and the pipeline against its plain stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from catalift.acceptance.queries import TABLES
from catalift.llm.oracle import ORACLE
from catalift.llm.queries import QUERIES
from tests.test_acceptance import SF_DIR, TYPES, _bag

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert dict(df.dtypes) == {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    expected = result.fetchall()
    assert len(expected) > 0
    assert _bag(df.columns, df.collect()) == _bag(columns, expected)


def test_one_query_for_each_operator():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES if name != "pipeline"]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in QUERIES
    assert set(QUERIES) - set(ORACLE) == {
        "op3_vector_packing",
        "op5_rank_profiles",
        "op7_simhash_bktree",
        "op8_katz_backoff",
        "pipeline",
    }
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
