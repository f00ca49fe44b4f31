from collections import Counter, defaultdict

import duckdb
import pytest

from catalift.llm import mixing
from catalift.llm.oracle import OP10

SCHEMA = "doc_id long, text string, source string, draw string, size int, row string"


def _frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA)


def _docs():
    sources = ["a", "b", "ä", "Z", None]
    docs = [(i, "w " * (i * 7 % 50 + 1), sources[i % 5] if i % 3 else "a") for i in range(2000)]
    return docs + [(5000, None, "a"), (5001, "", "b"), (None, "x y", None), (3, docs[3][1], docs[3][2]), (6000, "long " * 20_000, "a"), (6001, "", "empty")]


def test_taken_words_meet_the_targets(spark):
    docs = _docs()
    rows = mixing.mix_plan(_frame(spark, docs).repartition(3)).collect()
    assert len(rows) == len(docs)
    source = {(d, len((t or "").split())): s for d, t, s in docs}
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        s = source[r.doc_id, r.size]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        size[s] += r.size
        target[s] = (r.source_size, r.target)
    order = sorted((s for s in size if s is not None)) + [None]
    want = mixing.targets([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2)
    for s, t in zip(order, want):
        assert target[s] == (size[s], pytest.approx(t))
        assert abs(taken[s] - t) <= 25
    again = mixing.mix_plan(_frame(spark, docs[::-1]).repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_repeats_whole_rows(spark):
    docs = [d for d in _docs() if d[0] is not None]
    df = _frame(spark, docs)
    plan = defaultdict(int)
    for r in mixing.mix_plan(df).collect():
        plan[r.doc_id] += r.copies
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({k: v for k, v in plan.items() if v})


def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45, 2) == [20, pytest.approx(25 / 3), pytest.approx(50 / 3)]
    assert mixing.targets([0, 10], [3, 1], 15, 2) == [0, 15]
    assert mixing.targets([], [], 0, 2) == []


def test_empty_and_without_words(spark):
    assert mixing.mix_plan(_frame(spark, [])).count() == 0
    assert mixing.mix(_frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_plan(_frame(spark, [(1, None, None)])).collect()] == [0]


def _off(spark, docs, **how):
    """Words over the target of each source, by its size, and the rows."""
    rows = mixing.mix_plan(_frame(spark, docs).repartition(4), **how).collect()
    taken = Counter()
    for r in rows:
        assert r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source_size, r.target] += r.taken
    return {size: n - target for (size, target), n in taken.items()}, rows


def test_repeated_rows_have_draws_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_BITS", 4)
    docs = [(i, "w " * 100, "a") for i in range(500)] + [(None, "v " * 100, "a")] * 500 + [(9, "u " * 100, "b")] * 700
    off, rows = _off(spark, docs, share=1.3)
    assert max(map(abs, off.values())) <= 50
    copies = Counter(r.copies for r in rows if r.doc_id is None)
    assert len(copies) == 2 and min(copies.values()) > 100


def test_documents_larger_than_others(spark):
    """One document holds a third of its source; sizes over five powers of ten. No document left
    out would bring its source nearer to the target."""
    docs = [(i, "w " * 20, "a") for i in range(400)] + [(1000, "w " * 4000, "a")]
    docs += [(2000 + i, "w " * (10 ** (i % 5) // 2 + 1), "b") for i in range(300)]
    for share in (0.3, 0.5, 0.9, 1.2):
        off, rows = _off(spark, docs, share=share)
        assert abs(off[12_000]) <= 20 and abs(off[333_600]) <= 333.6
        for r in rows:
            left_out = r.copies < r.target / r.source_size
            assert not left_out or abs(off[r.source_size] + r.size) >= abs(off[r.source_size]) - 1e-6


def test_inclusion_is_met_by_the_draws(spark):
    """Over many seeds a document is taken as often as its inclusion says; a large one less often."""
    docs = [(i, "w " * (300 if i < 20 else 10), "a") for i in range(420)]
    hits, inclusion, words = Counter(), {}, 0
    for seed in range(6):
        for r in mixing.mix_plan(_frame(spark, docs), share=0.4, seed=seed).collect():
            inclusion[r.size] = r.inclusion
            hits[r.size] += r.copies
            words += r.taken
    assert inclusion[300] < inclusion[10] < 1
    assert 20 * 300 * inclusion[300] + 400 * 10 * inclusion[10] == pytest.approx(4000)
    assert words == pytest.approx(6 * 4000, rel=0.01)
    assert hits[10] / (6 * 400) == pytest.approx(inclusion[10], abs=0.05)
    assert hits[300] / (6 * 20) == pytest.approx(inclusion[300], abs=0.1)


def test_rows_equal_the_sql(spark, tmp_path):
    docs = _docs() + [(7, "x y z " * 9, "b")] * 40 + [(None, None, None)] * 3
    _frame(spark, docs).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({OP10})").fetchall())
    got = mixing.mix_plan(spark.read.parquet(f"{tmp_path}/documents.parquet")).drop("inclusion", "copies").collect()
    assert Counter(map(tuple, got)) == want
