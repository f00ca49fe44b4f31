import zlib
from collections import defaultdict

import pytest

from catalift.llm.sharding import pack, shard_plan

SCHEMA = "doc_id long, text string, shard string, size string, n string, piece int"


def _check(rows, docs, spread):
    assert len(rows) == len(docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    want = sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    for of in (lambda r: r.size, lambda r: 1):
        sums = [sum(map(of, by[s])) for s in range(8)]
        assert max(sums) - min(sums) <= spread * sum(sums) / 8
    return by


def _frame(spark, docs):
    return spark.createDataFrame([(d, t, "a", "b", "c", 1) for d, t in docs], SCHEMA)


def test_balanced_whole_and_rerun(spark):
    docs = [(i, " ".join(["wort"] * (1 + i * 37 % 90)) + str(i // 2)) for i in range(3000)]
    rows = shard_plan(_frame(spark, docs)).collect()
    _check(rows, docs, 0.02)
    where = defaultdict(set)
    texts = dict(docs)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    again = shard_plan(_frame(spark, docs).repartition(5)).collect()
    assert sorted(rows) == sorted(again)


def test_a_hot_group_is_cut(spark):
    docs = [(i, "the same text" if i % 3 == 0 else f"text number {i}") for i in range(6000)]
    rows = shard_plan(_frame(spark, docs)).collect()
    _check(rows, docs, 0.1)


@pytest.mark.parametrize("doc_id", [7, None])
def test_repeated_rows_of_one_id_are_cut(spark, doc_id):
    docs = [(doc_id, "the same row " * 8)] * 3000 + [(i, f"text number {i}") for i in range(1000)]
    rows = shard_plan(_frame(spark, docs).repartition(6)).collect()
    _check(rows, docs, 0.01)


def test_nulls_repeats_and_long_texts(spark):
    docs = [(None, None), (1, None), (2, ""), (3, "x " * 200_000), (4, "é"), (4, "é"), (None, "z")] * 2
    rows = shard_plan(_frame(spark, docs)).collect()
    _check(rows, docs, 9)


def test_empty(spark):
    assert shard_plan(_frame(spark, [])).count() == 0


def test_pack_puts_each_where_the_dot_product_is_highest():
    import numpy as np

    demands = np.array([[0.5, 0.1], [0.1, 0.5], [0.2, 0.2]])
    left = np.full((2, 2), 0.5)
    assert pack(demands, left).tolist() == [0, 1, 0]
    assert np.allclose(left, [[-0.2, 0.2], [0.4, 0.0]])
