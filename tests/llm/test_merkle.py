import random
from collections import Counter

import pytest

from catalift.llm import merkle
from tests.llm.plain import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, pos int, g int, total int"


def _rows(rng, n):
    langs = [None, "en", "en", "en", "é", "de", ""]
    return [
        (rng.choice([i, i, i, None, 5]), rng.choice([None, "", f"ä{i}", "t" * 5000]), rng.choice(langs), rng.choice(["a", None]), rng.choice([None, i]))
        for i in range(n)
    ]


@pytest.mark.parametrize(("n", "fanout", "step"), [(0, 2, 8), (1, 2, 8), (257, 2, 3), (90, 3, 2)])
def test_manifest_equals_a_plain_tree(spark, n, fanout, step):
    rows = _rows(random.Random(n), n)
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(docs, fanout=fanout, step=step).collect()
    assert Counter(map(tuple, got)) == Counter(manifest(rows, fanout))
    assert n < 90 or {r.verified for r in got} == {True, False}
    untouched = merkle.manifest(docs, tamper=False, fanout=fanout, step=step).collect()
    assert all(r.verified and r.folded_root == r.root for r in untouched)


def test_only_checkpoint_levels_are_kept(spark):
    nodes = spark.range(1000).selectExpr("0L AS g", "id AS pos", "1000L AS total", "sha2(string(id), 256) AS node")
    assert [level.count() for level in merkle.checkpoints(nodes, 2, 4)] == [1000, 63, 4, 1]
    assert [level.count() for level in merkle.checkpoints(nodes, 10, 1)] == [1000, 100, 10, 1]


def test_a_path_folds_to_the_root(spark):
    nodes = spark.range(300).selectExpr("0L AS g", "id AS pos", "300L AS total", "sha2(string(id), 256) AS node")
    levels = merkle.checkpoints(nodes, 2, 3)
    root = levels[-1].where("total = 1").first()["node"]
    tops = spark.createDataFrame([(0, 300, "", root, root)], "g long, total long, path string, subroot string, root string")
    rows = merkle.proofs(levels, tops, step=3).collect()
    assert len(rows) == 300 and {merkle._fold(r.node, merkle._path(r.path)) for r in rows} == {root}
    other = merkle.digest("another leaf")
    assert all(merkle._fold(other, merkle._path(r.path)) != root for r in rows)


def test_rows_of_a_hot_group_are_placed_without_gaps(spark):
    rows = [("a" if i % 3 else None, i % 7 or None) for i in range(2000)] + [("b", 1)] * 500
    frame = spark.createDataFrame(rows, "lang string, doc_id long").repartition(5)
    got = merkle.placed(frame, ["lang"], ["doc_id"]).collect()
    for lang in ("a", "b", None):
        own = sorted((r for r in got if r.lang == lang), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own))) and {r.total for r in own} == {len(own)}
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in own]
        assert ids == sorted(ids)
