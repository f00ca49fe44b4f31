import random

import pytest

from catalift.llm import simhash
from tests.llm.plain import component_of, fingerprint, simhash_components

SCHEMA = "doc_id long, text string, fp string, component string, node int"


def _frame(spark, docs):
    return spark.createDataFrame([(d, t, "a", "b", 1) for d, t in docs], SCHEMA)


def _docs():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(1, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            near = list(base)
            for _ in range(rng.randint(0, 2)):
                near[rng.randrange(len(near))] = word()
            texts.append(rng.choice([" ", "\n", "  "]).join(near).capitalize())
    return list(enumerate(texts + [None, "", " \n", "A b", "a B", "w " * 90_000]))


def test_groups_equal_all_pairs(spark):
    docs = _docs()
    rows = {r.doc_id: r for r in simhash.simhash_report(_frame(spark, docs).repartition(3)).collect()}
    want = simhash_components([t for _, t in docs])
    for (d, text), component in zip(docs, want):
        assert rows[d].fingerprint == f"{fingerprint(text):016x}"
        assert rows[d].component_id == component
    assert len(set(want)) < len(docs)


@pytest.mark.parametrize("tree", [20_000, 7])
def test_shards_lose_no_link(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    rng = random.Random(2)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 30])):
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    place = {x: i for i, x in enumerate(signed)}
    got = component_of(len(fps), [(place[r.a], place[r.b]) for r in links])
    want = component_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert got == want and len(set(want)) < len(fps)


def test_tree_follows_edges_within_the_radius():
    rng = random.Random(3)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for v in values[:40]:
        assert sorted(tree.near(v, 2)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 2]
    assert list(simhash.BKTree().near(1, 2)) == []


def test_one_row_of_each_group_stays_whole(spark):
    docs = [(3, "a b c d e"), (2, "A b c d e"), (2, "A b c d e"), (None, "a b c d e"), (9, "else where"), (None, "lost one"), (7, None), (8, "")]
    kept = simhash.keep_one(_frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "fp", "component", "node"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(2, "A b c d e"), (9, "else where"), (None, "lost one"), (7, None)], key=str)


def test_kept_rows_equal_all_pairs(spark):
    docs = _docs()
    want = simhash_components([t for _, t in docs])
    kept = simhash.keep_one(_frame(spark, docs).repartition(3)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_groups_without_ids_keep_one_row_each(spark):
    base = [f"w{i}" for i in range(100)]
    docs = [(None, " ".join(base)), (None, "  ".join(base).upper()), (None, "else where")]
    assert simhash.keep_one(_frame(spark, docs)).count() == 2


def test_empty(spark):
    assert simhash.simhash_report(_frame(spark, [])).count() == 0
    assert simhash.keep_one(_frame(spark, [])).count() == 0
