import random
from collections import Counter

import pytest

from catalift.llm import debruijn
from tests.llm.plain import without_repeats

SCHEMA = "doc_id long, text string, part string, seed int, key int, n int, lo int, doc int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def _rows(rng, words, n):
    """Texts of passages that others have too, whole, in part, shifted or edited."""
    word = lambda: rng.choice(words)
    passages = [[word() for _ in range(rng.randint(3, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 4)):
            own += [word() for _ in range(rng.randint(0, 25))]
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            own += p[a : rng.randint(a, len(p))] if rng.random() < 0.5 else p
        if rows and rng.random() < 0.3:
            own = (rng.choice(rows)[1] or "").split()
            if own and rng.random() < 0.5:
                own[rng.randrange(len(own))] = "changed"
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(own)))
    return rows


@pytest.mark.parametrize(("edge", "seed", "words"), [(10, 3, 2000), (10, 10, 500), (5, 2, 3), (50, 16, 5000)])
def test_equals_all_windows(spark, edge, seed, words):
    rng = random.Random(edge * seed)
    rows = _rows(rng, [f"w{i}" for i in range(words)], 150)
    rows += [(900, None), (901, ""), (902, " \n "), (None, rows[3][1]), (None, rows[3][1])]
    rows += [(903, "spam " * 300), (904, "spam " * 80), (905, "spam " * 1000), (903, "spam " * 300), (903, "Spam " + "spam " * 200)]
    got = debruijn.dedup_substrings(_frame(spark, rows).repartition(4), edge, seed)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = without_repeats(rows, edge)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert any(0 < removed < n for _, n, removed, _ in want)


def test_empty_table_and_long_text(spark):
    assert debruijn.dedup_substrings(_frame(spark, [])).collect() == []
    rng = random.Random(1)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(200_000))
    rows = [(2, "before " + long), (1, long), (3, "x " * 30)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in debruijn.dedup_substrings(_frame(spark, rows)).collect()}
    assert got == {1: (200_000, 0), 2: (200_001, 200_000), 3: (30, 0)}


def test_a_shared_passage_is_one_path_to_its_source(spark):
    rng = random.Random(3)
    word = lambda n: [str(rng.randrange(10**9)) for _ in range(n)]
    passage = word(400)
    rows = [(i, " ".join(word(60) + passage + word(60))) for i in range(5, 65)]
    paths = debruijn.repeated(_frame(spark, rows)).collect()
    assert sorted((p.doc, p.lo, p.n, p.src, p.src_lo) for p in paths) == [(i, 60, 351, 5, 60) for i in range(6, 65)]


def test_paths_that_do_not_verify_are_left(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda: " ".join(str(rng.randrange(10**9)) for _ in range(120))
    same = text()
    frame = _frame(spark, [(1, same), (2, same), (3, text())])
    paths = spark.createDataFrame(
        [(r.doc, r.part, r.lo, r.n, r.src, r.src_part, r.src_lo) for r in debruijn.repeated(frame).collect()]
        + [(3, r.part, 0, 20, 1, q.part, 5) for r in debruijn._documents(frame).where("doc = 3").collect() for q in debruijn._documents(frame).where("doc = 1").collect()],
        "doc long, part long, lo int, n int, src long, src_part long, src_lo int",
    )
    monkeypatch.setattr(debruijn, "repeated", lambda *_: paths)
    got = {r.doc_id: r.n_removed for r in debruijn.dedup_substrings(frame).collect()}
    assert got == {1: 0, 2: 120, 3: 0}


def test_many_spans_of_one_source(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "SPANS", 3)
    rng = random.Random(6)
    base = [str(rng.randrange(10**9)) for _ in range(300)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base[i : i + 100])) for i in range(1, 40)]
    got = debruijn.dedup_substrings(_frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(without_repeats(rows, 50))
