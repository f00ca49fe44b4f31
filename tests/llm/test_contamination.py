import random
from collections import Counter

import numpy as np
import pytest

from catalift.llm import contamination
from tests.llm.plain import matches, shingles

DOCS = "doc_id long, text string, row string, item_id long, _doc int"
ITEMS = "item_id long, text string, doc_id string"


def _data():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé", k=4))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "only three words"), (103, items[0][1]), (None, items[1][1])]
    items += [(104, "Two words"), (104, "Two words"), (105, "solitary")]
    docs = []
    for i in range(150):
        w = [word() for _ in range(rng.choice([0, 3, 200, 3000]))]
        if i % 3 == 0 and w:
            part = rng.choice(items[:40])[1].split()
            part = part[: max(5, int(len(part) * rng.choice([0.5, 0.85, 0.95, 1])))]
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "XX"
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(w).upper().replace("É", "é") if i % 2 else " ".join(w)))
    docs += [(200, None), (201, "Only THREE words"), (202, "only three words more"), (None, items[2][1]), (3, docs[3][1]), (203, items[3][1] + " x" * 100_000)]
    docs += [(204, "x " * 50 + "two WORDS y"), (205, "words two"), (206, "a solitary\tword"), (207, "solitary")]
    return docs, items


@pytest.mark.parametrize("pass_bytes", [contamination.PASS_BYTES, 2000])
def test_matches_equal_all_pairs(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(contamination, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(contamination, "PIECE", 5000)
    docs, items = _data()
    df = spark.createDataFrame([(*d, "x", 9, 1) for d in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(*i, "y") for i in items], ITEMS)
    rows = contamination.contaminated(df, bench).collect()
    want = matches(docs, items)
    assert Counter((r.doc_id, r.item_id) for r in rows) == want and len(want) > 30
    assert want[204, 104] == 2 and want[206, 105] == want[207, 105] == want[202, 102] == 1 and not want[205, 104]
    assert all(r.containment == r.shared / r.shingles >= 0.8 for r in rows)
    bad = {d for d, _ in want}
    kept = contamination.decontaminate(df, bench)
    assert kept.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert left == Counter(d for d in docs if d[0] not in bad)


def test_no_benchmark_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "", 1, 1)], DOCS)
    none = spark.createDataFrame([], ITEMS)
    assert contamination.contaminated(docs, none).count() == 0
    assert contamination.decontaminate(docs, none).count() == 1
    item = spark.createDataFrame([(1, "a b c d e", "")], ITEMS)
    assert contamination.contaminated(docs.limit(0), item).count() == 0


def test_shingle_hashes_stand_for_shingles():
    texts = ["A  b\tc d e f", "", " \n", "a b c d e", "x", "a b\nc d e f ", "é ü a b c d"]
    h, text = contamination.Shingler().hashes([t.encode() for t in texts])
    for i, t in enumerate(texts):
        own = h[text == i]
        assert len(set(own.tolist())) == len(shingles(t))
    assert set(h[text == 0].tolist()) == set(h[text == 5].tolist())
    assert set(h[text == 3].tolist()) < set(h[text == 0].tolist())


def test_sketches_cannot_miss():
    rng = random.Random(6)
    for n in (1, 4, 5, 6, 23, 64, 200):
        own = {f"s{rng.random()}".encode() for _ in range(n)}
        hashes, owner = contamination.sketches([(7, own)])
        missing = n - -(-4 * n // 5)
        assert len(hashes) == missing + 1 and np.all(owner == 0)
