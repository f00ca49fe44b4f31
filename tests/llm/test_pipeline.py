"""Each stage of the pipeline on its own input, against plain versions."""

import random
from collections import Counter

import duckdb

import corpus_pipeline
from catalift.llm.common import store
from catalift.llm.oracle import OP10
from tests.llm.plain import matches, simhash_components
from tests.llm.test_sharding import _check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    texts = []
    for i in range(120):
        w = [word() for _ in range(rng.randint(1, 300))]
        if i % 10 == 0:
            w[1:1] = rng.choice(items)[1].split()
        texts.append(" ".join(w))
        if i % 4 == 0:
            texts += [texts[-1]] * rng.randint(1, 3)
        if i % 6 == 0:
            w[len(w) // 2] = "changed"
            texts.append(" ".join(w))
    texts += [None, "", "12 34 !!", "x " * 50_000]
    docs = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_each_stage_against_a_plain_version(spark, tmp_path):
    docs, items = _tables(spark, str(tmp_path))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]

    def run(name, frame):
        out = store(stages[name](spark, frame, str(tmp_path)))
        assert name == "sharding" or out.columns == frame.columns
        return out

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    frame, rows = run("language_id", frame), [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    assert sorted(map(tuple, frame.collect())) == sorted(rows, key=lambda d: d[0])
    assert len(rows) == len(docs) - 3

    frame = run("near_dedup", frame)
    group = simhash_components([d[1] for d in rows])
    rows = [d for i, d in enumerate(rows) if group[i] == i]
    assert Counter(map(tuple, frame.collect())) == Counter(rows) and len(rows) < len(group)

    frame = run("decontamination", frame)
    bad = {d for d, _ in matches([d[:2] for d in rows], items)}
    rows = [d for d in rows if d[0] not in bad]
    assert Counter(map(tuple, frame.collect())) == Counter(rows) and bad

    mixed = run("mixing", frame)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = {d: taken // size for d, size, _, _, taken in con.execute(OP10).fetchall()}
    got = Counter(map(tuple, mixed.collect()))
    assert got == Counter({d: want[d[0]] for d in rows if want[d[0]]})
    assert {1, 2} <= set(got.values())

    rows = [d[:2] for d in got.elements()]
    _check(run("sharding", mixed).collect(), rows, 9)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.size) for r in final) == sorted((d, len(t.encode()) + 1) for d, t in rows)
