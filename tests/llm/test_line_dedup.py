import hashlib

from pyspark.sql import functions as F

from catalift.llm import line_dedup

SCHEMA = "doc_id long, text string, key string, drop int, no string"


def _chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) for s in lines]
    long = [len(s.split()) >= 50 for s in lines]
    out, now = [], []
    for i, s in enumerate(lines):
        now.append(s)
        rolled = ((h[i - 1] if i else 0) * 31 + h[i]) % 3 == 0
        if i == len(lines) - 1 or long[i] or long[i + 1] or rolled:
            out.append((now, long[i]))
            now = []
    return out


def _plain(docs):
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        if text is None:
            out.append((doc_id, None, 0, 0, 0))
            continue
        kept, lost = [], []
        for lines, long in _chunks(text):
            key = "\n".join(lines)
            if (len(lines) > 1 or long) and key in seen:
                lost.append(lines)
            else:
                kept.append(key)
            if len(lines) > 1 or long:
                seen.add(key)
        out.append((doc_id, "\n".join(kept), text.count("\n") + 1, sum(map(len, lost)), len(lost)))
    return out


def _run(spark, docs):
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA).repartition(3)
    return sorted(map(tuple, line_dedup.dedup_lines(df).collect()), key=str)


def _docs():
    shared = [f"shared line {i} with the same words" for i in range(20)]
    long = "one long passage of words " * 12
    docs = []
    for i in range(30):
        own = [f"own line {i} {j}" for j in range(i % 7)]
        part = shared[: 20 if i % 2 else 12]
        docs.append((i, "\n".join(own + part + [f"end {i}"] + [long.strip()] * (i % 3) + own)))
    return docs + [(30, None), (31, ""), (32, "\n"), (33, "\n\n\n"), (34, "one line"), (35, "one line"), (36, "\n".join(f"l{i}" for i in range(5000)))]


def test_removed_chunks_equal_a_plain_pass(spark):
    docs = _docs()
    got = _run(spark, docs)
    assert got == sorted(_plain(docs), key=str)
    assert sum(r[3] for r in got) > 300


def test_chunks_of_one_hash_are_told_apart_by_bytes(spark, monkeypatch):
    """With one hash for all chunks only equal bytes go."""
    docs = _docs()
    real = F.xxhash64
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: real(*c) if len(c) == 2 else F.lit(1).cast("long"))
    assert _run(spark, docs) == sorted(_plain(docs), key=str)


def test_null_ids_and_repeated_rows(spark):
    text = "\n".join(f"line {i} of a text" for i in range(40))
    got = _run(spark, [(None, text), (5, text), (5, text)])
    kept = [r for r in got if r[3] == 0]
    assert len(got) == 3 and [r[0] for r in kept] == [None]
    assert got[0][1:] == got[1][1:] or got[1][1:] == got[2][1:]


def test_empty(spark):
    assert _run(spark, []) == []
