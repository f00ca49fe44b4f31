import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from catalift.llm import repair
from tests.llm.plain import repaired_conversations

SCHEMA = "conv_id long, turn long, role string, text string, key string, own int"


def _rows(rng, n, convs):
    text = lambda: rng.choice(["Hello.", "Yes!", "cut off", "", None, " \n", "ok.", "Why?", "ä 漢.", "x" * rng.randint(1, 9) + "."])
    role = lambda: rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, ""])
    return [(rng.choice(convs), rng.choice([i, i, i, i, None]), role(), text()) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)


def _check(spark, rows, parts=3):
    got = repair.repair_report(_frame(spark, rows).repartition(parts))
    want = repaired_conversations(rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(want)


@pytest.mark.parametrize("limits", [(1024, 1 << 20), (3, 1 << 20), (1024, 12)])
def test_report_equals_a_plain_version(spark, monkeypatch, limits):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", limits[0])
    monkeypatch.setattr(repair, "SEGMENT_BYTES", limits[1])
    rng = random.Random(5)
    # turns are distinct in a conversation: the order of rows of one turn is the operator's own
    rows = [(c, t if t else None, r, x) for c in (*range(40), None) for t, (_, _, r, x) in enumerate(_rows(rng, rng.randint(0, 9), [c]))]
    rows += [(99, t, r, x) for t, (_, _, r, x) in enumerate(_rows(rng, 300, [99]), 5)]
    _check(spark, rows)


def test_no_rows_and_no_rows_left(spark):
    _check(spark, [])
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    _check(spark, [(dropped, 0, "user", "Hi.")])


def test_long_texts_and_many_equal_rows(spark):
    rows = [(1, 4, "user", "long " * 200_000 + "."), (1, 5, "assistant", "Ok.")] + [(2, None, "user", "same.")] * 3000
    got = {r.conv_id: r for r in repair.repair_report(_frame(spark, rows).repartition(4)).collect()}
    want = {r[0]: r for r in repaired_conversations(rows)}
    assert {c: tuple(r) for c, r in got.items()} == want
    assert got[2].duplicate == 2999


def _least(rows):
    """The least (cost, audit) from every place on, by recursion over what follows."""

    @cache
    def best(i, state, inserts):
        ways = [(0, "")] if i == len(rows) and state in repair.ENDS else []
        if inserts < 3:
            c, a = best(i, repair.NEXT[state], inserts + 1)
            ways.append((c + 5, "I" + a))
        if i < len(rows):
            initial, must_go, cut = rows[i]
            c, a = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a))
            if not must_go:
                if (initial, state) in repair.KEEP:
                    c, a = best(i + 1, repair.KEEP[initial, state], 0)
                    ways.append((c + 5 * cut, "K" + a))
                c, a = best(i + 1, repair.NEXT[state], 0)
                ways.append((c + 1 + 5 * cut, "R" + a))
        return min(ways, default=(10**9, ""))

    return best(0, repair.NOTHING, 0)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7])
def test_cheapest_least_audit_also_with_colliding_hashes(modulus):
    rng = random.Random(modulus)
    for n in (*range(8), 20, 60) * 12:
        rows = [(rng.choice("suuaaat"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
        ways = repair.cheapest(rows, audits=lambda: repair.Audits(3, modulus))
        assert min(ways[k] for k in ways if k[1] in repair.ENDS) == _least(tuple(rows))


def test_segments_joined_equal_the_whole():
    rng = random.Random(8)
    for _ in range(150):
        rows = [(rng.choice("suuaaat"), rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.randint(1, 25))]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(4))})
        segments = []
        for low, high in zip(cuts, cuts[1:]):
            found = repair.cheapest(rows[low:high], range(4))
            segments.append({"ways": [{"start": s, "end": e, "cost": c, "audit": a} for (s, e), (c, a) in found.items()]})
        cost, pieces = repair.joined(segments)
        assert (cost, "".join(a for _, a in pieces)) == _least(tuple(rows))


def test_common_beginnings():
    rng = random.Random(2)
    for modulus in ((1 << 61) - 1, 3):
        tree, texts = repair.Audits(5, modulus), {0: ""}
        for _ in range(400):
            node = rng.choice(list(texts)[-20:])
            letter = rng.choice("DI")
            texts[tree.add(node, letter)] = texts[node] + letter
        for _ in range(3000):
            a, b = rng.choices(list(texts), k=2)
            sign = tree.compare(a, b)
            assert (sign > 0) - (sign < 0) == (texts[a] > texts[b]) - (texts[a] < texts[b])
            assert tree.text(a) == texts[a]


def test_planted_faults_are_counted(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}.") for c in range(300) for t in range(6)]
    kinds = Counter(zlib.crc32(f"{c}:{t}".encode()) % 20 for c in range(300) for t in range(6))
    got = repair.repair_report(_frame(spark, rows)).collect()
    assert (sum(r.blank for r in got), sum(r.truncated for r in got), sum(r.duplicate for r in got)) == (kinds[1], kinds[2], kinds[3])
    untouched = [r for r in got if all(zlib.crc32(f"{r.conv_id}:{t}".encode()) % 20 > 4 for t in range(6))]
    assert untouched and all(r.audit == "KKKKKK" and r.cost == 0 for r in untouched)
    for r in untouched:
        text = "\n".join(f"{'assistant' if t % 2 else 'user'}:Text {r.conv_id} {t}." for t in range(6))
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert defaultdict(int, kinds)[0] and len(got) == 300
