"""Katz scores against a plain count of the same model."""

import math
import re
import zlib
from collections import Counter

import pytest

from catalift.llm import katz

SCHEMA = "doc_id long, text string, score string, chunk string"


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


class Plain:
    def __init__(self, docs):
        self.uni, self.bi, self.hist = Counter(), Counter(), Counter()
        for doc_id, text in docs:
            if not self.held(doc_id):
                words = ["", *_words(text), ""]
                for h, w in zip(words, words[1:]):
                    self.uni[w] += 1
                    self.bi[h, w] += 1
                    self.hist[h] += 1
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        ones = Counter(self.uni.values())
        self.du = katz.discounts([ones[i] for i in range(1, 7)])
        ones = Counter(self.bi.values())
        self.db = katz.discounts([ones[i] for i in range(1, 7)])
        self.free = sum((1 - self.du[c - 1]) * c for c in self.uni.values() if c <= 5)
        self.after = {}
        for (h, w), r in self.bi.items():
            self.after.setdefault(h, {})[w] = r

    @staticmethod
    def held(doc_id):
        return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 10 == 0

    def p1(self, w):
        c = self.uni[w]
        total = self.n + (0 if self.free > 0 else 1)
        if not c:
            return (self.free if self.free > 0 else 1) / total
        return (self.du[c - 1] if c <= 5 else 1) * c / total

    def p2(self, h, w):
        count = self.hist[h]
        if not count:
            return self.p1(w)
        seen = self.after[h]
        d = {x: (self.db[r - 1] if r <= 5 else 1) for x, r in seen.items()}
        if all(r > 5 for r in seen.values()):
            count += 1
        if w in seen:
            return d[w] * seen[w] / count
        left = 1 - sum(d[x] * r / count for x, r in seen.items())
        return left / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)


def _corpus(n=160):
    import random

    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["The", "çà", "ÉA"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = []
    for i in range(n):
        words = rng.choices(vocab, weights, k=rng.randint(0, 80)) + [f"once{i}"] * (i % 3 == 0)
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    docs += [(n, None), (n + 1, ""), (None, "the w1"), (3, docs[3][1]), (n + 2, "w1 " * 5000)]
    return docs


@pytest.mark.parametrize("chunk", [katz.CHUNK_BYTES, 900])
def test_scores_equal_a_plain_model(spark, monkeypatch, chunk):
    monkeypatch.setattr(katz, "CHUNK_BYTES", chunk)
    docs = _corpus()
    plain = Plain(docs)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA).repartition(3)
    rows = katz.katz_scores(df).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        words = ["", *_words(texts[r.doc_id]), ""]
        assert r.held_out == plain.held(r.doc_id) and r.train_tokens == plain.n
        assert r.n_tokens == len(words) - 1
        assert r.n_known == sum(plain.uni[w] > 0 for w in words[1:])
        base = sum(math.log10((plain.uni[w] + 0.1) / (plain.n + 0.1 * (plain.v + 1))) for w in words[1:])
        full = sum(math.log10(plain.p2(h, w)) for h, w in zip(words, words[1:]))
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(full, rel=1e-9)
    assert any(r.held_out and r.n_known < r.n_tokens for r in rows)


def test_probabilities_sum_to_one():
    plain = Plain(_corpus())
    unknown = "never seen"
    for h in [*list(plain.hist)[:20], unknown]:
        assert sum(plain.p2(h, w) for w in [*plain.uni, unknown]) == pytest.approx(1, abs=1e-9)


def test_discounts_fall_back_where_counts_are_odd():
    assert katz.discounts([100, 40, 22, 14, 9, 6]) == pytest.approx(katz.discounts([1000, 400, 220, 140, 90, 60]))
    for ones in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 9, 9, 9, 9]):
        d = katz.discounts(ones)
        assert all(0 < x < 1 for x in d) and d == sorted(d)


def test_empty_table(spark):
    assert katz.katz_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if Plain.held(i))
    row = katz.katz_scores(spark.createDataFrame([(held, "a b", "", "")], SCHEMA)).first()
    assert row.train_tokens == 0 and row.n_tokens == 3 and row.n_known == 0 and row.score == 0 and row.base_score == 0
