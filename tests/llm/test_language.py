import os

import pytest
from pyspark.sql import functions as F

from catalift.llm import language
from tests.llm.plain import language as plain_language
from tests.llm.plain import language_profiles
from tests.test_acceptance import SF_DIR

SCHEMA = "doc_id long, text string, lang string, row string, score int"


def _frame(spark, docs):
    return spark.createDataFrame([(*d, "a", 1) for d in docs], SCHEMA)


def _held(spark, docs):
    df = spark.createDataFrame([(d[0],) for d in docs], "doc_id long")
    return [r[0] for r in df.select(language.held_out_of(F.col("doc_id"))).collect()]


def test_predictions_equal_plain_profiles(spark, monkeypatch):
    monkeypatch.setattr(language, "PIECE", 200)
    docs = [
        (i, " ".join(["Haus und Hof, die Tür"] * (1 + i % 3)) + f" nummer{i}" if i % 2 else "the house of the yard; a DOOR " * (1 + i % 4) + f"x{i}", "de" if i % 2 else "en")
        for i in range(40)
    ] + [(40, None, "de"), (41, "", "en"), (42, "123 !!", "fr"), (43, "Tür", None), (None, "yard", "en"), (44, "İstanbul ß ﬃ", "tr")] * 2
    got = language.language_report(_frame(spark, docs).repartition(3)).collect()
    held = _held(spark, docs)
    profiles = language_profiles([(t, lang) for (_, t, lang), h in zip(docs, held) if t and lang and not h])
    profiles.pop("fr", None)  # no letter, no gram
    want = sorted((str(d), h, *plain_language(t, profiles)) for (d, t, _), h in zip(docs, held))
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in got)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = language.language_report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    rows = rows.where("lang is not null").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
    n, right = rows.agg(F.count("*"), F.sum("ok")).first()
    assert n > 150 and right / n > 0.97


def test_nothing_learned_and_empty(spark):
    assert [tuple(r) for r in language.language_report(_frame(spark, [(1, "abc", None)])).collect()] == [(1, False, "und", 0.0)]
    assert language.language_report(_frame(spark, [])).count() == 0


def test_documents_with_letters_stay_whole(spark):
    docs = [(1, "the house", "en"), (2, "123", "en"), (3, None, None), (1, "the house", "en")]
    kept = language.keep_known(_frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "lang", "row", "score"]
    assert sorted(map(tuple, kept.collect())) == [(1, "the house", "en", "a", 1)] * 2


def test_documents_with_letters_stay_if_nothing_was_learned(spark):
    docs = [(1, "the house", None), (2, "123 !!", None), (3, None, None), (4, "über", None)]
    kept = language.keep_known(_frame(spark, docs)).collect()
    assert sorted(map(tuple, kept)) == [(1, "the house", None, "a", 1), (4, "über", None, "a", 1)]


def test_texts_in_no_learned_language_go(spark):
    clean = [(i, f"the house number {i} stands in the old town and the garden is green", "en") for i in range(60)]
    clean += [(100 + i, f"das haus nummer {i} steht in der alten stadt und der garten ist grün", "de") for i in range(60)]
    clean += [(200, "the garden", None), (201, "das haus", None), (202, "12 the 34", "en")]
    foreign = [(300, "これは日本語の文章です。今日は天気がいいですね。", None), (301, "Это русский текст о погоде", None), (302, "ふ" * 200_000, None)]
    kept = language.keep_known(_frame(spark, clean + foreign * 2 + [(303, "77", "en"), (304, "", None)]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _ in clean)
    assert language.keep_known(_frame(spark, [])).count() == 0
