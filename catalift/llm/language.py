"""Language ID by rank-order profiles of n-grams and out-of-place distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: n-grams of 1 to ORDERS letters; a word boundary counts as a letter.
ORDERS = 3
#: Ranks of a profile, of languages and documents alike.
RANKS = 300
#: Languages are a label set, held by the driver: more of them are an error.
MAX_LANGUAGES = 1000
#: A text is in no learned language below this part of the score that all but so many of the
#: rows with a lang reach: 0.52 on check_s, where the least of all is 0.36.
FLOOR, OUTLIERS = 0.25, 0.01
#: Characters worked on at a time; a longer document is a piece of its own.
PIECE = 1 << 16

_BITS = 21  # of a code point
_UNSEEN, _BREAK = 0xFFFFFFFF, 1  # no letter is 1, and no gram begins with 0: lengths differ


class Letters:
    """Code points to lower-case letters; all else is a word boundary. Filled as met."""

    def __init__(self):
        import numpy as np

        self.table = np.full(0x110000, _UNSEEN, dtype=np.uint32)

    def of(self, text: str):
        import numpy as np

        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        found = self.table[points]
        unseen = np.flatnonzero(found == _UNSEEN)
        if len(unseen):
            for p in np.unique(points[unseen]).tolist():
                low = chr(p).lower()
                self.table[p] = ord(low[0]) if chr(p).isalpha() else _BREAK
            found = self.table[points]
        return found


def grams(letters):
    """n-grams of a run of letters with boundaries: (code, place of the last letter).

    A gram holds no boundary inside; one at either end marks the start or end of a word, and
    the boundary alone is no gram.
    """
    import numpy as np

    codes, places = [], []
    x = letters.astype(np.uint64)
    letter = x != _BREAK
    for n in range(1, ORDERS + 1):
        if len(x) < n:
            break
        code = x[: len(x) - n + 1].copy()
        for k in range(1, n):
            code = (code << np.uint64(_BITS)) | x[k : len(x) - n + 1 + k]
        if n < 3:
            ok = letter[: len(x) - n + 1] | letter[n - 1 :]
        else:
            ok = letter[1 : len(x) - n + 2].copy()
            for k in range(2, n - 1):
                ok &= letter[k : len(x) - n + 1 + k]
        at = np.flatnonzero(ok)
        codes.append(code[at])
        places.append(at)
    return np.concatenate(codes or [x]), np.concatenate(places or [np.zeros(0, dtype=np.int64)])


def _pieces(texts: list[str | None]):
    """Lists of row numbers with about ``PIECE`` characters together."""
    rows, size = [], 0
    for i, text in enumerate(texts):
        if text:
            rows.append(i)
            size += len(text)
            if size >= PIECE:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _joined(texts, rows, letters):
    """Letters of several texts with a boundary around each, and where each begins."""
    import numpy as np

    both = letters.of("\n" + "\n".join(texts[i] for i in rows) + "\n")
    starts = np.cumsum([0] + [len(texts[i]) + 1 for i in rows[:-1]])
    return both, starts


def train(docs: DataFrame, held_out: Column, ranks: int = RANKS) -> DataFrame:
    """Profiles (lang, gram, place): the ``ranks`` most frequent n-grams of each language over
    all whole texts that have a lang and are not held out; ties go by gram."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        letters, kept = Letters(), {}

        def out():
            langs, codes, counts = [], [], []
            for lang, parts in kept.items():
                code, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                langs += [lang] * len(code)
                codes.append(code.view(np.int64))
                counts.append(np.bincount(back, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64))
            kept.clear()
            columns = [pa.array(langs, pa.string())] + [pa.array(np.concatenate(c or [np.zeros(0, np.int64)])) for c in (codes, counts)]
            return pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, other in zip(texts, langs) if other == lang]
                for rows in _pieces(own):
                    code, _ = grams(_joined(own, rows, letters)[0])
                    kept.setdefault(lang, []).append(np.unique(code, return_counts=True))
            # one sum for a task unless it holds much
            if sum(len(p[0]) for parts in kept.values() for p in parts) > 4_000_000:
                yield out()
        yield out()

    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out)
    counts = known.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place).where(F.col("place") <= ranks).select("lang", "gram", "place")


def predict(docs: DataFrame, profiles: DataFrame, ranks: int = RANKS) -> DataFrame:
    """``docs`` with lang_pred and score for each row's whole text.

    The ``ranks`` most frequent n-grams of the text (ties by gram) are compared to each profile:
    a gram costs the difference of its two places, or ``ranks`` if the profile lacks it; the
    nearest language wins, ties go by name. score is 1 minus the mean cost over ``ranks``. A
    text that is null or has no letter, or any text when no language was learned, is ``und``
    with score 0.
    """
    import numpy as np

    names = [r.lang for r in profiles.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names.sort()
    rows = profiles.collect()  # ranks for each language
    own = {name: sorted((r.gram, r.place) for r in rows if r.lang == name) for name in names}
    # of each language: grams in order and their places
    learned = [(np.array([g for g, _ in own[n]], np.int64), np.array([p for _, p in own[n]], np.int64)) for n in names]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((names, learned))  # at most MAX_LANGUAGES * ranks grams

    def judge(texts: list[str | None], letters):
        names, learned = shared.value
        best, score = ["und"] * len(texts), [0.0] * len(texts)
        for rows in _pieces(texts) if names else ():
            both, starts = _joined(texts, rows, letters)
            code, place = grams(both)
            doc = np.searchsorted(starts, place, side="right") - 1
            order = np.lexsort((code, doc))
            doc, code = doc[order], code[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])) if len(doc) else np.zeros(0, int)
            n = np.diff(np.concatenate([first, [len(doc)]]))
            doc, code = doc[first], code[first].view(np.int64)
            order = np.lexsort((code, -n, doc))
            doc, code = doc[order], code[order]
            begin = np.searchsorted(doc, np.arange(len(rows)))
            at = np.arange(len(doc)) - begin[doc] + 1
            keep = at <= ranks
            doc, code, at = doc[keep], code[keep], at[keep]
            size = np.bincount(doc, minlength=len(rows))
            cost = np.empty((len(learned), len(rows)))
            for k, (known, places) in enumerate(learned):
                i = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
                hit = known[i] == code if len(known) else np.zeros(len(code), bool)
                one = np.where(hit, np.abs(places[i] - at), ranks) if len(known) else np.full(len(code), ranks)
                cost[k] = np.bincount(doc, one, len(rows))
            winner = cost.argmin(axis=0)
            for j, i in enumerate(rows):
                if size[j]:
                    best[i] = names[winner[j]]
                    score[i] = float(1 - cost[winner[j], j] / (size[j] * ranks))
        return best, score

    def label(batches):
        import pyarrow as pa

        letters = Letters()
        for batch in batches:
            best, score = judge(batch.column("row").field(text_at).to_pylist(), letters)
            columns = [batch.column("row"), pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score"])

    text_at = docs.columns.index("text")
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    schema = f"row {inner.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    return inner.mapInArrow(label, schema)


def held_out_of(doc_id: Column) -> Column:
    """True for documents whose crc32 of the doc_id as text leaves 2 modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learned from the rows not held out.
    Repeated rows are judged alike; an empty table gives no rows; other columns are ignored."""
    profiles = store(train(docs, held_out_of(F.col("doc_id"))))
    judged = predict(docs.select("doc_id", "text"), profiles)
    return judged.select("row.doc_id", held_out_of(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def least_score(judged: DataFrame) -> float:
    """The score below which a text is in no learned language: ``FLOOR`` of what all but
    ``OUTLIERS`` of the rows with a lang reach, by counts of all of them in steps of a thousandth."""
    step = F.floor(F.col("score") * 1000).cast("int").alias("step")
    rows = judged.where("row.lang is not null and lang_pred <> 'und'").groupBy(step).count().collect()  # at most 1,001
    left = OUTLIERS * sum(r["count"] for r in rows)
    for r in sorted(rows):
        left -= r["count"]
        if left < 0:
            return FLOOR * r.step / 1000
    return 0.0


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a language is found for, unchanged. Rejected: ``und``, that is
    null texts and texts without a letter, and texts whose score is below `least_score`: they
    share next to no n-gram with any language learned from ``docs``. If no language was learned,
    texts with a letter stay. Repeated rows stay or go together, long texts are judged whole, an
    empty table gives no rows, other columns are kept."""
    profiles = store(train(docs, F.lit(False)))
    if profiles.isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = store(predict(docs, profiles))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score(judged))).select("row.*")
