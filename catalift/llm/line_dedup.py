"""Line dedup by content-defined chunks of lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, store

#: A boundary falls after one line in so many, by the rolling hash.
DIVISOR = 3
#: A line of so many words is a chunk of its own, as it is a passage of its own.
LONG_WORDS = 50


def _chunks(text: Column) -> Column:
    """Chunks of a text as structs (lines, long, text).

    A line ends a chunk if the rolling hash of its own and the preceding line's hash is
    divisible by ``DIVISOR``, or if it or the next line is long: boundaries depend on the
    lines around them only, so they return wherever the same lines return.
    """
    number = lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")
    # a word and the space after it have two characters at least
    is_long = lambda s: (F.char_length(s) >= 2 * LONG_WORDS - 1) & (n_words(s) >= LONG_WORDS)
    lines = F.split(text, "\n", -1)
    marks = F.transform(lines, lambda s: F.struct(number(s).alias("h"), is_long(s).alias("long")))

    def ends(pair):
        lines, marks = pair["lines"], pair["marks"]
        n = F.size(lines)

        def end(i):
            here, next_, last = (F.element_at(marks, F.greatest(F.lit(1), F.least(n, i + d))) for d in (0, 1, -1))
            rolled = (F.when(i > 1, last["h"]).otherwise(F.lit(0)) * 31 + here["h"]) % DIVISOR == 0
            return (i == n) | here["long"] | next_["long"] | rolled

        return F.filter(F.sequence(F.lit(1), n), end)

    def cut(triple):
        lines, marks, stops = triple["lines"], triple["marks"], triple["stops"]

        def chunk(stop, k):
            start = F.when(k == 0, 1).otherwise(F.element_at(stops, F.greatest(k, F.lit(1))) + 1)
            return F.struct(
                (stop - start + 1).alias("lines"),
                F.element_at(marks, stop)["long"].alias("long"),
                F.concat_ws("\n", F.slice(lines, start, stop - start + 1)).alias("text"),
            )

        return F.transform(stops, chunk)

    # one-row arrays bind what is used often, so that it is computed once
    pair = F.array(F.struct(lines.alias("lines"), marks.alias("marks")))
    triple = F.transform(pair, lambda p: F.struct(p["lines"].alias("lines"), p["marks"].alias("marks"), ends(p).alias("stops")))
    return F.transform(triple, cut)[0]


def _eligible(chunk: Column) -> Column:
    return (chunk["lines"] > 1) | chunk["long"]


def _flags(places: Column) -> Column:
    """Of sorted places from 0 on: an array that is true at each and false between them, so
    that a look at one takes the same time however many there are."""

    def run(place, k):
        last = F.when(k == 0, -1).otherwise(F.element_at(places, F.greatest(k, F.lit(1))))
        return F.concat(F.array_repeat(F.lit(False), place - last - 1), F.array(F.lit(True)))

    return F.flatten(F.transform(places, run))


def _split(chunks: Column, places: Column) -> Column:
    """``chunks`` as a struct of those at the places (``at``) and the others (``rest``)."""
    set_ = lambda p, i: F.coalesce(F.get(p["flags"], i), F.lit(False))
    part = lambda p: F.struct(
        F.filter(p["chunks"], lambda c, i: set_(p, i)).alias("at"), F.filter(p["chunks"], lambda c, i: ~set_(p, i)).alias("rest")
    )
    # a one-row array binds both, so that each is computed once
    return F.transform(F.array(F.struct(chunks.alias("chunks"), _flags(places).alias("flags"))), part)[0]


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Remove chunks of lines that occur before: doc_id, text, n_lines, removed_lines, removed_chunks.

    Chunks of at least two lines, or of one line of ``LONG_WORDS`` words, count. Of equal
    chunks the first by (doc_id, a hash of the text, place) stays. Hashes of chunks find
    those that may repeat; their bytes are compared before anything goes, and chunks of one
    hash but other bytes are told apart by their bytes. Three passes over the texts, which
    travel twice, joined by document; both joins are by sort and merge at every size, as what
    they join grows with the texts. Hot chunks are combined before each shuffle.

    A null text stays null and has no lines; an empty text is one empty line and stays.
    Null doc_ids sort as 0; repeated rows are one document: they keep and lose the same
    chunks. Other columns are ignored; an empty table gives no rows.
    """
    keys = [
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("k_doc"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("k_text"),
    ]
    on = ["k_doc", "k_text"]
    texts = docs.select("doc_id", "text", *keys)
    full = texts.where(F.col("text").isNotNull())
    cut = full.select(*on, F.posexplode(F.transform(_chunks(F.col("text")), lambda c: F.struct(
        _eligible(c).alias("ok"), F.xxhash64(c["text"]).alias("key")))).alias("no", "c"))
    seen = store(cut.where("c.ok").select(*on, "no", F.col("c.key").alias("key")))
    twice = seen.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = store(seen.join(twice, "key").groupBy(*on).agg(F.sort_array(F.collect_set("no")).alias("nos")))

    # bytes of the chunks whose hash repeats
    part = F.transform(_chunks(F.col("text")), lambda c, i: F.struct(i.alias("no"), c["text"].alias("bytes")))
    part = _split(part, F.col("nos"))["at"]
    part = full.join(wanted.hint("merge"), on).select(*on, F.explode(part).alias("c")).select(*on, "c.no", "c.bytes")
    part = store(part.withColumn("key", F.xxhash64("bytes")))
    place = F.min(F.struct("k_doc", "k_text", "no")).alias("first")
    ends = part.groupBy("key").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"), place)
    ends = store(ends.select("key", (F.col("lo") == F.col("hi")).alias("same"), "first"))
    other = F.struct("k_doc", "k_text", "no") != F.col("first")
    gone = part.drop("bytes").join(ends.where("same").select("key", "first"), "key").where(other).select(*on, "no")
    clash = part.join(ends.where("not same").select("key"), "key")
    own = clash.groupBy("key", "bytes").agg(place)
    gone = gone.union(clash.join(own, ["key", "bytes"]).where(other).select(*on, "no"))
    drop = store(gone.groupBy(*on).agg(F.sort_array(F.collect_set("no")).alias("drop")))

    # the texts again, without what goes
    marked = texts.join(drop.hint("merge"), on, "left")
    parts = F.when(F.col("drop").isNotNull(), _split(_chunks(F.col("text")), F.col("drop")))
    rows = marked.select("doc_id", "text", "drop", parts.alias("parts"))
    kept, lost = F.col("parts.rest"), F.col("parts.at")
    lines = lambda cs: F.aggregate(cs, F.lit(0).cast("long"), lambda a, c: a + c["lines"])
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return rows.select(
        "doc_id",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda c: c["text"]), "\n")).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(lines(lost)).cast("long").alias("removed_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("removed_chunks"),
    )
