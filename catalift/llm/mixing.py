"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, store, whole

#: The targets of sources are configuration, held by the driver: more sources are an error.
MAX_SOURCES = 100_000
#: Steps of the ranks by which the boundary of a source is found.
STEPS = 4096
#: Documents of over one part in so many of a source's remainder have smaller odds.
PARTS = 128
#: Times that what is open is filled in the order of ranks: the sample, then what a document too large left open.
FILLS = 3
#: Rows of one task that are numbered together are at most 2 to this power.
RUN_BITS = 20

_SOURCE = ["no_source", "name"]
_SAME = ["doc_id", *_SOURCE, "tie"]  # of repeated rows
_KEY = ["rank", "draw", "tie", "number", "doc_id"]  # the order of the documents of a source


def targets(sizes: list[int], weights: list[float], budget: float, ceiling: float) -> list[float]:
    """Share ``budget`` by weight; none gets over ``ceiling`` times its size, the excess is
    shared again by weight among the others until none is above."""
    caps = [ceiling * s for s in sizes]
    free = set(range(len(sizes)))
    while free:
        unit = (budget - sum(caps[i] for i in range(len(sizes)) if i not in free)) / sum(weights[i] for i in sorted(free))
        over = {i for i in free if weights[i] * unit > caps[i]}
        if not over:
            return [weights[i] * unit if i in free else caps[i] for i in range(len(sizes))]
        free -= over
    return caps


def _bits(digest: Column) -> Column:
    """The first 52 bits of a digest in hexadecimal."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.monotonically_increasing_id().alias("_id"))


def _draws(rows: DataFrame, seed: int) -> DataFrame:
    """Size and random number of each row. The number depends on nothing but the seed, doc_id,
    text and the row's place among its repeats: reruns agree, and each repeat has its own."""
    own = rows.select(
        "_id",
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").isNull().alias("no_source"),
        F.coalesce("row.source", F.lit("")).alias("name"),
        n_words(F.col("row.text")).alias("size"),
        _bits(F.md5(whole(F.col("row.text")).cast("binary"))).alias("tie"),
    )
    own = store(own.withColumn("run", F.shiftright("_id", RUN_BITS)))
    # repeats are numbered run by run, then moved up by those of earlier runs: no task gets a hot row whole
    runs = own.groupBy(*_SAME, "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*_SAME).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    moved = runs.withColumn("moved", F.sum("n").over(earlier)).where("moved > 0")
    moved = moved.select(*[F.col(c).alias(f"_{c}") for c in (*_SAME, "run")], "moved")
    place = F.row_number().over(Window.partitionBy(*_SAME, "run").orderBy("_id")) - 1
    same = F.lit(True)
    for c in (*_SAME, "run"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = own.withColumn("place", place).join(moved, same, "left")
    own = own.withColumn("number", F.col("place") + F.coalesce("moved", F.lit(0)))
    key = [F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "tie", "number"]
    draw = _bits(F.md5(F.concat_ws("|", *key).cast("binary")))
    return store(own.select("_id", "doc_id", *_SOURCE, "size", "tie", "number", draw.alias("draw")))


def _plan(draws: DataFrame, share: float, weights: tuple, ceiling: float) -> DataFrame:
    """Per source: size, target, whole copies, words that remain (rest), and the size above
    which documents have smaller odds (limit; limited: all sizes, cut to it). It is the least
    of R / PARTS, 2 R / PARTS, ..., R for a remainder R that R can be met with."""
    spark = draws.sparkSession
    totals = draws.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    rows = totals.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.no_source, r.name))
    sizes = [int(r.source_size) for r in rows]
    given = [weights[i % len(weights)] for i in range(len(rows))]
    goal = targets(sizes, given, share * sum(sizes), ceiling)
    plan = []
    for r, size, target in zip(rows, sizes, goal):
        copies = int(min(ceiling, target / size)) if size else 0
        plan.append((r.no_source, r.name, size, float(target), copies, target - copies * float(size)))
    schema = "no_source boolean, name string, source_size long, target double, copies int, rest double"
    plan = F.broadcast(spark.createDataFrame(plan, schema))
    limits = [F.ceil(F.col("rest") * (2.0**j / PARTS)) for j in range(PARTS.bit_length())]
    sums = draws.join(plan, _SOURCE).where("rest > 0").groupBy(*_SOURCE, "rest")
    sums = sums.agg(*[F.sum(F.least("size", limit)).alias(f"sum{j}") for j, limit in enumerate(limits)])
    fit = F.coalesce(*[
        F.when(F.col(f"sum{j}") >= F.col("rest"), F.struct(limit.alias("limit"), F.col(f"sum{j}").alias("limited")))
        for j, limit in enumerate(limits)
    ])
    fits = sums.select(*_SOURCE, fit.alias("fit")).select(*_SOURCE, "fit.*")
    return F.broadcast(store(plan.join(F.broadcast(fits), _SOURCE, "left")))


def _ranked(draws: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with inclusion and rank: random odds divided by inclusion odds, 0 for what is
    certain; both null where nothing remains. Stored, as every fill reads them."""
    chance = F.col("rest") / F.col("limited")
    smaller = chance * (F.col("limit") / F.col("size"))
    inclusion = F.when(F.col("size") > F.col("limit"), smaller).otherwise(chance)
    draw = F.col("draw") + 0.5
    odds = draw / (F.lit(float(1 << 52)) - draw)
    rank = odds / (F.col("inclusion") / (1 - F.col("inclusion")))
    rows = draws.join(plan, _SOURCE).withColumn("inclusion", inclusion)
    rows = rows.withColumn("rank", F.when(F.col("inclusion") < 1, rank).when(F.col("inclusion") >= 1, 0.0))
    return store(rows.drop("limit", "limited"))


def _open(i: int) -> Column:
    """Rows that fill i may take: not larger than the gap, after all that was taken."""
    return (F.col("size") <= F.col(f"gap{i}")) & (F.col(f"last{i}").isNull() | (F.struct(*_KEY) > F.col(f"last{i}")))


def _fill(rows: DataFrame, i: int) -> DataFrame:
    """Per source the last row (end) that fill i takes, and the words it takes: rows in order
    until the gap would be overrun. A histogram of the ranks finds the step in which that
    happens, and only the rows of this step are ordered."""
    gap = F.col(f"gap{i}")
    step = F.floor(F.col("rank") / (F.col("rank") + 1) * STEPS)
    rows = rows.where(_open(i)).select(*_SOURCE, f"gap{i}", "size", *_KEY, step.alias("step"))
    hist = rows.groupBy(*_SOURCE, f"gap{i}", "step").agg(F.sum("size").alias("words"), F.max(F.struct(*_KEY)).alias("top"))
    hist = hist.withColumn("upto", F.sum("words").over(Window.partitionBy(*_SOURCE).orderBy("step")))
    edge = hist.groupBy(*_SOURCE).agg(
        F.min(F.when(F.col("upto") > gap, F.col("step"))).alias("edge"),
        F.max(F.when(F.col("upto") <= gap, F.col("top"))).alias("top"),
        F.coalesce(F.max(F.when(F.col("upto") <= gap, F.col("upto"))), F.lit(0)).alias("before"),
    )
    edge = F.broadcast(store(edge))  # a row for each source
    order = Window.partitionBy(*_SOURCE).orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.join(edge, _SOURCE).where("step = edge").withColumn("upto", F.col("before") + F.sum("size").over(order))
    near = near.where(F.col("upto") <= gap).groupBy(*_SOURCE).agg(F.max(F.struct(*_KEY)).alias("end"), F.max("upto").alias("upto"))
    return edge.join(F.broadcast(near), _SOURCE, "left").select(
        *_SOURCE, F.coalesce("end", "top").alias(f"end{i}"), F.coalesce("upto", "before").alias("words")
    )


def _nearest() -> Column:
    """How far a row is from the words that the fills leave open, then its place in the order."""
    return F.struct(F.abs(F.col("size") - F.col(f"gap{FILLS}")).alias("off"), *_KEY)


def _in_fills() -> Column:
    taken = F.lit(False)
    for i in range(FILLS):
        taken = taken | F.coalesce(_open(i) & (F.struct(*_KEY) <= F.col(f"end{i}")), F.lit(False))
    return taken


def _cuts(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source with a remainder all that decides which of its rows the sample takes; one row for each."""
    ranked = ranked.where("rest > 0")
    key = ranked.select(F.struct(*_KEY).alias("key")).schema["key"].dataType
    state = plan.where("rest > 0").select(*_SOURCE, F.col("rest").alias("gap0"), F.lit(None).cast(key).alias("last0"))
    state = F.broadcast(state)
    for i in range(FILLS):
        cut = _fill(ranked.join(state, _SOURCE), i)
        state = state.join(F.broadcast(cut), _SOURCE, "left")
        state = state.withColumn(f"gap{i + 1}", F.col(f"gap{i}") - F.coalesce("words", F.lit(0)))
        state = F.broadcast(store(state.withColumn(f"last{i + 1}", F.coalesce(f"end{i}", f"last{i}")).drop("words")))
    spare = ranked.join(state, _SOURCE).where(~_in_fills()).withColumn("near", _nearest())
    best = spare.where(F.col("near.off") < F.col(f"gap{FILLS}")).groupBy(*_SOURCE).agg(F.min("near").alias("best"))
    return F.broadcast(store(state.join(F.broadcast(best), _SOURCE, "left")))


def _taken(draws: DataFrame, share: float, weights: tuple, ceiling: float) -> DataFrame:
    plan = _plan(draws, share, weights, ceiling)
    ranked = _ranked(draws, plan)
    rows = ranked.join(_cuts(ranked, plan), _SOURCE, "left")
    more = _in_fills() | F.coalesce(_nearest() == F.col("best"), F.lit(False))
    return rows.withColumn("copies", F.col("copies") + more.cast("int"))


def mix_plan(docs: DataFrame, share: float = 1.5, weights: tuple = (3, 1, 2), ceiling: float = 2.0, seed: int = 17) -> DataFrame:
    """How often the mix takes each document.

    Sources sorted by code point, null last, weigh ``weights``, repeating, and share
    ``share`` times all words; no target is over ``ceiling`` times its source, the excess is
    shared again. Every document of a source gets the whole copies that its target holds.
    Of what remains, R words, each document has an inclusion probability; the expected words
    of all of them are R. It is equal for documents of up to a limit, R / 128 or as little
    more as R can be met with, and falls in proportion to the size above it. The sample is a
    Pareto order sample: documents in order of random odds divided by inclusion odds, until
    the next one would overrun R. What is open then is filled in the same order by documents
    that fit into it, and again, and at last by the one that brings the words nearest
    to R, if one does. One plan for every size: only documents in the same 1 / 4096 of the
    ranks as an end of the sample are ordered.

    Returns inclusion (null where nothing remains), doc_id, size, source_size, target, copies,
    taken. A null text is empty and has no words; empty documents add none. Repeated rows (of
    doc_id, source and text) have a draw each, by their number in the order they are read. An
    empty table gives no rows; columns other than doc_id, text, source are ignored.
    """
    draws = _draws(_rows(docs, ["doc_id", "text", "source"]), seed)
    taken = _taken(draws, share, weights, ceiling).withColumn("taken", F.col("size") * F.col("copies"))
    return taken.select("doc_id", "size", "source_size", "target", "inclusion", "copies", "taken")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple = (3, 1, 2), ceiling: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed documents themselves: each row as often as ``mix_plan`` takes it, all its columns kept.
    Nulls, empty texts, repeated rows, empty tables and other columns are as there. Rows are
    stored under numbers of their own, so those that are taken are shuffled once."""
    rows = store(_rows(docs, docs.columns))
    taken = _taken(_draws(rows, seed), share, weights, ceiling).where("copies > 0").select("_id", "copies")
    # both sides grow with the documents: by sort and merge at every size
    both = rows.join(taken.hint("merge"), "_id")
    return both.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
