"""Sharding by vector bin packing: bytes, tokens and rows are balanced together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, store, whole

SIZES = ("bytes", "tokens", "n")
#: A group of equal texts with over 1 / (shards * PIECES) of any size is cut.
PIECES = 4
#: Repeated rows of one doc_id that are so many are cut into so many times more pieces.
FINER = 16
#: Groups with over 1 / LARGE of any size are placed first; at most 3 * LARGE exist.
LARGE = 2048
#: Groups that one task packs at a time.
SLICE_GROUPS = 2048
#: Rows numbered together within a shard.
CHUNK_ROWS = 65_536


def pack(demands, capacity):
    """Shard of each demand (rows of a matrix), largest first: the shard whose remaining
    capacity (shards x sizes, changed in place) has the highest dot product with it; ties go
    to the lowest shard."""
    import numpy as np

    shards = np.zeros(len(demands), dtype=np.int32)
    for i in np.argsort(-demands.max(axis=1), kind="stable") if len(demands) else ():
        at = int((capacity @ demands[i]).argmax())
        shards[i] = at
        capacity[at] -= demands[i]
    return shards


def _size(text: Column) -> list[Column]:
    text = whole(text)
    return [
        (F.octet_length(text) + 1).cast("long").alias("bytes"),
        n_words(text).alias("tokens"),
        F.xxhash64(text).alias("text_key"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ]


def shard_plan(docs: DataFrame, shards: int = 8) -> DataFrame:
    """A shard and a slot for every row of ``docs``.

    Groups of equal texts stay together unless they are over a quarter of a shard; larger
    ones are cut by doc_id into pieces of about that, and repeated rows of one doc_id that are
    over a quarter of a shard themselves by a number of their own. The few groups that are large against
    the whole (at most 3 * ``LARGE``) are placed by the driver; all others by tasks that each
    take an even slice of the groups and fill the same part of every shard's remaining
    capacity. Each group goes, largest first, where the dot product of its (bytes, tokens,
    rows) with what is left is highest. Slots are gapless from 0 within a shard: chunks of
    rows are numbered apart and moved up by the counts of the chunks before.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard. A null
    text counts as an empty one; a null doc_id sorts first; repeated rows each get a slot; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = store(docs.select("doc_id", *_size(F.col("text")), F.monotonically_increasing_id().alias("own")))
    sums = [F.sum(c).alias(c) for c in ("bytes", "tokens")]
    groups = rows.groupBy("text_key").agg(*sums, F.count("*").alias("n"))
    total = groups.agg(*[F.sum(c).alias(c) for c in SIZES], F.count("*").alias("groups")).first()
    totals = [max(1, total[c] or 0) for c in SIZES]
    share = lambda c, t, parts: F.ceil(F.col(c) * parts / t)
    parts = F.greatest(*[share(c, t, shards * PIECES) for c, t in zip(SIZES, totals)]).cast("int")
    # at most 3 * shards * PIECES groups are above the bound, so this side may be broadcast
    cut = groups.where((F.col("n") > 1) & (parts > 1)).select("text_key", parts.alias("parts"))
    # nor are more keys of repeated rows; what rows of one key differ in is their number only
    keys = rows.join(F.broadcast(cut.drop("parts")), "text_key").groupBy("text_key", "doc_id").agg(*sums, F.count("*").alias("n"))
    again = keys.where((F.col("n") > 1) & (parts > 1)).select(F.col("text_key").alias("_text"), F.col("doc_id").alias("_doc"), F.lit(True).alias("_again"))
    rows = rows.join(F.broadcast(cut), "text_key", "left")
    rows = rows.join(F.broadcast(again), (F.col("text_key") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    rows = rows.withColumn("own", F.when(F.col("_again"), F.col("own"))).drop("_text", "_doc", "_again")
    pieces = F.when(F.col("own").isNull(), F.col("parts")).otherwise(F.col("parts") * FINER)
    piece = F.pmod(F.coalesce("own", F.xxhash64(F.lit(3), "doc_id")), F.coalesce(pieces, F.lit(1))).cast("int")
    rows = rows.withColumn("piece", piece).drop("parts")
    units = store(rows.groupBy("text_key", "piece").agg(*sums, F.count("*").alias("n")))

    over = F.greatest(*[F.col(c) / t for c, t in zip(SIZES, totals)]) > 1.0 / LARGE
    large = units.where(over).collect()
    import numpy as np

    large.sort(key=lambda r: (r.text_key, r.piece))
    demands = np.array([[r[c] / t for c, t in zip(SIZES, totals)] for r in large]).reshape(-1, len(SIZES))
    left = np.full((shards, len(SIZES)), 1.0 / shards)
    placed = [(r.text_key, r.piece, int(s)) for r, s in zip(large, pack(demands, left))]
    left = np.maximum(left, 0)
    left = (left / np.maximum(left.sum(axis=0), 1e-12)).tolist()

    def fill(frame):
        import numpy as np

        frame = frame.sort_values(["text_key", "piece"], ignore_index=True)
        d = frame[list(SIZES)].to_numpy(dtype=float)
        d /= np.maximum(d.sum(axis=0), 1)
        frame["shard"] = pack(d, np.array(left))
        return frame[["text_key", "piece", "shard"]]

    slices = max(1, -(-(total["groups"] or 0) // SLICE_GROUPS))
    at = F.pmod(F.xxhash64(F.lit(5), "text_key", "piece"), F.lit(slices)).alias("slice")
    schema = "text_key long, piece int, shard int"
    small = units.where(~over).groupBy(at).applyInPandas(fill, schema)
    where = small.union(spark.createDataFrame(placed, schema))

    chunks = max(64, -(-(total["n"] or 0) // CHUNK_ROWS))
    chunk = F.pmod(F.xxhash64(F.lit(9), "text_key", "doc_id", "own"), F.lit(chunks)).cast("int")
    put = store(rows.join(where, ["text_key", "piece"]).withColumn("chunk", chunk))
    counts = put.groupBy("shard", "chunk").count()
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "chunk").orderBy("text_key", "doc_id")
    return (
        put.withColumn("nth", F.row_number().over(within))
        .join(start, ["shard", "chunk"])
        .select(
            "doc_id",
            F.col("bytes").alias("size"),
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
