"""What the training-data operators share: text rules, stored intermediates, split of hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalift.functions.names import scratch_dir

#: A word is a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = folder or scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def block_pairs(rows: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Cut groups of over ``limit`` rows into blocks and give each block pair a group of its own.

    Adds ``lo``, ``hi`` and ``block``: the rows of a key with one block stay as they are
    (0, 0, 0); with b blocks a row appears once for each block that its own must meet, in
    group (lo, hi), so that every pair of rows meets in exactly one group: pairs inside
    block i in group (i, i), pairs across in group (i, j). No task gets more than 2 *
    ``limit`` rows of a key (give or take the spread of a hash). Large keys are few, at
    most rows / ``limit``; they are stored first, so that Spark broadcasts them only if
    their size on disk is below its threshold.
    """
    large = store(
        rows.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > limit)
        .select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_blocks"))
    )
    blocks = F.coalesce(F.col("_blocks"), F.lit(1))
    return (
        rows.join(large, key, "left")
        .withColumn("block", F.pmod(F.xxhash64(F.lit(7), F.col(member)), blocks).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("block", "_other").cast("int"))
        .withColumn("hi", F.greatest("block", "_other").cast("int"))
        .drop("_blocks", "_other")
    )


def runs(batches, key_names):
    """Yield the tables of equal key from sorted Arrow batches; a run may cross batches."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if held is not None:
            part = pa.concat_tables([held, part]).combine_chunks()
        if not part.num_rows:
            continue
        change = np.zeros(part.num_rows - 1, dtype=bool)
        for name in key_names:
            v = part.column(name).to_numpy()
            change |= v[1:] != v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        sizes = np.diff(np.concatenate([starts, [part.num_rows]]))
        for start, size in zip(starts[:-1], sizes[:-1]):
            if size > 1:
                yield part.slice(start, size)
        held = part.slice(starts[-1])
    if held is not None and held.num_rows > 1:
        yield held
