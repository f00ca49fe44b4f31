"""Substring dedup over a De Bruijn graph of words: repeated paths are compacted, source coordinates verify them."""

from __future__ import annotations

from hashlib import blake2b, sha256

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .contamination import _BASE, Shingler, pieces

#: Words of an edge: two documents that share so many in a row share an edge.
EDGE = 50
#: Edges of a document that follow each other and have the same least hash of so many words are one stretch.
SEED = 16
#: Spans of one document that are digested together.
SPANS = 10_000

_OTHER = 0xD6E8FEB86659FD93 | 1


def _mixed(h):
    import numpy as np

    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Sums:
    """Hashes of any runs of numbers by prefix sums; equal runs have equal hashes wherever they lie."""

    def __init__(self, base: int):
        import numpy as np

        self.base, self.powers, self.inverse = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def over(self, numbers):
        import numpy as np

        n = len(numbers) + 1
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                run = np.full(n, base, np.uint64)
                run[0] = 1
                setattr(self, name, np.multiply.accumulate(run))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(numbers * self.powers[: n - 1], out=self.sums[1:])
        return self

    def runs(self, starts, stops):
        return _mixed((self.sums[stops] - self.sums[starts]) * self.inverse[starts])


class Words(Shingler):
    """Hashes of the words of a batch of texts, letters as they are."""

    def __init__(self):
        super().__init__(1)
        self.low[65:91] -= 32


def _least(values, width: int):
    """The least of each ``width`` neighbours."""
    import numpy as np

    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _edges(text, edge: int):
    """Places, in a run of words of texts one after the other, where an edge lies in one text."""
    import numpy as np

    if len(text) < edge:
        return np.zeros(0, np.int64)
    return np.flatnonzero(text[: len(text) - edge + 1] == text[edge - 1 :])


def stretches(docs: DataFrame, edge: int = EDGE, seed: int = SEED) -> DataFrame:
    """(doc, part, seed, key, lo, n): n edges from word lo on that share their least seed, and the
    hash of all their words. Equal edges have equal seeds, and lie in stretches of that seed."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        words, seeds, keys = Words(), _Sums(_BASE), _Sums(_OTHER)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            docs, parts = batch.column("doc").to_numpy(), batch.column("part").to_numpy()
            for start, stop in pieces(texts):
                h, text = words.hashes(texts[start:stop])
                at = _edges(text, edge)
                if not len(at):
                    continue
                every = np.arange(len(h) - seed + 1)
                least = _least(seeds.over(h).runs(every, every + seed), edge - seed + 1)[at]
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (text[at[1:]] != text[at[:-1]])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(at)))
                lo = at[first]
                key = keys.over(h).runs(lo, lo + n + edge - 1) ^ _mixed(n.astype(np.uint64))
                own = text[lo]
                begin = np.searchsorted(text, own)
                columns = [docs[start:stop][own], parts[start:stop][own], least[first].view(np.int64), key.view(np.int64)]
                columns += [(lo - begin).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "part", "seed", "key", "lo", "n"])

    return docs.mapInArrow(cut, "doc long, part long, seed long, key long, lo int, n int")


def _single(docs: DataFrame, edge: int) -> DataFrame:
    """(h, g, doc, part, lo) of the edges in the stretches ``spans`` of each document."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        words, one, two = Words(), _Sums(_BASE), _Sums(_OTHER)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            spans = batch.column("spans").to_pylist()
            docs, parts = batch.column("doc").to_numpy(), batch.column("part").to_numpy()
            for start, stop in pieces(texts):
                h, text = words.hashes(texts[start:stop])
                begin = np.searchsorted(text, np.arange(stop - start))
                own = np.concatenate([np.full(len(s), i) for i, s in enumerate(spans[start:stop])])
                lo = np.array([s["lo"] for part in spans[start:stop] for s in part])
                n = np.array([s["n"] for part in spans[start:stop] for s in part])
                own, lo = np.repeat(own, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = begin[own] + lo
                columns = [one.over(h).runs(at, at + edge).view(np.int64), two.over(h).runs(at, at + edge).view(np.int64)]
                columns += [docs[start:stop][own], parts[start:stop][own], lo.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "g", "doc", "part", "lo"])

    return docs.mapInArrow(cut, "h long, g long, doc long, part long, lo int")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("part"), F.coalesce("text", F.lit("")).alias("text"))


def repeated(docs: DataFrame, edge: int = EDGE, seed: int = SEED) -> DataFrame:
    """Paths (doc, part, lo, n, src, src_part, src_lo): the n edges from word lo on are also those
    of the document src, a smaller one, from word src_lo on.

    The graph: an edge is a run of ``edge`` words, which leads from its first words to its last.
    Edges of two documents are repeated; of each the source is the smallest document that holds
    it. Most edges are never taken one by one: those that follow each other around one seed are
    a stretch with a hash of its own, and equal stretches have equal edges. Only where
    different stretches share a seed, at the ends of what is shared, the edges of one document
    for each stretch are told apart. A path goes on from edge to edge as long as the document
    and its source go on alike; it ends where they branch.
    """
    texts = _documents(docs).where("doc IS NOT NULL")
    rows = store(stretches(texts, edge, seed))
    # what rows are joined with is stored first: both sides then come from a shuffle, and a hot key is split
    shared = rows.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("seed")
    rows = store(rows.join(store(shared), "seed"))
    source = F.min(F.struct("doc", "part", "lo")).alias("source")
    kinds = store(rows.groupBy("seed", "key", "n").agg(source))
    several = store(kinds.groupBy("seed").agg(F.count("*").alias("kinds")))
    kinds = store(kinds.join(several, "seed"))
    known = store(rows.join(kinds, ["seed", "key", "n"]).select(*rows.columns, "source", "kinds"))
    whole = known.where("doc > source.doc").select("doc", "part", "lo", "n", "source")

    asked = known.where("doc = source.doc AND kinds > 1")
    asked = store(asked.groupBy("doc", "part").agg(F.collect_set(F.struct("lo", "n")).alias("spans")))
    single = store(_single(texts.join(asked, ["doc", "part"]).select("doc", "part", "text", "spans"), edge))
    sources = single.groupBy("h", "g").agg(source, F.max("doc").alias("last")).where("source.doc < last")
    ends = single.join(store(sources), ["h", "g"]).where("doc > source.doc").select("doc", "part", "lo", F.lit(1).alias("n"), "source")

    # rows of a text that follow each other, in the source too, are one path
    rows = whole.union(ends).distinct()
    shift = F.col("source.lo") - F.col("lo")
    line = Window.partitionBy("doc", "part", "source.doc", "source.part", shift).orderBy("lo")
    begins = F.coalesce(F.lag(F.col("lo") + F.col("n")).over(line) != F.col("lo"), F.lit(True))
    paths = rows.withColumn("begins", begins).withColumn("path", F.sum(F.col("begins").cast("int")).over(line))
    paths = paths.groupBy("doc", "part", "source.doc", "source.part", shift.alias("shift"), "path").agg(
        F.min("lo").alias("lo"), F.sum("n").cast("int").alias("n")
    )
    return store(paths.toDF("doc", "part", "src", "src_part", "shift", "path", "lo", "n").select(
        "doc", "part", "lo", "n", "src", "src_part", (F.col("lo") + F.col("shift")).alias("src_lo")
    ))


def _without(docs: DataFrame, paths: DataFrame, edge: int) -> DataFrame:
    """Each text without the words of its paths, and digests of the spans that paths name in it."""
    own = paths.select("doc", "part", "lo", "n", F.lit(True).alias("gone"))
    theirs = paths.select(F.col("src").alias("doc"), F.col("src_part").alias("part"), F.col("src_lo").alias("lo"), "n", F.lit(False))
    spans = own.union(theirs).groupBy("doc", "part", "lo", "n").agg(F.max("gone").alias("gone"))
    # what goes stays together; spans that are only digested may be many and are dealt to copies of the text
    total = spans.where("not gone").groupBy("doc", "part").agg(F.ceil(F.count("*") / SPANS).alias("copies"))
    copy = F.when(F.col("gone"), 0).otherwise(F.pmod(F.xxhash64("lo", "n"), F.coalesce("copies", F.lit(1))))
    asked = spans.join(total, ["doc", "part"], "left").groupBy("doc", "part", copy.cast("int").alias("copy"))
    asked = store(asked.agg(F.collect_list(F.struct("lo", "n", "gone")).alias("spans")))
    # every text has a copy 0
    bare = asked.groupBy("doc", "part").agg(F.min("copy").alias("least")).where("least > 0")
    none = F.array().cast("array<struct<lo: int, n: int, gone: boolean>>")
    asked = asked.union(bare.select("doc", "part", F.lit(0).alias("copy"), none))

    def cut(batches):
        import pyarrow as pa

        span = pa.struct([("lo", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])
        names = ["doc", "part", "copy", "n_words", "n_removed", "kept_sha256", "digests"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(span)]
        for batch in batches:
            out = []
            columns = (batch.column(n) for n in ("doc", "part", "copy", "text", "spans"))
            for doc, part, copy, text, spans in zip(*(c.cast(pa.binary()).to_pylist() if c.type == pa.string() else c.to_pylist() for c in columns)):
                words = text.split()
                digests, kept, at = [], [], 0
                for s in sorted(spans or (), key=lambda s: s["lo"]):
                    stop = s["lo"] + s["n"] + edge - 1
                    said = b" ".join(words[s["lo"] : stop])
                    digests.append({"lo": s["lo"], "n": s["n"], "digest": blake2b(said, digest_size=16).digest()})
                    if s["gone"]:
                        kept += words[at : s["lo"]]
                        at = max(at, stop)
                if not copy:
                    kept += words[at:]
                    out.append((doc, part, 0, len(words), len(words) - len(kept), sha256(b" ".join(kept)).hexdigest(), digests))
                else:
                    out.append((doc, part, copy, None, None, None, digests))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)

    texts = _documents(docs).join(asked, ["doc", "part"], "left").select("doc", "part", "copy", "text", "spans")
    return store(texts.mapInArrow(
        cut,
        "doc long, part long, copy int, n_words long, n_removed long, kept_sha256 string, "
        "digests array<struct<lo: int, n: int, digest: binary>>",
    ))


def _false(found: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths whose words are not those at the coordinates of their source."""
    said = found.select("doc", "part", F.explode("digests").alias("d")).select("doc", "part", "d.*").distinct()
    said = store(said)
    own = paths.join(said, ["doc", "part", "lo", "n"]).withColumnRenamed("digest", "own")
    theirs = said.toDF("src", "src_part", "src_lo", "n", "digest")
    return own.join(theirs, ["src", "src_part", "src_lo", "n"]).where("own <> digest").select(*paths.columns)


def dedup_substrings(docs: DataFrame, edge: int = EDGE, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document without the words that any run of
    ``edge`` words covers which a document of a smaller doc_id has too.

    Words are runs of anything but space and the characters 9 to 13, as they are; runs are
    judged on the texts as given. Hashes find the paths (:func:`repeated`); the words of each are
    then compared with those at the coordinates of its source, by digests of 128 bits, and a
    path that differs does not count. Stretches and edges are combined before each shuffle, so
    a passage in every document costs a row for each; no task holds more than a text, or a
    batch of them.

    Null and empty texts have no words; texts of any length are taken whole; rows without a
    doc_id neither take nor lose words; rows of one doc_id do not count against each other;
    repeated rows stay rows; other columns are ignored; an empty table gives no rows.
    """
    paths = repeated(docs, edge, seed)
    found = _without(docs, paths, edge)
    false = store(_false(found, paths))
    if false.head(1):
        paths = store(paths.join(false, paths.columns, "left_anti"))
        found = _without(docs, paths, edge)
    return found.where("copy = 0").select(F.col("doc").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
