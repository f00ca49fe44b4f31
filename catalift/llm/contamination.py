"""Benchmark decontamination: size-partitioned MinHash containment search of short items in
long documents, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

SHINGLE = 5
CONTAINED = 0.8
#: Benchmark text that one pass over the documents searches for; more text takes more passes.
#: Its shingles take about 17 times as much memory in the driver and in each task.
PASS_BYTES = 8 << 20
#: Bytes of documents worked on at a time; a longer document is a piece of its own.
PIECE = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2^64


def words_of(text: str | None) -> list[bytes]:
    """Words as bytes, A-Z in lower case, cut at space and the characters 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], n: int = SHINGLE) -> set[bytes]:
    """Distinct shingles; fewer words are one shingle, no words none."""
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def pieces(texts: list[bytes]):
    """Bounds of stretches of texts with about ``PIECE`` bytes together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


class Shingler:
    """Hashes of all shingles of a batch of texts by prefix sums over their bytes."""

    def __init__(self, n: int = SHINGLE):
        import numpy as np

        self.n = n
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        low[[32, 9, 10, 11, 12, 13]] = 32
        self.low = low
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, size: int):
        import numpy as np

        if len(self.powers) < size:
            base = np.full(size, _BASE, dtype=np.uint64)
            base[0] = 1
            self.powers = np.multiply.accumulate(base)
            base[1:] = pow(_BASE, -1, 1 << 64)
            self.inverse = np.multiply.accumulate(base)

    def hashes(self, texts: list[bytes]):
        """(hash of each shingle, number of its text); equal shingles have equal hashes."""
        import numpy as np

        joined = np.frombuffer(b" " + b"\x00 ".join(texts) + b"\x00 ", dtype=np.uint8)
        sizes = np.array([len(t) + 2 for t in texts])
        begins = np.cumsum(sizes) - sizes + 1
        ends_of = begins + sizes - 2  # place of the closing zero
        data = self.low[joined].copy()
        data[ends_of] = 32
        space = data == 32
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        keep[0] = True
        place = np.cumsum(keep) - 1
        data = data[keep]
        starts = np.flatnonzero((data[:-1] == 32) & (data[1:] != 32)) + 1
        stops = np.flatnonzero((data[:-1] != 32) & (data[1:] == 32)) + 1
        # words of each text
        first = np.searchsorted(starts, place[begins - 1])
        last = np.searchsorted(starts, place[np.minimum(ends_of, len(place) - 1)])
        n_words = last - first
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        n_shingles = np.where(n_words >= self.n, n_words - self.n + 1, np.minimum(n_words, 1))
        text = np.repeat(np.arange(len(texts)), n_shingles)
        offset = np.arange(n_shingles.sum()) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
        word = first[text] + offset
        a = starts[word] if len(word) else word
        b = stops[word + np.minimum(self.n, n_words[text]) - 1] if len(word) else word
        h = (sums[b] - sums[a]) * self.inverse[a]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h, text


def sketches(items: list[tuple], contained: float = CONTAINED):
    """MinHash sketches of a list of items (id, shingles, ...), by size: (sorted hashes, item of each).

    Items are partitioned by the power of two that their number of shingles reaches. In a
    partition whose largest item has u shingles the sketch holds the k = u - ceil(contained *
    u) + 1 smallest hashes of each item. A document that holds the item to that part misses
    fewer than k of its shingles, so it holds one of the sketch at least: nothing is missed.
    """
    import math

    import numpy as np

    shingler, partitions = Shingler(), {}
    for i, item in enumerate(items):
        partitions.setdefault(len(item[1]).bit_length(), []).append(i)
    hashes, owner = [], []
    for members in partitions.values():
        u = max(len(items[i][1]) for i in members)
        k = u - math.ceil(contained * u - 1e-9) + 1
        flat = [s for i in members for s in items[i][1]]
        # a shingle has no more words than the hasher takes, so it has one hash
        all_ = np.concatenate([shingler.hashes(flat[a:b])[0] for a, b in pieces(flat)])
        stops = np.cumsum([len(items[i][1]) for i in members])
        for i, own in zip(members, np.split(all_, stops[:-1])):
            h = np.unique(own)[:k]
            hashes.append(h)
            owner.append(np.full(len(h), i))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], owner[order]


def _search(docs: DataFrame, items: list[tuple[int, set[bytes], int, int]], contained: float) -> DataFrame:
    """Matches of items (id, shingles, words of a shingle, copies) in ``docs``."""
    spark = docs.sparkSession
    sketch, owner = sketches(items, contained)
    # at most PASS_BYTES of text and one sketch hash for about five shingles of it
    shared = spark.sparkContext.broadcast((sketch, owner, items))

    def find(batches):
        import numpy as np
        import pyarrow as pa

        sketch, owner, items = shared.value
        shinglers = [Shingler(n) for n in sorted({words for _, _, words, _ in items})]
        mask = np.uint64((1 << max(16, (16 * len(sketch)).bit_length())) - 1)
        may = np.zeros(int(mask) + 1, dtype=bool)
        may[sketch & mask] = True

        def look(ids, texts):
            pairs = set()
            for shingler in shinglers:
                h, text = shingler.hashes(texts)
                at = np.flatnonzero(may[h & mask])
                h, text = h[at], text[at]
                lo, hi = np.searchsorted(sketch, h, "left"), np.searchsorted(sketch, h, "right")
                hit = hi > lo
                for t, a, b in zip(text[hit].tolist(), lo[hit].tolist(), hi[hit].tolist()):
                    pairs.update((t, items[i][2], int(i)) for i in owner[a:b])
            last, shingles, rows = None, set(), []
            for t, n, i in sorted(pairs):
                if last != (t, n):
                    last, shingles = (t, n), shingle_set(texts[t].lower().split(), n)  # sorted: one set at a time
                item, own, _, copies = items[i]
                shared_ = len(own & shingles)
                if shared_ >= contained * len(own) - 1e-9:
                    rows += [(ids[t], item, shared_, len(own), shared_ / len(own))] * copies
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64()] * 4 + [pa.float64()]
            names = ["doc_id", "item_id", "shared", "shingles", "containment"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            start, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= PIECE or i == len(texts) - 1:
                    yield look(ids[start : i + 1], texts[start : i + 1])
                    start, size = i + 1, 0

    schema = "doc_id long, item_id long, shared long, shingles long, containment double"
    return docs.mapInArrow(find, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, shared, shingles, containment) for every item of which a document
    holds at least ``contained`` of the distinct five-word shingles. An item of one to four
    words is a shingle of that many words, and is looked for among such shingles of the documents.

    Sketches find candidates while the documents are read once; the shingles themselves are
    then compared. Documents never travel. The benchmark goes to the tasks in passes of about
    ``PASS_BYTES`` of text each, equal rows of it as one with a count. Null and empty items and
    documents match nothing; repeated rows of either side repeat their matches; a null doc_id or
    item_id stays null in the match; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    items = store(items.groupBy("item_id", "text").agg(F.count("*").alias("copies")))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-total // PASS_BYTES)
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        sets = []
        for r in part.toLocalIterator():
            words = words_of(r.text)
            if words:
                sets.append((r.item_id, shingle_set(words), min(len(words), SHINGLE), r.copies))
        own = _search(rows, sets, contained)
        found = own if found is None else found.union(own)
    empty = "doc_id long, item_id long, shared long, shingles long, containment double"
    return found if found is not None else spark.createDataFrame([], empty)


def decontaminate(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """``docs`` without the rows that hold an item, all columns kept. Rows of one doc_id go
    together, repeated ones too; rows without doc_id are judged by their text. Null and empty
    texts stay, long ones are searched whole; an empty benchmark leaves all rows, an empty
    ``docs`` none."""
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    named = docs.where(F.col("doc_id").isNotNull())
    bad = store(contaminated(named, benchmark, contained).select(F.col("doc_id").alias("_doc")).distinct())
    kept = marked.join(bad, "_doc", "left_anti").where("_doc is not null")
    nameless = docs.where(F.col("doc_id").isNull()).select(F.xxhash64("text").alias("doc_id"), "text")
    bad_texts = store(contaminated(nameless, benchmark, contained).select(F.col("doc_id").alias("_text")).distinct())
    return kept.union(marked.where("_doc is null").join(bad_texts, "_text", "left_anti").select(kept.columns)).select("row.*")
