"""LM scoring by Katz backoff: Good-Turing discounted bigrams that back off to unigrams.

The corpus is cut into chunks whose tokens are numbered locally. Counts are global: each
chunk sends its distinct keys with its own counts to buckets of the key space, and gets the
totals back for its own keys, once for words and once for bigrams. So no task holds a whole
vocabulary, a frequent key is one entry of each chunk, and all that travels is arrays.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalift.functions.names import scratch_dir

from .common import store

#: Counts above are trusted as they are.
TRUSTED = 5
#: Text bytes of a chunk (a longer document is a chunk of its own), and keys of a bucket.
CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 500_000
LEAST_BUCKETS = 64
#: Histories with over 1 / HOT of all tokens (so at most HOT of them) are spread over all buckets.
HOT = 1000
#: The symbol before the first and after the last word; no word holds a space.
EDGE = b" "

_CHUNK = (
    "chunk long, n_keys long, doc_id array<long>, held array<boolean>, sizes array<int>, "
    "ids binary, vocab binary"
)


def _bucketed(chunks: DataFrame) -> DataFrame:
    """Chunks as a table in the shared scratch folder, bucketed by chunk: what the buckets send
    back is joined to it twice, and only that travels. The name is needed to read the table
    as bucketed and is dropped again; the files stay."""
    spark = chunks.sparkSession
    name = f"catalift_chunks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.bucketBy(parts, "chunk").option("path", scratch_dir(spark)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _rows(batches):
    """Rows of Arrow batches one by one: a row holds a whole chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _pack(array) -> bytes:
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _unpack(data: bytes, dtype):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


# --- discounts ------------------------------------------------------------------------


def discounts(ones: list[int]) -> list[float]:
    """d_1..d_TRUSTED from the numbers of keys seen 1, 2, .. TRUSTED + 1 times.

    Good-Turing as Katz scales it: large counts keep their mass and all that is taken goes to
    the unseen. Where these numbers give no proper discount (small or odd corpora) a constant
    part of one count is taken instead.
    """
    k = TRUSTED
    if min(ones) > 0:
        a = (k + 1) * ones[k] / ones[0]
        if a < 1:
            d = [((r + 1) * ones[r] / (r * ones[r - 1]) - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return d
    part = ones[0] / (ones[0] + 2 * ones[1]) if ones[0] else 0.5
    part = min(0.9, max(0.1, part))
    return [1 - part / r for r in range(1, k + 1)]


@dataclass(frozen=True)
class Unigrams:
    """Probabilities by training count; count 0 is the one class of unknown words."""

    tokens: int
    types: int
    ones: tuple

    def table(self):
        """p for counts 0..TRUSTED, and the divisor of larger ones."""
        d = discounts(list(self.ones))
        mass = sum((1 - d[r - 1]) * r * self.ones[r - 1] for r in range(1, TRUSTED + 1))
        # counts that are all trusted leave nothing: then the unknown count as seen once
        total = self.tokens + (0 if mass > 0 else 1)
        known = [d[r - 1] * r / total for r in range(1, TRUSTED + 1)]
        return [(mass if mass > 0 else 1) / total, *known], total

    def p(self, counts):
        import numpy as np

        small, total = self.table()
        return np.where(counts <= TRUSTED, np.array(small)[np.minimum(counts, TRUSTED)], counts / total)

    def base(self, counts):
        import numpy as np

        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


# --- chunks ---------------------------------------------------------------------------


def _chunker(batches):
    """Documents to chunks: tokens as numbers of a local vocabulary, number 0 is the edge."""
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    def out(docs):
        local, ids, sizes = {EDGE: 0}, [], []
        for _, _, text in docs:
            words = text.lower().split()
            ids += [local.setdefault(w, len(local)) for w in words]
            ids.append(0)
            sizes.append(len(words) + 1)
        vocab = np.fromiter(map(xxh64_intdigest, local), np.uint64, len(local))
        row = {
            "chunk": uuid.uuid4().int >> 65,
            "n_keys": len(local),
            "doc_id": [d[0] for d in docs],
            "held": [d[1] for d in docs],
            "sizes": sizes,
            "ids": _pack(np.array(ids, dtype=np.int32)),
            "vocab": vocab.tobytes(),
        }
        schema = [("chunk", pa.int64()), ("n_keys", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))]
        schema += [("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("vocab", pa.binary())]
        return pa.RecordBatch.from_pylist([row], pa.schema(schema))

    docs, size = [], 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for doc_id, held, text in zip(batch.column("doc_id"), batch.column("held"), texts):
            docs.append((doc_id.as_py(), held.as_py(), text.as_py()))
            size += len(docs[-1][2])
            if size >= CHUNK_BYTES:
                yield out(docs)
                docs, size = [], 0
    if docs:
        yield out(docs)


def _tokens(row):
    """Token ids, the document of each token, and whether it is for training."""
    import numpy as np

    sizes = np.array(row["sizes"])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return _unpack(row["ids"], np.int32), doc, ~np.array(row["held"], dtype=bool)[doc]


def _bucket(keys, buckets: int):
    """Bucket of 64-bit keys, from their upper half."""
    import numpy as np

    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _slices(bucket):
    """(bucket, places in it) for each bucket that occurs, in order."""
    import numpy as np

    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _ones(counts):
    """How many counts are 1, 2, .. TRUSTED + 1."""
    import numpy as np

    return np.bincount(np.minimum(counts, TRUSTED + 2), minlength=TRUSTED + 3)[1 : TRUSTED + 2].tolist()


# --- words ----------------------------------------------------------------------------


def _word_counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, totals of the chunk's words there); a row without chunk holds sums."""

    def send(batches):
        import numpy as np
        import pyarrow as pa

        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for row in _rows(batches):
            ids, _, train = _tokens(row)
            vocab = np.frombuffer(row["vocab"], dtype=np.uint64)
            own = np.bincount(ids[train], minlength=len(vocab)).astype(np.int32)
            rows = [
                (b, row["chunk"], vocab[part].tobytes(), _pack(own[part])) for b, part in _slices(_bucket(vocab, buckets))
            ]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "keys", "own"])

    def total(table):
        import numpy as np
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        keys = [np.frombuffer(r["keys"], dtype=np.uint64) for r in rows]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, np.concatenate([_unpack(r["own"], np.int32) for r in rows]), len(every)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        bucket = rows[0]["bucket"]
        out = [(r["chunk"], bucket, _pack(sums[p]), None) for r, p in zip(rows, np.split(back, ends))]
        out.append((None, bucket, None, [int(sums.sum()), int((sums > 0).sum()), *_ones(sums)]))
        types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        names = ["chunk", "bucket", "totals", "sums"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    sent = chunks.select("chunk", "held", "sizes", "ids", "vocab").mapInArrow(
        send, "bucket int, chunk long, keys binary, own binary"
    )
    return store(sent.groupBy("bucket").applyInArrow(total, "chunk long, bucket int, totals binary, sums array<long>"))


def _sums(table: DataFrame, n: int) -> list[int]:
    parts = [F.sum(F.col("sums")[i]) for i in range(n)]
    return [int(x or 0) for x in table.where("chunk is null and sums is not null").agg(*parts).first()]


def _gather(chunks: DataFrame, *tables: tuple[DataFrame, str, list[str]]) -> DataFrame:
    """Chunks with what the buckets sent back, as arrays of structs."""
    for table, name, columns in tables:
        parts = table.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", *columns)).alias(name))
        chunks = chunks.join(parts, "chunk")
    return chunks


def _totals(row, buckets: int):
    """Training counts of the chunk's vocabulary."""
    import numpy as np

    vocab = np.frombuffer(row["vocab"], dtype=np.uint64)
    counts = np.zeros(len(vocab), dtype=np.int64)
    came = {p["bucket"]: p["totals"] for p in row["words"]}
    for b, part in _slices(_bucket(vocab, buckets)):
        counts[part] = _unpack(came[b], np.int64)
    return vocab, counts


# --- bigrams --------------------------------------------------------------------------


def _pairs(row, vocab, counts, buckets: int, hot_from: float):
    """Distinct (history, word) of a chunk sorted by both, the pair of each token, and the
    bucket of each pair: by history, so that all that follows it meets, but for hot ones."""
    import numpy as np

    ids, doc, train = _tokens(row)
    before = np.concatenate([[0], ids[:-1]])  # a document begins after an edge
    code, back = np.unique(before.astype(np.int64) * len(vocab) + ids, return_inverse=True)
    h, w = code // len(vocab), code % len(vocab)
    hot = counts[h] > hot_from
    key = np.where(hot, (vocab[h] ^ (vocab[w] << np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15), vocab[h])
    return ids, doc, train, h, w, back, hot, _bucket(key, buckets)


def _starts(h):
    """Where each history begins in pairs sorted by it."""
    import numpy as np

    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))


_BACK = "chunk long, bucket int, seen binary, few binary, mass binary, none binary, sums array<long>, hot long"


def _bigram_counts(chunks: DataFrame, words: DataFrame, unigrams: Unigrams, buckets: int, word_buckets: int) -> DataFrame:
    """For each chunk and bucket: seen, the totals of its pairs; few and mass, for histories
    with pairs unseen in training, how many followers were seen 1..TRUSTED times and the
    unigram mass of all followers; none, histories whose followers are all trusted. Rows
    without chunk hold sums, or the few and mass of a part of a hot history."""
    hot_from = unigrams.tokens / HOT

    def send(batches):
        import numpy as np
        import pyarrow as pa

        types = [pa.int32(), pa.int64()] + [pa.binary()] * 5
        names = ["bucket", "chunk", "h", "w", "own", "count", "hot"]
        for row in _rows(batches):
            vocab, counts = _totals(row, word_buckets)
            ids, _, train, h, w, back, hot, bucket = _pairs(row, vocab, counts, buckets, hot_from)
            own = np.bincount(back, train, len(h)).astype(np.int32)
            rows = [
                (b, row["chunk"], _pack(vocab[h[p]]), vocab[w[p]].tobytes(), _pack(own[p]), _pack(counts[w[p]]), _pack(hot[p]))
                for b, p in _slices(bucket)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def total(table):
        import numpy as np
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        load = lambda name, dtype: np.concatenate([_unpack(r[name], dtype) for r in rows])
        sizes = [len(r["w"]) // 8 for r in rows]
        h, w = load("h", np.uint64), np.concatenate([np.frombuffer(r["w"], dtype=np.uint64) for r in rows])
        pair = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(31)) ^ w
        _, first, back = np.unique(pair, return_index=True, return_inverse=True)
        r = np.bincount(back, load("own", np.int32), len(first)).astype(np.int64)
        there = r > 0
        p = unigrams.p(load("count", np.int64)[first])
        every, at = np.unique(h[first], return_inverse=True)
        few = np.stack([np.bincount(at, r == k, len(every)) for k in range(1, TRUSTED + 1)], axis=1).astype(np.int64)
        mass = np.bincount(at, np.where(there, p, 0.0), len(every))
        known = np.bincount(at, there, len(every)) > 0
        heat = np.zeros(len(every), dtype=bool)
        heat[at] = load("hot", bool)[first]
        bucket, out = rows[0]["bucket"], []
        ends = np.cumsum(sizes)
        for row, a, b in zip(rows, ends - sizes, ends):
            seen = r[back[a:b]]
            starts = _starts(h[a:b])
            place = np.searchsorted(every, h[a:b][starts])
            wants = (np.minimum.reduceat(seen, starts) == 0) & known[place] & ~heat[place]
            empty = known[place] & ~few[place].any(axis=1) & ~heat[place]
            got = place[wants]
            out.append((row["chunk"], bucket, _pack(seen.astype(np.int32)), _pack(few[got]), _pack(mass[got]), _pack(empty), None, None))
        out.append((None, bucket, None, None, None, None, _ones(r), None))
        for i in np.flatnonzero(heat & known):
            out.append((None, bucket, None, _pack(few[i]), _pack(mass[i : i + 1]), None, None, int(every[i : i + 1].view(np.int64)[0])))
        types = [pa.int64(), pa.int32()] + [pa.binary()] * 4 + [pa.list_(pa.int64()), pa.int64()]
        names = [f.split()[0] for f in _BACK.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    full = _gather(chunks.drop("doc_id", "n_keys"), (words, "words", ["totals"]))
    sent = full.mapInArrow(send, "bucket int, chunk long, h binary, w binary, own binary, count binary, hot binary")
    return store(sent.groupBy("bucket").applyInArrow(total, _BACK))


def _hot_histories(bigrams: DataFrame) -> dict:
    """few and mass of the hot histories: at most HOT of them, in a part for each bucket,
    summed on the executors."""

    def add(table):
        import numpy as np
        import pyarrow as pa

        few = sum(_unpack(x.as_py(), np.int64) for x in table.column("few"))
        mass = sum(sorted(float(_unpack(x.as_py(), float)[0]) for x in table.column("mass")))
        return pa.table([table.column("hot")[:1], pa.array([few.tolist()], pa.list_(pa.int64())), pa.array([mass])], ["hot", "few", "mass"])

    parts = bigrams.where("hot is not null").select("hot", "few", "mass")
    rows = parts.groupBy("hot").applyInArrow(add, "hot long, few array<long>, mass double").collect()
    return {r.hot: (list(r.few), r.mass) for r in rows}


def backoff(count, few, mass, d):
    """(divisor, weight) of histories: seen words get d r / divisor, unseen ones weight times
    their unigram probability, so that all probabilities sum to 1 exactly."""
    import numpy as np

    taken = (few * ((1 - np.array(d)) * np.arange(1, TRUSTED + 1))).sum(axis=1)
    # if every follower is trusted, backing off counts as seen once
    divisor = np.maximum(1, np.where(taken > 0, count, count + 1))
    return divisor, (divisor - count + taken) / divisor / (1 - mass)


# --- scores ---------------------------------------------------------------------------

_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out_of(doc_id: Column) -> Column:
    """True where the crc32 of the doc_id as text is divisible by 10; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def katz_scores(docs: DataFrame) -> DataFrame:
    """log10 probability of every whole text, learned from all documents not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are
    the words with A-Z in lower case and one end. score is that of the Katz bigram model:
    p(w | h) = d c(h, w) / c(h) where seen, else a(h) p(w), with Good-Turing discounts and
    a(h) from the exact sums over the followers of h; p(w) is a Good-Turing unigram model with
    one class of unknown words; a history unseen in training uses p(w) alone. base_score is
    the additive unigram score. A null text is empty: one end. Rows without doc_id are held
    out; repeated rows count and are scored each; with nothing to learn from, every word is
    unknown; an empty table gives no rows; other columns are ignored. Keys are 64-bit hashes.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out_of(F.col("doc_id")).alias("held"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    chunks = _bucketed(rows.mapInArrow(_chunker, _CHUNK))
    size = chunks.agg(F.sum("n_keys"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    word_buckets = max(LEAST_BUCKETS, -(-(size[0] or 0) // BUCKET_KEYS))
    buckets = max(LEAST_BUCKETS, -(-(size[1] or 0) // BUCKET_KEYS))
    words = _word_counts(chunks, word_buckets)
    tokens, types, *ones = _sums(words, 2 + TRUSTED + 1)
    unigrams = Unigrams(tokens, types, tuple(ones))
    bigrams = _bigram_counts(chunks, words, unigrams, buckets, word_buckets)
    d = discounts(_sums(bigrams, TRUSTED + 1))
    hot_from = tokens / HOT
    hot_rows = docs.sparkSession.sparkContext.broadcast(_hot_histories(bigrams))

    def score(batches):
        import numpy as np
        import pyarrow as pa

        shared = hot_rows.value
        scale = np.array([0.0, *d])
        for row in _rows(batches):
            vocab, counts = _totals(row, word_buckets)
            ids, doc, _, h, w, back, hot, bucket = _pairs(row, vocab, counts, buckets, hot_from)
            came = {p["bucket"]: p for p in row["pairs"]}
            seen = np.zeros(len(h), dtype=np.int64)
            few = np.zeros((len(vocab), TRUSTED))
            few[:, 0] = 1  # where only the divisor matters: some follower is not trusted
            mass = np.zeros(len(vocab))
            for b, part in _slices(bucket):
                got = came[b]
                seen[part] = _unpack(got["seen"], np.int32)
                starts = _starts(h[part])
                at = h[part][starts]
                few[at[_unpack(got["none"], bool)]] = 0
                wants = (np.minimum.reduceat(seen[part], starts) == 0) & (counts[at] > 0) & ~hot[part][starts]
                few[at[wants]] = _unpack(got["few"], np.int64).reshape(-1, TRUSTED)
                mass[at[wants]] = _unpack(got["mass"], float)
            for i in np.unique(h[hot]):
                few[i], mass[i] = shared[int(vocab[i : i + 1].view(np.int64)[0])]
            divisor, weight = backoff(counts, few, mass, d)
            unigram = unigrams.p(counts)
            known = np.where(seen <= TRUSTED, scale[np.minimum(seen, TRUSTED)], 1.0) * seen
            with np.errstate(divide="ignore", invalid="ignore"):
                lower = np.where(counts[h] > 0, weight[h], 1.0) * unigram[w]
                p = np.log10(np.where(seen > 0, known / divisor[h], lower))
            n = len(row["sizes"])
            columns = [
                pa.array(row["doc_id"], pa.int64()),
                pa.array(row["held"], pa.bool_()),
                pa.array(row["sizes"], pa.int64()),
                pa.array(np.bincount(doc, counts[ids] > 0, n).astype(np.int64)),
                pa.array(np.bincount(doc, unigrams.base(counts)[ids], n)),
                pa.array(np.bincount(doc, p[back], n)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SCORES.split(", ")])

    full = _gather(chunks, (words, "words", ["totals"]), (bigrams, "pairs", ["seen", "few", "mass", "none"]))
    scores = full.mapInArrow(score, _SCORES)
    return scores.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
