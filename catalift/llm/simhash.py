"""SimHash near-dedup: fingerprints linked by BK-trees over shards that share some bits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, runs, store
from .components import components

RADIUS = 4
SHINGLE = 4
#: Bits are cut into so many blocks; fingerprints within the radius agree in all but ``RADIUS`` of them.
BLOCKS = 6
#: Fingerprints in one tree.
TREE = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 for no words.

    A-Z are lower-cased; a text with fewer words is one shingle; a bit is set if it is set in
    over half of the XXH64 hashes (seed 42).
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    # bytes: lower() changes A-Z only, split() splits at space and 9 to 13
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp) of every row; fp is the fingerprint as a signed long."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(of, "doc_id long, text_key long, fp long")


class BKTree:
    """Integers by Hamming distance: children of a node are keyed by their distance to it."""

    def __init__(self):
        self.root = None

    def add(self, value: int, tag) -> None:
        node = self.root
        if node is None:
            self.root = (value, tag, {})
            return
        while True:
            distance = (node[0] ^ value).bit_count()
            child = node[2].get(distance)
            if child is None:
                node[2][distance] = (value, tag, {})
                return
            node = child

    def near(self, value: int, radius: int):
        """Tags within the radius: only edges of distance d - radius to d + radius are followed."""
        todo = [self.root] if self.root else []
        while todo:
            at, tag, children = todo.pop()
            distance = (at ^ value).bit_count()
            if distance <= radius:
                yield tag
            todo += [child for d, child in children.items() if distance - radius <= d <= distance + radius]


class Forest:
    """Union-find over 0..n-1; keeps the links that joined two groups."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def _shard_keys(blocks: int, radius: int) -> list:
    """A key for each choice of blocks - radius blocks: two fingerprints within the radius
    differ in at most ``radius`` blocks and so share one key at least."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    mask = lambda b: ((1 << cuts[b + 1]) - (1 << cuts[b]))
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        bits = sum(mask(b) for b in chosen)
        bits = bits - (1 << 64) if bits >> 63 else bits
        keys.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(bits).cast("long"))))
    return keys


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) that give the same components as all
    pairs within the radius.

    Fingerprints are dealt into shards that agree in ``blocks - radius`` blocks of bits, so no
    pair is missed. In each shard a BK-tree is grown and asked, along edges within the radius
    only. A shard of over ``TREE`` fingerprints is cut; each part's tree then goes to every
    other part of the shard, one pair of parts a task. Only links that join two groups of a
    shard leave it: a group of m near copies gives m - 1 links, not all pairs.
    """
    rows = fps.select("fp", F.explode(F.array(*_shard_keys(blocks, radius))).alias("key"))
    rows = block_pairs(rows, "key", "fp", TREE).select("key", "lo", "hi", "block", "fp")

    def link(batches):
        import numpy as np
        import pyarrow as pa

        a, b = [], []
        for run in runs(batches, ["key", "lo", "hi"]):
            values = run.column("fp").to_numpy()
            part = run.column("block").to_numpy().tolist()
            lo, hi = run.column("lo")[0].as_py(), run.column("hi")[0].as_py()
            bits = values.view(np.uint64).tolist()
            forest, tree = Forest(len(bits)), BKTree()
            if lo == hi:
                for i, value in enumerate(bits):
                    for j in tree.near(value, radius):
                        forest.link(i, j)
                    tree.add(value, i)
            else:
                for i, value in enumerate(bits):
                    if part[i] == lo:
                        tree.add(value, i)
                for i, value in enumerate(bits):
                    if part[i] == hi:
                        for j in tree.near(value, radius):
                            forest.link(i, j)
            for i, j in forest.links:
                a.append(values[i])
                b.append(values[j])
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(link, "a long, b long")


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, component, least, best) of every fingerprint: component names its class, also where
    no row has a doc_id; least is its smallest doc_id, best its smallest (no id, doc_id, text)."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(key).alias("best")))
    found = components(near_links(nodes.select("fp")), "a", "b")
    return nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "least", "best"
    )


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, component_id) of every row.

    component_id is the smallest doc_id that links of ``RADIUS`` or fewer differing bits
    reach. Equal fingerprints are one node, so exact copies of any number cost one. Null and
    empty texts have fingerprint 0 and link like any other; rows without doc_id are grouped
    but never name a group (its id is null if no row has one); repeated rows stay; an empty
    table gives no rows; other columns are ignored.
    """
    rows = store(fingerprints(docs))
    groups = _classes(rows)
    ids = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = store(groups.join(ids, "component").select("fp", "component_id"))
    return rows.join(named, "fp")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return simhash_groups(docs).select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of ``simhash_groups``, all columns kept: that of the smallest
    (doc_id, text), rows without doc_id last; of repeated rows any one. Texts of any length are
    one fingerprint, null and empty ones share a class; an empty table gives no rows."""
    best = _classes(store(fingerprints(docs))).groupBy("component").agg(F.min("best").alias("k")).select(
        F.coalesce("k.doc_id", F.lit(0)).alias("_doc"), F.col("k.no_id").alias("_no_id"), F.col("k.text_key").alias("_text")
    )
    best = store(best)
    own = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_doc"),
        F.col("doc_id").isNull().alias("_no_id"),
        F.xxhash64("text").alias("_text"),
    )
    on = ["_doc", "_no_id", "_text"]
    # what is kept grows with the rows: by sort and merge at every size; rows are dealt once for both steps
    return own.join(best.hint("merge"), on, "left_semi").dropDuplicates(on).select("row.*")
