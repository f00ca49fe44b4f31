"""Embedding near-dedup by lattice hashing: projections decoded to points of the E8 lattice."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, runs, store
from .components import components
from .simhash import Forest

COSINE = 0.93
#: Tables, cells asked in each (the own one and the nearest of its 240 neighbours), and the
#: width of a cell against a unit vector. Pairs at the threshold itself meet in a table with
#: probability 0.69, so in one of six with 0.999; closer pairs meet more often.
TABLES, PROBES, WIDTH = 6, 8, 1.25
#: Bits by which pairs of a cell are screened before their vectors are fetched. At the
#: threshold 15.4 of 128 differ on average, with a spread of 3.7; unrelated vectors differ in 64.
BITS, DIFFER = 128, 36
#: Vectors of one cell that a task compares with each other.
CELL = 512
SEED = 20_240


def neighbours():
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or all of 1/2 or -1/2 with
    an even number of minus signs."""
    import numpy as np

    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _even(y):
    """Nearest points with whole coordinates of even sum: round, and where the sum is odd
    round the coordinate that is farthest off the other way."""
    import numpy as np

    f = np.rint(y)
    off = y - f
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    at = np.abs(off[odd]).argmax(axis=1)
    f[odd, at] += np.where(off[odd, at] >= 0, 1.0, -1.0)
    return f


def decode(y):
    """Nearest E8 point of each row: the nearer of those with whole and with half coordinates."""
    import numpy as np

    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(y, probes: int = PROBES):
    """The own cell of each row and its nearest neighbours: rows x probes x 8, own first."""
    import numpy as np

    own, around = decode(y), neighbours()
    # |off - m|^2 without the part that is equal for all neighbours
    far = -2 * (y - own) @ around.T
    near = np.argsort(far, axis=1, kind="stable")[:, : probes - 1]
    return np.concatenate([own[:, None, :], own[:, None, :] + around[near]], axis=1)


def _mix(h, x):
    import numpy as np

    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _index(batches):
    """Unit vectors of representatives to cell keys of all tables and a bit sketch."""
    import numpy as np
    import pyarrow as pa

    drawn = {}
    for batch in batches:
        labels = batch.column("lab").to_numpy()
        vectors = [np.asarray(v.as_py(), dtype=float) for v in batch.column("vector")]
        sizes = np.array([len(v) for v in vectors])
        keys = np.zeros((len(vectors), TABLES * PROBES), dtype=np.int64)
        sketch = np.zeros((len(vectors), 2), dtype=np.int64)
        for dim in np.unique(sizes).tolist():
            if dim not in drawn:
                rng = np.random.default_rng([SEED, dim])
                drawn[dim] = rng.normal(size=(TABLES, dim, 8)) / WIDTH, rng.normal(size=(dim, BITS))
            tables, planes = drawn[dim]
            at = np.flatnonzero(sizes == dim)
            x = np.stack([vectors[i] for i in at])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for t in range(TABLES):
                points = (2 * cells(x @ tables[t])).astype(np.int64).view(np.uint64)
                h = np.repeat(labels[at].view(np.uint64)[:, None], PROBES, axis=1)
                h = _mix(h, np.uint64(t * 1_000_003 + dim))
                for c in range(8):
                    h = _mix(h, points[:, :, c])
                keys[at, t * PROBES : (t + 1) * PROBES] = h.view(np.int64)
            bits = np.packbits(x @ planes > 0, axis=1)
            sketch[at] = np.ascontiguousarray(bits).view(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * TABLES * PROBES, pa.array(keys.ravel()))
        columns = [batch.column("rid"), batch.column("lab"), batch.column("n"), batch.column("vector"), lists]
        columns += [pa.array(np.ascontiguousarray(sketch[:, i])) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["rid", "lab", "n", "vector", "keys", "s0", "s1"])


def _meet(run, own):
    """Blocks of (row numbers of cell owners, row numbers of askers) that a group compares."""
    import numpy as np

    block = run.column("block").to_numpy()
    lo, hi = run.column("lo")[0].as_py(), run.column("hi")[0].as_py()
    sides = [(block == lo, block == lo)] if lo == hi else [(block == lo, block == hi), (block == hi, block == lo)]
    for a, b in sides:
        mine, theirs = np.flatnonzero(own & a), np.flatnonzero(b)
        for i in range(0, len(mine), 512):
            yield mine[i : i + 512], theirs


def _screen(batches):
    """Rows of a cell that have a partner by their sketches."""
    import numpy as np
    import pyarrow as pa

    names = ["key", "lo", "hi", "block", "own", "rid"]
    kept, size = [], 0
    for run in runs(batches, ["key", "lo", "hi"]):
        own = run.column("own").to_numpy()
        if not own.any():
            continue
        s = [run.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")]
        rid = run.column("rid").to_numpy()
        good = np.zeros(run.num_rows, dtype=bool)
        for mine, theirs in _meet(run, own):
            differ = sum(np.bitwise_count(x[mine][:, None] ^ x[theirs][None, :]).astype(np.uint16) for x in s)
            near = (differ <= DIFFER) & (rid[mine][:, None] != rid[theirs][None, :])
            good[mine] |= near.any(axis=1)
            good[theirs] |= near.any(axis=0)
        if good.any():
            kept.append(run.select(names).filter(pa.array(good)))
            size += kept[-1].num_rows
        if size > 100_000:
            yield from pa.concat_tables(kept).combine_chunks().to_batches()
            kept, size = [], 0
    if kept:
        yield from pa.concat_tables(kept).combine_chunks().to_batches()


def _verify(batches):
    """Exact cosines of a cell. A pair may meet in several cells: it is counted in the first,
    by table, then by key. Gives (a, null, links of a) and the links (a, b) that join groups."""
    import numpy as np
    import pyarrow as pa

    def out(a, b, n):
        columns = [pa.array(v, pa.int64()) for v in (a, b, n)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    a, b, n = [], [], []
    for run in runs(batches, ["key", "lo", "hi"]):
        own = run.column("own").to_numpy()
        rid, lab, many = (run.column(c).to_numpy() for c in ("rid", "lab", "n"))
        keys = np.stack(run.column("keys").to_numpy()).reshape(run.num_rows, TABLES, PROBES)
        vectors = [np.asarray(v.as_py(), dtype=float) for v in run.column("vector")]
        dims = np.array([len(v) for v in vectors])
        x = np.zeros((run.num_rows, dims.max()))
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        norms = np.linalg.norm(x, axis=1)
        key, forest = run.column("key")[0].as_py(), Forest(run.num_rows)
        counts = np.zeros(run.num_rows, dtype=np.int64)
        for mine, theirs in _meet(run, own):
            cosine = (x[mine] @ x[theirs].T) / (norms[mine][:, None] * norms[theirs][None, :])
            # of two owners only one order of the pair
            i, j = np.nonzero(cosine >= COSINE)
            i, j = mine[i], theirs[j]
            ok = (rid[i] != rid[j]) & (lab[i] == lab[j]) & (dims[i] == dims[j]) & ~(own[j] & (rid[j] < rid[i]))
            i, j = i[ok], j[ok]
            for s in range(0, len(i), 65_536):
                p, q = i[s : s + 65_536], j[s : s + 65_536]
                first = np.full(len(p), -1)
                chosen = np.zeros(len(p), dtype=np.int64)
                for t in range(TABLES):
                    kp, kq = keys[p, t, 0], keys[q, t, 0]
                    in_q = (keys[q, t] == kp[:, None]).any(axis=1)
                    in_p = (keys[p, t] == kq[:, None]).any(axis=1)
                    here = (first < 0) & (in_q | in_p)
                    low = np.where(in_q & in_p, np.minimum(kp, kq), np.where(in_q, kp, kq))
                    chosen[here], first[here] = low[here], t
                count = chosen == key
                p, q = p[count], q[count]
                np.add.at(counts, p, many[q])
                np.add.at(counts, q, many[p])
                for u, v in zip(p.tolist(), q.tolist()):
                    forest.link(u, v)
        some = np.flatnonzero(counts)
        a += rid[some].tolist()
        b += [None] * len(some)
        n += counts[some].tolist()
        for u, v in forest.links:
            a.append(int(rid[u]))
            b.append(int(rid[v]))
            n.append(None)
        if len(a) > 100_000:
            yield out(a, b, n)
            a, b, n = [], [], []
    yield out(a, b, n)


def near_vectors(vectors: DataFrame) -> DataFrame:
    """Rows of ``vectors`` (vec_id, embedding, label) with n_links, component_id and kept.

    Vectors are compared only where labels are equal and not null; they link at a cosine of
    ``COSINE`` or more. Vectors that are null, empty or zero, or hold null or non-finite components,
    and rows without vec_id or label, link with nothing; so do vectors of unequal length.

    Equal vectors of a label are one node, whatever their number. Each node is projected to
    eight dimensions in every table and filed under its lattice cell; it asks that cell and
    the nearest neighbours. Cells hold ids and bit sketches; only nodes with a likely partner
    send their vectors, whose cosines decide. Cells of over ``CELL`` rows are cut into blocks that
    meet pair by pair. Links are counted where they are found; those that join groups make
    the components. kept is vec_id = component_id (both null counts as equal); repeated rows
    are vectors of their own, equal in all they return; an empty table gives no rows.
    """
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.xxhash64(F.col("label").cast("string")).alias("lab"),
        F.size(e).alias("dim"),
        F.xxhash64(e).alias("h0"),
        F.hash(e).alias("h1"),
        valid.alias("valid"),
        e.alias("vector"),
    )
    same = ["lab", "dim", "h0", "h1"]
    nodes = rows.where("valid").groupBy(*same).agg(
        F.min("vec_id").alias("rid"), F.count("*").alias("n"), F.first("vector").alias("vector")
    )
    vector = nodes.schema["vector"].dataType.simpleString()
    schema = f"rid long, lab long, n long, vector {vector}, keys array<long>, s0 long, s1 long"
    nodes = store(nodes)
    index = store(nodes.select("rid", "lab", "n", "vector").mapInArrow(_index, schema))

    asks = index.select("rid", "s0", "s1", F.posexplode("keys").alias("pos", "key"))
    asks = asks.withColumn("own", F.col("pos") % PROBES == 0).drop("pos")
    asks = block_pairs(asks, "key", "rid", CELL).select("key", "lo", "hi", "block", "own", "rid", "s0", "s1")
    group = ["key", "lo", "hi"]
    screened = "key long, lo int, hi int, block int, own boolean, rid long"
    likely = asks.repartition(*group).sortWithinPartitions(*group).mapInArrow(_screen, screened)
    likely = store(likely).join(index.select("rid", "lab", "n", "vector", "keys"), "rid")
    found = store(likely.repartition(*group).sortWithinPartitions(*group).mapInArrow(_verify, "a long, b long, n long"))

    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("more"))
    groups = components(found.where("b is not null"), "a", "b")
    known = (
        nodes.select(*same, "rid", "n")
        .join(counts, F.col("rid") == F.col("a"), "left")
        .join(groups, F.col("rid") == F.col("node"), "left")
        .select(
            *[F.col(c).alias(f"k_{c}") for c in same],
            (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rid").alias("component_id"),
        )
    )
    known = store(known)
    on = [rows[c] == known[f"k_{c}"] for c in same] + [rows["valid"]]
    component = F.coalesce("component_id", "vec_id")
    return rows.drop("vector").join(known, on, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
