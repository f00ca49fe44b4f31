"""Merkle manifest of documents: checkpoint levels are stored, the levels between are recomputed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Consecutive nodes that become one.
FANOUT = 2
#: Levels between two stored ones: a subtree of FANOUT ** STEP nodes is recomputed at a time.
STEP = 8
#: The tampering test changes documents whose crc32(doc_id) this divides.
TAMPERED = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(nodes: int, fanout: int) -> int:
    """Levels from so many nodes to one."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """Digest of a document, with some of its fields replaced."""
    return F.sha2(F.concat(*(_field(changed.get(name, F.col(name))) for name in FIELDS)), 256)


def placed(rows: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``pos``, from 0 in the order within a group, and ``total``, the rows of the group.

    Rows are dealt by range of (groups, order, a number of their own), so a group of any size,
    of equal rows too, is spread; within a range they are counted where they lie. What is added
    for a group are the counts of the ranges before, a row for each range and group.
    """
    keyed = store(rows.withColumn("_own", F.monotonically_increasing_id()))
    by = [*groups, *order, "_own"]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = store(dealt.withColumns({"_part": F.spark_partition_id(), "_at": at}))
    counts = dealt.groupBy("_part", *groups).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = counts.select(
        F.col("_part").alias("_p"),
        *(F.col(g).alias(f"_g_{g}") for g in groups),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("total"),
    )
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return dealt.join(store(known), same).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "total"
    )


def _blocks(batches) -> Iterator[list[dict]]:
    """Rows of equal (g, block) from sorted batches; a block may cross batches."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["g"], row["block"]) != key:
                if held:
                    yield held
                key, held = (row["g"], row["block"]), []
            held.append(row)
    if held:
        yield held


def _frames(rows: Iterator[tuple], names: Sequence[str], types, size: int = 10_000):
    import pyarrow as pa

    def batch(part):
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*part), types)]
        return pa.RecordBatch.from_arrays(arrays, names)

    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def _levels(nodes: list[str], steps: int, fanout: int) -> list[list[str]]:
    """The nodes and every level above them."""
    levels = [nodes]
    for _ in range(steps):
        below = levels[-1]
        levels.append([digest(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def _siblings(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """Siblings before and after a node and each node above it, upwards."""
    path = []
    for level in levels[:-1]:
        start = at // fanout * fanout
        path.append(("".join(level[start:at]), "".join(level[at + 1 : start + fanout])))
        at //= fanout
    return path


def _fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left, node, right)
    return node


def _text(path: list[tuple[str, str]]) -> str:
    return ",".join(f"{left}|{right}" for left, right in path)


def _path(text: str) -> list[tuple[str, str]]:
    return [tuple(entry.split("|")) for entry in text.split(",")] if text else []


def _steps(total: int, fanout: int, step: int) -> int:
    return min(step, height(total, fanout))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def checkpoints(nodes: DataFrame, fanout: int = FANOUT, step: int = STEP) -> list[DataFrame]:
    """Stored levels of the trees of all groups, every ``step`` levels, from rows (g, pos,
    total, node). A tree leaves the list behind the level that holds its root alone."""
    size = fanout**step

    def up(batches):
        import pyarrow as pa

        def rows():
            for block in _blocks(batches):
                total = block[0]["total"]
                above = _levels([row["node"] for row in block], _steps(total, fanout, step), fanout)
                yield block[0]["g"], block[0]["block"], -(-total // size), above[-1][0]

        yield from _frames(rows(), ["g", "pos", "total", "node"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    levels = [nodes]
    tallest = nodes.agg(F.max("total")).first()[0] or 0
    while tallest > 1:
        below = levels[-1].where("total > 1").select("g", F.expr(f"pos div {size}").alias("block"), "pos", "total", "node")
        levels.append(store(_dealt(below).mapInArrow(up, "g long, pos long, total long, node string")))
        tallest = -(-tallest // size)
    return levels


#: What `proofs` returns of a node: its path as text and what its tree said of itself.
PATH = "g long, pos long, node string, path string, subroot string, root string"


def _told(row: dict, own: list[tuple[str, str]], head: dict) -> tuple:
    path = ",".join(part for part in (_text(own), head["path"]) if part)
    return row["g"], row["pos"], row["node"], path, head["subroot"], head["root"]


def proofs(
    levels: list[DataFrame],
    tops: DataFrame,
    tell=_told,
    columns: str = PATH,
    keep: Sequence[str] = (),
    fanout: int = FANOUT,
    step: int = STEP,
) -> DataFrame:
    """A row for every node of the lowest level: by default its ``path``, the siblings before and
    after it and each node above it, level by level.

    `tops` holds (g, total, path, subroot, root) of every tree: what lies above its root.
    From the highest stored level down, the nodes of each aligned subtree and the path of its
    root meet in one task, which recomputes the levels between, writes the paths of its lower
    nodes and forgets them. `tell` makes the rows of the lowest level, in `columns`, of a node,
    its path in the subtree, and the head of the subtree; `keep` names what else a node has.
    """
    size = fanout**step

    def down(tell, columns):
        names = [column.split()[0] for column in columns.split(", ")]

        def of(batches):
            import pyarrow as pa

            kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

            def rows():
                for head, *block in _blocks(batches):
                    nodes = [row["node"] for row in block]
                    recomputed = _levels(nodes, _steps(block[0]["total"], fanout, step), fanout)
                    for at, row in enumerate(block):
                        yield tell(row, _siblings(recomputed, at, fanout), head)

            yield from _frames(rows(), names, [kinds[column.split()[1]] for column in columns.split(", ")])

        return of

    paths = None
    for at in reversed(range(len(levels))):
        # the trees whose root is all that is left at this level
        done = (F.col("total") <= size**at) & (F.col("total") > (size ** (at - 1) if at else 0))
        heads = tops.where(done).select("g", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        if paths is not None:
            heads = heads.union(paths.select("g", F.col("pos").alias("block"), "path", "subroot", "root"))
        heads = heads.withColumn("pos", F.lit(-1).cast("long"))
        nodes = levels[at].withColumn("block", F.expr(f"pos div {size}"))
        rows = nodes.select("g", "block", "pos", "total", "node", *([] if at else keep))
        rows = _dealt(rows.unionByName(heads, allowMissingColumns=True))
        if at:
            paths = store(rows.mapInArrow(down(_told, PATH), PATH))
        else:
            paths = rows.mapInArrow(down(tell, columns), columns)
    return paths


def manifest(docs: DataFrame, tamper: bool = True, fanout: int = FANOUT, step: int = STEP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    A leaf is the digest of doc_id, source, lang, n_chars and text. The documents of a language
    form a tree in the order of doc_id (null first; rows of one doc_id by their leaf); the roots
    of the languages, null first, form the tree above. Runs of `fanout` nodes become one, also
    a last run that is shorter. The proof of a leaf is folded from what the document holds now,
    which with `tamper` has one more in n_chars where crc32(doc_id) is divisible by
    ``TAMPERED``; a null n_chars or doc_id stays.

    Only every ``step``-th level is stored. Nulls are a field of their own kind, unlike empty
    texts; texts of any length are digested where they are read and do not travel; equal rows
    are leaves of their own; other columns are ignored; an empty table gives no rows. Languages
    may be any number and of any size: no task holds more than a subtree.
    """
    number = F.col("n_chars") + 1
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    now = F.when(bad & F.col("n_chars").isNotNull(), leaf_of(n_chars=number)) if tamper else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_of().alias("node"), now.alias("now"))
    rows = store(placed(rows, ["lang"], ["doc_id", "node"]))
    langs = rows.groupBy("lang").agg(F.max("total").alias("documents"))
    langs = store(placed(langs, [], ["lang"]).select(F.col("lang").alias("_lang"), "documents", "total", F.col("pos").alias("g")))
    leaves = rows.join(langs.select("_lang", "g"), F.col("lang").eqNullSafe(F.col("_lang")))
    levels = checkpoints(store(leaves.select("g", "pos", "total", "node", "doc_id", "now")), fanout, step)

    # the tree of the languages, whose leaves are the roots below
    roots = reduce(DataFrame.union, (level.where("total = 1").select("g", "node") for level in levels))
    above = roots.join(langs, "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), "total", "node")
    upper = checkpoints(store(above), fanout, step)
    root = upper[-1].where("total = 1").select("g", F.lit("").alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    tops = proofs(upper, upper[0].groupBy("g").agg(F.max("total").alias("total")).join(root, "g"), fanout=fanout, step=step)
    tops = tops.select(F.col("pos").alias("g"), "path", F.col("node").alias("subroot"), "root")
    tops = store(tops.join(langs.select("g", F.col("documents").alias("total")), "g"))

    def checked(row, own, head):
        path, above = own, _path(head["path"])
        proof = digest(*(part for pair in (*path, *above) for part in pair))
        folded = _fold(_fold(row["now"] or row["node"], path), above)
        return row["doc_id"], row["node"], head["subroot"], head["root"], proof, folded, folded == head["root"]

    columns = (
        "doc_id long, leaf string, subroot string, root string, "
        "proof_sha256 string, folded_root string, verified boolean"
    )
    return proofs(levels, tops, checked, columns, ["doc_id", "now"], fanout, step)
