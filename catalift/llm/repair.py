"""Repair of conversation structure: the cheapest edits, the least audit of them by a DP over shared edit prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: Rows, and bytes of text, after which a conversation is cut into a further segment.
SEGMENT_ROWS = 1_024
SEGMENT_BYTES = 1 << 20

#: What an edit costs; a truncated row that stays adds the last.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of what is kept so far: nothing, a system row, a user row last, an assistant row last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row leads that is kept, by its initial and the state before.
KEEP = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: Where an inserted or reroled row leads; its role is the name of that state.
NEXT = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: A repaired conversation may end in these.
ENDS = (NOTHING, ASSISTANT)

_SPACE = " \t\n\v\f\r"
_PRIME = (1 << 61) - 1


class Audits:
    """Strings that share their beginnings: a node is a letter behind another node.

    Each node knows its ancestors at distances 1, 2, 4 and so on, and a rolling hash of its
    whole string, so that the longest common prefix of two strings is found in logarithmic
    steps. What the hashes call equal is compared letter by letter; pairs found equal are
    remembered, so that no letter is compared twice.
    """

    def __init__(self, base: int = 1_000_003, modulus: int = _PRIME):
        self.base, self.modulus = base, modulus
        self.letter, self.depth, self.hash, self.up, self.same = [""], [0], [0], [()], [0]

    def add(self, node: int, letter: str) -> int:
        new = len(self.letter)
        ups, at, k = [node], node, 0
        while len(self.up[at]) > k:
            at = self.up[at][k]
            ups.append(at)
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % self.modulus)
        self.up.append(tuple(ups))
        self.same.append(new)
        return new

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def _ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            k = min((self.depth[node] - depth).bit_length(), len(self.up[node])) - 1
            node = self.up[node][k]
        return node

    def _class(self, node: int) -> int:
        while self.same[node] != node:
            self.same[node] = node = self.same[self.same[node]]
        return node

    def _first_difference(self, a: int, b: int) -> tuple[int, int] | None:
        """Nodes of one depth: the uppermost pair of their ancestors whose letters differ."""
        found, walked = None, []
        while self._class(a) != self._class(b):
            if self.letter[a] != self.letter[b]:
                found, walked = (a, b), []
            else:
                walked.append((a, b))
            a, b = self.up[a][0], self.up[b][0]
        for x, y in walked if found is None else ():
            self.same[self._class(x)] = self._class(y)
        return found

    def compare(self, a: int, b: int) -> int:
        """Below 0, 0 or above 0 as the first string is less, equal or greater."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._ancestor(a, depth), self._ancestor(b, depth)
        order = self.depth[a] - self.depth[b]
        if self.hash[x] != self.hash[y]:
            # down from the root the hashes agree up to the parents of x and y
            for k in reversed(range(len(self.up[x]))):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            order = (self.letter[x] > self.letter[y]) - (self.letter[x] < self.letter[y])
            x, y = self.up[x][0], self.up[y][0]
        wrong = self._first_difference(x, y)
        if wrong:
            x, y = wrong
            order = (self.letter[x] > self.letter[y]) - (self.letter[x] < self.letter[y])
        return order


def cheapest(rows: Iterable[tuple[str, bool, bool]], starts: Iterable[int] = (NOTHING,), audits=Audits) -> dict:
    """{(start, end): (cost, audit)} of the cheapest edits of rows (initial, must go, truncated).

    Of equal cost the least audit counts. It may be chosen state by state: of two audits of the
    same rows, state and cost neither is a beginning of the other, as what follows it could
    only be inserts, which cost.
    """
    rows, found = list(rows), {}
    for start in starts:
        tree = audits()

        def best(ways):
            ways = [way for way in ways if way is not None]
            if not ways:
                return None
            cost = min(way[0] for way in ways)
            ways = [way for way in ways if way[0] == cost]
            nodes = [tree.add(node, letter) if letter else node for _, node, letter in ways]
            least = nodes[0]
            for node in nodes[1:]:
                if tree.compare(node, least) < 0:
                    least = node
            return cost, least, ""

        def inserted(way):
            """The states after any inserts."""
            more = [(way[s][0] + INSERT, way[s][1], "I") for s in (NOTHING, SYSTEM, ASSISTANT) if way[s]]
            user = best([way[USER], *more])
            more = (user[0] + INSERT, user[1], "I") if user else None
            return [way[NOTHING], way[SYSTEM], user, best([way[ASSISTANT], more])]

        at = [None] * 4
        at[start] = (0, 0, "")
        at = inserted(at)
        for initial, must_go, cut in rows:
            ways = [[], [], [], []]
            for state, way in enumerate(at):
                if way is None:
                    continue
                cost, node, _ = way
                ways[state].append((cost + DELETE, node, "D"))
                if must_go:
                    continue
                if cut:
                    cost += TRUNCATED
                to = KEEP.get((initial, state))
                if to is not None:
                    ways[to].append((cost, node, "K"))
                if NEXT[state] != to:
                    ways[NEXT[state]].append((cost + REROLE, node, "R"))
            at = inserted([best(way) for way in ways])
        for end, way in enumerate(at):
            if way is not None:
                found[start, end] = (way[0], tree.text(way[1]))
    return found


def repaired(audit: str, rows: Iterable[tuple[str | None, str | None]], state: int = NOTHING) -> Iterator[str]:
    """Lines ``role:text`` that an audit leaves of rows (role, text)."""
    rows = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "K":
            state = KEEP[role[:1], state]
            yield f"{role}:{text}"
        elif letter != "D":
            state = NEXT[state]
            yield f"{ROLE[state]}:{text}"


def is_blank(text: str | None) -> bool:
    return not (text or "").strip(_SPACE)


def is_truncated(text: str | None) -> bool:
    return not (text or "").rstrip(_SPACE).endswith((".", "!", "?"))


class _Segment:
    """Rows of one conversation that follow each other, and what is known of them."""

    def __init__(self, conv, first: bool):
        self.conv, self.first, self.rows, self.edits, self.size = conv, first, [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn, role, text, seen: bool) -> None:
        initial = (role or "")[:1]
        blank = is_blank(text)
        seen = seen and not blank
        cut = not blank and not seen and is_truncated(text)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + seen, self.truncated + cut
        if self.rows:
            self.illegal += self.edits[-1][0] + initial not in LEGAL
        if turn is not None and turn != self.high:
            # turns ascend
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.rows.append((role, text))
        self.edits.append((initial, blank or seen, cut))
        self.size += len(text or "") + len(role or "")

    def facts(self) -> tuple:
        return self.low, self.high, self.turns, self.blank, self.duplicate, self.truncated, self.illegal


#: Initials that may follow each other.
LEGAL = ("su", "ua", "au")
_FACTS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")
_OPEN = ("first", "last", "ways", "roles", "texts")


def _segments(batches) -> Iterator[tuple[_Segment, bool]]:
    """Segments of sorted rows, and whether their conversation is known to end with them."""
    held, started = None, False
    for batch in batches:
        for row in batch.to_pylist():
            if held is not None and held.conv != row["conv_id"]:
                yield held, True
                held, started = None, True
            for copy in range(row["copies"]):
                if held is not None and (len(held.rows) >= SEGMENT_ROWS or held.size >= SEGMENT_BYTES):
                    yield held, False
                    held = _Segment(row["conv_id"], False)
                if held is None:
                    held = _Segment(row["conv_id"], started)
                held.add(row["turn"], row["role"], row["text"], row["seen"] or copy > 0)
    if held is not None:
        yield held, False


def _batches(rows: Iterable[tuple], names, types, size: int = 500):
    import pyarrow as pa

    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _cut(batches):
    """Whole conversations repaired; the others as segments with their ways from state to state."""
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    kind = None

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            yield batch

    def rows():
        for no, (segment, ends) in enumerate(_segments(typed())):
            whole = segment.first and ends
            ways = cheapest(segment.edits, (NOTHING,) if segment.first else range(4))
            head = (segment.conv, whole, part, no, *segment.facts())
            if whole:
                cost, audit = min(ways[NOTHING, end] for end in ENDS if (NOTHING, end) in ways)
                digest = sha256("\n".join(repaired(audit, segment.rows)).encode()).hexdigest()
                yield (*head, None, None, None, None, None, cost, audit, digest)
            else:
                ways = [{"start": s, "end": e, "cost": c, "audit": a} for (s, e), (c, a) in ways.items()]
                roles, texts = ([row[i] for row in segment.rows] for i in (0, 1))
                yield (*head, segment.edits[0][0], segment.edits[-1][0], ways, roles, texts, None, None, None)

    first = next(produced := rows(), None)
    if first is None:
        return
    way = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    names = ["conv_id", "whole", "part", "no", *_FACTS, *_OPEN, "cost", "audit", "repaired_sha256"]
    types = [kind, pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(way)]
    types += [pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string()]

    def all_rows():
        yield first
        yield from produced

    yield from _batches(all_rows(), names, types)


def _conversations(batches) -> Iterator[list[dict]]:
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != key:
                yield held
                held = []
            key = row["conv_id"]
            held.append(row)
    if held:
        yield held


def _beginning(a: str, b: str) -> int | str:
    """-1 or 1 if the order of two strings is settled whatever follows, else what b has more
    than a, or a more than b behind a minus sign."""
    if b.startswith(a):
        return "+" + b[len(a) :]
    if a.startswith(b):
        return "-" + a[len(b) :]
    return -1 if a < b else 1


def _behind(known: int | str, a: str, b: str) -> int | str:
    """The order of two strings of a known order with a and b behind them."""
    if isinstance(known, int):
        return known
    return _beginning(a, known[1:] + b) if known[0] == "+" else _beginning(known[1:] + a, b)


def joined(segments: list[dict]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and the state before and the audit of each segment, of the cheapest edits of a
    conversation in segments.

    Four states are carried from segment to segment. Of two of them it is known which audit is
    less, or what one has more than the other, so no more than a segment's letters are compared.
    """
    at, order, back = {NOTHING: 0}, {}, []

    def ordered(s, a, t, b):
        return _beginning(a, b) if s == t else _behind(order[s, t], a, b)

    for segment in segments:
        ways: dict[int, tuple] = {}
        for way in segment["ways"]:
            s, e = way["start"], way["end"]
            if s not in at:
                continue
            new = (at[s] + way["cost"], s, way["audit"])
            old = ways.get(e)
            if old is None or new[0] < old[0]:
                ways[e] = new
            elif new[0] == old[0]:
                sign = ordered(new[1], new[2], old[1], old[2])
                if sign == -1 or (isinstance(sign, str) and sign[0] == "+" and len(sign) > 1):
                    ways[e] = new
        order = {
            (e, f): ordered(ways[e][1], ways[e][2], ways[f][1], ways[f][2]) for e in ways for f in ways if e != f
        }
        at = {e: way[0] for e, way in ways.items()}
        back.append(ways)
    least = min(at[e] for e in ENDS if e in at)
    ends = [e for e in ENDS if at.get(e) == least]
    end = ends[0]
    if len(ends) == 2:
        sign = order[ends[0], ends[1]]
        if sign == 1 or (isinstance(sign, str) and sign[0] == "-" and len(sign) > 1):
            end = ends[1]
    pieces = []
    for ways in reversed(back):
        _, start, audit = ways[end]
        pieces.append((start, audit))
        end = start
    return least, pieces[::-1]


def _join(batches):
    """What is known of a conversation in segments as a row, and the audit of each segment."""
    import pyarrow as pa

    kind = None

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            yield batch

    def rows():
        for segments in _conversations(typed()):
            cost, pieces = joined(segments)
            for segment, (start, audit) in zip(segments, pieces):
                yield segment["conv_id"], segment["part"], segment["no"], start, audit, *[None] * 8
            lows = [s["low"] for s in segments if s["low"] is not None]
            highs = [s["high"] for s in segments if s["high"] is not None]
            turns = sum(s["turns"] for s in segments)
            illegal = sum(s["illegal"] for s in segments)
            last = None
            for before, segment in zip([None, *segments], segments):
                if before is not None:
                    illegal += before["last"] + segment["first"] not in LEGAL
                if segment["low"] is not None:
                    turns -= segment["low"] == last
                    last = segment["high"]
            counts = (sum(s[name] for s in segments) for name in ("blank", "duplicate", "truncated"))
            low, high = (min(lows), max(highs)) if lows else (None, None)
            yield segments[0]["conv_id"], None, None, None, "".join(a for _, a in pieces), low, high, turns, *counts, illegal, cost

    first = next(produced := rows(), None)
    if first is None:
        return
    names = ["conv_id", "part", "no", "start", "audit", *_FACTS, "cost"]
    types = [kind, pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 8]

    def all_rows():
        yield first
        yield from produced

    yield from _batches(all_rows(), names, types, 50)


def _lines(batches):
    """The repaired lines of each segment, a newline before each."""
    import pyarrow as pa

    for batch in batches:
        blobs = []
        for row in batch.to_pylist():
            lines = repaired(row["audit"], zip(row["roles"], row["texts"]), row["start"])
            blobs.append("".join(f"\n{line}" for line in lines))
        columns = [batch.column(n) for n in ("conv_id", "part", "no")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.string())], ["conv_id", "part", "no", "lines"])


def _digests(batches):
    """The digest of each conversation's lines, which pass one after the other."""
    import pyarrow as pa

    key, digest, begun, kind = None, None, False, None
    done = []
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if digest is not None and row["conv_id"] != key:
                done.append((key, digest.hexdigest()))
                digest = None
            if digest is None:
                key, digest, begun = row["conv_id"], sha256(), False
            lines = row["lines"]
            if lines:
                digest.update((lines if begun else lines[1:]).encode())
                begun = True
    if digest is not None:
        done.append((key, digest.hexdigest()))
    yield from _batches(done, ["conv_id", "repaired_sha256"], [kind, pa.string()])


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    same = a[names[0]].eqNullSafe(b[names[0]])
    for name in names[1:]:
        same &= a[name].eqNullSafe(b[name])
    return same


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` (a null is one space) modulo 20:
    0 goes, 1 loses its text, 2 its full stops, 3 comes twice (``copies``), 4 becomes the user's."""
    conv, turn = (F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    kind = F.crc32(key.cast("binary")) % 20
    return rows.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every
    conversation in rows (conv_id, turn, role, text and, if there, how many copies).

    Rows of a conversation are taken by turn, nulls first; of one turn by the beginnings of role
    and text, then by their digest. Equal rows follow each other. A row without a word is
    blank; one whose role and text came earlier is a duplicate; one that does not end in a full
    stop, question or exclamation mark is truncated. The repair has the roles system once at
    most, then user and assistant in turn; roles count by their first letter, a null role has
    none. An audit holds a letter for each edit: Keep, Rerole, Delete, Insert.

    Rows are dealt by range of conversation and turn, so a conversation of any length is cut:
    each segment's cheapest ways between states are found where it lies, and only what is left
    of those conversations that cross a range, or are long, is joined. The digest of such a one
    needs its lines in a row; they pass through a task in blocks and are not held.

    Null texts are blank; long texts are a segment of their own; null conv_ids are one
    conversation; other columns are ignored; an empty table gives no rows.
    """
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    said = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in ("role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copies")
    rows = rows.withColumns({"own": F.monotonically_increasing_id(), "key": F.sha2(F.concat(*said), 256)})
    rows = store(rows)
    # where equal rows of a conversation come first
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn", "own")
    often = rows.groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.min(place).alias("earliest"))
    often = store(often.where("n > 1").drop("n"))
    marked = rows.join(often, _same(rows, often, "conv_id", "key"), "left").select(
        *(rows[c] for c in ("conv_id", "turn", "role", "text", "copies", "own", "key")),
        F.coalesce(F.col("earliest.own") != F.col("own"), F.lit(False)).alias("seen"),
    )
    marked = store(marked)
    by = ["conv_id", "turn", F.substring("role", 1, 20), F.substring("text", 1, 100), "key", "own"]
    dealt = marked.repartitionByRange(*by).sortWithinPartitions(*by)
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    facts = ", ".join(f"{name} long" for name in _FACTS)
    cut = store(
        dealt.select("conv_id", "turn", "role", "text", "copies", "seen").mapInArrow(
            _cut,
            f"{conv}, whole boolean, part int, no int, {facts}, first string, last string, "
            "ways array<struct<start: int, end: int, cost: long, audit: string>>, roles array<string>, "
            "texts array<string>, cost long, audit string, repaired_sha256 string",
        )
    )
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    columns = ["conv_id", gaps.alias("gaps"), *_FACTS[3:], "cost", "audit", "repaired_sha256"]
    whole = cut.where("whole").select(*columns)

    pieces = cut.where("not whole")
    ordered = lambda frame: frame.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    linked = store(
        ordered(pieces.select("conv_id", "part", "no", *_FACTS, "first", "last", "ways")).mapInArrow(
            _join, f"{conv}, part int, no int, start int, audit string, {facts}, cost long"
        )
    )
    chosen = linked.where("part IS NOT NULL").select("part", "no", "start", "audit")
    lines = pieces.select("conv_id", "part", "no", "roles", "texts").join(chosen, ["part", "no"])
    lines = store(lines.select("conv_id", "part", "no", "roles", "texts", "start", "audit").mapInArrow(_lines, f"{conv}, part int, no int, lines string"))
    digests = ordered(lines).mapInArrow(_digests, f"{conv}, repaired_sha256 string")
    known = linked.where("part IS NULL").drop("part", "no", "start")
    rest = known.join(digests, _same(known, digests, "conv_id")).drop(digests["conv_id"]).select(*columns)
    return whole.unionByName(rest)


def repair_report(conversations: DataFrame) -> DataFrame:
    """`repair` of the damaged rows, a row for every conversation of the undamaged ones: one that
    lost all rows has zeros, an empty audit and the digest of nothing."""
    names = conversations.select("conv_id").distinct()
    found = store(repair(damage(conversations)))
    joined = names.join(found, _same(names, found, "conv_id"), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        names["conv_id"],
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
