"""Secret scan by a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, whole


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read by Java; ``group`` must have ``least`` characters. ``fold``: its
    letters match in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.fold else "") + self.pattern


# The formats searched for.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, group=2, least=8, fold=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    # maximal runs of 32 or more are the runs of any length that have 32 or more
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"ghp_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Ways to match beyond which a part of a pattern counts as anything.
MOST_WAYS = 64
#: Hits of a text that are placed together.
BLOCK = 256
_GAP = "\n\n"


def _ways(node) -> list[str]:
    """The strings that a parsed pattern can match, a gap where it may be anything."""
    from re import _constants as c

    found = [""]
    for op, value in node:
        if op is c.LITERAL:
            ways = [chr(value)]
        elif op is c.SUBPATTERN:
            ways = _ways(value[-1])
        elif op is c.BRANCH:
            ways = [w for part in value[1] for w in _ways(part)]
        elif op is c.MAX_REPEAT and value[:2] == (0, 1):
            ways = ["", *_ways(value[2])]
        elif op is c.MAX_REPEAT and value[0] >= 1:
            ways = [_GAP + w + _GAP for w in _ways(value[2])]
        else:
            ways = [_GAP]
        if len(ways) * len(found) > MOST_WAYS:
            ways = [_GAP]
        found = [a + b for a, b in product(found, ways)]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The trigrams of a match, in lower case: an OR of ANDs. None if a match needs none."""
    clauses = set()
    for way in _ways(re._parser.parse(pattern)):
        runs = [r.lower() for r in way.split("\n")]
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return None
        clauses.add(grams)
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, text_key) of the given trigrams over whole texts, in lower case,
    stored sorted by trigram so that a query reads only its own. The key is a hash of the
    text: equal texts share postings, and a clash only makes a candidate too many."""
    # a step of its own: otherwise each trigram would fold the text anew
    folded = docs.select(F.xxhash64("text").alias("text_key"), F.lower(whole(F.col("text"))).alias("folded"))
    there = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams]))
    rows = folded.select("text_key", F.explode(there).alias("trigram"))
    return store(rows.sortWithinPartitions("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(text_key, kinds): the rules whose trigram query a text meets; texts with none are left out."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    wanted = sorted({t for q in queries.values() for clause in q for t in clause})
    texts = index.where(F.col("trigram").isin(wanted)).groupBy("text_key").agg(F.collect_set("trigram").alias("has"))

    def meets(query):
        every = [F.size(F.array_except(F.array(*map(F.lit, sorted(c))), F.col("has"))) == 0 for c in query]
        return every[0] if len(every) == 1 else F.exists(F.array(*every), lambda x: x)

    kinds = F.array_compact(F.array(*[F.when(meets(q), F.lit(kind)) for kind, q in queries.items()]))
    return texts.select("text_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost matches that do not overlap, as (start, order, end, kind) in characters: the
    places follow from the lengths of the matches and of what lies between."""
    found = F.arrays_zip(
        F.split(text, rule.java, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)).alias("part"),
    )
    span = "struct<start:int,order:int,end:int,kind:string>"
    state = lambda at, out, type_: F.struct(at.alias("at"), F.coalesce(out, F.array().cast(type_)).alias("out"))
    start = lambda acc, x: acc["at"] + F.char_length(x["gap"])

    def step(acc, x):
        end = start(acc, x) + F.char_length(x["hit"])
        own = F.struct(start(acc, x).alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        ok = F.char_length(x["part"]) >= rule.least
        out = F.when(ok, F.concat(acc["out"], F.array(own))).otherwise(acc["out"])
        more = F.struct(end.alias("at"), out.alias("out"))
        return F.when(x["hit"].isNull(), acc).otherwise(more)

    def leap(acc, block):
        inner = F.aggregate(block, state(acc["at"], F.lit(None), f"array<{span}>"), step)
        both = lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out"))
        return F.transform(F.array(inner), both)[0]

    # an array that grows hit by hit is copied for each: blocks of hits keep such arrays short
    n_blocks = lambda hits: F.ceil(F.size(hits) / BLOCK).cast("int")
    cut = lambda hits: F.transform(F.sequence(F.lit(1), n_blocks(hits)), lambda b: F.slice(hits, (b - 1) * BLOCK + 1, F.lit(BLOCK)))
    blocks = F.transform(F.array(found), cut)[0]
    return F.aggregate(blocks, state(F.lit(0), F.lit(None), f"array<array<{span}>>"), leap, lambda acc: F.flatten(acc["out"]))


def _text_of(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Secrets in every whole text of ``docs``: doc_id, spans (array of start, order, end, kind
    by start, then rule; characters, end exclusive).

    Each rule's pattern gives a Boolean query of the trigrams that any match holds. Postings
    of these are intersected, and only texts that meet a rule's query are searched by its
    pattern; rules without mandatory trigrams search every text. A null text is empty and
    has no spans, null and repeated doc_ids keep their rows, other columns are ignored, an
    empty table gives no rows.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() if q for clause in q for t in clause})
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"), F.xxhash64("text").alias("text_key"))
    if trigrams:
        rows = rows.join(store(candidates(build_index(docs, trigrams), rules)), "text_key", "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    parts = []
    for i, rule in enumerate(rules):
        may = F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), rule.kind) if queries[rule.kind] else F.lit(True)
        may = may & F.col("text").rlike(rule.java)
        parts.append(F.when(may, _spans(F.col("text"), rule, i)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, all spans as text."""
    base = [r.kind for r in rules if r.base]
    spans = F.col("spans")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter(spans, lambda s: s["order"] < len(base))
    return scan_secrets(docs, rules).select(
        "doc_id", *map(count, base), F.sha2(_text_of(own).cast("binary"), 256).alias("base_sha256"), _text_of(spans).alias("spans")
    )
