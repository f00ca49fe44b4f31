"""Plain, slow versions of the operators on Python lists."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from xxhash import xxh64_intdigest


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def simhash_components(texts):
    """Component, as the smallest position, of each text."""
    fps = [fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    return component_of(len(texts), links)


def shingles(text, n=5):
    w = words(text)
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} - {""}


def matches(docs, items, contained=0.8):
    """(doc_id, item_id) of every item that a document holds; an item of fewer than five words
    is looked for among the runs of as many words."""
    sets = [(i, shingles(t), min(5, len(words(t)))) for i, t in items]
    found = Counter()
    for doc_id, text in docs:
        runs = {n: shingles(text, n) for n in {n for _, _, n in sets} - {0}}
        for item, s, n in sets:
            if s and len(s & runs[n]) >= contained * len(s) - 1e-9:
                found[doc_id, item] += 1
    return found


def text_grams(text, orders=3):
    run = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    out = Counter()
    for n in range(1, orders + 1):
        for i in range(len(run) - n + 1):
            g = run[i : i + n]
            if g.strip() and " " not in g[1:-1] and not (n == 1 and g == " "):
                out[g] += 1
    return out


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | (1 if c == " " else ord(c))
    return value


def top(counts, ranks=300):
    order = sorted(counts, key=lambda g: (-counts[g], code(g)))
    return {g: i + 1 for i, g in enumerate(order[:ranks])}


def language_profiles(docs, ranks=300):
    counts = defaultdict(Counter)
    for text, lang in docs:
        counts[lang].update(text_grams(text))
    return {lang: top(c, ranks) for lang, c in counts.items()}


def language(text, profiles, ranks=300):
    own = top(text_grams(text or ""), ranks)
    if not own or not profiles:
        return "und", 0.0
    cost = {
        lang: sum(abs(p[g] - at) if g in p else ranks for g, at in own.items()) for lang, p in profiles.items()
    }
    best = min(sorted(cost), key=cost.get)
    return best, 1 - cost[best] / (len(own) * ranks)


def damaged(rows):
    """Rows (conv_id, turn, role, text) with planted faults, in the order given."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2 and text is not None:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _edits(rows):
    """(cost, audit, lines) by a DP on whole strings, from the last row to the first."""
    keep = {("s", "-"): "s", ("u", "-"): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}
    after = {state: (0, "", ()) if state in "-a" else (10**9, "", ()) for state in "-sua"}

    def inserted(best):
        for _ in range(2):
            for state in "-sua":
                to = "a" if state == "u" else "u"
                cost, audit, lines = best[to]
                best[state] = min(best[state], (cost + 5, "I" + audit, (("assistant:" if to == "a" else "user:"), *lines)))
        return best

    best = inserted(after)
    for role, text, fault in reversed(rows):
        new = {}
        for state in "-sua":
            to = "a" if state == "u" else "u"
            ways = [(best[state][0] + 2, "D" + best[state][1], best[state][2])]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                kept = keep.get(((role or "")[:1], state))
                if kept:
                    ways.append((best[kept][0] + more, "K" + best[kept][1], (f"{role}:{text}", *best[kept][2])))
                name = "assistant" if to == "a" else "user"
                ways.append((best[to][0] + 1 + more, "R" + best[to][1], (f"{name}:{text}", *best[to][2])))
            new[state] = min(ways)
        best = inserted(new)
    return best["-"]


def repaired_conversations(rows):
    """Report of every conversation; rows of one turn keep their order."""
    by = {conv: [] for conv, *_ in rows}
    for row in damaged(rows):
        by[row[0]].append(row[1:])
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        faults, seen = [], set()
        for _, role, text in own:
            plain = (text or "").strip(" \t\n\v\f\r")
            fault = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        first = [(r or "")[:1] for _, r, _ in own]
        cost, audit, lines = _edits(faults)
        count = Counter(f for _, _, f in faults)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return out


def _digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _document(*fields):
    return _digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_digest(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def _way_up(levels, i, fanout):
    way = []
    for level in levels[:-1]:
        start = i // fanout * fanout
        way.append(("".join(level[start:i]), "".join(level[i + 1 : start + fanout])))
        i //= fanout
    return way


def manifest(rows, fanout=2):
    """Rows of the manifest of (doc_id, text, lang, source, n_chars)."""
    by = defaultdict(list)
    for doc, text, lang, source, n in rows:
        leaf = now = _document(doc, source, lang, n, text)
        if doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0:
            now = _document(doc, source, lang, n + 1, text)
        by[lang].append((doc is not None, doc or 0, leaf, now, doc))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: _tree([r[2] for r in sorted(by[lang])], fanout) for lang in langs}
    top = _tree([trees[lang][-1][0] for lang in langs], fanout)
    out = []
    for g, lang in enumerate(langs):
        for i, (_, _, leaf, node, doc) in enumerate(sorted(by[lang])):
            way = _way_up(trees[lang], i, fanout) + _way_up(top, g, fanout)
            for left, right in way:
                node = _digest(left, node, right)
            proof = _digest(*(part for pair in way for part in pair))
            out.append((doc, leaf, trees[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def without_repeats(rows, edge=50):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text), window by window."""
    texts = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in rows]
    least = {}
    for doc, w in texts:
        for i in range(len(w) - edge + 1 if doc is not None else 0):
            window = tuple(w[i : i + edge])
            least[window] = min(least.get(window, doc), doc)
    out = []
    for doc, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - edge + 1 if doc is not None else 0):
            if least[tuple(w[i : i + edge])] < doc:
                gone[i : i + edge] = [True] * edge
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
