"""SQL that gives the rows of the queries in another way, on the same tables."""

WORD = r"[^\x20\x09-\x0D]+"

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS v, vec_id AS c FROM v
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.v
), c AS (
  SELECT v, min(c) AS c FROM r GROUP BY v
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.v = v.vec_id
"""

# kind, pattern, group, least length; keywords match in either case
_KINDS = (
    (
        "assign",
        "((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
    ("github", "ghp_[A-Za-z0-9]{36}", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)


def _spans(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""list_filter(list_transform(
      list_zip(string_split_regex(t, '{pattern}'), regexp_extract_all(t, '{pattern}', 0), regexp_extract_all(t, '{pattern}', {group})),
      lambda z, i: {{
        's': list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda g: length(g)))
          + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}', 0)[1:i - 1], lambda h: length(h))), 0),
        'o': {order}, 'n': length(z[2]), 'k': '{kind}', 'p': length(z[3])}}), lambda x: x.n IS NOT NULL AND x.p >= {least})"""


OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT doc_id, list_sort(list_concat({", ".join(_spans(i, *k) for i, k in enumerate(_KINDS))})) AS spans FROM d
)
SELECT doc_id,
  len(list_filter(spans, lambda x: x.k = 'assign')) AS n_assign,
  len(list_filter(spans, lambda x: x.k = 'access')) AS n_access,
  len(list_filter(spans, lambda x: x.k = 'hex')) AS n_hex,
  sha256(array_to_string(list_transform(list_filter(spans, lambda x: x.o < 3),
    lambda x: x.k || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT), ',')) AS base_sha256,
  array_to_string(list_transform(spans, lambda x: x.k || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT), ',') AS spans
FROM s
"""

OP4 = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'b', item_id, list_filter(string_split_regex(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')
  FROM benchmark WHERE text IS NOT NULL
), k AS (
  SELECT DISTINCT least(len(words), 5) AS k FROM w WHERE side = 'b' AND len(words) > 0
), s AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS shingle
  FROM w JOIN k ON k <= len(words) AND (side = 'd' OR k = least(len(words), 5))
), n AS (
  SELECT id AS item_id, count(*) AS shingles FROM s WHERE side = 'b' GROUP BY id
), m AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared
  FROM s d JOIN s b ON d.shingle = b.shingle AND d.side = 'd' AND b.side = 'b' GROUP BY d.id, b.id
)
SELECT doc_id, item_id, shared, shingles, shared / shingles AS containment
FROM m JOIN n USING (item_id) WHERE shared >= 0.8 * shingles
"""

OP6 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), m AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h,
    length(line) >= 99 AND len(regexp_extract_all(line, '{WORD}')) >= 50 AS is_long
  FROM l
), e AS (
  SELECT *, (lag(h, 1, 0) OVER w * 31 + h) % 3 = 0 OR is_long OR coalesce(lead(is_long) OVER w, true) AS stop
  FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), n AS (
  SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no
  FROM e
), c AS (
  SELECT doc_id, no, count(*) AS lines, bool_or(is_long) AS is_long, string_agg(line, chr(10) ORDER BY i) AS txt
  FROM n GROUP BY doc_id, no
), r AS (
  SELECT *, (lines > 1 OR is_long) AND row_number() OVER (PARTITION BY (lines > 1 OR is_long), txt ORDER BY doc_id, no) > 1 AS gone
  FROM c
), g AS (
  SELECT doc_id, string_agg(txt, chr(10) ORDER BY no) FILTER (NOT gone) AS kept, sum(lines)::BIGINT AS n_lines,
    coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS removed_lines, count(*) FILTER (gone) AS removed_chunks
  FROM r GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.kept, '') END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_chunks, 0) AS removed_chunks
FROM documents d LEFT JOIN g USING (doc_id)
"""

OP9 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages
), first AS (
  SELECT d, n, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d, n
)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first.first <> p.page_id THEN first.first END AS refers_to
FROM p LEFT JOIN first ON p.d = first.d AND p.n = first.n
"""

_FILL = """, c@ AS (
  SELECT *, sum(size) FILTER (size <= gap AND place > last) OVER (PARTITION BY source ORDER BY place) AS cum FROM k@
), g@ AS (
  SELECT *, coalesce(size <= gap AND place > last AND cum <= gap, false) AS now FROM c@
), k# AS (
  SELECT * EXCLUDE (cum, now) REPLACE (
    CASE WHEN now THEN 1 ELSE fill END AS fill,
    gap - coalesce(max(cum) FILTER (now) OVER (PARTITION BY source), 0) AS gap,
    coalesce(max(place) FILTER (now) OVER (PARTITION BY source), last) AS last
  ) FROM g@
)"""

OP10 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(text, '')), 1, 13))::BIGINT AS tie
  FROM documents
), m AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, tie) - 1 AS number FROM d
), r AS (
  SELECT *, ('0x' || substr(md5(concat('17|', coalesce(doc_id::VARCHAR, 'null'), '|', tie, '|', number)), 1, 13))::BIGINT AS draw FROM m
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM s
), u AS (
  -- the unit if the sources before this one are at their ceiling
  SELECT a.k, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
      - coalesce(sum(b.cap) FILTER (b.k < a.k), 0)) / (sum(b.w) FILTER (b.k >= a.k)) AS unit
  FROM o a, o b GROUP BY a.k
), unit AS (
  SELECT u.unit FROM u JOIN o USING (k) WHERE o.w * u.unit <= o.cap ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least(w * (SELECT unit FROM unit), cap) AS target FROM o
), p AS (
  SELECT source, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS copies
  FROM t
), q AS (
  -- limits of sizes: the least that the remainder can be met with
  SELECT source, copies, rest, lim, sum(least(size, lim))::BIGINT AS limited
  FROM (
    SELECT p.*, d.size, ceil(rest * (pow(2, j) / 128))::BIGINT AS lim
    FROM (SELECT *, target - copies * source_size AS rest FROM p) p
    JOIN d ON d.source IS NOT DISTINCT FROM p.source, range(8) g(j) WHERE rest > 0
  ) GROUP BY ALL HAVING limited >= rest
), l AS (
  SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY source ORDER BY lim) = 1
), i AS (
  SELECT r.*, l.rest,
    CASE WHEN size > lim THEN rest / limited * (lim::DOUBLE / size) ELSE rest / limited END AS inclusion,
    (draw + 0.5::DOUBLE) / (4503599627370496::DOUBLE - (draw + 0.5::DOUBLE)) AS odds
  FROM r JOIN l ON r.source IS NOT DISTINCT FROM l.source
), k0 AS (
  SELECT *, rest AS gap, 0 AS fill, row_number() OVER (PARTITION BY source ORDER BY
    CASE WHEN inclusion < 1 THEN odds / (inclusion / (1 - inclusion)) ELSE 0 END, draw, tie, number, doc_id NULLS FIRST) AS place,
    0::BIGINT AS last
  FROM i
){"".join(_FILL.replace("@", str(n)).replace("#", str(n + 1)) for n in range(3))}, b AS (
  SELECT source, place FROM k3 WHERE fill = 0 AND abs(size - gap) < gap
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), place) = 1
), e AS (
  SELECT doc_id, source, tie, number, 1 AS more FROM k3 WHERE fill = 1 OR (coalesce(source, ''), source IS NULL, place) IN (SELECT (coalesce(source, ''), source IS NULL, place) FROM b)
)
SELECT r.doc_id, r.size, p.source_size, p.target, (r.size * (p.copies + coalesce(e.more, 0)))::BIGINT AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
LEFT JOIN e ON r.doc_id IS NOT DISTINCT FROM e.doc_id AND r.source IS NOT DISTINCT FROM e.source AND r.tie = e.tie AND r.number = e.number
"""

# a reflected CRC by bits: each byte is mixed in, then eight steps
_CRC = """xor(list_reduce(flatten(list_transform(range(1, length(k) + 1), lambda i:
    list_prepend(ascii(k[i])::BIGINT, list_transform(range(8), lambda j: -1::BIGINT)))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS other, doc_id::VARCHAR AS k, n_chars FROM documents
), n AS (
  SELECT doc_id, lang, leaf, CASE WHEN n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN other ELSE leaf END AS now,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM d
), t AS (
  SELECT lang, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM n GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(array_to_string(nodes[2 * i + 1:2 * i + 2], '')))
  FROM t WHERE len(nodes) > 1
), s AS (
  SELECT lang, nodes[1] AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM t WHERE len(nodes) = 1
), u AS (
  SELECT 0 AS lvl, list(subroot ORDER BY g) AS nodes FROM s
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(array_to_string(nodes[2 * i + 1:2 * i + 2], '')))
  FROM u WHERE len(nodes) > 1
), e AS (
  -- the nodes of a level and the place in it, from the leaf to the root
  SELECT n.doc_id, n.lang, n.pos, n.leaf, n.now, s.subroot, t.lvl, t.nodes, n.pos >> t.lvl AS i
  FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang JOIN t ON n.lang IS NOT DISTINCT FROM t.lang WHERE len(t.nodes) > 1
  UNION ALL
  SELECT n.doc_id, n.lang, n.pos, n.leaf, n.now, s.subroot, s.height + u.lvl, u.nodes, s.g >> u.lvl
  FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang, u WHERE len(u.nodes) > 1
), p AS (
  SELECT doc_id, lang, pos, list(struct_pack(side := i % 2, node := CASE WHEN i % 2 = 1 THEN nodes[i] ELSE coalesce(nodes[i + 2], '') END) ORDER BY lvl) AS path
  FROM e GROUP BY ALL
), f AS (
  SELECT n.doc_id, n.leaf, s.subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(p.path, lambda x: x.node), ''), '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(side := 0::BIGINT, node := n.now), coalesce(p.path, [])),
      lambda a, x: struct_pack(side := 0::BIGINT, node := CASE WHEN x.side = 1 THEN sha256(x.node || a.node) ELSE sha256(a.node || x.node) END)).node AS folded_root
  FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN p ON n.lang IS NOT DISTINCT FROM p.lang AND n.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM f
"""

def _edit(way: str, cost: str, letter: str, line: str | None = None) -> str:
    lines = f"list_append({way}.t, {line})" if line else f"{way}.t"
    return f"struct_pack(c := {way}.c + {cost}, a := {way}.a || '{letter}', t := {lines})"


def _stay(way: str, initial: str, to: str) -> str:
    """Keep the row if its role begins so, else give it the role `to`, unless it must go."""
    more = "(CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END)"
    kept, reroled = _edit(way, more, "K", "f.role || ':' || f.text"), _edit(way, f"1 + {more}", "R", f"'{to}:' || f.text")
    none = f"struct_pack(c := {_NEVER}, a := '', t := []::VARCHAR[])"
    return f"CASE WHEN f.fault IN ('blank', 'duplicate') THEN {none} WHEN left(f.role, 1) = '{initial}' THEN {kept} ELSE {reroled} END"


_NEVER = "1000000000::BIGINT"
_KEEP_SYSTEM = _stay("r.s0", "s", "user")

OP11 = rf"""
WITH RECURSIVE k AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), z AS (
  SELECT *, {_CRC} % 20 AS kind FROM k
), w AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, copy,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM z, (VALUES (1), (2)) v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen
  FROM w
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1), '') || coalesce(left(role, 1), '') AS pair
  FROM o
), r AS (
  -- the least way to each of four states: nothing, a system row, a user row, an assistant row kept last
  SELECT conv_id, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, a := '', t := []::VARCHAR[]) AS s0,
    struct_pack(c := {_NEVER}, a := '', t := []::VARCHAR[]) AS s1, struct_pack(c := 5::BIGINT, a := 'I', t := ['user:']) AS s2,
    struct_pack(c := 10::BIGINT, a := 'II', t := ['user:', 'assistant:']) AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, least(s3, {_edit("s2", "5", "I", "'assistant:'")})
  FROM (
    SELECT conv_id, i, s0, s1, s3,
      least(s2, {_edit("s0", "5", "I", "'user:'")}, {_edit("s1", "5", "I", "'user:'")}, {_edit("s3", "5", "I", "'user:'")}) AS s2
    FROM (
      SELECT r.conv_id, f.i, {_edit("r.s0", "2", "D")} AS s0,
        least({_edit("r.s1", "2", "D")}, CASE WHEN left(f.role, 1) = 's' THEN {_KEEP_SYSTEM}
          ELSE struct_pack(c := {_NEVER}, a := '', t := []::VARCHAR[]) END) AS s1,
        least({_edit("r.s2", "2", "D")}, {_stay("r.s0", "u", "user")}, {_stay("r.s1", "u", "user")}, {_stay("r.s3", "u", "user")}) AS s2,
        least({_edit("r.s3", "2", "D")}, {_stay("r.s2", "a", "assistant")}) AS s3
      FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i + 1
    )
  )
), e AS (
  SELECT conv_id, least(s0, s3) AS way FROM r
  QUALIFY i = max(i) OVER (PARTITION BY conv_id)
), n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, way.c AS cost, way.a AS audit,
  sha256(array_to_string(way.t, chr(10))) AS repaired_sha256
FROM e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), e AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: struct_pack(i := i, h := md5(array_to_string(w[i:i + 49], ' '))))) AS e
  FROM d WHERE len(w) >= 50
), m AS (
  SELECT e.h AS h, min(doc_id) AS least FROM e GROUP BY e.h
), c AS (
  SELECT DISTINCT doc_id, unnest(range(e.i, e.i + 50)) AS i FROM e JOIN m ON e.h = m.h WHERE doc_id > least
), w AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), k AS (
  SELECT w.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (c.i IS NULL) AS kept
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.i = c.i GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

ORACLE: dict[str, str] = {
    "op1_lattice_neardup": OP1,
    "op2_trigram_secrets": OP2,
    "op4_minhash_containment": OP4,
    "op6_chunked_lines": OP6,
    "op9_warc_bundles": OP9,
    "op10_pareto_mix": OP10,
    "op11_audit_repair": OP11,
    "op12_merkle_manifest": OP12,
    "op13_debruijn_spans": OP13,
}
