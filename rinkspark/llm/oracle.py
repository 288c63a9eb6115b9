"""SQL twins of the operators that SQL can express, written for a single-node engine."""

from __future__ import annotations

# The reversed polynomial of CRC-32, and all ones.
POLYNOMIAL, ONES = 3988292384, 4294967295
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * {POLYNOMIAL}))"
    return f"xor({ONES}, list_reduce(list_prepend({ONES}, {codes}), lambda c, b: {byte}))"


def leaf(*columns: str) -> str:
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
    return "sha256(" + " || ".join(part.format(c) for c in columns) + ")"


PAIRED = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"

MANIFEST = f"""WITH RECURSIVE
changed AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS found FROM documents),
leaves AS (
  SELECT doc_id, lang, {leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf, {leaf("doc_id", "source", "lang", "found", "text")} AS seen FROM changed),
docs AS (
  SELECT *, row_number() OVER () AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
trees AS (
  SELECT lang, list(leaf ORDER BY pos) AS nodes, 0 AS level FROM docs GROUP BY lang
  UNION ALL SELECT lang, {PAIRED}, level + 1 FROM trees WHERE len(nodes) > 1),
subroots AS (
  SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM trees WHERE len(nodes) = 1),
tops AS (
  SELECT list(subroot ORDER BY place) AS nodes, 0 AS level FROM subroots
  UNION ALL SELECT {PAIRED}, level + 1 FROM tops WHERE len(nodes) > 1),
steps AS (
  SELECT n, level AS k, (pos >> level) & 1 AS side, nodes[xor(pos >> level, 1) + 1] AS sibling
  FROM docs d JOIN trees t ON d.lang IS NOT DISTINCT FROM t.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT n, height + level, (place >> level) & 1, nodes[xor(place >> level, 1) + 1]
  FROM docs d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang CROSS JOIN tops WHERE len(nodes) > 1),
paths AS (
  SELECT n, string_agg(sibling, '' ORDER BY k) AS proof,
    list(CASE WHEN sibling IS NULL THEN '' WHEN side = 1 THEN '<' || sibling ELSE '>' || sibling END ORDER BY k) AS path
  FROM steps GROUP BY n)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (
  SELECT d.*, subroot, proof, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root,
    list_reduce(list_prepend(seen, coalesce(path, [])), lambda node, s:
      sha256(CASE WHEN s[1] = '<' THEN substr(s, 2) || node ELSE node || substr(s, 2) END)) AS folded
  FROM docs d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths USING (n))"""


def _edited(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"


def _inserted(state: str, role: str) -> str:
    return _edited(state, "3", "I", f"chr(10) || '{role}:'")


def _taken(state: str, initial: str, role: str) -> str:
    """The row kept where its role fits, given the role where not."""
    keep = _edited(state, "extra", "K", "chr(10) || role || ':' || text")
    change = _edited(state, "(3 + extra)", "R", f"chr(10) || '{role}:' || text")
    return f"CASE WHEN locked THEN NULL WHEN initial = '{initial}' THEN {keep} ELSE {change} END"


# z, s, u, a: the least (cost, audit, lines) that end with nothing, system, user, assistant. Before
# each row and at the end a user turn may be inserted (v), then an assistant's (b).
CONVERSATIONS = f"""WITH RECURSIVE
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, {crc32("key")} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, {BLANKS}) AS content FROM damaged),
faults AS (
  SELECT *, substr(role, 1, 1) AS initial, content = '' AS blank,
    content <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS duplicate,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS previous FROM ordered),
flagged AS (
  SELECT *, blank OR duplicate AS locked, NOT (blank OR duplicate) AND right(content, 1) NOT IN ('.', '!', '?') AS cut,
    CASE WHEN right(content, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra FROM faults),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS z, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS u, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS a FROM ids
  UNION ALL
  SELECT conv_id, n, {_edited("z", "4", "D")},
    list_min([{_edited("s", "4", "D")}, CASE WHEN initial = 's' AND NOT locked THEN {_edited("z", "extra", "K", "chr(10) || role || ':' || text")} END]),
    list_min([{_edited("v", "4", "D")}, {_taken("z", "u", "user")}, {_taken("s", "u", "user")}, {_taken("b", "u", "user")}]),
    list_min([{_edited("b", "4", "D")}, {_taken("v", "a", "assistant")}])
  FROM (
    SELECT *, list_min([a, {_inserted("v", "assistant")}]) AS b FROM (
      SELECT w.conv_id, r.n, z, s, a, initial, locked, extra, role, text,
        list_min([u, {_inserted("z", "user")}, {_inserted("s", "user")}, {_inserted("a", "user")}]) AS v
      FROM walk w JOIN flagged r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = w.n + 1))),
counts AS (
  SELECT i.conv_id, count(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids i LEFT JOIN flagged f ON i.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY i.conv_id),
ends AS (
  SELECT conv_id, n, list_min([z, a, {_inserted("v", "assistant")}]) AS best FROM (
    SELECT *, list_min([u, {_inserted("s", "user")}]) AS v FROM walk))
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM counts c JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.n = e.n"""

ORACLE: dict[str, str] = {"op11_conversations": CONVERSATIONS, "op12_manifest": MANIFEST}
