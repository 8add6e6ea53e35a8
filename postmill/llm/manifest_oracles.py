"""DuckDB SQL for the secret scan, the Merkle manifest and the vector codes."""

from __future__ import annotations

#: The CRC-32 table as a list ``t``, and the checksum of an ASCII string against it.
CRC_TABLE = """tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i)
  )
)"""


def crc(text: str) -> str:
    return (
        f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))), "
        "lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"
    )


def _found(kind: str, rank: int, pattern: str, good: str) -> str:
    return (
        f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, hit, before + list_sum(list_transform(gaps[1:k], lambda g: length(g))) AS start, t, {good} AS good FROM ("
        f"SELECT doc_id, t, gaps, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS k, "
        f"unnest(list_transform(range(1, len(hits) + 1), lambda k: coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0))) AS before FROM ("
        f"SELECT doc_id, t, regexp_extract_all(text, {pattern}) AS hits, regexp_split_to_array(text, {pattern}) AS gaps FROM d) WHERE len(hits) > 0)"
    )


_ASSIGN = (
    "'(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+'"
)
_CHECKED = (
    "{crc} = list_sum(list_transform(range(1, 7), lambda k: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', "
    "hit[-k]) - 1) * CAST(pow(62, k - 1) AS BIGINT)))"
).format(crc=crc("right(left(hit, 34), 30)"))
# The last group of the assignment is what follows the sign, without a quote.
_VALUE = "length(regexp_replace(hit, '^[A-Za-z_]+[\"'']?\\x20*[:=]\\x20*[\"'']?', ''))"

SECRETS = f"""
WITH {CRC_TABLE}, d AS (SELECT doc_id, coalesce(text, '') AS text, t FROM documents, tab),
s AS (
  {_found("assign", 0, _ASSIGN, _VALUE + " >= 8")}
  UNION ALL {_found("access", 1, "'AKIA[A-Z0-9]+'", "length(hit) >= 16")}
  UNION ALL {_found("hex", 2, "'[0-9a-f]+'", "length(hit) >= 32")}
  UNION ALL {_found("github", 3, "'gh[pousr]_[A-Za-z0-9]{36}\\b'", _CHECKED)}
  UNION ALL {_found("npm", 4, "'npm_[A-Za-z0-9]{36}\\b'", _CHECKED)}
), g AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(hit) AS BIGINT), ',' ORDER BY start, rank) FILTER (rank <= 2) AS base,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(hit) AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM s WHERE good GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, group: str, leaves: str) -> str:
    """Nodes ``(group, level, i, h)`` of the trees over ``leaves(group, i, h)``."""
    return f"""{name} AS (
  SELECT {group}, 0 AS level, i, h FROM {leaves}
  UNION ALL
  SELECT {group}, max(level) + 1 AS level, i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {name}) WHERE n > 1 GROUP BY {group}, i // 2
)"""


MERKLE = f"""
WITH RECURSIVE {CRC_TABLE}, l AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, {_leaf("n_chars")} AS h,
    CASE WHEN {crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS altered
  FROM documents, tab
), {_tree("n", "lang", "l")},
r0 AS (
  SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, level AS height
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY level DESC) AS nth FROM n) WHERE nth = 1
), {_tree("r", "one", "r0")},
top AS (SELECT h AS root, level AS height FROM r ORDER BY level DESC LIMIT 1),
steps AS (
  SELECT l.lang, l.i, k AS step, (l.i >> k) % 2 AS side, n.h
  FROM (SELECT l.lang, l.i, unnest(range(r0.height)) AS k FROM l JOIN r0 ON r0.lang IS NOT DISTINCT FROM l.lang) l
  LEFT JOIN n ON n.lang IS NOT DISTINCT FROM l.lang AND n.level = k AND n.i = xor(l.i >> k, 1)
  UNION ALL
  SELECT l.lang, l.i, l.below + k AS step, (l.place >> k) % 2 AS side, r.h
  FROM (
    SELECT l.lang, l.i, r0.height AS below, r0.i AS place, unnest(range(top.height)) AS k
    FROM l JOIN r0 ON r0.lang IS NOT DISTINCT FROM l.lang, top
  ) l LEFT JOIN r ON r.level = k AND r.i = xor(l.place >> k, 1)
), fold AS (
  SELECT lang, i, 0 AS step, altered AS h FROM l
  UNION ALL
  SELECT f.lang, f.i, f.step + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.side = 1 THEN s.h || f.h ELSE f.h || s.h END)
  FROM fold f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.i = f.i AND s.step = f.step
), last AS (SELECT lang, i, arg_max(h, step) AS folded_root FROM fold GROUP BY lang, i),
p AS (SELECT lang, i, string_agg(h, '' ORDER BY step) AS siblings FROM steps GROUP BY lang, i)
SELECT l.doc_id, l.h AS leaf, r0.h AS subroot, top.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, last.folded_root,
  last.folded_root = top.root AS verified
FROM l JOIN r0 ON r0.lang IS NOT DISTINCT FROM l.lang JOIN last ON last.lang IS NOT DISTINCT FROM l.lang AND last.i = l.i
LEFT JOIN p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i, top
"""


def _assigned(book: str) -> str:
    """``key`` is distance times 256 plus the entry, so its least settles ties too."""
    return f"""SELECT r, part, min(CAST(qq - 2 * list_inner_product(q, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS key
  FROM p JOIN {book} b USING (part) GROUP BY r, part"""


def _round(k: int) -> str:
    return f"""a{k} AS ({_assigned(f"b{k}")}),
u{k} AS (
  SELECT part, e, list(CAST((total - ((total % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM (
    SELECT part, e, i, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM (
      SELECT part, key % 256 AS e, unnest(q) AS x, unnest(range(len(q))) AS i FROM a{k} JOIN p USING (r, part)
    ) GROUP BY part, e, i
  ) GROUP BY part, e
), b{k + 1} AS (SELECT part, e, coalesce(u.c, b.c) AS c FROM b{k} b LEFT JOIN u{k} u USING (part, e))"""


VECTOR_CODES = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT r, part, q, list_inner_product(q, q) AS qq FROM (
    SELECT r, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS q FROM v, (SELECT unnest(range(4)) AS part)
  )
), b0 AS (SELECT part, r - 1 AS e, q AS c FROM p WHERE r <= 256),
{", ".join(_round(k) for k in range(4))},
a4 AS ({_assigned("b4")}),
codes AS (
  SELECT r, string_agg(printf('%02x', key % 256), '' ORDER BY part) AS code, CAST(sum(key // 256) AS BIGINT) AS error FROM a4 GROUP BY r
), o AS (SELECT vec_id, label, code, error FROM v JOIN codes USING (r)),
s AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM o GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM o JOIN s ON s.label IS NOT DISTINCT FROM o.label, h
"""
