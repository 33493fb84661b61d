"""SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS tab"


def _crc32(octets: str) -> str:
    """CRC-32 of a list of byte values, by the table ``tab``."""
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(changed: str | None = None) -> str:
    texts = [f"cast({changed if c == 'n_chars' and changed else c} AS VARCHAR)" for c in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


MERKLE = f"""
WITH RECURSIVE table_(tab) AS ({_CRC_TABLE}),
leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf()} AS leaf,
         {_crc32("list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda c: cast(ascii(c) AS BIGINT))")} % 7 = 0 AS bad,
         CASE WHEN bad THEN {_leaf("n_chars + 1")} ELSE {_leaf()} END AS found
  FROM documents, table_),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
levels AS (
  SELECT cast(0 AS BIGINT) AS lvl, lang, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM levels WHERE n > 1 GROUP BY lvl, lang, i // 2, n),
subroots AS MATERIALIZED (
  SELECT lang, h AS subroot, lvl AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS langs FROM levels WHERE n = 1),
uppers AS (
  SELECT cast(0 AS BIGINT) AS lvl, g, langs AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, g // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY g)) FROM uppers WHERE n > 1 GROUP BY lvl, g // 2, n),
whole AS (SELECT h AS root, lvl AS height FROM uppers WHERE n = 1),
steps AS MATERIALIZED (
  SELECT p.doc_id, p.leaf, l.lvl, s.h AS other, (l.i & 1) = 1 AS other_first
  FROM placed p JOIN levels l ON l.lang IS NOT DISTINCT FROM p.lang AND l.n > 1 AND l.i = p.i >> l.lvl
  LEFT JOIN levels s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = l.lvl AND s.i = xor(l.i, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, r.top + l.lvl, s.h, (l.g & 1) = 1
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN uppers l ON l.n > 1 AND l.g = r.g >> l.lvl
  LEFT JOIN uppers s ON s.lvl = l.lvl AND s.g = xor(l.g, 1)),
proofs AS (SELECT doc_id, leaf, sha256(coalesce(string_agg(other, '' ORDER BY lvl), '')) AS proof_sha256 FROM steps GROUP BY doc_id, leaf),
folds AS (
  SELECT p.doc_id, p.leaf, cast(0 AS BIGINT) AS lvl, p.found AS h FROM placed p
  UNION ALL
  SELECT f.doc_id, f.leaf, f.lvl + 1, sha256(CASE WHEN s.other IS NULL THEN f.h WHEN s.other_first THEN s.other || f.h ELSE f.h || s.other END)
  FROM folds f JOIN steps s ON s.doc_id IS NOT DISTINCT FROM f.doc_id AND s.leaf = f.leaf AND s.lvl = f.lvl)
SELECT p.doc_id, p.leaf, r.subroot, w.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = w.root AS verified
FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang CROSS JOIN whole w
LEFT JOIN proofs q ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.leaf = p.leaf
JOIN folds f ON f.doc_id IS NOT DISTINCT FROM p.doc_id AND f.leaf = p.leaf AND f.lvl = r.top + w.height
"""


def _hilbert(source: str, bits: int = 5) -> str:
    """Hilbert index of the integer columns x0, x1, x2 of a query, as ``curve``: one nested query a step."""
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        source = f"SELECT * REPLACE (CASE WHEN x0 & {q} > 0 THEN xor(x0, {low}) ELSE x0 END AS x0) FROM ({source})"
        for i in (1, 2):
            source = f"SELECT * REPLACE (CASE WHEN x{i} & {q} > 0 THEN xor(x0, {low}) ELSE xor(x0, xor(x0, x{i}) & {low}) END AS x0, CASE WHEN x{i} & {q} > 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {low}) END AS x{i}) FROM ({source})"
    source = f"SELECT * REPLACE (xor(x1, x0) AS x1) FROM ({source})"
    source = f"SELECT * REPLACE (xor(x2, x1) AS x2) FROM ({source})"
    turned = "0"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turned = f"xor({turned}, CASE WHEN x2 & {q} > 0 THEN {q - 1} ELSE 0 END)"
    source = f"SELECT *, {turned} AS turned FROM ({source})"
    index = " + ".join(f"((xor(x{i}, turned) >> {b} & 1) << {3 * b + 2 - i})" for b in range(bits) for i in range(3))
    return f"SELECT *, {index} AS curve FROM ({source})"


SHARDS = f"""
WITH table_(tab) AS ({_CRC_TABLE}),
sized AS MATERIALIZED (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         {_crc32("list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: cast('0x' || p AS BIGINT))")} AS text_crc32,
         32 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // count(*) OVER () AS x0,
         32 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // count(*) OVER () AS x1,
         32 * (rank() OVER (ORDER BY n_chars NULLS FIRST) - 1) // count(*) OVER () AS x2
  FROM documents, table_),
placed AS ({_hilbert("SELECT * FROM sized")}),
summed AS (SELECT *, sum(size) OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM placed),
cut AS (SELECT *, cast(16 * (2 * before + size) // (2 * total) AS INTEGER) AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY curve, text_crc32, doc_id NULLS FIRST) - 1 AS slot,
       cast(NULL AS INTEGER) AS grown_shard, cast(curve AS BIGINT) AS curve
FROM cut
"""

ORACLES: dict[str, str] = {"op12_merkle_manifest": MERKLE, "op13_hilbert_shards": SHARDS}
