"""SQL of the queries that SQL can state, over whole tables and texts."""

from __future__ import annotations

from .sharding import BITS

_CRC_TABLE = "list_transform(range(256), lambda c: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, c))"


def _crc(blob: str) -> str:
    """CRC-32 of a blob, byte by byte, with the table in a column ``t``."""
    each = f"list_transform(range(octet_length({blob})), lambda i: CAST('0x' || hex({blob}[i + 1 : i + 1]) AS BIGINT))"
    return f"xor(list_reduce({each}, lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]), 4294967295), 4294967295)"


def hilbert_shards(bits: int = BITS, shards: int = 8) -> str:
    """Cells of language, source and length, their Hilbert index step by step, and equal runs of that order."""
    cell = lambda c: f"coalesce({_crc(f'encode({c})')} >> {32 - bits}, 0)"
    steps = [f"SELECT *, {_crc('b')} AS text_crc32, {cell('lang')} AS x0, {cell('source')} AS x1, least(CAST(floor(log2(size)) AS BIGINT), {(1 << bits) - 1}) AS x2 FROM d, (SELECT {_CRC_TABLE} AS t)"]

    def step(**sets: str) -> None:
        steps.append(f"SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in sets.items())}) FROM s{len(steps) - 1}")

    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(3):
            high, swap = f"x{i} & {q} <> 0", f"xor(x0, x{i}) & {low}"
            sets = {} if i == 0 else {f"x{i}": f"CASE WHEN {high} THEN x{i} ELSE xor(x{i}, {swap}) END"}
            step(x0=f"CASE WHEN {high} THEN xor(x0, {low}) ELSE xor(x0, {swap}) END", **sets)
    step(x1="xor(x1, x0)")
    step(x2="xor(x2, x1)")
    turn = "0"
    for level in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN (x2 >> {level}) & 1 = 1 THEN {(1 << level) - 1} ELSE 0 END)"
    step(**{f"x{i}": f"xor(x{i}, {turn})" for i in range(3)})
    curve = " + ".join(f"(((x{i} >> {level}) & 1) << {3 * level + 2 - i})" for level in range(bits) for i in range(3))
    chain = ", ".join(f"s{k} AS ({x})" for k, x in enumerate(steps))
    return f"""WITH d AS (SELECT *, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents), {chain},
  o AS (SELECT *, row_number() OVER (ORDER BY {curve}, text_crc32, doc_id NULLS FIRST, size) - 1 AS pos, count(*) OVER () AS n FROM s{len(steps) - 1})
  SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(pos * {shards} // n AS INT) AS shard, CAST(pos - (pos * {shards} // n * n + {shards - 1}) // {shards} AS BIGINT) AS slot,
  CAST(NULL AS INT) AS grown_shard FROM o"""


#: Every window of 200 bytes by its digest; those that occur again, their union in each text, and what is left of it.
REPEATED_BYTES = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
  w AS MATERIALIZED (SELECT r, i, md5(b[i + 1 : i + 200]) AS m FROM (SELECT r, b, unnest(range(octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200)),
  hit AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
  cut AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM hit)),
  gone AS (SELECT r, min(i) AS a, max(i) + 200 AS e FROM cut GROUP BY r, k),
  edge AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM gone),
  kept AS (SELECT r, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS e, string_agg(CASE WHEN a > p THEN hex(b[p + 1 : a]) ELSE '' END, '' ORDER BY a) AS h FROM edge JOIN d USING (r) GROUP BY r)
  SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h || CASE WHEN e < octet_length(b) THEN hex(b[e + 1 : octet_length(b)]) ELSE '' END) END) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

#: Sets of three-word shingles, links by their true similarity, and the smallest id reachable.
NEAR_COPIES = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
  s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, ' ')] ELSE list_distinct([x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] for i in range(1, len(x) - 1)]) END AS g FROM w),
  e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
  l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
  low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
  SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, b) AS component_id, least(doc_id, b) = doc_id AS kept FROM s LEFT JOIN low ON a = doc_id"""

ORACLE_SQL: dict[str, str] = {"op1_hilbert_shards": hilbert_shards(), "op3_suffix_doubling": REPEATED_BYTES, "op4_minhash_bbit": NEAR_COPIES}
