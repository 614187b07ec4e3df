"""The general problems' queries as SQL over the same tables, for comparison only."""

SNAPSHOTS = """
usable AS (SELECT node_id, taken_at, min(snap_id) AS snap_id FROM snapshot_file WHERE complete AND node_id IS NOT NULL AND taken_at IS NOT NULL GROUP BY 1, 2),
idx AS (SELECT node_id, snap_id, row_number() OVER (PARTITION BY node_id ORDER BY taken_at) AS ord FROM usable),
latest AS (SELECT snap_id FROM idx QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ord DESC) = 1)"""

JUDGED = f"""
WITH {SNAPSHOTS},
spec AS (SELECT attr, kind, regexp_replace(lower(attr), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS s FROM attr_spec),
pairs AS (SELECT snap_id, db, decode(key) AS key, field, value, regexp_replace(lower(decode(field)), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS s, trim(try(decode(value)), E' \\t\\n\\r\\x0b\\x0c') AS t
          FROM kv_hash WHERE snap_id IN (SELECT snap_id FROM latest)),
named AS (SELECT p.*, spec.attr, spec.kind FROM pairs p JOIN spec ON p.s = spec.s WHERE p.field IS NOT NULL AND p.value IS NOT NULL),
judged AS (SELECT *, CASE
  WHEN t IS NULL THEN kind = 'string'
  WHEN lower(t) IN ('', 'null', 'none', 'nil', 'n/a', 'undefined', '-', '?') THEN false
  WHEN kind = 'string' THEN true
  WHEN kind = 'int' THEN regexp_full_match(t, '[+-]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\\.0+)?') AND try_cast(regexp_replace(t, '\\..*$|,', '', 'g') AS BIGINT) IS NOT NULL
  WHEN kind = 'double' THEN regexp_full_match(t, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(try_cast(t AS DOUBLE))
  WHEN kind = 'bool' THEN lower(t) IN ('true', 't', 'yes', 'y', 'on', '1', 'false', 'f', 'no', 'n', 'off', '0')
  WHEN kind = 'ts' THEN regexp_full_match(t, '[0-9]{{10}}|[0-9]{{13}}') OR (
    regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.,][0-9]+)?)?(Z|[+-][0-9]{{2}}(:?[0-9]{{2}})?)?)?')
    AND try_cast(substr(t, 1, 10) AS DATE) IS NOT NULL
    AND (length(t) = 10 OR try_cast(regexp_extract(t, '[T ]([0-9:]+)', 1) || CASE WHEN regexp_matches(t, ':[0-9]{{2}}:') THEN '' ELSE ':00' END AS TIME) IS NOT NULL))
  ELSE false END AS fit FROM named)"""

#: The test tables' attributes by kind.
ATTRS = {
    "string": ("display_name", "home_city", "plan", "referrer", "device_model", "locale"), "int": ("age", "login_count", "items_in_cart", "retry_limit", "points", "quota_bytes"),
    "double": ("balance", "score_avg", "lat_offset", "discount_rate"), "bool": ("is_active", "opt_in", "email_verified", "beta_user"), "ts": ("created_at", "last_seen", "expires_on", "password_changed_at"),
}
TYPED = {
    "string": "t", "int": "CAST(regexp_replace(t, '\\..*$|,', '', 'g') AS BIGINT)", "double": "CAST(t AS DOUBLE)", "bool": "CAST(lower(t) IN ('true', 't', 'yes', 'y', 'on', '1') AS BIGINT)",
    "ts": """CASE WHEN regexp_full_match(t, '[0-9]{10}') THEN CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '[0-9]{13}') THEN CAST(t AS BIGINT) * 1000
      ELSE epoch_us(CAST(replace(regexp_extract(t, '^([0-9-]{10}([T ][0-9:.]+)?)', 1), 'T', ' ') AS TIMESTAMP))
        - CASE WHEN regexp_matches(t, '[T ].*[+-][0-9]{2}:[0-9]{2}$') THEN (CASE WHEN t[-6] = '-' THEN -1 ELSE 1 END) * (CAST(t[-5:-4] AS BIGINT) * 60 + CAST(t[-2:] AS BIGINT)) * 60000000 ELSE 0 END END""",
}
CELL = JUDGED + """,
best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY snap_id, db, key, attr ORDER BY fit DESC, field, value) = 1)"""

SQL = {
    "p1_wide": CELL
    + " SELECT p.snap_id AS snap_id, p.db AS db, p.key AS key, "
    + ", ".join(f"max(CASE WHEN b.attr = '{a}' AND b.fit THEN {v} END) AS {a}" for k, v in TYPED.items() for a in ATTRS[k])
    + " FROM (SELECT DISTINCT snap_id, db, key FROM pairs) p LEFT JOIN best b ON p.snap_id = b.snap_id AND p.db = b.db AND p.key = b.key GROUP BY 1, 2, 3",
    "p1_failures": CELL + " SELECT snap_id, db, key, attr, t AS text FROM best WHERE NOT fit",
    "p1_found": JUDGED + " SELECT DISTINCT snap_id, db, key, attr FROM judged WHERE fit",
    "p2_found": """
WITH e AS (SELECT snap_id, db, decode(key) AS key, CAST(split_part(stream_id, '-', 1) AS BIGINT) AS id_ms,
                  CASE WHEN contains(stream_id, '-') THEN CAST(split_part(stream_id, '-', 2) AS BIGINT) ELSE 0 END AS id_seq, file_id FROM kv_stream WHERE stream_id IS NOT NULL)
SELECT snap_id, db, key, id_ms, id_seq FROM e GROUP BY ALL HAVING count(DISTINCT file_id) > 1""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5"),
    "p2_compacted": """
WITH e AS (SELECT *, CAST(split_part(stream_id, '-', 1) AS BIGINT) AS id_ms,
                  CASE WHEN contains(stream_id, '-') THEN CAST(split_part(stream_id, '-', 2) AS BIGINT) WHEN stream_id IS NOT NULL THEN 0 END AS id_seq FROM kv_stream),
n AS (SELECT snap_id, db, key, id_ms, id_seq, field, field_value, file_id, count(*) AS n FROM e GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
m AS (SELECT snap_id, db, key, id_ms, id_seq, field, field_value, max(n) AS n FROM n GROUP BY 1, 2, 3, 4, 5, 6, 7),
c AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY snap_id, db, key, id_ms, id_seq, field, field_value ORDER BY file_id NULLS FIRST, stream_id NULLS FIRST, type NULLS FIRST,
      expiry_ms NULLS FIRST, lru_idle_secs NULLS FIRST, lfu_frequency NULLS FIRST, encoding NULLS FIRST, num_elements NULLS FIRST) = 1)
SELECT snap_id, db, decode(key) AS key, id_ms, id_seq, stream_id, decode(field) AS field, hex(field_value) AS value_hex, file_id, type, expiry_ms, lru_idle_secs, CAST(lfu_frequency AS BIGINT) AS lfu_frequency, encoding, num_elements
FROM (SELECT c.*, unnest(range(m.n)) AS i FROM c JOIN m ON c.snap_id IS NOT DISTINCT FROM m.snap_id AND c.db IS NOT DISTINCT FROM m.db AND c.key IS NOT DISTINCT FROM m.key AND c.id_ms IS NOT DISTINCT FROM m.id_ms
      AND c.id_seq IS NOT DISTINCT FROM m.id_seq AND c.field IS NOT DISTINCT FROM m.field AND c.field_value IS NOT DISTINCT FROM m.field_value)""",
    "p2_joined": """
SELECT snap_id, db, decode(key) AS key, type, expiry_ms, lru_idle_secs, CAST(lfu_frequency AS BIGINT) AS lfu_frequency, encoding, num_elements, stream_id, decode(field) AS field, hex(field_value) AS value_hex, file_id FROM kv_stream""",
    "p2_report": """
WITH f AS (SELECT file_id FROM kv_stream UNION SELECT file_id FROM stream_file)
SELECT (SELECT count(*) FROM f) AS n_files, (SELECT count(*) FROM f) AS n_blocks, (SELECT count(*) FROM kv_stream) AS n_rows, true AS few_groups, true AS few_files""",
    "p5_found": f"""
WITH {SNAPSHOTS},
held AS (SELECT DISTINCT node_id, ord, db, key, field, value, expiry_ms FROM kv_hash JOIN idx USING (snap_id) WHERE field IS NOT NULL),
runs AS (SELECT *, ord - row_number() OVER (PARTITION BY node_id, db, key, field, value, expiry_ms ORDER BY ord) AS island FROM held),
spans AS (SELECT node_id, db, key, field, value, expiry_ms, min(ord) AS a, max(ord) + 1 AS b FROM runs GROUP BY node_id, db, key, field, value, expiry_ms, island)
SELECT DISTINCT f.snap_id AS snap_id, db, decode(key) AS key, decode(field) AS field, coalesce(u.snap_id, 0) AS until_snap_id
FROM spans s JOIN idx f ON f.node_id = s.node_id AND f.ord = s.a LEFT JOIN idx u ON u.node_id = s.node_id AND u.ord = s.b""",
    "p5_history": f"""
WITH {SNAPSHOTS},
held AS (SELECT DISTINCT node_id, ord, db, key, field, value, expiry_ms FROM kv_hash JOIN idx USING (snap_id) WHERE field IS NOT NULL),
runs AS (SELECT *, ord - row_number() OVER (PARTITION BY node_id, db, key, field, value, expiry_ms ORDER BY ord) AS island FROM held),
spans AS (SELECT node_id, db, key, field, value, expiry_ms, min(ord) AS a, max(ord) + 1 AS b FROM runs GROUP BY node_id, db, key, field, value, expiry_ms, island)
SELECT s.node_id AS node_id, db, decode(key) AS key, decode(field) AS field, hex(value) AS value_hex, expiry_ms, f.snap_id AS from_snap_id, u.snap_id AS until_snap_id
FROM spans s JOIN idx f ON f.node_id = s.node_id AND f.ord = s.a LEFT JOIN idx u ON u.node_id = s.node_id AND u.ord = s.b""",
    "p6_found": """
SELECT snap_id, db, decode(key) AS key FROM kv_list GROUP BY snap_id, db, kv_list.key HAVING count(DISTINCT elem_index) IS DISTINCT FROM max(num_elements)""",
    "p6_lists": """
SELECT snap_id, db, decode(key) AS key, count(*) AS n_rows, count(DISTINCT elem_index) AS true_length, max(num_elements) AS stated_length
FROM kv_list GROUP BY snap_id, db, kv_list.key""",
    "p6_modes": """
WITH v AS (SELECT snap_id, db, key, hex(element) AS e, count(*) AS w FROM kv_list GROUP BY 1, 2, 3, 4)
SELECT snap_id, db, decode(key) AS key, count(e) AS n_distinct, first(e ORDER BY w DESC, e) FILTER (e IS NOT NULL) AS mode_hex, max(w) FILTER (e IS NOT NULL) AS mode_weight
FROM v GROUP BY snap_id, db, v.key""",
    "p6_percentiles": """
WITH v AS (SELECT snap_id, db, key, octet_length(element) AS n, row_number() OVER (PARTITION BY snap_id, db, key ORDER BY octet_length(element)) AS r, count(*) OVER (PARTITION BY snap_id, db, key) AS c
           FROM kv_list WHERE element IS NOT NULL),
q AS (SELECT unnest([0.0, 0.5, 0.9, 1.0]::DOUBLE[]) AS fraction)
SELECT snap_id, db, decode(key) AS key, fraction, CAST(n AS BIGINT) AS n_bytes FROM v JOIN q ON r = greatest(1, ceil(fraction * c))""",
    "p7_changes": f"""
WITH {SNAPSHOTS},
held AS (SELECT DISTINCT node_id, ord, db, key, value, expiry_ms FROM kv_string JOIN idx USING (snap_id)),
steps AS (SELECT b.node_id, b.ord, b.snap_id, a.snap_id AS before_id FROM idx a JOIN idx b ON a.node_id = b.node_id AND b.ord = a.ord + 1),
cur AS (SELECT h.*, i.snap_id, i.before_id FROM held h JOIN steps i ON i.node_id = h.node_id AND i.ord = h.ord),
prev AS (SELECT h.node_id, h.ord + 1 AS ord, h.db, h.key, h.value, h.expiry_ms, i.snap_id, i.before_id FROM held h JOIN steps i ON i.node_id = h.node_id AND i.ord = h.ord + 1)
SELECT coalesce(c.node_id, p.node_id) AS node_id, coalesce(c.snap_id, p.snap_id) AS snap_id, coalesce(c.before_id, p.before_id) AS previous_snap_id, coalesce(c.db, p.db) AS db, decode(coalesce(c.key, p.key)) AS key,
       CASE WHEN p.key IS NULL THEN 'added' WHEN c.key IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN prev p ON c.node_id = p.node_id AND c.ord = p.ord AND c.db = p.db AND c.key = p.key
WHERE p.key IS NULL OR c.key IS NULL OR c.value IS DISTINCT FROM p.value OR c.expiry_ms IS DISTINCT FROM p.expiry_ms""",
}
SQL["p7_found"] = f"SELECT snap_id, db, key, change_kind FROM ({SQL['p7_changes']})"
