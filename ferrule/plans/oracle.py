"""DuckDB SQL equivalents of the registered queries (same column names).

The adapter CTEs below restate ``ferrule.sources.adapters`` in SQL.
"""

from __future__ import annotations

NUM = r"CASE WHEN regexp_full_match(value, '[0-9]+(\.[0-9]+)?') THEN CAST(value AS DOUBLE) END"

DEC = r"CASE WHEN regexp_full_match(value, '[0-9]+(\.[0-9]+)?') THEN CAST(value AS DECIMAL(38,10)) END"
AVG = f"(CAST(sum({DEC}) AS DOUBLE) / count({DEC}))"
SIGNED_DEC = r"CASE WHEN regexp_full_match(value, '-?[0-9]+(\.[0-9]+)?') THEN CAST(value AS DECIMAL(38,10)) END"
SIGNED_AVG = f"(CAST(sum({SIGNED_DEC}) AS DOUBLE) / count({SIGNED_DEC}))"

TYPE_TAGS = """type_tags AS (
  SELECT CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS id, event_type AS name
  FROM (SELECT DISTINCT event_type FROM events))"""

READING = """CASE CAST(json_extract_string(props, '$.k') AS INTEGER)
    WHEN 13 THEN 'BAD' WHEN 42 THEN '-' || CAST(value AS VARCHAR) WHEN 77 THEN 'NaN'
    ELSE CAST(value AS VARCHAR) END"""

SERIES_BY_TYPE = f"""{TYPE_TAGS},
series AS (
  SELECT t.id AS tag_id, e.ts AS timestamp, {READING} AS value
  FROM events e JOIN type_tags t ON e.event_type = t.name)"""


def _num(col: str = "value") -> str:
    return NUM.replace("value", col)


ORACLE = {
    "metrics_hourly": f"""
WITH {SERIES_BY_TYPE}
SELECT tag_id, time_bucket(INTERVAL '1 hour', timestamp) AS bucket,
       round({AVG}, 6) AS avg_value, round(min({NUM}), 6) AS min_value,
       round(max({NUM}), 6) AS max_value, count(*) AS sample_count
FROM series GROUP BY 1, 2""",
}

SERIES_BY_USER = f"""series AS (
  SELECT CAST(user_id AS INTEGER) AS tag_id, ts AS timestamp, {READING} AS value FROM events)"""

SERIES_BY_SUPPLIER = """series AS (
  SELECT CAST(l_suppkey AS INTEGER) AS tag_id, l_shipdate AS timestamp,
         CAST(l_quantity AS VARCHAR) AS value FROM lineitem)"""

RANGE = "timestamp BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"


def _metrics(series_cte: str, bucket: str, where: str = "", num: str = NUM, avg: str = AVG) -> str:
    return f"""
WITH {series_cte}
SELECT tag_id, {bucket} AS bucket,
       round({avg}, 6) AS avg_value, round(min({num}), 6) AS min_value,
       round(max({num}), 6) AS max_value, count(*) AS sample_count
FROM series {('WHERE ' + where) if where else ''} GROUP BY 1, 2"""


SIGNED = r"CASE WHEN regexp_full_match(value, '-?[0-9]+(\.[0-9]+)?') THEN CAST(value AS DOUBLE) END"


def _gapfill(series_cte: str, width: str, where: str = "", lo: str | None = None, hi: str | None = None) -> str:
    bounds = (f"SELECT DISTINCT tag_id, time_bucket(INTERVAL '{width}', TIMESTAMP '{lo}') AS b0, "
              f"time_bucket(INTERVAL '{width}', TIMESTAMP '{hi}') AS b1 FROM agg") if lo else \
        "SELECT tag_id, min(bucket) AS b0, max(bucket) AS b1 FROM agg GROUP BY tag_id"
    return f"""
WITH {series_cte},
agg AS (
  SELECT tag_id, time_bucket(INTERVAL '{width}', timestamp) AS bucket,
         {AVG} AS avg_value, min({NUM}) AS min_value, max({NUM}) AS max_value,
         arg_min({NUM}, timestamp) FILTER (WHERE {NUM} IS NOT NULL) AS first_value,
         arg_max({NUM}, timestamp) FILTER (WHERE {NUM} IS NOT NULL) AS last_value,
         count(*) AS sample_count
  FROM series {('WHERE ' + where) if where else ''} GROUP BY 1, 2),
bounds AS ({bounds}),
spine AS (SELECT tag_id, unnest(generate_series(b0, b1, INTERVAL '{width}')) AS bucket FROM bounds),
filled AS (
  SELECT s.tag_id, s.bucket, a.avg_value, a.min_value, a.max_value, a.first_value, a.last_value,
         coalesce(a.sample_count, 0) AS sample_count
  FROM spine s LEFT JOIN agg a ON s.tag_id = a.tag_id AND s.bucket = a.bucket)
SELECT tag_id, bucket, round(avg_value, 6) AS avg_value, round(min_value, 6) AS min_value,
       round(max_value, 6) AS max_value, round(first_value, 6) AS first_value,
       round(last_value, 6) AS last_value, sample_count,
       round(last_value(avg_value IGNORE NULLS) OVER (PARTITION BY tag_id ORDER BY bucket
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS interpolated_value
FROM filled"""


GAP = "(epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY {key} ORDER BY timestamp))) / 1e6"

LADDER = """CASE WHEN m IS NULL THEN NULL WHEN m < 1 THEN 'sub_second' WHEN m < 60 THEN 'second'
  WHEN m < 3600 THEN 'minute' WHEN m < 86400 THEN 'hour' WHEN m < 604800 THEN 'day' ELSE 'week' END"""


def _frequency(series_cte: str) -> str:
    return f"""
WITH {series_cte},
g AS (SELECT tag_id, {GAP.format(key='tag_id')} AS gap FROM series WHERE timestamp IS NOT NULL),
m AS (SELECT tag_id, count(gap) AS gap_count, median(gap) AS m FROM g GROUP BY tag_id)
SELECT tag_id, gap_count, {LADDER} AS frequency FROM m"""


USER_FREQ = f"""{SERIES_BY_USER},
g AS (SELECT tag_id, {GAP.format(key='tag_id')} AS gap FROM series),
freq AS (SELECT tag_id, (SELECT {LADDER} FROM (SELECT median(gap) AS m)) AS frequency FROM g GROUP BY tag_id)"""

ORACLE.update({
    "metrics_range": _metrics(SERIES_BY_TYPE, "time_bucket(INTERVAL '15 minutes', timestamp)", RANGE),
    "metrics_weekly": _metrics(SERIES_BY_USER, "time_bucket(INTERVAL '7 days', timestamp)"),
    "metrics_trunc_day": _metrics(SERIES_BY_TYPE, "date_trunc('day', timestamp)"),
    "metrics_quarterly": _metrics(SERIES_BY_SUPPLIER, "time_bucket(INTERVAL '3 months', timestamp)"),
    "metrics_signed": _metrics(SERIES_BY_TYPE, "time_bucket(INTERVAL '1 day', timestamp)", num=SIGNED,
                               avg=SIGNED_AVG),
    "gapfill_hourly": _gapfill(SERIES_BY_TYPE, "1 hour"),
    "gapfill_users_range": _gapfill(SERIES_BY_USER, "6 hours", RANGE,
                                    "2024-01-10 00:00:00", "2024-01-20 12:00:00"),
    "first_last_daily": f"""
WITH {SERIES_BY_TYPE}
SELECT tag_id, time_bucket(INTERVAL '1 day', timestamp) AS bucket,
       round(arg_min({NUM}, timestamp) FILTER (WHERE {NUM} IS NOT NULL), 6) AS first_value,
       round(arg_max({NUM}, timestamp) FILTER (WHERE {NUM} IS NOT NULL), 6) AS last_value,
       min(timestamp) FILTER (WHERE {NUM} IS NOT NULL) AS first_time,
       max(timestamp) FILTER (WHERE {NUM} IS NOT NULL) AS last_time
FROM series GROUP BY 1, 2""",
    "daily_rollup": f"""
WITH {SERIES_BY_USER}
SELECT tag_id, time_bucket(INTERVAL '1 day', timestamp) AS bucket,
       round({AVG}, 6) AS avg_value, count(*) AS sample_count
FROM series GROUP BY 1, 2""",
    "upload_history": f"""
WITH {USER_FREQ}
SELECT 'user_' || CAST(s.tag_id AS VARCHAR) AS tag_name, f.frequency, count(*) AS records_count,
       min(s.timestamp) AS first_record, max(s.timestamp) AS last_record
FROM series s JOIN freq f ON s.tag_id = f.tag_id
GROUP BY 1, 2 ORDER BY last_record DESC, tag_name, f.frequency LIMIT 20""",
    "tag_statistics": f"""
WITH {SERIES_BY_TYPE}
SELECT t.id AS tag_id, t.name, CAST(NULL AS VARCHAR) AS unit_of_measure,
       time_bucket(INTERVAL '1 day', s.timestamp) AS day, count(s.value) AS data_points,
       min(s.timestamp) AS first_timestamp, max(s.timestamp) AS last_timestamp,
       count(s.value) AS daily_count
FROM type_tags t LEFT JOIN series s ON t.id = s.tag_id
WHERE s.{RANGE}
GROUP BY 1, 2, 3, 4""",
    "latest_readings": f"""
WITH {SERIES_BY_USER}
SELECT tag_id, timestamp, value, 'GOOD' AS quality FROM series WHERE {RANGE}
ORDER BY timestamp DESC, tag_id LIMIT 100""",
    "frequency_by_user": _frequency(SERIES_BY_USER),
    "frequency_by_type": _frequency(SERIES_BY_TYPE),
    "frequency_of_file": f"""
WITH g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 1e6 AS gap
           FROM events WHERE ts IS NOT NULL),
m AS (SELECT count(gap) AS gap_count, median(gap) AS m FROM g)
SELECT gap_count, {LADDER} AS frequency FROM m""",
    "median_gap_by_type": f"""
WITH {SERIES_BY_TYPE},
g AS (SELECT tag_id, {GAP.format(key='tag_id')} AS gap FROM series)
SELECT tag_id, round(median(gap), 6) AS median_gap FROM g WHERE gap IS NOT NULL GROUP BY tag_id""",
    "gap_quantiles_by_user": f"""
WITH {SERIES_BY_USER},
g AS (SELECT tag_id, {GAP.format(key='tag_id')} AS gap FROM series)
SELECT tag_id, count(*) AS gap_count, round(quantile_cont(gap, 0.1), 6) AS p10, round(quantile_cont(gap, 0.5), 6) AS p50,
       round(quantile_cont(gap, 0.9), 6) AS p90
FROM g WHERE gap IS NOT NULL GROUP BY tag_id""",
})

# --- wide-sheet ingest ------------------------------------------------------------

SHEET = f"""{TYPE_TAGS},
hours AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, value FROM events),
cells AS (
  SELECT event_type AS tag_name, hour AS timestamp, CAST(max(value) AS VARCHAR) AS value FROM hours GROUP BY 1, 2
  UNION ALL
  SELECT 'total', hour, CAST(count(*) AS VARCHAR) FROM hours GROUP BY 2),
sheet_names AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT 'spare' UNION SELECT 'total'),
file_freq AS (
  SELECT {LADDER} AS frequency FROM (
    SELECT median(gap) AS m FROM (
      SELECT (epoch_us(hour) - epoch_us(lag(hour) OVER (ORDER BY hour))) / 1e6 AS gap
      FROM (SELECT DISTINCT hour FROM hours)))),
new_tags AS (
  SELECT CAST((SELECT max(id) FROM type_tags) + row_number() OVER (ORDER BY name) AS INTEGER) AS id, name
  FROM sheet_names WHERE name NOT IN (SELECT name FROM type_tags)),
tags_after AS (SELECT id, name, false AS is_new FROM type_tags UNION ALL SELECT id, name, true FROM new_tags),
stored AS (
  SELECT t.id AS tag_id, e.ts AS timestamp FROM events e JOIN type_tags t ON e.event_type = t.name)"""

TYPE_FREQ = f"""{SERIES_BY_TYPE},
g AS (SELECT tag_id, {GAP.format(key='tag_id')} AS gap FROM series),
freq AS (SELECT tag_id, (SELECT {LADDER} FROM (SELECT median(gap) AS m)) AS frequency FROM g GROUP BY tag_id)"""

HOURLY_USER_ROWS = f"""rows AS (
  SELECT CAST(user_id AS INTEGER) AS tag_id, date_trunc('hour', ts) AS timestamp, {READING} AS value,
         event_id AS src_row FROM events)"""

MERGE_INPUTS = f"""{HOURLY_USER_ROWS},
target AS (SELECT tag_id, timestamp, arg_min(value, src_row) AS value, min(src_row) AS src_row
           FROM rows WHERE timestamp < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2),
batch AS (SELECT * FROM rows WHERE timestamp >= TIMESTAMP '2024-01-15 00:00:00')"""

ORACLE.update({
    "sheet_melt": f"WITH {SHEET} SELECT tag_name, timestamp, value FROM cells",
    "sheet_inserted": f"""
WITH {SHEET}
SELECT t.id AS tag_id, c.timestamp, c.value, (SELECT frequency FROM file_freq) AS frequency, 'GOOD' AS quality
FROM cells c JOIN tags_after t ON c.tag_name = t.name
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.tag_id = t.id AND s.timestamp = c.timestamp)""",
    "sheet_tags": f"""
WITH {SHEET}
SELECT t.name, t.id, t.is_new,
       CASE WHEN t.is_new AND t.name IN (SELECT DISTINCT event_type FROM events) THEN 'Event type ' || t.name
            WHEN t.is_new THEN 'Sensor data collected at ' || (SELECT frequency FROM file_freq) || ' intervals'
       END AS description,
       CASE WHEN t.is_new AND t.name = 'total' THEN 'count' END AS unit_of_measure
FROM tags_after t WHERE t.name IN (SELECT name FROM sheet_names)""",
    "sheet_counters": f"""
WITH {SHEET},
n AS (SELECT count(DISTINCT hour) AS row_count FROM hours),
k AS (SELECT count(*) AS names FROM sheet_names),
c AS (SELECT count(*) AS filled, count(*) FILTER (WHERE TRY_CAST(value AS DOUBLE) = 0) AS zeros FROM cells)
SELECT n.row_count, n.row_count * k.names AS total_values, c.zeros AS zero_values,
       n.row_count * k.names - c.filled AS nan_values, CAST(0 AS BIGINT) AS none_values,
       CAST(0 AS BIGINT) AS missing_tag_values, c.filled AS prepared_records,
       n.row_count * k.names AS expected_records
FROM n, k, c""",
    "sheet_conflicts": f"""
WITH {TYPE_FREQ},
span AS (SELECT min(time_bucket(INTERVAL '1 hour', ts)) AS lo, max(time_bucket(INTERVAL '1 hour', ts)) AS hi FROM events),
per_tag AS (
  SELECT t.name, list_sort(list(DISTINCT f.frequency)) AS freqs
  FROM series s JOIN freq f ON s.tag_id = f.tag_id JOIN type_tags t ON t.id = s.tag_id, span
  WHERE s.timestamp BETWEEN span.lo AND span.hi GROUP BY t.name)
SELECT name AS tag_name, list_min(freqs) AS existing_frequency, array_to_string(freqs, ',') AS existing_frequencies,
       'hour' AS new_frequency
FROM per_tag WHERE NOT list_contains(freqs, 'hour')""",
    "missing_tags": """
SELECT name FROM (SELECT DISTINCT event_type AS name FROM events UNION SELECT 'spare' UNION SELECT 'total')
EXCEPT SELECT DISTINCT event_type FROM events""",
    "keep_first": f"""
WITH {HOURLY_USER_ROWS}
SELECT tag_id, timestamp, arg_min(value, src_row) AS value, min(src_row) AS src_row FROM rows GROUP BY 1, 2""",
    "merge_append": f"""
WITH {MERGE_INPUTS},
first AS (SELECT tag_id, timestamp, arg_min(value, src_row) AS value, min(src_row) AS src_row FROM batch GROUP BY 1, 2)
SELECT tag_id, timestamp, value, src_row FROM target
UNION ALL
SELECT f.tag_id, f.timestamp, f.value, f.src_row FROM first f
WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.tag_id = f.tag_id AND t.timestamp = f.timestamp)""",
    "duplicate_flags": f"""
WITH {MERGE_INPUTS}
SELECT b.tag_id, b.timestamp, b.src_row,
       EXISTS (SELECT 1 FROM target t WHERE t.tag_id = b.tag_id AND t.timestamp = b.timestamp) AS is_duplicate,
       CASE WHEN EXISTS (SELECT 1 FROM target t WHERE t.tag_id = b.tag_id AND t.timestamp = b.timestamp)
            THEN 'Duplicate entry detected.' END AS reason
FROM batch b""",
})

# --- hierarchy ---------------------------------------------------------------------------

from ferrule.functions.text import ABBREVIATIONS, ICON_KEYWORDS  # noqa: E402

CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def _display_name_sql(x: str) -> str:
    t = f"translate({x}, '_-', '  ')"
    out = (f"array_to_string(list_transform(regexp_extract_all({t}, '([{CASED}]+|[^{CASED}]+)'), "
           f"lambda s: CASE WHEN regexp_matches(s, '^[{CASED}]') THEN upper(s[1]) || lower(s[2:]) ELSE s END), '')")
    for src, dst in ABBREVIATIONS:
        out = f"replace({out}, '{src}', '{dst}')"
    return out


def _icon_sql(x: str) -> str:
    whens = " ".join(f"WHEN contains(lower({x}), '{kw}') THEN '{icon}'" for kw, icon in ICON_KEYWORDS)
    return f"CASE {whens} ELSE 'file' END"


CUSTOMER_NODES = f"""paths AS (
  SELECT c_custkey AS src_row, concat_ws(':', r_name, n_name, c_mktsegment) AS path
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
parts AS (
  SELECT src_row, list_filter(list_transform(string_split(coalesce(path, ''), ':'),
                                             lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p
  FROM paths),
subs AS (SELECT src_row, p, generate_subscripts(p, 1) AS i FROM parts),
raw_nodes AS (
  SELECT src_row, i - 1 AS lvl, p[i] AS label, array_to_string(p[1:i], ':') AS path,
         CASE WHEN i > 1 THEN p[i - 1] END AS parent_label FROM subs),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY src_row, lvl) AS rn FROM raw_nodes)
  WHERE rn = 1),
nodes AS (
  SELECT label, path, parent_label, CAST(row_number() OVER (ORDER BY src_row, lvl) - 1 AS INTEGER) AS display_order,
         {_display_name_sql('label')} AS display_name, {_icon_sql('label')} AS icon
  FROM firsts)"""

SUPPLIER_CFG = """cfg AS (
  SELECT s_name AS label, n_name || ':' || CAST(s_suppkey % 40 AS VARCHAR) AS path,
         printf('Supplier#%09d', ((s_suppkey * 37 + 11) % 113) + 1) AS parent_label,
         CAST(s_suppkey AS INTEGER) AS display_order, s_acctbal >= 0 AS is_active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

INTEGRITY = f"""RECURSIVE {SUPPLIER_CFG},
act AS (SELECT * FROM cfg WHERE is_active),
nxt AS (SELECT label, parent_label AS nxt FROM (
          SELECT label, parent_label, row_number() OVER (PARTITION BY label ORDER BY path) AS rn FROM act)
        WHERE rn = 1),
bound AS (SELECT count(*) + 1 AS b FROM nxt),
walk(label, path, parent_label, cur, steps) AS (
  SELECT label, path, parent_label, parent_label, 0 FROM act WHERE parent_label IS NOT NULL
  UNION ALL
  SELECT w.label, w.path, w.parent_label, n.nxt, w.steps + 1
  FROM walk w JOIN nxt n ON n.label = w.cur
  WHERE w.cur <> w.label AND n.nxt IS NOT NULL AND w.steps < (SELECT b FROM bound)),
issues AS (
  SELECT 'orphaned_records' AS issue_type, h1.label, h1.parent_label, h1.path, CAST(1 AS BIGINT) AS count
  FROM cfg h1 WHERE h1.parent_label IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM cfg h2 WHERE h2.label = h1.parent_label)
  UNION ALL
  SELECT DISTINCT 'circular_reference', label, parent_label, path, CAST(1 AS BIGINT)
  FROM walk WHERE cur = label OR steps >= (SELECT b FROM bound)
  UNION ALL
  SELECT 'duplicate_paths', NULL, NULL, path, count(*) FROM cfg GROUP BY path HAVING count(*) > 1)"""

ORACLE.update({
    "hierarchy_nodes": f"WITH {CUSTOMER_NODES} SELECT * FROM nodes",
    "hierarchy_summary": f"""
WITH {CUSTOMER_NODES}
SELECT count(*) AS total_rows, count(*) FILTER (WHERE len(p) > 0) AS valid_paths,
       count(*) FILTER (WHERE len(p) = 0) AS invalid_paths FROM parts""",
    "hierarchy_children": f"""
WITH {CUSTOMER_NODES}
SELECT parent_label, label AS child_label, path AS child_path, display_order AS child_order
FROM nodes WHERE parent_label IS NOT NULL""",
    "hierarchy_tree": f"""
WITH {CUSTOMER_NODES},
kids AS (SELECT regexp_replace(path, ':[^:]*$', '') AS node_path, label AS child_label, path AS child_path,
                display_order AS child_order FROM nodes WHERE contains(path, ':'))
SELECT n.path AS node_path, n.label AS node_label, n.parent_label IS NULL AS is_root,
       k.child_label, k.child_path, k.child_order
FROM nodes n LEFT JOIN kids k ON k.node_path = n.path
WHERE n.parent_label IS NULL OR k.child_path IS NOT NULL""",
    "hierarchy_descendants": f"""
WITH RECURSIVE {CUSTOMER_NODES},
d(root_label, label, path, depth) AS (
  SELECT r.label, c.label, c.path, 1 FROM (SELECT DISTINCT label FROM nodes) r
  JOIN nodes c ON c.parent_label = r.label
  UNION
  SELECT d.root_label, c.label, c.path, d.depth + 1 FROM d JOIN nodes c ON c.parent_label = d.label
  WHERE d.depth < (SELECT count(*) FROM nodes))
SELECT root_label, label, path, CAST(min(depth) AS INTEGER) AS depth FROM d GROUP BY 1, 2, 3""",
    "hierarchy_active": f"""
WITH {SUPPLIER_CFG}
SELECT label, path, parent_label, display_order FROM cfg WHERE is_active
ORDER BY display_order, path""",
    "hierarchy_integrity": f"WITH {INTEGRITY} SELECT * FROM issues",
    "hierarchy_integrity_summary": f"""
WITH {INTEGRITY}
SELECT (SELECT count(*) FROM act) AS total_records,
       count(*) FILTER (WHERE issue_type = 'orphaned_records') AS orphaned,
       count(*) FILTER (WHERE issue_type = 'circular_reference') AS circular,
       count(*) FILTER (WHERE issue_type = 'duplicate_paths') AS duplicate_paths,
       count(*) = 0 AS is_valid
FROM issues""",
    "display_names": f"""
WITH texts AS (SELECT url AS text FROM pages UNION ALL SELECT p_name FROM part)
SELECT text, {_display_name_sql('text')} AS display_name, {_icon_sql('text')} AS icon,
       regexp_replace(text, '[^\\p{{L}}\\p{{N}}_-]', '', 'g') AS icon_name
FROM texts""",
})

# --- access ------------------------------------------------------------------------------

from ferrule.operators.access import PERMISSION_NAMES  # noqa: E402
from ferrule.sources.adapters import ROLE_GRANTS  # noqa: E402

_PERM_ROWS = ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(PERMISSION_NAMES))
_GRANT_ROWS = ", ".join(f"('{r}', '{p}')" for r, ps in ROLE_GRANTS.items() for p in ps)

ACCESS = f"""users AS (SELECT c_custkey AS id, c_acctbal >= 0 AS is_active FROM customer),
plants AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey <> 4 AS is_active FROM nation),
roles AS (SELECT CAST(dense_rank() OVER (ORDER BY name) AS INTEGER) AS id, name
          FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)),
permissions AS (SELECT * FROM (VALUES {_PERM_ROWS}) v(id, name)),
grants AS (SELECT * FROM (VALUES {_GRANT_ROWS}) v(role, perm)),
role_permissions AS (
  SELECT r.id AS role_id, p.id AS permission_id FROM grants g JOIN roles r ON r.name = g.role
  JOIN permissions p ON p.name = g.perm),
cust_role AS (SELECT c_custkey, c_nationkey, r.id AS global_role_id FROM customer JOIN roles r ON r.name = c_mktsegment),
upa AS (
  SELECT o_custkey AS user_id, s_nationkey AS plant_id, bool_or(o_orderstatus = 'O') AS is_active,
         any_value(cr.global_role_id) AS global_role_id
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN cust_role cr ON cr.c_custkey = o_custkey GROUP BY 1, 2),
oc AS (SELECT o.*, cr.c_nationkey FROM orders o JOIN cust_role cr ON o.o_custkey = cr.c_custkey),
workspaces AS (
  SELECT CAST(c_nationkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS id,
         n_name || ' / ' || o_orderpriority AS name, min(o_custkey) AS owner_id, c_nationkey AS plant_id,
         o_orderpriority <> '5-LOW' AS is_active
  FROM oc JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey, o_orderpriority, n_name),
members AS (
  SELECT DISTINCT CAST(c_nationkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS workspace_id,
         o_custkey AS user_id FROM oc),
cards AS (
  SELECT l_orderkey * 8 + l_linenumber AS id,
         CAST(c_nationkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS workspace_id,
         o_custkey AS user_id, is_active
  FROM (SELECT l_orderkey, l_linenumber, bool_and(l_returnflag <> 'R') AS is_active FROM lineitem GROUP BY 1, 2) l
  JOIN oc ON l_orderkey = o_orderkey),
perms AS (
  SELECT DISTINCT upa.user_id, upa.plant_id, p.name AS permission FROM upa
  JOIN role_permissions rp ON rp.role_id = upa.global_role_id JOIN permissions p ON p.id = rp.permission_id
  WHERE upa.is_active),
pa AS (SELECT DISTINCT upa.user_id, upa.plant_id FROM upa JOIN plants p ON p.id = upa.plant_id
       WHERE upa.is_active AND p.is_active),
roles_ws AS (
  SELECT user_id, workspace_id, bool_or(o) AS is_owner, bool_or(m) AS is_member FROM (
    SELECT owner_id AS user_id, id AS workspace_id, true AS o, false AS m FROM workspaces WHERE is_active
    UNION ALL
    SELECT m.user_id, m.workspace_id, false, true FROM members m JOIN workspaces w ON w.id = m.workspace_id
    WHERE w.is_active) GROUP BY 1, 2),
accessible AS (
  SELECT r.user_id, w.plant_id, r.workspace_id, w.name, w.owner_id,
         CASE WHEN r.is_owner THEN 'owner' ELSE 'member' END AS user_role
  FROM roles_ws r JOIN workspaces w ON w.id = r.workspace_id AND w.is_active
  WHERE EXISTS (SELECT 1 FROM pa WHERE pa.user_id = r.user_id AND pa.plant_id = w.plant_id)
    AND EXISTS (SELECT 1 FROM users u WHERE u.id = r.user_id AND u.is_active))"""

FALLBACK = """req AS (SELECT DISTINCT o_custkey AS user_id, CAST(c_nationkey * 10 + 1 AS INTEGER) AS workspace_id,
               c_nationkey AS plant_id FROM oc),
judged AS (
  SELECT req.*, EXISTS (SELECT 1 FROM accessible a WHERE a.user_id = req.user_id AND a.plant_id = req.plant_id
                        AND a.workspace_id = req.workspace_id) AS has_access FROM req)"""

ORACLE.update({
    "access_permissions": f"WITH {ACCESS} SELECT user_id, plant_id, permission FROM perms",
    "access_any_plant": f"WITH {ACCESS} SELECT DISTINCT user_id, permission FROM perms",
    "plant_access": f"WITH {ACCESS} SELECT user_id, plant_id FROM pa",
    "active_plants": f"WITH {ACCESS} SELECT id, name FROM plants WHERE is_active ORDER BY name, id",
    "accessible_workspaces": f"WITH {ACCESS} SELECT * FROM accessible",
    "workspace_fallback": f"""
WITH {ACCESS}, {FALLBACK}
SELECT j.user_id, j.plant_id, j.workspace_id, j.has_access,
       CASE WHEN j.has_access THEN 0 ELSE coalesce(n.cnt, 0) END AS alternatives
FROM judged j LEFT JOIN (SELECT user_id, plant_id, count(*) AS cnt FROM accessible GROUP BY 1, 2) n
  ON n.user_id = j.user_id AND n.plant_id = j.plant_id""",
    "workspace_alternatives": f"""
WITH {ACCESS}, {FALLBACK}
SELECT j.user_id, j.plant_id, j.workspace_id, a.workspace_id AS available_workspace_id
FROM judged j JOIN accessible a ON a.user_id = j.user_id AND a.plant_id = j.plant_id
WHERE NOT j.has_access""",
    "card_access": f"""
WITH {ACCESS},
req AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS card_id, l_suppkey AS user_id FROM lineitem),
j AS (
  SELECT req.card_id, req.user_id, c.user_id AS card_owner, c.is_active AS card_active,
         r.workspace_id IS NOT NULL AS ws,
         EXISTS (SELECT 1 FROM perms p WHERE p.user_id = req.user_id AND p.permission = 'view_any_user_cards') AS perm
  FROM req LEFT JOIN cards c ON c.id = req.card_id
  LEFT JOIN roles_ws r ON r.user_id = req.user_id AND r.workspace_id = c.workspace_id),
v AS (
  SELECT card_id, user_id, CASE WHEN card_owner = user_id THEN 'owner' WHEN ws AND card_active THEN 'workspace'
                                WHEN perm THEN 'permission' END AS reason FROM j)
SELECT card_id, user_id, reason IS NOT NULL AS allowed, reason FROM v""",
})

# --- storage, retention, streaming --------------------------------------------------------

from ferrule.operators.frequency import CHUNK_INTERVALS, ROLLUP_TABLES  # noqa: E402
from ferrule.sources.tables import DRIVER_TABLES  # noqa: E402

_CHUNK_CASE = "CASE frequency " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHUNK_INTERVALS.items()) + \
    " ELSE '30 days' END"
_ROLLUP_CASE = "CASE frequency " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLLUP_TABLES.items()) + \
    " ELSE 'time_bucket_day' END"

RETAINED = """time_bucket(INTERVAL '30 days', timestamp) + INTERVAL '30 days'
  > TIMESTAMP '1998-12-01 00:00:00' - INTERVAL '3 months'"""

ORACLE.update({
    "layout_range_read": f"WITH {SERIES_BY_TYPE} SELECT tag_id, timestamp, value FROM series WHERE {RANGE}",
    "retention_kept": f"""
WITH {SERIES_BY_SUPPLIER}
SELECT tag_id, count(*) AS kept_rows, min(timestamp) AS first_kept FROM series WHERE {RETAINED} GROUP BY tag_id""",
    "retention_dropped": f"""
WITH {SERIES_BY_SUPPLIER}
SELECT DISTINCT time_bucket(INTERVAL '30 days', timestamp) AS chunk_start FROM series WHERE NOT ({RETAINED})""",
    "chunk_policy": f"""
WITH f AS ({_frequency(SERIES_BY_USER)})
SELECT tag_id, frequency, {_CHUNK_CASE} AS chunk_interval, {_ROLLUP_CASE} AS rollup_table FROM f""",
    "table_row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in DRIVER_TABLES),
    "daily_rollup_stream": f"""
WITH {SERIES_BY_TYPE}
SELECT tag_id, time_bucket(INTERVAL '1 day', timestamp) AS bucket, round({AVG}, 6) AS avg_value,
       count(*) AS sample_count
FROM series GROUP BY 1, 2""",
    "daily_rollup_closed": f"""
WITH {SERIES_BY_TYPE},
wm AS (SELECT max(timestamp) - INTERVAL '1 hour' AS w FROM series)
SELECT tag_id, time_bucket(INTERVAL '1 day', timestamp) AS bucket, round({AVG}, 6) AS avg_value,
       count(*) AS sample_count
FROM series GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 day', timestamp) + INTERVAL '1 day' <= (SELECT w FROM wm)""",
    "keep_first_stream": ORACLE["keep_first"],
})

ORACLE.update({
    "icon_inventory": """
SELECT regexp_replace(replace('page_' || CAST(page_id AS VARCHAR) || '.svg', '.svg', ''), '_[^_]*$', '') AS icon_name,
       'page_' || CAST(page_id AS VARCHAR) || '.svg' AS file_name, CAST(strlen(html) AS BIGINT) AS file_size,
       to_base64(encode(html)) AS svg_base64
FROM pages""",
})

# --- remaining maintenance / validation operators ------------------------------------------

from ferrule.sources.adapters import TYPE_LIMITS  # noqa: E402

_LIMIT_ROWS = ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in TYPE_LIMITS)
_K4 = "floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 25)"
_FORMATS_SQL = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y")

ORACLE.update({
    "range_check": f"""
WITH {SERIES_BY_TYPE},
limits AS (SELECT * FROM (VALUES {_LIMIT_ROWS}) v(tag_name, lo, hi))
SELECT t.name AS tag_name, s.timestamp, s.value,
       'Value ' || s.value || ' is outside the allowed range (' ||
       regexp_replace(CAST(l.lo AS VARCHAR), '\\.0$', '') || ' - ' ||
       regexp_replace(CAST(l.hi AS VARCHAR), '\\.0$', '') || ')' AS reason
FROM series s JOIN type_tags t ON t.id = s.tag_id JOIN limits l ON l.tag_name = t.name
WHERE {NUM.replace('value', 's.value')} < l.lo OR {NUM.replace('value', 's.value')} > l.hi""",
    "timestamp_normalize": f"""
WITH t AS (
  SELECT event_id, CASE WHEN {_K4} = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                        WHEN {_K4} = 1 THEN strftime(ts, '%-d/%-m/%Y %H:%M:%S')
                        WHEN {_K4} = 2 THEN strftime(ts, '%-m/%-d/%Y')
                        ELSE strftime(ts, '%Y-%m-%d') END AS text
  FROM events)
SELECT event_id, text,
       strftime(coalesce({', '.join(f"try_strptime(text, '{f}')" for f in _FORMATS_SQL)}), '%Y-%m-%d %H:%M:%S')
         AS normalized
FROM t""",
    "default_sources": """
WITH src AS (
  SELECT CAST(s_suppkey AS INTEGER) AS id, CAST(s_nationkey AS INTEGER) AS plant_id, s_acctbal >= 0 AS is_active,
         TIMESTAMP '2020-01-01 00:00:00' + to_minutes(CAST((s_suppkey * 7919) % 1000 AS BIGINT)) AS created_at
  FROM supplier),
have AS (
  SELECT plant_id, id AS data_source_id FROM (
    SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY created_at, id) AS rn FROM src WHERE is_active)
  WHERE rn = 1),
need AS (SELECT n_nationkey AS plant_id FROM nation WHERE n_nationkey NOT IN (SELECT plant_id FROM have))
SELECT plant_id, data_source_id, false AS created, NULL AS type, NULL AS name, NULL AS description,
       CAST(NULL AS TIMESTAMP) AS created_at FROM have
UNION ALL
SELECT plant_id, CAST((SELECT max(id) FROM src) + row_number() OVER (ORDER BY plant_id) AS INTEGER), true, 'file',
       'Default File Upload', 'Default source for file uploads', TIMESTAMP '2024-01-01 00:00:00' FROM need""",
    "hierarchy_update": f"""
WITH {CUSTOMER_NODES}
SELECT n.label, n.path, n.parent_label, n.display_order,
       coalesce('Nation ' || CAST(x.n_nationkey AS VARCHAR), n.display_name) AS display_name,
       CASE WHEN x.n_nationkey = 0 THEN NULL WHEN x.n_name IS NOT NULL THEN 'flag' ELSE n.icon END AS icon
FROM nodes n LEFT JOIN nation x ON x.n_name = n.label""",
    "hierarchy_delete_cascade": f"""
WITH RECURSIVE {CUSTOMER_NODES},
gone(label, path) AS (
  SELECT label, path FROM nodes WHERE label IN (SELECT n_name FROM nation)
  UNION
  SELECT c.label, c.path FROM gone g JOIN nodes c ON c.parent_label = g.label)
SELECT label, path, parent_label FROM nodes WHERE (label, path) NOT IN (SELECT (label, path) FROM gone)""",
    "hierarchy_replace": f"""
WITH {CUSTOMER_NODES}, {SUPPLIER_CFG}
SELECT CASE WHEN length(path) % 3 > 0 THEN length(path) % 3 END AS plant_id, label, path FROM cfg
WHERE length(path) % 3 <> 1
UNION ALL SELECT 1, label, path FROM nodes""",
    "rekey_collisions": f"""
WITH {SERIES_BY_SUPPLIER}
SELECT tag_id, timestamp, count(*) AS rows FROM series GROUP BY 1, 2 HAVING count(*) > 1""",
    "unknown_tags": f"""
WITH {SHEET}
SELECT tag_name, count(*) AS rows FROM cells WHERE tag_name NOT IN (SELECT name FROM type_tags) GROUP BY 1""",
    "workspace_roles": f"WITH {ACCESS} SELECT * FROM roles_ws",
})

ORACLE["daily_rollup_refresh"] = f"""
WITH {SERIES_BY_USER}
SELECT tag_id, time_bucket(INTERVAL '1 day', timestamp) AS bucket, round({AVG}, 6) AS avg_value,
       count(*) AS sample_count
FROM series
WHERE timestamp >= time_bucket(INTERVAL '1 day', TIMESTAMP '2024-01-20 12:00:00' - INTERVAL '1 month')
  AND timestamp < time_bucket(INTERVAL '1 day', TIMESTAMP '2024-01-20 12:00:00' - INTERVAL '1 hour')
GROUP BY 1, 2"""

# The folder of user sheets: ten users a sheet, readings at whole seconds; users divisible by four have no stored tag.
USER_SHEETS = f"""cells AS (
  SELECT CAST(user_id // 10 AS INTEGER) AS sheet, user_id, 'user_' || user_id AS tag_name, date_trunc('second', ts) AS timestamp,
         CAST(value AS VARCHAR) AS value, event_id FROM events),
sheets AS (SELECT sheet, count(*) AS lines, count(*) FILTER (WHERE user_id % 4 <> 0) AS known_cells,
                  count(*) FILTER (WHERE user_id % 4 <> 0 AND CAST(value AS DOUBLE) = 0) AS zeros FROM cells GROUP BY sheet),
gaps AS (SELECT sheet, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY sheet ORDER BY timestamp)) AS us FROM cells),
labels AS (SELECT sheet, {LADDER} AS frequency FROM (SELECT sheet, median(us / 1e6) AS m FROM gaps GROUP BY sheet)),
members AS (SELECT sheet, sheet * 10 + i AS user_id FROM sheets, range(10) AS r(i)),
stored_tags AS (SELECT DISTINCT user_id FROM events WHERE user_id % 4 <> 0)"""

ORACLE["sheet_folder_melt"] = f"WITH {USER_SHEETS} SELECT sheet, tag_name, timestamp, value FROM cells"

ORACLE["sheet_folder_inserted"] = f"""
WITH {USER_SHEETS},
firsts AS (SELECT sheet, user_id, tag_name, timestamp, arg_min(value, event_id) AS value FROM cells GROUP BY ALL)
SELECT tag_name, timestamp, value, frequency, 'GOOD' AS quality FROM firsts JOIN labels USING (sheet)
WHERE user_id % 4 = 0 OR NOT EXISTS (
  SELECT 1 FROM events e WHERE e.user_id = firsts.user_id AND day(e.ts) <= 3 AND date_trunc('second', e.ts) = firsts.timestamp)"""

ORACLE["sheet_folder_counters"] = f"""
WITH {USER_SHEETS},
known AS (SELECT sheet, count(*) FILTER (WHERE user_id IN (SELECT user_id FROM stored_tags)) AS names FROM members GROUP BY sheet)
SELECT sheet, lines AS row_count, lines * names AS total_values, zeros AS zero_values, lines * names - known_cells AS nan_values,
       lines * (10 - names) AS missing_tag_values, known_cells AS prepared_records, lines * 10 AS expected_records
FROM sheets JOIN known USING (sheet)"""

ORACLE["sheet_folder_tags"] = f"""
WITH {USER_SHEETS}
SELECT 'user_' || user_id AS name, 'kept' AS description, CAST(NULL AS VARCHAR) AS unit_of_measure FROM stored_tags
UNION ALL
SELECT 'user_' || user_id,
       CASE WHEN user_id % 3 = 0 THEN 'Sensor data collected at ' || frequency || ' intervals'
            ELSE 'Readings,' || chr(10) || 'of "user" ' || user_id END,
       CASE WHEN user_id % 2 = 0 THEN 'units' END
FROM members JOIN labels USING (sheet) WHERE user_id NOT IN (SELECT user_id FROM stored_tags)"""

ORACLE["summary_upload_history"] = ORACLE["upload_history"]

ORACLE["latest_of_layout"] = f"""
WITH {SERIES_BY_USER} SELECT tag_id, timestamp, value FROM series WHERE {RANGE} ORDER BY timestamp DESC, tag_id LIMIT 100"""

ORACLE["summary_counts"] = f"""
WITH {SERIES_BY_USER}
SELECT tag_id, count(*) AS rows, min(timestamp) AS first, max(timestamp) AS last FROM series GROUP BY 1"""

ORACLE["summary_conflicts"] = f"""
WITH {TYPE_FREQ}
SELECT t.name AS tag_name, list_min(list(f.frequency)) AS existing_frequency,
       array_to_string(list_sort(list(DISTINCT f.frequency)), ',') AS existing_frequencies, 'hour' AS new_frequency
FROM freq f JOIN type_tags t ON t.id = f.tag_id GROUP BY t.name HAVING NOT list_contains(list(f.frequency), 'hour')"""

_CASCADE = {"time_bucket_second": "1 second", "time_bucket_minute": "1 minute", "time_bucket_hour": "1 hour", "time_bucket_day": "1 day",
            "time_bucket_week": "7 days", "time_bucket_month": "1 month", "time_bucket_year": "1 year"}


def _level(table: str) -> str:
    return f"""
SELECT '{table}' AS rollup, tag_id, time_bucket(INTERVAL '{_CASCADE[table]}', timestamp) AS bucket, round({AVG}, 6) AS avg_value,
       round(min({NUM}), 6) AS min_value, round(max({NUM}), 6) AS max_value,
       (min({{'t': timestamp, 'v': {NUM}}}) FILTER (WHERE {NUM} IS NOT NULL)).v AS first_raw,
       (max({{'t': timestamp, 'v': {NUM}}}) FILTER (WHERE {NUM} IS NOT NULL)).v AS last_raw, count(*) AS sample_count
FROM series GROUP BY 1, 2, 3"""


_ROLLUP_COLUMNS = """tag_id, bucket, avg_value, min_value, max_value, round(first_raw, 6) AS first_value,
       round(last_raw, 6) AS last_value, sample_count"""

ORACLE["rollup_cascade"] = f"""
WITH {SERIES_BY_TYPE},
levels AS ({" UNION ALL ".join(_level(t) for t in _CASCADE if t != "time_bucket_second")})
SELECT rollup, {_ROLLUP_COLUMNS} FROM levels"""

ORACLE["rollup_of_frequency"] = f"""
WITH {SERIES_BY_TYPE},
levels AS ({" UNION ALL ".join(_level(t) for t in _CASCADE)}),
file AS ({ORACLE["frequency_of_file"]})
SELECT frequency, {_ROLLUP_COLUMNS} FROM levels, file
WHERE rollup = CASE frequency WHEN 'sub_second' THEN 'time_bucket_second' WHEN 'second' THEN 'time_bucket_minute'
  WHEN 'minute' THEN 'time_bucket_hour' WHEN 'hour' THEN 'time_bucket_day' WHEN 'day' THEN 'time_bucket_week'
  WHEN 'week' THEN 'time_bucket_month' ELSE 'time_bucket_day' END"""

ORACLE["rollup_follows_changes"] = f"""
WITH {SERIES_BY_USER},
kept AS (
  SELECT tag_id, timestamp, value FROM series
  WHERE tag_id % 5 = 0 OR NOT ((tag_id % 3 = 0 AND day(timestamp) BETWEEN 5 AND 8) OR day(timestamp) = 10
                     OR (day(timestamp) = 25 AND tag_id % 2 = 0)))
SELECT tag_id, time_bucket(INTERVAL '1 day', timestamp) AS bucket, round({AVG}, 6) AS avg_value, count(*) AS sample_count
FROM kept WHERE timestamp < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1, 2"""

ORACLE["hierarchy_upload"] = f"""
WITH {CUSTOMER_NODES}, {SUPPLIER_CFG}
SELECT count(*) AS total_rows, count(*) FILTER (WHERE len(p) > 0) AS valid_paths,
       count(*) FILTER (WHERE len(p) = 0) AS invalid_paths,
       (SELECT count(*) FROM cfg) AS deleted, (SELECT count(*) FROM nodes) AS created
FROM parts"""

ORACLE["layout_merge"] = f"""
WITH {MERGE_INPUTS},
first AS (SELECT tag_id, timestamp, arg_min(value, src_row) AS value FROM batch GROUP BY 1, 2)
SELECT tag_id, timestamp, value FROM target
UNION ALL
SELECT f.tag_id, f.timestamp, f.value FROM first f
WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.tag_id = f.tag_id AND t.timestamp = f.timestamp)"""

ORACLE.update({name: "SELECT * FROM customer" for name in ("records_csv", "records_json", "records_xml")})

ORACLE.update({
    "split_files": "SELECT count(*) AS total_rows, true AS within_limit FROM lineitem",
    "compaction": f"""
WITH {SERIES_BY_SUPPLIER}
SELECT tag_id, timestamp, value FROM series""",
})

ORACLE.update({
    "legacy_permissions": f"""
WITH {ACCESS}
SELECT cr.c_custkey AS user_id, p.name AS permission FROM cust_role cr
JOIN role_permissions rp ON rp.role_id = cr.global_role_id JOIN permissions p ON p.id = rp.permission_id""",
    "user_roles": f"""
WITH {ACCESS}
SELECT cr.c_custkey AS user_id, cr.global_role_id AS role_id, r.name AS role_name
FROM cust_role cr JOIN roles r ON r.id = cr.global_role_id""",
})

ORACLE["permission_checks"] = f"""
WITH {ACCESS},
req AS (SELECT DISTINCT user_id, plant_id, 'view_any_user_cards' AS permission FROM upa)
SELECT r.user_id, r.plant_id, r.permission,
       CASE WHEN r.plant_id IS NULL
            THEN EXISTS (SELECT 1 FROM perms p WHERE p.user_id = r.user_id AND p.permission = r.permission)
            ELSE EXISTS (SELECT 1 FROM perms p WHERE p.user_id = r.user_id AND p.plant_id = r.plant_id
                         AND p.permission = r.permission) END AS allowed
FROM req r"""


ICON_FILES = """kinds AS (
  SELECT page_id, page_id % 9 AS kind, CAST(page_id AS VARCHAR) AS page FROM pages
), files AS (
  SELECT kind, page, page_id,
         'icon_' || page || CASE kind WHEN 1 THEN '.png' WHEN 8 THEN '.SVG' ELSE '.svg' END AS file_name,
         replace(CASE kind
           WHEN 1 THEN '<svg><text>page #</text></svg>'
           WHEN 2 THEN '<svg><!--' || repeat(' ', 64) || '--><text>page #</text></svg>'
           WHEN 3 THEN '<svg><text>page #</svg>'
           WHEN 4 THEN '<div>page #</div>'
           WHEN 5 THEN '<svg><SCRIPT>page #</SCRIPT></svg>'
           WHEN 6 THEN '<svg onload="go()"><rect id="r#" onClick="stop()"/>page #</svg>'
           WHEN 7 THEN '<svg xmlns:x="urn:x"><x:script>bad <b>#</b></x:script>page #</svg>'
           WHEN 8 THEN '<svg><a href="#">1 &lt; 2</a><iframe2/></svg>'
           ELSE '<svg xmlns="http://www.w3.org/2000/svg"><text>page #</text></svg>' END, '#', page) AS body
  FROM kinds
), audited AS (
  SELECT *, length(body) + CASE WHEN page_id % 90 = 2 THEN 1025 * 1024 ELSE 0 END AS file_size,
         CASE WHEN kind = 1 THEN 'File must be an SVG file (.svg)'
              WHEN page_id % 90 = 2 THEN 'SVG file too large (max 1MB)'
              WHEN kind = 3 THEN 'Invalid XML/SVG format: mismatched tag: line 1, column ' || CAST(length('<svg><text>page </') + length(page) AS VARCHAR)
              WHEN kind = 4 THEN 'File does not contain valid SVG content'
              WHEN kind = 5 THEN 'SVG contains potentially dangerous element: script'
              WHEN kind = 8 THEN 'SVG contains potentially dangerous element: iframe' END AS error
  FROM files
)"""

ORACLE.update({
    "layout_mixed_widths": ORACLE["layout_range_read"],
    "merge_append_zone": ORACLE["merge_append"],
    "metrics_small_values": """
SELECT event_type, round(avg(v) * 1e9, 6) AS avg_value, round(max(v) * 1e9, 6) AS max_value
FROM (SELECT event_type, CAST('0.0000000000' || lpad(CAST(event_id % 9973 AS VARCHAR), 4, '0') AS DOUBLE) AS v FROM events)
GROUP BY 1""",
    "icon_audit_files": f"""
WITH {ICON_FILES}
SELECT file_name, error IS NULL AS is_valid, error, CAST(file_size AS BIGINT) AS file_size FROM audited""",
    "icon_clean": f"""
WITH {ICON_FILES}
SELECT file_name, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || replace(CASE kind
         WHEN 6 THEN '<svg xmlns="http://www.w3.org/2000/svg"><rect id="r#"/>page #</svg>'
         WHEN 7 THEN '<svg xmlns:x="urn:x" xmlns="http://www.w3.org/2000/svg"><x:script/>page #</svg>'
         ELSE '<svg xmlns="http://www.w3.org/2000/svg"><text>page #</text></svg>' END, '#', page) AS clean_svg
FROM audited WHERE error IS NULL""",
})

ORACLE.update({
    "hierarchy_all_nodes": f"WITH {SUPPLIER_CFG} SELECT label, path, parent_label, display_order, is_active FROM cfg",
    "hierarchy_lookup": f"""
WITH {CUSTOMER_NODES}
SELECT 'label' AS lookup, label, path, parent_label FROM nodes WHERE label = 'BUILDING'
UNION ALL
SELECT 'path', label, path, parent_label FROM nodes WHERE label = 'BUILDING' AND path = 'AFRICA:KENYA:BUILDING'""",
    "hierarchy_icons": f"""
WITH {CUSTOMER_NODES}
SELECT label, path, coalesce('/icons/' || lower(n_name) || '_' || CAST(n_nationkey AS VARCHAR) || '.svg', lower(label)) AS icon
FROM nodes LEFT JOIN nation ON lower(n_name) = lower(label)""",
    "plant_delete_all": f"""
WITH {SUPPLIER_CFG}
SELECT CASE WHEN length(path) % 3 > 0 THEN length(path) % 3 END AS plant_id, label, path FROM cfg WHERE length(path) % 3 <> 1""",
    "update_by_id": """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'part ' || CAST(p_partkey AS VARCHAR) ELSE p_name END AS p_name, p_size FROM part""",
    "table_columns": """
SELECT column_name, (SELECT count(*) FROM customer) AS row_count FROM (DESCRIBE customer)""",
    "import_tables": f"""
WITH {MERGE_INPUTS},
first AS (SELECT tag_id, timestamp, arg_min(value, src_row) AS value FROM batch GROUP BY 1, 2)
SELECT 'time_series' AS table_name, tag_id, timestamp, value FROM target
UNION ALL
SELECT 'time_series', f.tag_id, f.timestamp, f.value FROM first f
WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.tag_id = f.tag_id AND t.timestamp = f.timestamp)""",
    "records_json_array": "SELECT * FROM customer",
    "iso_range_output": f"""
WITH {SERIES_BY_TYPE} SELECT tag_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, value FROM series WHERE {RANGE}""",
    "tag_statistics_gapfilled": f"""
WITH {SERIES_BY_TYPE},
days AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-01-20', INTERVAL '1 day')) AS day),
found AS (
  SELECT tag_id, time_bucket(INTERVAL '1 day', timestamp) AS day, count(value) AS n, min(timestamp) AS lo, max(timestamp) AS hi
  FROM series WHERE timestamp BETWEEN TIMESTAMP '2023-12-25 06:00:00' AND TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2)
SELECT t.id AS tag_id, t.name, d.day, coalesce(f.n, 0) AS data_points, f.lo AS first_timestamp, f.hi AS last_timestamp
FROM type_tags t JOIN days d ON t.id IN (SELECT tag_id FROM found) LEFT JOIN found f ON f.tag_id = t.id AND f.day = d.day""",
    "tag_statistics_keep_empty": f"""
WITH {SERIES_BY_TYPE},
found AS (SELECT tag_id, time_bucket(INTERVAL '1 day', timestamp) AS day, count(value) AS n
          FROM series WHERE {RANGE} AND tag_id % 2 = 1 GROUP BY 1, 2)
SELECT t.id AS tag_id, t.name, f.day, coalesce(f.n, 0) AS data_points FROM type_tags t LEFT JOIN found f ON f.tag_id = t.id""",
    "card_access_admin": ORACLE["card_access"].replace(
        "SELECT card_id, user_id, CASE WHEN card_owner", "SELECT card_id, user_id, CASE WHEN user_id % 10 = 0 THEN 'admin' WHEN card_owner"),
})

ORACLE["import_changed"] = ORACLE["import_tables"]
