"""SQL equivalents of the data problems' queries, where SQL can state them."""

from tallyforge.columnar import MARKS, NO_VALUE, WHITE_SPACE
from tallyforge.operators.rowcheck import CUSTOMER_ROW, USER_ROW

_ORPHANS = """
WITH o AS (SELECT row_id, lower(trim(cust_id)) k, createdAtTimestamp t FROM orders_qa WHERE trim(cust_id) <> ''),
c AS (SELECT DISTINCT lower(trim(cust_id)) k, loaded_at FROM customers_qa WHERE trim(cust_id) <> ''),
x AS (SELECT DISTINCT lower(trim(cust_id)) k, deleted_at FROM customer_deletes WHERE trim(cust_id) <> '' AND deleted_at IS NOT NULL),
e AS (SELECT k, min(loaded_at) first_load FROM c GROUP BY k),
l AS (SELECT o.row_id, o.k, o.t, c.loaded_at last_load FROM o ASOF LEFT JOIN c ON o.k = c.k AND o.t >= c.loaded_at),
g AS (SELECT o.row_id, x.deleted_at last_gone FROM o ASOF LEFT JOIN x ON o.k = x.k AND o.t >= x.deleted_at),
j AS (SELECT l.row_id, l.t, CASE WHEN e.k IS NULL THEN 'missing' WHEN l.last_load IS NULL THEN 'late' WHEN g.last_gone > l.last_load THEN 'deleted' END kind
      FROM l JOIN g USING (row_id) LEFT JOIN e ON e.k = l.k)
"""

_CAMPAIGNS = """
WITH once AS (SELECT row_id, CASE WHEN json_valid(payload) THEN CASE json_type(payload) WHEN 'VARCHAR' THEN payload::JSON ->> '$' ELSE payload END END AS p FROM viewport_event),
good AS (SELECT row_id, p::JSON AS p FROM once WHERE json_valid(p)),
listed AS (SELECT row_id, CASE json_type(p) WHEN 'ARRAY' THEN json_extract(p, '$[*]') WHEN 'OBJECT' THEN [p] ELSE [] END AS es FROM good),
ev AS (SELECT row_id, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS event_pos FROM listed),
body AS (SELECT row_id, event_pos, json_extract(e, '$.*.value.v1EventValueValue.value.*.value')[1] AS b FROM ev),
raw AS (SELECT *, CASE WHEN json_type(b, '$.elements') = 'OBJECT' AND json_exists(b, '$.elements.value') THEN b -> '$.elements.value' ELSE b -> '$.elements' END AS els FROM body),
lists AS (SELECT *, CASE json_type(els) WHEN 'ARRAY' THEN json_extract(els, '$[*]') WHEN 'OBJECT' THEN [els] ELSE [] END AS items FROM raw),
every AS (
  SELECT row_id, event_pos, -1 AS element_pos, b -> '$.campaign' AS c FROM raw
  UNION ALL
  SELECT row_id, event_pos, pos, item -> '$.campaign' FROM (SELECT row_id, event_pos, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM lists))
"""

_FIELD = r"""(?:[^",\r\n]*|"(?:[^"]|"")*")"""
_LOOSE = r"""(?:[^",]*|"(?:[^"]|"")*")"""
_LINES = rf"""
WITH l AS (
  SELECT row_id, target_table, line, CASE target_table WHEN 'customers_qa' THEN 20 ELSE 7 END AS want, regexp_full_match(line, '{_LOOSE}(?:,{_LOOSE})*', 's') AS well, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*', 's') AS unbroken,
         CASE target_table WHEN 'customers_qa' THEN regexp_full_match(line, '(?:{_FIELD},){{17}}(?:\s*|-?[0-9]+(?:\.[0-9]{{1,2}})?|"(?:\s*|-?[0-9]+(?:\.[0-9]{{1,2}})?)")(?:,{_FIELD}){{2}}')
                           ELSE regexp_full_match(line, '(?:{_FIELD},){{6}}(?:\s*|[0-9]{{1,18}}|"(?:\s*|[0-9]{{1,18}})")') END AS good
  FROM raw_lines WHERE target_table IN ('customers_qa', 'users')),
n AS (SELECT *, length(regexp_replace(line, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(line, '"(?:[^"]|"")*"', '', 'g'), ',', '')) + 1 AS have FROM l)
"""

_NO_VALUE = ", ".join(f"'{w}'" for w in NO_VALUE)
_PROFILE = rf"""
WITH v AS (
  SELECT load_id, 'last_name' AS column_name, trim(last_name, '{WHITE_SPACE}') AS v FROM customers_qa UNION ALL
  SELECT load_id, 'height', trim(height, '{WHITE_SPACE}') FROM customers_qa UNION ALL
  SELECT load_id, 'age', age::VARCHAR FROM customers_qa UNION ALL
  SELECT load_id, 'zip', trim(zip, '{WHITE_SPACE}') FROM customers_qa),
c AS (SELECT load_id, column_name, v, count(*) AS n, coalesce(v = '' OR lower(v) IN ({_NO_VALUE}) OR regexp_full_match(v, '{MARKS}+'), true) AS gone FROM v GROUP BY ALL),
w AS (SELECT *, CASE column_name
    WHEN 'last_name' THEN regexp_full_match(v, '\p{{L}}+(?:[ ''-]\p{{L}}+)*')
    WHEN 'zip' THEN regexp_full_match(v, '[0-9]{{5}}(?:-[0-9]{{4}})?')
    WHEN 'age' THEN try_cast(v AS BIGINT) BETWEEN 0 AND 120
    ELSE coalesce(regexp_full_match(v, '-?[0-9]+(?:\.[0-9]{{1,2}})?') AND try_cast(v AS DOUBLE) BETWEEN 20 AND 100, false) END AS fine FROM c),
s AS (SELECT load_id, column_name, sum(n) AS rows, coalesce(sum(n) FILTER (gone), 0) AS missing, coalesce(sum(n) FILTER (NOT gone AND NOT fine), 0) AS malformed,
    coalesce(max(n) FILTER (NOT gone), 0) AS top, sum(n * try_cast(v AS DOUBLE)) FILTER (NOT gone AND fine AND column_name IN ('age', 'height')) AS total, sum(n) FILTER (NOT gone AND fine AND column_name IN ('age', 'height')) AS numbers FROM w GROUP BY ALL),
f AS (SELECT load_id, column_name, missing / rows AS a, malformed / nullif(rows - missing, 0) AS b, top / nullif(rows - missing, 0) AS c, total / numbers AS d FROM s),
m AS (SELECT column_name, median(a) AS ma, median(b) AS mb, median(c) AS mc, median(d) AS md FROM f GROUP BY ALL)
"""

# values of a cell: separators count outside quotes, and everywhere if the quotes don't close
_VALUES = rf"""
WITH cell AS (
  SELECT 'customers_qa' AS source_table, row_id, trim(phoneType, '{WHITE_SPACE}') AS c FROM customers_qa UNION ALL
  SELECT 'users', row_id, trim(interests, '{WHITE_SPACE}') FROM users),
bare AS (SELECT source_table, row_id, CASE WHEN regexp_full_match(c, '(?s)\[.*\]|\{{.*\}}|\(.*\)') THEN trim(c[2:-2], '{WHITE_SPACE}') ELSE c END AS c FROM cell),
full_ AS (SELECT *, regexp_replace(c, '\\["\\]', '', 'g') AS q FROM bare WHERE c <> '' AND lower(c) NOT IN ({_NO_VALUE}) AND NOT regexp_full_match(c, '{MARKS}+')),
parts AS (SELECT source_table, row_id, CASE WHEN (length(q) - length(replace(q, '"', ''))) % 2 = 1 THEN regexp_split_to_array(c, '[,;|/\t\r\n]')
    ELSE regexp_extract_all(c, '(?s)(?:[^",;|/\t\r\n\\]|\\["\\]|\\|"(?:[^"\\]|\\.)*")+') END AS ps FROM full_),
trimmed AS (SELECT source_table, row_id, list_transform(ps, lambda p: trim(p, '{WHITE_SPACE}')) AS ps FROM parts),
plain AS (SELECT source_table, row_id, list_filter(list_transform(ps, lambda p: CASE WHEN length(p) >= 2 AND starts_with(p, '"') AND ends_with(p, '"')
    THEN trim(replace(regexp_replace(p[2:-2], '\\(["\\/])', '\1', 'g'), '""', '"'), '{WHITE_SPACE}') ELSE p END), lambda p: p <> '') AS ps FROM trimmed)
SELECT source_table, row_id, generate_subscripts(ps, 1)::INT - 1 AS item_pos, unnest(ps) AS item FROM plain WHERE len(ps) >= 2
"""

# masks of every column, load by load
_TEXTS = {"isActive": "isActive::VARCHAR", "isLegalAge": "isLegalAge::VARCHAR", "age": "age::VARCHAR", "numFamilyMembers": "numFamilyMembers::VARCHAR", "rownum": "rownum::VARCHAR", "feed_id": "feed_id::VARCHAR", "loaded_at": r"regexp_replace(strftime(loaded_at, '%Y-%m-%d %H:%M:%S.%f'), '\.?0+$', '')"}
_COLUMNS = ("cust_id", "first_name", "last_name", "address", "city", "state", "zip", "createdAtTimestamp", "timestamp_micro", "timestamp_millis", "hashedCustId", "phone", "phoneType", "isActive", "birthdate", "isLegalAge", "age", "height", "numFamilyMembers", "rownum", "feed_id", "loaded_at")
_MASKS = rf"""
WITH v AS ({" UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, trim({_TEXTS.get(c, c)}, '{WHITE_SPACE}') AS v FROM customers_qa" for c in _COLUMNS)}),
m AS (SELECT load_id, column_name, CASE WHEN v = '' OR lower(v) IN ({_NO_VALUE}) OR regexp_full_match(v, '{MARKS}+') THEN NULL
    ELSE regexp_replace(regexp_replace(regexp_replace(v, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]\p{{M}}*', 'a', 'g'), '\p{{Lu}}\p{{M}}*', 'A', 'g'), '[0-9]', '9', 'g') END AS mask, v FROM v),
k AS (SELECT load_id, column_name, mask, count(*) AS rows, count(DISTINCT CASE WHEN mask IS NOT NULL THEN v END) AS distinct_values FROM m GROUP BY ALL),
s AS (SELECT load_id, column_name, coalesce(mask, '') AS mask, rows, rows / sum(rows) OVER (PARTITION BY load_id, column_name) AS p FROM k),
o AS (SELECT column_name, mask, sum(rows)::BIGINT AS rows FROM k WHERE mask IS NOT NULL GROUP BY ALL)
"""
_JS = "greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)"



def _loaded(target: str, fields: tuple[str, ...]) -> str:
    """The fields of a target's valid records; empty ones are null."""
    columns = ", ".join(f'fs[{i}] AS "{f}"' for i, f in enumerate(fields, 1))
    value = """CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END"""
    return _LINES + rf"""
SELECT row_id, {columns} FROM (
  SELECT row_id, list_transform(regexp_extract_all(line || ',', '(?s)("(?:[^"]|"")*"|[^,]*),', 1), lambda f: nullif({value}, '')) AS fs
  FROM n WHERE target_table = '{target}' AND well AND have = want AND unbroken AND good)"""


SQL = {
    "p4_loaded_customers": _loaded("customers_qa", CUSTOMER_ROW.fields),
    "p4_loaded_users": _loaded("users", USER_ROW.fields),
    "p6_found": _VALUES,
    "p5_masks": _MASKS + "SELECT load_id, column_name, mask, rows, distinct_values FROM k",
    "p5_rare_patterns": _MASKS + """, r AS (SELECT *, sum(rows) OVER (PARTITION BY column_name ORDER BY rows DESC) - sum(rows) OVER (PARTITION BY column_name, rows) AS above, sum(rows) OVER (PARTITION BY column_name) AS whole FROM o),
t AS (SELECT column_name, min(rows) AS least FROM r WHERE above < 0.98 * whole GROUP BY ALL)
SELECT column_name, mask, rows, rows / whole AS share FROM r JOIN t USING (column_name) WHERE rows < least""",
    "p5_divergence": _MASKS + f""", w AS (SELECT column_name, mask, sum(rows) AS n FROM s GROUP BY ALL), q AS (SELECT column_name, mask, n / sum(n) OVER (PARTITION BY column_name) AS q FROM w),
loads AS (SELECT load_id, lag(load_id) OVER (ORDER BY load_id) AS previous FROM (SELECT DISTINCT load_id FROM s)), cells AS (SELECT DISTINCT load_id, previous, column_name FROM s JOIN loads USING (load_id)),
a AS (SELECT load_id, column_name, {_JS} AS divergence FROM (SELECT c.load_id, c.column_name, coalesce(p, 0) AS p, q FROM cells c JOIN q USING (column_name) LEFT JOIN s ON s.load_id = c.load_id AND s.column_name = c.column_name AND s.mask = q.mask) GROUP BY ALL),
b AS (SELECT load_id, column_name, {_JS} AS from_previous FROM (SELECT load_id, column_name, mask, sum(p) AS p, sum(q) AS q FROM (SELECT load_id, column_name, mask, p, 0 AS q FROM s UNION ALL SELECT c.load_id, s.column_name, s.mask, 0, s.p FROM cells c JOIN s ON s.load_id = c.previous AND s.column_name = c.column_name) GROUP BY ALL) WHERE load_id IN (SELECT load_id FROM loads WHERE previous IS NOT NULL) GROUP BY ALL)
SELECT load_id, column_name, round(divergence, 6) AS divergence, round(from_previous, 6) AS from_previous FROM a LEFT JOIN b USING (load_id, column_name)""",
    "p1_found": _ORPHANS + "SELECT row_id, kind FROM j WHERE kind IS NOT NULL",
    "p1_counts": _ORPHANS + """
SELECT 'orders_qa' AS child_table, strftime(t, '%Y-%m') AS month, kind, count(*) AS n FROM j WHERE kind IS NOT NULL GROUP BY ALL""",
    "p3_found": _CAMPAIGNS + """
SELECT row_id, event_pos::INT AS event_pos, element_pos::INT AS element_pos, c ->> '$.assetId' AS asset_id FROM every WHERE c ->> '$.assetId' <> ''""",
    "p3_campaigns": _CAMPAIGNS + """
SELECT row_id, event_pos::INT AS event_pos, element_pos::INT AS element_pos, c ->> '$.assetId' AS "assetId", c ->> '$.flightId' AS "flightId" FROM every WHERE json_type(c) <> 'NULL'""",
    "p3_unreadable": """
WITH once AS (SELECT row_id, CASE WHEN json_valid(payload) THEN CASE json_type(payload) WHEN 'VARCHAR' THEN payload::JSON ->> '$' ELSE payload END END AS p FROM viewport_event)
SELECT row_id FROM once WHERE coalesce(CASE WHEN json_valid(p) THEN json_type(p) END, '') NOT IN ('OBJECT', 'ARRAY')""",
    "p4_found": _LINES + r"""
SELECT 'raw_lines' AS source_table, row_id, CASE WHEN NOT well THEN 'quoting' WHEN have <> want THEN 'column_count' WHEN NOT unbroken THEN 'quoting' ELSE 'value' END AS reason FROM n WHERE NOT well OR have <> want OR NOT good
UNION ALL SELECT 'customers_qa', row_id, 'value' FROM customers_qa WHERE trim(height) <> '' AND NOT regexp_full_match(height, '-?[0-9]+(?:\.[0-9]{1,2})?')
UNION ALL SELECT 'users', row_id, 'value' FROM users WHERE trim(item_count) <> '' AND NOT regexp_full_match(item_count, '[0-9]{1,18}')""",
    "p5_found": _PROFILE + "SELECT load_id, column_name FROM f JOIN m USING (column_name) WHERE coalesce(abs(a - ma) > 0.15, false) OR coalesce(abs(b - mb) > 0.15, false) OR coalesce(abs(c - mc) > 0.15, false) OR coalesce(abs(d - md) > 10, false)",
}
