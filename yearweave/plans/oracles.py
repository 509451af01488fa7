"""The same results in DuckDB SQL over the given tables."""

ORACLES: dict[str, str] = {}

NATIONS = """
base AS (
  SELECT n_nationkey AS k, n_name, CAST(year(o_orderdate) AS INTEGER) AS yr,
         sum(o_totalprice) AS total, count(*) AS n, count(DISTINCT o_custkey) AS customers,
         avg(c_acctbal) AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL),
core AS (
  SELECT n_name AS country, yr AS year, floor(total / 1000) * 1000.0 AS data_x,
         round(log10(floor(total / 1000) * 1000.0), 9) AS data_x_log,
         CASE WHEN k % 5 <> 4 THEN CAST(n AS DOUBLE) END AS data_y,
         CAST(customers AS DOUBLE) AS extra_data_point, floor(balance) AS extra_data_x
  FROM base WHERE (k + yr) % 7 <> 0)"""

ORACLES["core_table"] = f"WITH {NATIONS} SELECT * FROM core"
ORACLES["core_table_dead_optional"] = f"""WITH {NATIONS}
SELECT * REPLACE (CAST(NULL AS DOUBLE) AS extra_data_point) FROM core"""
ORACLES["core_table_duplicate_contract"] = f"""WITH {NATIONS}
SELECT * FROM core UNION ALL
SELECT * REPLACE (CAST(NULL AS DOUBLE) AS data_y) FROM core WHERE country = 'NATION_3'"""
ORACLES["load_report"] = f"""WITH {NATIONS}
SELECT source, mandatory, status, reason, detail FROM (VALUES
  ('data_x', true, 'loaded', NULL, NULL), ('data_y', true, 'loaded', NULL, NULL),
  ('extra_data_point', false, 'skipped', 'no_path', 'no path given'),
  ('extra_data_x', false, 'loaded', NULL, NULL)) AS r(source, mandatory, status, reason, detail)
WHERE (SELECT count(*) FROM core) > 0"""

CUSTOMERS = """
cents AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS spend, count(*) AS n,
         max(CAST(round(o_totalprice * 100) AS BIGINT)) AS top
  FROM orders GROUP BY ALL),
core AS (
  SELECT c_name AS country, yr AS year, CAST(spend AS DOUBLE) AS data_x,
         round(log10(CAST(spend AS DOUBLE)), 9) AS data_x_log, CAST(n AS DOUBLE) AS data_y,
         CAST(top AS DOUBLE) AS extra_data_point, CAST(NULL AS DOUBLE) AS extra_data_x
  FROM cents JOIN customer ON o_custkey = c_custkey)"""

ORACLES["core_table_customers"] = f"WITH {CUSTOMERS} SELECT * FROM core"
ORACLES["core_to_parquet"] = ORACLES["core_table_customers"]
ORACLES["core_to_csv"] = f"WITH {CUSTOMERS} SELECT *, true AS ordered FROM core"

TEXTS = """
texts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS flag,
         CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS VARCHAR) AS v,
         CASE l_linenumber WHEN 1 THEN v || 'k' WHEN 2 THEN '-' || v || '.5 M'
           WHEN 3 THEN v || ',234' WHEN 4 THEN 'n/a' WHEN 5 THEN v || 'k ' WHEN 6 THEN v || 'e5'
           ELSE v || l_returnflag END AS text
  FROM lineitem)"""

ORACLES["parse_magnitudes"] = f"""WITH {TEXTS}
SELECT l_orderkey, l_linenumber, l_partkey, text,
       CASE l_linenumber WHEN 1 THEN CAST(v AS DOUBLE) * 1000.0
         WHEN 2 THEN CAST('-' || v || '.5' AS DOUBLE) * 1000000.0
         WHEN 3 THEN CAST(v AS DOUBLE) WHEN 5 THEN CAST(v AS DOUBLE)
         WHEN 6 THEN CAST(v AS DOUBLE) END AS value,
       l_linenumber NOT BETWEEN 1 AND 6 AS unknown_suffix,
       l_linenumber IN (3, 4, 5, 6) AS suspicious
FROM texts"""
ORACLES["unknown_suffix_report"] = f"""WITH {TEXTS}
SELECT regexp_extract(text, '([A-Za-zµ]+)$', 1) AS symbol, count(*) AS n_cells,
       min(text) AS example
FROM texts WHERE regexp_extract(text, '([A-Za-zµ]+)$', 1) NOT IN
  ('', 'Y', 'Z', 'E', 'P', 'T', 'G', 'M', 'k', 'm', 'u', 'n', 'p', 'f', 'a')
GROUP BY 1"""
ORACLES["suffix_table_problems"] = """
SELECT p_type AS source, p_brand AS symbol, p_name AS factor, count(*) AS n
FROM part WHERE p_size % 10 = 0 GROUP BY ALL"""

ORACLES["unpivot_long"] = f"""WITH {CUSTOMERS}
SELECT o_custkey, yr AS year, CAST(spend AS BIGINT) AS cents FROM cents"""
ORACLES["overlap_prune"] = f"""WITH {CUSTOMERS}
SELECT o_custkey, yr AS year, CAST(spend AS BIGINT) AS cents FROM cents
WHERE yr BETWEEN 1996 AND 1999 AND yr <> 1997"""
for _name in ("csv_roundtrip", "csv_dusty"):
    ORACLES[_name] = f"""WITH {CUSTOMERS}
    SELECT 'Customer, ' || o_custkey AS country, yr AS year, CAST(spend AS DOUBLE) AS cents
    FROM cents"""
ORACLES["csv_multiline"] = f"""WITH {CUSTOMERS}
SELECT 'Customer,' || chr(10) || o_custkey AS country, yr AS year, CAST(spend AS DOUBLE) AS cents
FROM cents"""
ORACLES["csv_many_files"] = """
SELECT DISTINCT 'Customer, ' || o_custkey AS label, CAST(o_custkey AS BIGINT) AS ord,
       CAST(NULL AS VARCHAR) AS reason FROM orders
UNION ALL SELECT 'other_header', NULL, 'read_failure' UNION ALL SELECT 'other_header_no_order', NULL, 'read_failure'"""
ORACLES["csv_file_order"] = """
SELECT 'Customer,' || chr(10) || o_custkey AS label, row_number() OVER (ORDER BY o_custkey) - 1 AS ord
FROM (SELECT DISTINCT o_custkey FROM orders)"""
ORACLES["csv_ragged_rows"] = """
SELECT 'Customer, ' || o_custkey AS country FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey"""

ORACLES["dup_keys"] = """
SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1 OR p_name IS NULL"""
ORACLES["non_positive"] = """
SELECT count(*) AS n_non_positive FROM customer WHERE c_acctbal <= 0"""
ORACLES["coverage"] = """
SELECT c_nationkey, CAST(min(yr) AS INTEGER) AS axis_min, CAST(max(yr) AS INTEGER) AS axis_max,
       count(DISTINCT CASE WHEN yr BETWEEN 1995 AND 2001 THEN yr END) AS n_inside,
       bool_or(yr = 1995) AS has_start, bool_or(yr = 2001) AS has_end,
       count(DISTINCT CASE WHEN yr BETWEEN 1995 AND 2001 THEN yr END) = 7 AS contiguous
FROM (SELECT c_nationkey, year(o_orderdate) AS yr
      FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1"""
ORACLES["gaps"] = """
WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
spans AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM days GROUP BY 1),
every AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
          FROM spans)
SELECT user_id, day FROM every ANTI JOIN days USING (user_id, day)"""
ORACLES["schema_contract"] = """
SELECT * FROM (
  SELECT 'title' AS "column", 'missing' AS issue, 'string' AS expected, '' AS found,
         CAST(0 AS BIGINT) AS n_values
  UNION ALL SELECT 'source', 'unexpected', '', 'string', (SELECT count(source) FROM documents)
  UNION ALL SELECT 'n_chars', 'type_mismatch', 'int', 'bigint',
                   (SELECT count(n_chars) FROM documents)
  UNION ALL SELECT 'lang', 'out_of_order', '1', '2', (SELECT count(lang) FROM documents)
  UNION ALL SELECT 'text', 'out_of_order', '2', '1', (SELECT count(text) FROM documents))"""
STRIP = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{STRIP}|{STRIP}$', '', 'g')"


ORACLES["value_violations"] = f"""
WITH docs AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0
  THEN '   ' || chr(10) || chr(9) || chr(160) || chr(8195) || ' ' ELSE chr(9) || lang END AS lang
  FROM documents)
SELECT 'customer' AS table_name, c_custkey AS key, 'c_acctbal' AS "column", 'min' AS rule,
       CAST(round(c_acctbal, 2) AS VARCHAR) AS value FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'customer', c_custkey, 'c_acctbal', 'max', CAST(round(c_acctbal, 2) AS VARCHAR) FROM customer
  WHERE c_acctbal > 9000
UNION ALL SELECT 'customer', c_custkey, 'c_mktsegment', 'allowed', c_mktsegment FROM customer
  WHERE trim(c_mktsegment) NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
UNION ALL SELECT 'part', p_partkey, 'p_name', 'len_min', p_name FROM part
  WHERE length(trim(p_name)) < 9
UNION ALL SELECT 'part', p_partkey, 'p_name', 'len_max', p_name FROM part
  WHERE length(trim(p_name)) > 12
UNION ALL SELECT 'part', p_partkey, 'p_size', 'min', CAST(p_size AS VARCHAR) FROM part
  WHERE p_size < 3
UNION ALL SELECT 'part', p_partkey, 'p_size', 'below_p_partkey', CAST(p_size AS VARCHAR) FROM part
  WHERE p_size >= p_partkey
UNION ALL SELECT 'documents', doc_id, 'lang', 'len_min', lang FROM docs
  WHERE length({strip('lang')}) < 1
UNION ALL SELECT 'documents', doc_id, 'lang', 'len_max', lang FROM docs
  WHERE length({strip('lang')}) > 2
UNION ALL SELECT 'documents', doc_id, 'lang', 'allowed', lang FROM docs
  WHERE {strip('lang')} NOT IN ('en', 'de')
UNION ALL SELECT 'documents', doc_id, 'source', 'type', source FROM documents
  WHERE source IS NOT NULL AND TRY_CAST(source AS INTEGER) IS NULL"""
ORACLES["sanitize_values"] = r"""
SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(url, '[^0-9a-zA-Z]', '_', 'g'),
       '_+', '_', 'g'), '_'), '^(\d)', '_\1') AS name FROM pages"""


def common_length(a: str, b: str) -> str:
    """Longest common subsequence of two texts of up to 126 characters, one bit per character."""
    one = "CAST(1 AS HUGEINT)"
    full = f"(({one} << length({a})) - 1)"
    where = f"""list_sum(list_transform(range(length({a})),
        lambda i: CASE WHEN {a}[i + 1] = ch THEN {one} << i ELSE 0 END))"""
    masks = f"""list_transform(string_split({b}, ''),
        lambda ch: CAST(coalesce({where}, 0) AS HUGEINT))"""
    row = f"""list_reduce({masks},
        lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})"""
    return f"(length({a}) - bit_count({row}))"


def best_matches(suffix: str = "") -> str:
    """CTEs from xs(label, ord) and ls(label, ord) to best(label, ord, x_label, score)."""
    s = suffix
    return f"""
forms{s} AS (
  SELECT label, list_sort(list_filter(regexp_split_to_array(label, '\\s+'), lambda t: t <> '')) AS ts
  FROM (SELECT label FROM xs{s} UNION SELECT label FROM ls{s})),
pairs{s} AS (
  SELECT l.label AS a, x.label AS b, x.ord AS x_ord, length(l.label) AS n, length(x.label) AS m,
         greatest(n, m) / least(n, m) AS r, f.ts AS ta, g.ts AS tb
  FROM ls{s} l JOIN forms{s} f ON f.label = l.label, xs{s} x JOIN forms{s} g ON g.label = x.label),
near{s} AS (
  SELECT a, b, x_ord, n, m, array_to_string(ta, ' ') AS sa, array_to_string(tb, ' ') AS sb,
         array_to_string(list_filter(list_sort(list_distinct(ta)),
           lambda t: list_contains(tb, t)), ' ') AS common,
         array_to_string(list_filter(list_sort(list_distinct(ta)),
           lambda t: NOT list_contains(tb, t)), ' ') AS da,
         array_to_string(list_filter(list_sort(list_distinct(tb)),
           lambda t: NOT list_contains(ta, t)), ' ') AS db
  FROM pairs{s} WHERE r < 1.5 AND a <> b
    AND (levenshtein(a, b) * 10 <= n + m OR len(list_intersect(ta, tb)) > 0
         OR levenshtein(array_to_string(ta, ' '), array_to_string(tb, ' ')) * 19 <= n + m)),
dist{s} AS (
  SELECT *, n + m - 2 * {common_length('a', 'b')} AS d1,
         length(sa) + length(sb) - 2 * {common_length('sa', 'sb')} AS d2,
         length(da) + length(db) - 2 * {common_length('da', 'db')} AS d3,
         length(common) AS s, CASE WHEN common <> '' THEN 1 ELSE 0 END AS gap
  FROM near{s}),
scored{s} AS (
  SELECT a, b, x_ord, greatest((1.0::DOUBLE - d1 / (n + m)) * 100.0::DOUBLE,
    0.95::DOUBLE * ((1.0::DOUBLE - d2 / (length(sa) + length(sb))) * 100.0::DOUBLE),
    0.95::DOUBLE * CASE WHEN s > 0 AND (da = '' OR db = '') THEN 100.0::DOUBLE ELSE greatest(
      100.0::DOUBLE - 100.0::DOUBLE * d3 / (2 * (s + gap) + length(da) + length(db)),
      CASE WHEN s > 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * (1 + length(da)) / (2 * s + 1 + length(da)) END,
      CASE WHEN s > 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * (1 + length(db)) / (2 * s + 1 + length(db)) END)
    END) AS score
  FROM dist{s}
  UNION ALL SELECT a, b, x_ord, 100.0 FROM pairs{s} WHERE a = b
  UNION ALL SELECT a, b, x_ord, 90.0 FROM pairs{s}
    WHERE r >= 1.5 AND r <= 8 AND (contains(a, b) OR contains(b, a))),
best{s} AS (
  SELECT l.label, l.ord, t.b AS x_label, t.score FROM ls{s} l LEFT JOIN (
    SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, x_ord) AS rn
    FROM scored{s} WHERE score >= 90) t ON t.a = l.label AND t.rn = 1),
classed{s} AS (
  SELECT label, ord, x_label,
         CASE WHEN score >= 100 THEN 'exact' WHEN score >= 90 THEN 'fuzzy' ELSE 'unmatched' END
           AS match_type,
         CASE WHEN score >= 100 THEN 1.0 WHEN score >= 90 THEN round(score / 100.0, 9) ELSE 0.0 END
           AS confidence
  FROM best{s})"""


PART_NAMES = "SELECT p_name AS label, min(p_partkey) AS ord FROM part GROUP BY 1"
SWAP = r"regexp_replace(label, '^(\S+) (\S+)$', '\2 \1')"
PART_VARIANTS = f"""SELECT CASE ord % 4 WHEN 0 THEN label WHEN 1 THEN {SWAP}
    WHEN 2 THEN label[1:2] || label[4:] ELSE 'zz ' || reverse(label) END AS label, ord
  FROM ({PART_NAMES})"""
CUSTOMER_NAMES = "SELECT c_name AS label, c_custkey AS ord FROM customer"
CUSTOMER_VARIANTS = f"""SELECT CASE ord % 4 WHEN 0 THEN label WHEN 1 THEN label[10:]
    WHEN 2 THEN label[1:11] || label[13:] ELSE 'Mr ' || lower(label) END AS label, min(ord) AS ord
  FROM ({CUSTOMER_NAMES}) GROUP BY 1"""

ORACLES["entities_exact"] = f"""WITH xs AS ({CUSTOMER_NAMES}), ls AS ({CUSTOMER_VARIANTS})
SELECT xs.label AS data_x, ls.label AS data_y,
       CASE WHEN ls.label IS NOT NULL THEN 'exact' END AS data_y_match_type
FROM xs LEFT JOIN ls ON xs.label = ls.label"""
ORACLES["similarity_join_parts"] = f"""
WITH xs AS ({PART_NAMES}), ls AS ({PART_VARIANTS}), {best_matches()} SELECT * FROM classed"""
ORACLES["similarity_join_customers"] = f"""
WITH xs AS ({CUSTOMER_NAMES}), ls AS ({CUSTOMER_VARIANTS}), {best_matches()} SELECT * FROM classed"""

CONTRACT = f"""
xs AS ({PART_NAMES}), ls AS ({PART_VARIANTS}), {best_matches()},
xs2 AS ({PART_NAMES}),
ls2 AS (SELECT label, ord * 2 AS ord FROM ls UNION ALL
        SELECT {SWAP}, ord * 2 + 1 FROM xs WHERE ord % 4 = 0), {best_matches('2')}"""


def contract(order: str) -> str:
    """CTEs up to won, won2 (winner per x label) and contract, for a winner order."""
    sets = ""
    for s in ("", "2"):
        sets += f""",
won{s} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x_label ORDER BY {order}) AS rn
           FROM classed{s} WHERE x_label IS NOT NULL) WHERE rn = 1)"""
    return f"""{CONTRACT}{sets},
contract AS (
  SELECT x.label AS data_x, w.label AS data_y, w.match_type AS data_y_match_type,
         w.confidence AS data_y_confidence, v.label AS extra_data_point,
         v.match_type AS extra_data_point_match_type, v.confidence AS extra_data_point_confidence,
         CAST(NULL AS VARCHAR) AS extra_data_x, CAST(NULL AS VARCHAR) AS extra_data_x_match_type,
         CAST(NULL AS DOUBLE) AS extra_data_x_confidence
  FROM xs x LEFT JOIN won w ON w.x_label = x.label LEFT JOIN won2 v ON v.x_label = x.label
  UNION ALL SELECT NULL, label, match_type, confidence, NULL, NULL, NULL, NULL, NULL, NULL
  FROM classed WHERE x_label IS NULL
  UNION ALL SELECT NULL, NULL, NULL, NULL, label, match_type, confidence, NULL, NULL, NULL
  FROM classed2 WHERE x_label IS NULL)"""


LAST, BEST = "ord DESC", "confidence DESC, ord DESC"
ORACLES["matches_contract"] = f"WITH {contract(LAST)} SELECT * FROM contract"
ORACLES["matches_best"] = f"WITH {contract(BEST)} SELECT * FROM contract"
ORACLES["matched_split"] = f"WITH {contract(LAST)} SELECT * FROM contract WHERE data_x IS NOT NULL"
ORACLES["contract_roundtrip"] = ORACLES["matched_split"]
ORACLES["contract_labels_roundtrip"] = f"""WITH {contract(LAST)}
SELECT * REPLACE (' ' || data_x AS data_x, data_y || chr(10) || '"a", \\ ' AS data_y) FROM contract"""
ORACLES["unmatched_split"] = f"WITH {contract(LAST)} SELECT * FROM contract WHERE data_x IS NULL"
ORACLES["matches_conflicts"] = f"""WITH {contract(LAST)}
SELECT 'data_y' AS source, c.x_label, c.label, c.match_type, c.confidence, w.label AS winner
FROM classed c JOIN won w ON w.x_label = c.x_label WHERE c.label <> w.label
UNION ALL
SELECT 'extra_data_point', c.x_label, c.label, c.match_type, c.confidence, w.label
FROM classed2 c JOIN won2 w ON w.x_label = c.x_label WHERE c.label <> w.label"""
ORACLES["core_table_matched_parts"] = f"""
WITH xs AS ({PART_NAMES}), ls AS ({PART_VARIANTS}), {best_matches()},
won AS (SELECT x_label, max_by(label, ord) AS label FROM classed WHERE x_label IS NOT NULL GROUP BY 1),
cells AS (
  SELECT p_name, CAST(year(l_shipdate) AS INTEGER) AS yr,
         floor(sum(CAST(floor(l_extendedprice) AS BIGINT)) / 1000) * 1000.0::DOUBLE AS x,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE year(l_shipdate) BETWEEN 1995 AND 2001 GROUP BY ALL),
named AS (SELECT ls.label, c.yr, c.y FROM cells c JOIN xs ON xs.label = c.p_name
          JOIN ls ON ls.ord = xs.ord)
SELECT c.p_name AS country, c.yr AS year, c.x AS data_x, round(log10(c.x), 9) AS data_x_log,
       d.y AS data_y, CAST(NULL AS DOUBLE) AS extra_data_point, CAST(NULL AS DOUBLE) AS extra_data_x
FROM cells c LEFT JOIN won w ON w.x_label = c.p_name
LEFT JOIN named d ON d.label = w.label AND d.yr = c.yr"""


def metric(x: str, digits: int = 6) -> dict[str, str]:
    """Regression of data_y on x, null where undefined; slopes, tiny on large x, times 1e12."""
    def clean(v: str, scale: str = "", digits: int = digits) -> str:
        return f"CASE WHEN isnan({v}) OR isinf({v}) THEN NULL ELSE round({v}{scale}, {digits}) END"

    return {
        "slope": clean(f"regr_slope(data_y, {x})", " * 1e12", 0),
        "intercept": clean(f"regr_intercept(data_y, {x})"),
        "r": clean(f"corr(data_y, {x})"),
        "r2": clean(f"regr_r2(data_y, {x})"),
    }


def year_metrics(x: str, k: int) -> str:
    n = f"count(CASE WHEN data_y IS NOT NULL AND {x} IS NOT NULL THEN 1 END)"
    cols = ", ".join(f"CASE WHEN {n} >= {k} THEN {v} END AS {c}" for c, v in metric(x).items())
    return f"SELECT year, {n} AS n, {n} < {k} AS insufficient, {cols} FROM core GROUP BY year"


RAW_LOG = ("round(log10(", "), 9) AS data_x_log", "log10(", ") AS data_x_log")


def unrounded(ctes: str) -> str:
    return ctes.replace(RAW_LOG[0], RAW_LOG[2]).replace(RAW_LOG[1], RAW_LOG[3])


ORACLES["year_metrics_lin"] = f"WITH {unrounded(NATIONS)} {year_metrics('data_x', 5)}"
ORACLES["year_metrics_log"] = f"WITH {unrounded(NATIONS)} {year_metrics('data_x_log', 5)}"
SHORT = """SELECT year, count(data_y) AS n FROM core GROUP BY year HAVING count(data_y) < 18"""
ORACLES["year_metrics_short"] = f"WITH {NATIONS} {SHORT}"


def both_metrics() -> str:
    n = "count(CASE WHEN data_y IS NOT NULL AND data_x IS NOT NULL THEN 1 END)"
    cols = [
        f"CASE WHEN {n} >= 5 THEN {v} END AS {c}_{scale}"
        for scale, x in (("lin", "data_x"), ("log", "data_x_log"))
        for c, v in metric(x).items()
    ]
    return f"SELECT year, {n} AS n, {n} < 5 AS insufficient, {', '.join(cols)} FROM core GROUP BY year"


ORACLES["run_report"] = f"""WITH {NATIONS}, short AS ({SHORT})
SELECT 'extra_data_point' AS source, 'no_path' AS reason, 'no path given' AS detail, CAST(1 AS BIGINT) AS n
UNION ALL SELECT 'data_y', 'too_few_points', CAST(year AS VARCHAR), n FROM short"""
ORACLES["run_frames"] = f"""WITH {unrounded(NATIONS)}, metrics AS ({both_metrics()})
SELECT core.* REPLACE (round(data_x_log, 6) AS data_x_log), metrics.* EXCLUDE (year)
FROM core LEFT JOIN metrics USING (year)"""
ORACLES["run_conflicts"] = f"""
WITH xs AS ({PART_NAMES}),
ls AS (SELECT label, max(ord) AS ord FROM ({PART_VARIANTS} UNION ALL
       SELECT {SWAP}, ord + (1::BIGINT << 40) FROM xs WHERE ord % 4 = 0) GROUP BY 1), {best_matches()},
won AS (SELECT x_label, max_by(label, ord) AS label FROM classed WHERE x_label IS NOT NULL GROUP BY 1)
SELECT 'data_y' AS source, c.x_label, c.label, c.match_type, c.confidence, w.label AS winner
FROM classed c JOIN won w ON w.x_label = c.x_label WHERE c.label <> w.label"""
ORACLES["table_replace"] = "SELECT * FROM nation"
ORACLES["catalog_table"] = "SELECT * FROM customer"
ORACLES["suffix_source"] = """
WITH cells AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS source,
         CAST(floor(l_extendedprice / 1000) AS BIGINT) AS v,
         ['k', 'G', 'B', '', 'x'][l_orderkey % 5 + 1] AS symbol FROM lineitem),
known AS (
  SELECT *, CASE WHEN symbol = '' THEN 1.0 WHEN source = 'N' AND symbol = 'B' THEN 1e9
    WHEN source <> 'N' AND symbol = 'k' THEN 1e3 WHEN source <> 'N' AND symbol = 'G' THEN 1e9
    END AS factor FROM cells)
SELECT l_orderkey, l_linenumber, source, v || symbol AS text, v * factor::DOUBLE AS value,
       factor IS NULL AS unknown_suffix FROM known"""
FAULTY = """
keys AS (SELECT o_custkey AS k, count(CASE WHEN year(o_orderdate) = 1996 THEN 1 END) AS n FROM orders GROUP BY 1),
names AS (SELECT CASE WHEN k % 3 <> 0 THEN CAST(k % 100 AS VARCHAR) END AS value FROM keys),
bad AS (
  SELECT 'keys' AS source, 'duplicate_or_null_keys' AS reason, value, count(*) AS n FROM names
  GROUP BY value HAVING count(*) > 1 OR value IS NULL
  UNION ALL SELECT 'suffix', 'unknown_suffix', 'Q', count(*) FROM keys WHERE k % 5 = 0 AND n > 0
  HAVING count(*) > 0)"""
ORACLES["load_violations_all"] = f"WITH {FAULTY} SELECT * FROM bad"
ORACLES["load_report_dropped"] = f"""WITH {FAULTY}, found AS (
  SELECT source, max(reason) AS reason FROM bad GROUP BY 1
  UNION ALL SELECT * FROM (VALUES ('first_column', 'wrong_entity_column'), ('outside', 'no_overlap_column'),
    ('missing', 'file_not_found'), ('none', 'no_path')))
SELECT s.source, false AS mandatory, f.reason,
       CASE WHEN f.reason IS NULL THEN 'loaded' WHEN f.reason = 'no_path' THEN 'skipped' ELSE 'dropped' END AS status
FROM (VALUES ('first_column'), ('outside'), ('keys'), ('suffix'), ('missing'), ('none'), ('good')) AS s(source)
LEFT JOIN found f ON f.source = s.source"""
ORACLES["overlap_order"] = """
SELECT 'overlap_order' AS reason, count(DISTINCT o_custkey) AS n FROM orders"""
ORACLES["year_metrics_customers"] = f"WITH {unrounded(CUSTOMERS)} {both_metrics()}"
ORACLES["frames_by_year"] = f"""WITH {unrounded(CUSTOMERS)}, metrics AS ({both_metrics()})
SELECT core.* REPLACE (round(data_x_log, 6) AS data_x_log), metrics.* EXCLUDE (year)
FROM core LEFT JOIN metrics USING (year)"""
ORACLES["frames_compact"] = ORACLES["frames_by_year"]
ORACLES["frame_chunks"] = f"""WITH {unrounded(CUSTOMERS)}, metrics AS ({both_metrics()}),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY year ORDER BY data_x NULLS LAST, country NULLS LAST) - 1) // 500 AS chunk
           FROM core)
SELECT year, chunk, count(*) AS n_points, min(data_x) AS x_min, max(data_x) AS x_max, min(data_y) AS y_min,
       max(data_y) AS y_max, arg_min(country, (data_x IS NULL, data_x, country)) AS first_country,
       arg_max(country, (data_x IS NULL, data_x, country)) AS last_country, any_value(metrics.n) AS n
FROM ranked LEFT JOIN metrics USING (year) GROUP BY year, chunk"""
_SPREAD = ", ".join(
    f"CASE WHEN count(*) >= 5 THEN round(stddev_samp({c}), 4) END AS sd_{s}, "
    f"CASE WHEN count(*) >= 5 THEN round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) END"
    f" AS iqr_{s}"
    for s, c in (("x", "data_x"), ("x_log", "data_x_log"), ("y", "data_y"))
)
ORACLES["dispersion_by_year"] = f"""WITH {unrounded(CUSTOMERS)}
SELECT year, count(*) AS n, {_SPREAD} FROM core
WHERE data_x IS NOT NULL AND data_y IS NOT NULL GROUP BY year"""
