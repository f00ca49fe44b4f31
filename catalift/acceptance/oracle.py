"""SQL that a plain SQL engine runs on the test tables to check the queries."""

from __future__ import annotations

from catalift.acceptance.queries import TABLES

_ROWS_OF_TABLES = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {name}" for name in TABLES
)

ORACLE: dict[str, str] = {
    "inventory_profile": """
SELECT type, format, count(*) AS "count",
       CASE WHEN lower(format) = 'hive' THEN 'difficult' ELSE 'null' END AS complexity
FROM (SELECT p_type AS type,
             CASE p_partkey % 4 WHEN 0 THEN 'HIVE' WHEN 1 THEN 'parquet' WHEN 2 THEN 'delta' ELSE 'Unknown' END AS format
      FROM part)
GROUP BY 1, 2
""",
    "inventory_csv": """
SELECT 'db' || (p_partkey % 10) AS db, 't' || p_partkey AS table_name,
       CASE WHEN p_partkey % 7 = 0 THEN 'Unknown' ELSE p_brand END AS format,
       CASE WHEN p_partkey % 7 = 0 THEN 'Unknown' ELSE 'EXTERNAL' END AS type,
       CASE WHEN p_partkey % 7 = 0 THEN 'NONE' ELSE 'file:/a,b/' || p_partkey END AS table_location,
       CASE WHEN p_partkey % 7 <> 0 THEN '4.1' END AS created_version,
       CASE WHEN p_partkey % 7 <> 0 THEN p_partkey * 1000 END AS created_time,
       CASE WHEN p_partkey % 7 <> 0 THEN CAST(-1 AS BIGINT) END AS last_access,
       CASE WHEN p_partkey % 7 = 0 THEN 'absent' ELSE 'Unknown' END AS lib,
       CASE WHEN p_partkey % 7 = 0 THEN 'absent' ELSE 'Unknown' END AS inputformat,
       CASE WHEN p_partkey % 7 = 0 THEN 'absent' ELSE 'Unknown' END AS outputformat,
       inferred
FROM part, (VALUES (false), (true)) AS modes(inferred)
""",
    "database_inventory": """
SELECT DISTINCT c_mktsegment AS segment, 'spark_catalog' AS catalog FROM customer
""",
    "describe_databases": """
SELECT CAST(o_orderkey // 5000 AS BIGINT) AS batch, CAST(3 AS BIGINT) AS facts, CAST(0 AS BIGINT) AS errors, count(*) AS n_orders
FROM orders GROUP BY 1
UNION ALL SELECT -1, 0, 1, 0
""",
    "catalog_cleanup": """
SELECT DISTINCT p_type AS db FROM part WHERE contains(p_type, 'ECO') UNION ALL SELECT 'spark_catalog'
""",
    "owned_by_me": """
SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0
""",
    "sync_options": """
SELECT t AS table_name, count(*) AS source_rows, count(*) AS target_rows, true AS matches
FROM nation, (VALUES ('placed'), ('kept')) AS v(t) GROUP BY t
""",
    "sync_resume": """
SELECT 'customer' AS table_name, 'RESUMED' AS action, 'EXISTS' AS status, count(*) AS source_rows, count(*) AS target_rows, true AS matches FROM customer
UNION ALL SELECT 'orders', 'RESUMED', 'EXISTS', count(*), count(*), true FROM orders
UNION ALL SELECT 'supplier', 'COPIED', 'EXISTS', n, n, true FROM (SELECT count(*) + count(*) FILTER (s_suppkey % 10 = 0) AS n FROM supplier)
""",
    "reconcile_differences": """
WITH t AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 89 = 7 THEN 1 ELSE 0 END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders, (VALUES (1), (2)) AS v(n) WHERE o_orderkey % 97 <> 5 AND (n = 1 OR o_orderkey % 101 = 3)
  UNION ALL
  SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 103 = 9),
a AS (SELECT o_orderkey, count(*) AS n FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM t) GROUP BY 1),
b AS (SELECT o_orderkey, count(*) AS n FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM orders) GROUP BY 1)
SELECT o_orderkey, CASE WHEN b.n IS NULL THEN 'REMOVED' WHEN a.n IS NULL THEN 'ADDED' ELSE 'CHANGED' END AS change,
       coalesce(a.n, 0) AS source_rows, coalesce(b.n, 0) AS target_rows
FROM a FULL JOIN b USING (o_orderkey)
""",
    "registry_applied": """
WITH v AS (SELECT 'm' || (o_custkey % 50) AS model, o_orderstatus AS st, o_orderpriority <> '5-LOW' AS signed,
                  CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS BIGINT) AS version FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY version) AS dest_version FROM v WHERE signed),
a AS (SELECT model, CASE st WHEN 'P' THEN 'Champion' ELSE 'Challenger' END AS alias, max(version) AS version
      FROM s WHERE st IN ('P', 'O') GROUP BY 1, 2)
SELECT 'main.models.' || s.model AS dest_name, s.dest_version AS version, s.version AS source_version, a.alias, 'EXISTS' AS again
FROM s LEFT JOIN a ON s.model = a.model AND s.version = a.version
""",
    "plan_catalogs": """
WITH p AS (
  SELECT c AS catalog, 't' || p_partkey AS t, p_partkey % 11 = 0 AS is_view, p_partkey % 5 = 0 AS root,
         p_partkey % 7 AS known, p_partkey % 3 = 0 AS both_have
  FROM part JOIN (VALUES ('a'), ('b')) AS v(c) ON c = 'a' OR p_partkey % 3 = 0),
s AS (
  SELECT source, p.*, CASE WHEN source = 'd' THEN '' ELSE catalog || '.' END || 'd.' || t AS source_name
  FROM p JOIN (VALUES ('a.d'), ('b.d'), ('d')) AS v(source) ON source = 'd' OR source[1] = catalog)
SELECT source, source_name, 'main.s.' || t AS target_name,
       CASE WHEN is_view THEN 'VIEW_SKIPPED'
            WHEN source = 'd' AND both_have THEN 'ERROR'
            WHEN known = 1 AND NOT root THEN 'ERROR'
            WHEN known IN (0, 1) THEN 'EXISTS'
            WHEN root THEN 'NEEDS_COPY' ELSE 'READY' END AS status
FROM s
""",
    "champion_challenger": """
WITH tr AS (SELECT * FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-01-01'),
va AS (SELECT * FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-01-01'),
f AS (SELECT regr_slope(l_extendedprice, l_discount) AS a1, regr_intercept(l_extendedprice, l_discount) AS b1,
             regr_slope(l_extendedprice, l_quantity) AS a2, regr_intercept(l_extendedprice, l_quantity) AS b2 FROM tr),
m AS (SELECT CAST(1 AS BIGINT) AS version, avg(power(l_extendedprice - (a1 * l_discount + b1), 2)) AS mse FROM va, f
      UNION ALL SELECT 2, avg(power(l_extendedprice - (a2 * l_quantity + b2), 2)) FROM va, f)
SELECT 'compared' AS stage, version, round(mse, 2) AS mse, CAST(0 AS BIGINT) AS unscored FROM m
UNION ALL SELECT 'promoted', version, round(mse, 2), 0 FROM m WHERE mse = (SELECT min(mse) FROM m)
""",
    "forest_exact": """
SELECT l_orderkey, l_linenumber, CAST(3 * l_linenumber * l_linenumber + 1 AS DOUBLE) AS prediction
FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-01-01'
""",
    "label_split": """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
""",
    "holdout": """
SELECT CAST(count(*) AS BIGINT) AS lines, CAST(1 AS BIGINT) AS sides, true AS about_a_fifth FROM lineitem
""",
    "upgrade_carried": """
WITH o AS (SELECT *, o_custkey % 50 AS k, CASE WHEN o_custkey % 50 = 7 THEN 'in.valid' WHEN o_custkey % 50 <> 8 THEN 'm' || (o_custkey % 50) END AS name
           FROM orders),
v AS (SELECT *, CASE WHEN k IN (7, 8) THEN 'INVALID_NAME' WHEN o_orderpriority <> '5-LOW' THEN 'READY' ELSE 'NO_SIGNATURE' END AS status FROM o),
n AS (SELECT *, CASE WHEN status = 'READY' THEN row_number() OVER (PARTITION BY name, status ORDER BY o_orderkey) END AS dest_version FROM v),
m AS (SELECT DISTINCT name FROM o UNION SELECT DISTINCT 'bare' || k FROM o)
SELECT 'versions' AS run, name AS model, o_orderkey AS version, 'main.migrated_models.' || name AS dest_name, status, dest_version,
       's3://runs/' || o_orderkey AS source, 'r' || o_custkey AS run_id, o_orderpriority AS description, 'about ' || name AS model_description
FROM n
UNION ALL
SELECT 'versions', name, NULL, 'main.migrated_models.' || name, 'NO_VERSIONS', NULL, NULL, NULL, NULL, 'about ' || name
FROM m WHERE name LIKE 'bare%'
UNION ALL
SELECT 'models', name, NULL, 'main.migrated_models.' || name, CASE WHEN name IS NULL OR name = 'in.valid' THEN 'INVALID_NAME' ELSE 'READY' END,
       NULL, NULL, NULL, NULL, 'about ' || name
FROM m
""",
    "name_contains_any": """
SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'small')
""",
    "name_glob": """
SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE 'customer%0001%'
""",
    "owned_not_marked": """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT DISTINCT o_custkey FROM orders WHERE lower(o_orderpriority) LIKE '1-%')
  AND c_mktsegment = 'BUILDING'
""",
    "classify_copy": """
WITH d AS (
  SELECT p_partkey AS table_id,
         CASE p_partkey % 5 WHEN 0 THEN 'dbfs:/user/hive/warehouse/a' WHEN 1 THEN 'dbfs:/mnt/a' WHEN 2 THEN 'dbfs:/mnt/b' WHEN 3 THEN 'wasbs://c@a/t' END AS location,
         p_partkey % 5 = 4 AS is_view, p_partkey % 5 <> 4 AS is_delta, p_partkey % 5 IN (0, 2) AS managed
  FROM part)
SELECT table_id, location, is_view, is_delta,
       coalesce((starts_with(location, 'dbfs:/') OR starts_with(location, 'wasb')) AND NOT starts_with(location, 'dbfs:/mnt/'), false) OR managed AS should_copy
FROM d WHERE table_id % 7 <> 3
UNION ALL SELECT table_id, NULL, false, false, false FROM d WHERE table_id % 7 = 3
""",
    "slice_inclusive": """
SELECT 'train' AS split, o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-01-01'
UNION ALL
SELECT 'validation', o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-01-01'
""",
    "forecast_window": """
WITH daily AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
w AS (SELECT * FROM daily WHERE day BETWEEN DATE '2001-06-15' - 5 AND DATE '2001-06-15' + 5),
t AS (SELECT day, n, row_number() OVER (ORDER BY day DESC) AS rn FROM daily)
SELECT day, n, day <= DATE '2001-06-15' AS has_actual FROM w WHERE (SELECT count(*) FROM w) >= 10
UNION ALL
SELECT day, n, rn BETWEEN 6 AND 10 FROM t WHERE rn <= 10 AND (SELECT count(*) FROM w) < 10
""",
    "forecast_window_fallback": """
SELECT day, n, rn BETWEEN 6 AND 10 AS has_actual
FROM (SELECT day, n, row_number() OVER (ORDER BY day DESC) AS rn
      FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1))
WHERE rn <= 10
""",
    "latest_version": """
WITH v AS (SELECT 'm' || (o_custkey % 50) AS model,
                  CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS VARCHAR) AS version, o_orderstatus FROM orders)
SELECT model, max(CAST(version AS BIGINT)) AS latest_version FROM v GROUP BY 1
""",
    "stage_alias": """
WITH v AS (SELECT 'm' || (o_custkey % 50) AS model,
                  CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS BIGINT) AS version, o_orderstatus AS st FROM orders),
s AS (SELECT model, version, CASE st WHEN 'P' THEN 'Production' WHEN 'O' THEN 'Staging' ELSE 'Archived' END AS stage FROM v)
SELECT model, CASE stage WHEN 'Production' THEN 'Champion' ELSE 'Challenger' END AS alias, max(version) AS version
FROM s WHERE stage IN ('Production', 'Staging') GROUP BY 1, 2
""",
    "upgrade_plan": """
WITH v AS (SELECT 'm' || (o_custkey % 50) AS model,
                  CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS BIGINT) AS version,
                  o_orderpriority <> '5-LOW' AS has_signature FROM orders)
SELECT model, version, 'main.migrated_models.' || model AS dest_name,
       CASE WHEN has_signature THEN 'READY' ELSE 'NO_SIGNATURE' END AS status,
       CASE WHEN has_signature THEN row_number() OVER (PARTITION BY model, has_signature ORDER BY version) END AS dest_version
FROM v
""",
    "validation_mse": """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b
           FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-01-01')
SELECT CAST(round(avg(power(l_extendedprice - (a * l_quantity + b), 2))) AS BIGINT) AS mse,
       round(avg(power(l_extendedprice - (a * l_quantity + b), 2)), 2) AS exact, CAST(0 AS BIGINT) AS unscored
FROM lineitem, f WHERE l_shipdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-01-01'
""",
    "score_rows": """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b
           FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-01-01')
SELECT l_orderkey, l_linenumber, round(a * l_quantity + b, 4) AS prediction
FROM lineitem, f WHERE l_shipdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-01-01'
""",
    "network_challenger": """
WITH l AS (SELECT l_shipdate, l_quantity, abs(l_quantity - 25) AS bent FROM lineitem),
f AS (SELECT regr_slope(bent, l_quantity) AS a, regr_intercept(bent, l_quantity) AS b FROM l
      WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-01-01')
SELECT round(avg(power(bent - (a * l_quantity + b), 2)), 4) AS line, true AS network_better, CAST(0 AS BIGINT) AS unscored
FROM l, f WHERE l_shipdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-01-01'
""",
    "score_segments": """
WITH f AS (SELECT l_linenumber, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b
           FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-01-01' GROUP BY l_linenumber)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN CAST(1 AS BIGINT) END AS version,
       CASE WHEN l_linenumber <> 3 THEN round(a * l_quantity + b, 4) END AS prediction
FROM lineitem JOIN f USING (l_linenumber) WHERE l_shipdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-01-01'
""",
    "compare_versions": """
WITH tr AS (SELECT * FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-01-01'),
va AS (SELECT * FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-01-01'),
f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b, avg(l_extendedprice) AS m FROM tr)
SELECT 1 AS version, CAST(round(avg(power(l_extendedprice - m, 2))) AS BIGINT) AS mse FROM va, f
UNION ALL
SELECT 2, CAST(round(avg(power(l_extendedprice - (a * l_quantity + b), 2))) AS BIGINT) FROM va, f
""",
    "preview_top_name": """
SELECT s_suppkey, s_name FROM supplier ORDER BY s_name DESC LIMIT 1
""",
    "path_roundtrip": """
SELECT * FROM nation ORDER BY n_nationkey LIMIT 10
""",
    "table_overwrite": """
SELECT * FROM customer
""",
    "sync_reconcile": f"""
SELECT table_name, n_rows AS source_rows, n_rows AS target_rows, true AS matches FROM ({_ROWS_OF_TABLES})
""",
    "cleanup_candidates": """
SELECT DISTINCT p_type AS db FROM part WHERE contains(p_type, 'AN') OR contains(p_type, 'ECO')""",
    "forecast_vs_actual": """
WITH daily AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
w AS (SELECT * FROM daily WHERE day BETWEEN DATE '2001-06-15' - 5 AND DATE '2001-06-15' + 5),
t AS (SELECT day, n, row_number() OVER (ORDER BY day DESC) AS rn FROM daily),
f AS (SELECT day, n, day <= DATE '2001-06-15' AS has_actual FROM w WHERE (SELECT count(*) FROM w) >= 10
      UNION ALL
      SELECT day, n, rn BETWEEN 6 AND 10 FROM t WHERE rn <= 10 AND (SELECT count(*) FROM w) < 10)
SELECT p.day, p.n * 2 AS prediction, a.n AS actual
FROM f AS p LEFT JOIN (SELECT day, n FROM f WHERE has_actual) AS a ON p.day = a.day""",
    "holdout_tail": """
SELECT o_orderkey, o_totalprice,
       row_number() OVER (ORDER BY o_orderkey) > floor((SELECT count(*) FROM orders) * 0.8) AS held_back
FROM orders""",
    "table_inventory": f"""
SELECT table_name, 'parquet' AS format, 'EXTERNAL' AS type, CAST(-1 AS BIGINT) AS last_access, n_rows
FROM ({_ROWS_OF_TABLES})""",
    "column_inventory": f"""
SELECT c.table_name, c.column_name, c.position, c.data_type, r.n_rows
FROM ({_ROWS_OF_TABLES}) AS r
JOIN (SELECT DISTINCT table_name, column_name, CAST(ordinal_position AS INTEGER) AS position,
             CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
                            WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
                            ELSE lower(data_type) END AS data_type
      FROM information_schema.columns) AS c ON c.table_name = r.table_name""",
    "owned_by": """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "describe_tables": f"""
SELECT table_name, false AS is_view, false AS is_delta, false AS should_copy, n_rows
FROM ({_ROWS_OF_TABLES})""",
    "read_series": """
SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1""",
    "conform": """
SELECT c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey, 'absent' AS c_comment
FROM customer""",
    "upgrade_plan_again": """
WITH v AS (SELECT 'm' || (o_custkey % 50) AS model,
                  CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS BIGINT) AS version,
                  o_orderpriority <> '5-LOW' OR o_custkey % 50 % 2 = 0 AS has_signature FROM orders),
s AS (SELECT model, version, CASE WHEN version <= 10 THEN 'EXISTS' WHEN has_signature THEN 'READY' ELSE 'NO_SIGNATURE' END AS status
      FROM v)
SELECT model, version, 'main.migrated_models.' || model AS dest_name, status,
       CASE WHEN status = 'READY' THEN 10 + row_number() OVER (PARTITION BY model, status ORDER BY version) END AS dest_version
FROM s""",
}
