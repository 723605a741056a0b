"""SQL oracles: for every registered query, DuckDB SQL that computes the same
result directly from the test tables (registered as views).

The derivation rules mirror :mod:`tidewater.plans.inputs` (nulls injected by
the row key) and :func:`tidewater.queries.mirror_sides`; column names and
types match the Spark results (CSV inference gives INTEGER for small whole
numbers, hence the casts).
"""

from __future__ import annotations

_DERIVED = """
    SELECT CAST(l_orderkey AS INTEGER) AS order_key,
           l_linenumber AS line_number,
           l_quantity AS quantity,
           CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_extendedprice END AS price,
           CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey AS INTEGER) END AS seller,
           CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_linestatus END AS status,
           l_returnflag AS return_flag
    FROM lineitem"""
_KEPT = f"""
    SELECT price, seller, status FROM ({_DERIVED}) d
    WHERE price IS NOT NULL OR seller IS NOT NULL OR status IS NOT NULL"""
_NAN_KEPT = f"""
    SELECT price, seller, status FROM (
        SELECT CASE WHEN order_key % 2 <> 0 AND order_key % 7 = 0
                    THEN CAST('NaN' AS DOUBLE) ELSE price END AS price,
               seller, status
        FROM ({_DERIVED}) d) n
    WHERE NOT (price IS NULL OR isnan(price)) OR seller IS NOT NULL OR status IS NOT NULL"""
_COUNTS = f"""
    SELECT count(*) AS input_rows,
           count(*) FILTER (WHERE price IS NOT NULL OR seller IS NOT NULL
                            OR status IS NOT NULL) AS output_rows
    FROM ({_DERIVED}) d"""
_NAN_COUNTS = f"""
    SELECT (SELECT count(*) FROM lineitem) AS input_rows, count(*) AS output_rows
    FROM ({_NAN_KEPT}) k"""
_RUN_AGG = """
    SELECT count(*) AS n_rows, count(price) AS n_price, count(DISTINCT seller) AS n_sellers,
           min(price) AS min_price, max(price) AS max_price,
           count(CASE WHEN status = 'F' THEN 1 END) AS n_status_f"""
_CUSTOMER_TGT = """
    SELECT c_custkey,
           CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS c_name,
           c_nationkey, c_acctbal, c_mktsegment
    FROM customer"""
_CUSTOMER_SRC = f"""
    SELECT c_custkey, c_name, c_nationkey,
           CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
    FROM ({_CUSTOMER_TGT}) t WHERE c_custkey % 10 <> 3
    UNION ALL
    SELECT -(c_custkey + 1) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM ({_CUSTOMER_TGT}) t WHERE c_custkey % 13 = 0"""
_MIRROR_DIFF = f"""
    SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey,
           CASE WHEN s.c_custkey IS NULL THEN t.c_name ELSE s.c_name END AS c_name,
           CASE WHEN s.c_custkey IS NULL THEN t.c_nationkey ELSE s.c_nationkey END AS c_nationkey,
           CASE WHEN s.c_custkey IS NULL THEN t.c_acctbal ELSE s.c_acctbal END AS c_acctbal,
           CASE WHEN s.c_custkey IS NULL THEN t.c_mktsegment ELSE s.c_mktsegment END
               AS c_mktsegment,
           CASE WHEN t.c_custkey IS NULL THEN 'insert'
                WHEN s.c_custkey IS NULL THEN 'delete'
                WHEN s.c_name IS DISTINCT FROM t.c_name
                  OR s.c_nationkey IS DISTINCT FROM t.c_nationkey
                  OR s.c_acctbal IS DISTINCT FROM t.c_acctbal
                  OR s.c_mktsegment IS DISTINCT FROM t.c_mktsegment THEN 'update'
                ELSE 'same' END AS change
    FROM ({_CUSTOMER_SRC}) s FULL OUTER JOIN ({_CUSTOMER_TGT}) t ON s.c_custkey = t.c_custkey"""
_EVENTS_KEPT = """
    SELECT strftime(ts, '%Y%m%d') AS run_date, count(*) AS n
    FROM events
    WHERE user_id IS NOT NULL OR event_type IS NOT NULL
       OR NOT (value IS NULL OR isnan(value))
    GROUP BY 1"""

_HEADERS = f"""
    SELECT order_key, line_number, CASE WHEN order_key % 3 <> 1 THEN quantity END AS quantity, price, seller,
           CASE WHEN order_key % 3 <> 2 THEN status END AS status,
           CASE WHEN order_key % 3 <> 1 THEN return_flag END AS return_flag,
           CASE WHEN order_key % 3 = 1 THEN 'x,y' END AS note
    FROM ({_DERIVED}) d"""
_FOLLOWED = f"""
    SELECT CASE WHEN order_key % 4 = 1 THEN price + 1 ELSE price END AS price, seller, status, order_key
    FROM ({_DERIVED}) d
    WHERE order_key % 4 <> 2 AND (price IS NOT NULL OR seller IS NOT NULL OR status IS NOT NULL)"""
_WHOLE = f"""
    SELECT CAST(floor(price) AS DOUBLE) AS price, seller, status FROM ({_KEPT}) k"""
_DRIFT = f"""
    SELECT '20240101' AS run_date, * FROM ({_WHOLE}) a
    UNION ALL SELECT '20240102', * FROM ({_KEPT}) b
    UNION ALL SELECT '20240103', price, seller, NULL FROM ({_DERIVED}) c
    WHERE price IS NOT NULL OR seller IS NOT NULL"""
_UNPARSABLE_TEXT = f"""
    SELECT CASE WHEN price IS NULL THEN NULL WHEN order_key % 11 = 0 THEN 'n/a'
                ELSE CAST(price AS VARCHAR) END AS price, seller, status
    FROM ({_DERIVED}) d WHERE price IS NOT NULL OR seller IS NOT NULL OR status IS NOT NULL"""

ORACLE_SQL: dict[str, str] = {
    "csv_scan_infer": _DERIVED,
    "project_three": f"SELECT price, seller, status FROM ({_DERIVED}) d",
    "csv_to_parquet_run": _KEPT,
    "drop_all_null_nan": _NAN_KEPT,
    "run_metrics": f"""
        SELECT input_rows, output_rows, output_rows AS written_rows, 'VERIFIED' AS status
        FROM ({_COUNTS}) c""",
    "schema_report": """
        SELECT * FROM (VALUES
            (1, 'order_key', 'int', true),
            (2, 'line_number', 'int', true),
            (3, 'quantity', 'double', true),
            (4, 'price', 'double', true),
            (5, 'seller', 'int', true),
            (6, 'status', 'string', true),
            (7, 'return_flag', 'string', true)
        ) AS t(position, name, type, nullable)""",
    "published_schema": """
        SELECT * FROM (VALUES
            (1, 'price', 'double', true),
            (2, 'seller', 'int', true),
            (3, 'status', 'string', true)
        ) AS t(position, name, type, nullable)""",
    "preview_rows": f"""
        SELECT price, seller, status FROM ({_KEPT}) k
        ORDER BY price ASC NULLS FIRST, seller ASC NULLS FIRST, status ASC NULLS FIRST
        LIMIT 10""",
    "runs_union": f"""
        SELECT '20240101' AS run_date, count(*) AS n_rows, count(price) AS n_price,
               count(seller) AS n_seller, count(status) AS n_status
        FROM ({_KEPT}) k
        UNION ALL
        SELECT '20240102', count(*), count(price), count(seller), count(status)
        FROM ({_KEPT}) k""",
    "runs_sql": f"""
        SELECT '20240101' AS run_date, a.* FROM ({_RUN_AGG} FROM ({_KEPT}) k) a
        UNION ALL
        SELECT '20240102' AS run_date, a.* FROM ({_RUN_AGG} FROM ({_KEPT}) k) a""",
    "runs_all_attempts": f"""
        SELECT '20240101' AS run_date,
               (SELECT count(*) FROM ({_NAN_KEPT}) a) + (SELECT count(*) FROM ({_KEPT}) b)
                   AS n_rows,
               CAST(2 AS BIGINT) AS n_attempts_with_rows
        UNION ALL
        SELECT '20240102', (SELECT count(*) FROM ({_KEPT}) c), CAST(1 AS BIGINT)""",
    "latest_verified": f"SELECT '20240101' AS run_date, price, seller, status FROM ({_KEPT}) k",
    "run_status": f"""
        SELECT '20240101' AS run_date, 'EMPTY' AS status, input_rows,
               CAST(0 AS BIGINT) AS output_rows, CAST(0 AS BIGINT) AS written_rows
        FROM ({_COUNTS}) c
        UNION ALL
        SELECT '20240102', 'VERIFIED', input_rows, output_rows, output_rows
        FROM ({_COUNTS}) c""",
    "daily_backfill": f"""
        WITH b AS (SELECT CAST(min(ts) AS DATE) - 1 AS lo, CAST(max(ts) AS DATE) + 1 AS hi
                   FROM events),
             d AS (SELECT strftime(g.day, '%Y%m%d') AS run_date
                   FROM b, generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP),
                                           INTERVAL 1 DAY) AS g(day))
        SELECT d.run_date,
               CASE WHEN coalesce(c.n, 0) = 0 THEN 'EMPTY' ELSE 'VERIFIED' END AS status,
               coalesce(c.n, 0) AS written_rows
        FROM d LEFT JOIN ({_EVENTS_KEPT}) c ON c.run_date = d.run_date""",
    "backfill_input_counts": f"""
        WITH b AS (SELECT CAST(min(ts) AS DATE) - 1 AS lo, CAST(max(ts) AS DATE) + 1 AS hi
                   FROM events),
             d AS (SELECT strftime(g.day, '%Y%m%d') AS run_date
                   FROM b, generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP),
                                           INTERVAL 1 DAY) AS g(day)),
             i AS (SELECT strftime(ts, '%Y%m%d') AS run_date, count(*) AS n FROM events
                   GROUP BY 1)
        SELECT d.run_date,
               CASE WHEN coalesce(c.n, 0) = 0 THEN 'EMPTY' ELSE 'VERIFIED' END AS status,
               coalesce(i.n, 0) AS input_rows,
               coalesce(c.n, 0) AS output_rows,
               coalesce(c.n, 0) AS written_rows
        FROM d LEFT JOIN ({_EVENTS_KEPT}) c ON c.run_date = d.run_date
               LEFT JOIN i ON i.run_date = d.run_date""",
    "mirror_diff": _MIRROR_DIFF,
    "mirror_apply": f"""
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
        FROM ({_MIRROR_DIFF}) m WHERE change <> 'delete'""",
    "ingest_stream": _KEPT,
    "csv_scan_declared": f"""
        SELECT *, CAST(NULL AS VARCHAR) AS _corrupt_record FROM ({_DERIVED}) d""",
    "overwrite_layout_run": f"""
        SELECT '20240101' AS run_date, price, seller, status FROM ({_KEPT}) k""",
    "run_audit": f"""
        SELECT '20240101' AS run_date, 'VERIFIED' AS status, input_rows,
               output_rows, output_rows AS written_rows FROM ({_NAN_COUNTS}) c
        UNION ALL
        SELECT '20240101', 'VERIFIED', input_rows, output_rows, output_rows FROM ({_COUNTS}) c
        UNION ALL
        SELECT '20240101', 'EMPTY', input_rows, CAST(0 AS BIGINT), CAST(0 AS BIGINT)
        FROM ({_COUNTS}) c
        UNION ALL
        SELECT '20240102', 'VERIFIED', input_rows, output_rows, output_rows FROM ({_COUNTS}) c""",
    "backfill_published": """
        SELECT strftime(ts, '%Y%m%d') AS run_date, CAST(user_id AS INTEGER) AS user_id,
               event_type, value
        FROM events
        WHERE user_id IS NOT NULL OR event_type IS NOT NULL
           OR NOT (value IS NULL OR isnan(value))""",
    "backfill_rebalanced": """
        SELECT strftime(ts, '%Y%m%d') AS run_date, CAST(user_id AS INTEGER) AS user_id,
               event_type, value
        FROM events
        WHERE user_id IS NOT NULL OR event_type IS NOT NULL
           OR NOT (value IS NULL OR isnan(value))""",
    "backfill_parity": f"""
        SELECT '20240101' AS run_date, 'VERIFIED' AS status, input_rows, output_rows,
               output_rows AS written_rows FROM ({_COUNTS}) c
        UNION ALL
        SELECT '20240102', 'VERIFIED', input_rows, output_rows, output_rows FROM ({_COUNTS}) c""",
    "quarantined_rows": """
        SELECT CAST(l_orderkey AS INTEGER) AS order_key, l_linenumber AS line_number
        FROM lineitem WHERE l_orderkey % 11 = 0 AND l_orderkey % 2 <> 0""",
    "mirror_copy": f"""
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
        FROM ({_MIRROR_DIFF}) m""",
    "compacted_run": _KEPT,
    "runs_catalog_sql": f"""
        SELECT '20240101' AS run_date, count(*) AS n_rows, count(price) AS n_price,
               count(seller) AS n_seller, count(status) AS n_status
        FROM ({_KEPT}) k
        UNION ALL
        SELECT '20240102', count(*), count(price), count(seller), count(status)
        FROM ({_KEPT}) k""",
    "published_semi_join": f"SELECT '20240102' AS run_date, price, seller, status FROM ({_KEPT}) k",
    "strict_scan": _DERIVED,
    "mirror_changes": f"""
        SELECT change, count(*) AS rows FROM ({_MIRROR_DIFF}) m GROUP BY change""",
    "mirror_publish": f"""
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
        FROM ({_MIRROR_DIFF}) m WHERE change <> 'delete'""",
    "job_log_metrics": f"""
        SELECT '20240101' AS run_date, 'input_rows' AS metric, input_rows AS value
        FROM ({_COUNTS}) c
        UNION ALL SELECT '20240101', 'output_rows', output_rows FROM ({_COUNTS}) c
        UNION ALL SELECT '20240101', 'written_rows', output_rows FROM ({_COUNTS}) c""",
    "scan_by_header": _HEADERS,
    "scan_by_header_declared": f"SELECT price, seller, status, line_number FROM ({_HEADERS}) h",
    "run_by_header": f"""
        SELECT price, seller, status FROM ({_HEADERS}) h
        WHERE price IS NOT NULL OR seller IS NOT NULL OR status IS NOT NULL""",
    "mirror_diff_digest": _MIRROR_DIFF,
    "mirror_few_changes": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 5 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus,
               CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'update' END AS change
        FROM orders, (SELECT max(o_orderkey) AS hi FROM orders) m
        WHERE o_orderkey BETWEEN hi // 2 AND hi // 2 + hi // 100 AND o_orderkey % 5 IN (0, 1)""",
    "ingest_batches": f"""
        SELECT 'VERIFIED' AS status, CAST(count(*) AS BIGINT) AS input_rows,
               CAST(count(*) FILTER (WHERE n) AS BIGINT) AS output_rows,
               CAST(count(*) FILTER (WHERE n) AS BIGINT) AS written_rows,
               CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS bad_rows
        FROM (SELECT price IS NOT NULL AND order_key % 11 = 0 AS bad,
                     (price IS NOT NULL AND order_key % 11 <> 0) OR seller IS NOT NULL OR status IS NOT NULL AS n
              FROM ({_DERIVED}) d) c""",
    "ingest_verified": _KEPT,
    "views_stay_current": f"""
        SELECT '20240101' AS run_date, count(*) AS n_rows, 1::BIGINT AS n_attempts,
               CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, 2::BIGINT AS n_recorded,
               count(*) AS written_rows FROM ({_KEPT}) k
        UNION ALL
        SELECT '20240102', count(*), 1, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE), 1, count(*)
        FROM ({_WHOLE}) w""",
    "retention_plan": f"""
        SELECT '20240101' AS run_date, 'SUPERSEDED' AS reason, count(*) AS written_rows FROM ({_NAN_KEPT}) n
        UNION ALL SELECT '20240102', 'SUPERSEDED', count(*) FROM ({_KEPT}) k""",
    "file_sync": f"SELECT price, seller, status FROM ({_FOLLOWED}) f",
    "file_sync_compacted": f"""
        SELECT count(*) AS n_rows, count(price) AS n_price,
               CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
               count(*) FILTER (WHERE order_key % 4 IN (1, 3)) AS rows_written,
               (SELECT count(*) FROM ({_DERIVED}) d WHERE order_key % 4 IN (1, 2)
                AND (price IS NOT NULL OR seller IS NOT NULL OR status IS NOT NULL)) AS rows_retracted
        FROM ({_FOLLOWED}) f""",
    "runs_changing_types": _DRIFT,
    "attempts_changing_types": f"""
        SELECT run_date, count(*) AS n_rows, count(DISTINCT attempt) AS n_attempts,
               CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, count(status) AS n_status
        FROM (SELECT *, 1 AS attempt FROM ({_DRIFT}) d
              UNION ALL SELECT '20240102', *, 2 FROM ({_WHOLE}) w) a
        GROUP BY run_date""",
    "overwritten_changing_types": _DRIFT,
    "runs_conflicting_types": f"""
        SELECT '20240101' AS run_date, CAST(price AS VARCHAR) AS price, seller, status FROM ({_KEPT}) k
        UNION ALL SELECT '20240102', * FROM ({_UNPARSABLE_TEXT}) u""",
    "schema_history": """
        SELECT * FROM (VALUES
            ('price', 'integer', 1::BIGINT, '20240101', '20240101'),
            ('price', 'double', 2::BIGINT, '20240102', '20240103'),
            ('seller', 'integer', 3::BIGINT, '20240101', '20240103'),
            ('status', 'string', 2::BIGINT, '20240101', '20240102')
        ) AS t("column", type, n_attempts, first_date, last_date)""",
}
