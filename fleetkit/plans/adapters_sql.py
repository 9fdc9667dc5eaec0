"""DuckDB text of the adapter views (twin of ``fleetkit.sources.testdata``).

Every oracle query is ``WITH <these CTEs> <query>``; DuckDB inlines and
prunes the CTEs it does not use.
"""

ADAPTER_CTES = r"""
tools AS (
  SELECT 'TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END) AS tool_code,
         p_name AS tool_name, p_type AS category, p_brand AS location,
         DATE '1995-01-01' + CAST((p_partkey * 37) % 1500 AS INTEGER) AS purchase_date,
         CAST(NULL AS DATE) AS last_maintenance_date,
         CASE WHEN p_partkey % 17 = 0 THEN CAST(NULL AS DATE)
              ELSE DATE '2001-11-11' + CAST((p_partkey * 13) % 120 AS INTEGER) END AS next_maintenance_due,
         CASE WHEN p_partkey % 10 < 3 THEN 'in_use' WHEN p_partkey % 10 = 3 THEN 'maintenance'
              ELSE 'available' END AS status,
         CAST(10.0 - CAST(p_size AS DOUBLE) * 0.171875 AS DOUBLE) AS condition_score,
         CAST(0.0 AS DOUBLE) AS usage_hours,
         CAST(0 AS DECIMAL(18,2)) AS maintenance_cost,
         TIMESTAMP '2001-01-01 00:00:00' AS created_at,
         TIMESTAMP '2001-01-01 00:00:00' AS updated_at
  FROM part),
usage_history AS (
  SELECT CAST((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 1048576
              + (CAST(l_partkey AS BIGINT) * 7919 + l_suppkey) % 1048573 AS BIGINT) AS seq,
         'TL-' || (CASE WHEN length(CAST(l_partkey AS VARCHAR)) < 6 THEN lpad(CAST(l_partkey AS VARCHAR), 6, '0') ELSE CAST(l_partkey AS VARCHAR) END) AS tool_code,
         'U' || CAST(l_suppkey AS VARCHAR) AS user_id,
         CASE WHEN l_linenumber = 7 THEN CAST(NULL AS TIMESTAMP)
              ELSE l_shipdate + to_hours(CAST(l_linenumber + 7 AS BIGINT)) END AS checkout_time,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_hours(CAST(l_linenumber + 8 AS BIGINT))
              ELSE CAST(NULL AS TIMESTAMP) END AS checkin_time,
         CASE WHEN l_returnflag = 'R' THEN CAST(NULL AS DOUBLE) ELSE l_quantity / 4.0 END AS usage_duration,
         CASE WHEN l_linestatus = 'O' THEN 'checkout' ELSE 'checkin' END AS usage_type,
         CAST(NULL AS VARCHAR) AS notes,
         l_shipdate AS created_at
  FROM lineitem),
recent_usage AS (
  SELECT -event_id AS seq, 'TL-' || (CASE WHEN length(CAST(user_id AS VARCHAR)) < 6 THEN lpad(CAST(user_id AS VARCHAR), 6, '0') ELSE CAST(user_id AS VARCHAR) END) AS tool_code,
         'U' || CAST(event_id % 97 AS VARCHAR) AS user_id, ts AS checkout_time, CAST(NULL AS TIMESTAMP) AS checkin_time,
         CAST(NULL AS DOUBLE) AS usage_duration, 'checkout' AS usage_type, CAST(NULL AS VARCHAR) AS notes, ts AS created_at
  FROM events WHERE event_type = 'purchase'),
listed_tools AS (
  SELECT 'TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END) AS tool_code
  FROM part WHERE p_size < 45),
maintenance_history AS (
  SELECT CAST((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 1048576
              + (CAST(l_partkey AS BIGINT) * 7919 + l_suppkey) % 1048573 AS BIGINT) AS seq,
         'TL-' || (CASE WHEN length(CAST(l_partkey AS VARCHAR)) < 6 THEN lpad(CAST(l_partkey AS VARCHAR), 6, '0') ELSE CAST(l_partkey AS VARCHAR) END) AS tool_code,
         CAST(l_shipdate AS DATE) AS maintenance_date,
         o_orderpriority AS maintenance_type,
         'order ' || CAST(l_orderkey AS VARCHAR) AS description,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS cost,
         s_name AS technician,
         CASE WHEN l_linenumber = 1 THEN CAST(NULL AS DOUBLE) ELSE 10.0 - l_quantity / 16.0 END - 1.0
           AS condition_before,
         CASE WHEN l_linenumber = 1 THEN CAST(NULL AS DOUBLE) ELSE 10.0 - l_quantity / 16.0 END
           AS condition_after,
         l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_returnflag = 'R'),
maintenance_facts AS (
  SELECT CAST((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 1048576
              + (CAST(l_partkey AS BIGINT) * 7919 + l_suppkey) % 1048573 AS BIGINT) AS seq,
         'TL-' || (CASE WHEN length(CAST(l_partkey AS VARCHAR)) < 6 THEN lpad(CAST(l_partkey AS VARCHAR), 6, '0') ELSE CAST(l_partkey AS VARCHAR) END) AS tool_code,
         CAST(l_shipdate AS DATE) AS maintenance_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS cost,
         CASE WHEN l_linenumber = 1 THEN CAST(NULL AS DOUBLE) ELSE 10.0 - l_quantity / 16.0 END - 1.0
           AS condition_before,
         CASE WHEN l_linenumber = 1 THEN CAST(NULL AS DOUBLE) ELSE 10.0 - l_quantity / 16.0 END AS condition_after,
         l_shipdate AS created_at
  FROM lineitem WHERE l_returnflag = 'R'),
tool_events AS (
  SELECT event_id AS seq, ts,
         'TL-' || (CASE WHEN length(CAST(user_id AS VARCHAR)) < 6 THEN lpad(CAST(user_id AS VARCHAR), 6, '0') ELSE CAST(user_id AS VARCHAR) END) AS tool_code,
         'U' || CAST(event_id % 97 AS VARCHAR) AS user_id,
         CASE WHEN event_type = 'view' THEN 'checkout' ELSE 'checkin' END AS event_kind
  FROM events WHERE event_type IN ('view', 'click')),
scans AS (
  SELECT event_id AS seq, ts,
         'TL-' || (CASE WHEN length(CAST((user_id * 7 + event_id) % (2 * (SELECT count(*) FROM part)) AS VARCHAR)) < 6 THEN lpad(CAST((user_id * 7 + event_id) % (2 * (SELECT count(*) FROM part)) AS VARCHAR), 6, '0') ELSE CAST((user_id * 7 + event_id) % (2 * (SELECT count(*) FROM part)) AS VARCHAR) END)
           AS code
  FROM events WHERE event_type IN ('error', 'signup')),
status_updates AS (
  SELECT event_id AS seq,
         'TL-' || (CASE WHEN length(CAST((user_id * 7 + event_id) % (2 * (SELECT count(*) FROM part)) AS VARCHAR)) < 6 THEN lpad(CAST((user_id * 7 + event_id) % (2 * (SELECT count(*) FROM part)) AS VARCHAR), 6, '0') ELSE CAST((user_id * 7 + event_id) % (2 * (SELECT count(*) FROM part)) AS VARCHAR) END)
           AS tool_code,
         CASE WHEN event_type = 'error' THEN 'maintenance' ELSE 'available' END AS status
  FROM events WHERE event_type IN ('error', 'signup')),
intake AS (
  SELECT p_partkey * 4 AS seq, 'TN-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END) AS tool_code,
         CASE WHEN p_partkey % 11 = 0 THEN CAST(NULL AS VARCHAR) WHEN p_partkey % 13 = 0 THEN ''
              ELSE p_name END AS tool_name,
         p_type AS category, p_brand AS location,
         DATE '1995-01-01' + CAST((p_partkey * 37) % 1500 AS INTEGER) AS purchase_date,
         CAST(10.0 - CAST(p_size AS DOUBLE) * 0.171875 AS DOUBLE) AS condition_score
  FROM part
  UNION ALL
  SELECT p_partkey * 4 + 3, 'TN-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END), p_name, p_type, p_brand,
         DATE '1995-01-01' + CAST((p_partkey * 37) % 1500 AS INTEGER),
         CAST(10.0 - CAST(p_size AS DOUBLE) * 0.171875 AS DOUBLE)
  FROM part WHERE p_partkey % 7 = 0
  UNION ALL
  SELECT p_partkey * 4 + 1, 'TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END), p_name, p_type, p_brand,
         DATE '1995-01-01' + CAST((p_partkey * 37) % 1500 AS INTEGER),
         CAST(10.0 - CAST(p_size AS DOUBLE) * 0.171875 AS DOUBLE)
  FROM part WHERE p_partkey % 5 = 0
  UNION ALL
  SELECT p_partkey * 4 + 2, 'TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END), p_name, p_type, p_brand,
         DATE '1995-01-01' + CAST((p_partkey * 37) % 1500 AS INTEGER),
         CAST(10.0 - CAST(p_size AS DOUBLE) * 0.171875 AS DOUBLE)
  FROM part WHERE p_partkey % 5 = 0),
prediction_inputs AS (
  SELECT 'TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END) AS tool_code,
         CAST(p_size AS DOUBLE) / 5.0 AS condition_pred,
         CAST((p_partkey * 7) % 101 - 50 AS DOUBLE) / 25.0 AS anomaly_score
  FROM part),
label_batch AS (
  SELECT p_partkey * 3 AS seq,
         CASE WHEN p_partkey % 97 = 0 THEN CAST(NULL AS VARCHAR)
              ELSE 'TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END) END AS tool_code,
         p_name AS tool_name
  FROM part
  UNION ALL
  SELECT p_partkey * 3 + 1, 'TL/' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END), p_name
  FROM part WHERE p_partkey % 50 = 0
  UNION ALL
  SELECT p_partkey * 3 + 2, 'TL ' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END), p_name
  FROM part WHERE p_partkey % 50 = 0),
raw_codes AS (
  SELECT p_partkey AS seq,
         CASE p_partkey % 9
           WHEN 0 THEN lower('TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END))
           WHEN 1 THEN p_name
           WHEN 2 THEN p_brand
           WHEN 3 THEN 'TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END) || chr(10)
           WHEN 4 THEN 'TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END) || chr(13) || chr(10)
           WHEN 5 THEN substr('TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END), 1, 2)
           WHEN 6 THEN repeat('TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END), 3)
           WHEN 7 THEN CASE WHEN p_partkey % 2 = 0 THEN '' ELSE CAST(NULL AS VARCHAR) END
           ELSE 'TL-' || (CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END) END AS code
  FROM part),
raw_timestamps AS (
  SELECT o_orderkey AS seq,
         CASE o_orderkey % 5
           WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
           WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T09:00:00.5'
           WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
           WHEN 3 THEN 'bad'
           ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 23:59:59' END AS raw
  FROM orders)
"""


def with_adapters(query: str) -> str:
    """Prefix the adapter CTEs; ``query`` is a SELECT or starts with more
    CTE definitions (``name AS (...), ... SELECT``)."""
    q = query.strip()
    sep = "\n" if q[:6].upper() == "SELECT" else ",\n"
    return "WITH " + ADAPTER_CTES.strip() + sep + q
