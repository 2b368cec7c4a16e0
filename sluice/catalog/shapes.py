"""Submissions, trees, jobs and attempts built from the given tables.

Each text is plain SQL that Spark and the oracle both run; sizes and keys decide
which rows are faulty, so every rule fires somewhere.
"""

PRICE = "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)"

PRODUCTS = f"""
SELECT p_type AS submission_id, p_partkey + 1 AS row_index,
  CASE WHEN p_size = 17 THEN '  ' WHEN p_size IN (9, 18, 27) THEN p_brand
       WHEN p_size = 19 THEN repeat('s', 65)
       ELSE ' ' || lower(replace(p_brand, '#', '-')) || '_' || CAST(p_size AS STRING) END AS sku,
  CASE WHEN p_size = 13 THEN ' ' WHEN p_size = 14 THEN repeat('n', 201)
       ELSE ' ' || p_name || ' ' END AS name,
  CASE p_size WHEN 1 THEN {PRICE} || '5' WHEN 2 THEN '-' || {PRICE} WHEN 3 THEN 'abc'
       WHEN 4 THEN '' WHEN 5 THEN '9e6' WHEN 6 THEN '99999999' WHEN 7 THEN '1e400'
       WHEN 8 THEN '+5' WHEN 10 THEN '12.' WHEN 11 THEN 'inf' WHEN 12 THEN '5d'
       ELSE ' ' || {PRICE} END AS price,
  CASE WHEN p_size IN (20, 21, 22) THEN ' ' WHEN p_size = 23 THEN 'us1'
       WHEN p_size = 24 THEN NULL ELSE ' ' || lower(substr(p_type, 1, 3)) END AS currency,
  CASE WHEN p_size = 26 THEN repeat('c', 101) WHEN p_size = 28 THEN '  '
       ELSE ' ' || p_type || ' ' END AS category,
  CASE WHEN p_size = 29 THEN repeat('d', 2001) ELSE p_name || ' by ' || p_brand END
       AS description,
  CASE p_size WHEN 30 THEN '-1' WHEN 31 THEN '1.5' WHEN 32 THEN ' '
       WHEN 33 THEN '99999999999999999999' WHEN 34 THEN '10000001' WHEN 35 THEN NULL
       ELSE CAST(p_size AS STRING) END AS stock_quantity
FROM {{part}}"""

USERS = """
SELECT c_mktsegment AS submission_id, c_custkey + 1 AS row_index,
  CASE WHEN c_nationkey = 3 THEN '  ' WHEN c_nationkey = 4 THEN repeat('n', 201)
       ELSE c_name END AS name,
  CASE c_nationkey WHEN 5 THEN replace(c_name, '#', '@')
       WHEN 6 THEN replace(c_name, '#', '@.') || '.com'
       WHEN 7 THEN replace(c_name, '#', '@') || '@x.co' WHEN 8 THEN '@x.co'
       WHEN 9 THEN ' Shared@Example.COM' WHEN 10 THEN replace(c_name, '#', '@') || '.'
       WHEN 11 THEN replace(c_name, '#', '@') || '.É.' WHEN 12 THEN ''
       ELSE ' ' || replace(c_name, '#', '@') || '.Example.COM ' END AS email,
  CASE c_nationkey WHEN 13 THEN repeat('9', 33) WHEN 14 THEN '  ' WHEN 15 THEN NULL
       ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) END AS phone
FROM {customer}"""

CATEGORIES = """
SELECT 'suppliers' AS submission_id, s_suppkey + 1 AS row_index,
  CASE WHEN s_nationkey = 3 THEN ' ' WHEN s_nationkey = 4 THEN '###' ELSE s_name END AS name,
  CASE WHEN s_nationkey = 5 THEN ' The Same! ' WHEN s_nationkey = 6 THEN repeat('s', 201)
       ELSE '' END AS slug,
  CASE WHEN s_nationkey = 7 THEN repeat('d', 2001) ELSE ' about ' || s_name END AS description,
  CASE WHEN s_nationkey = 8 THEN s_name WHEN s_nationkey = 9 THEN '!!'
       WHEN s_nationkey = 10 THEN NULL ELSE 'Nation ' || CAST(s_nationkey AS STRING) END
       AS parent_slug
FROM {supplier}
UNION ALL
SELECT CAST(n_regionkey AS STRING), n_nationkey + 1, n_name, NULL, '',
       'Region ' || CAST(n_regionkey AS STRING) FROM {nation}
UNION ALL
SELECT CAST(r_regionkey AS STRING), r_regionkey + 1000, r_name,
       'region ' || CAST(r_regionkey AS STRING), NULL, ' ' FROM {region}"""

# Regions are roots, nations their children; one region hangs below its own
# nation (a cycle).  Suppliers are leaves, some under an unknown parent.
# Customers form chains twenty apart, long enough to pass the depth limit.
CHAIN_PARENT = ("CASE WHEN c_custkey < 20 THEN 'NATION_' || CAST(c_custkey AS STRING) "
                "ELSE 'Customer#' || lpad(CAST(c_custkey - 20 AS STRING), 9, '0') END")
REGION_ROWS = "SELECT r_name AS name, CAST(NULL AS STRING) AS parent FROM {region}"
NATION_ROWS = ("SELECT n_name AS name, r_name AS parent FROM {nation} "
               "JOIN {region} ON n_regionkey = r_regionkey")
LEAF_ROWS = f"""
SELECT s_name AS name, CASE WHEN s_acctbal < 1000 THEN 'Ghost' ELSE 'NATION_' ||
  CAST(s_nationkey AS STRING) END AS parent FROM {{supplier}}
UNION ALL SELECT c_name, {CHAIN_PARENT} FROM {{customer}}"""
LOOPED_REGION = ("SELECT r_name AS name, CASE WHEN r_name = 'ASIA' THEN 'NATION_2' END "
                 "AS parent FROM {region}")
TREE = f"{LOOPED_REGION} UNION ALL {NATION_ROWS} UNION ALL {LEAF_ROWS}"
STORED_TREE = f"{REGION_ROWS} UNION ALL {NATION_ROWS}"
ACCEPTED_TREE = f"{LOOPED_REGION} UNION ALL {LEAF_ROWS}"

ORDER_STATUS = """
CASE o_orderstatus
  WHEN 'F' THEN CASE WHEN o_totalprice < 50000 THEN 'dead_letter'
                     WHEN o_totalprice < 100000 THEN 'failed'
                     WHEN o_totalprice < 120000 THEN 'cancelled' ELSE 'succeeded' END
  WHEN 'O' THEN CASE WHEN o_totalprice < 150000 THEN 'retrying' ELSE 'queued' END
  ELSE CASE WHEN o_totalprice < 100000 THEN 'pending' ELSE 'running' END END"""

ORDER_JOBS = f"""
SELECT o_orderkey AS id, o_orderpriority AS queue_name, o_custkey AS workload_id,
  CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, {ORDER_STATUS} AS status,
  o_orderdate AS created_at, o_orderdate AS updated_at,
  CAST(o_orderkey % 9 AS INT) AS attempt_count,
  CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '2-HIGH' THEN 'other'
       ELSE 'user.process' END AS job_type
FROM {{orders}}"""

LINE_JOBS = """
SELECT l_orderkey AS workload_id,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'dead_letter'
       WHEN l_returnflag = 'R' THEN 'retrying'
       WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'queued'
       WHEN l_linestatus = 'O' AND l_linenumber = 2 THEN 'running'
       WHEN l_quantity < 3 THEN 'failed' ELSE 'succeeded' END AS status
FROM {lineitem}"""

ORDER_WORKLOADS = """
SELECT o_orderkey AS id, o_orderpriority AS type, CAST(o_orderkey % 7 AS BIGINT) AS total_items
FROM {orders}"""

_ATTEMPTS = """
SELECT user_id AS job_id, event_id AS attempt_id, ts AS started_at, {finished} AS finished_at,
  CASE WHEN event_type = 'purchase' AND value < 1 THEN 'succeeded'
       WHEN event_type = 'signup' AND value < 0.3 THEN 'cancelled'
       WHEN event_type = 'click' THEN 'timed_out' ELSE 'failed' END AS outcome,
  event_type = 'error' AND user_id % 3 <> 0 AS retryable,
  event_type || ' ' || CAST(event_id AS STRING) AS error_message
FROM {events}"""
SPARK_ATTEMPTS = _ATTEMPTS.replace(
    "{finished}", "timestampadd(MILLISECOND, CAST(floor(value * 10) AS INT), ts)")
ORACLE_ATTEMPTS = _ATTEMPTS.replace("{events}", "events").replace(
    "{finished}", "ts + to_milliseconds(CAST(floor(value * 10) AS INT))")

_CUSTOMER_JOBS = """
SELECT c_custkey AS id,
  CASE c_nationkey WHEN 1 THEN 'succeeded' WHEN 2 THEN 'cancelled' ELSE 'queued' END AS status,
  c_nationkey % 3 AS attempt_count, CAST(3 + c_custkey % 60 AS INT) AS max_attempts,
  CASE WHEN c_nationkey = 4 THEN 'earlier' END AS last_error,
  CAST('2023-12-31 00:00:00' AS {ts}) AS updated_at
FROM {customer}"""
SPARK_CUSTOMER_JOBS = _CUSTOMER_JOBS.replace("{ts}", "TIMESTAMP_NTZ")
ORACLE_CUSTOMER_JOBS = _CUSTOMER_JOBS.replace("{customer}", "customer").replace(
    "{ts}", "TIMESTAMP")

METRICS = """
SELECT event_type AS name,
  CASE WHEN event_type IN ('view', 'click') THEN 'counter'
       WHEN event_type = 'signup' THEN 'gauge' ELSE 'histogram' END AS kind,
  CAST(round(value * 100) AS BIGINT) AS value, ts, event_id
FROM {events}"""

# Words of whole documents laid out as boxes: every fourth gap is wide.
_WORD_BOXES = """
  0 AS level_zero, 100 * word + 300 * (word DIV 4) AS left, 30 * line AS top,
  60 + length(text) % 30 AS width, 20 + word % 3 AS height,
  CAST((length(text) * 13 + line) % 101 - 1 AS DOUBLE) AS confidence,
  1 + line DIV 40 AS block_num, 1 AS par_num, line + 1 AS line_num"""
SPARK_WORDS = f"""
WITH lines AS (SELECT doc_id, p.pos AS line, p.col AS raw FROM {{documents}},
                 LATERAL posexplode(split(text, '\\n')) AS p),
words AS (SELECT doc_id, line, w.pos AS word, w.col AS text FROM lines,
            LATERAL posexplode(split(raw, ' ')) AS w)
SELECT CAST(doc_id AS STRING) AS submission_id, line * 100000 + word AS word_pos, text,
{_WORD_BOXES.replace('0 AS level_zero, ', '')}
FROM words WHERE text <> ''"""
ORACLE_WORDS = f"""
SELECT CAST(doc_id AS STRING) AS submission_id, line * 100000 + word AS word_pos, text,
{_WORD_BOXES.replace('0 AS level_zero, ', '').replace(' DIV ', ' // ')}
FROM (SELECT doc_id, line, unnest(string_split(raw, ' ')) AS text,
        generate_subscripts(string_split(raw, ' '), 1) - 1 AS word
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
              generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
            FROM documents)) WHERE text <> ''"""
