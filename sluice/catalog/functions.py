"""Queries over the column functions (FN-*)."""

from pyspark.sql import functions as F

from sluice import functions as fn
from sluice.catalog import shapes
from sluice.catalog.base import query, sql
from sluice.functions import status as st

UP, LOW = fn.text.UPPER, fn.text.LOWER
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
PADDED = "' ' || chr(9) || text || chr(11) || chr(10) || chr(13) || chr(12) || ' '"


@query("fn1_trim_ws", f"""
SELECT doc_id, md5(trim({PADDED}, {WS})) AS trimmed, strlen(trim({PADDED}, {WS})) AS bytes
FROM documents""")
def _(t):
    trimmed = fn.trim_ws(F.expr(PADDED))
    return t["documents"].select("doc_id", F.md5(trimmed).alias("trimmed"),
                                 F.octet_length(trimmed).cast("bigint").alias("bytes"))


@query("fn2_ascii_case", f"""
SELECT doc_id, md5(translate(text, '{UP}', '{LOW}')) AS lowered,
  md5(translate(text, '{LOW}', '{UP}')) AS raised FROM documents""")
def _(t):
    return t["documents"].select("doc_id", F.md5(fn.ascii_lower(F.col("text"))).alias("lowered"),
                                 F.md5(fn.ascii_upper(F.col("text"))).alias("raised"))


SLUG = (f"trim(regexp_replace(translate({{}}, '{UP}', '{LOW}'), '[^a-z0-9]+', '-', 'g'), '-')")


@query("fn3_slugify", f"""
SELECT 'd' || doc_id AS id, md5({SLUG.format('text')}) AS slug FROM documents
UNION ALL SELECT 'p' || p_partkey, md5({SLUG.format("p_name || ' & ' || p_brand")}) FROM part""")
def _(t):
    docs = t["documents"].select(F.concat(F.lit("d"), "doc_id").alias("id"),
                                 F.md5(fn.slugify(F.col("text"))).alias("slug"))
    parts = t["part"].select(
        F.concat(F.lit("p"), "p_partkey").alias("id"),
        F.md5(fn.slugify(F.concat("p_name", F.lit(" & "), "p_brand"))).alias("slug"))
    return docs.unionByName(parts)


@query("fn4_is_email", f"""
SELECT row_index, regexp_full_match(email, '[^@]+@[^@.][^@.]*[.][^@]+')
  AND strlen(email) BETWEEN 1 AND 320 AS valid FROM ({sql(shapes.USERS)})""")
def _(t):
    return t.shape(shapes.USERS).select("row_index", fn.is_email(F.col("email")).alias("valid"))


@query("fn5_is_sku", f"""
SELECT row_index, upper(trim(sku)) AS sku, regexp_full_match(upper(trim(sku)), '[A-Z0-9_-]+')
  AND strlen(trim(sku)) <= 64 AS valid FROM ({sql(shapes.PRODUCTS)})""")
def _(t):
    sku = fn.ascii_upper(fn.trim_ws(F.col("sku")))
    return t.shape(shapes.PRODUCTS).select("row_index", sku.alias("sku"),
                                           fn.is_sku(sku).alias("valid"))


@query("fn6_currency_code", f"""
SELECT row_index, code, regexp_full_match(code, '[A-Z][A-Z][A-Z]') AS valid FROM (
  SELECT row_index, coalesce(nullif(upper(trim(currency)), ''), 'USD') AS code
  FROM ({sql(shapes.PRODUCTS)}))""")
def _(t):
    code = fn.currency_code(F.col("currency"))
    return t.shape(shapes.PRODUCTS).select("row_index", code.alias("code"),
                                           fn.is_currency(code).alias("valid"))


@query("fn7_parse_price", f"""
SELECT row_index, CASE WHEN regexp_full_match(p, '-?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[0-9]+)?')
    AND NOT regexp_matches(p, '[.]...') AND TRY_CAST(p AS DOUBLE) BETWEEN 0 AND 10000000
  THEN CAST(TRY_CAST(p AS DOUBLE) AS DOUBLE) END AS price
FROM (SELECT row_index, trim(price) AS p FROM ({sql(shapes.PRODUCTS)}))""")
def _(t):
    price = fn.parse_price(fn.trim_ws(F.col("price")))
    return t.shape(shapes.PRODUCTS).select("row_index", price.cast("double").alias("price"))


@query("fn8_parse_stock", f"""
SELECT row_index, CASE WHEN s = '' THEN 0 WHEN regexp_full_match(s, '-?[0-9]+')
    AND TRY_CAST(s AS BIGINT) BETWEEN 0 AND 10000000 THEN TRY_CAST(s AS BIGINT) END AS stock
FROM (SELECT row_index, coalesce(trim(stock_quantity), '') AS s FROM ({sql(shapes.PRODUCTS)}))""")
def _(t):
    stock = fn.parse_stock(fn.trim_ws(F.col("stock_quantity")))
    return t.shape(shapes.PRODUCTS).select("row_index", stock.alias("stock"))


@query("fn9_bounded_text", """
SELECT doc_id, strlen(trim(text)) > 2000 AS too_long, nullif(trim(replace(lang, 'en', ' ')), '')
  AS lang FROM documents""")
def _(t):
    # A blank text is none, and none has no length; the SQL calls it not too long.
    text = fn.trim_ws(F.col("text"))
    return t["documents"].select(
        "doc_id", fn.longer_than(text, 2000).alias("too_long"),
        fn.bounded_text(F.replace("lang", F.lit("en"), F.lit(" "))).alias("lang"))


@query("fn10_format_price", """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS price FROM orders""")
def _(t):
    return t["orders"].select("o_orderkey", fn.format_price(F.col("o_totalprice")).alias("price"))


@query("fn11_payload_json", """
SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey > 3 THEN c_mktsegment END AS phone,
  c_nationkey > 3 AS has_phone FROM customer""")
def _(t):
    phone = F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).alias("phone")
    payload = fn.payload_json(F.col("c_name").alias("name"), phone)
    return t["customer"].select("c_custkey", payload.alias("p")).select(
        "c_custkey", F.get_json_object("p", "$.name").alias("name"),
        F.get_json_object("p", "$.phone").alias("phone"),
        F.contains("p", F.lit('"phone"')).alias("has_phone"))


@query("fn12_payload_field", """
SELECT doc_id, md5(text) AS body, lang, CAST(NULL AS VARCHAR) AS n_chars, CAST(NULL AS VARCHAR)
  AS absent FROM documents""")
def _(t):
    payload = F.to_json(F.struct(F.col("text").alias("body"), "lang", "n_chars"))
    read = t["documents"].select("doc_id", payload.alias("p"))
    return read.select("doc_id", F.md5(fn.payload_field(F.col("p"), "body")).alias("body"),
                       *[fn.payload_field(F.col("p"), k).alias(k)
                         for k in ("lang", "n_chars", "absent")])


@query("fn13_payload_best_effort", """
SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS absent,
  CAST(NULL AS VARCHAR) AS plain FROM events""")
def _(t):
    return t["events"].select(
        "event_id", fn.payload_best_effort(F.col("props"), "k").alias("k"),
        fn.payload_best_effort(F.col("props"), "absent").alias("absent"),
        fn.payload_best_effort(F.col("event_type"), "k").alias("plain"))


@query("fn15_to_iso8601", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(
  (epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS at FROM events""")
def _(t):
    return t["events"].select("event_id", fn.to_iso8601(F.col("ts")).alias("at"))


STABLE = ("regexp_replace(md5({}), '^(.{{8}})(.{{4}}).(.{{3}}).(.{{3}})(.{{12}})$', "
          r"'\1-\2-8\3-a\4-\5')")


@query("fn16_uuid", f"""
SELECT c_custkey, {STABLE.format("c_name || chr(31) || c_custkey")} AS id, true AS valid,
  false AS name_valid FROM customer""")
def _(t):
    uid = fn.stable_uuid(F.col("c_name"), F.col("c_custkey"))
    return t["customer"].select("c_custkey", uid.alias("id"), fn.is_uuid(uid).alias("valid"),
                                fn.is_uuid(F.col("c_name")).alias("name_valid"))


@query("fn17_compute_backoff", """
SELECT event_id, CASE WHEN n = 0 THEN 0 ELSE CAST(trunc(least(
    (100 + user_id) * pow(CASE event_type WHEN 'view' THEN 1.5 WHEN 'click' THEN 1 ELSE 2 END,
    n - 1), 60000.0)) AS BIGINT) END AS wait_ms
FROM (SELECT *, event_id % 40 AS n FROM events)""")
def _(t):
    n = F.col("event_id") % 40
    growth = (F.when(F.col("event_type") == "view", 1.5)
              .when(F.col("event_type") == "click", 1.0).otherwise(2.0))
    return t["events"].select("event_id", fn.compute_backoff(
        n, F.lit(100) + F.col("user_id"), F.lit(60000), growth).alias("wait_ms"))


@query("fn18_exhausted", "SELECT event_id, event_id % 7 >= 1 + user_id % 5 AS done FROM events")
def _(t):
    return t["events"].select("event_id", fn.exhausted(
        F.col("event_id") % 7, F.col("user_id") % 5 + 1).alias("done"))


@query("fn19_retry_policy_parse", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 1 + o_orderkey % 5 END AS max_attempts,
  CASE WHEN o_orderstatus <> 'P' THEN 1000 END AS initial_backoff_ms,
  CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS max_backoff_ms,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(1.5 AS DOUBLE) END AS backoff_multiplier FROM orders""")
def _(t):
    complete = F.col("o_orderstatus") != "P"
    text = F.to_json(F.struct(
        (F.col("o_orderkey") % 5 + 1).alias("max_attempts"),
        F.lit(1000).alias("initial_backoff_ms"),
        F.when(complete, F.col("o_custkey")).alias("max_backoff_ms"),
        F.lit(1.5).alias("backoff_multiplier")))
    policy = fn.retry_policy_parse(text)
    return t["orders"].select("o_orderkey", policy.alias("p")).select(
        "o_orderkey", F.col("p.max_attempts").cast("bigint").alias("max_attempts"),
        "p.initial_backoff_ms", "p.max_backoff_ms", "p.backoff_multiplier")


@query("fn20_classify_job_status", f"""
SELECT id, CASE WHEN status = 'succeeded' THEN 'succeeded' WHEN status = 'running' THEN 'running'
  WHEN status IN ('failed', 'cancelled', 'dead_letter') THEN 'failed' ELSE 'queued' END AS bucket
FROM ({sql(shapes.ORDER_JOBS)})""")
def _(t):
    return t.shape(shapes.ORDER_JOBS).select(
        "id", fn.classify_job_status(F.col("status")).alias("bucket"))


@query("fn21_derive_workload_status", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'succeeded'
  WHEN o_orderkey % 3 + o_custkey % 3 < o_orderkey % 5 THEN 'running'
  WHEN o_custkey % 3 > 0 THEN 'failed' ELSE 'succeeded' END AS status FROM orders""")
def _(t):
    key = F.col("o_orderkey")
    return t["orders"].select("o_orderkey", fn.derive_workload_status(
        key % 5, key % 3, F.col("o_custkey") % 3).alias("status"))


@query("fn22_progress_percent", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 100 ELSE CAST(floor(
  100.0 * (o_custkey % (1 + o_orderkey % 11)) / (o_orderkey % 11) + 0.5) AS BIGINT) END AS percent
FROM orders""")
def _(t):
    total = F.col("o_orderkey") % 11
    return t["orders"].select("o_orderkey", fn.progress_percent(
        total, F.col("o_custkey") % (total + 1)).alias("percent"))


@query("fn23_uppercase_transform", f"""
SELECT conv_id, turn, md5(translate(text, '{LOW}', '{UP}')) AS output,
  strlen(text) > 262144 AS refused FROM conversations""")
def _(t):
    return t["conversations"].select(
        "conv_id", "turn", F.md5(fn.ascii_upper(F.col("text"))).alias("output"),
        fn.longer_than(F.col("text"), 256 * 1024).alias("refused"))


@query("fn24_known_status", f"""
SELECT status, status IN ('succeeded', 'failed', 'running', 'pending', 'queued') AS known,
  count(*) AS jobs FROM ({sql(shapes.ORDER_JOBS)}) GROUP BY 1, 2""")
def _(t):
    known = fn.known(F.col("status"), st.WORKLOAD_STATUSES)
    return (t.shape(shapes.ORDER_JOBS).groupBy("status", known.alias("known"))
            .agg(F.count(F.lit(1)).alias("jobs")))
