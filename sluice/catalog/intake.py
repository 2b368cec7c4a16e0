"""Queries that take in real files, show previews of them, and page through tables."""

from pyspark.sql import functions as F

from sluice import files
from sluice.catalog import shapes
from sluice.catalog.base import query, sql
from sluice.catalog.records import USERS_CTE
from sluice.lineage import fresh_path
from sluice.operators import paging, progress
from sluice.operators.validate import reject_union
from sluice.plans.documents import preview_documents
from sluice.plans.extractors import extract
from sluice.plans.submission import direct_import_path, preview
from sluice.plans.targets import PRODUCTS
from sluice.sources import csv
from sluice.sources.store import Store

# ------------------------------------------------------------------- previews


def product_files(t):
    """One CSV text per document: a good row, a short one, a bad price, a repeated code."""
    code = F.concat(F.lit("d-"), F.col("doc_id").cast("string"))
    content = F.concat(
        F.lit(" Code ,Product Name,UNIT_PRICE\r\n"), code, F.lit(","), F.col("lang"),
        F.lit(",1.50\r\nshort\r\n"), code, F.lit('x,"'), F.replace("source", F.lit('"'), F.lit('""')),
        F.lit('",-1\r\n\r\n'), F.upper(code), F.lit(",again,2\r\n"), code, F.lit("y,,3"))
    return t["documents"].select(F.col("doc_id").cast("string").alias("submission_id"),
                                 F.encode(content, "UTF-8").alias("content"))


PREVIEWED = """
WITH lines(row_index, stage, says) AS (VALUES (1, NULL, NULL),
  (2, 'structural', 'expected 3 fields, found 1'),
  (3, 'mapping', '''price'' must be between 0 and 10000000.000000'),
  (4, 'mapping', 'duplicate sku ''D-{}'' in this submission -- only the first occurrence is kept'),
  (5, 'mapping', '''name'' must not be blank')),
found AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS submission_id, lang,
  CAST(row_index AS BIGINT) AS row_index, stage, replace(says, '{}', CAST(doc_id AS VARCHAR)) AS reason
  FROM documents, lines)"""


@query("val7_preview_csv", f"{PREVIEWED} SELECT submission_id, row_index, stage, reason FROM found")
def _(t):
    records, _refused = csv.extract_csv(product_files(t))
    plan = preview(records, PRODUCTS)
    good = plan.records.select("submission_id", "row_index", F.lit(None).cast("string").alias("stage"),
                               F.lit(None).cast("string").alias("reason"))
    return good.unionByName(plan.rejects)


@query("set1_reject_union_csv", f"""{PREVIEWED}
SELECT stage, submission_id, row_index, reason FROM found WHERE stage IS NOT NULL""")
def _(t):
    records, _refused = csv.extract_csv(product_files(t))
    mapped = preview(records.filter(F.col("reason").isNull()), PRODUCTS).rejects
    return reject_union(records.filter(F.col("reason").isNotNull()), mapped)


@query("snk6_preview_documents", f"""{PREVIEWED}
SELECT submission_id, 'csv products 5 1 4 true' AS figures, '["D-' || doc_id || '"]' AS skus,
  string_agg(row_index || ':' || reason, ' | ' ORDER BY row_index) FILTER (WHERE row_index
    IN (2, 3, 4)) AS rejected, 1 AS records, true AS no_confidence, '[]' AS warnings
FROM found GROUP BY ALL""")
def _(t):
    records, _refused = csv.extract_csv(product_files(t))
    # Three of four rejects are listed.
    found = preview_documents(preview(records, PRODUCTS), "csv", PRODUCTS, rejects=3)
    read = lambda p: F.get_json_object("document", p)
    listed = F.from_json(read("$.rejected_records"), "array<struct<index bigint, reason string>>")
    shown = F.from_json(read("$.records"), "array<map<string, string>>")
    return found.select(
        "submission_id", F.concat_ws(" ", *[read(f"$.{k}") for k in (
            "source", "target", "total_records", "valid_records", "invalid_records",
            "rejected_records_truncated")]).alias("figures"),
        F.to_json(F.transform(shown, lambda r: r["sku"])).alias("skus"),
        F.array_join(F.transform(listed, lambda r: F.concat(
            r["index"].cast("string"), F.lit(":"), r["reason"])), " | ").alias("rejected"),
        F.size(shown).alias("records"), read("$.average_confidence").isNull().alias("no_confidence"),
        read("$.warnings").alias("warnings"))


@query("snk6_item_documents", f"""
SELECT id AS job_id, status, attempt_count, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.000Z')
  AS updated_at, 'job ' || id AS name, CAST(NULL AS VARCHAR) AS email FROM (
  {sql(shapes.ORDER_JOBS)}) ORDER BY created_at, id LIMIT 50 OFFSET 100""")
def _(t):
    payload = F.to_json(F.struct(F.concat(F.lit("job "), "id").alias("name")))
    jobs = t.shape(shapes.ORDER_JOBS).withColumns({
        "payload": payload, "last_error": F.lit(None).cast("string")})
    page = paging.envelope(jobs, paging.item_document(), "items", 50, 100)
    item = "struct<job_id bigint, status string, attempt_count int, updated_at string, name string, email string>"
    return page.select(F.explode(F.from_json(
        F.get_json_object("document", "$.items"), f"array<{item}>")).alias("i")).select("i.*")


@query("snk6_workload_documents", """
WITH jobs AS (SELECT l_orderkey AS id, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R')
  AS failed FROM lineitem GROUP BY 1)
SELECT id, 'lines' AS type, CASE WHEN failed > 0 THEN 'failed' ELSE 'succeeded' END AS status,
  total AS total_items, total - failed AS completed_items, failed AS failed_items,
  0 AS queued_items, '2024-01-01T00:00:00.000Z' AS created_at FROM jobs""")
def _(t):
    now = F.lit("2024-01-01").cast("timestamp")
    jobs = t["lineitem"].select(F.col("l_orderkey").alias("workload_id"), F.when(
        F.col("l_returnflag") == "R", "failed").otherwise("succeeded").alias("status"))
    workloads = jobs.groupBy(F.col("workload_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_items")).withColumns({
            "type": F.lit("lines"), "created_at": now, "updated_at": now})
    found = progress.workload_progress(workloads, jobs).select(
        paging.workload_document().alias("document"))
    kind = ("struct<id bigint, type string, status string, total_items bigint, completed_items bigint, "
            "failed_items bigint, queued_items int, created_at string>")
    return found.select(F.from_json("document", kind).alias("d")).select("d.*")


# ---------------------------------------------------------------------- files

@query("src2_csv_empty_files", """
SELECT reason, files FROM (SELECT 'CSV input is empty' AS reason, count(*) AS files FROM nation
UNION ALL SELECT NULL, count(DISTINCT lang) FROM documents)""")
def _(t):
    path = fresh_path(t.spark, "drop")
    text, source = (F.coalesce(c, F.lit("")) for c in ("text", "source"))
    record = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('",'), source)
    # Every task writes its own files, blank lines among them; those of a language count as one.
    (t["documents"].select("lang", F.explode(F.array(record, F.lit(""))).alias("value"))
     .write.partitionBy("lang").text(path))
    for row in t["nation"].select("n_nationkey").collect():
        files.create_once(t.spark, f"{path}/none-{row['n_nationkey']}.csv", "")
    found = extract(t.spark, "csv", path)
    folder = F.regexp_extract("submission_id", "/lang=([^/]*)/[^/]*$", 1)
    named = F.when(folder != "__HIVE_DEFAULT_PARTITION__", folder)
    read = found.records.agg(F.countDistinct(named).alias("files")).select(
        F.lit(None).cast("string").alias("reason"), "files")
    return found.refused.groupBy("reason").agg(F.count(F.lit(1)).alias("files")).unionByName(read)


@query("val9_direct_import_files", f"""{USERS_CTE},
seen AS (SELECT submission_id, reason IS NOT NULL AS bad, count(*) AS rows,
  count(DISTINCT email) AS keys FROM judged GROUP BY ALL)
SELECT submission_id, CAST(sum(rows) AS BIGINT) AS total_records,
  CAST(coalesce(sum(keys) FILTER (WHERE NOT bad), 0) AS BIGINT) AS valid_records FROM seen
GROUP BY 1""")
def _(t):
    path = fresh_path(t.spark, "users")
    rows = t.shape(shapes.USERS)
    rows.repartition("submission_id").select("submission_id", "phone", "email", "name").write.option(
        "header", True).option("quoteAll", True).option("escape", '"').partitionBy(
        "submission_id").csv(path)
    done, _refused = direct_import_path(t.spark, path, F.lit("2024-02-01").cast("timestamp"))
    file = F.regexp_extract("submission_id", "submission_id=([^/]*)", 1)
    return done.summary.groupBy(file.alias("submission_id")).agg(
        F.sum("total_records").alias("total_records"), F.sum("valid_records").alias("valid_records"))


@query("src7_image_source", """
SELECT refused, count(*) AS files FROM (SELECT CASE WHEN n_nationkey % 3 = 0
  THEN 'unsupported or corrupt image -- only PNG, JPEG, and WebP are supported'
  WHEN n_nationkey % 3 = 1 THEN 'image upload is empty' END AS refused FROM nation) GROUP BY 1""")
def _(t):
    path = fresh_path(t.spark, "images")
    header = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext\n"
    for row in t["nation"].collect():
        n = row["n_nationkey"]
        cells = [(1, 0, "Name"), (1, 300, "Region"), (2, 0, row["n_name"]), (2, 300, "r")]
        words = "".join(f"5\t1\t1\t1\t{line}\t1\t{left}\t{line}\t40\t20\t90\t{text}\n"
                        for line, left, text in cells)
        files.create_once(t.spark, f"{path}/words/n{n}.tsv", header + words)
        # The leading bytes of a JPEG are no UTF-8 text; PNG's first byte is not either.
        image = ("GIF89a", "", "RIFF0000WEBPVP8 ")[n % 3]
        files.create_once(t.spark, f"{path}/images/n{n}.webp", image)
    found = extract(t.spark, "image", f"{path}/words", images=f"{path}/images")
    read = found.records.select("submission_id", F.lit(None).cast("string").alias("refused"))
    return read.unionByName(found.refused.withColumnRenamed("reason", "refused")).groupBy(
        "refused").agg(F.count(F.lit(1)).alias("files"))


# ---------------------------------------------------------------------- pages

DEEP = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("srt1_deep_page", f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY {", ".join(DEEP)}
LIMIT 50 OFFSET (SELECT count(*) * 5 // 6 FROM lineitem)""")
def _(t):
    lines = t["lineitem"].select(*DEEP)
    return paging.page(lines, 50, lines.count() * 5 // 6, DEEP, shallow=1000).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("srt1_page_after", """
WITH mark AS (SELECT o_orderdate, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1)
SELECT o.o_orderkey AS id, o_orderstatus FROM orders o, mark m
WHERE (o.o_orderdate, o.o_orderkey) > (m.o_orderdate, m.o_orderkey)
ORDER BY o.o_orderdate, o.o_orderkey LIMIT 50""")
def _(t):
    orders = t["orders"].select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice",
                                F.col("o_orderdate").alias("created_at"))
    mark = orders.orderBy("o_totalprice", "id").first()
    return paging.page_after(orders, 50, (mark["created_at"], mark["id"])).select(
        "id", "o_orderstatus")


# --------------------------------------------------------------------- lookup

@query("jn1_store_lookup", """
SELECT n_nationkey, c_name, c_name IS NOT NULL AS found FROM nation
LEFT JOIN customer ON c_custkey = n_nationkey * 70""")
def _(t):
    store = Store(t.spark, fresh_path(t.spark, "store"))
    batch = store.begin()
    batch.upsert("users", t["customer"].select(F.col("c_custkey").alias("key"), "c_name"), ["key"])
    batch.commit()
    wanted = t["nation"].select("n_nationkey", (F.col("n_nationkey") * 70).cast("bigint").alias("key"))
    return store.find("users", wanted, ["n_nationkey"]).select(
        "n_nationkey", "c_name", F.col("c_name").isNotNull().alias("found"))
