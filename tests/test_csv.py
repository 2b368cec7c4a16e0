"""Exact CSV reading, against a field-by-field reading of the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.plans.extractors import extract
from sluice.plans.targets import USERS
from sluice.sources import csv as source


def take_field(text, at):
    """One field from ``at``: (value, where it stops, error)."""
    value = ""
    if text.startswith('"', at):
        ahead = re.compile(r'[^"]').search
        end = at + 1
        while True:
            end = text.find('"', end)
            if end < 0:
                return value, len(text), "unterminated"
            after = ahead(text, end)
            run = (after.start() if after else len(text)) - end
            if run % 2:
                break
            end += run
        end += run - 1
        value, at = text[at + 1:end].replace('""', '"'), end + 1
    plain = re.compile(r'[^,"\r\n]*').match(text, at)
    stop = plain.end()
    return value + plain.group(), stop, "unexpected" if text.startswith('"', stop) else None


def slow_read(text):
    """Brute force, field by field: (non-blank rows, error)."""
    rows, row, at = [], [], 0
    while at < len(text) or row:
        value, at, error = take_field(text, at)
        if error:
            return rows, error
        row.append(value)
        if text.startswith(",", at):
            at += 1
            continue
        at += 2 if text.startswith("\r\n", at) else 1
        rows += [row] if row != [""] else []
        row = []
    return rows, None


def frame(spark, texts):
    rows = [(f"f{i:05d}", t if isinstance(t, (bytes, bytearray)) else t.encode())
            for i, t in enumerate(texts)]
    return spark.createDataFrame([(a, bytearray(b)) for a, b in rows],
                                 "submission_id string, content binary")


def test_random_texts_match_slow_reading(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice('ab",\n\r"é,') for _ in range(rng.randint(1, 24)))
             for _ in range(3000)]
    got = (source.tokenize_csv(frame(spark, texts))
           .select("submission_id", F.transform("records", source.split_record).alias("rows"),
                   F.col("stopped").isNotNull().alias("bad"),
                   F.col("stopped").rlike(source.UNTERMINATED).alias("open"))
           .orderBy("submission_id").collect())
    for text, row in zip(texts, got):
        rows, error = slow_read(text)
        assert [list(r) for r in row.rows] == rows, repr(text)
        kind = None if not row.bad else "unterminated" if row.open else "unexpected"
        assert kind == error, repr(text)


def test_long_quoted_fields_and_wide_rows(spark):
    long_field = 'x""' * 200_000
    wide = ",".join(str(i) for i in range(5000))
    got = source.tokenize_csv(frame(spark, [f'h\n"{long_field}"\n', wide + "\n"])).select(
        F.transform("records", source.split_record).alias("rows")).collect()
    assert got[0].rows[1][0] == 'x"' * 200_000
    assert len(got[1].rows[0]) == 5000


def reason_of(spark, content, strict=True, limited=True):
    limits = (source.MAX_FILE_BYTES, source.MAX_DATA_ROWS) if limited else ()
    _, refused = source.extract_csv(frame(spark, [content]), strict, *limits)
    rows = refused.collect()
    return rows[0].reason if rows else None


@pytest.mark.parametrize("content, reason", [
    ("", "CSV file is empty"),
    (b"name,email\n\xff\xfe,a@b.co\n", "CSV file must be valid UTF-8"),
    ("\n\n", "CSV file must contain a header row"),
    ('name,email\n"A,a@b.co\n', "malformed CSV: unterminated quoted field"),
    ('name,email\nA"x,a@b.co\n', "malformed CSV: unexpected '\"' inside an unquoted field"),
    ("name\nA\n", "CSV header is missing the required 'email' column"),
    ("email\nA\n", "CSV header is missing the required 'name' column"),
    ("name,email,name\n", "CSV header has duplicate column 'name'"),
    ("name,Email\n",
     "CSV header has an unexpected column 'Email' -- only name, email, phone are supported"),
    ("email,phone,name\n", None),
    ("\ufeffname,email\nA,a@b.co\n", None),
])
def test_whole_file_rules(spark, content, reason):
    assert reason_of(spark, content) == reason


def test_limits_are_inclusive(spark):
    body = lambda n: "name,email\n" + "".join(f"U{i},u{i}@x.co\n" for i in range(n))
    many = "CSV contains more than 1000 data rows (including header)"
    assert reason_of(spark, body(1000)) is None
    assert reason_of(spark, body(1001)) == many
    # The row limit is met before the quote error that follows it, not after.
    assert reason_of(spark, body(1001) + 'x"y,z') == many
    assert reason_of(spark, body(500) + 'x"y,z\n' + body(900)).startswith("malformed")
    assert reason_of(spark, body(1001), limited=False) is None
    assert reason_of(spark, body(1001) + 'x"y,z', limited=False).startswith("malformed")
    size = source.MAX_FILE_BYTES
    assert reason_of(spark, "name,email\n" + "x" * (size - 11)) is None
    assert reason_of(spark, "name,email\n" + "x" * (size - 10)) == (
        f"CSV file must be <= {size} bytes")


def test_generic_header_duplicates(spark):
    assert reason_of(spark, "a,b,a\n1,2,3\n", strict=False) == (
        "CSV header has duplicate column 'a'")
    assert reason_of(spark, "a,A\n1,2\n", strict=False) is None


def test_rows_keep_their_index_and_arity_reason(spark):
    records, _ = source.extract_csv(
        frame(spark, ['a,b\n1,2\n\n3\n"4","5 ""x"""\n6,7,8']))
    rows = {r.row_index: r for r in records.collect()}
    assert rows[1].fields == {"a": "1", "b": "2"}
    assert rows[2].reason == "expected 2 fields, found 1" and rows[2].fields is None
    assert rows[3].fields == {"a": "4", "b": '5 "x"'}
    assert rows[4].reason == "expected 2 fields, found 3"


def test_header_only_file_has_no_rows(spark):
    records, refused = source.extract_csv(frame(spark, ["name,email\n"]), strict_users=True)
    assert records.count() == 0 and refused.count() == 0


def test_read_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,email\nAnn,ann@x.co\n")
    (tmp_path / "b.csv").write_text("\n")
    records, refused = source.extract_csv(source.read_files(spark, str(tmp_path)), True)
    assert [r.fields for r in records.collect()] == [{"name": "Ann", "email": "ann@x.co"}]
    assert [r.reason for r in refused.collect()] == ["CSV file must contain a header row"]


def test_bulk_rows_are_numbered_in_file_order(spark, tmp_path):
    lines = [f"u{i},u{i}@x.co,{'' if i % 7 else '5'}" for i in range(1, 20_001)]
    lines[99] = "u100,u100@x.co"
    lines.insert(500, "")
    (tmp_path / "big.csv").write_text("name,email,phone\n" + "\n".join(lines) + "\n")
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = source.read_csv_bulk(spark, str(tmp_path), USERS.columns)
        assert rows.rdd.getNumPartitions() > 5
        got = {r.row_index: r for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    assert sorted(got) == list(range(1, 20_001))
    assert all(got[i].name == f"u{i}" for i in got)
    assert got[1].phone == "" and got[7].phone == "5"
    assert got[100].reason == "expected 3 fields, found 2"
    assert sum(r.reason is not None for r in got.values()) == 1


def test_large_files_are_listed_but_not_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,email\nAnn,ann@x.co\n")
    (tmp_path / "b.csv").write_text("name,email\n" + "x" * source.MAX_FILE_BYTES)
    assert source.read_files(spark, str(tmp_path)).filter("content IS NULL").count() == 0
    files = source.read_files(spark, str(tmp_path), source.MAX_FILE_BYTES)
    assert "LessThanOrEqual(length,2097152)" in files._jdf.queryExecution().toString()
    records, refused = source.extract_csv(files, True, source.MAX_FILE_BYTES)
    assert records.count() == 1
    assert [r.reason for r in refused.collect()] == ["CSV file must be <= 2097152 bytes"]


def test_split_files_read_as_whole_files(spark, tmp_path):
    rng = random.Random(11)
    texts = ["a,b\n" + "".join(rng.choice('ab",\n\r"é,') for _ in range(rng.randint(1, 24)))
             for _ in range(150)]
    texts += ["name,email\r\nA,a@b.co\r\n", "\ufeffa,b\n\ufeff1,2\n", "\n\n", "a,b,a\n1,2,3\n",
              b"a,b\n\xff,1\n", 'a,b\n"x\n\n""y""\r\nz",2\n3,4\n', 'a\n"open\n1\n2', 'a\nx"y\n1\n"',
              '"a\nb",c\n' + "".join(f'"r{i}\n{"x" * 40}",{i}\n' for i in range(300))]
    for i, text in enumerate(texts):
        (tmp_path / f"f {i:03d}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        split = extract(spark, "csv", str(tmp_path))
        whole = source.extract_csv(source.read_files(spark, str(tmp_path)))
        for got, want in zip((split.records, split.refused), whole):
            assert got.columns == want.columns
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        plan = split.records._jdf.queryExecution().toString()
        assert "binaryFile" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)


def test_bulk_columns_follow_each_file_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,email\nAnn,ann@x.co\n")
    (tmp_path / "b.csv").write_text("email,name\nbob@x.co,Bob\ncy@x.co\n")
    (tmp_path / "c.csv").write_text("name,mail\nDan,d@x.co\n")
    rows = source.read_csv_bulk(spark, str(tmp_path), ["name", "email"]).collect()
    got = {(r.submission_id[-5:], r.row_index): (r.name, r.email, r.reason) for r in rows}
    assert got == {("a.csv", 1): ("Ann", "ann@x.co", None), ("b.csv", 1): ("Bob", "bob@x.co", None),
                   ("b.csv", 2): ("", "cy@x.co", "expected 2 fields, found 1"),
                   ("c.csv", 1): ("Dan", "", "CSV header is missing the required 'email' column")}


def test_files_of_a_language_are_written_by_many_tasks(spark, tmp_path):
    from pathlib import Path

    from sluice.catalog import queries
    from sluice.lineage import shared_dir
    rows = [(i, f"t{i}", ("en", "fr", None)[i % 3], "web") for i in range(60)]
    schema = "doc_id long, text string, lang string, source string"
    for start in (0, 30):
        (spark.createDataFrame(rows[start:start + 30], schema).coalesce(1)
         .write.mode("append").parquet(str(tmp_path / "documents.parquet")))
    spark.range(2).withColumnRenamed("id", "n_nationkey").write.parquet(
        str(tmp_path / "nation.parquet"))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("sluice-drop-*"))
    found = queries()["src2_csv_empty_files"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("CSV input is empty", 2), (None, 2)}
    (drop,) = set(folder.glob("sluice-drop-*")) - before
    assert len(list(drop.glob("lang=en/part-*"))) > 1


def test_lines_of_split_files_are_read_once_and_sorted_only_in_uneven_splits(spark, tmp_path):
    lines = [f'r{i},"{i}, ""x"""' if i % 5 == 0 else f"r{i},{i}" for i in range(600)]
    lines[300] = ""
    (tmp_path / "a.csv").write_bytes(("a,b\r\n" + "\r\n".join(lines)).encode())
    (tmp_path / "b.csv").write_text("a,b\n" + "\n".join(lines[:150] + ['"x\ny",1'] + lines))
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        _, figures = source.read_pieces(spark, str(tmp_path))
        even = [r["_even"] for r in figures.collect()]
        assert len(even) > 10 and 0 < even.count(False) < 6
        split = extract(spark, "csv", str(tmp_path))
        whole = source.extract_csv(source.read_files(spark, str(tmp_path)))
        assert sorted(map(repr, split.records.collect())) == sorted(map(repr, whole[0].collect()))
        assert "FileScan text" not in split.records._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)


def test_bulk_query_counts_rows_without_file_names(spark):
    """Names of files filled the tasks that count rows."""
    import re

    from sluice import catalog
    found = catalog.queries()["src1_csv_bulk"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan)
    assert any("xxhash64" in k for k in keys)
    assert not any("l_orderkey" in k and "submission_id#" in k and "xxhash64" not in k
                   for k in keys)
    assert found.filter("rejected > 0").count() == 0
