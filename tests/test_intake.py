"""Deep pages, empty files, strict imports of split files, refused images."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import paging
from sluice.plans.extractors import extract
from sluice.plans.submission import direct_import, direct_import_path
from sluice.sources import csv


@pytest.mark.parametrize("ties", [3, 400, 5000])
def test_deep_pages_and_keyset_pages(spark, ties):
    rng = random.Random(ties)
    rows = [(rng.choice([None, *range(5000 // ties + 1)]), i) for i in range(5000)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "created_at int, id int").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for offset in (0, 137, 2500, 4990, 6000):
        page = paging.page(table, 20, offset, shallow=100)
        assert [tuple(r) for r in page.collect()] == order[offset:offset + 20]
        if 0 < offset < 5000:
            after = paging.page_after(table, 20, order[offset - 1])
            assert [tuple(r) for r in after.collect()] == order[offset:offset + 20]
    assert [tuple(r) for r in paging.page_after(table, 3).collect()] == order[:3]


def test_a_deep_page_sorts_a_small_range(spark):
    table = spark.range(50_000).select("id", (F.col("id") * 7 % 50_000).alias("created_at"))
    page = paging.page(table, 10, 40_000, shallow=500)
    assert [r.created_at for r in page.collect()] == list(range(40_000, 40_010))
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    skipped = int(plan.split("Offset ")[1].split()[0])
    assert skipped <= 500


def test_empty_files_are_refused_by_both_readers(spark, tmp_path):
    (tmp_path / "a b+c%.csv").write_text("")
    (tmp_path / "d.csv").write_text("name\nx\n")
    found = extract(spark, "csv", str(tmp_path))
    limited = extract(spark, "csv", str(tmp_path), max_rows=5)
    for part in (found, limited):
        assert [(r.submission_id.rsplit("/", 1)[1], r.reason) for r in part.refused.collect()] == [
            ("a b+c%.csv", "CSV input is empty")]
        assert part.records.count() == 1
    (tmp_path / "d.csv").unlink()
    assert extract(spark, "csv", str(tmp_path)).refused.count() == 1


def test_strict_import_of_split_files_equals_whole_files(spark, tmp_path):
    files = {"good.csv": "email,name\na@x.co,A\nb@x.co\na@x.co,again\n\"q@x.co\",\"Q \"\"q\"\"\nline\"\n",
             "extra.csv": "email,name,age\na@x.co,A,3\n", "twice.csv": "email,name,email\n",
             "short.csv": "name\nA\n", "none.csv": "", "open.csv": "email,name\n\"a"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    now = F.lit("2024-01-01").cast("timestamp")
    whole, refused = direct_import(csv.read_files(spark, str(tmp_path)), now)
    split, refused_too = direct_import_path(spark, str(tmp_path), now)
    show = lambda f, *c: sorted(map(tuple, f.select(*c).collect()))
    assert show(split.jobs, "id", "payload") == show(whole.jobs, "id", "payload")
    assert show(split.rejects, "row_index", "reason") == show(whole.rejects, "row_index", "reason")
    assert show(refused_too, "submission_id", "reason") == show(refused, "submission_id", "reason")
    assert len(show(refused, "reason")) == 5 and whole.jobs.count() == 2


def test_a_refused_image_refuses_its_words(spark, tmp_path):
    head = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext\n"
    body = "".join(f"5\t1\t1\t1\t{n}\t1\t{x}\t{n}\t40\t20\t90\tw{n}\n" for n in (1, 2) for x in (0, 300))
    for folder in ("words", "images"):
        (tmp_path / folder).mkdir()
    for name, image in (("ok", b"\x89PNG\r\n\x1a\n...."), ("bad", b"GIF89a"), ("nil", b"")):
        (tmp_path / "words" / f"{name}.tsv").write_text(head + body)
        (tmp_path / "images" / f"{name}.png").write_bytes(image)
    (tmp_path / "words" / "alone.tsv").write_text(head + body)
    found = extract(spark, "image", str(tmp_path / "words"), images=str(tmp_path / "images"))
    stem = lambda r: r.submission_id.rsplit("/", 1)[1]
    assert {stem(r) for r in found.records.collect()} == {"ok.tsv", "alone.tsv"}
    assert {stem(r): r.reason for r in found.refused.collect()} == {
        "bad.tsv": "unsupported or corrupt image -- only PNG, JPEG, and WebP are supported",
        "nil.tsv": "image upload is empty"}
