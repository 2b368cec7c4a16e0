"""Images, OCR words and JSON bodies."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sluice.plans import extractors
from sluice.plans.submission import preview
from sluice.plans.targets import USERS
from sluice.sources import images, json_records, ocr

WORD = ("submission_id string, word_pos int, text string, left int, top int, width int, "
        "height int, confidence double, block_num int, par_num int, line_num int")


def test_image_admission(spark):
    png, webp = bytes.fromhex("89504E470D0A1A0A"), b"RIFF\0\0\0\0WEBP"
    cases = {"png": (png + b"x", "png", None), "jpeg": (b"\xff\xd8\xff", "jpeg", None),
             "webp": (webp, "webp", None), "empty": (b"", None, "image upload is empty"),
             "short": (b"RIFF\0\0\0\0WEB", None, "unsupported"), "text": (b"hi", None, "unsup"),
             "max": (png + b"\0" * (images.MAX_IMAGE_BYTES - 8), "png", None),
             "big": (png + b"\0" * (images.MAX_IMAGE_BYTES - 7), None, "image upload must be <=")}
    files = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()],
                                  "submission_id string, content binary")
    for row in images.image_admission(files).collect():
        content, kind, reason = cases[row.submission_id]
        assert (row.format, row.bytes) == (kind, len(content))
        assert row.reason is None if reason is None else row.reason.startswith(reason)


def boxes(image, lines, height=20, confidence=90.0):
    """Words of table lines; cells start 200 px apart, words inside touch."""
    words = []
    for n, cells in enumerate(lines):
        for c, cell in enumerate(cells):
            left = 20 + 400 * c
            for word in cell.split(" "):
                words.append((image, len(words), word, left, 40 * n, 8 * len(word), height,
                              confidence, 1, 1, n + 1))
                left += 8 * len(word) + 10
    return words


def extract(spark, words, listed=None):
    frame = spark.createDataFrame(words, WORD).repartition(3)
    images_seen = None if listed is None else spark.createDataFrame(
        [(i,) for i in listed], "submission_id string")
    records, refused, notes = ocr.extract_ocr(frame, images_seen, ocr.MAX_TABLE_ROWS)
    rows = {(r.submission_id, r.row_index): r for r in records.collect()}
    return rows, {r.submission_id: r.reason for r in refused.collect()}, {
        r.submission_id: r for r in notes.collect()}


def test_tables_of_words(spark):
    words = (boxes("ok", [["Full Name", "Email"], ["Ann Lee", "ann@x.co"], ["Bob", "b@x.co", "?"],
                          ["Cy", "cy@x.co"]])
             + boxes("single", [["Name"], ["Ann"]]) + boxes("line", [["Name", "Email"]])
             + boxes("long", [["A", "B"]] * 202) + boxes("full", [["A", "B"]] * 201)
             + boxes("twice", [["A", "A"], ["1", "2"]], confidence=69.9)
             + boxes("unscored", [["A", "B"], ["1", "2"]], confidence=-1.0))
    rng = random.Random(2)
    rng.shuffle(words)
    rows, refused, notes = extract(spark, words, ["ok", "single", "line", "long", "full", "twice",
                                                  "unscored", "blank"])
    assert rows["ok", 1].fields == {"Full Name": "Ann Lee", "Email": "ann@x.co"}
    assert rows["ok", 2].reason == "expected 2 columns, found 3" and rows["ok", 2].fields is None
    assert rows["ok", 3].fields["Full Name"] == "Cy"
    assert rows["twice", 1].fields == {"A": "1"}
    assert len([k for k in rows if k[0] == "full"]) == 200
    assert {k: v.split(" --")[0] for k, v in refused.items()} == {
        "single": "no table structure was detected in the image",
        "line": "no table structure was detected in the image",
        "long": "image contains too many table rows (max 200)",
        "blank": "no text was detected in the image"}
    assert notes["twice"].warning.startswith("OCR confidence for this image is low (69%)")
    assert notes["ok"].warning is None and notes["unscored"].average_confidence is None


def test_gap_rule_is_strict(spark):
    def pair(image, gap):
        return [(image, 0, "a", 0, 0, 10, 20, 90.0, 1, 1, 1),
                (image, 1, "b", 10 + gap, 0, 10, 20, 90.0, 1, 1, 1),
                (image, 2, "c", 0, 0, 10, 20, 90.0, 1, 1, 2),
                (image, 3, "d", 500, 0, 10, 20, 90.0, 1, 1, 2)]
    rows, _, _ = extract(spark, pair("at", 40) + pair("over", 41))
    assert rows["at", 1].reason == "expected 1 columns, found 2"
    assert rows["over", 1].fields == {"a": "c", "b": "d"}


def test_word_files(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    row = lambda *v: "\t".join(str(x) for x in v)
    lines = [head, row(4, 1, 1, 1, 1, 0, 0, 0, 9, 9, -1, ""),
             row(5, 1, 1, 1, 1, 1, 0, 0, 30, 20, 96.5, "Name"),
             row(5, 1, 1, 1, 1, 2, 300, 0, 30, 20, 90, "Email"),
             row(5, 1, 1, 1, 2, 1, 0, 40, 30, 20, 90, "A\tB"),
             row(5, 1, 1, 1, 2, 2, 300, 40, 30, 20, 90, "a@b.c"),
             row(5, 1, 1, 1, 2, 3, "x", 40, 30, 20, 90, "bad"),
             row(5, 1, 1, 1, 2, 3, 1, 40, 30, 20, "", "bad"), "5\t1\tshort",
             row(5, 1, 1, 1, 2, 3, 1, 40, 30, 20, 90, "")]
    (tmp_path / "scan.tsv").write_text("\r\n".join(lines))
    found = extractors.extract(spark, "image", str(tmp_path))
    assert [r.fields for r in found.records.collect()] == [{"Name": "A\tB", "Email": "a@b.c"}]
    plan = preview(found.records, USERS)
    assert [(r.name, r.email) for r in plan.records.collect()] == [("A\tB", "a@b.c")]


def test_extractor_registry(spark):
    with pytest.raises(ValueError):
        extractors.register_extractor("csv", None)
    with pytest.raises(ValueError):
        extractors.register_extractor("fax", None)
    with pytest.raises(KeyError, match="not yet supported"):
        extractors.extract(spark, "url", "x")


def bodies(spark, *texts):
    rows = [(f"b{i}", t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "submission_id string, body string")


def test_record_bodies(spark):
    good = {"target": "users", "records": [{"name": "A", "email": "a@b.c"}, {}]}
    records, refused = json_records.json_records(bodies(
        spark, good, "[1]", "{", {"records": []}, {"target": 5}, {"target": "cars"},
        {"target": "users"}, {"target": "users", "records": []},
        {"target": "users", "records": [1]}, {"target": "users", "records": [{"a": "x", "b": 1}]},
        {"target": "users", "records": [{"a": None}]}, {"target": "users", "records": "x"},
        {"target": "users", "records": [{"a": "1"}] * 1001},
        {"target": "users", "records": [{"a": "1"}] * 1000}), json_records.MAX_RECORDS)
    many, none = json_records.json_records(bodies(
        spark, {"target": "users", "records": [{"a": "1"}] * 5000}))
    assert many.count() == 5000 and none.count() == 0
    rows = records.collect()
    assert {(r.row_index, tuple(sorted(r.fields.items()))) for r in rows
            if r.submission_id == "b0"} == {(1, (("email", "a@b.c"), ("name", "A"))), (2, ())}
    assert len([r for r in rows if r.submission_id == "b13"]) == 1000
    assert {r.submission_id: r.reason for r in refused.collect()} == {
        "b1": "request body must be a JSON object", "b2": "request body must be a JSON object",
        "b3": "'target' must be a string", "b4": "'target' must be a string",
        "b5": "unrecognized 'target' value 'cars'",
        **{b: "'records' must be a non-empty array" for b in ("b6", "b7", "b11")},
        "b8": "each element of 'records' must be an object",
        "b9": "each record field must be a string (field 'b' is not)",
        "b10": "each record field must be a string (field 'a' is not)",
        "b12": "at most 1000 records may be confirmed at once"}


def test_item_bodies(spark):
    items, refused = json_records.json_items(bodies(
        spark, {"type": "t", "items": ["x", {"b": 1, "a": [True, None]}, 3, "1"]}, {"type": "t"},
        {"items": []}, {"type": "", "items": []}, {"type": "t" * 129}, {"type": "t", "items": 5},
        {"type": "t", "items": [""]}, {"type": "t", "items": ["x" * 65537]},
        {"type": "t", "items": ["x"] * 1001}, "nope"),
        json_records.MAX_ITEMS, json_records.MAX_ITEM_BYTES, json_records.MAX_TYPE_BYTES)
    many, none = json_records.json_items(bodies(
        spark, {"type": "t" * 129, "items": ["x" * 65537] + ["y"] * 5000}))
    assert many.count() == 5001 and none.count() == 0
    assert [r.payload for r in items.orderBy("row_index").collect()] == [
        "x", '{"a":[true,null],"b":1}', "3", "1"]
    assert {r.submission_id: r.reason for r in refused.collect()} == {
        "b2": "'type' must be a string", "b3": "type must not be empty",
        "b4": "type must be <= 128 characters", "b5": "'items' must be an array",
        "b6": "every item payload must not be empty",
        "b7": "every item payload must be <= 65536 bytes",
        "b8": "items must contain <= 1000 entries", "b9": "request body must be a JSON object"}


def test_bodies_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(
        {"target": "users", "records": [{"name": "A", "email": "a@b.c"}]}, indent=2))
    records, _ = json_records.json_records(json_records.read_bodies(spark, str(tmp_path)))
    assert records.select(F.col("fields")["name"].alias("n")).first().n == "A"


def test_words_are_moved_once_and_hot_images_keep_their_lines(spark):
    from sluice.sources import ocr
    rows = [(None if i == 7 else f"i{0 if i % 3 else i % 40}", 1, 1, i % 97, 30 * (i // 97), i, 20,
             10 + i % 3, f"w{i}") for i in range(4000)]
    words = spark.createDataFrame(rows, "submission_id string, block_num int, par_num int, line_num"
                                        " int, left int, word_pos int, width int, height int, text string")
    figures = ocr.image_figures(words.withColumn("confidence", F.lit(1.0)))
    heights, lines = {}, {}
    for image, _, _, line, left, pos, width, height, _ in rows:
        heights.setdefault(image, []).append(height)
        lines.setdefault((image, line), []).append((left, pos, width))
    wanted = set()
    for (image, line), found in lines.items():
        found.sort()
        gap = float("inf") if image is None else 2 * sum(heights[image]) / len(heights[image])
        wanted.add((image, line, len(found), 1 + sum(
            b[0] - a[0] - a[2] > gap for a, b in zip(found, found[1:]))))
    for texts in (True, False):
        starts = ocr.column_starts(words, figures, texts=texts)
        assert {tuple(r) for r in starts.select("submission_id", "line_num", F.size("words"),
                                                F.size("starts")).collect()} == wanted
        plan = starts._jdf.queryExecution().sparkPlan().toString()
        physical = starts._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" in plan
        assert "Exchange hashpartitioning" not in physical.split("collect_list")[0]


def test_cells_are_written_before_ranges_are_drawn_from_them(spark):
    from pathlib import Path

    from sluice.lineage import shared_dir
    from sluice.sources import ocr
    words = spark.createDataFrame([("a", 1, 1, i % 3, 50 * i, i, 20, 10, f"w{i}", 90.0) for i in range(9)],
                                  "submission_id string, block_num int, par_num int, line_num int, left int,"
                                  " word_pos int, width int, height int, text string, confidence double")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("sluice-cells-*"))
    lines = ocr.table_lines(words, ocr.image_figures(words))
    assert [tuple(r) for r in lines.select("line_num", "line_at").orderBy("line_at").collect()] == [
        (0, 0), (1, 1), (2, 2)]
    assert len(set(folder.glob("sluice-cells-*")) - before) == 1


def test_word_lines_lose_one_carriage_return_without_a_pattern(spark):
    line = "5\t1\t1\t1\t1\t1\t10\t0\t4\t12\t90.5\t"
    files = spark.createDataFrame(
        [("a", f"head\r\n{line}one\r\n{line}two\r\r\n{line}th\rree\n{line}\r\n{line}\tfour")],
        "submission_id string, tsv string")
    words = ocr.ocr_word_scan(files)
    assert [(r.word_pos, r.text) for r in words.orderBy("word_pos").collect()] == [
        (1, "one"), (2, "two\r"), (3, "th\rree"), (5, "\tfour")]
    plan = words._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace(_raw" not in plan
