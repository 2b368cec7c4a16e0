"""Tables in images: OCR words are put back into rows and columns.

Recognition itself is not done here; the input is the word table an OCR tool
writes (tab-separated, one file per image) or a DataFrame of word boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import functions as fn
from sluice.lineage import cut
from sluice.operators.barrier import compute_once
from sluice.operators.ranges import dense_index
from sluice.operators.skew import HOT_KEYS, lookup
from sluice.sources.csv import row_arity_check, row_to_record

# The service's own limit.  Nothing applies it unless a caller asks for it.
MAX_TABLE_ROWS = 200
# The lines of an image with very many words are dealt to so many places.
LINE_SALTS = 64
LOW_CONFIDENCE = 70.0
LINE = ("block_num", "par_num", "line_num")


def read_word_files(spark: SparkSession, path: str) -> DataFrame:
    """``(submission_id, tsv)``, one OCR output file per row."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("submission_id"), F.col("value").alias("tsv"))


def ocr_word_scan(files: DataFrame) -> DataFrame:
    """Word boxes of each file, numbered in file order.

    Keeps level-5 rows with text; a row with any unreadable number is dropped.
    Tabs after the eleventh belong to the text.
    """
    lines = files.select("submission_id", F.posexplode(F.split("tsv", "\n"))
                         .alias("_line", "_raw")).filter(F.col("_line") > 0)
    # A pattern would be run for every word.
    raw = F.when(F.endswith("_raw", F.lit("\r")),
                 F.substring("_raw", F.lit(1), F.length("_raw") - 1)).otherwise(F.col("_raw"))
    cells = compute_once(
        lines.withColumnRenamed("_line", "word_pos"), ["submission_id", "word_pos"],
        {"c": F.split(raw, "\t", 12)})

    def integer(i: int) -> Column:
        value = F.try_element_at("c", F.lit(i))
        return F.when(value.rlike(fn.numbers.INTEGER_TEXT), value.try_cast("int"))

    words = cells.filter(F.size("c") == 12).select(
        "submission_id", "word_pos", integer(1).alias("level"),
        F.try_element_at("c", F.lit(12)).alias("text"),
        integer(3).alias("block_num"), integer(4).alias("par_num"),
        integer(5).alias("line_num"), integer(7).alias("left"), integer(8).alias("top"),
        integer(9).alias("width"), integer(10).alias("height"),
        fn.strict_double(F.try_element_at("c", F.lit(11))).alias("confidence"))
    kept = words.filter((F.col("level") == 5) & (F.col("text") != ""))
    return kept.drop("level").dropna()


def image_figures(words: DataFrame) -> DataFrame:
    """Per image: gap threshold, mean confidence and its warning."""
    scored = F.when(F.col("confidence") >= 0, F.col("confidence"))
    figures = words.groupBy("submission_id").agg(
        (F.avg(F.col("height").cast("double")) * 2).alias("gap_threshold"),
        F.avg(scored).alias("average_confidence"),
        F.count(F.lit(1)).alias("_n"))
    low = F.col("average_confidence") < LOW_CONFIDENCE
    return figures.withColumn("warning", F.when(low, F.concat(
        F.lit("OCR confidence for this image is low ("),
        F.col("average_confidence").cast("int").cast("string"),
        F.lit("%) -- extracted data may contain errors; please review before confirming"))))


def _placed(words: DataFrame, figures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words and thresholds, both dealt by (image, ``_salt``), which a line never leaves.

    The lines of the images with the most words, at most ``HOT_KEYS`` of them, are spread over
    ``LINE_SALTS`` salts, so that no task gets more than a small part of any image.
    """
    hot = F.broadcast(figures.filter(F.col("submission_id").isNotNull())
                      .orderBy(F.desc("_n"), "submission_id").limit(HOT_KEYS)
                      .select("submission_id", F.lit(True).alias("_hot")))
    line = F.pmod(F.xxhash64(*LINE), F.lit(LINE_SALTS)).cast("int") + 1
    spread = F.col("_hot").isNotNull() | F.col("submission_id").isNull()
    dealt = (words.join(hot, "submission_id", "left")
             .withColumn("_salt", F.when(spread, line).otherwise(F.lit(0))).drop("_hot"))
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(1), F.lit(LINE_SALTS))).otherwise(
        F.array(F.lit(0)))
    thresholds = figures.join(hot, "submission_id", "left").select(
        "submission_id", F.explode(salts).alias("_salt"), "gap_threshold")
    return dealt.repartition("submission_id", "_salt"), thresholds


def column_starts(words: DataFrame, figures: DataFrame, texts: bool = True) -> DataFrame:
    """Printed lines with their words in order and where each column starts.

    The words are shuffled once, by image, and what is made from them stays where it is: the
    images' thresholds come to them.  A line is bounded by the width of the page, so its
    words fit one row; a page with very many words uses many tasks.  Without ``texts`` the
    words are places alone.
    """
    line = ["submission_id", *LINE]
    word = ["left", "word_pos", "width", *(["text"] if texts else [])]
    dealt, thresholds = _placed(words.select(*line, *word), figures)
    lines = dealt.groupBy("submission_id", "_salt", *LINE).agg(
        F.sort_array(F.collect_list(F.struct(*word))).alias("words"),
        F.min("word_pos").alias("first_pos"))
    sized = lines.join(thresholds.hint("shuffle_hash"), ["submission_id", "_salt"], "left")

    def opens_column(i: Column) -> Column:
        word, before = F.col("words")[i - 1], F.col("words")[i - 2]
        return (i == 1) | (word["left"] - (before["left"] + before["width"])
                           > F.col("gap_threshold"))

    return compute_once(sized, [*line, "words", "first_pos"], {
        "starts": F.filter(F.sequence(F.lit(1), F.size("words")), opens_column)})


def line_widths(words: DataFrame, figures: DataFrame) -> DataFrame:
    """One row per printed line with its number of cells: enough for the checks."""
    return column_starts(words, figures, texts=False).select(
        "submission_id", F.size("starts").alias("width"))


def table_lines(words: DataFrame, figures: DataFrame) -> DataFrame:
    """One row per printed line: its first word's position, its cells and its place."""
    lines = column_starts(words, figures)
    texts = F.col("words.text")

    def cell(start: Column, i: Column) -> Column:
        after = F.coalesce(F.get("starts", i + 1), F.size("words") + 1)
        return fn.trim_header(F.array_join(F.slice(texts, start, after - start), " "))

    cells = compute_once(lines, ["submission_id", *LINE, "first_pos"],
                         {"fields": F.transform("starts", cell)})
    # Ranges are drawn from a sample of the lines; these are not made from the words again for that.
    cells = cut(cells, "cells")
    # Written once, in order: checks and rows are made from that.
    return dense_index(cells, ["submission_id", "first_pos"], index="line_at")


def ocr_table_checks(lines: DataFrame, images: DataFrame | None = None,
                     max_rows: int | None = None) -> DataFrame:
    """Reason per image (NULL when it holds a table): words, structure, size if limited.

    ``images`` lists every submission, so that those without words are seen.  ``lines`` have
    their ``fields`` or, from ``line_widths``, only their number.
    """
    width = F.col("width") if "width" in lines.columns else F.size("fields")
    many = F.lit(False) if max_rows is None else F.col("lines") - 1 > max_rows
    shape = lines.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("lines"), F.max(width).alias("widest"))
    if images is not None:
        shape = images.select("submission_id").join(shape, "submission_id", "left")
    reason = (F.when(F.col("lines").isNull(), "no text was detected in the image")
              .when((F.col("lines") < 2) | (F.col("widest") < 2),
                    "no table structure was detected in the image -- expected a header row "
                    "and at least one data row split across two or more columns")
              .when(many, f"image contains too many table rows (max {max_rows})"))
    return shape.select("submission_id", "lines", reason.alias("file_reason"))


def ocr_table_rebuild(lines: DataFrame, checks: DataFrame) -> DataFrame:
    """Data rows of the admitted images with header, row index and arity reason.

    A line's row is its place behind the first line of its image; the header comes from the
    same pass over the lines.  An image may have any number of lines.
    """
    passed = checks.filter(F.col("file_reason").isNull()).select("submission_id")
    firsts = lines.groupBy("submission_id").agg(
        F.min("line_at").alias("_first"), F.min_by("fields", "line_at").alias("header"),
        F.count(F.lit(1)).alias("_n")).join(passed, "submission_id")
    placed = (lookup(lines, firsts, ["submission_id"], spread=["line_at"])
              .filter(F.col("_first").isNotNull())
              .withColumn("row_index", F.col("line_at") - F.col("_first")))
    rows = placed.filter(F.col("row_index") > 0).select(
        "submission_id", F.col("row_index").cast("bigint").alias("row_index"), "header",
        "fields")
    return row_arity_check(rows, noun="columns")


def extract_ocr(words: DataFrame, images: DataFrame | None = None,
                max_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, refused images, and per-image confidence and warning."""
    figures = image_figures(words)
    lines = table_lines(words, figures)
    checks = ocr_table_checks(lines, images, max_rows)
    records = row_to_record(ocr_table_rebuild(lines, checks))
    refused = checks.filter(F.col("file_reason").isNotNull()).select(
        "submission_id", F.col("file_reason").alias("reason"))
    return records, refused, figures.select("submission_id", "average_confidence", "warning")
