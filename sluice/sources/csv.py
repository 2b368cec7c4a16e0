"""CSV: an exact reader for whole small files, a bulk reader for large ones.

The exact reader applies whole-file rules (size, encoding, quoting, row count)
and gives every data row its 1-based index among non-blank rows.  It works on
``(submission_id, content)`` rows, one file each, with Spark expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.lineage import cut
from sluice.operators.barrier import compute_once

# The service's own limits.  Nothing applies them unless a caller asks for limits.
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_DATA_ROWS = 1000

# One field: quoted (doubled quotes inside, text after the closing quote is
# appended) or plain.  Possessive, so long fields need no backtracking.
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^",\r\n]*+|[^",\r\n]*+)'
RECORD = rf'\G{FIELD}(?:,{FIELD})*+(?:\r\n|\r|\n|\z)'
# Content in group 1, text after the closing quote in group 2.
QUOTED = r'^"([^"]*+(?:""[^"]*+)*+)"([^"]*)\z'
# The field in group 1, its separator in group 2.
SPLIT = rf'\G({FIELD})(,|\z)'
# An unread rest that opens a quote and never closes it.
UNTERMINATED = rf'^(?:{FIELD},)*+"[^"]*+(?:""[^"]*+)*+\z'


def read_files(spark: SparkSession, path: str | list[str], max_bytes: int | None = None) -> DataFrame:
    """Whole files as ``(submission_id, content, length)``.

    With a limit, files over ``max_bytes`` are listed without reading them (the
    length test reaches the scan).  Spark's scan passes over files of zero
    bytes; those come from its listing.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.col("path").alias("submission_id")
    empty = empty_files(spark, path).select(
        "submission_id", F.lit(b"").alias("content"), F.lit(0).cast("bigint").alias("length"))
    if max_bytes is None:
        return files.select(name, "content", "length").unionByName(empty)
    read = files.filter(F.col("length") <= max_bytes).select(name, "content", "length")
    listed = files.filter(F.col("length") > max_bytes).select(
        name, F.lit(None).cast("binary").alias("content"), "length")
    return read.unionByName(listed).unionByName(empty)


def empty_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``submission_id`` of the files of zero bytes: listed by Spark, but not scanned.

    The names of all files are on the driver once, as in any file scan.
    """
    files = spark.read.format("binaryFile").load(path)
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "f string").select(
        _file_name(F.col("f")).alias("submission_id"))
    return listed.join(files.select(F.col("path").alias("submission_id")), "submission_id",
                       "left_anti")


def _file_name(encoded: Column) -> Column:
    """One name for a file in listings, metadata and ``binaryFile``: those before are encoded."""
    return F.regexp_replace(F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))),
                            "^file:///", "file:/")


def _unquote(field: Column) -> Column:
    quoted = F.regexp_extract(field, QUOTED, 1)
    tail = F.regexp_extract(field, QUOTED, 2)
    return F.when(field.startswith('"'),
                  F.concat(F.replace(quoted, F.lit('""'), F.lit('"')), tail)).otherwise(field)


def split_record(record: Column) -> Column:
    """Unquoted fields of one raw record (without its line end).

    Without quotes and line ends, what the pattern finds is what lies between commas.
    """
    plain = F.lit(True)
    for mark in '"\r\n':
        plain = plain & ~F.contains(record, F.lit(mark))
    return F.when(plain, F.split(record, ",")).when(record.isNotNull(), _matched_fields(record))


def _matched_fields(record: Column) -> Column:
    pieces = F.regexp_extract_all(record, F.lit(SPLIT), F.lit(0))
    # Only the last piece has no comma; an empty match after it is not a field.
    commas = F.filter(pieces, lambda p: F.endswith(p, F.lit(",")))
    inner = F.transform(commas, lambda p: F.substring(p, F.lit(1), F.length(p) - 1))
    last = F.element_at(pieces, F.size(commas) + 1)
    return F.transform(F.concat(inner, F.array(last)), _unquote)


def tokenize_csv(files: DataFrame, whole: bool = True) -> DataFrame:
    """Raw non-blank records per file and what stopped the reading, if anything.

    ``whole`` says that each row is a file and not a piece from inside one.  Adds ``records`` (raw text, in order) and ``stopped``: the unread rest of a
    malformed file, else NULL.
    """
    text = F.col("content").cast("string")
    # A byte order mark is not part of the text.
    plain = text if not whole else F.when(
        F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    # One line without quotes is one record, or none: most pieces need no pattern.
    end = F.instr("_text", "\r")
    single = ~F.contains("_text", F.lit('"')) & ~F.contains("_text", F.lit("\n")) & (
        (end == 0) | (end == F.length("_text")))
    read = files.withColumn("_text", plain).withColumn("_single", single).withColumn(
        "_raw", F.when(~F.col("_single"),
                       F.regexp_extract_all("_text", F.lit(RECORD), F.lit(0))))
    used = F.aggregate("_raw", F.lit(0), lambda total, r: total + F.length(r))
    stripped = F.transform("_raw", lambda r: F.regexp_replace(r, r"(?:\r\n|\r|\n)\z", ""))
    bare = F.replace("_text", F.lit("\r"), F.lit(""))
    return (read.withColumn("_used", F.when(~F.col("_single"), used))
            .withColumn("records", F.when(
                F.col("_single"), F.when(bare == "", F.array().cast("array<string>"))
                .otherwise(F.array(bare)))
                .otherwise(F.filter(stripped, lambda r: (r != "") & (r != '""'))))
            .withColumn("stopped", F.when(
                F.col("_used") < F.length("_text"),
                F.expr("substring(_text, _used + 1)")))
            .drop("_text", "_single", "_raw", "_used"))


def csv_file_admission(files: DataFrame, max_bytes: int | None = None,
                       max_rows: int | None = None, subject: str = "CSV input") -> DataFrame:
    """``records`` and ``header`` per file, and ``file_reason`` when it is refused.

    The first rule that fails names the reason: empty, too large, not UTF-8,
    too many rows or malformed (whichever comes first in the file), no header.
    Size and rows are only limited where the caller gives a limit.
    """
    over = F.lit(False) if max_bytes is None else F.col("_length") > max_bytes
    many = F.lit(False) if max_rows is None else F.size("records") > max_rows + 1
    size = F.col("length") if "length" in files.columns else F.octet_length("content")
    files = files.withColumn("_length", F.coalesce(size, F.lit(0)))
    early = (F.when(F.col("_length") == 0, F.lit(f"{subject} is empty"))
             .when(over, F.lit(f"{subject} must be <= {max_bytes} bytes"))
             .when(~F.is_valid_utf8(F.col("content").cast("string")),
                   F.lit(f"{subject} must be valid UTF-8")))
    early_checked = files.withColumn("_early", early)
    # A file refused early is not tokenised.
    readable = early_checked.withColumn(
        "content", F.when(F.col("_early").isNull(), F.col("content")))
    read = tokenize_csv(readable)
    late = (F.when(many,
                   F.lit(f"CSV contains more than {max_rows} data rows (including header)"))
            .when(F.col("stopped").rlike(UNTERMINATED),
                  F.lit("malformed CSV: unterminated quoted field"))
            .when(F.col("stopped").isNotNull(),
                  F.lit("malformed CSV: unexpected '\"' inside an unquoted field"))
            .when(F.size("records") == 0,
                  F.lit(f"{subject} must contain a header row")))
    keep = [c for c in files.columns if c not in ("content", "length", "_length")]
    judged = compute_once(read, keep, {"records": F.col("records"),
                                       "file_reason": F.coalesce("_early", late)})
    first = F.when(F.col("file_reason").isNull(), split_record(F.element_at("records", 1)))
    return compute_once(judged, [*keep, "records", "file_reason"], {"header": first})


def header_duplicates(files: DataFrame) -> DataFrame:
    """Refuse files whose header names a column twice (exact compare)."""
    second = F.filter("header", lambda c, i: F.array_position(F.col("header"), c) <= i)
    duplicate = F.when(F.size(second) > 0, F.concat(
        F.lit("CSV header has duplicate column '"), F.element_at(second, 1), F.lit("'")))
    keep = [c for c in files.columns if c != "file_reason"]
    return compute_once(files, keep, {"file_reason": F.coalesce("file_reason", duplicate)})


def header_users_strict(files: DataFrame) -> DataFrame:
    """Refuse files whose header is not exactly name, email and optional phone.

    The first offending column of the header decides the reason.
    """
    header = F.col("header")

    def offence(column: Column, index: Column) -> Column:
        known = column.isin("name", "email", "phone")
        return (F.when(~known, F.concat(
                    F.lit("CSV header has an unexpected column '"), column,
                    F.lit("' -- only name, email, phone are supported")))
                .when(F.array_position(header, column) <= index, F.concat(
                    F.lit("CSV header has duplicate column '"), column, F.lit("'"))))

    offences = F.filter(F.transform(header, offence), lambda r: r.isNotNull())

    def missing(column: str) -> Column:
        return F.when(~F.array_contains(header, column), F.lit(
            f"CSV header is missing the required '{column}' column"))

    reason = F.coalesce("file_reason", F.try_element_at(offences, F.lit(1)),
                        missing("name"), missing("email"))
    keep = [c for c in files.columns if c != "file_reason"]
    return compute_once(files, keep, {"file_reason": reason})


def data_rows(files: DataFrame) -> DataFrame:
    """Fields of every data row of the admitted files, with its row index."""
    admitted = files.filter(F.col("file_reason").isNull())
    body = F.slice("records", F.lit(2), F.greatest(F.size("records") - 1, F.lit(0)))
    rows = admitted.select("submission_id", "header", F.posexplode(body)
                           .alias("_position", "_record"))
    numbered = rows.select("submission_id", (F.col("_position") + 1).cast("bigint")
                           .alias("row_index"), "header", "_record")
    return compute_once(numbered, ["submission_id", "row_index", "header"],
                        {"fields": split_record(F.col("_record"))})


def row_arity_check(rows: DataFrame, noun: str = "fields") -> DataFrame:
    """Reason for rows whose field count differs from the header's."""
    wrong = F.size("fields") != F.size("header")
    return rows.withColumn("reason", F.when(wrong, F.concat(
        F.lit("expected "), F.size("header").cast("string"), F.lit(f" {noun}, found "),
        F.size("fields").cast("string"))))


def row_to_record(rows: DataFrame, distinct: bool = False) -> DataFrame:
    """Header and fields as a map; of equal labels the first one counts.

    ``distinct`` says that no header has equal labels.
    """
    firsts = F.filter(F.arrays_zip("header", "fields"),
                      lambda e, i: F.array_position(F.col("header"), e["header"]) == i + 1)
    fits = F.size("fields") == F.size("header")
    record = F.when(fits, F.map_from_arrays("header", "fields") if distinct
                    else F.map_from_entries(firsts))
    keep = [c for c in rows.columns if c not in ("header", "fields")]
    return compute_once(rows, keep, {"fields": record})


def extract_csv(files: DataFrame, strict_users: bool = False, max_bytes: int | None = None,
                max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of admitted files, and the refused files with their reason.

    Records: submission_id, row_index, fields (map, NULL on wrong arity), reason.
    """
    subject = "CSV file" if strict_users else "CSV input"
    admitted = csv_file_admission(files, max_bytes, max_rows, subject)
    checked = header_users_strict(admitted) if strict_users else header_duplicates(admitted)
    records = row_to_record(row_arity_check(data_rows(checked)))
    refused = (checked.filter(F.col("file_reason").isNotNull())
               .select("submission_id", F.col("file_reason").alias("reason")))
    return records, refused


# ------------------------------------------------------------ split files

def _before(column: str) -> Column:
    """Sum of a column over the splits of a file before this one."""
    window = Window.partitionBy("_file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _so_far(column: Column) -> Column:
    """Sum of a column over the rows of a split before this one."""
    window = Window.partitionBy("_file", "_block").orderBy("_id").rowsBetween(
        Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _counted(pieces: DataFrame, keep: list[str]) -> DataFrame:
    """``pieces`` with what their content holds: records, bad encoding, a malformed rest."""
    read = tokenize_csv(pieces, whole=False)
    stop = (F.when(F.col("stopped").rlike(UNTERMINATED),
                   F.lit("malformed CSV: unterminated quoted field"))
            .when(F.col("stopped").isNotNull(),
                  F.lit("malformed CSV: unexpected '\"' inside an unquoted field")))
    return compute_once(read, ["_file", "_block", "_id", "content", *keep], {
        "_n": F.size("records"), "_valid": F.is_valid_utf8("content"), "_stop": stop})


def _split_figures(pieces: DataFrame, *more: Column) -> DataFrame:
    """One row per split: counts, the first malformed rest, the first piece with a record."""
    place = F.struct("_block", "_id")

    def first(column: str, where: Column) -> Column:
        return F.min(F.when(where, F.struct(place.alias("place"), F.col(column).alias("value"))))

    return pieces.groupBy("_file", "_block").agg(
        F.min("_id").alias("_first"), F.sum("_n").alias("_count"),
        F.bool_and("_valid").alias("_valid"),
        first("_stop", F.col("_stop").isNotNull()).alias("_stop"),
        first("content", F.col("_n") > 0).alias("_head"), *more)


def _joined_lines(lines: DataFrame, knots: DataFrame) -> DataFrame:
    """Lines of the splits ``knots`` as pieces that begin and end between records: a line, or
    the lines from one that opens a quote to the one that closes it."""
    toggles = F.col("_inside") + F.col("_flips")
    # One row per split, as below.
    placed = (lines.join(knots.select("_file", "_block", "_flips"), ["_file", "_block"])
              .withColumn("_inside", _so_far(F.col("_odd"))).withColumn("_toggles", toggles))
    alone = (F.col("_toggles") % 2 == 0) & (F.col("_odd") == 0)
    several = (placed.filter(~alone)
               .groupBy("_file", F.floor(F.col("_toggles") / 2).alias("_quote"))
               .agg(F.sort_array(F.collect_list(F.struct("_block", "_id", "content")))
                    .alias("_lines")))
    text = F.array_join(F.transform("_lines", lambda x: x["content"]), "\n")
    first = F.element_at("_lines", 1)
    return (placed.filter(alone).select("_file", "_block", "_id", "content")
            .unionByName(several.select("_file", first["_block"].alias("_block"),
                                        first["_id"].alias("_id"), text.alias("content"))))


def read_pieces(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Files of any size in splits, as pieces that begin and end between records, and one row
    of figures per split (``_even``: each of its pieces is one record).

    A piece has its file, its place (``_block``, ``_id``), its ``content`` and counts.  Up to
    the first malformed record an odd number of quotes before a line says that it begins
    inside one.  The files are read once, and lines written with what they hold; only splits
    in which a quote is open across a line end are sorted to join their lines.
    """
    value = F.col("value")
    quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), value.alias("content"),
        (quotes % 2).alias("_odd"))
    lines = cut(_counted(read, ["_odd"]), "csv-lines")
    splits = _split_figures(lines, F.sum("_odd").alias("_odds"),
                            F.bool_and(F.col("_n") == 1).alias("_even"))
    splits = cut(splits.withColumn("_flips", _before("_odds")), "csv-splits")
    knotted = (F.col("_odds") > 0) | (F.col("_flips") % 2 == 1)
    figures = [c for c in splits.columns if c not in ("_odds", "_flips")]
    knots = splits.filter(knotted)
    if knots.isEmpty():
        return lines.drop("_odd"), splits.select(figures)
    joined = cut(_counted(_joined_lines(lines, knots), []), "csv-pieces")
    smooth = splits.filter(~knotted)
    pieces = (lines.join(smooth.select("_file", "_block"), ["_file", "_block"])
              .drop("_odd").unionByName(joined))
    return pieces, smooth.select(figures).unionByName(
        _split_figures(joined, F.lit(False).alias("_even")).select(figures))


def extract_csv_split(spark: SparkSession, path: str | list[str],
                      strict_users: bool = False) -> tuple[DataFrame, DataFrame]:
    """As ``extract_csv`` without limits, but large files are split across tasks."""
    subject = "CSV file" if strict_users else "CSV input"
    pieces, blocks = read_pieces(spark, path)
    judged = blocks.groupBy("_file").agg(
        F.bool_and("_valid").alias("_valid"), F.min("_stop")["value"].alias("_stop"),
        F.min("_head")["value"].alias("content"))
    reason = (F.when(~F.col("_valid"), F.lit(f"{subject} must be valid UTF-8"))
              .when(F.col("_stop").isNotNull(), F.col("_stop"))
              .when(F.col("content").isNull(), F.lit(f"{subject} must contain a header row")))
    judged = tokenize_csv(judged.withColumn("file_reason", reason), whole=False)
    headed = compute_once(judged, ["_file"], {
        "submission_id": _file_name(F.col("_file")), "file_reason": F.col("file_reason"),
        "header": F.when(F.col("file_reason").isNull(),
                         split_record(F.try_element_at("records", F.lit(1))))})
    checked = header_users_strict(headed) if strict_users else header_duplicates(headed)
    admitted = checked.filter(F.col("file_reason").isNull()).select(
        "_file", "submission_id", "header")
    # One row per split: far smaller than the data.  It is written, so that Spark knows its
    # size before it plans the join.
    offsets = cut(blocks.select("_file", "_block", "_first", "_even", _before("_count")
                                .alias("_shift")).join(admitted, "_file"), "csv-offsets")
    placed = pieces.select("_file", "_block", "_id", "_n", "content").join(
        offsets, ["_file", "_block"])
    keep = ["submission_id", "header", "_shift", "_done", "content"]
    # Where every line is one record, its place in the split is its number.
    even = placed.filter("_even").withColumn("_done", F.col("_id") - F.col("_first"))
    uneven = placed.filter("NOT _even").withColumn("_done", _so_far(F.col("_n")))
    read = tokenize_csv(even.select(keep).unionByName(uneven.select(keep)), whole=False)
    rows = read.select("submission_id", "header", (F.col("_done") + F.col("_shift"))
                       .alias("_from"), F.posexplode("records").alias("_position", "_record"))
    numbered = rows.select("submission_id", (F.col("_from") + F.col("_position")).cast("bigint")
                           .alias("row_index"), "header", "_record").filter("row_index > 0")
    fields = compute_once(numbered, ["submission_id", "row_index", "header"],
                          {"fields": split_record(F.col("_record"))})
    refused = (checked.filter(F.col("file_reason").isNotNull())
               .select("submission_id", F.col("file_reason").alias("reason")))
    empty = empty_files(spark, path).select("submission_id",
                                            F.lit(f"{subject} is empty").alias("reason"))
    # Files with equal labels are refused.
    return row_to_record(row_arity_check(fields), distinct=True), refused.unionByName(empty)


# ------------------------------------------------------------- bulk path

def read_csv_bulk(spark: SparkSession, path: str, columns: list[str],
                  multi_line: bool = False) -> DataFrame:
    """Large CSV files of one layout: split across tasks, no size or row limits.

    Gives submission_id (the file), row_index, the columns as text (absent
    text is '') and ``reason`` for rows of the wrong length or without one of the columns
    in their file's header; columns are found by that header.  Row indexes come
    from the byte offset of each split plus the position inside it, so rows
    keep the order of the file without any sort.  ``multi_line`` allows line
    breaks inside quotes at the price of one task per file.
    """
    places = [f"_c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{c} string" for c in places) + ", _bad string"
    raw = (spark.read.schema(schema).option("header", False).option("multiLine", multi_line)
           .option("escape", '"').option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_bad").csv(path))
    placed = raw.select("*", F.col("_metadata.file_path").alias("submission_id"),
                        F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_id"))
    top = F.when(F.col("_bad").isNull(), F.array(*places)).otherwise(split_record(F.col("_bad")))
    blocks = placed.groupBy("submission_id", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"),
        F.min_by(top, "_id").alias("_top"))
    before = Window.partitionBy("submission_id").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    header = F.first("_top").over(before.rowsBetween(Window.unboundedPreceding, 0))
    offsets = blocks.select("submission_id", "_block", header.alias("_header"), (
        F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    # One row per split: far smaller than the data, and AQE checks its size
    # before it is broadcast.
    numbered = placed.join(offsets, ["submission_id", "_block"]).withColumn(
        "row_index", F.col("_id") + F.col("_shift")).filter("row_index > 0")
    found = F.size(split_record(F.col("_bad")))
    wrong = F.coalesce(found, F.size("_header")) != F.size("_header")
    missing = F.filter(F.array(*[F.lit(c) for c in columns]),
                       lambda c: ~F.array_contains(F.col("_header"), c))
    reason = (F.when(F.size(missing) > 0, F.concat(
                  F.lit("CSV header is missing the required '"), F.element_at(missing, 1),
                  F.lit("' column")))
              .when(wrong, F.concat(
                  F.lit("expected "), F.size("_header").cast("string"), F.lit(" fields, found "),
                  found.cast("string"))))
    fields = F.when(F.col("_bad").isNull(), F.array(*places)).otherwise(
        split_record(F.col("_bad")))

    def value(c: str) -> Column:
        at = F.array_position("_header", F.lit(c)).cast("int")
        return F.coalesce(F.when(at > 0, F.try_element_at(fields, at)), F.lit(""))

    return numbered.select("submission_id", "row_index", *[value(c).alias(c) for c in columns],
                           reason.alias("reason"))
