"""Pages of a stored table and the JSON documents built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import functions as fn

# Page size limits of the three list families.
MAX_JOB_PAGE = 500
MAX_ITEM_PAGE = 200
MAX_DOMAIN_PAGE = 200
DEFAULT_LIMIT = 50
DEFAULT_OFFSET = 0


def clamp_job_limit(limit: int) -> int:
    """Jobs and workloads: zero or too large means the maximum."""
    return MAX_JOB_PAGE if limit == 0 or limit > MAX_JOB_PAGE else limit


def clamp_item_limit(limit: int) -> int:
    """Items of a workload: zero or too large means the maximum."""
    return MAX_ITEM_PAGE if limit == 0 or limit > MAX_ITEM_PAGE else limit


def clamp_domain_limit(limit: int) -> int:
    """Users, products, categories: capped, zero stays zero."""
    return min(limit, MAX_DOMAIN_PAGE)


def size_parameter(raw: str | None, default: int) -> int:
    """Non-negative integer of a request parameter, else the default."""
    return int(raw) if raw is not None and raw.isascii() and raw.isdigit() else default


def before(keys: Sequence[str], bound: Sequence) -> Column:
    """Whether a row comes before ``bound`` in the order of ``keys``, NULL first."""
    found = F.lit(False)
    for name, value in reversed(list(zip(keys, bound))):
        column = F.col(name)
        if value is None:
            found = column.isNull() & found
        else:
            less = column.isNull() | (column < F.lit(value))
            found = less | ((column == F.lit(value)) & found)
    return F.coalesce(found, F.lit(False))


def page_after(table: DataFrame, limit: int, after: Sequence | None = None,
               order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """The page behind the row with key ``after``; its cost does not grow with the position.

    ``order`` must end in a unique column.
    """
    if after is not None:
        same = F.lit(True)
        for name, value in zip(order, after):
            same = same & F.col(name).eqNullSafe(F.lit(value))
        # The first key column alone is a range that reaches the scan.
        if after[0] is not None:
            table = table.filter(F.col(order[0]) >= F.lit(after[0]))
        table = table.filter(~before(order, after) & ~same)
    return table.orderBy(*order).limit(limit)


# Up to this offset a page is a top-k of offset + limit rows.
SHALLOW = 10_000
# A deep offset is narrowed by this many bounds from a sample of SAMPLED keys, again and again.
BOUNDS = 64
SAMPLED = 4096


def page(table: DataFrame, limit: int, offset: int,
         order: Sequence[str] = ("created_at", "id"), shallow: int = SHALLOW) -> DataFrame:
    """One page; runs as a top-k, not as a full sort.

    Far down the table, rows before each of a few sampled keys are counted first, and only
    the range around the page is kept, until what is left of the offset is shallow.
    """
    order = list(order)
    low = high = None
    while offset > shallow:
        part = _between(table, order, low, high)
        size = part.count()
        taken = part.select(*order).sample(min(1.0, SAMPLED / max(size, 1)), seed=7)
        keys = sorted({tuple(r) for r in taken.limit(4 * SAMPLED).collect()},
                      key=lambda k: tuple((v is not None, v) for v in k))
        bounds = keys[::max(1, len(keys) // BOUNDS)]
        if not bounds:
            break
        counts = part.agg(*[F.count_if(before(order, b)).alias(str(i))
                            for i, b in enumerate(bounds)]).first()
        above = [i for i in range(len(bounds)) if counts[i] <= offset]
        below = [i for i in range(len(bounds)) if counts[i] >= offset + limit]
        start, end = above[-1] if above else None, below[0] if below else None
        if start is None and end is None or (
                (start is None or counts[start] == 0) and (end is None or counts[end] == size)):
            break
        low = bounds[start] if start is not None else low
        high = bounds[end] if end is not None else high
        offset -= counts[start] if start is not None else 0
    return _between(table, order, low, high).orderBy(*order).offset(offset).limit(limit)


def _between(table: DataFrame, order: Sequence[str], low: tuple | None,
             high: tuple | None) -> DataFrame:
    """Rows from key ``low`` to before key ``high``; the first column also reaches the scan."""
    first = order[0]
    if low is not None:
        table = table.filter(~before(order, low))
        if low[0] is not None:
            table = table.filter(F.col(first) >= F.lit(low[0]))
    if high is not None:
        table = table.filter(before(order, high))
        if high[0] is not None:
            table = table.filter(F.col(first).isNull() | (F.col(first) <= F.lit(high[0])))
    return table


def page_with_total(table: DataFrame, limit: int, offset: int,
                    order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """One page whose rows also carry the size of the whole table."""
    total = table.select(F.count(F.lit(1))).scalar()
    return page(table, limit, offset, order).withColumn("total", total)


def json_document(*fields: Column) -> Column:
    """JSON object text with explicit nulls."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def job_document() -> Column:
    """Read model of a job row; a payload that is JSON is embedded, not quoted."""
    payload = F.coalesce(F.try_parse_json("payload"), F.col("payload").cast("variant"))
    return json_document(
        F.col("id"), F.col("queue_name"), F.col("job_type"), payload.alias("payload"),
        F.col("priority"), F.col("status"), F.col("attempt_count"),
        F.col("retry_policy.max_attempts").alias("max_attempts"),
        fn.to_iso8601(F.col("created_at")).alias("created_at"),
        fn.to_iso8601(F.col("updated_at")).alias("updated_at"),
        F.col("last_error"), F.col("workload_id"))


def attempt_document() -> Column:
    """Read model of an attempt row."""
    return json_document(
        F.col("id"), F.col("job_id"), F.col("attempt_number"), F.col("outcome"),
        fn.to_iso8601(F.col("started_at")).alias("started_at"), F.col("worker_id"),
        fn.to_iso8601(F.col("finished_at")).alias("finished_at"), F.col("error_message"))


def workload_document() -> Column:
    """Read model of a workload with its derived progress."""
    return json_document(
        F.col("id"), F.col("type"), F.col("status"), F.col("total_items"),
        F.col("queued_items"), F.col("running_items"), F.col("completed_items"),
        F.col("failed_items"), F.col("retrying_items"), F.col("dead_letter_items"),
        fn.to_iso8601(F.col("created_at")).alias("created_at"),
        fn.to_iso8601(F.col("updated_at")).alias("updated_at"))


def item_document() -> Column:
    """Read model of one workload item: the job's state, name and email."""
    return json_document(
        F.col("id").alias("job_id"), F.col("status"), F.col("attempt_count"),
        fn.to_iso8601(F.col("updated_at")).alias("updated_at"),
        fn.payload_best_effort(F.col("payload"), "name").alias("name"),
        fn.payload_best_effort(F.col("payload"), "email").alias("email"),
        F.col("last_error"))


def record_document(columns: Sequence[str]) -> Column:
    """Read model of a stored user, product or category."""
    times = ("created_at", "updated_at")
    return json_document(*[fn.to_iso8601(F.col(c)).alias(c) if c in times else F.col(c)
                           for c in columns])


def envelope(table: DataFrame, document: Column, name: str, limit: int, offset: int,
             order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """One row: ``{<name>: [...], total, limit, offset}`` for one page.

    Only the page (at most ``MAX_JOB_PAGE`` rows) is gathered into the array.
    """
    if limit > MAX_JOB_PAGE:
        raise ValueError(f"a page holds at most {MAX_JOB_PAGE} rows")
    total = table.select(F.count(F.lit(1))).scalar()
    rows = page(table, limit, offset, order).select(
        F.struct(*order).alias("_order"), F.try_parse_json(document).alias("_item"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("_order", F.to_json("_item")
                                                             .alias("_text")))),
                        lambda e: F.try_parse_json(e["_text"]))
    gathered = rows.agg(items.alias("items"))
    return gathered.select(json_document(
        F.col("items").alias(name), total.alias("total"), F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset")).alias("document"))
