"""Column-to-column functions; all run inside Spark's own expressions."""

from sluice.functions.numbers import (  # noqa: F401
    format_price, has_excess_decimals, is_price_number, parse_price, parse_stock,
    strict_double, strict_long)
from sluice.functions.payload import (  # noqa: F401
    payload_best_effort, payload_field, payload_json, retry_policy_json, retry_policy_parse)
from sluice.functions.status import (  # noqa: F401
    classify_job_status, compute_backoff, derive_workload_status, exhausted, is_terminal,
    known, progress_percent)
from sluice.functions.text import (  # noqa: F401
    ascii_lower, ascii_upper, bounded_text, currency_code, is_currency, is_email, is_sku,
    is_uuid, longer_than, none_if_blank, random_uuid, slugify, stable_uuid, to_iso8601,
    trim_header, trim_ws)
