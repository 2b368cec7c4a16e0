"""All named queries, grouped by module; names start with the operator's id."""

from __future__ import annotations

from sluice.catalog import (  # noqa: F401
    functions, intake, jobs, records, sources, stored, streams)
from sluice.catalog.base import ORACLES, QUERIES, runner


def queries():
    return {name: runner(name) for name in QUERIES}


def oracle_sql():
    return dict(ORACLES)
