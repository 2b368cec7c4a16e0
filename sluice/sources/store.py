"""Tables that change together: one numbered version over all of them.

A version is a small file that names the data folders of every table.  A batch writes its
data to new folders and then creates the file of the next version, once: readers see all of
the batch or nothing, and of two writers that started from the same version one is refused.
Folders of a batch that did not get there are named nowhere and removed by ``expire``.

* ``append`` tables are logs: a list of folders, shortened by ``fold``.
* ``upsert`` tables are split into buckets by the hash of their key; a batch rewrites the
  buckets its keys fall into, and the others keep their files.

A batch may carry the name and number of a stream's micro-batch; a number that was applied
before is not applied again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice import files
from sluice.lineage import cut
from sluice.operators.skew import lookup
from sluice.operators.upsert import KEPT, upsert

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made the version this batch was going to make."""


@dataclass
class State:
    """What one version holds."""

    version: int = 0
    applied: dict[str, int] = field(default_factory=dict)
    logs: dict[str, dict] = field(default_factory=dict)
    keyed: dict[str, dict] = field(default_factory=dict)

    def folders(self) -> set[str]:
        found = {p for log in self.logs.values() for p in log["paths"]}
        return found | {p.rsplit("/", 1)[0] for t in self.keyed.values()
                        for p in t["paths"].values()}


def bucket(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a key: the partition that ``repartition(buckets, *keys)`` puts it in."""
    return F.pmod(F.hash(*keys), F.lit(buckets))


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # ---------------------------------------------------------------- reading

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in files.names(self.spark, f"{self.root}/_versions")
                if n.endswith(".json")]

    def _file(self, version: int) -> str:
        return f"{self.root}/_versions/{version:020d}.json"

    def state(self, version: int | None = None) -> State:
        """The newest version, or the given one."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return State()
        return State(**json.loads(files.read_text(self.spark, self._file(version))))

    def log(self, table: str, state: State | None = None) -> DataFrame | None:
        """All rows of a log; None before the first."""
        known = (state or self.state()).logs.get(table)
        return known and self._read(known["schema"], known["paths"])

    def rows(self, table: str, state: State | None = None,
             only: Sequence[int] | None = None) -> DataFrame | None:
        """An upserted table, or the named buckets of it; None before the first row."""
        known = (state or self.state()).keyed.get(table)
        if known is None:
            return None
        paths = [p for b, p in sorted(known["paths"].items(), key=lambda x: int(x[0]))
                 if only is None or int(b) in set(only)]
        return self._read(known["schema"], paths)

    def find(self, table: str, wanted: DataFrame, spread: Sequence[str]) -> DataFrame | None:
        """``wanted`` beside the stored rows of its keys; only the keys' buckets are read."""
        state = self.state()
        known = state.keyed.get(table)
        if known is None:
            return None
        stored = self.rows(table, state, self._touched(wanted, known["keys"], known["buckets"]))
        return lookup(wanted, stored, known["keys"], spread)

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{p}" for p in paths])

    def _touched(self, rows: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
        found = rows.select(bucket(keys, buckets).alias("b")).distinct().collect()
        return sorted(r["b"] for r in found)

    # ---------------------------------------------------------------- writing

    def begin(self, app: str | None = None, number: int | None = None) -> Batch | None:
        """A batch on top of the newest version; None if ``number`` of ``app`` was applied."""
        state = self.state()
        if app is not None and state.applied.get(app, -1) >= number:
            return None
        return Batch(self, state, app, number)

    def apply(self, write: Callable[[Batch], None], app: str | None = None,
              number: int | None = None, tries: int = 5) -> int | None:
        """``write`` a batch and commit it, again on top of what another writer committed.

        None if ``number`` of ``app`` was applied before.
        """
        while True:
            batch = self.begin(app, number)
            if batch is None:
                return None
            write(batch)
            try:
                return batch.commit()
            except Conflict:
                tries -= 1
                if not tries:
                    raise

    def fold(self, table: str, summarise: Callable[[DataFrame], DataFrame]) -> int | None:
        """Replace a log's folders by one with ``summarise`` of its rows (same columns)."""
        def write(batch: Batch) -> None:
            rows = self.log(table, batch.base)
            batch.replace(table, summarise(rows).select(*rows.columns))
        return self.apply(write)

    def expire(self, keep: int = 10) -> None:
        """Forget all but the newest ``keep`` versions and the folders only they named."""
        found = sorted(self.versions())
        named = set()
        for version in found[-keep:]:
            named |= self.state(version).folders()
        for version in found[:-keep]:
            files.delete(self.spark, self._file(version))
        newest = max(found, default=0)
        for table in files.names(self.spark, self.root):
            if table == "_versions":
                continue
            for folder in files.names(self.spark, f"{self.root}/{table}"):
                # Batches that are being written have later numbers.
                if f"{table}/{folder}" not in named and int(folder.split("-")[0]) <= newest:
                    files.delete(self.spark, f"{self.root}/{table}/{folder}")


class Batch:
    """Changes of several tables; nothing is visible before ``commit``."""

    def __init__(self, store: Store, base: State, app: str | None, number: int | None) -> None:
        self.store, self.base = store, base
        self.version = base.version + 1
        self._applied = {} if app is None else {app: number}
        self._logs: dict[str, dict] = {}
        self._keyed: dict[str, dict] = {}

    def _folder(self, table: str) -> str:
        return f"{table}/{self.version:020d}-{uuid.uuid4().hex}"

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to a log."""
        known = self.base.logs.get(table, {"paths": []})["paths"]
        self._write_log(table, rows, known)

    def replace(self, table: str, rows: DataFrame) -> None:
        """Make these the only rows of a log."""
        self._write_log(table, rows, [])

    def _write_log(self, table: str, rows: DataFrame, known: list[str]) -> None:
        folder = self._folder(table)
        rows.write.parquet(f"{self.store.root}/{folder}")
        self._logs[table] = {"schema": rows.schema.json(), "paths": [*known, folder]}

    def upsert(self, table: str, rows: DataFrame, keys: Sequence[str],
               buckets: int = BUCKETS, kept: Sequence[str] = KEPT) -> None:
        """Insert or overwrite by key; ``rows`` has unique keys.

        Both sides are dealt out by the hash that names the bucket, so every task joins and
        writes one bucket.  ``kept`` columns stay as first written.
        """
        keys = list(keys)
        known = self.base.keyed.get(table)
        if known is not None:
            buckets = known["buckets"]
        rows = cut(rows, "upsert")
        touched = self.store._touched(rows, keys, buckets)
        before = {int(b): p for b, p in (known or {"paths": {}})["paths"].items()}
        old = [b for b in touched if b in before]
        merged = rows.repartition(buckets, *keys)
        if old:
            stored = self.store.rows(table, self.base, old)
            merged = upsert(stored.repartition(buckets, *keys), merged, keys, kept)
        folder = self._folder(table)
        if touched:
            (merged.withColumn("_bucket", bucket(keys, buckets))
             .write.partitionBy("_bucket").parquet(f"{self.store.root}/{folder}"))
        before.update({b: f"{folder}/_bucket={b}" for b in touched})
        self._keyed[table] = {"schema": rows.schema.json(), "keys": keys, "buckets": buckets,
                              "paths": {str(b): p for b, p in before.items()}}

    def commit(self) -> int:
        """Make the batch the next version; all of it becomes visible at once."""
        base = self.base
        state = State(self.version, {**base.applied, **self._applied},
                      {**base.logs, **self._logs}, {**base.keyed, **self._keyed})
        # Folder names are unique, so two writers' texts differ.
        text = json.dumps(state.__dict__)
        if not files.create_once(self.store.spark, self.store._file(self.version), text):
            raise Conflict(f"version {self.version} of {self.store.root} was made by another writer")
        return self.version
