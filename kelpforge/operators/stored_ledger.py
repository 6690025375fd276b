"""A ledger kept in a folder, to which several writers append without forking a chain.

    log/<group>/<version>        names the batch that took this version of a group of tenants
    batches/<batch>/group=<g>    entries; they count once the log names them
    heads/<batch>/group=<g>      where each tenant's chain stood after the batch

A writer chains its entries behind the heads that it sees, writes them, and then claims the next version of each group
that they touch, by a file that only one writer can create. Who finds a version taken has chained behind heads that are
no longer the last: it reads them anew and chains what was refused again, five times at most. What a loser or a writer
that failed has written is named by no log and never read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.operators import ledger
from kelpforge.sources.shared import create_once, names_in, read_small, settle

GROUPS, RETRIES = 16, 5
_HEAD = "tenant_id string, sequence long, entry_hash string"


class Contention(RuntimeError):
    """Other writers were first, each time."""


class StoredLedger:
    def __init__(self, spark: SparkSession, folder: str, key: bytes | None = None, groups: int = GROUPS):
        self.spark, self.folder, self.key, self.groups = spark, folder.rstrip("/"), key, groups
        self._batches: dict[tuple[int, int], str] = {}  # what a log file says never changes

    def _log(self, group: int, version: int | None = None) -> str:
        return f"{self.folder}/log/{group}" + ("" if version is None else f"/{version:012d}")

    def _group(self):
        return F.pmod(F.xxhash64("tenant_id"), F.lit(self.groups)).cast("int")

    def versions(self, groups: list[int] | None = None) -> dict[int, list[str]]:
        """The batches that took the versions of each group, in order."""
        told = {}
        for g in range(self.groups) if groups is None else groups:
            taken = [int(n) for n in names_in(self.spark, self._log(g)) if n.isdigit()]
            for v in taken:
                if (g, v) not in self._batches:
                    self._batches[g, v] = read_small(self.spark, self._log(g, v))
            told[g] = [self._batches[g, v] for v in sorted(taken)]
        return told

    def _read(self, table: str, schema: str, versions: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.folder}/{table}/{batch}/group={g}" for g, batches in versions.items() for batch in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._read("batches", ledger.ENTRY, self.versions())

    def heads(self, versions: dict[int, list[str]] | None = None) -> DataFrame:
        """Each tenant's last sequence and hash: one row a tenant and batch is read, not the entries."""
        return ledger.heads(self._read("heads", _HEAD, self.versions() if versions is None else versions))

    def verify(self, require_signed: bool = False) -> DataFrame:
        return ledger.verify(self.read(), self.key, require_signed)

    def append(self, entries: DataFrame, order: str = "write_seq") -> int:
        """Appends entries (as ledger.append takes them) and gives how often it had to chain some again.

        All entries of a group of tenants are appended or none; groups for themselves, so that a writer which fails half-way
        may have appended some groups, and one that appends the same entries again repeats those.
        """
        rows = settle(entries.withColumn("group", self._group()))
        pending = sorted(r["group"] for r in rows.select("group").distinct().collect())
        for attempt in range(RETRIES + 1):
            if not pending:
                return max(0, attempt - 1)
            seen = self.versions(pending)
            some = reduce(lambda a, b: a | b, (F.col("group") == g for g in pending))
            chained = ledger.append(rows.where(some).drop("group"), self.heads(seen), self.key, order).withColumn("group", self._group())
            batch = uuid.uuid4().hex
            chained.write.partitionBy("group").parquet(f"{self.folder}/batches/{batch}")
            written = self._read("batches", ledger.ENTRY, {g: [batch] for g in pending})
            ledger.heads(written).withColumn("group", self._group()).write.partitionBy("group").parquet(f"{self.folder}/heads/{batch}")
            pending = [g for g in pending if not create_once(self.spark, self._log(g, len(seen[g])), batch)]
        if pending:
            raise Contention(f"groups {pending} were taken by other writers {RETRIES + 1} times")
        return RETRIES
