"""A vector index kept in a folder: a built base, batches of later changes beside it, and compaction of both.

    base-<n>/nodes, links, entries    the graph of all changes up to batch n; counts once base-<n>.done is there
    delta/<n>                         batch n: (id, vector), a null vector withdraws the key; counts once delta/<n>.done says ok
    delta/<n>.claim                   number n is taken

Marks and numbers are files that only one writer can create, so writers on several machines get numbers of their own, a
base that was left half-written is never read, and a reader always sees whole batches. Answers come from the base, where
changed keys lead on but don't count, and from an exact search over what changed since.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.operators.blocks import block_top_k
from kelpforge.operators.proximity import Graph, GraphConfig, build_graph, walk
from kelpforge.operators.retrieval import top_k
from kelpforge.operators.tables import latest
from kelpforge.sources.shared import create_once, exists, names_in, read_small, remove, settle

_DIGITS = 12


class StoredIndex:
    def __init__(self, spark: SparkSession, folder: str, config: GraphConfig | None = None):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or GraphConfig()

    def _at(self, *names: str) -> str:
        return "/".join((self.folder, *names))

    # Changes

    def put(self, rows: DataFrame) -> int:
        """Adds or replaces keys: rows (id, vector), null vectors withdraw theirs. Gives the batch's number; of a key's rows in one batch the vector counts that sorts first."""
        number = self._claim()
        batch = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))
        batch.write.mode("overwrite").parquet(self._at("delta", self._name(number)))
        if not create_once(self.spark, self._at("delta", f"{self._name(number)}.done"), "ok"):
            raise RuntimeError(f"batch {number} was given up before it was written")
        return number

    def withdraw(self, ids: DataFrame, like: str = "array<float>") -> int:
        return self.put(ids.select("id", F.lit(None).cast(like).alias("vector")))

    def give_up(self, number: int) -> bool:
        """Leaves out a batch whose writer is gone; False if it was finished after all."""
        return create_once(self.spark, self._at("delta", f"{self._name(number)}.done"), "given up")

    def _claim(self) -> int:
        number = max((n for n, _ in self._batches()), default=self.version()) + 1
        while not create_once(self.spark, self._at("delta", f"{self._name(number)}.claim")):
            number += 1
        return number

    @staticmethod
    def _name(number: int) -> str:
        return f"{number:0{_DIGITS}d}"

    def _batches(self) -> list[tuple[int, str]]:
        """Number and state ("open", "ok", "given up") of all batches."""
        names = names_in(self.spark, self._at("delta"))
        done = {n.split(".")[0] for n in names if n.endswith(".done")}
        claimed = sorted(n.split(".")[0] for n in names if n.endswith(".claim"))
        return [(int(n), read_small(self.spark, self._at("delta", f"{n}.done")) if n in done else "open") for n in claimed]

    def changes(self, after: int, up_to: int | None = None) -> DataFrame | None:
        """id, vector, seq of finished batches; None without any."""
        out = None
        for n, state in self._batches():
            if state == "ok" and after < n and (up_to is None or n <= up_to):
                rows = self.spark.read.parquet(self._at("delta", self._name(n))).withColumn("seq", F.lit(n).cast("long"))
                out = rows if out is None else out.unionByName(rows)
        return out

    # The base

    def version(self) -> int:
        """The last batch that the newest finished base holds; 0 without a base."""
        return max((int(n[5:-5]) for n in names_in(self.spark, self.folder) if n.startswith("base-") and n.endswith(".done")), default=0)

    def base(self) -> Graph | None:
        version = self.version()
        if not version:
            return None
        folder = read_small(self.spark, self._at(f"base-{self._name(version)}.done"))
        return Graph(*(self.spark.read.parquet(self._at(folder, t)) for t in ("nodes", "links", "entries")))

    def live(self, up_to: int | None = None) -> DataFrame | None:
        """id, vector of all keys that stand, after every finished batch."""
        base, changed = self.base(), self.changes(self.version(), up_to)
        held = None if base is None else base.nodes.select("id", "vector", F.lit(0).cast("long").alias("seq"))
        rows = held if changed is None else changed.select("id", F.col("vector").cast("array<float>").alias("vector"), "seq") if held is None else held.unionByName(changed.select("id", F.col("vector").cast("array<float>").alias("vector"), "seq"))
        return None if rows is None else latest(rows, ["id"], "seq").where("vector IS NOT NULL").select("id", "vector")

    def compact(self) -> int:
        """Builds a base of all batches up to the first open one and gives its version; with nothing new, the version that is.

        Several may compact at once: each builds in a folder of its own, and the first to set the mark counts. Readers go on
        with the base before until then.
        """
        version, last = self.version(), self.version()
        for n, state in self._batches():
            if n > version:
                if state == "open":
                    break
                last = n
        if last == version:
            return version
        rows = self.live(last)
        graph = build_graph(rows if rows is not None else self.spark.createDataFrame([], "id long, vector array<float>"), self.config)
        folder = f"base-{self._name(last)}-{uuid.uuid4().hex}"
        for name in ("nodes", "links", "entries"):
            getattr(graph, name).write.parquet(self._at(folder, name))
        if not create_once(self.spark, self._at(f"base-{self._name(last)}.done"), folder):
            remove(self.spark, self._at(folder))
        return last

    def clean(self) -> list[str]:
        """Removes bases and batches that the newest base replaces, and unfinished bases before it; no reader of those may be left."""
        version = self.version()
        current = read_small(self.spark, self._at(f"base-{self._name(version)}.done")) if version else ""
        keep = {current, f"base-{self._name(version)}.done"}
        old = [n for n in names_in(self.spark, self.folder) if n.startswith("base-") and n not in keep and int(n[5 : 5 + _DIGITS]) <= version]
        old += [f"delta/{n}" for n in names_in(self.spark, self._at("delta")) if int(n.split(".")[0]) <= version]
        for n in old:
            remove(self.spark, self._at(n))
        return old

    # Answers

    def search(self, queries: DataFrame, k: int, budget: int = 64) -> DataFrame:
        """query_id, item_id, similarity, rank: about the k nearest standing keys to each query (id, vector).

        The base is walked with a budget that leaves room for changed keys, twice the budget at most.
        """
        base, changed = self.base(), self.changes(self.version())
        parts, gone = [], None
        if changed is not None:
            own = settle(latest(changed, ["id"], "seq").select("id", "vector"))
            gone = own.select("id")
            fresh = block_top_k(queries.select("id", "vector"), own, k, unit=True)
            parts.append(fresh.select("query_id", "item_id", F.col("score").alias("similarity")))
        if base is not None:
            room = 0 if gone is None else min(gone.count(), budget)
            parts.append(walk(queries, base, k, (budget + room,), gone=gone).select("query_id", "item_id", "similarity"))
        if not parts:
            kind = dict(queries.dtypes)["id"]
            return self.spark.createDataFrame([], f"query_id {kind}, item_id {kind}, similarity double, rank int")
        return top_k(parts[0] if len(parts) == 1 else parts[0].union(parts[1]), k)

    def is_there(self) -> bool:
        return exists(self.spark, self.folder)
