"""Best-fit packing of documents into fixed-length bins under conflicts.

Two pieces conflict if they share a source or a duplicate cluster; conflicting pieces never share a bin. Documents
longer than a bin are cut into whole bins and a rest. The rests are dealt by a hash of their id to shards of a bounded
expected size, whose number grows with the table, and each shard is packed by decreasing length: bins are kept by
residual length and carry their sources and duplicate clusters as bitmaps, the search begins at the smallest residual
that fits and goes on to its successors until a bin has no conflict; where none is left, a new bin is opened.

Only (id, length, source, cluster) is moved, never text. `bin_texts` builds the bins' texts from the result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforge.llm._common import WHITE_SPACE, empty_if_null, settle

CAPACITY = 2048
#: Documents in a shard, about. More shards are made as the table grows; no document is left out.
SHARD_DOCUMENTS = 4096
#: Equal rows that go to one shard together, at most.
_COPIES = 256
_WORD = r"[^\x20\x09-\x0D]+"


class BinShelf:
    """Open bins by residual, each with the bitmap of what it holds."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []
        self.shelves: dict[int, dict[int, list[int]]] = {}
        self.opened = 0

    def _put(self, residual: int, held: int, number: int) -> None:
        if residual:
            if residual not in self.shelves:
                insort(self.residuals, residual)
                self.shelves[residual] = {}
            heapq.heappush(self.shelves[residual].setdefault(held, []), number)

    def place(self, length: int, mask: int) -> tuple[int, int]:
        """Bin and offset of the tightest bin without a conflict; of equally tight ones the one opened first."""
        for at in range(bisect_left(self.residuals, length), len(self.residuals)):
            residual = self.residuals[at]
            shelf = self.shelves[residual]
            fits = [(numbers[0], held) for held, numbers in shelf.items() if not held & mask]
            if fits:
                number, held = min(fits)
                heapq.heappop(shelf[held])
                if not shelf[held]:
                    del shelf[held]
                if not shelf:
                    del self.shelves[residual], self.residuals[at]
                self._put(residual - length, held | mask, number)
                return number, self.capacity - residual
        number, self.opened = self.opened, self.opened + 1
        self._put(self.capacity - length, mask, number)
        return number, 0

    def whole(self) -> int:
        number, self.opened = self.opened, self.opened + 1
        return number


def pack_rows(rows: list[tuple], capacity: int) -> list[tuple]:
    """(key, doc_id, n_words, source, cluster) to (doc_id, piece, start_word, n_words, bin, offset), in one shard."""
    shelf, out = BinShelf(capacity), []
    sources = {s: k for k, s in enumerate(sorted({r[3] for r in rows if r[3] is not None}))}
    shared = sorted(c for c, n in Counter(r[4] for r in rows if r[4] is not None).items() if n > 1)
    clusters = {c: len(sources) + k for k, c in enumerate(shared)}
    for _, doc_id, length, source, cluster in sorted(rows, key=lambda r: (-(r[2] % capacity), r[0])):
        full, rest = divmod(length, capacity)
        out += [(doc_id, k, k * capacity, capacity, shelf.whole(), 0) for k in range(full)]
        if rest:
            mask = (1 << sources[source] if source in sources else 0) | (1 << clusters[cluster] if cluster in clusters else 0)
            out.append((doc_id, full, full * capacity, rest, *shelf.place(rest, mask)))
        elif not full:
            out.append((doc_id, 0, 0, 0, None, None))
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(empty_if_null(text), F.lit(_WORD)).cast("long")


def text_cluster(text: Column) -> Column:
    """Texts that are equal without white space share it."""
    return F.xxhash64(F.regexp_replace(empty_if_null(text), WHITE_SPACE + "+", ""))


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = "source",
    cluster: Column | None = None,
    shard_documents: int = SHARD_DOCUMENTS,
) -> DataFrame:
    """doc_id, piece, start_word, n_words, bin_id, bin_offset: a row per piece, lengths and offsets in words; ids of any type.

    Every word of every row is in exactly one piece. A text without words (null, empty, white space) gives one piece of
    0 words in no bin. A null source or cluster conflicts with nothing. cluster is a column of docs' rows; by default
    texts that are equal without white space conflict. Repeated rows are packed each for itself and share a cluster, so
    they never meet in a bin. An empty table gives an empty result. Bin ids are unique over all shards.
    """
    n_words = word_count(F.col(text_col))
    id_type = docs.schema[id_col].dataType.simpleString()
    numbers = id_type in ("tinyint", "smallint", "int", "bigint")
    narrow = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        n_words.alias("n_words"),
        (F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")).alias("source"),
        F.when(n_words > 0, text_cluster(F.col(text_col)) if cluster is None else cluster).cast("string").alias("cluster"),
    )
    # Rows that are equal in all this are counted before they move, and then dealt over the shards by _COPIES.
    narrow = settle(narrow.groupBy("doc_id", "n_words", "source", "cluster").agg(F.count(F.lit(1)).alias("copies")))
    shards = max(1, -(-(narrow.agg(F.sum("copies")).first()[0] or 0) // shard_documents))
    block = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("copies") - 1).cast("long"), F.lit(_COPIES).cast("long")))
    narrow = narrow.withColumn("block", block).withColumn("copies", F.least(F.col("copies") - F.col("block"), F.lit(_COPIES).cast("long")))

    def pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        told = []
        for doc_id, n, source, group, copies, first in zip(*(rows[c] for c in ("doc_id", "n_words", "source", "cluster", "copies", "block")), strict=True):
            at = None if doc_id is None or pd.isna(doc_id) else int(doc_id) if numbers else doc_id
            group = None if group is None or pd.isna(group) else group
            order = (at is not None, at if at is not None else 0 if numbers else "", group or "", first)
            told += [(order, at, int(n), None if source is None or pd.isna(source) else source, group)] * int(copies)
        packed = pack_rows(told, capacity)
        frame = pd.DataFrame(packed, columns=["doc_id", "piece", "start_word", "n_words", "bin", "bin_offset"], dtype=object)
        frame["doc_id"] = [None if i is None else str(i) for i in frame["doc_id"]]
        frame["bin_id"] = [None if b is None else (int(key[0]) << 32) + b for b in frame["bin"]]
        return frame.astype({"piece": "int32", "start_word": "int64", "n_words": "int64", "bin_id": "Int64", "bin_offset": "Int32"})[
            ["doc_id", "piece", "start_word", "n_words", "bin_id", "bin_offset"]
        ]

    shard = F.pmod(F.xxhash64("doc_id", "cluster", "block"), F.lit(shards)).cast("int")
    packed = narrow.groupBy(shard.alias("shard")).applyInPandas(pack_shard, "doc_id string, piece int, start_word long, n_words long, bin_id long, bin_offset int")
    return packed.withColumn("doc_id", F.col("doc_id").cast(id_type))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """bins, words, share: how full the bins are; share is null without bins."""
    held = packed.where("bin_id IS NOT NULL").agg(F.countDistinct("bin_id").alias("bins"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"))
    return held.select("bins", "words", F.try_divide(F.col("words"), F.col("bins") * capacity).alias("share"))


def bin_texts(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n\n") -> DataFrame:
    """bin_id, doc_ids, text: the bins' texts, words joined by one space and pieces by separator. Ids must be unique."""
    words = F.regexp_extract_all(empty_if_null(F.col(text_col)), F.lit(_WORD), F.lit(0))
    texts = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    pieces = packed.where("bin_id IS NOT NULL").join(texts, "doc_id")
    part = F.struct("bin_offset", "doc_id", F.array_join(F.slice("words", F.col("start_word").cast("int") + 1, F.col("n_words").cast("int")), " ").alias("text"))
    parts = pieces.groupBy("bin_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return parts.select("bin_id", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.array_join(F.transform("parts", lambda p: p["text"]), separator).alias("text"))
