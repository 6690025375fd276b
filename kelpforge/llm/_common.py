"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.sources.shared import settle, shared_folder

WHITE_SPACE = r"[\x20\x09-\x0D]"


#: Tables below this size may be one Parquet row group, which one task would have to read and process alone.
_SMALL_BYTES, _TASK_BYTES = 20 << 20, 1 << 20
ROW = "__row"
#: Keys with a share of the rows above one in this many are joined by broadcast, so at most this many rows are.
HEAVY_KEYS = 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one is dealt over the cores, one task for each megabyte, since its files may not split.

    A session without a JVM of its own (Spark Connect) gives no size: there the table is read as it lies.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if getattr(df, "_jdf", None) is None:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = min(spark.sparkContext.defaultParallelism, size // _TASK_BYTES)
    return df.repartition(tasks) if size < _SMALL_BYTES and tasks > 1 else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where it names none: a folder of this machine in local mode, an error elsewhere."""
    return shared_folder(spark)


def with_row_key(docs: DataFrame, name: str = ROW) -> DataFrame:
    """docs with a key of each row's own in column name; written out, so that every later read sees the same key."""
    return settle(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to differ from all columns of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_heavy(
    rows: DataFrame,
    table: DataFrame,
    keys: str | list[str],
    weight: str,
    total: int,
    each: Callable[[DataFrame], DataFrame] = lambda joined: joined,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """rows joined (inner) with table, which has one row for each combination of keys and says in weight how many rows have it.

    Keys with more than total / HEAVY_KEYS rows number fewer than HEAVY_KEYS, if the weights add up to total at most: the
    driver takes these, and only their rows of table are broadcast, so that none of them gathers its rows in one task. All
    others are shuffled; without heavy keys that is all there is. Null keys never join. `each` works on the joined rows of
    heavy and of other keys apart, where what was shuffled by keys still lies so. sizes is a cheaper table with the keys and
    their weights, where table takes work.
    """
    keys = [keys] if isinstance(keys, str) else keys
    heavy = F.col(weight) * HEAVY_KEYS > total
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))
    hot = (table if sizes is None else sizes).where(heavy & known).select(*keys).limit(HEAVY_KEYS).collect()
    if not hot:
        return each(rows.join(table, keys))
    if len(keys) == 1:
        among = F.col(keys[0]).isin([r[0] for r in hot])
    else:
        among = reduce(or_, (reduce(and_, (F.col(k) == r[k] for k in keys)) for r in hot))
    return each(rows.where(among).join(F.broadcast(table.where(among)), keys)).unionByName(each(rows.where(~among).join(table.where(~among), keys)))


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(doc_id.cast("string")) % divisor


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """Whether labels of this id may not be learned from; rows without an id are never learned from."""
    return F.coalesce(id_remainder(doc_id, divisor) == remainder, F.lit(True))
