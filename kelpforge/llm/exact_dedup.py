"""Exact duplicate groups by skew-safe combining, in DataFrame functions only.

Texts are equal when they are identical without white space (0x20, 0x09-0x0D). Three stages combine them, each grouping
by digest *and* full content:

1. locally: the map side of the first aggregate keeps one row per text and salt of each input task;
2. by (digest, salt): rows of a hot text meet in as many tasks as there are salts;
3. by digest: the salt winners, at most `salts` rows a text, give the group's winner and size.

On the way back rows meet their group's winner by a join on the group, in which the few groups that hold a good share of
all rows are broadcast (`join_heavy`) and so stay where they lie. A group is named by its digest alone, and by digest and
content where one digest stands for two contents. SHA-256 makes that set empty in practice, which is why it alone may be
broadcast whole; tests give a weak digest to exercise it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpforge.llm._common import WHITE_SPACE, empty_if_null, join_heavy, settle

SALTS = 16
#: A winner packs (code points, smallest id) in one number, which a hash aggregate can hold: points * 2^64 + (2^63 - 1 - id).
_POINTS_UNIT = 1 << 64
_ID_TOP = (1 << 63) - 1


def sha256_of(content: Column) -> Column:
    return F.sha2(content, 256)


def normalised(text: Column) -> Column:
    return F.regexp_replace(empty_if_null(text), WHITE_SPACE + "+", "")


def _is_number(docs: DataFrame, id_col: str) -> bool:
    return docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def _pack(points: Column, doc_id: Column, number: bool) -> Column:
    """What is greatest for the row that stays: one number for ids that are numbers, which a hash aggregate can hold, else a struct."""
    if not number:
        return F.struct((-points).alias("p"), doc_id.isNull().alias("n"), doc_id.alias("i"))
    wide = "decimal(38,0)"
    rank = F.lit(_ID_TOP).cast(wide) - F.coalesce(doc_id.cast("long"), F.lit(_ID_TOP)).cast(wide)
    return ((points.cast("decimal(11,0)") * F.lit(str(_POINTS_UNIT)).cast("decimal(20,0)")).cast(wide) + rank).cast(wide)


def _best_of(column: Column, number: bool) -> Column:
    return F.max(column) if number else F.min(column)


def _winner_points(packed: Column, number: bool) -> Column:
    if not number:
        return (-packed["p"]).cast("long")
    return F.floor(packed / F.lit(str(_POINTS_UNIT)).cast("decimal(38,0)")).cast("long")


def _winner_id(packed: Column, number: bool) -> Column:
    if not number:
        return packed["i"]
    rest = packed % F.lit(str(_POINTS_UNIT)).cast("decimal(38,0)")
    return F.when(rest > 0, (F.lit(_ID_TOP).cast("decimal(38,0)") - rest).cast("long"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row, dropped ones too.

    Of equal texts the row with the most code points stays, then the smallest id. Ids are of any type that can be ordered;
    integers come back as 64-bit ones. Null text counts as empty; all empty texts are one group. A row without an id loses to rows of its length
    with one; where it stays, keep_id is null. Of rows that are equal in all this, repeated rows among them, one is
    kept; all count in group_size. Other columns of docs are neither read nor returned, so their names cannot clash. An
    empty table gives an empty result.
    """
    rows, winners, collided, total = _combined(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", salts, digest)
    members = _with_group(rows, collided).select("doc_id", "points", "grp", F.sha2("content", 256).alias("text_sha256"))
    members = settle(members.withColumn("row_key", F.monotonically_increasing_id()))
    best = members.select("grp", "row_key", "points", "doc_id")
    chosen = join_heavy(best, winners, "grp", "group_size", total, lambda j: j.where(_is_best()).groupBy("grp").agg(F.min("row_key").alias("chosen")))
    named = winners.join(chosen, "grp")
    return join_heavy(members, named, "grp", "group_size", total, sizes=winners).select(
        "doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("chosen")).alias("kept"), "text_sha256"
    )


def _combined(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column] = sha256_of) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """docs as (row, doc_id, points, content, digest); its groups' winners, written out; digests of two contents; how many rows."""
    number = _is_number(docs, id_col)
    rows = docs.select(
        F.struct("*").alias("row"), (F.col(id_col).cast("long") if number else F.col(id_col)).alias("doc_id"), F.length(empty_if_null(F.col(text_col))).alias("points"), normalised(F.col(text_col)).alias("content")
    ).withColumn("digest", digest(F.col("content")))
    salt = F.pmod(F.xxhash64("doc_id", "points"), F.lit(salts)).cast("int")
    salted = rows.groupBy("digest", salt.alias("salt"), "content").agg(_best_of(_pack(F.col("points"), F.col("doc_id"), number), number).alias("best"), F.count(F.lit(1)).alias("members"))
    groups = salted.repartition("digest").groupBy("digest", "content").agg(_best_of(F.col("best"), number).alias("best"), F.sum("members").alias("group_size"))
    groups = groups.withColumn("collides", F.count(F.lit(1)).over(Window.partitionBy("digest")) > 1)
    winners = settle(groups.select("digest", "collides", _group_name().alias("grp"), _winner_points(F.col("best"), number).alias("most"), _winner_id(F.col("best"), number).alias("keep_id"), "group_size"))
    collided = winners.where("collides").select("digest", F.lit(True).alias("collides")).distinct()
    total = winners.agg(F.sum("group_size")).first()[0] or 0
    return rows, winners.drop("digest", "collides"), collided, total


def _group_name() -> Column:
    return F.when(F.col("collides"), F.concat("digest", F.lit(":"), "content")).otherwise(F.col("digest"))


def _with_group(rows: DataFrame, collided: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(collided), "digest", "left").withColumn("grp", _group_name())


def _is_best() -> Column:
    """Of a row beside its group's winner, which has the most points and, of those rows, the smallest id; a null id comes last.

    Told by order, for Spark would take equalities into the join's keys, and the rows of a group would then lie apart.
    """
    return (F.col("points") >= F.col("most")) & (F.col("keep_id").isNull() | (F.col("doc_id") <= F.col("keep_id")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs: the longest, then the one with the smallest id.

    Rows are decided one by one, whatever their ids: of several rows of that length and id (repeated rows, rows without
    an id, an id that stands for several texts) the one stays whose text, then whose other columns as JSON sort first.
    Rows that are equal in all columns leave one. Null text counts as empty. No column of docs can clash with a name of
    this operator's own; an empty table gives an empty result.
    """
    rows, winners, collided, total = _combined(docs, id_col, text_col, salts)
    others = [F.col("row")[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col]
    order = F.struct(F.col("row")[text_col], F.to_json(F.struct(*others)))
    first = lambda j: j.where(_is_best()).groupBy("grp").agg(F.min_by("row", order).alias("row"))
    keyed = _with_group(rows, collided).select("row", "doc_id", "points", "grp")
    return join_heavy(keyed, winners, "grp", "group_size", total, first).select(*(F.col("row")[c].alias(c) for c in docs.columns))
