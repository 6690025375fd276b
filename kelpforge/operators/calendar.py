"""Calendars by owner: free time left by appointments, slots of a length, and their assignment without overlap.

Times are numbers (seconds, say) and intervals are half-open. One sweep over an owner's sorted points does the work of
interval subtraction: points are added up before they move, so an owner costs as many rows as it has distinct times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _points(intervals: DataFrame, name: str) -> DataFrame:
    ends = intervals.where("start < end").select("owner", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("p"))
    return ends.select("owner", "p.at", F.col("p.d").alias(name))


def _stretches(points: DataFrame, holds: Column) -> DataFrame:
    """owner, start, end: the longest stretches in which holds is true of the sums so far of all columns but owner and at."""
    counts = [c for c in points.columns if c not in ("owner", "at")]
    at = points.groupBy("owner", "at").agg(*(F.sum(c).alias(c) for c in counts))
    own = Window.partitionBy("owner").orderBy("at")
    sums = at.select("owner", "at", *(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in counts))
    turns = sums.select("owner", "at", F.coalesce(holds, F.lit(False)).alias("holds")).withColumn("held", F.coalesce(F.lag("holds").over(own), F.lit(False))).where("holds <> held")
    # What is left is a start and an end in turn.
    return turns.withColumn("end", F.lead("at").over(own)).where("holds").select("owner", F.col("at").alias("start"), "end")


def merged(busy: DataFrame) -> DataFrame:
    """owner, start, end: overlapping and touching intervals as one; empty and reversed ones, and those with a null, count for nothing."""
    return _stretches(_points(busy.dropna(), "busy"), F.col("busy") > 0)


def free(hours: DataFrame, busy: DataFrame) -> DataFrame:
    """owner, start, end: what of the opening hours no appointment takes. Both are (owner, start, end), in any order, overlapping or not."""
    nothing = F.lit(0)
    points = _points(hours.dropna(), "open").withColumn("busy", nothing).unionByName(_points(busy.dropna(), "busy").withColumn("open", nothing))
    return _stretches(points, (F.col("open") > 0) & (F.col("busy") == 0))


def slots(free_time: DataFrame, length: int) -> DataFrame:
    """owner, start, end: each free interval cut into slots of one length from its start; what is left over is no slot."""
    if length <= 0:
        raise ValueError("a slot has a length")
    n = F.floor((F.col("end") - F.col("start")) / length).cast("int")
    cut = free_time.withColumn("n", n).where("n > 0").select("owner", "start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return cut.select("owner", (F.col("start") + F.col("k") * length).alias("start"), (F.col("start") + (F.col("k") + 1) * length).alias("end"))


def assign(requests: DataFrame, free_slots: DataFrame) -> DataFrame:
    """owner, request, priority, start, end: the requests of an owner get its slots in turn, by priority, then request.

    Every slot is given once, so nothing overlaps; requests beyond the slots have nulls.
    """
    turn = lambda *by: F.row_number().over(Window.partitionBy("owner").orderBy(*by))
    asked = requests.select("owner", "request", "priority").withColumn("k", turn("priority", "request"))
    return asked.join(free_slots.withColumn("k", turn("start")), ["owner", "k"], "left").drop("k")
