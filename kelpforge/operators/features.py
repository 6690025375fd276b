"""Point-in-time features: as-of joins with embargo and expiry, latest values, leakage audit, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    name: str
    default: float = 0.0


@dataclass(frozen=True)
class FeatureView:
    """Declared features of an entity; values older than ttl_seconds don't count."""

    name: str
    features: Sequence[Feature]
    ttl_seconds: int = 30 * 86_400
    entity: str = "entity_id"
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        names = tuple(f.name for f in self.features)
        if not names or len(set(names)) < len(names):
            raise ValueError(f"feature view {self.name}: features must be named, each once")
        if self.ttl_seconds <= 0:
            raise ValueError(f"feature view {self.name}: ttl must be positive")
        object.__setattr__(self, "names", names)

    def undeclared(self, writes: DataFrame) -> DataFrame:
        """Keys of writes.values that the view doesn't declare, with the number of rows."""
        keys = writes.select(F.explode(F.map_keys("values")).alias("feature"))
        return keys.where(~F.col("feature").isin(*self.names)).groupBy("feature").count()


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _first_written(view: FeatureView, writes: DataFrame) -> DataFrame:
    """entity_id, t and a column per feature; of writes at one instant the earliest set value wins."""
    told = [
        F.min(F.when(F.try_element_at("values", F.lit(n)).isNotNull(), F.struct("write_seq", F.try_element_at("values", F.lit(n)).alias("v"))))["v"].alias(f"f{k}")
        for k, n in enumerate(view.names)
    ]
    return writes.groupBy("entity_id", _micros(F.col("event_time")).alias("t")).agg(*told)


def point_in_time_join(view: FeatureView, labels: DataFrame, writes: DataFrame, embargo_seconds: int = 0) -> DataFrame:
    """labels (entity_id, label_time, ...) with a column per feature: its newest value in [cutoff - ttl, cutoff], else its default.

    cutoff is label_time - embargo. writes is (entity_id, event_time, write_seq, values map). Labels and writes of an
    entity meet in one sorted pass: the newest (time, value) so far is carried on, and dropped where it has expired, so
    the frame never has to be kept. Time is cut in spans of one ttl, and a write is sent to its own span and the next,
    beyond which it has expired: so an entity with a large share of all writes is spread over its spans.
    """
    span = lambda t: F.floor(t / F.lit(view.ttl_seconds * 1_000_000))
    features = _first_written(view, writes)
    features = features.withColumn("span", F.explode(F.array(span(F.col("t")), span(F.col("t")) + 1)))
    columns = [f"f{k}" for k in range(len(view.names))]
    own = F.struct(*(F.col(c) for c in labels.columns))
    asked = labels.select("entity_id", (_micros(F.col("label_time")) - embargo_seconds * 1_000_000).alias("t"), own.alias("own"))
    both = asked.withColumn("span", span(F.col("t"))).unionByName(features, allowMissingColumns=True)
    so_far = Window.partitionBy("entity_id", "span").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    newest = [F.last(F.when(F.col(c).isNotNull(), F.struct("t", F.col(c).alias("v"))), ignorenulls=True).over(so_far).alias(c) for c in columns]
    oldest = F.col("t") - view.ttl_seconds * 1_000_000
    values = [F.coalesce(F.when(F.col(c)["t"] >= oldest, F.col(c)["v"]), F.lit(f.default)).alias(f.name) for c, f in zip(columns, view.features, strict=True)]
    return both.select("t", "own", *newest).where("own IS NOT NULL").select("own.*", *values)


def latest(view: FeatureView, writes: DataFrame, as_of: str | None = None) -> DataFrame:
    """entity_id and its newest value per feature; with as_of only what is then visible and not expired."""
    rows = _first_written(view, writes)
    if as_of is not None:
        now = _micros(F.lit(as_of).cast("timestamp"))
        rows = rows.where((F.col("t") <= now) & (F.col("t") >= now - view.ttl_seconds * 1_000_000))
    newest = [F.coalesce(F.max_by(f"f{k}", F.when(F.col(f"f{k}").isNotNull(), F.col("t"))), F.lit(f.default)).alias(f.name) for k, f in enumerate(view.features)]
    return rows.groupBy("entity_id").agg(*newest)


def leaked(view: FeatureView, examples: DataFrame, writes: DataFrame, embargo_seconds: int = 0) -> DataFrame:
    """entity_id, label_time, feature, value of examples that can only come from after their cutoff.

    A value leaks if it isn't the default and the entity's first write of it is later than the cutoff. So one minimum
    per (entity, feature, value) decides, and no inequality join is needed.
    """
    told = F.map_from_arrays(F.array(*map(F.lit, view.names)), F.array(*(F.col(n).cast("double") for n in view.names)))
    defaults = F.map_from_arrays(F.array(*map(F.lit, view.names)), F.array(*(F.lit(float(f.default)) for f in view.features)))
    held = examples.select("entity_id", "label_time", F.explode(told).alias("feature", "value")).where(F.col("value") != defaults[F.col("feature")])
    written = writes.select("entity_id", _micros(F.col("event_time")).alias("t"), F.explode("values").alias("feature", "value"))
    first = written.groupBy("entity_id", "feature", "value").agg(F.min("t").alias("first"))
    late = held.join(first, ["entity_id", "feature", "value"])
    return late.where(F.col("first") > _micros(F.col("label_time")) - embargo_seconds * 1_000_000).select("entity_id", "label_time", "feature", "value")


def assert_no_leakage(view: FeatureView, examples: DataFrame, writes: DataFrame, embargo_seconds: int = 0) -> None:
    found = leaked(view, examples, writes, embargo_seconds).limit(5).collect()
    if found:
        raise ValueError(f"feature values from the future: {found}")


#: Words of 32 bits in a row's SHA-256.
_WORDS = 8


def data_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the row count and a digest of the named columns that doesn't depend on the order of rows.

    A row's SHA-256 (over each value with its length, nulls apart from all values) is taken as eight words; the digest is
    the SHA-256 of the count and the words' exact sums. Two tables agree only if the sums of their rows' digests do, all 256
    bits of them, so repeated rows count and no 64-bit collision hides a change.
    """
    told = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    row = F.sha2(F.concat(*map(told, columns or df.columns)), 256)
    words = [F.sum(F.conv(F.substring("row", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{k}") for k in range(_WORDS)]
    sums = df.select(row.alias("row")).agg(F.count(F.lit(1)).alias("rows"), *words)
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", *(F.coalesce(f"w{k}", F.lit(0)) for k in range(_WORDS))), 256).alias("fingerprint"))


def assemble_training_rows(labels: DataFrame, users: DataFrame, items: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """labels (user_id, item_id, label) with the columns of both views and the dot product of both vectors, 0 if one is missing.

    Both tables of a key meet the labels together, so labels are dealt anew once a key. The tables are what a task holds as
    hash tables; labels, which are many more, go by and are never sorted.
    """
    from kelpforge.functions.numeric import dot

    held = lambda t: t.hint("shuffle_hash")
    joined = labels
    for key, view, vectors, name in (("user_id", users, user_vectors, "__u"), ("item_id", items, item_vectors, "__i")):
        joined = joined.join(held(view), key, "left").join(held(vectors.withColumnRenamed("vector", name)), key, "left")
    return joined.withColumn("retrieval_score", F.coalesce(dot(F.col("__u"), F.col("__i")), F.lit(0.0))).drop("__u", "__i")
