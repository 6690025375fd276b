"""Reading and writing: state tables, hash-checked artifacts, CSV and JSON with checks, evidence packs, generators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.functions.text import spreadsheet_safe
from kelpforge.operators.tables import latest
from kelpforge.sources.shared import create_once, exists, names_in, read_small, remove

STATE_VERSION = 1
RATINGS = "user long, item long, rating double, timestamp long"


class StateStore:
    """Append-only tables in one folder: each write adds files, reads fold to the newest row of a key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        told = self.get("meta", "version")
        if told is None:
            self.put("meta", "version", STATE_VERSION)
        elif told > STATE_VERSION:
            raise ValueError(f"the state is of version {told}, newer than {STATE_VERSION}")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def put(self, table: str, key: str, value) -> None:
        """Numbers are files that only one writer can create, so that two writers never put under one number."""
        seq = max((int(n) for n in names_in(self.spark, f"{self.path(table)}.numbers")), default=-1) + 1
        while not create_once(self.spark, f"{self.path(table)}.numbers/{seq:012d}"):
            seq += 1
        self.append(table, self.spark.createDataFrame([(key, json.dumps(value), seq)], "key string, value string, seq long"))

    def get(self, table: str, key: str, default=None):
        if not self.exists(table):
            return default
        row = latest(self.read(table).where(F.col("key") == key), ["key"], "seq").first()
        return default if row is None else json.loads(row["value"])

    def rewrite(self, table: str, rows: DataFrame, generation: int) -> str:
        """A new generation beside the old one, which its reader may still be using."""
        path = f"{self.path(table)}.{generation}"
        rows.write.mode("errorifexists").parquet(path)
        return path

    def purge(self, tables: Sequence[str], tenant: str, generation: int) -> list[str]:
        """All tables rewritten without a tenant's rows."""
        return [self.rewrite(t, self.read(t).where(F.col("tenant_id") != tenant), generation) for t in tables]

    def restore_or_build(self, fingerprint: str, build) -> DataFrame:
        """The built table if one was finished from data of this fingerprint, else built anew in a folder of its own.

        A mark names the finished folder; what a failed build left has none and is built again.
        """
        mark = f"{self.path(f'built-{fingerprint[:16]}')}.done"
        if not exists(self.spark, mark):
            folder = f"built-{fingerprint[:16]}-{uuid.uuid4().hex}"
            build().write.parquet(self.path(folder))
            if not create_once(self.spark, mark, folder):
                remove(self.spark, self.path(folder))
        return self.read(read_small(self.spark, mark))


def read_artifact(spark: SparkSession, path: str, sha256: str) -> bytes:
    """A file's bytes, if their SHA-256 is as expected. Artifacts are models, which fit in memory."""
    row = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("sha")).first()
    if row is None or row["sha"] != sha256:
        raise ValueError(f"{path} is not what was written")
    return bytes(row["content"])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RATINGS).option("mode", "FAILFAST").csv(path, header=True)


def parse_checked(df: DataFrame, json_col: str, schema: str, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON bodies that parse and pass all checks, and the others with what is wrong (checks are over `body`)."""
    parsed = df.withColumn("body", F.from_json(json_col, schema, {"mode": "PERMISSIVE"}))
    empty = F.col("body").isNull() | F.forall(F.map_values(F.from_json(F.coalesce(json_col, F.lit("{}")), "map<string,string>")), lambda v: v.isNull())
    wrong = F.array_compact(F.array(F.when(empty, F.lit("no object")), *(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    told = parsed.withColumn("faults", wrong)
    return told.where(F.size("faults") == 0).select(*df.columns, "body.*"), told.where(F.size("faults") > 0).select(*df.columns, "faults")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV in which no text cell starts like a formula."""
    texts = {c for c, t in df.dtypes if t == "string"}
    df.select(*(spreadsheet_safe(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns)).write.option("header", True).option("escape", '"').csv(path)


def write_evidence(entries: DataFrame, manifest: DataFrame, path: str, cap: int | None = None) -> None:
    """One JSON document per line: the manifest under `manifest`, the entries under `entries`, written in tasks whatever their number.

    A cap is the caller's; more than cap entries are refused, not cut.
    """
    told = manifest.first() if cap is not None else None
    if told and told["entries"] > cap:
        raise ValueError(f"{told['entries']} entries are more than {cap}; choose a shorter range")
    manifest.select(F.to_json(F.struct("*"))).write.text(f"{path}/manifest")
    entries.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})).write.text(f"{path}/entries")


def read_evidence(spark: SparkSession, path: str, entry_schema: str) -> tuple[DataFrame, DataFrame]:
    manifest = spark.read.json(f"{path}/manifest")
    return manifest, spark.read.schema(entry_schema).option("mode", "FAILFAST").json(f"{path}/entries")


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def as_document(df: DataFrame, *order: str) -> DataFrame:
    """One row, document: a registry-sized table as a JSON array in the given order."""
    whole = F.struct(*(F.col(c) for c in (*order, *(c for c in df.columns if c not in order))))
    return df.agg(F.to_json(F.array_sort(F.collect_list(whole))).alias("document"))


def _uniform(*parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)).cast("double")


def synthetic_world(spark: SparkSession, users: int, items: int, topics: int = 8, per_user: int = 40, seed: int = 7) -> DataFrame:
    """user, item, topic, clicked from hashes of ids, the same on any cluster: users prefer one topic, items have one."""
    rows = spark.range(users * per_user).select((F.col("id") / per_user).cast("long").alias("user"), F.col("id").alias("n"))
    rows = rows.withColumn("item", F.pmod(F.xxhash64("n", F.lit(seed)), F.lit(items)))
    rows = rows.withColumn("topic", F.pmod(F.xxhash64("item", F.lit(seed + 1)), F.lit(topics))).withColumn("likes", F.pmod(F.xxhash64("user", F.lit(seed + 2)), F.lit(topics)))
    p = F.when(F.col("topic") == F.col("likes"), 0.6).otherwise(0.05)
    return rows.select("user", "item", "topic", (_uniform("n", F.lit(seed + 3)) < p).alias("clicked"))


def synthetic_applicants(spark: SparkSession, n: int, seed: int = 11) -> DataFrame:
    """Applicants whose use of recent tools falls with age, so that screening by it is unfair by age and by nothing else."""
    rows = spark.range(n).withColumn("age", (22 + _uniform("id", F.lit(seed)) * 38).cast("int"))
    rows = rows.withColumn("gender", F.when(_uniform("id", F.lit(seed + 1)) < 0.5, "f").otherwise("m"))
    rows = rows.withColumn("skill_match", F.round(_uniform("id", F.lit(seed + 2)), 3)).withColumn("assessment_score", F.round(_uniform("id", F.lit(seed + 3)), 3))
    return rows.withColumn("recent_tooling", F.round(F.greatest(F.lit(0.0), 1.3 - F.col("age") / 40 + 0.2 * _uniform("id", F.lit(seed + 4))), 3))


def synthetic_employees(spark: SparkSession, n: int, seed: int = 13) -> DataFrame:
    u = lambda k: _uniform("id", F.lit(seed + k))
    rows = spark.range(n).select(
        F.concat(F.lit("subj_"), "id").alias("subject_key"), (u(0) * 12).alias("tenure_years"), (u(1) * 60).alias("months_since_promotion"), (40_000 + u(2) * 60_000).alias("salary"),
        F.lit(70_000.0).alias("band_midpoint"), F.lit(68_000.0).alias("peer_median_salary"), F.floor(u(3) * 4).cast("double").alias("manager_changes_24m"), (u(4) * 90).alias("commute_minutes"),
        (1 + u(5) * 4).alias("engagement_score"), (u(6) * 40).alias("training_hours_12m"), (u(7) * 30).alias("overtime_hours_monthly"), F.floor(u(8) * 3).cast("double").alias("internal_applications_12m"), u(9).alias("__u"),
    )
    p = 1 / (1 + F.exp(-(2.5 - F.col("engagement_score") + F.col("overtime_hours_monthly") / 20 - F.col("salary") / 70_000)))
    return rows.withColumn("left", F.col("__u") < p).drop("__u")
