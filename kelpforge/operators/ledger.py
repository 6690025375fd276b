"""Hash-chained decision ledger: appending, parallel verification, signatures, evidence."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforge.functions.hashing import GENESIS, hmac_sha256, iso_timestamp, length_prefixed, length_prefixed_list
from kelpforge.sources.shared import settle

TEXTS = ("tenant_id", "workflow", "run_id", "step", "action_type", "subject_id", "agent", "outcome")
ENTRY = (
    "sequence long, tenant_id string, workflow string, run_id string, step string, action_type string, subject_id string, agent string, outcome string, "
    "reasons array<string>, approver string, recorded_at timestamp, previous_hash string, entry_hash string, signature string"
)
_CHAIN = ("sequence", "previous_hash", "entry_hash")


def content_hash(sequence: Column, previous: Column) -> Column:
    """SHA-256 of an entry's canonical form: every part with its length, so no two entries share one."""
    return F.sha2(length_prefixed(sequence, previous, iso_timestamp(F.col("recorded_at")), *(F.col(c) for c in TEXTS), length_prefixed_list(F.col("reasons")), F.col("approver")), 256)


def _told(sequence: str, previous: str) -> str:
    """The first two parts of an entry's canonical form."""
    return f"{len(sequence)}:{sequence}{len(previous)}:{previous}"


def sign_text(kind: str, tenant: str, sequence: int, digest: str) -> str:
    return "".join(f"{len(p)}:{p}" for p in (kind, tenant, str(sequence), digest))


def append(entries: DataFrame, heads: DataFrame | None = None, key: bytes | None = None, order: str = "write_seq") -> DataFrame:
    """New ledger rows of `entries` (the texts, reasons, approver, recorded_at and an order), chained behind heads (tenant_id, sequence, entry_hash).

    A chain is sequential by definition, so a tenant's new entries pass through one task, which holds one batch of them at
    a time; tenants run in parallel. New entries are what has arrived since the last append, not a tenant's history.
    """
    heads = heads if heads is not None else entries.sparkSession.createDataFrame([], "tenant_id string, sequence long, entry_hash string")
    last = heads.select(F.col("tenant_id").alias("__t"), F.col("sequence").alias("__seq"), F.col("entry_hash").alias("__hash"))
    rows = entries.join(last, F.col("tenant_id").eqNullSafe(F.col("__t")), "left").drop("__t")

    # All of an entry's form but its number and the hash before it is made where the rows lie; the fold adds those two.
    rest = length_prefixed(iso_timestamp(F.col("recorded_at")), *(F.col(c) for c in TEXTS), length_prefixed_list(F.col("reasons")), F.col("approver"))
    kept = ["tenant_id", *(c for c in TEXTS if c != "tenant_id"), "reasons", "approver", "recorded_at"]
    rows = rows.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>"))).select(*kept, F.col(order).alias("__order"), rest.alias("__rest"), F.col("__seq").cast("long").alias("__seq"), "__hash")

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, sequence, previous = object(), 0, GENESIS
        for part in parts:
            sequences, before, after = [], [], []
            names = part.column("tenant_id").dictionary_encode()
            whole = names.dictionary.to_pylist()
            own = [None if j is None else whole[j] for j in names.indices.to_pylist()]
            for name, told, seq, head in zip(own, *(part.column(c).to_pylist() for c in ("__rest", "__seq", "__hash")), strict=True):
                if name != tenant:
                    tenant = name
                    sequence, previous = (0, GENESIS) if seq is None else (seq + 1, head)
                digest = hashlib.sha256((_told(str(sequence), previous) + told).encode()).hexdigest()
                sequences.append(sequence)
                before.append(previous)
                after.append(digest)
                sequence, previous = sequence + 1, digest
            chain = [pa.array(sequences, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *chain], [*kept, *_CHAIN])

    kinds = {c.split()[0]: c for c in ENTRY.split(", ")}
    ordered = rows.repartition("tenant_id").sortWithinPartitions("tenant_id", "__order")
    # A chain is costly to work out again, and most of what reads a ledger reads it more than once.
    chained = settle(ordered.mapInArrow(fold, ", ".join(kinds[c] for c in (*kept, *_CHAIN))))
    signature = _signature(key, "entry") if key else F.lit(None).cast("string")
    return chained.withColumn("signature", signature).select(*kinds)


def _signature(key: bytes, kind: str) -> Column:
    return hmac_sha256(key, length_prefixed(F.lit(kind), F.col("tenant_id"), F.col("sequence"), F.col("entry_hash")))


def checked(ledger: DataFrame, key: bytes | None = None, require_signed: bool = False) -> DataFrame:
    """Ledger rows with their first fault or null.

    Each row is hashed by itself and meets its predecessor by (tenant, sequence), not in a window over its tenant, so a
    tenant with most of the rows is dealt over all tasks. A missing predecessor and a repeated sequence are gaps.
    """
    at = ledger.groupBy("tenant_id", "sequence").agg(F.max("entry_hash").alias("__before"), F.count(F.lit(1)).alias("__copies"))
    rows = ledger.join(at.select("tenant_id", "sequence", "__copies"), ["tenant_id", "sequence"])
    rows = rows.join(at.select("tenant_id", (F.col("sequence") + 1).alias("sequence"), "__before"), ["tenant_id", "sequence"], "left")
    before = F.when(F.col("sequence") == 0, F.lit(GENESIS)).otherwise(F.col("__before"))
    fault = (
        F.when(before.isNull() | (F.col("__copies") > 1), F.lit("sequence gap")).when(F.coalesce(F.col("previous_hash") != before, F.lit(True)), F.lit("broken link"))
        .when(F.coalesce(content_hash(F.col("sequence"), F.col("previous_hash")) != F.col("entry_hash"), F.lit(True)), F.lit("content differs from its hash"))
    )
    if key is not None:
        signed = ledger.groupBy(F.col("tenant_id").alias("__t")).agg(F.min(F.when(F.col("signature").isNotNull(), F.col("sequence"))).alias("__signed"))
        rows = rows.join(signed, F.col("tenant_id") == F.col("__t")).drop("__t")
        fault = fault.when(F.col("signature").isNotNull() & (F.col("signature") != _signature(key, "entry")), F.lit("signature does not verify"))
        fault = fault.when(F.col("signature").isNull() & (F.coalesce(F.col("__signed") < F.col("sequence"), F.lit(False)) | F.lit(require_signed)), F.lit("unsigned entry"))
    return rows.select(*ledger.columns, fault.alias("fault"))


def verify(ledger: DataFrame, key: bytes | None = None, require_signed: bool = False) -> DataFrame:
    """tenant_id, intact, entries_checked, broken_at, reason, signed, unsigned: the first break of each tenant's chain.

    Counts are of the rows before the break, or of all rows where there is none.
    """
    rows = checked(ledger, key, require_signed)
    first = rows.groupBy("tenant_id").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("sequence", "fault"))).alias("b"))
    fine = F.col("b").isNull() | (F.col("sequence") < F.col("b.sequence"))
    told = rows.join(first, "tenant_id").groupBy("tenant_id").agg(
        F.first("b").alias("b"), F.sum(fine.cast("long")).alias("entries_checked"), F.count(F.when(fine, F.col("signature"))).alias("signed"), F.sum((fine & F.col("signature").isNull()).cast("long")).alias("unsigned")
    )
    return told.select("tenant_id", F.col("b").isNull().alias("intact"), "entries_checked", F.col("b.sequence").alias("broken_at"), F.col("b.fault").alias("reason"), "signed", "unsigned")


def heads(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("tenant_id").agg(F.max_by(F.struct("sequence", "entry_hash"), "sequence").alias("h")).select("tenant_id", "h.*")


def sign_unsigned(ledger: DataFrame, key: bytes) -> DataFrame:
    """The ledger with all rows signed; refuses tenants whose chain doesn't verify."""
    broken = [r["tenant_id"] for r in verify(ledger).where("NOT intact").select("tenant_id").limit(5).collect()]
    if broken:
        raise ValueError(f"chains that do not verify: {broken}")
    return ledger.withColumn("signature", F.coalesce("signature", _signature(key, "entry")))


def human_approvals(ledger: DataFrame) -> DataFrame:
    return ledger.where("approver IS NOT NULL")


def for_subject(ledger: DataFrame, subject: str) -> DataFrame:
    return ledger.where(F.col("subject_id") == subject).orderBy("tenant_id", "sequence")


def evidence_manifest(ledger: DataFrame, tenant: str, key: bytes | None = None) -> DataFrame:
    """One row: tenant, count, first and last sequence, head hash, a digest over all entry hashes, and a signature if there is a key."""
    own = ledger.where(F.col("tenant_id") == tenant)
    digest = F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64("sequence", "entry_hash").cast("decimal(38,0)"))), 256)
    row = own.agg(F.count(F.lit(1)).alias("entries"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.max_by("entry_hash", "sequence").alias("head_hash"), digest.alias("content_digest"))
    row = row.select(F.lit(tenant).alias("tenant_id"), "*")
    if key is None:
        return row.withColumn("signature", F.lit(None).cast("string"))
    return row.withColumn("signature", hmac_sha256(key, length_prefixed(F.lit("head"), F.col("tenant_id"), F.col("last"), F.col("head_hash"), F.col("content_digest"))))


def verify_evidence(entries: DataFrame, manifest: DataFrame, key: bytes | None = None, expected_head: str | None = None) -> list[str]:
    """What is wrong with an evidence pack; empty if nothing is. Only one-row summaries come to the driver."""
    told = manifest.first()
    again = evidence_manifest(entries, told["tenant_id"], key).first()
    wrong = [f"{c}: manifest has {told[c]}, entries give {again[c]}" for c in ("entries", "first", "last", "head_hash", "content_digest") if told[c] != again[c]]
    if key is not None and not hmac.compare_digest(told["signature"] or "", again["signature"] or ""):
        wrong.append("the manifest's signature does not verify")
    if expected_head is not None and told["head_hash"] != expected_head:
        wrong.append("the head is not the expected one")
    start = told["first"] or 0
    if start == 0:
        wrong += [f"entry {r['broken_at']}: {r['reason']}" for r in verify(entries, key).where("NOT intact").limit(5).collect()]
    return wrong
