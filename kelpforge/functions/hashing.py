"""Hash-derived columns: experiment buckets, pseudonyms, canonical encodings and keyed signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64
_BLOCK = 64


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def unit_interval(text: Column) -> Column:
    """[0, 1) from the first 8 bytes of the SHA-256, big-endian."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("double") / F.lit(float(1 << 64))


def bucket(unit_id: Column, key: str, salt: str) -> Column:
    return unit_interval(F.concat_ws(":", F.lit(salt), F.lit(key), unit_id))


def pseudonym(salt: str, identifiers: dict[str, Column]) -> Column:
    """subj_ + 16 hex digits over the first identifier that is neither null nor empty; without one the row is refused."""
    told = [F.when(c.isNotNull() & (c.cast("string") != ""), F.concat_ws(":", F.lit(salt), F.lit(name), c.cast("string"))) for name, c in identifiers.items()]
    first = F.coalesce(*told, F.lit(None).cast("string"))
    digest = F.concat(F.lit("subj_"), F.substring(F.sha2(first, 256), 1, 16))
    return F.when(first.isNull(), F.raise_error(F.lit("a row has no stable identifier to pseudonymise"))).otherwise(digest)


def institution(salt: str, name: Column) -> Column:
    plain = F.lower(F.trim(name))
    return F.when(F.coalesce(plain, F.lit("")) == "", F.lit("UNSPECIFIED")).otherwise(
        F.concat(F.lit("inst_"), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), F.lit("pedigree"), plain), 256), 1, 8))
    )


def length_prefixed(*parts: Column) -> Column:
    """Each part as `length:part`, lengths in code points; null counts as empty, so the encoding is injective on texts."""
    told = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in told))


def length_prefixed_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "")


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 in UTC; the fraction is left out when it is zero."""
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(plain, F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO text, null if it is none; a text without zone counts as UTC (the session's zone)."""
    return F.try_to_timestamp(text)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex by its definition, two nested SHA-256 over padded keys; the key is known on the driver only."""
    import hashlib

    padded = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner, outer = (bytes(b ^ pad for b in padded) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def fingerprint16(*fields: Column) -> Column:
    """16 hex digits over the fields in the given order."""
    return F.substring(F.sha2(length_prefixed(*fields), 256), 1, 16)
