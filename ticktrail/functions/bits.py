"""Quality bits of a row and helpers for bitmaps held in BIGINT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 36 quality bits, the place in the list is the bit. Bit 63 is never used.
QUALITY_BITS = (
    "START_UNKNOWN", "RECOVERING", "SESSION_UNKNOWN", "SUBSCRIPTION_CHANGED", "VENDOR_SEQUENCE_GAP", "VENDOR_SEQUENCE_DUPLICATE",
    "VENDOR_SEQUENCE_CONFLICT", "EXCHANGE_SEQUENCE_GAP", "EXCHANGE_SEQUENCE_BACKWARD", "EXCHANGE_SEQUENCE_CONFLICT", "CALLBACK_REENTRY",
    "RAW_RECOVERED_APPEND_ONLY", "RAW_CORRUPTION", "DECODE_TRUNCATED", "DECODE_OFFSET_INVALID", "DECODE_TEXT_INVALID",
    "NONCANONICAL_EMPTY_OFFSET", "NULL_VALUE_PRESENT", "UNKNOWN_ENUM", "SCHEMA_UNKNOWN", "NON_INTEGRAL_MATCHED_QTY",
    "AMBIGUOUS_ORDER_REFERENCE", "SNAPSHOT_STALE", "SNAPSHOT_DEPTH_SHORT", "QUEUE_TRUNCATED_TO_50", "TICK_RECON_INVALID", "UNAUTHORIZED",
    "CONNECTION_SWITCHED", "CLOCK_UNSYNCED", "CLOCK_EPOCH_CHANGED", "SOURCE_DISCONNECTED", "INSTRUMENT_UNKNOWN", "QTY_UNIT_UNKNOWN",
    "DURABILITY_LAG", "MARKET_CLOSED", "NONDETERMINISTIC_LIVE_LATEST",
)
BIT = {name: 1 << i for i, name in enumerate(QUALITY_BITS)}


def flag(name: str, when: Column) -> Column:
    """The bit where ``when`` holds, else 0."""
    return F.when(when, F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")


def union(*flags: Column) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out.bitwiseOR(f)
    return out


def has(col: Column, name: str) -> Column:
    return col.bitwiseAND(F.lit(BIT[name])) != 0


def names(col: Column) -> Column:
    """The names of the bits set, lowest first."""
    pairs = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(n).alias("n")) for n, b in BIT.items()])
    return F.transform(F.filter(pairs, lambda x: col.bitwiseAND(x["b"]) != 0), lambda x: x["n"])


def masks_pass(validity: Column, required: int, quality: Column, forbidden: int) -> Column:
    """All required validity bits set and no forbidden quality bit."""
    return (validity.bitwiseAND(F.lit(required)) == required) & (quality.bitwiseAND(F.lit(forbidden)) == 0)


def log2_bucket(value: Column, buckets: int = 32) -> Column:
    """The place of value's highest bit, held to the last bucket; values up to 1 are bucket 0, null stays null."""
    return F.when(value <= 1, 0).when(value > 1, F.least(F.length(F.bin(value)) - 1, F.lit(buckets - 1)))
