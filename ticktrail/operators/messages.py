"""Control messages from logical columns: connection events, logon responses, bodies, identifiers and paced sending.

A column that couldn't be read is null. A message with a fault gives its fault and no fields, so that a reader never
sees half of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .control import DISCONNECTED, FAILURE, SUCCESS
from .ordered import prefix

CONNECTING, CONNECT_ERROR = "CONNECTING", "CONNECT_ERROR"
MAX_SERVICES, MAX_MESSAGES = 4096, 1_000_000


def _digest(domain: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(domain + ":"), text), 256)


def connection_event(kind: Column, version: Column, address: Column, error_text: Column, supported: int) -> Column:
    """Struct of control_type, decode_error and the digests of the texts. All three kinds need an address, all but
    connecting a text of the error; an empty text is one, a null isn't."""
    known = F.coalesce(kind.isin(CONNECTING, CONNECT_ERROR, DISCONNECTED), F.lit(False))
    failed = kind != CONNECTING
    fault = (
        F.when(~known, "UNSUPPORTED_MESSAGE").when(~version.eqNullSafe(F.lit(supported)), "UNSUPPORTED_VERSION")
        .when(address.isNull() | (failed & error_text.isNull()), "UNREADABLE_TEXT")
    )
    good = fault.isNull()
    return F.struct(
        F.when(good, kind).alias("control_type"), fault.alias("decode_error"), F.when(good, _digest("address", address)).alias("address_sha256"),
        F.when(good & failed, _digest("error", error_text)).alias("error_text_sha256"),
    )


def statuses(services: Column) -> Column:
    """Sorted (service_id, service_version, message_id, status) of nested services; null if a list is missing."""
    flat = F.transform(services, lambda s: F.transform(s["messages"], lambda m: F.struct(s["service_id"], s["service_version"], m["message_id"].alias("message_id"), m["status"].alias("status"))))
    return F.array_sort(F.flatten(flat))


def logon_response(code: Column, services: Column) -> Column:
    """Struct of control_type, decode_error, entries and manifest_sha256 of a logon response; code 0 is success. Lists are
    bounded, and a key answered twice is a fault."""
    flat = statuses(services)
    keys = F.transform(flat, lambda x: F.struct(x["service_id"], x["service_version"], x["message_id"]))
    fault = (
        F.when(code.isNull(), "UNREADABLE_CODE").when(flat.isNull(), "UNREADABLE_LIST").when((F.size(services) > MAX_SERVICES) | (F.size(flat) > MAX_MESSAGES), "TOO_MANY_ENTRIES")
        .when(F.size(F.array_distinct(keys)) < F.size(flat), "DUPLICATE_KEY")
    )
    good = fault.isNull()
    line = lambda x: F.concat_ws(",", x["service_id"], x["service_version"], x["message_id"], x["status"])
    return F.struct(
        F.when(good, F.when(code == 0, SUCCESS).otherwise(FAILURE)).alias("control_type"), fault.alias("decode_error"),
        F.when(good, F.size(flat).cast("long")).alias("entries"), F.when(good, _digest("manifest", F.concat_ws(";", F.transform(flat, line)))).alias("manifest_sha256"),
    )


def body_valid(size: Column, minimum: int, ranges: Sequence[tuple[Column, Column, int]] = ()) -> Column:
    """A body has its fixed part, and each range (offset, count, bytes an item) that isn't empty lies behind that part and
    inside the body. Nulls and overflow are invalid."""
    ok = size >= minimum
    for offset, count, width in ranges:
        end = F.try_add(offset, F.try_multiply(count, F.lit(width).cast("long")))
        ok = ok & (count >= 0) & ((count == 0) | ((offset >= minimum) & (end <= size)))
    return F.coalesce(ok, F.lit(False))


def identifier(service: Column, security_id: Column, instrument_id: Column, cash: Sequence[int], derivative: Sequence[int]) -> Column:
    """The one field that names an instrument at this service; null elsewhere, so that no pattern matches there."""
    return F.when(service.isin(*cash), security_id).when(service.isin(*derivative), instrument_id)


def paced(df: DataFrame, keys: Sequence[str], order: str, clock: str, match: Column, interval: int) -> DataFrame:
    """The matching rows plus deadline: one each interval, counted from the clock of the first match after rows that
    don't match, so that a pause is followed by no burst. A null match doesn't match."""
    d = df.withColumn("__m", F.coalesce(match, F.lit(False)))
    d = prefix(d, keys, order, {"__was": ("last", F.col("__m")), "__n": ("sum", F.col("__m").cast("long"))}, inclusive=False)
    n = F.coalesce(F.col("__n"), F.lit(0).cast("long"))
    begins = F.col("__m") & ~F.coalesce("__was", F.lit(False))
    d = prefix(d, keys, order, {"__from": ("last", F.when(begins, F.struct(F.col(clock).alias("at"), n.alias("n"))))})
    due = F.col("__from.at") + (n - F.col("__from.n") + 1) * F.lit(interval).cast("long")
    return d.where("__m").withColumn("deadline", due).drop("__m", "__was", "__n", "__from")
