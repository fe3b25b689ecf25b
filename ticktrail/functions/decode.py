"""Bounded reads from binary columns. Out of bounds is null with an error, never a wrong number."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def read_uint(data: Column, offset: int | Column, width: int) -> Column:
    """Little-endian unsigned integer of 1 to 8 bytes as DECIMAL(20,0); null if any byte is outside."""
    o = offset if isinstance(offset, Column) else F.lit(offset)
    part = F.substring(data, o + 1, F.lit(width))
    ok = (o >= 0) & (F.length(data) >= o + width)
    return F.when(ok, F.conv(_reversed_hex(part, width), 16, 10).cast("decimal(20,0)"))


def _reversed_hex(part: Column, width: int) -> Column:
    h = F.hex(part)
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(width - 1, -1, -1)])


def read_text(data: Column, offset: int, header: int = 0) -> Column:
    """struct(value binary, error string, empty_offset boolean) of a text whose 32-bit offset and length
    stand at ``offset``. Its place is counted from the start of the data and may not overlap the first
    ``header`` bytes. An empty text with an offset is accepted and flagged."""

    @F.pandas_udf("value binary, error string, empty_offset boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_at(None if b is None else bytes(b), offset, header) for b in s], columns=["value", "error", "empty_offset"])

    return run(data)


def text_at(data: bytes | None, offset: int, header: int) -> tuple[bytes | None, str | None, bool]:
    if data is None or len(data) < offset + 8:
        return None, "TRUNCATED", False
    at, n = int.from_bytes(data[offset : offset + 4], "little"), int.from_bytes(data[offset + 4 : offset + 8], "little")
    if n == 0:
        return b"", None, at != 0
    if at < max(header, offset + 8):
        return None, "OVERLAP", False
    return (data[at : at + n], None, False) if at + n <= len(data) else (None, "OUT_OF_BOUNDS", False)


def read_list(data: Column, offset: int, width: int, most: int, header: int = 0) -> Column:
    """struct(items array<binary>, error string) of a list of fixed-width items, at most ``most``."""

    @F.pandas_udf("items array<binary>, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([list_at(None if b is None else bytes(b), offset, width, most, header) for b in s], columns=["items", "error"])

    return run(data)


def list_at(data: bytes | None, offset: int, width: int, most: int, header: int) -> tuple[list[bytes] | None, str | None]:
    if data is None or len(data) < offset + 8:
        return None, "TRUNCATED"
    at, n = int.from_bytes(data[offset : offset + 4], "little"), int.from_bytes(data[offset + 4 : offset + 8], "little")
    if n > most:
        return None, "TOO_MANY"
    if n == 0:
        return [], None
    if at < max(header, offset + 8):
        return None, "OVERLAP"
    if at + n * width > len(data):
        return None, "OUT_OF_BOUNDS"
    return [data[at + i * width : at + (i + 1) * width] for i in range(n)], None
