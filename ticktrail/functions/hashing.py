"""Hashes that Spark lacks, as Arrow functions, and keyed stable draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers and increments of the splitmix generator, and the keys of ordinal and lane.
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
ORDINAL_KEY, LANE_KEY = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
CASTAGNOLI = 0x82F63B78


def splitmix(x) -> np.ndarray:
    x = np.atleast_1d(np.asarray(x, np.uint64)) + np.uint64(GAMMA)  # arrays wrap in silence
    for shift, by in ((30, MIX_A), (27, MIX_B)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def stable_draw(seed: int, ordinal, purpose: int, lane=0) -> np.ndarray:
    """A draw for each ordinal, or each lane, that no other purpose or lane shifts."""
    o = splitmix(np.asarray(ordinal, np.uint64) ^ np.uint64(ORDINAL_KEY))
    k = splitmix(np.asarray(lane, np.uint64) ^ np.uint64(LANE_KEY))
    return splitmix(np.uint64(seed) ^ np.uint64(purpose) ^ o ^ k)


def selected(ordinal: Column, seed: int, purpose: int, one_in: int) -> Column:
    """One in ``one_in`` ordinals, 0 none."""
    if not one_in:
        return F.lit(False)

    @F.pandas_udf("boolean")
    def draw(s: pd.Series) -> pd.Series:
        return pd.Series(stable_draw(seed, s.to_numpy().astype(np.uint64), purpose) % np.uint64(one_in) == 0)

    return draw(ordinal)


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1)
    return t


def crc32c_bytes(data: bytes, crc: int = 0) -> int:
    """CRC-32C of data, or of what ``crc`` is of with data after it."""
    table, crc = _LIST, crc ^ 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


_TABLE = _table()
_LIST = _TABLE.tolist()
FEW = 16  # values that are still going on; below it a loop over bytes is faster than steps of numpy


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value: all values step together, a byte of each at a time, longest first."""
    sizes = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat, at = np.frombuffer(b"".join(values), np.uint8), (np.cumsum(sizes) - sizes)[order]
    alive = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # values longer than k
    crc, steps = np.full(len(values), 0xFFFFFFFF, np.uint32), int((alive >= FEW).sum())
    for k in range(steps):
        n = alive[k]
        crc[:n] = _TABLE[(crc[:n] ^ flat[at[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes[order] > steps):
        crc[i] = crc32c_bytes(values[order[i]][steps:], int(crc[i]))
    out = np.empty(len(values), np.int64)
    out[order] = crc
    return out


def crc32c(col: Column) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        known = s[s.notna()]
        return pd.Series(crc32c_many([bytes(b) for b in known]), known.index, "Int64").reindex(s.index)

    return run(col)


def clock_epoch(host: Column, boot: Column, clock: Column) -> tuple[Column, Column]:
    """Digest of a clock's identity, by which epochs are compared, and its label: the first eight bytes in hex. Each field
    is framed by its length in bytes, so that no two identities run together; a null or empty field has no epoch."""
    parts = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(f)), 8, "0")), F.encode(f, "UTF-8")) for f in (host, boot, clock)]
    whole = (F.length(host) > 0) & (F.length(boot) > 0) & (F.length(clock) > 0)
    digest = F.when(whole, F.sha2(F.concat(F.encode(F.lit("clock-epoch"), "UTF-8"), F.unhex(F.lit("00")), *parts), 256))
    return digest, F.substring(digest, 1, 16)
