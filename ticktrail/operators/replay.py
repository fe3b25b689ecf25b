"""Selecting, ordering and auditing a log of records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import record_size
from .ordered import prefix, previous, scanned


def half_open(col: str, begin=None, end=None) -> Column:
    """begin <= col < end, either side open. A reversed range is refused."""
    if begin is not None and end is not None and begin > end:
        raise ValueError(f"{col}: range begins after its end")
    out = F.lit(True)
    if begin is not None:
        out = out & (F.col(col) >= F.lit(begin))
    return out & (F.col(col) < F.lit(end)) if end is not None else out


def replay_filter(df: DataFrame, selectors: dict[str, Iterable] | None = None, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """All selectors (an empty list is any value) and all half-open ranges hold. Plain predicates: pushed to scans."""
    for col, values in (selectors or {}).items():
        if values := sorted(set(values)):
            df = df.where(F.col(col).isin(values))
    for col, (begin, end) in (ranges or {}).items():
        df = df.where(half_open(col, begin, end))
    return df


def positions(df: DataFrame, keys: Sequence[str] = ("stream",), order: str = "seq", body: str = "body") -> DataFrame:
    """start_pos and end_pos of each record in its namespace's log."""
    out = prefix(df.withColumn("size", record_size(F.col(body))), keys, order, {"end_pos": ("sum", F.col("size"))})
    return out.withColumn("start_pos", F.col("end_pos") - F.col("size"))


def boundaries(df: DataFrame, keys: Sequence[str], order: str, epoch: str, clock: str) -> DataFrame:
    """Notices between neighbours that a filter left: another clock epoch, else a clock that ran back."""
    d = previous(df, keys, order, [order, epoch, clock])
    kind = F.when(F.col("prev").isNull(), None).when(F.col(epoch) != F.col(f"prev.{epoch}"), "CLOCK_EPOCH_BOUNDARY").when(F.col(clock) < F.col(f"prev.{clock}"), "MONOTONIC_REGRESSION")
    return d.withColumn("notice", kind).where("notice IS NOT NULL")


def provenance(df: DataFrame, frontier: DataFrame, on: str = "stream") -> DataFrame:
    """durable where the record ends at or before the frontier, append-only where it begins there or later;
    a record across it is an error."""
    d = df.join(F.broadcast(frontier), on)  # one row for each stream
    kind = F.when(F.col("end_pos") <= F.col("frontier"), "durable").when(F.col("start_pos") >= F.col("frontier"), "append_only").otherwise("straddling")
    return d.withColumn("provenance", kind)


def segments(df: DataFrame, keys: Sequence[str], segment: str, order: str = "seq") -> DataFrame:
    return df.groupBy(*keys, segment).agg(
        F.count("*").alias("records"), F.min(order).alias("first_seq"), F.max(order).alias("last_seq"), F.min("start_pos").alias("base_pos"),
        F.max("end_pos").alias("limit_pos"), F.min_by("recv_ns", order).alias("first_ns"), F.max_by("recv_ns", order).alias("last_ns"),
    )


def located(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, begin: str, end: str, take: Sequence[str], width: int = 1 << 20) -> DataFrame:
    """rows joined with the range [begin, end) of their keys that holds ``at``, and its columns ``take``; rows outside all
    ranges go. Ranges of one key don't overlap. Both sides are cut into cells of ``width`` and joined by equality, so a
    row meets the few ranges of its cell, never all of its key."""
    cell = lambda c: F.floor(c / width).cast("long")
    r = ranges.where(F.col(end) > F.col(begin)).select(*keys, *[F.col(c).alias(f"__{c}") for c in dict.fromkeys((begin, end, *take))])
    r = r.withColumn("__cell", F.explode(F.sequence(cell(F.col(f"__{begin}")), cell(F.col(f"__{end}") - 1))))
    d = rows.withColumn("__cell", cell(F.col(at))).join(r, [*keys, "__cell"])
    d = d.where((F.col(at) >= F.col(f"__{begin}")) & (F.col(at) < F.col(f"__{end}")))
    return d.select(*[F.col(c) for c in rows.columns], *[F.col(f"__{c}").alias(c) for c in take])


def contiguity_violations(segs: DataFrame, keys: Sequence[str], segment: str) -> DataFrame:
    """Segments (few, by their nature) that don't follow the one before, and why: the first reason that applies."""
    w = Window.partitionBy(*keys).orderBy(segment)
    prev = lambda c: F.lag(c).over(w)
    why = F.when(prev(segment).isNull(), None).when(F.col(segment) != prev(segment) + 1, "segment_gap").when(F.col("base_pos") != prev("limit_pos"), "base_gap").when(F.col("first_seq") <= prev("last_seq"), "ingress_gap")
    return segs.withColumn("violation", why).where("violation IS NOT NULL")


def sampled_index(df: DataFrame, keys: Sequence[str], order: str, records: int, size: int) -> DataFrame:
    """The first record of a group, then each that is ``records`` records or ``size`` bytes after the last
    sampled."""
    d = df.select(*keys, order, "start_pos")

    def step(rows, state):
        pos = rows["start_pos"].to_numpy()
        since, at = state or (records, int(pos[0]))  # records since the last sample, and where that was
        i, keep = 0, []
        while (i := max(0, min(i + records - since, int(np.searchsorted(pos, at + size))))) < len(pos):
            keep.append(i)
            since, at = 0, int(pos[i])
        passed = len(pos) - keep[-1] if keep else since + len(pos)
        return rows.iloc[keep], (passed, at)

    return scanned(d, keys, order, step, d.schema.simpleString()[7:-1])


def rotated(df: DataFrame, keys: Sequence[str], order: str, target: int) -> DataFrame:
    """segment_no: a new segment begins when a record would exceed ``target`` bytes in the current one; a record larger
    than that is a segment of its own."""
    d = df.select(*keys, order, "size")

    def step(rows, state):
        segment, used = state or (0, 0)
        ends, at, base = rows["size"].cumsum().to_numpy(), 0, -used  # base: where the current segment begins
        out = np.empty(len(ends), np.int64)
        while True:
            stop = int(np.searchsorted(ends, base + target, side="right"))
            if stop == at and not used:
                stop += 1
            out[at:stop] = segment
            if stop >= len(ends):
                return rows.assign(segment_no=out), (segment, int(ends[-1]) - base)
            segment, at, base, used = segment + 1, stop, int(ends[stop - 1]) if stop else 0, 0

    return scanned(d, keys, order, step, ", ".join(f"{c} {t}" for c, t in d.dtypes) + ", segment_no long")


def due_offsets(df: DataFrame, keys: Sequence[str], order: str, clock: str, num: int = 1, den: int = 1) -> DataFrame:
    """When a paced replay hands a record out: clock distance from the namespace's first record times den/num."""
    first = df.groupBy(*keys).agg(F.min_by(clock, order).alias("anchor"))
    return df.join(F.broadcast(first), list(keys)).withColumn("due_ns", F.greatest(F.lit(0).cast("long"), F.expr(f"(({clock} - anchor) * {den}) div {num}")))


def glob_regex(pattern: str) -> str:
    """* any run, ? one character, anchored."""
    import re

    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def subscribed(messages: DataFrame, rules: list[tuple[str, str | None]], key: str, identifier: str) -> DataFrame:
    """Messages that a rule (key, glob or None for all values) covers. Rules are kept by hand: a short predicate."""
    cond = F.lit(False)
    for k, pattern in rules:
        cond = cond | ((F.col(key) == k) & (F.lit(True) if pattern is None else F.rlike(F.col(identifier), F.lit(glob_regex(pattern)))))
    return messages.where(cond)


class RuleSet:
    """A subscription as edits leave it: key -> None (all values) or (field, values)."""

    def __init__(self):
        self.rules: dict[str, tuple[str, set[str]] | None] = {}

    def add_key(self, key: str):
        self.rules.setdefault(key, None)  # a filtered key is not widened
        return self

    def add_values(self, key: str, field: str, values: Iterable[str]):
        values = set(values)
        if not values:
            return self.add_key(key)
        now = self.rules.get(key)
        if now is None:
            self.rules[key] = (field, values)
        elif now[0] == field:
            now[1].update(values)
        return self

    def delete_key(self, key: str):
        self.rules.pop(key, None)
        return self

    def delete_values(self, key: str, field: str, values: Iterable[str]):
        now = self.rules.get(key)
        if now is not None and now[0] == field:
            now[1].difference_update(values)
            if not now[1]:
                del self.rules[key]
        return self

    def clear(self):
        self.rules.clear()
        return self

    def describe(self) -> str | None:
        import json

        if not self.rules:
            return None
        rows = [{"key": k} if v is None else {"key": k, "field": v[0], "values": sorted(v[1])} for k, v in sorted(self.rules.items())]
        return json.dumps(rows, separators=(",", ":"))
