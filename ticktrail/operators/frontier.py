"""Cursors of a log and whether they can be true: arithmetic that any writer and any reader must satisfy.

A frontier is a sample of two cursors in one segment, append and durable; each is an offset in the segment, a
position in the whole log and an ingress sequence. A cursor moves by whole records, or by a segment's
header, which carries no record. All rules are column expressions without a join or a shuffle; null counts as
a broken rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import div
from .ordered import prefix

#: Alignment of positions, bytes of a segment's header, least bytes of a record.
ALIGNMENT, SEGMENT_HEADER, RECORD_LEAST = 8, 4096, 112
#: Columns of a frontier sample.
FRONTIER = ("segment", "append_offset", "append_pos", "append_seq", "durable_offset", "durable_pos", "durable_seq")


def advance_plausible(pos: Column, seq: Column, later_pos: Column, later_seq: Column) -> Column:
    """That a cursor (pos, seq) can have become (later_pos, later_seq)."""
    moved, records = later_pos - pos, later_seq - seq
    header_only = moved % SEGMENT_HEADER == 0
    fits = records <= div(moved, RECORD_LEAST)
    step = F.when(moved == 0, records == 0).when(records == 0, header_only).otherwise(fits)
    aligned = (pos % ALIGNMENT == 0) & (later_pos % ALIGNMENT == 0)
    return F.coalesce(aligned & (moved >= 0) & (records >= 0) & step, F.lit(False))


def frontier_rules() -> dict[str, Column]:
    """What a frontier must satisfy, by name, over the columns of FRONTIER."""
    c = {n: F.col(n) for n in FRONTIER}
    base, waiting = c["append_pos"] - c["append_offset"], c["append_pos"] - c["durable_pos"]
    records = c["append_seq"] - c["durable_seq"]
    return {
        "segment_numbered": c["segment"] >= 1,
        "append_after_header": c["append_offset"] >= SEGMENT_HEADER,
        "durable_after_header": c["durable_offset"] >= SEGMENT_HEADER,
        "aligned": F.greatest(*[c[n] % ALIGNMENT for n in FRONTIER if n.endswith(("pos", "offset"))]) == 0,
        "append_not_before_segment": base >= 0,
        "durable_not_before_segment": c["durable_pos"] >= c["durable_offset"],
        "durable_not_ahead": (c["durable_offset"] <= c["append_offset"]) & (waiting >= 0) & (records >= 0),
        "one_segment_base": base == c["durable_pos"] - c["durable_offset"],
        "headers_before_base": base >= (c["segment"] - 1) * SEGMENT_HEADER,
        "first_segment_at_zero": (c["segment"] != 1) | (base == 0),
        "bytes_with_records": (waiting == 0) == (records == 0),
        "records_fit_bytes": records <= div(waiting, RECORD_LEAST),
    }


def frontier_faults() -> Column:
    """The names of the broken rules, in order; empty for a frontier that can be true."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in frontier_rules().items()]
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def frontier_valid() -> Column:
    out = F.lit(True)
    for ok in frontier_rules().values():
        out = out & ok
    return F.coalesce(out, F.lit(False))


def sampled(log: DataFrame, keys: list[str], segment: str, order: str, durable: Column) -> DataFrame:
    """A frontier at every record of a log: log has end_pos and start_pos without headers, and a segment's number from
    0. The durable cursor is the last record of the segment, itself included, where ``durable`` holds, else
    the segment's header."""
    d = prefix(log, keys, order, {"append_seq": ("sum", F.lit(1).cast("long"))})
    first = d.groupBy(*keys, segment).agg(F.min("start_pos").alias("__start"), (F.min("append_seq") - 1).alias("__before"))
    d = d.join(first, [*keys, segment])
    base = F.col("__start") + F.col(segment) * SEGMENT_HEADER
    d = d.withColumn("append_offset", F.col("end_pos") - F.col("__start") + SEGMENT_HEADER).withColumn("append_pos", base + F.col("append_offset"))
    d = prefix(d, [*keys, segment], order, {"__d": ("last", F.when(durable, F.struct("append_offset", "append_seq")))})
    offset = F.coalesce("__d.append_offset", F.lit(SEGMENT_HEADER).cast("long"))
    d = d.withColumn("durable_offset", offset).withColumn("durable_pos", base + F.col("durable_offset"))
    return d.withColumn("durable_seq", F.coalesce("__d.append_seq", "__before")).drop("__d", "__start", "__before")


def quiet() -> Column:
    """That a source was idle between two reads of its counters: nothing captured, appended or waiting from one to the
    other, and no callback under way in either. Null is not idle."""
    caught_up = (F.col("captured") == F.col("appended")) & (F.col("appended") == F.col("processed"))
    still = (F.col("captured_again") == F.col("captured")) & (F.col("appended_again") == F.col("appended"))
    return F.coalesce(caught_up & still & (F.col("inflight") == 0) & (F.col("inflight_again") == 0), F.lit(False))


def idle_frontiers(samples: DataFrame, source: str) -> DataFrame:
    """(source, idle_to): the latest now_ns at which a healthy source was proven idle, null if it never was. samples: source,
    now_ns, state and the columns of quiet()."""
    proof = quiet() & F.coalesce(F.col("state") == "HEALTHY", F.lit(False))
    return samples.groupBy(source).agg(F.max(F.when(proof, F.col("now_ns"))).alias("idle_to"))


def released(events: DataFrame, idle: DataFrame, source: str, at: str, required: Sequence) -> DataFrame:
    """The events that can go out in the order of one merged stream without a look ahead: every other required source
    has an event at that time or later, or is proven idle up to it. A required source of which nothing is
    known holds all others back. events: one clock epoch. The table of limits has a row for each source that is required."""
    spark, kind = events.sparkSession, events.schema[source].dataType.simpleString()
    need = spark.createDataFrame([(x,) for x in required], f"`{source}` {kind}")
    known = events.groupBy(source).agg(F.max(at).alias("__top"))
    bound = need.join(known, source, "left").join(idle, source, "left").select(source, F.greatest("__top", "idle_to").alias("__bound"))
    limits = bound.agg(F.collect_list(F.struct(source, F.col("__bound").alias("b"))).alias("__all"))
    others = lambda s: F.filter("__all", lambda x: x[source] != s)
    clear = F.forall(others(F.col(source)), lambda x: F.coalesce(x["b"] >= F.col(at), F.lit(False)))
    return events.crossJoin(F.broadcast(limits)).where(clear).drop("__all")  # one row
