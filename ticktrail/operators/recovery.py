"""Recovery: which prefix of a journal of durable markers holds, and what each segment has beyond it.

Nothing is repaired. A marker says that a segment is durable up to an offset. Markers are judged against their
segment and the marker before; the first that doesn't hold is fatal, except that an incomplete last marker, or a
last one whose checksum alone fails, is rolled back. Markers are few beside records, but a journal is
still cut into buckets (``ordered.previous``), so that none is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frontier import SEGMENT_HEADER
from .ordered import prefix, previous

#: Why a recovery stops. The first five, RESOURCE_EXHAUSTED and the journal's header are found by readers of files.
FATALS = (
    "NONE", "JOURNAL_BUFFER_MISSING", "JOURNAL_HEADER_TRUNCATED", "JOURNAL_HEADER_INVALID", "SEGMENT_BUFFER_MISSING", "SEGMENT_HEADER_TRUNCATED",
    "SEGMENT_HEADER_INVALID", "SEGMENT_ORDER_INVALID", "NAMESPACE_MISMATCH", "SEGMENT_MISSING", "UNEXPECTED_SEGMENT", "SEGMENT_BASE_MISMATCH",
    "JOURNAL_MARKER_CORRUPTION", "JOURNAL_CHAIN_VIOLATION", "JOURNAL_SEMANTIC_VIOLATION", "RAW_DURABLE_CORRUPTION", "SEALED_SEGMENT_HAS_TAIL",
    "RESOURCE_EXHAUSTED",
)
ROLLED_BACK = ("NONE", "PARTIAL_MARKER", "TERMINAL_CRC_INVALID_MARKER")


def judged_markers(markers: DataFrame, segments: DataFrame) -> DataFrame:
    """markers plus fatal (null where it holds), rolled_back and accepted.

    markers: stream, at (its ordinal), status (OK, PARTIAL, BAD_CRC or another damage), marker_stream, segment, offset,
    pos, seq, sealed. segments: stream, segment, base_pos, first_seq."""
    ends = markers.groupBy("stream").agg(F.max("at").alias("__last"))
    s = segments.select("stream", "segment", F.col("base_pos").alias("__base"), F.col("first_seq").alias("__first"))
    d = markers.join(s, ["stream", "segment"], "left").join(ends, "stream")
    d = previous(d, ["stream"], "at", ["segment", "offset", "pos", "seq", "sealed", "__base"]).withColumnRenamed("prev", "__p")
    c, p = F.col, lambda n: F.col(f"__p.{n}")
    last = c("at") == c("__last")
    rolled = F.when(last & (c("status") == "PARTIAL"), ROLLED_BACK[1]).when(last & (c("status") == "BAD_CRC"), ROLLED_BACK[2])
    opens = (c("offset") == SEGMENT_HEADER) & ~c("sealed")
    first_ok = opens & (c("segment") == 1) & (c("__base") == 0) & (c("__first") == 1) & (c("seq") == 0)
    here = (c("offset") == p("offset")) & (c("pos") == p("pos")) & (c("seq") == p("seq"))
    repeats = here & ((c("sealed") == p("sealed")) | c("sealed"))
    grows = ~p("sealed") & (c("offset") > p("offset")) & (c("pos") > p("pos")) & (c("seq") >= p("seq"))
    follows = (c("segment") == p("segment") + 1) & p("sealed") & opens & (c("seq") == p("seq"))
    joins = (c("__base") == p("__base") + p("offset")) & (c("__first") == p("seq") + 1)
    fatal = (
        F.when(c("status") != "OK", "JOURNAL_MARKER_CORRUPTION").when(c("marker_stream") != c("stream"), "NAMESPACE_MISMATCH")
        .when(c("__base").isNull(), "SEGMENT_MISSING").when(c("__base") + c("offset") != c("pos"), "JOURNAL_CHAIN_VIOLATION")
        .when(c("__p").isNull(), F.when(~first_ok, "JOURNAL_CHAIN_VIOLATION"))
        .when(c("segment") == p("segment"), F.when(~(repeats | grows), "JOURNAL_CHAIN_VIOLATION"))
        .when(~follows, "JOURNAL_CHAIN_VIOLATION").when(~joins, "SEGMENT_BASE_MISMATCH")
    )
    d = d.withColumn("rolled_back", rolled).withColumn("fatal", F.when(F.col("rolled_back").isNull(), fatal))
    holds = F.when(F.col("fatal").isNull() & F.col("rolled_back").isNull(), 1).otherwise(0)
    d = prefix(d, ["stream"], "at", {"__ok": ("min", holds)})
    return d.withColumn("accepted", F.col("__ok") == 1).drop("__base", "__first", "__last", "__p", "__ok")


def journal_prefix(judged: DataFrame) -> DataFrame:
    """Per stream: accepted markers, the last accepted ordinal, the first fatal and what was rolled back; after a fatal
    nothing is rolled back."""
    fatal = F.coalesce(F.min_by(F.when(F.col("fatal").isNotNull(), F.col("fatal")), F.when(F.col("fatal").isNotNull(), F.col("at"))), F.lit("NONE"))
    g = judged.groupBy("stream").agg(
        F.count_if("accepted").alias("accepted"), F.max(F.when(F.col("accepted"), F.col("at"))).alias("last_accepted"), fatal.alias("fatal"), F.max("rolled_back").alias("r")
    )
    rolled = F.when(F.col("fatal") == "NONE", F.coalesce("r", F.lit(ROLLED_BACK[0]))).otherwise(ROLLED_BACK[0])
    return g.select("stream", "accepted", "last_accepted", "fatal", rolled.alias("rolled_back"))


def segment_recovery(judged: DataFrame, scans: DataFrame) -> DataFrame:
    """Per segment with an accepted marker, or without one: durable_end, the append-only range, its tail and a fatal.

    scans: stream, segment, size, valid_end (offset after the last proven record), valid_seq (its sequence), durable_seq
    (of the last record that ends at or before the last accepted marker's offset), zero_tail, partial_tail."""
    top = F.max_by(F.struct("offset", "seq", "sealed"), "at")
    m = judged.where("accepted").groupBy("stream", "segment").agg(top.alias("m"))
    highest = m.groupBy("stream").agg(F.max("segment").alias("__high"))
    d = scans.join(m, ["stream", "segment"], "left").join(highest, "stream", "left")
    c, offset = F.col, F.col("m.offset")
    fatal = (
        F.when(c("m").isNull(), F.when(F.coalesce(c("segment") != c("__high") + 1, F.lit(True)) | ~c("zero_tail"), "UNEXPECTED_SEGMENT"))
        .when(c("valid_end") < offset, "RAW_DURABLE_CORRUPTION").when(c("durable_seq") != c("m.seq"), "JOURNAL_SEMANTIC_VIOLATION")
        .when(c("m.sealed") & (c("size") > offset), "SEALED_SEGMENT_HAS_TAIL")
    )
    tail = F.when(c("valid_end") >= c("size"), "CLEAN").when(c("zero_tail"), "ZERO_PREALLOCATION").when(c("partial_tail"), "PARTIAL_RECORD").otherwise("INVALID_RECORD")
    begin = F.coalesce(offset, F.lit(SEGMENT_HEADER).cast("long"))
    return d.select(
        "stream", "segment", begin.alias("durable_end"), F.greatest(begin, "valid_end").alias("append_only_end"), tail.alias("tail"),
        F.coalesce(c("m.sealed"), F.lit(False)).alias("sealed"), F.coalesce(fatal, F.lit("NONE")).alias("fatal"),
    )
