"""Gates: whether a stream is ready, whether silence was allowed, what a monitor does next, what may be deleted.

Each gate computes its checks from a row's own columns and names the first that refuses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frontier import ALIGNMENT, advance_plausible, frontier_valid

PROOF_VERSION = 1


@dataclass(frozen=True)
class ReadinessConfig:
    """Bounds in bytes and nanoseconds; calendar_hash is that of the approved calendar, empty for none."""

    decoder_lag: int = 1 << 20
    durability_lag: int = 1 << 20
    heartbeat_timeout: int = 5_000_000_000
    calendar_hash: str = ""

    @property
    def valid(self) -> bool:
        return min(self.decoder_lag, self.durability_lag, self.heartbeat_timeout) > 0


def proof_valid(config: ReadinessConfig) -> Column:
    """A proof of silence (a struct ``proof``) holds for the row: its namespace, the approved calendar, and a window
    that holds the time it was evaluated at and now."""
    p, now = lambda n: F.col(f"proof.{n}"), F.col("now_realtime_ns")
    same = (p("version") == PROOF_VERSION) & (p("stream") == F.col("stream")) & (p("date") == F.col("date"))
    calendar = F.lit(bool(config.calendar_hash)) & (p("calendar_hash") == config.calendar_hash)
    window = (p("valid_from") > 0) & (p("evaluated") >= p("valid_from")) & (p("evaluated") < p("valid_until")) & (now >= p("evaluated")) & (now < p("valid_until"))
    return F.coalesce(same & calendar & window & p("silence_expected"), F.lit(False))


def _heartbeat(name: str, at: Column, now: Column, config: ReadinessConfig) -> list[tuple[str, Column]]:
    return [
        (f"{name}_HEARTBEAT_MISSING", at == 0), (f"{name}_HEARTBEAT_CLOCK_REGRESSION", now < at),
        (f"{name}_HEARTBEAT_TIMED_OUT", now - at > config.heartbeat_timeout),
    ]


def readiness_checks(config: ReadinessConfig) -> list[tuple[str, Column]]:
    """(reason, refuses) in the order in which they are checked. Columns: a frontier's; writer, expected_writer; stream,
    date, decoder_stream, decoder_date; processed_pos, processed_seq (the runtime's), record_end_pos and
    decoder_seq (the decoder's); fatal, capture_healthy, decoder_healthy, poisoned, control_ready,
    market_ready; writer_heartbeat, decoder_heartbeat, now_ns, now_realtime_ns; generation, generation_first,
    logon_generation, logon_seq; proof, a struct or null. A null cursor or heartbeat refuses."""
    c = F.col
    silent = ~c("market_ready")
    ahead = advance_plausible(c("processed_pos"), c("processed_seq"), c("append_pos"), c("append_seq"))
    behind = advance_plausible(c("append_pos"), c("append_seq"), c("processed_pos"), c("processed_seq"))
    writer_leads = (c("append_pos") > c("processed_pos")) | (c("append_seq") > c("processed_seq"))
    return [
        ("INVALID_CONFIG", F.lit(not config.valid) | (c("expected_writer") == 0)),
        ("WRITER_INSTANCE_MISMATCH", c("writer") != c("expected_writer")),
        ("NAMESPACE_MISMATCH", (c("stream") != c("decoder_stream")) | (c("date") != c("decoder_date"))),
        ("RAW_FRONTIER_INVALID", ~frontier_valid()),
        ("DECODER_CURSOR_INVALID", (c("processed_pos") % ALIGNMENT != 0) | (c("processed_pos") < c("record_end_pos")) | (c("processed_seq") != c("decoder_seq"))),
        ("WRITER_FATAL", c("fatal")),
        ("CAPTURE_PIPELINE_UNHEALTHY", ~c("capture_healthy")),
        *_heartbeat("WRITER", c("writer_heartbeat"), c("now_ns"), config),
        *_heartbeat("DECODER", c("decoder_heartbeat"), c("now_ns"), config),
        ("DECODER_UNHEALTHY", ~c("decoder_healthy")),
        ("LIVE_GENERATION_INVALID", (c("generation") == 0) | (c("generation_first") == 0) | (c("generation_first") > c("decoder_seq") + 1)),
        ("CURRENT_GENERATION_LOGON_MISSING", (c("logon_generation") != c("generation")) | (c("logon_seq") < c("generation_first")) | (c("logon_seq") > c("decoder_seq"))),
        ("CONTROL_POISONED", c("poisoned")),
        ("CONTROL_EVIDENCE_INCOMPLETE", ~c("control_ready")),
        ("MARKET_EVIDENCE_INCOMPLETE", silent & c("proof").isNull()),
        ("CALENDAR_PROOF_INVALID", silent & ~proof_valid(config)),
        ("DURABILITY_LAG_EXCEEDED", c("append_pos") - c("durable_pos") > config.durability_lag),
        # Samples aren't simultaneous: either side may lead, but only by an advance that can be true.
        ("DECODER_CURSOR_INVALID", ~(ahead | behind)),
        ("DECODER_LAG_EXCEEDED", writer_leads & (c("append_pos") - c("processed_pos") > config.decoder_lag)),
        ("DECODER_NOT_CAUGHT_UP", writer_leads),
    ]


def readiness_reason(config: ReadinessConfig) -> Column:
    """READY, or the first reason that refuses; a check that null leaves open refuses too."""
    out = None
    for reason, refuses in readiness_checks(config):
        refuses = F.coalesce(refuses, F.lit(True))
        out = F.when(refuses, reason) if out is None else out.when(refuses, reason)
    return out.otherwise("READY")


#: What a monitor does, in order of precedence.
MONITOR_ACTIONS = ("CLEAN_STOP", "FATAL", "LOST_AFTER_READY", "FAILED_BEFORE_READY", "READY", "READY_STATUS", "WAITING_STATUS", "WATCHDOG")


def monitor_actions() -> Column:
    """What a monitor does at a row, as an array: one terminal action, or the announcement of readiness, or any status and
    watchdog pulse that are due. Columns: stop, fatal, ready_sent, announced (the generation announced),
    current (the ready generation, 0 for none), failed_logons, failed_required (a mask), status_due, watchdog_due."""
    c = F.col
    lost = c("ready_sent") & (c("current") != c("announced"))
    failed = ~c("ready_sent") & ((c("failed_logons") > 0) | (c("failed_required") != 0))
    became = ~c("ready_sent") & (c("current") != 0)
    due = F.array(
        F.when(c("status_due"), F.when(c("ready_sent"), "READY_STATUS").otherwise("WAITING_STATUS")),
        F.when(c("ready_sent") & c("watchdog_due"), "WATCHDOG"),
    )
    one = lambda name: F.array(F.lit(name))
    return (
        F.when(c("stop"), one("CLEAN_STOP")).when(c("fatal"), one("FATAL")).when(lost, one("LOST_AFTER_READY"))
        .when(failed, one("FAILED_BEFORE_READY")).when(became, one("READY")).otherwise(F.filter(due, lambda x: x.isNotNull()))
    )


def retention_plan(segments: DataFrame, manifests: DataFrame, checkpoints: DataFrame, readers: DataFrame, replicas: DataFrame, now: int, keep: int, copies: int, approved: DataFrame) -> DataFrame:
    """Per segment the six conditions under which it may be deleted, and whether all hold; nothing is deleted.
    segments: stream, segment, last_ns, limit_pos. manifests: stream, segment, verified. checkpoints: stream, consumer,
    durable_pos. readers: stream, segment in use. replicas: stream, segment, place. approved: stream, segment."""
    on = ["stream", "segment"]
    proven = manifests.groupBy(*on).agg(F.bool_and("verified").alias("published"))
    behind = checkpoints.groupBy("stream").agg(F.min("durable_pos").alias("__least"))
    held = readers.select(*on).distinct().withColumn("__held", F.lit(True))
    places = replicas.groupBy(*on).agg(F.count_distinct("place").alias("__places"))
    yes = approved.select(*on).distinct().withColumn("__approved", F.lit(True))
    d = segments.join(proven, on, "left").join(behind, "stream", "left").join(held, on, "left").join(places, on, "left").join(yes, on, "left")
    false = F.lit(False)
    tests = {
        "expired": F.col("last_ns") <= F.lit(now - keep), "published": F.coalesce("published", false),
        "consumed": F.coalesce(F.col("__least") >= F.col("limit_pos"), false), "unreferenced": F.col("__held").isNull(),
        "replicated": F.coalesce(F.col("__places") >= copies, false), "approved": F.coalesce("__approved", false),
    }
    d = d.select(*on, *[t.alias(n) for n, t in tests.items()])
    every = F.lit(True)
    for n in tests:
        every = every & F.col(n)
    return d.withColumn("may_delete", every)
