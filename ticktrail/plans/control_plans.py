"""Session control, readiness and recovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bits import BIT
from ..operators import control as C
from .base import query, raw, table
from .replay_plans import POS_SQL

CTL = """ctl AS (
  SELECT *, seq % 3 AS address, CASE WHEN kind = 'signup' AND qty % 5 = 0 THEN 'LOGON_FAILURE' WHEN kind = 'signup' THEN 'LOGON_SUCCESS'
    WHEN kind = 'error' AND price % 1000 = 777 THEN 'DECODE_ERROR' WHEN kind = 'error' THEN 'DISCONNECTED'
    WHEN kind = 'click' AND price % 10 = 0 THEN 'SUBSCRIPTION' END AS ctype FROM raw)"""
SES = CTL + """, s1 AS (SELECT *, max(CASE WHEN ctype = 'DECODE_ERROR' THEN 1 ELSE 0 END) OVER w = 1 AS poisoned FROM ctl WINDOW w AS (PARTITION BY stream ORDER BY seq)),
s2 AS (SELECT *, NOT poisoned AND coalesce(ctype = 'LOGON_SUCCESS', false) AS ok FROM s1),
s3 AS (SELECT *, last_value(CASE WHEN ok THEN address END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s2),
ses AS (SELECT *, CAST(sum(ok::INT) OVER w AS BIGINT) AS connection_epoch,
  coalesce(last_value(CASE WHEN ctype = 'DECODE_ERROR' THEN 0 WHEN poisoned THEN NULL WHEN ctype = 'LOGON_SUCCESS' THEN 1 WHEN ctype IN ('LOGON_FAILURE', 'DISCONNECTED') THEN 0 END IGNORE NULLS) OVER w = 1, false) AS logged_in,
  coalesce(last_value(CASE WHEN poisoned THEN NULL WHEN ctype = 'LOGON_SUCCESS' THEN 0 WHEN ctype = 'DISCONNECTED' THEN 1 END IGNORE NULLS) OVER w = 1, false) AS disconnected,
  coalesce(last_value(CASE WHEN ok THEN (before IS NOT NULL AND before <> address)::INT END IGNORE NULLS) OVER w = 1, false) AS switched
  FROM s3 WINDOW w AS (PARTITION BY stream ORDER BY seq))"""


def _control(spark, sf):
    kind = F.expr(CTL[CTL.index("CASE") : CTL.index("END") + 3])
    return raw(spark, sf).withColumn("address", F.expr("seq % 3")).withColumn("ctype", kind)


def _session(spark, sf, mask=None):
    return C.session(_control(spark, sf), mask=mask)


@query("session_attribution", SES + f""" SELECT seq, stream, connection_epoch, logged_in,
  CAST(CASE WHEN logged_in THEN 0 ELSE {BIT["SESSION_UNKNOWN"]} + CASE WHEN disconnected THEN {BIT["SOURCE_DISCONNECTED"]} ELSE 0 END END + CASE WHEN switched THEN {BIT["CONNECTION_SWITCHED"]} ELSE 0 END AS BIGINT) AS quality FROM ses""")
def _(spark, sf):
    return _session(spark, sf).select("seq", "stream", "connection_epoch", "logged_in", "quality")


@query("session_epochs", SES + """ SELECT stream, connection_epoch, count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq,
  count(*) FILTER (WHERE logged_in) AS logged_in_records FROM ses GROUP BY ALL""")
def _(spark, sf):
    return _session(spark, sf).groupBy("stream", "connection_epoch").agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_if("logged_in").alias("logged_in_records"))


@query("disconnect_windows", SES + " SELECT stream, disconnected, count(*) AS records FROM ses GROUP BY ALL")
def _(spark, sf):
    return _session(spark, sf).groupBy("stream", "disconnected").agg(F.count("*").alias("records"))


@query("connection_switched", SES + " SELECT stream, seq, address, before AS previous_address FROM ses WHERE ok AND before IS NOT NULL AND before <> address")
def _(spark, sf):
    from ..operators.ordered import prefix

    d = _session(spark, sf).withColumn("ok", ~F.col("poisoned") & F.coalesce(F.col("ctype") == C.SUCCESS, F.lit(False)))
    d = prefix(d, ["stream"], "seq", {"previous_address": ("last", F.when(F.col("ok"), F.col("address")))}, inclusive=False)
    return d.where("ok AND switched").select("stream", "seq", "address", "previous_address")


@query("sticky_poison", SES + " SELECT stream, count(*) FILTER (WHERE poisoned) AS poisoned_records, min(seq) FILTER (WHERE poisoned) AS from_seq FROM ses GROUP BY stream")
def _(spark, sf):
    return _session(spark, sf).groupBy("stream").agg(F.count_if("poisoned").alias("poisoned_records"), F.min(F.when(F.col("poisoned"), F.col("seq"))).alias("from_seq"))


@query("unauthorized_flag", CTL + f""" SELECT seq, stream, CAST(CASE WHEN last_value(CASE WHEN ctype = 'LOGON_FAILURE' AND price % 2 = 0 THEN 1 WHEN ctype = 'LOGON_SUCCESS' THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY stream ORDER BY seq) = 1 THEN {BIT["UNAUTHORIZED"]} ELSE 0 END AS BIGINT) AS flags FROM ctl""")
def _(spark, sf):
    from ..functions.bits import flag
    from ..operators.ordered import prefix

    e = F.expr("CASE WHEN ctype = 'LOGON_FAILURE' AND price % 2 = 0 THEN 1 WHEN ctype = 'LOGON_SUCCESS' THEN 0 END")
    return prefix(_control(spark, sf), ["stream"], "seq", {"u": ("last", e)}).select("seq", "stream", flag("UNAUTHORIZED", F.coalesce(F.col("u") == 1, F.lit(False))).alias("flags"))


SUB = SES + """, m1 AS (SELECT *, ok OR (NOT poisoned AND coalesce(ctype = 'SUBSCRIPTION', false) AND logged_in) AS adds FROM ses),
m2 AS (SELECT *, bit_or(CASE WHEN adds THEN 1 << CAST(qty % 6 AS INT) END) OVER (PARTITION BY stream, connection_epoch ORDER BY seq) AS m FROM m1),
m3 AS (SELECT *, CASE WHEN adds THEN m END AS now FROM m2),
m4 AS (SELECT *, last_value(now IGNORE NULLS) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM m3),
sub AS (SELECT *, CAST(sum((now IS NOT NULL AND now IS DISTINCT FROM was)::INT) OVER w AS BIGINT) AS subscription_epoch,
  last_value(now IGNORE NULLS) OVER w AS effective_mask, now IS NOT NULL AND now IS DISTINCT FROM was AND was IS NOT NULL AS subscription_changed
  FROM m4 WINDOW w AS (PARTITION BY stream ORDER BY seq))"""


@query("subscription_epochs", SUB + " SELECT seq, stream, subscription_epoch, CAST(effective_mask AS BIGINT) AS effective_mask, subscription_changed FROM sub")
def _(spark, sf):
    d = _session(spark, sf, F.expr("shiftleft(1L, int(qty % 6))"))
    return d.select("seq", "stream", "subscription_epoch", "effective_mask", "subscription_changed")


@query("first_seen_mask", SES + """, r AS (SELECT *, sum(CASE WHEN ctype IN ('LOGON_SUCCESS', 'LOGON_FAILURE') THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq) AS run FROM ses)
SELECT seq, stream, CAST(bit_or(CASE WHEN kind IN ('view', 'purchase') AND logged_in AND NOT poisoned THEN 1 << CAST(instrument_id % 8 AS INT) ELSE 0 END) OVER (PARTITION BY stream, run ORDER BY seq) AS BIGINT) AS seen_mask FROM r""")
def _(spark, sf):
    d = C.first_seen(_session(spark, sf), F.expr("shiftleft(1L, int(instrument_id % 8))"), F.col("kind").isin("view", "purchase"))
    return d.select("seq", "stream", "seen_mask")


@query("seen_and_effective", "SELECT stream, CAST(bit_or(1 << CAST(qty % 6 AS INT)) AS BIGINT) & CAST(bit_or(CASE WHEN kind = 'view' THEN 1 << CAST(qty % 6 AS INT) ELSE 0 END) AS BIGINT) AS both_mask FROM raw GROUP BY stream")
def _(spark, sf):
    bit = F.expr("shiftleft(1L, int(qty % 6))")
    return raw(spark, sf).groupBy("stream").agg(F.bit_or(bit).bitwiseAND(F.bit_or(F.when(F.col("kind") == "view", bit).otherwise(F.lit(0).cast("long")))).alias("both_mask"))


@query("decoder_counters", CTL + """ SELECT stream, count(*) AS processed, count(ctype) AS emitted, count(*) FILTER (WHERE ctype = 'LOGON_SUCCESS') AS logon_ok, count(*) FILTER (WHERE ctype = 'LOGON_FAILURE') AS logon_failed,
  count(*) FILTER (WHERE ctype = 'DISCONNECTED') AS disconnects, count(*) FILTER (WHERE ctype = 'SUBSCRIPTION') AS responses, count(*) FILTER (WHERE ctype = 'DECODE_ERROR') AS errors FROM ctl GROUP BY stream""")
def _(spark, sf):
    n = lambda t: F.count_if(F.col("ctype") == t)
    return _control(spark, sf).groupBy("stream").agg(F.count("*").alias("processed"), F.count("ctype").alias("emitted"), n(C.SUCCESS).alias("logon_ok"), n(C.FAILURE).alias("logon_failed"), n(C.DISCONNECTED).alias("disconnects"), n(C.SUBSCRIPTION).alias("responses"), n(C.DECODE_ERROR).alias("errors"))


@query("status_tallies", """SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'required' ELSE 'optional' END AS policy, count(*) FILTER (WHERE s_acctbal >= 0) AS ok, count(*) FILTER (WHERE s_acctbal < 0) AS failed
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""", with_raw=False)
def _(spark, sf):
    d = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, "required").otherwise("optional").alias("policy")).agg(F.count_if(F.col("s_acctbal") >= 0).alias("ok"), F.count_if(F.col("s_acctbal") < 0).alias("failed"))


@query("success_masks", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) SELECT n_regionkey, CAST(bit_or(1::BIGINT << i) AS BIGINT) AS effective_mask, CAST(bit_or(CASE WHEN n_nationkey % 2 = 0 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS required_mask FROM k GROUP BY n_regionkey", with_raw=False)
def _(spark, sf):
    d = table(spark, sf, "nation").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") % 2 == 0).alias("required"))
    return C.key_masks(d, ["n_regionkey"], "n_nationkey", {"effective_mask": F.lit(True), "required_mask": F.col("required")})


@query("missing_required", "SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", with_raw=False)
def _(spark, sf):
    have = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf, "nation").select("n_nationkey").exceptAll(have.distinct())


@query("key_policies", "SELECT n_nationkey, max(policy) AS policy FROM (SELECT n_nationkey, 'required' AS policy FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_nationkey, 'optional' FROM nation WHERE n_regionkey > 1) GROUP BY n_nationkey", with_raw=False)
def _(spark, sf):
    n = table(spark, sf, "nation")
    both = n.where("n_regionkey < 3").select("n_nationkey", F.lit("required").alias("policy")).unionByName(n.where("n_regionkey > 1").select("n_nationkey", F.lit("optional").alias("policy")))
    return both.groupBy("n_nationkey").agg(F.max("policy").alias("policy"))


FRONT = POS_SQL + """, n1 AS (SELECT *, seq // 1000 AS seg, row_number() OVER (PARTITION BY stream ORDER BY seq) AS append_seq FROM placed),
n2 AS (SELECT *, min(start_pos) OVER (PARTITION BY stream, seg) AS st, min(append_seq) OVER (PARTITION BY stream, seg) - 1 AS bf FROM n1),
n3 AS (SELECT *, seg + 1 AS segment, end_pos - st + 4096 AS append_offset, st + seg * 4096 + end_pos - st + 4096 AS append_pos FROM n2),
n4 AS (SELECT *, last_value(CASE WHEN seq % 16 = 0 THEN append_offset END IGNORE NULLS) OVER w AS d_off, last_value(CASE WHEN seq % 16 = 0 THEN append_seq END IGNORE NULLS) OVER w AS d_seq FROM n3 WINDOW w AS (PARTITION BY stream, seg ORDER BY seq)),
n5 AS (SELECT *, coalesce(d_off, 4096) AS durable_offset, st + seg * 4096 + coalesce(d_off, 4096) AS durable_pos, coalesce(d_seq, bf) AS durable_seq FROM n4),
fr AS (SELECT stream, seq, kind, price, qty, recv_ns, instrument_id, CASE WHEN seq % 53 = 3 THEN 0 ELSE segment END AS segment, append_offset + CASE WHEN price % 41 = 7 THEN 4 ELSE 0 END AS append_offset,
  append_pos + CASE WHEN price % 43 = 8 THEN 8 ELSE 0 END AS append_pos, append_seq, durable_offset, durable_pos, durable_seq + CASE WHEN price % 47 = 9 THEN 30 ELSE 0 END AS durable_seq FROM n5)"""
VALID = """segment >= 1 AND append_offset >= 4096 AND durable_offset >= 4096 AND append_offset % 8 = 0 AND append_pos % 8 = 0 AND durable_offset % 8 = 0 AND durable_pos % 8 = 0
  AND append_pos >= append_offset AND durable_pos >= durable_offset AND durable_offset <= append_offset AND durable_pos <= append_pos AND durable_seq <= append_seq
  AND append_pos - append_offset = durable_pos - durable_offset AND append_pos - append_offset >= (segment - 1) * 4096 AND (segment <> 1 OR append_pos = append_offset)
  AND (append_pos = durable_pos) = (append_seq = durable_seq) AND append_seq - durable_seq <= (append_pos - durable_pos) // 112"""


def _frontier(spark, sf):
    """A frontier at every record, some of them damaged."""
    from ..operators.frontier import sampled
    from ..operators.replay import positions

    d = sampled(positions(raw(spark, sf)).withColumn("seg", F.expr("seq div 1000")), ["stream"], "seg", "seq", F.col("seq") % 16 == 0)
    hit = lambda m, r, by: F.when(F.col("price") % m == r, by).otherwise(0)
    return d.withColumn("segment", F.when(F.col("seq") % 53 == 3, 0).otherwise(F.col("seg") + 1)).withColumns({
        "append_offset": F.col("append_offset") + hit(41, 7, 4), "append_pos": F.col("append_pos") + hit(43, 8, 8), "durable_seq": F.col("durable_seq") + hit(47, 9, 30),
    })


@query("frontier_shape", FRONT + f" SELECT seq, stream, {VALID} AS valid, segment < 1 AS unnumbered FROM fr")
def _(spark, sf):
    from ..operators.frontier import frontier_faults, frontier_valid

    d = _frontier(spark, sf).withColumn("faults", frontier_faults())
    return d.select("seq", "stream", frontier_valid().alias("valid"), F.array_contains("faults", "segment_numbered").alias("unnumbered"))


@query("cursor_advance", FRONT + """, p AS (SELECT *, lag(append_pos) OVER w AS pp, lag(append_seq) OVER w AS ps FROM fr WINDOW w AS (PARTITION BY stream ORDER BY seq))
SELECT seq, stream, pp % 8 = 0 AND append_pos % 8 = 0 AND append_pos >= pp AND append_seq >= ps AND CASE WHEN append_pos = pp THEN append_seq = ps WHEN append_seq = ps THEN (append_pos - pp) % 4096 = 0 ELSE append_seq - ps <= (append_pos - pp) // 112 END AS plausible FROM p WHERE pp IS NOT NULL""")
def _(spark, sf):
    from ..operators.frontier import advance_plausible
    from ..operators.ordered import previous

    d = previous(_frontier(spark, sf), ["stream"], "seq", ["append_pos", "append_seq"]).where("prev IS NOT NULL")
    return d.select("seq", "stream", advance_plausible(F.col("prev.append_pos"), F.col("prev.append_seq"), F.col("append_pos"), F.col("append_seq")).alias("plausible"))


#: Inputs of the readiness gate at every record: the decoder's state and the runtime's, made from the record.
GATE = """seq AS decoder_key, stream AS decoder_date, stream + CAST(price % 37 = 2 AS BIGINT) AS decoder_stream, stream AS date, stream + 1 AS writer, stream + 1 + CAST(price % 41 = 1 AS BIGINT) AS expected_writer,
CASE WHEN qty % 4 = 0 THEN durable_pos ELSE append_pos END + CASE WHEN seq % 59 = 4 THEN 4 WHEN seq % 61 = 4 THEN 8 ELSE 0 END AS processed_pos, CASE WHEN qty % 4 = 0 THEN durable_seq ELSE append_seq END AS processed_seq,
durable_pos AS record_end_pos, CASE WHEN qty % 4 = 0 THEN durable_seq ELSE append_seq END + CAST(seq % 67 = 5 AS BIGINT) AS decoder_seq,
kind = 'error' AND qty % 7 = 0 AS fatal, price % 29 <> 5 AS capture_healthy, qty % 23 <> 9 AS decoder_healthy, kind = 'error' AND price % 11 = 0 AS poisoned, NOT (kind = 'signup' AND qty % 3 = 0) AS control_ready, kind <> 'view' AS market_ready,
CASE WHEN price % 31 = 6 THEN 0 WHEN price % 31 = 7 THEN recv_ns + 1 ELSE recv_ns - price * 1000000 END AS writer_heartbeat, CASE WHEN qty % 43 = 7 THEN 0 WHEN qty % 41 = 8 THEN recv_ns + 1 ELSE recv_ns - qty * 80000000 END AS decoder_heartbeat,
recv_ns AS now_ns, recv_ns AS now_realtime_ns, CAST(seq % 31 <> 10 AS BIGINT) AS generation, 1 AS generation_first, CAST(seq % 29 <> 11 AS BIGINT) AS logon_generation, 1 + CAST(append_seq < 3 AS BIGINT) * 5 AS logon_seq"""
PROOF = """CASE WHEN instrument_id % 3 > 0 THEN 1 END AS version, stream AS p_stream, stream + CAST(instrument_id % 19 = 1 AS BIGINT) AS p_date, CASE WHEN qty % 13 = 1 THEN 'other' ELSE 'approved' END AS calendar_hash,
recv_ns - 5000 AS valid_from, recv_ns + CASE WHEN qty % 17 = 3 THEN 0 ELSE 5000 END AS valid_until, recv_ns - 100 AS evaluated, price % 23 <> 1 AS silence_expected"""
REASON = f"""CASE WHEN expected_writer = 0 THEN 'INVALID_CONFIG' WHEN writer <> expected_writer THEN 'WRITER_INSTANCE_MISMATCH' WHEN stream <> decoder_stream OR date <> decoder_date THEN 'NAMESPACE_MISMATCH' WHEN NOT ({VALID}) THEN 'RAW_FRONTIER_INVALID'
WHEN processed_pos % 8 <> 0 OR processed_pos < record_end_pos OR processed_seq <> decoder_seq THEN 'DECODER_CURSOR_INVALID' WHEN fatal THEN 'WRITER_FATAL' WHEN NOT capture_healthy THEN 'CAPTURE_PIPELINE_UNHEALTHY'
WHEN writer_heartbeat = 0 THEN 'WRITER_HEARTBEAT_MISSING' WHEN now_ns < writer_heartbeat THEN 'WRITER_HEARTBEAT_CLOCK_REGRESSION' WHEN now_ns - writer_heartbeat > 5000000000 THEN 'WRITER_HEARTBEAT_TIMED_OUT'
WHEN decoder_heartbeat = 0 THEN 'DECODER_HEARTBEAT_MISSING' WHEN now_ns < decoder_heartbeat THEN 'DECODER_HEARTBEAT_CLOCK_REGRESSION' WHEN now_ns - decoder_heartbeat > 5000000000 THEN 'DECODER_HEARTBEAT_TIMED_OUT'
WHEN NOT decoder_healthy THEN 'DECODER_UNHEALTHY' WHEN generation = 0 OR generation_first = 0 OR generation_first > decoder_seq + 1 THEN 'LIVE_GENERATION_INVALID'
WHEN logon_generation <> generation OR logon_seq < generation_first OR logon_seq > decoder_seq THEN 'CURRENT_GENERATION_LOGON_MISSING' WHEN poisoned THEN 'CONTROL_POISONED' WHEN NOT control_ready THEN 'CONTROL_EVIDENCE_INCOMPLETE'
WHEN NOT market_ready AND version IS NULL THEN 'MARKET_EVIDENCE_INCOMPLETE'
WHEN NOT market_ready AND NOT (p_stream = stream AND p_date = date AND calendar_hash = 'approved' AND valid_from > 0 AND evaluated >= valid_from AND evaluated < valid_until AND now_realtime_ns >= evaluated AND now_realtime_ns < valid_until AND silence_expected) THEN 'CALENDAR_PROOF_INVALID'
WHEN append_pos - durable_pos > 900 THEN 'DURABILITY_LAG_EXCEEDED'
WHEN NOT ((processed_pos = append_pos AND processed_seq = append_seq) OR (processed_pos < append_pos AND processed_seq < append_seq AND append_seq - processed_seq <= (append_pos - processed_pos) // 112) OR (processed_seq = append_seq AND (append_pos - processed_pos) % 4096 = 0)) THEN 'DECODER_CURSOR_INVALID'
WHEN append_pos > processed_pos OR append_seq > processed_seq THEN CASE WHEN append_pos - processed_pos > 500 THEN 'DECODER_LAG_EXCEEDED' ELSE 'DECODER_NOT_CAUGHT_UP' END ELSE 'READY' END"""


@query("readiness_reason", FRONT + f", gate AS (SELECT *, {GATE}, {PROOF} FROM fr) SELECT seq, stream, {REASON} AS reason FROM gate")
def _(spark, sf):
    from ..operators.gates import ReadinessConfig, readiness_reason

    d = _frontier(spark, sf).selectExpr("*", *_columns(GATE), *_columns(PROOF))
    proof = F.struct("version", F.col("p_stream").alias("stream"), F.col("p_date").alias("date"), "calendar_hash", "valid_from", "valid_until", "evaluated", "silence_expected")
    d = d.withColumn("proof", F.when(F.col("version").isNotNull(), proof))
    return d.select("seq", "stream", readiness_reason(ReadinessConfig(500, 900, 5_000_000_000, "approved")).alias("reason"))


def _columns(text: str) -> list[str]:
    """The expressions of a select list; commas inside none of them."""
    return [x.strip() for x in text.replace("\n", " ").split(", ")] if ",\n" not in text else [x.strip() for part in text.split(",\n") for x in part.split(", ")]


@query("lag_metrics", POS_SQL + ", t AS (SELECT stream, max(end_pos) AS append_pos, max(end_pos) FILTER (WHERE seq % 16 = 0) AS durable_pos, max(end_pos) FILTER (WHERE seq % 64 = 0) AS processed_pos FROM placed GROUP BY stream) SELECT stream, append_pos - durable_pos AS durability_lag, append_pos - processed_pos AS decoder_lag FROM t")
def _(spark, sf):
    from ..operators.replay import positions

    top = lambda n: F.max(F.when(F.col("seq") % n == 0, F.col("end_pos")))
    return positions(raw(spark, sf)).groupBy("stream").agg((F.max("end_pos") - top(16)).alias("durability_lag"), (F.max("end_pos") - top(64)).alias("decoder_lag"))


@query("resubscribe_guard", "SELECT seq, CASE WHEN qty % 3 = 0 THEN 'NOT_LOGGED_IN' WHEN kind = 'purchase' THEN 'INSIDE_TRADING' WHEN price % 4 = 1 THEN 'AUDIT_HASH_MISMATCH' ELSE 'ALLOWED' END AS verdict FROM raw")
def _(spark, sf):
    return raw(spark, sf).select("seq", C.resubscribe_verdict(F.expr("qty % 3 <> 0"), F.col("kind") == "purchase", F.expr("price % 4 <> 1")).alias("verdict"))


@query("calendar_exception", "SELECT seq, coalesce(p.reason, 'MARKET_EVIDENCE') AS evidence FROM raw LEFT JOIN (SELECT DISTINCT stream, CAST(ts AS DATE) AS d, 'CALENDAR_PROOF' AS reason FROM raw WHERE kind = 'signup') p ON raw.stream = p.stream AND CAST(raw.ts AS DATE) = p.d")
def _(spark, sf):
    d = raw(spark, sf).withColumn("d", F.to_date("ts"))
    proof = d.where("kind = 'signup'").select("stream", "d").distinct().withColumn("reason", F.lit("CALENDAR_PROOF"))
    return d.join(proof, ["stream", "d"], "left").select("seq", F.coalesce("reason", F.lit("MARKET_EVIDENCE")).alias("evidence"))


JOURNAL = POS_SQL + """, g1 AS (SELECT *, seq // 1000 + 1 AS segment, row_number() OVER (PARTITION BY stream ORDER BY seq) AS rn FROM placed),
sg AS (SELECT stream, segment, min(start_pos) AS st, max(end_pos) AS en, min(rn) AS first_seq, max(rn) AS last_seq, min(start_pos) + (segment - 1) * 4096 AS base_pos FROM g1 GROUP BY stream, segment),
mk AS (SELECT stream, segment, 4096 AS offs, base_pos + 4096 AS pos, first_seq - 1 AS sq, false AS sealed, first_seq * 4 - 2 AS k, 0 AS price FROM sg
  UNION ALL SELECT g1.stream, g1.segment, end_pos - st + 4096, base_pos + end_pos - st + 4096, rn, false, rn * 4, price FROM g1 JOIN sg ON g1.stream = sg.stream AND g1.segment = sg.segment WHERE seq % 20 = 0
  UNION ALL SELECT stream, segment, en - st + 4096, base_pos + en - st + 4096, last_seq, true, last_seq * 4 + 1, 0 FROM sg),
m1 AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY k) AS ord, count(*) OVER (PARTITION BY stream) AS total FROM mk),
m2 AS (SELECT stream, segment, CASE WHEN stream = 1 AND ord > total / 2 AND price % 7 = 3 THEN offs + 8 ELSE offs END AS offs, pos, sq, sealed, ord, total, price,
  CASE WHEN stream = 2 AND ord > total / 3 AND price % 11 = 5 THEN 'BAD_CRC' WHEN stream = 3 AND ord = total THEN 'BAD_CRC' ELSE 'OK' END AS status FROM m1)"""


@query("journal_prefix", JOURNAL + """, m3 AS (SELECT m2.*, base_pos, first_seq, lag(m2.segment) OVER w AS p_seg, lag(offs) OVER w AS p_off, lag(pos) OVER w AS p_pos, lag(sq) OVER w AS p_sq, lag(sealed) OVER w AS p_sealed, lag(base_pos) OVER w AS p_base
  FROM m2 LEFT JOIN sg ON m2.stream = sg.stream AND m2.segment = sg.segment WINDOW w AS (PARTITION BY m2.stream ORDER BY ord)),
m4 AS (SELECT *, CASE WHEN ord = total AND status = 'BAD_CRC' THEN 'TERMINAL_CRC_INVALID_MARKER' END AS rb, CASE WHEN ord = total AND status = 'BAD_CRC' THEN NULL WHEN status <> 'OK' THEN 'JOURNAL_MARKER_CORRUPTION' WHEN base_pos + offs <> pos THEN 'JOURNAL_CHAIN_VIOLATION'
  WHEN p_seg IS NULL THEN CASE WHEN NOT (segment = 1 AND base_pos = 0 AND first_seq = 1 AND offs = 4096 AND sq = 0 AND NOT sealed) THEN 'JOURNAL_CHAIN_VIOLATION' END
  WHEN segment = p_seg THEN CASE WHEN NOT ((offs = p_off AND pos = p_pos AND sq = p_sq AND (sealed = p_sealed OR sealed)) OR (NOT p_sealed AND offs > p_off AND pos > p_pos AND sq >= p_sq)) THEN 'JOURNAL_CHAIN_VIOLATION' END
  WHEN NOT (segment = p_seg + 1 AND p_sealed AND offs = 4096 AND NOT sealed AND sq = p_sq) THEN 'JOURNAL_CHAIN_VIOLATION' WHEN base_pos <> p_base + p_off OR first_seq <> p_sq + 1 THEN 'SEGMENT_BASE_MISMATCH' END AS fatal FROM m3),
m5 AS (SELECT *, min((fatal IS NULL AND rb IS NULL)::INT) OVER (PARTITION BY stream ORDER BY ord) = 1 AS accepted FROM m4),
m6 AS (SELECT stream, count(*) FILTER (WHERE accepted) AS accepted, max(ord) FILTER (WHERE accepted) AS last_accepted, coalesce(arg_min(fatal, ord) FILTER (WHERE fatal IS NOT NULL), 'NONE') AS fatal, max(rb) AS rb FROM m5 GROUP BY stream)
SELECT stream, accepted, last_accepted, fatal, CASE WHEN fatal = 'NONE' THEN coalesce(rb, 'NONE') ELSE 'NONE' END AS rolled_back FROM m6""")
def _(spark, sf):
    from ..operators import recovery as V

    markers, segs, _ = _journal(spark, sf)
    return V.journal_prefix(V.judged_markers(markers, segs))


def _journal(spark, sf):
    """A journal over the log's segments: a marker where a segment opens, at every twentieth record and where it is sealed; some are damaged."""
    from ..operators.frontier import SEGMENT_HEADER
    from ..operators.lineage import cut
    from ..operators.ordered import prefix
    from ..operators.replay import positions

    one = F.lit(1).cast("long")
    d = cut(prefix(positions(raw(spark, sf)), ["stream"], "seq", {"rn": ("sum", one)}).withColumn("segment", F.expr("seq div 1000 + 1")), "log")
    segs = d.groupBy("stream", "segment").agg(F.min("start_pos").alias("st"), F.max("end_pos").alias("en"), F.min("rn").alias("first_seq"), F.max("rn").alias("last_seq"))
    segs = segs.withColumn("base_pos", F.col("st") + (F.col("segment") - 1) * SEGMENT_HEADER)
    at = lambda df, end, seq, sealed, k, price: df.select("stream", "segment", (end - F.col("st") + SEGMENT_HEADER).alias("offset"), (F.col("base_pos") + end - F.col("st") + SEGMENT_HEADER).alias("pos"), seq.alias("seq"), F.lit(sealed).alias("sealed"), k.alias("k"), price.cast("long").alias("price"))
    c, zero = F.col, F.lit(0)
    opened = at(segs, c("st"), c("first_seq") - 1, False, c("first_seq") * 4 - 2, zero)
    between = at(d.where("seq % 20 = 0").drop("start_pos").join(segs, ["stream", "segment"]), c("end_pos"), c("rn"), False, c("rn") * 4, c("price"))
    sealed = at(segs, c("en"), c("last_seq"), True, c("last_seq") * 4 + 1, zero)
    m = prefix(opened.unionByName(between).unionByName(sealed), ["stream"], "k", {"at": ("sum", one)})
    m = m.join(m.groupBy("stream").agg(F.max("at").alias("last")), "stream").withColumn("marker_stream", c("stream"))
    moved = (c("stream") == 1) & (c("at") > c("last") / 2) & (c("price") % 7 == 3)
    bad = ((c("stream") == 2) & (c("at") > c("last") / 3) & (c("price") % 11 == 5)) | ((c("stream") == 3) & (c("at") == c("last")))
    m = m.withColumn("offset", F.when(moved, c("offset") + 8).otherwise(c("offset"))).withColumn("status", F.when(bad, "BAD_CRC").otherwise("OK"))
    return cut(m.drop("last", "k", "price"), "markers"), segs, d


@query("recovery_classes", JOURNAL + """, ok AS (SELECT stream, min(ord) FILTER (WHERE status <> 'OK' OR base_pos + offs <> pos) AS stop FROM m2 JOIN sg USING (stream, segment) GROUP BY stream),
am AS (SELECT m2.stream, segment, max(ord) AS ord FROM m2 JOIN ok USING (stream) WHERE stop IS NULL OR ord < stop GROUP BY ALL), hi AS (SELECT stream, max(segment) AS high FROM am GROUP BY 1),
tp AS (SELECT m2.stream, m2.segment, offs, sq, sealed FROM m2 JOIN am USING (stream, segment, ord)),
sc AS (SELECT stream, segment, en - st + 4096 AS valid_end, CASE WHEN segment % 4 = 0 THEN en - st + 4096 + 64 ELSE en - st + 4096 END AS size, segment % 8 = 0 AS zero_tail, segment % 3 = 0 AS partial_tail FROM sg),
ds AS (SELECT g1.stream, g1.segment, max(rn) AS durable_seq FROM g1 JOIN sg USING (stream, segment) JOIN tp USING (stream, segment) WHERE end_pos - sg.st + 4096 <= offs GROUP BY ALL)
SELECT sc.stream, sc.segment, coalesce(offs, 4096) AS durable_end, greatest(coalesce(offs, 4096), valid_end) AS append_only_end, CASE WHEN valid_end >= size THEN 'CLEAN' WHEN zero_tail THEN 'ZERO_PREALLOCATION' WHEN partial_tail THEN 'PARTIAL_RECORD' ELSE 'INVALID_RECORD' END AS tail,
  coalesce(sealed, false) AS sealed, CASE WHEN offs IS NULL THEN CASE WHEN coalesce(sc.segment <> high + 1, true) OR NOT zero_tail THEN 'UNEXPECTED_SEGMENT' ELSE 'NONE' END WHEN valid_end < offs THEN 'RAW_DURABLE_CORRUPTION' WHEN coalesce(durable_seq, first_seq - 1) <> sq THEN 'JOURNAL_SEMANTIC_VIOLATION'
    WHEN sealed AND size > offs THEN 'SEALED_SEGMENT_HAS_TAIL' ELSE 'NONE' END AS fatal
FROM sc JOIN sg USING (stream, segment) LEFT JOIN tp USING (stream, segment) LEFT JOIN hi ON sc.stream = hi.stream LEFT JOIN ds ON sc.stream = ds.stream AND sc.segment = ds.segment""")
def _(spark, sf):
    from ..operators import recovery as V
    from ..operators.frontier import SEGMENT_HEADER
    from ..operators.lineage import cut

    markers, segs, d = _journal(spark, sf)
    judged = cut(V.judged_markers(markers, segs), "judged")
    top = judged.where("accepted").groupBy("stream", "segment").agg(F.max("offset").alias("offset"))
    inside = d.select("stream", "segment", "end_pos", "rn").join(segs, ["stream", "segment"]).join(top, ["stream", "segment"]).where(F.col("end_pos") - F.col("st") + SEGMENT_HEADER <= F.col("offset"))
    proven = inside.groupBy("stream", "segment").agg(F.max("rn").alias("durable_seq"))
    end = F.col("en") - F.col("st") + SEGMENT_HEADER
    scans = segs.join(proven, ["stream", "segment"], "left").select(
        "stream", "segment", end.alias("valid_end"), F.col("last_seq").alias("valid_seq"), F.when(F.col("segment") % 4 == 0, end + 64).otherwise(end).alias("size"),
        F.coalesce("durable_seq", F.col("first_seq") - 1).alias("durable_seq"), (F.col("segment") % 8 == 0).alias("zero_tail"), (F.col("segment") % 3 == 0).alias("partial_tail"),
    )
    return V.segment_recovery(judged, scans)


@query("marker_boundaries", POS_SQL + ", mk AS (SELECT stream, seq, CASE WHEN seq % 7 = 0 THEN end_pos + 8 ELSE end_pos END AS marker FROM placed WHERE seq % 5 = 0) SELECT mk.stream, mk.marker FROM mk WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.stream = mk.stream AND p.end_pos = mk.marker)")
def _(spark, sf):
    from ..operators.replay import positions

    d = positions(raw(spark, sf))
    mk = d.where("seq % 5 = 0").select("stream", F.expr("CASE WHEN seq % 7 = 0 THEN end_pos + 8 ELSE end_pos END").alias("marker"))
    return mk.join(d.select("stream", F.col("end_pos").alias("marker")), ["stream", "marker"], "left_anti")


MONITOR = """seq % 101 = 0 AS stop, kind = 'error' AND qty % 7 = 0 AS fatal, seq % 3 > 0 AS ready_sent, qty % 4 AS announced, CASE WHEN price % 5 = 0 THEN 0 WHEN price % 5 = 1 THEN qty % 4 + 1 ELSE qty % 4 END AS current,
CAST(kind = 'signup' AND qty % 5 = 0 AS BIGINT) AS failed_logons, CASE WHEN kind = 'click' AND price % 9 = 0 THEN qty ELSE 0 END AS failed_required, price % 2 = 0 AS status_due, qty % 2 = 0 AS watchdog_due"""


@query("monitor_policy", f"""m AS (SELECT seq, {MONITOR} FROM raw) SELECT seq, CASE WHEN stop THEN 'CLEAN_STOP' WHEN fatal THEN 'FATAL' WHEN ready_sent AND "current" <> announced THEN 'LOST_AFTER_READY' WHEN NOT ready_sent AND (failed_logons > 0 OR failed_required <> 0) THEN 'FAILED_BEFORE_READY'
  WHEN NOT ready_sent AND "current" <> 0 THEN 'READY' ELSE concat_ws('+', CASE WHEN status_due AND ready_sent THEN 'READY_STATUS' WHEN status_due THEN 'WAITING_STATUS' END, CASE WHEN ready_sent AND watchdog_due THEN 'WATCHDOG' END) END AS actions FROM m""".replace("AS current,", 'AS "current",'))
def _(spark, sf):
    from ..operators.gates import monitor_actions

    d = raw(spark, sf).selectExpr("seq", *_columns(MONITOR.replace("AS current,", "AS `current`,")))
    return d.select("seq", F.array_join(monitor_actions(), "+").alias("actions"))
