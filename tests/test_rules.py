"""Rules against plain Python: cursors, gates, recovery, numbers, ranges, reconciliation, one order over streams."""

import random

import pytest
from pyspark.sql import functions as F

from ticktrail.functions import fixed
from ticktrail.operators import control, frontier, gates, lake, market, recovery, replay

BIG = (1 << 63) - 1


def test_cursor_advance(spark):
    rows = [(0, 0, 0, 0), (0, 0, 0, 1), (8, 1, 0, 1), (0, 0, 4096, 0), (0, 0, 4088, 0), (0, 0, 112, 1), (0, 0, 104, 1), (0, 0, 224, 3), (0, 5, 224, 3), (4, 0, 116, 1), (None, 0, 8, 0), (0, 0, 8192, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long, c long, d long").select(frontier.advance_plausible(*map(F.col, "abcd"))).collect()]
    assert got == [True, False, False, True, False, True, False, False, False, False, False, True]


def test_frontier_faults_name_what_is_broken(spark):
    good = (2, 4096 + 224, 10_000 + 4096 + 224, 12, 4096 + 112, 10_000 + 4096 + 112, 11)
    at = {n: i for i, n in enumerate(frontier.FRONTIER)}
    rows = [good]
    for name, by in (("segment", -2), ("append_offset", 4), ("append_pos", 8), ("durable_seq", 5), ("append_seq", 40), ("durable_offset", 8)):
        rows.append(tuple(v + by if i == at[name] else v for i, v in enumerate(good)))
    rows.append((None, *good[1:]))
    d = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in frontier.FRONTIER))
    got = [(r.ok, r.faults) for r in d.select(frontier.frontier_valid().alias("ok"), frontier.frontier_faults().alias("faults")).collect()]
    assert [ok for ok, _ in got] == [True] + [False] * 7 and got[0][1] == []
    assert "segment_numbered" in got[1][1] and "aligned" in got[2][1] and got[3][1] == ["one_segment_base"] and "durable_not_ahead" in got[4][1] and got[5][1] == ["records_fit_bytes"]


READY = {
    "segment": 1, "append_offset": 4320, "append_pos": 4320, "append_seq": 2, "durable_offset": 4208, "durable_pos": 4208, "durable_seq": 1, "writer": 5, "expected_writer": 5,
    "stream": 1, "date": 20240229, "decoder_stream": 1, "decoder_date": 20240229, "processed_pos": 4320, "processed_seq": 2, "record_end_pos": 4320, "decoder_seq": 2, "fatal": False,
    "capture_healthy": True, "decoder_healthy": True, "poisoned": False, "control_ready": True, "market_ready": True, "writer_heartbeat": 90, "decoder_heartbeat": 95, "now_ns": 100,
    "now_realtime_ns": 1000, "generation": 1, "generation_first": 1, "logon_generation": 1, "logon_seq": 1, "proof": None,
}
PROOF = {"version": 1, "stream": 1, "date": 20240229, "calendar_hash": "c", "valid_from": 900, "valid_until": 1100, "evaluated": 950, "silence_expected": True}


def test_every_refusal_and_the_first_of_two(spark):
    config = gates.ReadinessConfig(decoder_lag=100, durability_lag=200, heartbeat_timeout=50, calendar_hash="c")
    silent = {"market_ready": False}
    cases = [
        ({}, "READY"), ({"expected_writer": 0}, "INVALID_CONFIG"), ({"writer": 6}, "WRITER_INSTANCE_MISMATCH"), ({"decoder_date": 20240301}, "NAMESPACE_MISMATCH"), ({"append_offset": 4321}, "RAW_FRONTIER_INVALID"),
        ({"processed_pos": 4321}, "DECODER_CURSOR_INVALID"), ({"decoder_seq": 3}, "DECODER_CURSOR_INVALID"), ({"fatal": True}, "WRITER_FATAL"), ({"capture_healthy": False}, "CAPTURE_PIPELINE_UNHEALTHY"),
        ({"writer_heartbeat": 0}, "WRITER_HEARTBEAT_MISSING"), ({"writer_heartbeat": 101}, "WRITER_HEARTBEAT_CLOCK_REGRESSION"), ({"writer_heartbeat": 49}, "WRITER_HEARTBEAT_TIMED_OUT"),
        ({"decoder_heartbeat": 0}, "DECODER_HEARTBEAT_MISSING"), ({"decoder_heartbeat": 101}, "DECODER_HEARTBEAT_CLOCK_REGRESSION"), ({"decoder_heartbeat": 49}, "DECODER_HEARTBEAT_TIMED_OUT"),
        ({"decoder_healthy": False}, "DECODER_UNHEALTHY"), ({"generation": 0}, "LIVE_GENERATION_INVALID"), ({"logon_generation": 2}, "CURRENT_GENERATION_LOGON_MISSING"), ({"poisoned": True}, "CONTROL_POISONED"),
        ({"control_ready": False}, "CONTROL_EVIDENCE_INCOMPLETE"), (silent, "MARKET_EVIDENCE_INCOMPLETE"), (silent | {"proof": PROOF}, "READY"), (silent | {"proof": PROOF | {"calendar_hash": "x"}}, "CALENDAR_PROOF_INVALID"),
        (silent | {"proof": PROOF | {"valid_until": 1000}}, "CALENDAR_PROOF_INVALID"), ({"append_offset": 4432, "append_pos": 4432, "append_seq": 3}, "DURABILITY_LAG_EXCEEDED"),
        ({"processed_pos": 4208, "processed_seq": 1, "record_end_pos": 4208, "decoder_seq": 1}, "DECODER_LAG_EXCEEDED"), ({"processed_pos": 4328}, "DECODER_CURSOR_INVALID"),
        ({"fatal": True, "writer": 6}, "WRITER_INSTANCE_MISMATCH"), ({"poisoned": None}, "CONTROL_POISONED"),
    ]
    kind = "struct<version:int,stream:long,date:long,calendar_hash:string,valid_from:long,valid_until:long,evaluated:long,silence_expected:boolean>"
    types = ", ".join(f"{k} {kind if k == 'proof' else 'boolean' if isinstance(v, bool) else 'long'}" for k, v in READY.items())
    got = spark.createDataFrame([tuple((READY | c).values()) for c, _ in cases], types).select(gates.readiness_reason(config).alias("r")).collect()
    assert [r.r for r in got] == [want for _, want in cases]
    assert spark.createDataFrame([tuple(READY.values())], types).select(gates.readiness_reason(gates.ReadinessConfig(decoder_lag=0)).alias("r")).first().r == "INVALID_CONFIG"


def test_journal_rules(spark):
    segs = spark.createDataFrame([("s", 1, 0, 1), ("s", 2, 4320, 3)], "stream string, segment long, base_pos long, first_seq long")
    good = [(1, "OK", "s", 1, 4096, 4096, 0, False), (2, "OK", "s", 1, 4320, 4320, 2, False), (3, "OK", "s", 1, 4320, 4320, 2, True), (4, "OK", "s", 2, 4096, 8416, 2, False), (5, "OK", "s", 2, 4208, 8528, 3, False)]

    def run(markers):
        d = spark.createDataFrame([("s", *m) for m in markers], "stream string, at long, status string, marker_stream string, segment long, offset long, pos long, seq long, sealed boolean")
        r = recovery.journal_prefix(recovery.judged_markers(d, segs)).first()
        return r.accepted, r.last_accepted, r.fatal, r.rolled_back

    def change(i, **by):
        names = ("at", "status", "marker_stream", "segment", "offset", "pos", "seq", "sealed")
        return [tuple(by.get(n, v) for n, v in zip(names, m)) if k == i else m for k, m in enumerate(good)]

    assert run(good) == (5, 5, "NONE", "NONE") and set(recovery.FATALS) >= {"NONE", "SEALED_SEGMENT_HAS_TAIL"}
    assert run(change(4, status="BAD_CRC")) == (4, 4, "NONE", "TERMINAL_CRC_INVALID_MARKER") and run(change(4, status="PARTIAL")) == (4, 4, "NONE", "PARTIAL_MARKER")
    assert run(change(2, status="BAD_CRC")) == (2, 2, "JOURNAL_MARKER_CORRUPTION", "NONE") and run(change(3, marker_stream="x")) == (3, 3, "NAMESPACE_MISMATCH", "NONE")
    assert run(change(4, segment=9))[2] == "SEGMENT_MISSING" and run(change(1, pos=4328))[2] == "JOURNAL_CHAIN_VIOLATION" and run(change(0, seq=1))[2] == "JOURNAL_CHAIN_VIOLATION"
    assert run(change(2, sealed=False))[2] == "JOURNAL_CHAIN_VIOLATION"  # the next segment follows an unsealed one
    other = segs.where("segment = 1").unionByName(spark.createDataFrame([("s", 2, 4320, 4)], segs.schema))
    d = spark.createDataFrame([("s", *m) for m in good], "stream string, at long, status string, marker_stream string, segment long, offset long, pos long, seq long, sealed boolean")
    assert recovery.journal_prefix(recovery.judged_markers(d, other)).first().fatal == "SEGMENT_BASE_MISMATCH"


def test_numbers(spark):
    rows = [(BIG, 2, 2), (-BIG, 3, 1), (BIG, BIG, BIG), (7, 3, 2), (-7, 3, 2), (1, 1, 0), (None, 1, 1), (BIG, BIG, 1), (5_000_000_000, 1, 1)]
    d = spark.createDataFrame(rows, "a long, b long, c long")
    a, b, c = map(F.col, "abc")
    got = d.select(fixed.mul_div(a, b, c), fixed.saturating_multiply(a, b), fixed.saturating_add(a, b), fixed.narrow_u32(a), fixed.exact_positive_i32(b), fixed.to_p6(a, 7), fixed.narrow_i32(a)).collect()

    def hold(v):
        return min(max(v, -BIG - 1), BIG)

    for r, (x, y, z) in zip(got, rows):
        if x is None:
            assert r[0] is None and r[1] is None and r[2] is None and r[3] is None and r[6] is None
            continue
        whole = None if z == 0 else abs(x * y) // abs(z) * (1 if (x * y < 0) == (z < 0) else -1)
        assert r[0] == (whole if whole is not None and abs(whole) <= BIG else None) and r[1] == hold(x * y) and r[2] == hold(x + y)
        assert r[3] == min(max(x, 0), (1 << 32) - 1) and r[4] == (y if 0 < y < 1 << 31 else None) and r[5] is None and r[6] == min(max(x, -(1 << 31)), (1 << 31) - 1)


def test_ranges_reconciliation_and_order(spark):
    rng = random.Random(4)
    ranges = [(k, i, 100 * i, 100 * i + rng.randint(0, 100)) for k in range(3) for i in range(40)]
    rows = [(rng.randrange(4), rng.randrange(4200)) for _ in range(500)]
    got = replay.located(spark.createDataFrame(rows, "k long, pos long"), spark.createDataFrame(ranges, "k long, i long, lo long, hi long"), ["k"], "pos", "lo", "hi", ["i"], width=37).collect()
    assert sorted(map(tuple, got)) == sorted((k, p, i) for k, p in rows for kk, i, lo, hi in ranges if k == kk and lo <= p < hi)
    cap = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (2, "a", 6), (3, "a", 7), (4, "b", 1)], "id long, g string, v long")
    back = spark.createDataFrame([(1, "a", 5), (1, "a", 9), (2, "a", 6), (9, "b", 1), (4, "b", 1)], cap.schema)
    r = {x.g: x for x in lake.reconcile(cap, back, ["id"], ["v"], "g").collect()}
    assert (r["a"].capture_rows, r["a"].backup_matches, r["a"].missing_rows, r["a"].backup_only_rows, r["a"].repeated_keys, r["a"].differing_rows) == (3, 2, 1, 0, 2, 1)
    assert (r["b"].capture_rows, r["b"].backup_only_rows, r["b"].result) == (1, 1, "FAIL")
    ticks = [(e, rng.randrange(50), s, i) for e in range(2) for s in range(3) for i in range(40)]
    d = market.mux(spark.createDataFrame(ticks, "epoch long, ns long, stream long, seq long"), ["epoch"], "ns", ["stream", "seq"], width=7)
    for e in range(2):
        want = {t: n + 1 for n, t in enumerate(sorted(t for t in ticks if t[0] == e))}
        assert {(r.epoch, r.ns, r.stream, r.seq): r.place for r in d.where(F.col("epoch") == e).collect()} == want
    many = spark.range(70).select(F.lit(1).alias("g"), F.col("id").alias("k"))
    with pytest.raises(Exception, match="63 keys"):
        control.key_masks(many, ["g"], "k", {"m": F.lit(True)}).collect()


def test_messages_keep_faults_apart(spark):
    from ticktrail.operators import messages as M

    rows = [("CONNECTING", 1, "a", None), ("CONNECTING", 2, "a", None), ("DISCONNECTED", 1, "a", None), ("CONNECT_ERROR", 1, "", ""), (None, 1, "a", "b"), ("CONNECTING", None, "a", "b"), ("CONNECTING", 1, None, "b")]
    d = spark.createDataFrame(rows, "k string, v int, a string, e string")
    got = [(r[0][0], r[0][1]) for r in d.select(M.connection_event(F.col("k"), F.col("v"), F.col("a"), F.col("e"), 1)).collect()]
    assert got == [("CONNECTING", None), (None, "UNSUPPORTED_VERSION"), (None, "UNREADABLE_TEXT"), ("CONNECT_ERROR", None), (None, "UNSUPPORTED_MESSAGE"), (None, "UNSUPPORTED_VERSION"), (None, "UNREADABLE_TEXT")]

    kind = "c int, s array<struct<service_id:int,service_version:int,messages:array<struct<message_id:int,status:int>>>>"
    rows = [(0, []), (1, [(2, 1, [(1, 0)]), (1, 1, [(5, 0), (3, 1)])]), (0, [(1, 1, None)]), (0, None), (None, []), (0, [(1, 1, [(1, 0), (1, 1)])]), (0, [(i, 1, []) for i in range(4097)])]
    got = [tuple(r[0])[:3] for r in spark.createDataFrame(rows, kind).select(M.logon_response(F.col("c"), F.col("s"))).collect()]
    assert got == [("LOGON_SUCCESS", None, 0), ("LOGON_FAILURE", None, 3), (None, "UNREADABLE_LIST", None), (None, "UNREADABLE_LIST", None), (None, "UNREADABLE_CODE", None), (None, "DUPLICATE_KEY", None), (None, "TOO_MANY_ENTRIES", None)]

    rows = [(40, 0, 0), (39, 0, 0), (56, 40, 2), (55, 40, 2), (100, 39, 1), (None, 40, 0), (100, BIG, 2), (100, 40, -1), (100, None, 0), (100, 40, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "size long, o long, n long").select(M.body_valid(F.col("size"), 40, [(F.col("o"), F.col("n"), 8)])).collect()]
    assert got == [True, False, True, False, False, False, False, False, True, False]


def test_accumulated_lots_against_a_walk(spark):
    draw = random.Random(5)
    rows = [(draw.choice([1, 2, 3, None]), i, draw.choice([None, 0, -5, *range(1, 300)]), draw.choice([None, 0, -3, *range(1, 90)])) for i in range(400)]
    rows += [(9, 1000 + i, BIG // 2, 50) for i in range(3)]
    want = {}
    for key in {r[0] for r in rows}:
        v = t = 0
        for _, i, p, q in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            take = max(0, min(q, 900 - v, (200_000 - t) // p) // 10 * 10) if (p or 0) > 0 and (q or 0) > 0 else 0
            v, t = v + take, t + take * (p or 0)
            want[i] = (take, v, t)
    d = spark.createDataFrame(rows, "k int, seq long, price long, qty long")
    got = {r.seq: (r.accepted, r.volume, r.turnover) for r in market.accumulated(d, ["k"], "seq", "price", "qty", 10, 900, 200_000).collect()}
    assert got == want
    loose = market.accumulated(d.where("k < 9"), ["k"], "seq", "price", "qty", 10, BIG, BIG).agg(F.max("volume"), F.sum("accepted")).first()
    assert loose[1] == sum(q // 10 * 10 for k, _, p, q in rows if k and k < 9 and (p or 0) > 0 and (q or 0) > 0)


def test_pacing_starts_anew_after_a_pause(spark):
    from ticktrail.operators.messages import paced

    rows = [(1, i, 10 * i, m) for i, m in enumerate([True, True, None, False, True, True, True, False])]
    got = paced(spark.createDataFrame(rows, "s int, seq long, at long, m boolean"), ["s"], "seq", "at", F.col("m"), 100).orderBy("seq")
    assert [(r.seq, r.deadline) for r in got.collect()] == [(0, 100), (1, 200), (4, 140), (5, 240), (6, 340)]


def test_book_sides_against_a_walk(spark):
    draw = random.Random(8)
    rows = [(draw.choice(["a", "b", None]), draw.choice([True, False, None]), draw.choice([None, *range(100, 125)]), draw.choice([5, 6, 7]), i) for i in range(900)]
    rows += [("hot", True, 7, i % 3, 1000 + i) for i in range(70)]
    got = {(r.k, r.is_bid): r for r in market.book_sides(spark.createDataFrame(rows, "k string, bid boolean, price long, qty long, seq long"), ["k"], F.col("bid"), "price", "qty", "seq").collect()}
    want = {(k, b) for k, b, p, _, _ in rows if b is not None and p is not None}
    assert set(got) == want
    for (k, b), r in got.items():
        mine = sorted((i, p, q) for kk, bb, p, q, i in rows if (kk, bb) == (k, b) and p is not None)
        prices = sorted({p for _, p, _ in mine}, reverse=b)
        assert r.actual_depth == len(prices)
        assert [tuple(x) for x in r.levels] == [(p, sum(q for _, x, q in mine if x == p), sum(x == p for _, x, _ in mine)) for p in prices[:10]]
        best = [q for _, p, q in mine if p == prices[0]]
        assert r.queue == best[:50] and r.queue_orders == len(best)
    empty = spark.createDataFrame([], "k string, bid boolean, price long, qty long, seq long")
    assert market.book_sides(empty, ["k"], F.col("bid"), "price", "qty", "seq").count() == 0


def test_log2_buckets_and_epochs(spark):
    from ticktrail.functions.bits import log2_bucket
    from ticktrail.functions.hashing import clock_epoch

    values = [0, 1, 2, 3, 4, 1023, 1024, (1 << 31) - 1, 1 << 31, BIG, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(log2_bucket(F.col("v"))).collect()]
    assert got == [None if v is None else min(max(v, 1).bit_length() - 1, 31) for v in values]
    d = spark.createDataFrame([("a", "bc", "d"), ("ab", "c", "d"), ("", "b", "c"), ("a", None, "c")], "a string, b string, c string")
    got = [tuple(r) for r in d.select(*clock_epoch(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got[0] != got[1] and got[2:] == [(None, None)] * 2 and all(x[:16] == y for x, y in got[:2])


def test_player_waits_holds_and_steps():
    from ticktrail.operators.player import Player

    now, slept = [1000], []

    def sleep(ns):
        slept.append(ns)
        now[0] += ns

    p = Player(iter([{"due_ns": x} for x in (0, 50, 80, 90, 200)]), lambda: now[0], sleep)
    assert p.take()["due_ns"] == 0 and p.take()["due_ns"] == 50 and slept == [50]
    p.pause()
    now[0] += 500
    assert p.take() is None and not p.ended
    p.step()
    assert p.take()["due_ns"] == 80 and p.take() is None and slept == [50]
    p.resume()
    assert p.take()["due_ns"] == 90 and slept == [50, 40]
    with pytest.raises(ValueError):
        p.step()
    assert p.take()["due_ns"] == 200 and p.take() is None and p.ended


def test_idle_proofs_and_release(spark):
    sound = dict(source=1, now_ns=50, state="HEALTHY", captured=5, appended=5, processed=5, inflight=0, captured_again=5, appended_again=5, inflight_again=0)
    broken = [{}, {"state": "FATAL"}, {"state": None}, {"appended": 4}, {"processed": 4}, {"inflight": 1}, {"captured_again": 6}, {"appended_again": 6}, {"inflight_again": 1}, {"processed": None}]
    rows = [sound | change | {"source": i, "now_ns": 50 + i} for i, change in enumerate(broken)]
    schema = "source int, now_ns long, state string, captured long, appended long, processed long, inflight long, captured_again long, appended_again long, inflight_again long"
    samples = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    idle = frontier.idle_frontiers(samples, "source")
    assert {r.source: r.idle_to for r in idle.collect()} == {0: 50} | {i: None for i in range(1, len(broken))}
    events = spark.createDataFrame([(1, 10), (1, 40), (1, 60), (2, 45), (2, 48)], "source int, at long")
    out = lambda need: sorted((r.source, r["at"]) for r in frontier.released(events, idle, "source", "at", need).collect())
    assert out([1, 2, 0]) == [(1, 10), (1, 40), (2, 45), (2, 48)]
    assert out([1, 2, 7]) == []  # nothing is known of 7
    assert out([1]) == [(1, 10), (1, 40), (1, 60), (2, 45), (2, 48)]
