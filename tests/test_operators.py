"""Operators that SQL doesn't state: recurrences, codecs, faults, streaming, and hard inputs."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticktrail.functions import bits, fixed, hashing
from ticktrail.operators import control, factors, lake, market, ordered, replay
from ticktrail.plans import base, catalog, control_plans
from ticktrail.sources import faults, injected, rawlog, sinks, synth
from ticktrail.streaming import session_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("width", [1, 3, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_prefix_by_brute_force(spark, width, inclusive):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(8)])) for i in range(60)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "k string, i long, v long")
    kinds = {"s": ("sum", F.col("v")), "x": ("max", F.col("v")), "m": ("min", F.col("v")), "o": ("bit_or", F.col("v")), "l": ("last", F.col("v"))}
    for r in ordered.prefix(d, ["k"], "i", kinds, inclusive, width).collect():
        seen = [v for k, i, v in sorted(rows, key=lambda x: x[1]) if k == r.k and (i <= r.i if inclusive else i < r.i) and v is not None]
        want = (sum(seen), max(seen), min(seen), int(np.bitwise_or.reduce(seen)), seen[-1]) if seen else (None,) * 5
        assert (r.s, r.x, r.m, r.o, r.l) == want


def test_prefix_empty(spark):
    d = spark.createDataFrame([], "k string, i long, v long")
    assert ordered.prefix(d, ["k"], "i", {"s": ("sum", F.col("v"))}).collect() == []


def test_checksums_and_draws():
    assert hashing.crc32c_bytes(b"123456789") == 0xE3069283 and hashing.crc32c_bytes(b"") == 0
    assert int(hashing.splitmix(0)[0]) == 0xE220A8397B1DCDAF
    a, b = hashing.stable_draw(1, np.arange(10), 1), hashing.stable_draw(1, np.arange(5, 10), 1)
    assert (a[5:] == b).all() and (a != hashing.stable_draw(1, np.arange(10), 2)).all()


def test_index_and_rotation_recurrences(spark):
    d = replay.positions(base.raw(spark, SF)).withColumn("segment", F.lit(0))
    rows = sorted(d.where("stream = 1").collect(), key=lambda r: r.seq)
    keep, since, at = [], 0, None
    for r in rows:
        if at is None or since >= 16 or r.start_pos - at >= 3000:
            keep.append(r.seq)
            since, at = 0, r.start_pos
        since += 1
    got = replay.sampled_index(d.where("stream = 1"), ["stream", "segment"], "seq", 16, 3000)
    assert sorted(r.seq for r in got.collect()) == keep
    rot = replay.rotated(d.where("stream = 1"), ["stream"], "seq", 2000).groupBy("segment_no").agg(F.sum("size").alias("b")).collect()
    assert all(r.b <= 2000 for r in rot) and sorted(r.segment_no for r in rot) == list(range(len(rot)))


def test_recurrences_carry_their_state_over_batches(spark):
    """Batches of seven rows, null group keys and values, a record larger than a segment."""
    rows = [(g, i, (i * 37) % 50 + 1 if i != 40 else 500, None if i % 9 == 4 else float(i * 13 % 17)) for g in (None, 1, 2) for i in range(100)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.createDataFrame(rows, "g int, i int, size long, v double").repartition(5)
        rot = {(r.g, r.i): r.segment_no for r in replay.rotated(d, ["g"], "i", 120).collect()}
        ew = {(r.g, r.i): r.ewma for r in factors.ewma(d, ["g"], "i", "v", 0.3).collect()}
        at = d.withColumn("start_pos", F.col("i").cast("long") * 10)
        idx = {(r.g, r.i) for r in replay.sampled_index(at, ["g"], "i", 12, 95).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(rot) == len(ew) == len(rows)
    for g in (None, 1, 2):
        seg = used = 0
        y, since, last = None, 0, None
        for _, i, size, v in (r for r in rows if r[0] == g):
            if used and used + size > 120:
                seg, used = seg + 1, 0
            used += size
            assert rot[g, i] == seg
            y = y if v is None else v if y is None else 0.7 * y + 0.3 * v
            assert abs(ew[g, i] - y) < 1e-9
            hit = last is None or i - since >= 12 or i * 10 - last >= 95
            assert ((g, i) in idx) == hit
            since, last = (i, i * 10) if hit else (since, last)


def test_crc32c_of_many_lengths():
    values = [bytes((i * j) % 256 for j in range(i % 40)) for i in range(200)] + [b"x" * 5000, b"", b"123456789"]
    got = hashing.crc32c_many(values).tolist()
    assert got == [hashing.crc32c_bytes(v) for v in values] and got[-1] == 0xE3069283 and hashing.crc32c_many([]).tolist() == []


def test_ranges_globs_and_rules(spark):
    with pytest.raises(ValueError):
        replay.half_open("x", 2, 1)
    d = spark.createDataFrame([("600001",), ("600",), ("a.b",), ("axb",), ("",), (None,)], "id string").withColumn("k", F.lit("m"))
    hit = lambda p: sorted(r.id for r in replay.subscribed(d, [("m", p)], "k", "id").collect())
    assert hit("6*") == ["600", "600001"] and hit("?00001") == ["600001"] and hit("a.b") == ["a.b"] and hit("") == [""] and len(hit("*")) == 5
    assert replay.subscribed(d, [], "k", "id").count() == 0 and replay.subscribed(d, [("m", None)], "k", "id").count() == 6
    r = replay.RuleSet().add_values("a", "f", ["x", "y"]).add_key("a").add_values("a", "g", ["z"])
    assert r.rules["a"] == ("f", {"x", "y"})
    assert r.delete_values("a", "f", ["x", "y"]).describe() is None and r.add_values("b", "f", []).describe() == '[{"key":"b"}]'
    assert r.delete_values("b", "f", ["x"]).rules == {"b": None} and r.add_values("b", "f", ["q"]).rules["b"] == ("f", {"q"})


def test_faults_keep_their_promises(spark):
    d = spark.range(500).select(F.lit(0).alias("stream"), F.col("id").alias("seq"), (F.col("id") * 8).alias("price"))
    rule = faults.FaultRule(seed=3, drop_one_in=7, duplicate_one_in=5, copies=2, mutate_one_in=4, xor_mask=1, reorder_window=8)
    got = faults.transform(d, ["stream"], "seq", "price", rule).collect()
    dropped = set(range(500)) - {r.seq for r in got}
    assert dropped == set(np.flatnonzero(hashing.stable_draw(3, np.arange(500), faults.DROP) % np.uint64(7) == 0))
    assert sorted(r.new_seq for r in got) == list(range(1, len(got) + 1))
    for s in {r.seq for r in got}:
        own = [r for r in got if r.seq == s]
        assert len({r.price for r in own}) == 1 and sorted(r.copy for r in own) == list(range(1, len(own) + 1))
    no_drop = faults.transform(d, ["stream"], "seq", "price", faults.FaultRule(seed=3, mutate_one_in=4, xor_mask=1)).collect()
    assert {r.seq for r in no_drop if r.price % 8} - dropped == {r.seq for r in got if r.price % 8}
    straight = sorted((r.seq, r.copy) for r in got)
    assert all(abs(straight.index((r.seq, r.copy)) - (r.new_seq - 1)) < 8 for r in got)


def test_chunks_reorder_together_as_each_alone(spark):
    """A frame holds many chunks, the last one short; each is shuffled as if it were alone."""
    for n, window, base in ((1, 4, 0), (3, 4, 8), (50, 4, 8), (64, 16, 0), (65, 16, 32), (20, 30, 0)):
        pdf = pd.DataFrame({"x": np.arange(n) * 3, "new_seq": np.arange(n) + base + 1}).sample(frac=1, random_state=1)
        want = []
        for start in range(0, n, window):
            own = list(range(start, min(n, start + window)))
            for left in range(len(own), 1, -1):
                pick = int(hashing.stable_draw(5, (base + start) // window, faults.REORDER, left)[0]) % left
                own[left - 1], own[pick] = own[pick], own[left - 1]
            want += [3 * i for i in own]
        got = faults.reordered(pdf, 5, window)
        assert got["x"].tolist() == want and got["new_seq"].tolist() == list(range(base + 1, base + n + 1))
    d = spark.range(40_000).select(F.when(F.col("id") < 500, None).otherwise(F.lit(1)).alias("stream"), F.col("id").alias("seq"), F.col("id").alias("price"))
    got = faults.transform(d, ["stream"], "seq", "price", faults.FaultRule(seed=5, reorder_window=16)).toPandas()
    for _, own in got.groupby("stream", dropna=False):
        straight = pd.DataFrame({"seq": sorted(own["seq"]), "new_seq": np.arange(len(own)) + 1})
        assert own.sort_values("new_seq")["seq"].tolist() == faults.reordered(straight, 5, 16)["seq"].tolist()


def test_injected_logs_are_sound_and_apart(spark, tmp_path):
    d = replay.positions(base.raw(spark, SF)).where("stream < 2")
    rule, path = faults.FaultRule(seed=2, drop_one_in=6, duplicate_one_in=4, copies=2, mutate_one_in=3, xor_mask=5, reorder_window=8), str(tmp_path / "run")
    put = lambda: injected.write_injected(d, path, ["stream"], "seq", "price", rule, ["stream", "seq", "start_pos", "end_pos"], "r1", "abc")
    put()
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        put()
    records, gone, manifest = injected.read_injected(spark, path)
    n = d.count()
    assert records.where("occurrence = 1").count() + gone.count() == n and manifest.count() == 1 and records.where("mutated").count()
    assert injected.injected_faults(records, gone, manifest, ["stream"]).collect() == []
    with_kind = injected.with_parents(records, d, ["stream", "seq", "start_pos", "end_pos"], ["kind"])
    assert with_kind.count() == records.count()
    bad = records.where("synthetic_seq <> 3").withColumn("mutated", F.lit(False))
    found = {r.fault for r in injected.injected_faults(bad, records.select(*gone.columns).limit(1).union(gone), manifest, ["stream"]).collect()}
    assert {"sequence_not_gapless", "mutation_mislabelled", "dropped_and_kept", "not_as_the_manifest_counts"} <= found


def test_reordered_chunks_by_hand():
    """Draws by the chunk's number and the rows not yet placed."""
    left = np.array([4, 3, 2])
    got = hashing.stable_draw(9, 2, faults.REORDER, left)
    assert got.tolist() == [int(hashing.stable_draw(9, 2, faults.REORDER, int(n))[0]) for n in left]


@pytest.mark.parametrize("width", [2, 65536])
def test_sequence_guard_table(spark, width):
    rows = [("c1", 1, 100, "a"), ("c1", 2, 101, "b"), ("c1", 3, 101, "b"), ("c1", 4, 104, "c"), ("c1", 5, 102, "d"), ("c1", 6, 105, "e"), ("c2", 7, 1, "x"), ("c2", 8, 1, "y")]
    got = control.sequence_guard(spark.createDataFrame(rows, "scope string, i long, seq long, h string"), ["scope"], ["i"], "seq", F.col("h"), width=width).orderBy("i").collect()
    assert [r.verdict for r in got] == ["FIRST_OBSERVED", "CONTIGUOUS", "EXACT_DUPLICATE", "FORWARD_GAP", "BACKWARD", "CONTIGUOUS", "FIRST_OBSERVED", "CONFLICT_DUPLICATE"]
    assert [r.poisoned for r in got] == [False] * 4 + [True, True, False, True] and got[3].missing == 2


def test_readiness_takes_the_first_reason(spark):
    t = {r: F.col("bad").getItem(i) for i, r in enumerate(control.READINESS_REASONS)}
    n = len(t)
    rows = [([j >= i for j in range(n)],) for i in range(n + 1)]
    got = [r.r for r in spark.createDataFrame(rows, "bad array<boolean>").select(control.readiness(t).alias("r")).collect()]
    assert got == [*control.READINESS_REASONS, "READY"]


def test_latest_takes_whole_rows(spark):
    d = spark.createDataFrame([(1, 1, 10, 5), (1, 2, None, 6), (1, 0, 7, 7), (2, 1, 3, 3)], "k long, c long, bid long, ask long")
    assert sorted(tuple(r) for r in market.latest(d, ["k"], ["c"]).select("k", "c", "bid", "ask").collect()) == [(1, 2, None, 6), (2, 1, 3, 3)]


def test_asof_ties(spark):
    t = spark.createDataFrame([(1, 5, 1, 9), (1, 10, 2, 9), (1, 19, 3, 9)], "k long, at long, seq long, px long")
    s = spark.createDataFrame([(1, 10, 7), (1, 10, 8), (1, 20, 9)], "k long, at long, seq long").withColumn("bid", F.col("seq"))
    got = market.asof(t, s, ["k"], "at", "seq", ["bid"]).orderBy("at").collect()
    assert [r.bid for r in got] == [None, 8, 8]


def test_asof_and_sliding_by_brute_force_over_chunks(spark):
    rng = random.Random(5)
    t = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(-60, 300), i) for i in range(150)]
    s = [(rng.choice([1, 1, 2, None]), rng.randrange(-60, 300), i) for i in range(80)]
    a, b = spark.createDataFrame(t, "k long, at long, seq long"), spark.createDataFrame(s, "k long, at long, seq long").withColumn("v", F.col("seq"))
    for width in (7, 1000):
        got = {r.seq: r.v for r in market.asof(a, b, ["k"], "at", "seq", ["v"], width=width).collect()}
        assert got == {i: max(((y, j) for q, y, j in s if q == k and y <= x), default=(0, None))[1] for k, x, i in t}
    t.append((1, None, 999))
    a = spark.createDataFrame(t, "k long, at long, seq long")
    for chunks in (1, 4):
        got = {r.seq: r.n for r in factors.sliding(a, ["k"], "at", 20, {"n": F.count("*")}, chunks=chunks).collect()}
        assert got == {i: 1 if x is None else sum(q == k and y is not None and x - 20 <= y <= x for q, y, _ in t) for k, x, i in t}


def test_bits_and_numbers(spark):
    assert len(bits.QUALITY_BITS) == 36
    r = spark.range(1).select(
        bits.names(F.lit(bits.BIT["UNAUTHORIZED"] | 1)).alias("n"), fixed.to_p6(F.lit(1 << 62), 2).alias("p"), fixed.saturating_add(F.lit(fixed.I64_MAX), F.lit(1)).alias("s"),
        fixed.record_size(F.lit(79)).alias("a"), fixed.record_size(F.lit(87)).alias("b"), fixed.div(F.lit(-7), 2).alias("d"), fixed.fixed_text(F.lit(-5), 2).alias("t"),
    ).first()
    assert list(r.n) == ["START_UNKNOWN", "UNAUTHORIZED"] and r.p is None and r.s == fixed.I64_MAX and (r.a, r.b) == (216, 224) and r.d == -3 and r.t == "-0.05"


def test_generated_feed_invariants(spark):
    u = synth.universe(spark, 5, 4, 3)
    a = synth.generate(u, 40, 9).orderBy("security_id", "step").collect()
    assert a == synth.generate(u.repartition(3), 40, 9).orderBy("security_id", "step").collect()
    for r in a:
        assert r.low <= r.open <= r.high and r.low <= r.last <= r.high and r.best_bid < r.best_ask and r.low <= r.turnover / r.volume <= r.high


def segment(tmp_path, n=20):
    rec = [rawlog.Record(100 + i, 1000 + i, 2000 + i, 4, i % 3, 93000000, i, bytes([i] * (i % 11))) for i in range(n)]
    end = rawlog.write_segment(str(tmp_path / "0001.seg"), 1001, 20240229, 1, 0, rec[:12])
    rawlog.write_segment(str(tmp_path / "0002.seg"), 1001, 20240229, 2, end, rec[12:])
    return rec


def test_segments_round_trip_and_filters(spark, tmp_path):
    rec = segment(tmp_path)
    rawlog.register(spark)
    d = spark.read.format("ticksegments").option("path", str(tmp_path)).load()
    rows = d.orderBy("ingress_sequence").collect()
    assert [(r.ingress_sequence, bytes(r.payload)) for r in rows] == [(x.sequence, x.body) for x in rec] and all(a.end_pos == b.start_pos for a, b in zip(rows, rows[1:]))
    assert d.where("message_id = 1 AND ingress_sequence >= 105 AND ingress_sequence < 110").count() == sum(x.message == 1 and 105 <= x.sequence < 110 for x in rec)
    assert {r.tail for r in rawlog.recovery(d).collect()} == {"CLEAN"}


@pytest.mark.parametrize("damage, tail", [(lambda b: b + b"\0" * 64, "PREALLOCATION"), (lambda b: b[:-5], "PARTIAL_RECORD"), (lambda b: b[:-20] + bytes([b[-20] ^ 1]) + b[-19:], "INVALID_RECORD"), (lambda b: b"x" + b[1:], "BAD_SEGMENT_HEADER")])
def test_damaged_segments(spark, tmp_path, damage, tail):
    segment(tmp_path)
    p = tmp_path / "0002.seg"
    p.write_bytes(damage(p.read_bytes()))
    rawlog.register(spark)
    got = rawlog.recovery(spark.read.format("ticksegments").option("path", str(tmp_path)).load()).collect()
    assert sorted(r.tail for r in got) == sorted(["CLEAN", tail])


def test_segment_tail_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    rec = segment(src)
    rawlog.register(spark)
    q = spark.readStream.format("ticksegments").option("path", str(src)).load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
    q.processAllAvailable()
    rawlog.write_segment(str(src / "0003.seg"), 1001, 20240229, 3, 9999, [rawlog.Record(200, 1, 1, 4, 0, 0, 0, b"z")])
    q.processAllAvailable()
    q.stop()
    assert sorted(r.ingress_sequence for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [*[x.sequence for x in rec], 200]


def follow(spark, src, out, **options):
    q = spark.readStream.format("ticksegments").option("path", str(src)).options(**options).load().writeStream.format("parquet").option("checkpointLocation", str(out / "cp")).trigger(availableNow=True).start(str(out / "rows"))
    q.awaitTermination()
    return sorted((r.ingress_sequence if r.status == "OK" else -r.segment_sequence) for r in spark.read.parquet(str(out / "rows")).collect())


def test_a_record_still_being_written_waits(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    segment(src, 12)
    (src / "0002.seg").unlink()
    p = src / "0001.seg"
    whole = p.read_bytes()
    more = rawlog.encode(rawlog.Record(112, 5, 5, 4, 0, 0, 0, b"late"))
    rawlog.register(spark)
    p.write_bytes(whole + more[:-7])
    assert follow(spark, src, tmp_path, transitions="true") == [-1, *range(100, 112)]
    p.write_bytes(whole + more)
    assert follow(spark, src, tmp_path, transitions="true") == [-1, *range(100, 113)]


@pytest.mark.parametrize("bad", ["gap", "other log", "half left"])
def test_a_tail_refuses_what_does_not_follow(spark, tmp_path, bad):
    src = tmp_path / "src"
    src.mkdir()
    segment(src, 12)
    (src / "0002.seg").unlink()
    p = src / "0001.seg"
    rawlog.register(spark)
    follow(spark, src, tmp_path)
    r = lambda n: rawlog.Record(n, 5, 5, 4, 0, 0, 0, b"z")
    if bad == "gap":  # the first record of the batch is where the gap lies
        p.write_bytes(p.read_bytes() + rawlog.encode(r(113)))
    else:
        if bad == "half left":
            p.write_bytes(p.read_bytes() + rawlog.encode(r(112))[:-3])
        rawlog.write_segment(str(src / "0002.seg"), 1001 if bad == "half left" else 7, 20240229, 2, 0, [r(113)])
    with pytest.raises(Exception, match={"gap": "SEQUENCE_MISMATCH", "other log": "is followed", "half left": "PARTIAL_RECORD"}[bad]):
        follow(spark, src, tmp_path)


def test_stream_equals_batch(spark, tmp_path):
    d = control_plans._control(spark, SF).select("stream", "seq", "ctype", "address", "ts", "instrument_id", "qty")
    want = {(r.stream, r.seq): (r.connection_epoch, r.logged_in, r.quality) for r in control.session(d).collect()}
    src = str(tmp_path / "src")
    for i, (a, b) in enumerate([(0, 130), (130, 131), (131, 700), (700, 1000)]):
        d.where(f"seq >= {a} AND seq < {b}").coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(d.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    q = session_stream.session_stream(stream).writeStream.format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("sess").collect()
    assert len(got) == len(want) and not any(r.late for r in got)
    assert {(r.stream, r.seq): (r.connection_epoch, r.logged_in, r.quality) for r in got} == want


def test_publish_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k long, p string")
    assert lake.publish(a, path, ["k"], "p") == 2 and lake.publish(a, path, ["k"], "p") == 0
    with pytest.raises(ValueError):
        lake.publish(spark.createDataFrame([(1, "z")], "k long, p string"), path, ["k"], "p")
    with pytest.raises(ValueError):
        lake.publish(spark.createDataFrame([(9, "a"), (9, "b")], "k long, p string"), path, ["k"], "p")


def test_history_layout(spark, tmp_path):
    d = base.raw(spark, SF).withColumn("trade_date", F.date_format("ts", "yyyyMM"))
    lake.write_history(d, str(tmp_path / "h"), ["trade_date", "kind"], ["recv_ns", "seq"], buckets=4)
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.count() == d.count() and {"trade_date", "kind", "bucket"} <= set(back.columns)


def test_bounded_reads(spark):
    from ticktrail.functions import decode

    data = [bytes([1, 2, 3, 4, 255, 255, 255, 255, 255, 255, 255, 255]), b"\x01", b"", None]
    got = spark.createDataFrame([(i, b) for i, b in enumerate(data)], "i int, b binary").select(
        "i", decode.read_uint(F.col("b"), 0, 2).alias("a"), decode.read_uint(F.col("b"), 4, 8).alias("c")
    ).orderBy("i").collect()
    assert [r.a and int(r.a) for r in got] == [513, None, None, None] and [r.c and int(r.c) for r in got] == [2**64 - 1, None, None, None]
    word = lambda at, n: at.to_bytes(4, "little") + n.to_bytes(4, "little")
    cases = {word(8, 3) + b"abc": (b"abc", None, False), word(5, 0): (b"", None, True), word(0, 0): (b"", None, False), word(4, 2) + b"xx": (None, "OVERLAP", False), word(8, 9) + b"x": (None, "OUT_OF_BOUNDS", False), b"xx": (None, "TRUNCATED", False)}
    rows = spark.createDataFrame([(b,) for b in cases], "b binary").select("b", decode.read_text(F.col("b"), 0).alias("t")).collect()
    for r in rows:
        v, e, flagged = cases[bytes(r.b)]
        assert (None if r.t.value is None else bytes(r.t.value)) == v and r.t.error == e and r.t.empty_offset == flagged
    assert decode.list_at(word(8, 2) + b"abcd", 0, 2, 5, 0) == ([b"ab", b"cd"], None) and decode.list_at(word(8, 6), 0, 1, 5, 0)[1] == "TOO_MANY"
    assert spark.createDataFrame([(word(8, 2) + b"abcd",)], "b binary").select(decode.read_list(F.col("b"), 0, 2, 5)["items"].alias("x")).first().x == [b"ab", b"cd"]


def test_feed_config_and_clock():
    from ticktrail.functions.clock import advance
    from ticktrail.sources.catalogs import CATALOG, FeedConfig

    assert FeedConfig().validate() == "" and sum(map(len, CATALOG.values())) == 28
    for bad in ({"book_depth": 0}, {"orders_per_level": 101}, {"min_step_ms": 9, "max_step_ms": 1}, {"start_date": 20230229}, {"start_date": 20240302}, {"start_time": 120000000}, {"shanghai": -1}, {"shanghai": 0, "shenzhen": 0, "derivatives_per_market": 0}):
        assert FeedConfig(**bad).validate()
    assert advance(41_400_000, 0, 1) == (46_800_000, 0) and advance(53_999_999, 0, 2) == (34_200_000, 1) and advance(53_999_999, 0, 1) == (54_000_000, 0)


def test_replay_cli(spark, tmp_path, capsys):
    from ticktrail import replay_cli

    rec = segment(tmp_path)
    assert replay_cli.main([str(tmp_path), "--message", "1", "--sequence", "102", "112"]) == 0
    lines = capsys.readouterr().out.strip().split("\n")
    assert len(lines) == sum(x.message == 1 and 102 <= x.sequence < 112 for x in rec) and all(x.startswith("record\t") for x in lines)
    replay_cli.main([str(tmp_path), "--out", str(tmp_path / "o")])
    assert spark.read.text(str(tmp_path / "o")).count() == len(rec)


def test_csv_is_never_overwritten(spark, tmp_path):
    rows = [(1, 'say "hi", twice', [1, 2]), (2, None, []), (3, "", None), (4, "two\nlines", [3])]
    d, path = spark.createDataFrame(rows, "i long, t string, a array<int>"), str(tmp_path / "csv")
    sinks.write_csv(d, path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "~").csv(path)
    got = {int(r.i): (r.t, r.a) for r in back.collect()}
    assert got[1] == ('say "hi", twice', "[1,2]") and got[3][0] == "" and got[4][0] == "two\nlines" and not got[2][0]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_csv(d, path)
    assert [r.i for r in sinks.current_generation(d.withColumn("generation", F.when(F.col("i") > 1, F.col("i") % 2)), 1).collect()] == [3]


def test_metrics_are_replaced_whole(spark, tmp_path):
    assert sinks.metrics_text({"b": 2, "a": 1}, {"q": 'x"\n'}) == 'ticktrail_a{q="x\\"\\n"} 1\nticktrail_b{q="x\\"\\n"} 2\n'
    at, source = tmp_path / "metrics.txt", str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    listener = sinks.MetricsListener(str(at))
    spark.streams.addListener(listener)
    try:
        q = spark.readStream.schema("id long").parquet(source).writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        for _ in range(100):
            if at.exists():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert 'ticktrail_input_rows{query="counted"} 5' in at.read_text() and not (tmp_path / "metrics.txt.part").exists()


def test_order_reference_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    """No broadcast and so many tasks as the rows ask for, whatever the session's setting; null and repeated keys as in SQL."""
    import duckdb

    monkeypatch.setattr(ordered, "TASK_ROWS", 5)
    keys = [None, None, 1, 1, 1, 2, 3, 7, 7, *range(20, 60)]
    spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "l_orderkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in [None, 1, 1, 2, 7, *range(30, 60)]], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["order_reference"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and f"hashpartitioning(l_orderkey#{plan.split('hashpartitioning(l_orderkey#')[1].split(',')[0]}, 10)" in plan
    sql = catalog.ORACLES["order_reference"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'").replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, duckdb.connect().sql(sql).fetchall()))


@pytest.mark.parametrize("limit", [0, 4, 500_000])
def test_sequence_guard_by_brute_force(spark, monkeypatch, limit):
    """Scopes finished in one task, in buckets, and both at once give the same rows, also for a null scope."""
    monkeypatch.setattr(control, "SCOPE_ROWS", limit)
    rng = random.Random(4)
    rows = [(k, rng.randrange(40), i, rng.randrange(1, 7), rng.choice("ab")) for k, n in ((None, 3), (1, 2), (2, 30), (3, 1), (4, 12)) for i in range(n)]
    want = set()
    for k in {r[0] for r in rows}:
        top, seen, poisoned = None, {}, False
        for _, at, tie, s, p in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            if s in seen:
                verdict = "EXACT_DUPLICATE" if seen[s] == p else "CONFLICT_DUPLICATE"
            else:
                verdict = "FIRST_OBSERVED" if top is None else "CONTIGUOUS" if s == top + 1 else "FORWARD_GAP" if s > top + 1 else "BACKWARD"
            poisoned = poisoned or verdict in ("CONFLICT_DUPLICATE", "BACKWARD")
            want.add((k, at, tie, s, p, verdict, s - top - 1 if verdict == "FORWARD_GAP" else 0, poisoned))
            seen.setdefault(s, p)
            top = s if top is None else max(top, s)
    d = spark.createDataFrame(rows, "k long, at long, tie long, s long, p string")
    got = [tuple(r) for r in control.sequence_guard(d, ["k"], ["at", "tie"], "s", F.col("p"), width=8).collect()]
    assert len(got) == len(rows) and set(got) == want


@pytest.mark.parametrize("name, most", [("seq_guard", 1), ("seq_gaps", 1), ("poisoned_scopes", 2)])
def test_the_guard_moves_rows_once(spark, name, most):
    """One exchange for all windows; the counts by verdict add one of a few rows."""
    got = catalog.QUERIES[name](spark, SF)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == most
