"""Decoding, catalogs, range joins and content hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decode import read_uint
from ..operators.factors import FactorSpec, imbalance, run_factor
from ..operators.replay import located, positions
from ..sources import catalogs
from .base import query, raw, table
from .factor_plans import _book
from .replay_plans import POS_SQL, SEG_SQL, _segments


@query("bounded_reads", "SELECT event_id, CAST(ascii(props[1]) + 256 * ascii(props[2]) AS BIGINT) AS u16, CASE WHEN length(props) >= 12 THEN CAST(ascii(props[9]) + 256 * ascii(props[10]) + 65536 * ascii(props[11]) + 16777216 * ascii(props[12]) AS BIGINT) END AS u32 FROM events", with_raw=False)
def _(spark, sf):
    b = F.col("props").cast("binary")
    return table(spark, sf, "events").select("event_id", read_uint(b, 0, 2).cast("long").alias("u16"), read_uint(b, 8, 4).cast("long").alias("u32"))


@query("message_catalog", "SELECT venue, CAST(generate_subscripts(roles, 1) - 1 AS INTEGER) AS kind, unnest(roles) AS role FROM (VALUES " + ", ".join(f"('{v}', ['" + "', '".join(r) + "'])" for v, r in catalogs.CATALOG.items()) + ") t(venue, roles)", with_raw=False)
def _(spark, sf):
    return catalogs.message_catalog(spark)


SPEC = ", ".join(f"({s}, '{k}', '{p}')" for s, sets in catalogs.STREAMS.items() for p, keys in zip(("required", "optional", "forbidden"), sets) for k in keys)


@query("subscription_faults", f"""SELECT source_stream_id, message_key, CASE policy WHEN 'required' THEN 'missing' ELSE 'forbidden' END AS fault FROM (VALUES {SPEC}) s(source_stream_id, message_key, policy)
WHERE (policy = 'required' AND message_key NOT IN ('SH.snapshot', 'SZ.order')) OR (policy = 'forbidden' AND source_stream_id = 2001)""", with_raw=False)
def _(spark, sf):
    seen = [(s, k) for s in catalogs.STREAMS for k in ("SH.snapshot", "SZ.order")] + [(2001, "SZ.combined")]
    return catalogs.subscription_faults(catalogs.subscription_spec(spark), spark.createDataFrame(seen, "source_stream_id int, message_key string"))


@query("segment_lookup", SEG_SQL + ", t AS (SELECT stream, max(end_pos) AS n FROM placed GROUP BY stream), q AS (SELECT raw.stream, seq, (seq * 7919 * 131) % n AS pos FROM raw JOIN t USING (stream)) SELECT q.stream, q.seq, q.pos, seg.segment FROM q JOIN seg ON q.stream = seg.stream AND q.pos >= seg.base_pos AND q.pos < seg.limit_pos")
def _(spark, sf):
    ends = positions(raw(spark, sf)).groupBy("stream").agg(F.max("end_pos").alias("n"))
    q = raw(spark, sf).join(ends, "stream").select("stream", "seq", F.expr("(seq * 7919 * 131) % n").alias("pos"))
    return located(q, _segments(spark, sf), ["stream"], "pos", "base_pos", "limit_pos", ["segment"]).select("stream", "seq", "pos", "segment")


@query("content_hash", "SELECT l_orderkey, sha256('lines:' || string_agg(l_partkey || '/' || l_suppkey || '/' || l_linenumber, ';' ORDER BY l_partkey, l_suppkey, l_linenumber)) AS content_hash FROM lineitem GROUP BY l_orderkey", with_raw=False)
def _(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat_ws("/", x["l_partkey"], x["l_suppkey"], x["l_linenumber"])), ";")
    return g.select("l_orderkey", F.sha2(F.concat(F.lit("lines:"), text), 256).alias("content_hash"))


@query("factor_run", """b AS (SELECT seq, instrument_id, recv_ns, qty AS bid_qty, price % 100 AS ask_qty, qty AS validity, price % 8 AS quality FROM raw WHERE kind = 'view'),
n AS (SELECT *, count(*) OVER (PARTITION BY instrument_id ORDER BY recv_ns RANGE BETWEEN 864000000000000 PRECEDING AND CURRENT ROW) AS n FROM b)
SELECT seq, CASE WHEN bid_qty + ask_qty <> 0 THEN CAST(bid_qty - ask_qty AS DOUBLE) / CAST(bid_qty + ask_qty AS DOUBLE) END AS value, n >= 3 AND bid_qty + ask_qty <> 0 AND (validity & 1) = 1 AND (quality & 4) = 0 AS valid FROM n""")
def _(spark, sf):
    spec = FactorSpec("book_imbalance", 1, 864_000_000_000_000, 3, 1, 4, lambda d: d.withColumn("value", imbalance(F.col("bid_qty"), F.col("ask_qty"))))
    d = _book(spark, sf).withColumn("validity", F.col("bid_qty")).withColumn("quality", F.col("bid") % 8)
    return run_factor(d, spec, ["instrument_id"], "recv_ns", "seq").select("seq", "value", "valid")


@query("durable_scan", POS_SQL + ", f AS (SELECT stream, max(end_pos) * 9 // 10 AS durable FROM placed GROUP BY stream) SELECT stream, count(*) AS records, max(end_pos) AS valid_end FROM placed JOIN f USING (stream) WHERE end_pos <= durable GROUP BY stream")
def _(spark, sf):
    d = positions(raw(spark, sf))
    f = d.groupBy("stream").agg(F.expr("max(end_pos) * 9 div 10").alias("durable"))
    return d.join(f, "stream").where("end_pos <= durable").groupBy("stream").agg(F.count("*").alias("records"), F.max("end_pos").alias("valid_end"))
