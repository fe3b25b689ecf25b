"""Lineage, watermarks, manifests and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bits import log2_bucket
from ..operators import lake as L
from ..operators.replay import positions
from .base import query, raw, table
from .quality_plans import QUAL
from .replay_plans import POS_SQL, SEG_SQL, _segments


@query("lineage_summary", f"SELECT stream, seq // 2000 AS file_no, min(seq) AS min_cursor, max(seq) AS max_cursor, count(*) AS rows, bit_or({QUAL}) AS quality_union FROM raw GROUP BY ALL")
def _(spark, sf):
    return L.lineage(raw(spark, sf).withColumn("q", F.expr(QUAL)).withColumn("file_no", F.expr("seq div 2000")), ["stream", "file_no"], "seq", "q")


@query("input_identity", "SELECT instrument_id, sha256(string_agg(stream || ':' || seq, ',' ORDER BY seq)) AS input_identity_hash FROM raw WHERE kind = 'signup' GROUP BY instrument_id")
def _(spark, sf):
    d = raw(spark, sf).where("kind = 'signup'").groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stream"))).alias("e"))
    return d.select("instrument_id", F.sha2(F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["stream"], x["seq"])), ","), 256).alias("input_identity_hash"))


@query("durability_barrier", POS_SQL + ", d AS (SELECT stream, max(end_pos) FILTER (WHERE seq % 16 = 0) AS durable FROM placed GROUP BY stream), w AS (SELECT stream, seq // 500 AS wm, max(end_pos) AS consumed FROM placed GROUP BY ALL) SELECT wm, bool_and(consumed <= durable) AS may_checkpoint, count(*) AS inputs FROM w JOIN d USING (stream) GROUP BY wm")
def _(spark, sf):
    p = positions(raw(spark, sf))
    d = p.where("seq % 16 = 0").groupBy("stream").agg(F.max("end_pos").alias("durable"))
    w = p.groupBy("stream", F.expr("seq div 500").alias("wm")).agg(F.max("end_pos").alias("consumed"))
    return w.join(F.broadcast(d), "stream").groupBy("wm").agg(F.bool_and(F.col("consumed") <= F.col("durable")).alias("may_checkpoint"), F.count("*").alias("inputs"))


@query("retention_plan", SEG_SQL + """, k AS (SELECT max(last_ns) AS now, max(segment) AS top FROM seg), mf AS (SELECT stream, segment, bool_and(segment % 5 <> 0 OR part = 0) AS published FROM seg, range(2) r(part) WHERE segment % 7 <> 3 GROUP BY ALL),
cp AS (SELECT stream, min(limit_pos) AS least FROM seg, k WHERE segment IN (top, top - 1) GROUP BY stream)
SELECT seg.stream, seg.segment, last_ns <= now - 3600000000000 AS expired, coalesce(published, false) AS published, coalesce(least >= limit_pos, false) AS consumed, seg.segment % 4 <> 2 AS unreferenced, seg.segment % 3 <> 1 AS replicated, seg.segment % 2 = 0 OR seg.stream > 1 AS approved,
  last_ns <= now - 3600000000000 AND coalesce(published, false) AND coalesce(least >= limit_pos, false) AND seg.segment % 4 <> 2 AND seg.segment % 3 <> 1 AND (seg.segment % 2 = 0 OR seg.stream > 1) AS may_delete
FROM seg JOIN k ON true LEFT JOIN mf ON seg.stream = mf.stream AND seg.segment = mf.segment LEFT JOIN cp ON seg.stream = cp.stream""")
def _(spark, sf):
    from ..operators.gates import retention_plan

    s = _segments(spark, sf).select("stream", "segment", "last_ns", "limit_pos")
    now, top = s.agg(F.max("last_ns"), F.max("segment")).first()  # one row
    parts = s.where("segment % 7 <> 3").withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    manifests = parts.select("stream", "segment", F.expr("segment % 5 <> 0 OR part = 0").alias("verified"))
    checkpoints = s.where(F.col("segment").isin(top, top - 1)).select("stream", F.col("segment").alias("consumer"), F.col("limit_pos").alias("durable_pos"))
    readers, replicas = s.where("segment % 4 = 2"), s.withColumn("place", F.explode(F.expr("CASE WHEN segment % 3 = 1 THEN array('a', 'a') ELSE array('a', 'b') END")))
    return retention_plan(s, manifests, checkpoints, readers, replicas, now, 3_600_000_000_000, 2, s.where("segment % 2 = 0 OR stream > 1"))


@query("feed_statistics", "SELECT count(*) FILTER (WHERE kind <> 'error') AS delivered, count(*) FILTER (WHERE kind = 'error') AS errors, count(*) FILTER (WHERE qty = 0) AS filtered, count(*) FILTER (WHERE qty > 95) AS dropped, max(price) AS high_water, count(DISTINCT instrument_id) AS active FROM raw")
def _(spark, sf):
    k = F.col("kind")
    return raw(spark, sf).agg(F.count_if(k != "error").alias("delivered"), F.count_if(k == "error").alias("errors"), F.count_if(F.col("qty") == 0).alias("filtered"), F.count_if(F.col("qty") > 95).alias("dropped"), F.max("price").alias("high_water"), F.countDistinct("instrument_id").alias("active"))


@query("service_counts", "SELECT stream, kind, count(*) AS messages, CAST(sum(body) AS BIGINT) AS bytes FROM raw GROUP BY ALL")
def _(spark, sf):
    return raw(spark, sf).groupBy("stream", "kind").agg(F.count("*").alias("messages"), F.sum("body").alias("bytes"))


@query("capture_reconciliation", POS_SQL + " SELECT stream, count(*) AS callback_records, count(*) FILTER (WHERE seq % 100 <> 99) AS append_records, count(*) FILTER (WHERE seq % 100 < 90) AS durable_records, CAST(sum(size) AS BIGINT) AS callback_bytes, CAST(sum(size) FILTER (WHERE seq % 100 < 90) AS BIGINT) AS durable_bytes FROM placed GROUP BY stream")
def _(spark, sf):
    s = F.col("seq") % 100
    return positions(raw(spark, sf)).groupBy("stream").agg(F.count("*").alias("callback_records"), F.count_if(s != 99).alias("append_records"), F.count_if(s < 90).alias("durable_records"), F.sum("size").alias("callback_bytes"), F.sum(F.when(s < 90, F.col("size"))).alias("durable_bytes"))


@query("latency_histogram", "SELECT CAST(CASE WHEN price * price * qty <= 1 THEN 0 ELSE least(length(bin(price * price * qty)) - 1, 31) END AS INTEGER) AS bucket, count(*) AS n FROM raw GROUP BY 1")
def _(spark, sf):
    return raw(spark, sf).groupBy(log2_bucket(F.expr("price * price * qty")).alias("bucket")).agg(F.count("*").alias("n"))


@query("synthetic_universe", """WITH u AS (
  SELECT 101 AS service_id, CAST(600000 + i AS VARCHAR) AS security_id, 10000 + (i * 7919 % 19000) * 10 AS reference_price_milli, 10 AS tick_size_milli, 100 AS lot_size, false AS option FROM range(3000) r(i)
  UNION ALL SELECT 102, lpad(CAST(i + 1 AS VARCHAR), 6, '0'), 10000 + (i * 7877 % 19000) * 10, 10, 100, false FROM range(2000) r(i)
  UNION ALL SELECT 103, 'D' || lpad(CAST(i AS VARCHAR), 4, '0'), 500000 + (i * 12347 % 45000) * 100, 100, 1, i % 2 = 1 FROM range(320) r(i))
SELECT * FROM u""", with_raw=False)
def _(spark, sf):
    from ..sources.synth import universe

    return universe(spark, 3000, 2000, 320)


@query("synthetic_ticks")
def _(spark, sf):
    from ..sources.synth import generate, universe

    return generate(universe(spark, 20, 10, 4), 50, seed=5)


@query("service_metrics", "SELECT kind, 'records_total{kind=\"' || kind || '\"} ' || count(*) AS line FROM raw GROUP BY kind")
def _(spark, sf):
    return raw(spark, sf).groupBy("kind").agg(F.count("*").alias("n")).select("kind", F.concat(F.lit('records_total{kind="'), "kind", F.lit('"} '), "n").alias("line"))


MANIFEST = ("segment", "records", "first_seq", "last_seq", "base_pos", "limit_pos")
CHAIN_SQL = SEG_SQL + """, j AS (SELECT stream, segment, '{"base_pos":"' || base_pos || '","first_seq":"' || first_seq || '","last_seq":"' || last_seq || '","limit_pos":"' || limit_pos || '","records":"' || records || '","segment":"' || segment || '"}' AS manifest FROM seg),
h AS (SELECT stream, count(*) AS segments, list_reduce([''] || list(manifest ORDER BY segment), lambda a, b: sha256(a || b)) AS chain FROM j GROUP BY stream)"""


@query("segment_manifest", CHAIN_SQL + " SELECT stream, segment, manifest FROM j")
def _(spark, sf):
    return _segments(spark, sf).select("stream", "segment", L.manifest_json(MANIFEST).alias("manifest"))


@query("manifest_chain", CHAIN_SQL + " SELECT stream, segments, chain FROM h")
def _(spark, sf):
    return L.manifest_chain(_segments(spark, sf), ["stream"], "segment", MANIFEST)


@query("run_manifest", CHAIN_SQL + """, m AS (SELECT '{"config":{"registry":"7","shards":"4"},"factors":["f1","f2"],"inputs":[' || string_agg('{"chain":"' || chain || '","segments":"' || segments || '","stream":"' || stream || '"}', ',' ORDER BY chain) || '],"rules":["drop"]}' AS manifest FROM h) SELECT manifest, sha256(manifest) AS run_id FROM m""")
def _(spark, sf):
    return L.run_manifest(L.manifest_chain(_segments(spark, sf), ["stream"], "segment", MANIFEST), {"shards": 4, "registry": 7}, ["f2", "f1"], ["drop"])
