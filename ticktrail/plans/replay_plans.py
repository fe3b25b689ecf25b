"""Replay, layout and subscription queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import record_pad, record_size
from ..operators import replay as R
from .base import RAW_SQL, query, raw, table

POS_SQL = """pos AS (
  SELECT *, 135 + body + (8 - (119 + body) % 8) % 8 AS size,
         CAST(sum(135 + body + (8 - (119 + body) % 8) % 8) OVER (PARTITION BY stream ORDER BY seq) AS BIGINT) AS end_pos FROM raw),
placed AS (SELECT *, end_pos - size AS start_pos FROM pos)"""


@query("replay_filter", "SELECT seq, stream, kind, price, qty FROM raw WHERE stream IN (1, 2) AND kind IN ('click', 'view') AND seq >= 100 AND seq < 5000 AND recv_ns >= 0")
def _(spark, sf):
    d = R.replay_filter(raw(spark, sf), {"stream": [2, 1, 1], "kind": ["click", "view"], "instrument_id": []}, {"seq": (100, 5000), "recv_ns": (0, None)})
    return d.select("seq", "stream", "kind", "price", "qty")


CLOCK_SQL = """c AS (SELECT *, seq // 2500 AS epoch, seq * 1000 - CASE WHEN seq % 97 = 0 THEN 500000 ELSE 0 END AS mono FROM raw WHERE kind <> 'view'),
p AS (SELECT *, lag(seq) OVER w AS prev_seq, lag(epoch) OVER w AS pe, lag(mono) OVER w AS pm FROM c WINDOW w AS (PARTITION BY stream ORDER BY seq))"""


@query("replay_boundaries", CLOCK_SQL + """
SELECT stream, seq, prev_seq, CASE WHEN epoch <> pe THEN 'CLOCK_EPOCH_BOUNDARY' ELSE 'MONOTONIC_REGRESSION' END AS notice
FROM p WHERE prev_seq IS NOT NULL AND (epoch <> pe OR mono < pm)""")
def _(spark, sf):
    d = raw(spark, sf).where("kind <> 'view'").withColumn("epoch", F.expr("seq div 2500")).withColumn("mono", F.expr("seq * 1000 - CASE WHEN seq % 97 = 0 THEN 500000 ELSE 0 END"))
    return R.boundaries(d, ["stream"], "seq", "epoch", "mono").select("stream", "seq", F.col("prev.seq").alias("prev_seq"), "notice")


@query("record_layout", "SELECT seq, body, (8 - (119 + body) % 8) % 8 AS pad, 135 + body + (8 - (119 + body) % 8) % 8 AS size FROM raw")
def _(spark, sf):
    return raw(spark, sf).select("seq", "body", record_pad(F.col("body")).alias("pad"), record_size(F.col("body")).alias("size"))


@query("log_positions", POS_SQL + " SELECT stream, seq, start_pos, end_pos FROM placed")
def _(spark, sf):
    return R.positions(raw(spark, sf)).select("stream", "seq", "start_pos", "end_pos")


FRONT_SQL = POS_SQL + """, f AS (SELECT stream, (max(end_pos) * 4) // 5 // 8 * 8 AS frontier FROM placed GROUP BY stream),
pv AS (SELECT placed.*, frontier, CASE WHEN end_pos <= frontier THEN 'durable' WHEN start_pos >= frontier THEN 'append_only' ELSE 'straddling' END AS provenance
       FROM placed JOIN f USING (stream))"""


def _provenance(spark, sf):
    d = R.positions(raw(spark, sf))
    f = d.groupBy("stream").agg(F.expr("(max(end_pos) * 4) div 5 div 8 * 8").alias("frontier"))
    return R.provenance(d, f)


@query("provenance_split", FRONT_SQL + " SELECT stream, provenance, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM pv GROUP BY ALL")
def _(spark, sf):
    return _provenance(spark, sf).groupBy("stream", "provenance").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))


@query("frontier_alignment", FRONT_SQL + " SELECT stream, frontier, max(CASE WHEN end_pos = frontier THEN 1 ELSE 0 END) = 1 OR frontier = 0 AS aligned FROM pv GROUP BY stream, frontier")
def _(spark, sf):
    return _provenance(spark, sf).groupBy("stream", "frontier").agg(F.expr("max(CASE WHEN end_pos = frontier THEN 1 ELSE 0 END) = 1 OR frontier = 0").alias("aligned"))


SEG_SQL = POS_SQL + """, seg AS (
  SELECT stream, seq // 1000 AS segment, count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq, min(start_pos) AS base_pos,
         max(end_pos) AS limit_pos, arg_min(recv_ns, seq) AS first_ns, arg_max(recv_ns, seq) AS last_ns FROM placed GROUP BY ALL)"""


def _segments(spark, sf):
    return R.segments(R.positions(raw(spark, sf)).withColumn("segment", F.expr("seq div 1000")), ["stream"], "segment")


@query("segment_ranges", SEG_SQL + " SELECT * FROM seg")
def _(spark, sf):
    return _segments(spark, sf)


@query("contiguity_violations", SEG_SQL + """, s AS (SELECT * FROM seg WHERE (segment + stream) % 5 <> 3),
l AS (SELECT *, lag(segment) OVER w AS ps, lag(limit_pos) OVER w AS pl, lag(last_seq) OVER w AS pq FROM s WINDOW w AS (PARTITION BY stream ORDER BY segment))
SELECT stream, segment, CASE WHEN segment <> ps + 1 THEN 'segment_gap' WHEN base_pos <> pl THEN 'base_gap' ELSE 'ingress_gap' END AS violation
FROM l WHERE ps IS NOT NULL AND (segment <> ps + 1 OR base_pos <> pl OR first_seq <= pq)""")
def _(spark, sf):
    return R.contiguity_violations(_segments(spark, sf).where("(segment + stream) % 5 <> 3"), ["stream"], "segment").select("stream", "segment", "violation")


@query("sparse_index", f"""WITH RECURSIVE {RAW_SQL}, {POS_SQL}, o AS (SELECT stream, seq // 1000 AS segment, seq, start_pos, row_number() OVER (PARTITION BY stream, seq // 1000 ORDER BY seq) AS i FROM placed),
x AS (SELECT * FROM o WHERE i = 1 UNION ALL SELECT o.* FROM o JOIN (SELECT x.stream, x.segment, min(o.i) AS i FROM x JOIN o ON o.stream = x.stream AND o.segment = x.segment AND o.i > x.i AND (o.i >= x.i + 64 OR o.start_pos >= x.start_pos + 8192) GROUP BY x.stream, x.segment) n
  ON o.stream = n.stream AND o.segment = n.segment AND o.i = n.i)
SELECT stream, segment, seq, start_pos FROM x""", with_raw=False)
def _(spark, sf):
    d = R.positions(raw(spark, sf)).withColumn("segment", F.expr("seq div 1000"))
    return R.sampled_index(d, ["stream", "segment"], "seq", 64, 8192)


@query("rotation_simulation", f"""WITH RECURSIVE {RAW_SQL}, {POS_SQL},
x AS (SELECT stream, CAST(0 AS BIGINT) AS segment_no, CAST(0 AS BIGINT) AS base FROM placed GROUP BY stream
  UNION ALL SELECT x.stream, x.segment_no + 1, min(p.start_pos) FROM x JOIN placed p ON p.stream = x.stream AND p.start_pos > x.base AND p.end_pos > x.base + 65536 GROUP BY x.stream, x.segment_no),
b AS (SELECT *, lead(base) OVER (PARTITION BY stream ORDER BY segment_no) AS until FROM x)
SELECT p.stream, b.segment_no, count(*) AS records, CAST(sum(p.size) AS BIGINT) AS bytes FROM placed p JOIN b ON p.stream = b.stream AND p.start_pos >= b.base AND (b.until IS NULL OR p.start_pos < b.until) GROUP BY ALL""", with_raw=False)
def _(spark, sf):
    d = R.positions(raw(spark, sf))
    return R.rotated(d, ["stream"], "seq", 65536).groupBy("stream", "segment_no").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))


@query("replay_pacing", "a AS (SELECT stream, arg_min(recv_ns, seq) AS anchor FROM raw GROUP BY stream) SELECT seq, stream, greatest(0, (recv_ns - anchor) * 2 // 3) AS due_ns FROM raw JOIN a USING (stream)")
def _(spark, sf):
    return R.due_offsets(raw(spark, sf), ["stream"], "seq", "recv_ns", 3, 2).select("seq", "stream", "due_ns")


@query("replay_text_sink", r"SELECT seq, 'record' || chr(9) || 'stream=' || stream || chr(9) || 'seq=' || seq || chr(9) || 'kind=' || kind AS line FROM raw")
def _(spark, sf):
    t = F.lit("\t")
    return raw(spark, sf).select("seq", F.concat(F.lit("record"), t, F.lit("stream="), "stream", t, F.lit("seq="), "seq", t, F.lit("kind="), "kind").alias("line"))


@query("first_heads", "SELECT seq, kind, price FROM raw ORDER BY seq LIMIT 16")
def _(spark, sf):
    return raw(spark, sf).orderBy("seq").limit(16).select("seq", "kind", "price")


@query("glob_subscription", "SELECT p_partkey, p_brand, p_name FROM part WHERE (p_brand GLOB 'Brand#1?') OR (p_brand = 'Brand#23') OR (p_name GLOB '*1*' AND p_brand LIKE 'Brand#3%')", with_raw=False)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name").withColumn("k", F.lit("part"))
    third = R.subscribed(p.where(F.col("p_brand").startswith("Brand#3")), [("part", "*1*")], "k", "p_name")
    return R.subscribed(p, [("part", "Brand#1?"), ("part", "Brand#23")], "k", "p_brand").unionByName(third).distinct().drop("k")


@query("subscription_rules", """SELECT p_brand, count(*) AS messages FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#32') GROUP BY p_brand""", with_raw=False)
def _(spark, sf):
    rules = R.RuleSet().add_values("part", "brand", ["Brand#11", "Brand#12", "Brand#13"]).add_key("part").add_values("part", "brand", ["Brand#32"]).delete_values("part", "brand", ["Brand#13"])
    field, values = rules.rules["part"]
    return table(spark, sf, "part").where(F.col("p_brand").isin(sorted(values))).groupBy("p_brand").agg(F.count("*").alias("messages"))


@query("forbidden_keys", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", with_raw=False)
def _(spark, sf):
    no = table(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf, "supplier").join(no, "s_nationkey", "left_anti").select("s_suppkey", "s_nationkey")


@query("required_subscriptions", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", with_raw=False)
def _(spark, sf):
    yes = table(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf, "supplier").join(yes, "s_nationkey", "left_semi").select("s_suppkey", "s_nationkey")


@query("union_segments", "s AS (SELECT *, seq // 300 AS segment FROM raw) SELECT seq, stream, segment FROM s WHERE segment % 2 = 0 UNION ALL SELECT seq, stream, segment FROM s WHERE segment % 2 = 1 AND kind <> 'error'")
def _(spark, sf):
    d = raw(spark, sf).select("seq", "stream", "kind", F.expr("seq div 300").alias("segment"))
    return d.where("segment % 2 = 0").drop("kind").unionByName(d.where("segment % 2 = 1 AND kind <> 'error'").drop("kind"))
