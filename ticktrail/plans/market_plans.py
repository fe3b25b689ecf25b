"""Tick, book, order and join queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.bits import BIT
from ..functions.fixed import div
from ..operators import market as M
from ..operators.frontier import idle_frontiers, released
from ..operators.ordered import prefix, tasks
from .base import query, raw, table

ACTION = "CASE qty % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'D' WHEN 2 THEN 'T' ELSE 'S' END"
SIDE = "CASE WHEN price % 2 = 0 THEN 'B' ELSE 'S' END"


@query("validity_matrix", f"t AS (SELECT *, {ACTION} AS a, {SIDE} AS s FROM raw)," + """
v AS (SELECT seq, a AS action, CASE WHEN a IN ('A', 'T') THEN price END AS price, CASE WHEN a IN ('A', 'D', 'T') THEN qty END AS qty, CASE WHEN a = 'T' THEN price * qty END AS amount,
  CASE WHEN a = 'T' OR (a IN ('A', 'D') AND s = 'B') THEN seq END AS buy_order_id, CASE WHEN a = 'T' OR (a IN ('A', 'D') AND s = 'S') THEN instrument_id END AS sell_order_id,
  CASE WHEN a IN ('A', 'D') THEN s END AS side, CASE WHEN a = 'T' THEN s END AS aggressor FROM t)
SELECT *, CAST((price IS NOT NULL)::INT * 1 + (qty IS NOT NULL)::INT * 2 + (amount IS NOT NULL)::INT * 4 + (buy_order_id IS NOT NULL)::INT * 32 + (sell_order_id IS NOT NULL)::INT * 64
  + (side IS NOT NULL)::INT * 128 + (aggressor IS NOT NULL)::INT * 512 AS BIGINT) AS validity FROM v""")
def _(spark, sf):
    a, s = F.expr(ACTION), F.expr(SIDE)
    c = F.col
    got = M.tick_fields(a, c("price"), c("qty"), c("price") * c("qty"), c("seq"), c("instrument_id"), s)
    return raw(spark, sf).select("seq", a.alias("action"), *[v.alias(k) for k, v in got.items()])


@query("matched_qty", f"SELECT seq, CASE WHEN price >= 0 AND price % 1000 = 0 THEN price // 1000 END AS matched_qty, CAST(CASE WHEN price >= 0 AND price % 1000 = 0 THEN 0 ELSE {BIT['NON_INTEGRAL_MATCHED_QTY']} END AS BIGINT) AS flags FROM raw")
def _(spark, sf):
    q, f = M.matched_qty(F.col("price"))
    return raw(spark, sf).select("seq", q.alias("matched_qty"), f.alias("flags"))


@query("order_enums", "SELECT seq, CASE 49 + qty % 25 WHEN 49 THEN 'BUY' WHEN 50 THEN 'SELL' WHEN 71 THEN 'BORROW' WHEN 70 THEN 'LEND' ELSE 'UNKNOWN' END AS side, CASE 49 + qty % 40 WHEN 49 THEN 'MARKET' WHEN 50 THEN 'LIMIT' WHEN 85 THEN 'BEST_OWN' ELSE 'UNKNOWN' END AS order_type, CASE WHEN qty % 40 = 1 THEN price END AS price FROM raw")
def _(spark, sf):
    kind = M.enum_name(F.expr("49 + qty % 40"), M.ORDER_TYPES)
    return raw(spark, sf).select("seq", M.enum_name(F.expr("49 + qty % 25"), M.SIDES).alias("side"), kind.alias("order_type"), F.when(kind == "LIMIT", F.col("price")).alias("price"))


@query("cancel_side", f"SELECT seq, CASE WHEN (price % 2 <> 0) <> (qty % 2 <> 0) THEN CASE WHEN price % 2 <> 0 THEN 'BUY' ELSE 'SELL' END END AS side, CAST(CASE WHEN (price % 2 <> 0) <> (qty % 2 <> 0) THEN 0 ELSE {BIT['AMBIGUOUS_ORDER_REFERENCE']} END AS BIGINT) AS flags FROM raw")
def _(spark, sf):
    s, f = M.cancel_side(F.expr("price % 2"), F.expr("qty % 2"))
    return raw(spark, sf).select("seq", s.alias("side"), f.alias("flags"))


@query("phase_carry", "SELECT seq, stream, coalesce(last_value(CASE WHEN kind = 'signup' THEN 'PHASE_' || qty % 7 END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY seq), 'UNKNOWN') AS phase FROM raw")
def _(spark, sf):
    e = F.when(F.col("kind") == "signup", F.concat(F.lit("PHASE_"), F.col("qty") % 7))
    return prefix(raw(spark, sf), ["stream"], "seq", {"p": ("last", e)}).select("seq", "stream", F.coalesce("p", F.lit("UNKNOWN")).alias("phase"))


@query("registry_join", f"SELECT seq, coalesce(c_custkey, -instrument_id - 1) AS registered_id, c_custkey IS NULL AS temporary, (coalesce(c_custkey, -instrument_id - 1) % 16 + 16) % 16 AS shard, CAST(CASE WHEN c_custkey IS NULL THEN {BIT['INSTRUMENT_UNKNOWN']} ELSE 0 END AS BIGINT) AS flags FROM raw LEFT JOIN customer ON instrument_id = c_custkey AND c_custkey % 10 <> 3")
def _(spark, sf):
    reg = table(spark, sf, "customer").where("c_custkey % 10 <> 3").select("c_custkey")
    d = raw(spark, sf).join(reg, F.col("instrument_id") == F.col("c_custkey"), "left")
    i = F.coalesce("c_custkey", -F.col("instrument_id") - 1)
    return d.select("seq", i.alias("registered_id"), F.col("c_custkey").isNull().alias("temporary"), F.pmod(i, F.lit(16)).alias("shard"), F.when(F.col("c_custkey").isNull(), F.lit(BIT["INSTRUMENT_UNKNOWN"])).otherwise(F.lit(0)).cast("long").alias("flags"))


@query("ohlc_daily", "SELECT instrument_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS trade_date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume, CAST(sum(price * qty) AS BIGINT) AS turnover, count(*) AS trades FROM raw WHERE kind = 'purchase' GROUP BY ALL")
def _(spark, sf):
    return raw(spark, sf).where("kind = 'purchase'").groupBy("instrument_id", F.date_format("ts", "yyyy-MM-dd").alias("trade_date")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("volume"), F.sum(F.col("price") * F.col("qty")).alias("turnover"), F.count("*").alias("trades"),
    )


@query("cum_volume", "SELECT seq, instrument_id, CAST(sum(qty) OVER w AS BIGINT) AS volume, CAST(sum(price * qty) OVER w AS BIGINT) AS turnover FROM raw WHERE kind = 'purchase' WINDOW w AS (PARTITION BY instrument_id ORDER BY seq)")
def _(spark, sf):
    d = raw(spark, sf).where("kind = 'purchase'")
    d = prefix(d, ["instrument_id"], "seq", {"volume": ("sum", F.col("qty")), "turnover": ("sum", F.col("price") * F.col("qty"))})
    return d.select("seq", "instrument_id", "volume", "turnover")


@query("average_price", "SELECT instrument_id, CASE WHEN sum(qty) = 0 THEN arg_max(price, seq) ELSE CAST(sum(price * qty) AS BIGINT) // CAST(sum(qty) AS BIGINT) END AS average_price FROM raw WHERE kind = 'purchase' GROUP BY instrument_id")
def _(spark, sf):
    g = raw(spark, sf).where("kind = 'purchase'").groupBy("instrument_id").agg(F.sum("qty").alias("q"), F.sum(F.col("price") * F.col("qty")).alias("t"), F.max_by("price", "seq").alias("l"))
    return g.select("instrument_id", F.when(F.col("q") == 0, F.col("l")).otherwise(div(F.col("t"), F.when(F.col("q") != 0, F.col("q")))).alias("average_price"))


BOOK_SQL = "bk AS (SELECT l_orderkey AS k, list({'p': CAST(round(l_extendedprice * 100) AS BIGINT), 'q': CAST(l_quantity AS BIGINT)} ORDER BY CAST(round(l_extendedprice * 100) AS BIGINT) DESC, CAST(l_quantity AS BIGINT) DESC) AS levels FROM lineitem GROUP BY l_orderkey)"


def _book(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("p"), F.col("l_quantity").cast("long").alias("q"))
    return li.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("p", "q")), asc=False).alias("levels"))


@query("book_depth_slice", "WITH " + BOOK_SQL + " SELECT k AS book_id, CAST(len(levels) AS INTEGER) AS actual_depth, CAST(least(len(levels), 3) AS INTEGER) AS depth, len(levels) > 3 AS truncated, levels[1].p AS best_price, levels[least(len(levels), 3)].p AS last_price FROM bk", with_raw=False)
def _(spark, sf):
    top = F.slice("levels", 1, 3)
    return _book(spark, sf).select(F.col("k").alias("book_id"), F.size("levels").alias("actual_depth"), F.size(top).alias("depth"), (F.size("levels") > 3).alias("truncated"), F.col("levels")[0]["p"].alias("best_price"), F.element_at(top, -1)["p"].alias("last_price"))


@query("snapshot_sides", """o AS (SELECT stream, kind, price % 2 = 0 AS is_bid, price // 500 AS price, seq, qty FROM raw), l AS (SELECT stream, kind, is_bid, price, sum(qty) AS q, count(*) AS n FROM o GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY stream, kind, is_bid ORDER BY CASE WHEN is_bid THEN -price ELSE price END) AS at, count(*) OVER (PARTITION BY stream, kind, is_bid) AS actual_depth FROM l),
f AS (SELECT o.stream, o.kind, o.is_bid, o.qty, o.seq, row_number() OVER (PARTITION BY o.stream, o.kind, o.is_bid ORDER BY o.seq) AS r FROM o JOIN a ON a.at = 1 AND o.stream = a.stream AND o.kind = a.kind AND o.is_bid = a.is_bid AND o.price = a.price),
z AS (SELECT stream, kind, is_bid, string_agg(qty, ',' ORDER BY seq) AS queue FROM f WHERE r <= 50 GROUP BY ALL)
SELECT a.stream, a.kind, a.is_bid, a.actual_depth, string_agg(a.price || ':' || CAST(a.q AS BIGINT) || ':' || a.n, ',' ORDER BY a.at) AS levels, any_value(z.queue) AS queue, CAST(max(CASE WHEN a.at = 1 THEN a.n END) AS BIGINT) AS queue_orders
FROM a JOIN z ON a.stream = z.stream AND a.kind = z.kind AND a.is_bid = z.is_bid WHERE a.at <= 10 GROUP BY ALL""")
def _(spark, sf):
    d = raw(spark, sf).select("stream", "kind", (F.col("price") % 2 == 0).alias("bid"), F.expr("price div 500").alias("price"), "seq", "qty")
    b = M.book_sides(d, ["stream", "kind"], F.col("bid"), "price", "qty", "seq")
    text = F.array_join(F.transform("levels", lambda x: F.concat_ws(":", x["price"], x["qty"], x["orders"])), ",")
    return b.select("stream", "kind", "is_bid", "actual_depth", text.alias("levels"), F.array_join(F.transform("queue", lambda q: q.cast("string")), ",").alias("queue"), "queue_orders")


@query("weighted_price", "WITH " + BOOK_SQL + " SELECT k AS book_id, CAST(list_sum(list_transform(levels, lambda x: x.p * x.q)) AS BIGINT) // CAST(nullif(list_sum(list_transform(levels, lambda x: x.q)), 0) AS BIGINT) AS weighted_price, CAST(list_sum(list_transform(levels, lambda x: x.q)) AS BIGINT) AS total_qty FROM bk", with_raw=False)
def _(spark, sf):
    total = F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + x["q"])
    return _book(spark, sf).select(F.col("k").alias("book_id"), M.weighted_price(F.col("levels")).alias("weighted_price"), total.alias("total_qty"))


@query("latest_state", "SELECT instrument_id, seq, kind, CASE WHEN kind = 'view' THEN price END AS price, qty FROM raw QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY recv_ns DESC, seq DESC) = 1")
def _(spark, sf):
    d = raw(spark, sf).select("instrument_id", "seq", "kind", F.when(F.col("kind") == "view", F.col("price")).alias("price"), "qty", "recv_ns")
    return M.latest(d, ["instrument_id"], ["recv_ns", "seq"]).drop("recv_ns")


@query("asof_snapshot", "t AS (SELECT * FROM raw WHERE kind = 'purchase'), s AS (SELECT * FROM raw WHERE kind = 'view') SELECT t.seq, t.instrument_id, t.price, s.seq AS snapshot_seq, s.price AS snapshot_price FROM t ASOF LEFT JOIN s ON t.instrument_id = s.instrument_id AND t.recv_ns >= s.recv_ns")
def _(spark, sf):
    d = raw(spark, sf).select("instrument_id", "recv_ns", "seq", "kind", "price")
    t, s = d.where("kind = 'purchase'").drop("kind"), d.where("kind = 'view'").select("instrument_id", "recv_ns", "seq", F.col("seq").alias("snapshot_seq"), F.col("price").alias("snapshot_price"))
    return M.asof(t, s, ["instrument_id"], "recv_ns", "seq", ["snapshot_seq", "snapshot_price"]).select("seq", "instrument_id", "price", "snapshot_seq", "snapshot_price")


@query("live_latest", f"s AS (SELECT instrument_id, arg_max(price, seq) AS latest_price FROM raw WHERE kind = 'view' GROUP BY 1) SELECT seq, latest_price, CAST({BIT['NONDETERMINISTIC_LIVE_LATEST']} AS BIGINT) AS flags FROM raw LEFT JOIN s USING (instrument_id) WHERE kind = 'purchase'")
def _(spark, sf):
    d = raw(spark, sf)
    s = d.where("kind = 'view'").groupBy("instrument_id").agg(F.max_by("price", "seq").alias("latest_price"))
    return d.where("kind = 'purchase'").join(s, "instrument_id", "left").select("seq", "latest_price", F.lit(BIT["NONDETERMINISTIC_LIVE_LATEST"]).alias("flags"))


@query("mux_order", "SELECT seq, seq // 2500 AS epoch, row_number() OVER (PARTITION BY seq // 2500 ORDER BY recv_ns, stream, seq) AS place FROM raw")
def _(spark, sf):
    d = raw(spark, sf).select("seq", F.expr("seq div 2500").alias("epoch"), "recv_ns", "stream")
    return M.mux(d, ["epoch"], "recv_ns", ["stream", "seq"]).select("seq", "epoch", "place")


@query("book_lookup", "SELECT instrument_id, max(seq) AS seq FROM raw WHERE kind = 'view' AND instrument_id IN (1, 5, 7, 11) GROUP BY 1")
def _(spark, sf):
    ids = spark.createDataFrame([(i,) for i in (1, 5, 7, 11)], "instrument_id long")
    return raw(spark, sf).where("kind = 'view'").join(F.broadcast(ids), "instrument_id", "left_semi").groupBy("instrument_id").agg(F.max("seq").alias("seq"))


@query("order_reference", "SELECT l_orderkey, l_linenumber, count(*) AS rows, max(o_orderkey) IS NOT NULL AS known FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o ON l_orderkey = o_orderkey GROUP BY ALL", with_raw=False)
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select("o_orderkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    n = tasks(spark, li.count())
    # Both sides dealt by order: the join and the groups, nearly as many as rows, need no more; a broadcast would hold all orders in every executor.
    d = li.repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return d.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("rows"), F.max("o_orderkey").isNotNull().alias("known"))


@query("stale_snapshot", f"p AS (SELECT *, lag(recv_ns) OVER (PARTITION BY instrument_id ORDER BY seq) AS prev FROM raw WHERE kind = 'view') SELECT seq, recv_ns - prev AS age_ns, CAST(CASE WHEN recv_ns - prev > CASE WHEN qty % 2 = 0 THEN 3600000000000 ELSE 7200000000000 END THEN {BIT['SNAPSHOT_STALE']} ELSE 0 END AS BIGINT) AS flags FROM p WHERE prev IS NOT NULL")
def _(spark, sf):
    d = raw(spark, sf).where("kind = 'view'").withColumn("prev", F.lag("recv_ns").over(Window.partitionBy("instrument_id").orderBy("seq"))).where("prev IS NOT NULL")
    age = F.col("recv_ns") - F.col("prev")
    limit = F.when(F.col("qty") % 2 == 0, F.lit(3_600_000_000_000)).otherwise(F.lit(7_200_000_000_000))
    return d.select("seq", age.alias("age_ns"), F.when(age > limit, F.lit(BIT["SNAPSHOT_STALE"])).otherwise(F.lit(0)).cast("long").alias("flags"))


@query("market_normalised", "SELECT seq, 'order' AS message, price, CAST(NULL AS BIGINT) AS last_price, qty FROM raw WHERE kind = 'click' UNION ALL SELECT seq, 'trade', price, price, qty FROM raw WHERE kind = 'purchase' UNION ALL SELECT seq, 'snapshot', NULL, price, NULL FROM raw WHERE kind = 'view'")
def _(spark, sf):
    d = raw(spark, sf)
    o = d.where("kind = 'click'").select("seq", F.lit("order").alias("message"), "price", "qty")
    t = d.where("kind = 'purchase'").select("seq", F.lit("trade").alias("message"), "price", F.col("price").alias("last_price"), "qty")
    s = d.where("kind = 'view'").select("seq", F.lit("snapshot").alias("message"), F.col("price").alias("last_price"))
    return o.unionByName(t, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)


@query("status_flatten", "WITH s AS (SELECT n_regionkey, unnest([n_nationkey, n_nationkey + 100]) AS message_id, n_nationkey % 3 AS status FROM nation) SELECT n_regionkey, count(*) AS entries, count(DISTINCT message_id) AS distinct_entries, bool_and(status = 0) AS accepted FROM s GROUP BY n_regionkey", with_raw=False)
def _(spark, sf):
    st = F.transform(F.array(F.col("n_nationkey"), F.col("n_nationkey") + 100), lambda m: F.struct(m.alias("message_id"), (F.col("n_nationkey") % 3).alias("status")))
    g = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.flatten(F.collect_list(st)).alias("st"))
    ids = F.array_sort(F.transform("st", lambda x: x["message_id"]))
    return g.select("n_regionkey", F.size("st").cast("long").alias("entries"), F.size(F.array_distinct(ids)).cast("long").alias("distinct_entries"), F.forall("st", lambda x: x["status"] == 0).alias("accepted"))


@query("safe_frontier", """s AS (SELECT stream, recv_ns + 1000000000 AS now_ns, qty % 5 <> 0 AND qty % 7 <> 0 AND qty % 11 <> 0 AND price % 13 <> 0 AS idle FROM raw WHERE seq % 10 = 0),
i AS (SELECT stream, max(now_ns) FILTER (WHERE idle) AS idle_to FROM s GROUP BY stream), e AS (SELECT * FROM raw WHERE seq % 10 <> 0),
b AS (SELECT stream, greatest(top, idle_to) AS bound FROM (SELECT stream, max(recv_ns) AS top FROM e GROUP BY stream) FULL JOIN i USING (stream)),
l AS (SELECT x.stream, min(y.bound) AS until, count(y.bound) AS n FROM b x JOIN b y ON x.stream <> y.stream GROUP BY x.stream)
SELECT stream, count(*) AS released, max(recv_ns) AS released_to FROM e JOIN l USING (stream) WHERE recv_ns <= until AND n = 3 GROUP BY stream""")
def _(spark, sf):
    d = raw(spark, sf)
    off = lambda e: F.when(F.expr(e), 1).otherwise(0)
    samples = d.where("seq % 10 = 0").select(
        "stream", (F.col("recv_ns") + 1_000_000_000).alias("now_ns"), F.when(F.expr("price % 13 = 0"), "DISCONNECTED").otherwise("HEALTHY").alias("state"), F.col("seq").alias("captured"),
        F.col("seq").alias("appended"), (F.col("seq") - off("qty % 5 = 0")).alias("processed"), F.lit(0).alias("inflight"), (F.col("seq") + off("qty % 7 = 0")).alias("captured_again"),
        F.col("seq").alias("appended_again"), off("qty % 11 = 0").alias("inflight_again"),
    )
    out = released(d.where("seq % 10 <> 0"), idle_frontiers(samples, "stream"), "stream", "recv_ns", [0, 1, 2, 3])
    return out.groupBy("stream").agg(F.count("*").alias("released"), F.max("recv_ns").alias("released_to"))
