"""Factor and window queries. Formulas of trade imbalance, cancel rate and intensity are ours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import factors as X
from .base import RAW_SQL, query, raw

HOUR = 3_600_000_000_000
BOOK = "b AS (SELECT seq, instrument_id, recv_ns, price AS bid, price + 1 + qty % 5 AS ask, qty AS bid_qty, price % 100 AS ask_qty FROM raw WHERE kind = 'view')"


def _book(spark, sf):
    return raw(spark, sf).where("kind = 'view'").selectExpr("seq", "instrument_id", "recv_ns", "price AS bid", "price + 1 + qty % 5 AS ask", "qty AS bid_qty", "price % 100 AS ask_qty")


@query("book_imbalance", BOOK + " SELECT seq, CASE WHEN bid_qty + ask_qty <> 0 THEN CAST(bid_qty - ask_qty AS DOUBLE) / CAST(bid_qty + ask_qty AS DOUBLE) END AS imbalance, bid_qty + ask_qty <> 0 AS valid FROM b")
def _(spark, sf):
    i = X.imbalance(F.col("bid_qty"), F.col("ask_qty"))
    return _book(spark, sf).select("seq", i.alias("imbalance"), i.isNotNull().alias("valid"))


@query("microprice", BOOK + " SELECT seq, CASE WHEN bid_qty + ask_qty <> 0 THEN CAST(ask * bid_qty + bid * ask_qty AS DOUBLE) / CAST(bid_qty + ask_qty AS DOUBLE) END AS microprice FROM b")
def _(spark, sf):
    return _book(spark, sf).select("seq", X.microprice(F.col("bid"), F.col("bid_qty"), F.col("ask"), F.col("ask_qty")).alias("microprice"))


W = f"WINDOW w AS (PARTITION BY instrument_id ORDER BY recv_ns RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW)"


@query("trade_imbalance", f"SELECT seq, CAST(sum(CASE WHEN price % 2 = 0 THEN qty ELSE -qty END) OVER w AS BIGINT) AS signed_qty, CAST(sum(qty) OVER w AS BIGINT) AS total_qty, CAST(signed_qty AS DOUBLE) / nullif(total_qty, 0) AS imbalance FROM raw WHERE kind = 'purchase' {W}")
def _(spark, sf):
    signed = F.when(F.col("price") % 2 == 0, F.col("qty")).otherwise(-F.col("qty"))
    d = X.sliding(raw(spark, sf).where("kind = 'purchase'"), ["instrument_id"], "recv_ns", 24 * HOUR, {"signed_qty": F.sum(signed), "total_qty": F.sum("qty")})
    return d.select("seq", "signed_qty", "total_qty", X.ratio(F.col("signed_qty"), F.col("total_qty")).alias("imbalance"))


@query("cancel_rate", f"SELECT seq, count(*) FILTER (WHERE kind = 'error') OVER w AS cancels, count(*) FILTER (WHERE kind = 'click') OVER w AS adds, CAST(cancels AS DOUBLE) / nullif(adds, 0) AS rate FROM raw {W}")
def _(spark, sf):
    n = lambda k: F.count_if(F.col("kind") == k)
    return X.sliding(raw(spark, sf), ["instrument_id"], "recv_ns", 24 * HOUR, {"cancels": n("error"), "adds": n("click")}).select("seq", "cancels", "adds", X.ratio(F.col("cancels"), F.col("adds")).alias("rate"))


@query("trade_intensity", f"SELECT seq, count(*) OVER w AS trades, CAST(count(*) OVER w AS DOUBLE) / 24.0 AS per_hour FROM raw WHERE kind = 'purchase' {W}")
def _(spark, sf):
    d = X.sliding(raw(spark, sf).where("kind = 'purchase'"), ["instrument_id"], "recv_ns", 24 * HOUR, {"trades": F.count("*")})
    return d.select("seq", "trades", (F.col("trades").cast("double") / F.lit(24.0)).alias("per_hour"))


@query("sliding_sum_5s", "SELECT seq, CAST(sum(qty) OVER (PARTITION BY instrument_id ORDER BY recv_ns RANGE BETWEEN 5000000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS qty_5s FROM raw")
def _(spark, sf):
    return X.sliding(raw(spark, sf), ["instrument_id"], "recv_ns", 5_000_000_000, {"qty_5s": F.sum("qty")}, chunks=720).select("seq", "qty_5s")


@query("rolling_primitives", "SELECT seq, CAST(sum(qty) OVER w AS BIGINT) AS s, count(*) OVER w AS n, CAST(sum(qty * qty) OVER w AS BIGINT) AS ss, min(price) OVER w AS lo, max(price) OVER w AS hi, first_value(price) OVER w AS oldest FROM raw WINDOW w AS (PARTITION BY instrument_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    w = Window.partitionBy("instrument_id").orderBy("seq").rowsBetween(-9, 0)
    q = F.col("qty")
    return raw(spark, sf).select("seq", F.sum(q).over(w).alias("s"), F.count("*").over(w).alias("n"), F.sum(q * q).over(w).alias("ss"), F.min("price").over(w).alias("lo"), F.max("price").over(w).alias("hi"), F.first("price").over(w).alias("oldest"))


@query("warmup_valid", "SELECT seq, count(*) FILTER (WHERE kind = 'view') OVER w >= 3 AND count(*) FILTER (WHERE kind = 'purchase') OVER w >= 5 AS valid FROM raw WINDOW w AS (PARTITION BY instrument_id ORDER BY seq)")
def _(spark, sf):
    w = Window.partitionBy("instrument_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda k: F.count_if(F.col("kind") == k).over(w)
    return raw(spark, sf).select("seq", ((n("view") >= 3) & (n("purchase") >= 5)).alias("valid"))


@query("reset_barrier", "r AS (SELECT *, seq // 2500 AS epoch_run FROM raw) SELECT seq, epoch_run, CAST(sum(qty) OVER w AS BIGINT) AS qty_since_reset, count(*) OVER w >= 3 AS warm FROM r WINDOW w AS (PARTITION BY instrument_id, epoch_run ORDER BY seq)")
def _(spark, sf):
    w = Window.partitionBy("instrument_id", "epoch_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return raw(spark, sf).withColumn("epoch_run", F.expr("seq div 2500")).select("seq", "epoch_run", F.sum("qty").over(w).alias("qty_since_reset"), (F.count("*").over(w) >= 3).alias("warm"))


@query("cross_section", f"SELECT recv_ns // {HOUR} AS slot, instrument_id, arg_max(price, seq) AS price FROM raw WHERE kind = 'view' GROUP BY ALL")
def _(spark, sf):
    return raw(spark, sf).where("kind = 'view'").groupBy(F.expr(f"recv_ns div {HOUR}").alias("slot"), "instrument_id").agg(F.max_by("price", "seq").alias("price"))


@query("ewma_price", f"""WITH RECURSIVE {RAW_SQL}, o AS (SELECT instrument_id, seq, price, row_number() OVER (PARTITION BY instrument_id ORDER BY seq) AS i FROM raw),
e AS (SELECT *, CAST(price AS DOUBLE) AS y FROM o WHERE i = 1 UNION ALL SELECT o.*, coalesce(0.2::DOUBLE * o.price + 0.8::DOUBLE * e.y, e.y, o.price) FROM e JOIN o ON o.instrument_id = e.instrument_id AND o.i = e.i + 1)
SELECT instrument_id, seq, price, round(y, 6) AS ewma FROM e""", with_raw=False)
def _(spark, sf):
    return X.ewma(raw(spark, sf), ["instrument_id"], "seq", "price", 0.2).withColumn("ewma", F.round("ewma", 6))


@query("factor_batch_invariance", "SELECT instrument_id, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n FROM raw GROUP BY instrument_id")
def _(spark, sf):
    d = raw(spark, sf).groupBy("instrument_id", F.expr("seq div 777").alias("batch")).agg(F.sum("qty").alias("q"), F.count("*").alias("c"))
    return d.groupBy("instrument_id").agg(F.sum("q").alias("qty"), F.sum("c").alias("n"))
