"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock as K
from ..functions import fixed as X
from ..functions.hashing import clock_epoch
from .base import query, raw, table


@query("fixed_point_p6", "SELECT seq, price * 10000 AS price_p6, price * 1000000 AS whole_p6, CASE WHEN price < 0 THEN '-' ELSE '' END || (abs(price) // 100) || '.' || lpad(CAST(abs(price) % 100 AS VARCHAR), 2, '0') AS price_text FROM raw")
def _(spark, sf):
    p = F.col("price")
    return raw(spark, sf).select("seq", X.to_p6(p, 2).alias("price_p6"), X.to_p6(p, 0).alias("whole_p6"), X.fixed_text(p, 2).alias("price_text"))


@query("saturating_arithmetic", "SELECT seq, CAST(least(price::HUGEINT * 5000000000000000, 9223372036854775807) AS BIGINT) AS product, CAST(least(qty::HUGEINT + 9223372036854775800, 9223372036854775807) AS BIGINT) AS total, CAST(greatest(least(price * 1000000, 2147483647), -2147483648) AS INTEGER) AS narrow, price * 10 AS up, price // 100 AS down FROM raw WHERE price >= 0")
def _(spark, sf):
    p = F.col("price")
    return raw(spark, sf).where("price >= 0").select("seq", X.saturating_multiply(p, F.lit(5_000_000_000_000_000)).alias("product"), X.saturating_add(F.col("qty"), F.lit(9_223_372_036_854_775_800)).alias("total"), X.narrow_i32(p * 1_000_000).alias("narrow"), X.rescale_milli(p, 4).alias("up"), X.rescale_milli(p, 1).alias("down"))


@query("mul_div", "SELECT seq, CAST((seq + 1000003)::HUGEINT * (price + 1000000000000) // (qty + 1) AS BIGINT) AS scaled FROM raw")
def _(spark, sf):
    return raw(spark, sf).select("seq", X.mul_div(F.expr("seq + 1000003"), F.expr("price + 1000000000000"), F.expr("qty + 1")).alias("scaled"))


@query("price_limits", "SELECT seq, ((price * (100 - p) + 99) // 100 + 4) // 5 * 5 AS lower_limit, (price * (100 + p) // 100) // 5 * 5 AS upper_limit FROM (SELECT *, CASE WHEN kind = 'view' THEN 20 ELSE 10 END AS p FROM raw)")
def _(spark, sf):
    lo, hi = X.price_limits(F.col("price"), F.lit(5), F.col("kind") == "view")
    return raw(spark, sf).select("seq", lo.alias("lower_limit"), hi.alias("upper_limit"))


TOD = "t AS (SELECT seq, ts, (epoch_us(ts) // 1000) % 86400000 AS ms FROM raw), h AS (SELECT *, ms // 3600000 * 10000000 + ms // 60000 % 60 * 100000 + ms // 1000 % 60 * 1000 + ms % 1000 AS t9 FROM t)"


@query("time_codec", TOD + " SELECT seq, t9 AS hhmmssmmm, ms AS millis, substr(lpad(CAST(t9 AS VARCHAR), 9, '0'), 1, 2) || ':' || substr(lpad(CAST(t9 AS VARCHAR), 9, '0'), 3, 2) || ':' || substr(lpad(CAST(t9 AS VARCHAR), 9, '0'), 5, 2) || '.' || substr(lpad(CAST(t9 AS VARCHAR), 9, '0'), 7, 3) AS time_text FROM h")
def _(spark, sf):
    t = K.encode_hhmmssmmm(K.millis_of_day(F.col("ts")))
    return raw(spark, sf).select("seq", t.alias("hhmmssmmm"), K.decode_hhmmssmmm(t).alias("millis"), K.time_text(t).alias("time_text"))


@query("session_time", TOD + " SELECT seq, t9 BETWEEN 93000000 AND 113000000 OR t9 BETWEEN 130000000 AND 150000000 AS in_session FROM h")
def _(spark, sf):
    return raw(spark, sf).select("seq", K.in_session(K.encode_hhmmssmmm(K.millis_of_day(F.col("ts")))).alias("in_session"))


@query("exchange_time_ns", TOD + " SELECT seq, (epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) // 1000 + ms - 28800000) * 1000000 AS exchange_time_ns FROM h")
def _(spark, sf):
    return raw(spark, sf).select("seq", K.exchange_ns(F.to_date("ts"), K.encode_hhmmssmmm(K.millis_of_day(F.col("ts")))).alias("exchange_time_ns"))


@query("trading_calendar", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT CAST(d AS VARCHAR) AS trade_date, CAST(dayofweek(d) AS INTEGER) AS weekday, CAST(CASE dayofweek(d) WHEN 5 THEN d + 3 WHEN 6 THEN d + 2 ELSE d + 1 END AS VARCHAR) AS next_trading_day FROM d", with_raw=False)
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select(F.col("d").cast("string").alias("trade_date"), K.weekday(F.col("d")).alias("weekday"), K.next_trading_day(F.col("d")).cast("string").alias("next_trading_day"))


def _framed(f):
    return f"unhex(lpad(to_hex(octet_length(encode({f}))), 8, '0')) || encode({f})"


@query("clock_epoch_id", f"""c AS (SELECT DISTINCT kind, 'bööt' || stream AS boot, CASE WHEN qty % 9 = 0 THEN '' ELSE 'tsc' || (qty % 3) END AS clock FROM raw),
d AS (SELECT *, CASE WHEN clock <> '' THEN sha256(encode('clock-epoch') || unhex('00') || {_framed("kind")} || {_framed("boot")} || {_framed("clock")}) END AS digest FROM c) SELECT kind, boot, clock, digest, digest[1:16] AS label FROM d""")
def _(spark, sf):
    c = raw(spark, sf).select("kind", F.concat(F.lit("bööt"), "stream").alias("boot"), F.expr("CASE WHEN qty % 9 = 0 THEN '' ELSE concat('tsc', qty % 3) END").alias("clock")).distinct()
    digest, label = clock_epoch(F.col("kind"), F.col("boot"), F.col("clock"))
    return c.select("kind", "boot", "clock", digest.alias("digest"), label.alias("label"))


@query("hex_keys", "SELECT seq, lpad(lower(to_hex(seq)), 16, '0') || '-' || lpad(lower(to_hex(stream)), 4, '0') AS file_key FROM raw")
def _(spark, sf):
    return raw(spark, sf).select("seq", F.concat(F.lpad(F.lower(F.hex("seq")), 16, "0"), F.lit("-"), F.lpad(F.lower(F.hex("stream")), 4, "0")).alias("file_key"))


@query("canonical_json", "SELECT seq, '{\"seq\":\"' || seq || '\",\"stream\":' || stream || ',\"kind\":\"' || kind || '\"}' AS doc FROM raw")
def _(spark, sf):
    return raw(spark, sf).select("seq", F.to_json(F.struct(F.col("seq").cast("string").alias("seq"), "stream", "kind")).alias("doc"))


@query("record_checksums", """WITH t AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 2197175160) ELSE a >> 1 END) AS c FROM range(256) r(i)))
SELECT event_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(props, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, t.crc[(xor(a, b) & 255) + 1])), 4294967295) AS crc32c, sha256(props) AS sha256 FROM events, t""", with_raw=False)
def _(spark, sf):
    from ..functions.hashing import crc32c

    e = table(spark, sf, "events").select("event_id", F.col("props").cast("binary").alias("b"))
    return e.select("event_id", crc32c(F.col("b")).alias("crc32c"), F.sha2("b", 256).alias("sha256"))
