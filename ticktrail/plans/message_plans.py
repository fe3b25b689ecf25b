"""Queries of control messages, identifiers, pacing and saturating totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import depth_clamped
from ..operators import messages as M
from ..operators.market import accumulated
from .base import RAW_SQL, query, raw, table


@query("connection_events", """m AS (SELECT seq, CASE kind WHEN 'signup' THEN 'CONNECTING' WHEN 'click' THEN 'CONNECT_ERROR' WHEN 'error' THEN 'DISCONNECTED' ELSE kind END AS k, 100 + (qty % 7 = 0)::INT AS version,
  CASE WHEN price % 11 <> 0 THEN 'host' || (seq % 3) END AS address, CASE WHEN price % 13 <> 0 THEN 'code ' || qty END AS err FROM raw),
f AS (SELECT *, CASE WHEN k NOT IN ('CONNECTING', 'CONNECT_ERROR', 'DISCONNECTED') THEN 'UNSUPPORTED_MESSAGE' WHEN version <> 100 THEN 'UNSUPPORTED_VERSION' WHEN address IS NULL OR (k <> 'CONNECTING' AND err IS NULL) THEN 'UNREADABLE_TEXT' END AS fault FROM m)
SELECT seq, CASE WHEN fault IS NULL THEN k END AS control_type, fault AS decode_error, CASE WHEN fault IS NULL THEN sha256('address:' || address) END AS address_sha256, CASE WHEN fault IS NULL AND k <> 'CONNECTING' THEN sha256('error:' || err) END AS error_text_sha256 FROM f""")
def _(spark, sf):
    kind = F.expr("CASE kind WHEN 'signup' THEN 'CONNECTING' WHEN 'click' THEN 'CONNECT_ERROR' WHEN 'error' THEN 'DISCONNECTED' ELSE kind END")
    address, err = F.when(F.col("price") % 11 != 0, F.concat(F.lit("host"), F.col("seq") % 3)), F.when(F.col("price") % 13 != 0, F.concat(F.lit("code "), "qty"))
    return raw(spark, sf).select("seq", M.connection_event(kind, F.expr("100 + int(qty % 7 = 0)"), address, err, 100).alias("e")).select("seq", "e.*")


@query("logon_responses", """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS s, unnest([l_partkey % 9, 9 + l_suppkey % 9, l_suppkey % 9]) AS m, l_linenumber % 2 AS st FROM lineitem),
g AS (SELECT k, count(*) AS n, count(DISTINCT (s, m)) AS d, string_agg(s || ',1,' || m || ',' || st, ';' ORDER BY s, m, st) AS t FROM s GROUP BY k)
SELECT k, CASE WHEN n = d THEN CASE WHEN k % 3 = 0 THEN 'LOGON_SUCCESS' ELSE 'LOGON_FAILURE' END END AS control_type, CASE WHEN n <> d THEN 'DUPLICATE_KEY' END AS decode_error, CASE WHEN n = d THEN n END AS entries, CASE WHEN n = d THEN sha256('manifest:' || t) END AS manifest_sha256 FROM g""", with_raw=False)
def _(spark, sf):
    ids = F.array(F.col("l_partkey") % 9, F.col("l_suppkey") % 9 + 9, F.col("l_suppkey") % 9)
    messages = F.transform(ids, lambda i: F.struct(i.alias("message_id"), (F.col("l_linenumber") % 2).alias("status")))
    service = F.struct(F.col("l_linenumber").alias("service_id"), F.lit(1).alias("service_version"), messages.alias("messages"))
    d = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(service).alias("services"))
    return d.select("k", M.logon_response(F.col("k") % 3, F.col("services")).alias("r")).select("k", "r.*")


@query("valid_bodies", "SELECT kind, count(*) AS bodies, count(*) FILTER (WHERE body + price >= 40 AND (qty % 5 = 0 OR (30 + price % 30 >= 40 AND 30 + price % 30 + qty % 5 * 8 <= body + price))) AS valid FROM raw GROUP BY kind")
def _(spark, sf):
    ok = M.body_valid(F.col("body") + F.col("price"), 40, [(F.col("price") % 30 + 30, F.col("qty") % 5, 8)])
    return raw(spark, sf).groupBy("kind").agg(F.count("*").alias("bodies"), F.count_if(ok).alias("valid"))


@query("identifier_choice", "SELECT seq, CASE WHEN qty % 9 < 2 THEN 'S' || instrument_id WHEN qty % 9 < 7 THEN 'I' || price END AS identifier FROM raw")
def _(spark, sf):
    named = M.identifier(F.col("qty") % 9, F.concat(F.lit("S"), "instrument_id"), F.concat(F.lit("I"), "price"), [0, 1], [2, 3, 4, 5, 6])
    return raw(spark, sf).select("seq", named.alias("identifier"))


@query("paced_deadlines", """m AS (SELECT *, kind IN ('click', 'purchase') AS m FROM raw), s AS (SELECT *, m AND NOT coalesce(lag(m) OVER (PARTITION BY stream ORDER BY seq), false) AS st FROM m),
g AS (SELECT *, sum(st::INT) OVER (PARTITION BY stream ORDER BY seq) AS run FROM s) SELECT stream, seq, first_value(recv_ns) OVER w + 250000000 * row_number() OVER w AS deadline FROM g WHERE m WINDOW w AS (PARTITION BY stream, run ORDER BY seq)""")
def _(spark, sf):
    return M.paced(raw(spark, sf), ["stream"], "seq", "recv_ns", F.col("kind").isin("click", "purchase"), 250_000_000).select("stream", "seq", "deadline")


@query("accepted_lots", "WITH RECURSIVE " + RAW_SQL + """, p AS (SELECT seq, instrument_id, price, qty, row_number() OVER (PARTITION BY instrument_id ORDER BY seq) AS n FROM raw WHERE kind = 'purchase'),
r AS (SELECT instrument_id, 0::BIGINT AS n, NULL::BIGINT AS seq, 0::BIGINT AS accepted, 0::BIGINT AS volume, 0::BIGINT AS turnover FROM (SELECT DISTINCT instrument_id FROM p)
  UNION ALL SELECT instrument_id, n, seq, take, volume + take, turnover + take * price FROM (SELECT r.instrument_id, p.n, p.seq, r.volume, r.turnover, p.price,
    CASE WHEN p.price > 0 AND p.qty > 0 THEN least(p.qty, 400 - r.volume, (3000000 - r.turnover) // p.price) // 10 * 10 ELSE 0 END AS take FROM r JOIN p ON p.instrument_id = r.instrument_id AND p.n = r.n + 1))
SELECT seq, instrument_id, accepted, volume, turnover FROM r WHERE n > 0""", with_raw=False)
def _(spark, sf):
    d = raw(spark, sf).where("kind = 'purchase'").select("seq", "instrument_id", "price", "qty")
    return accumulated(d, ["instrument_id"], "seq", "price", "qty", 10, 400, 3_000_000).select("seq", "instrument_id", "accepted", "volume", "turnover")


@query("depth_clamped", """c AS (SELECT seq, price, qty % 12 AS depth, 9 * (instrument_id % 50 + 10) * 10 AS lower, 11 * (instrument_id % 50 + 10) * 10 AS upper FROM raw), f AS (SELECT *, least(upper, lower + 10 * (depth + 2)) AS lo FROM c)
SELECT seq, greatest(lo, least(price, greatest(lo, upper - 10 * (depth + 2)))) AS price FROM f""")
def _(spark, sf):
    by = F.col("instrument_id") % 50 + 10
    return raw(spark, sf).select("seq", depth_clamped(F.col("price"), by * 90, by * 110, F.lit(10), F.col("qty") % 12).alias("price"))
