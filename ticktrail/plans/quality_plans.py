"""Sequence guard, quality bits and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bits import BIT, QUALITY_BITS, masks_pass
from ..functions.bits import names as bit_names
from ..functions import hashing
from ..operators.control import sequence_guard
from ..operators.lake import merge_tiers, offered, reconcile
from ..operators.ordered import prefix
from ..operators.replay import positions
from ..sources import faults, injected
from .base import query, raw, table
from .replay_plans import POS_SQL

COLS = ["l_partkey", "l_suppkey", "cents", "qty", "ship"]
GUARD = """WITH l AS (SELECT l_orderkey AS scope, CAST(l_linenumber AS BIGINT) AS s, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty, epoch_us(l_shipdate) AS ship FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ship, l_partkey, l_suppkey, cents, qty, s) AS i FROM l),
g AS (SELECT *, l_suppkey AS p, max(s) OVER (PARTITION BY scope ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
  first_value(l_suppkey) OVER (PARTITION BY scope, s ORDER BY i) AS fp, row_number() OVER (PARTITION BY scope, s ORDER BY i) AS n FROM o),
v AS (SELECT *, CASE WHEN top IS NULL THEN 'FIRST_OBSERVED' WHEN n > 1 AND p = fp THEN 'EXACT_DUPLICATE' WHEN n > 1 THEN 'CONFLICT_DUPLICATE' WHEN s = top + 1 THEN 'CONTIGUOUS' WHEN s > top + 1 THEN 'FORWARD_GAP' ELSE 'BACKWARD' END AS verdict FROM g),
z AS (SELECT *, CASE WHEN verdict = 'FORWARD_GAP' THEN s - top - 1 ELSE 0 END AS missing, max((verdict IN ('CONFLICT_DUPLICATE', 'BACKWARD'))::INT) OVER (PARTITION BY scope ORDER BY i) = 1 AS poisoned FROM v)"""


def _guard(spark, sf):
    from ..functions.clock import micros

    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("scope"), F.col("l_linenumber").cast("long").alias("s"), "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("qty"), micros(F.col("l_shipdate")).alias("ship"),
    )
    return sequence_guard(li, ["scope"], ["ship", "l_partkey", "l_suppkey", "cents", "qty", "s"], "s", F.col("l_suppkey"), width=400 * 86_400_000_000)


@query("seq_guard", GUARD + " SELECT scope, s, l_partkey, verdict, missing, poisoned FROM z", with_raw=False)
def _(spark, sf):
    return _guard(spark, sf).select("scope", "s", "l_partkey", "verdict", "missing", "poisoned")


@query("seq_gaps", GUARD + " SELECT scope, count(*) FILTER (WHERE missing > 0) AS gaps, CAST(sum(missing) AS BIGINT) AS missing FROM z GROUP BY scope", with_raw=False)
def _(spark, sf):
    return _guard(spark, sf).groupBy("scope").agg(F.count_if(F.col("missing") > 0).alias("gaps"), F.sum("missing").alias("missing"))


@query("poisoned_scopes", GUARD + " SELECT verdict, count(*) AS rows, count(*) FILTER (WHERE poisoned) AS poisoned_rows, count(DISTINCT scope) AS scopes FROM z GROUP BY verdict", with_raw=False)
def _(spark, sf):
    d = _guard(spark, sf).groupBy("scope", "verdict").agg(F.count("*").alias("rows"), F.count_if("poisoned").alias("poisoned_rows"))  # where the guard left a scope's rows
    return d.groupBy("verdict").agg(F.sum("rows").alias("rows"), F.sum("poisoned_rows").alias("poisoned_rows"), F.count("scope").alias("scopes"))


QUAL = "CAST((CASE WHEN kind = 'error' THEN {a} ELSE 0 END) + (CASE WHEN qty = 0 THEN {b} ELSE 0 END) + (CASE WHEN price < 100 THEN {c} ELSE 0 END) + (CASE WHEN seq % 50 = 0 THEN {d} ELSE 0 END) AS BIGINT)".format(a=BIT["SOURCE_DISCONNECTED"], b=BIT["NULL_VALUE_PRESENT"], c=BIT["SNAPSHOT_STALE"], d=BIT["VENDOR_SEQUENCE_GAP"])
NAMES = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(QUALITY_BITS))


@query("quality_bits", f"SELECT seq, {QUAL} AS quality, CAST(bit_count({QUAL}) AS INTEGER) AS bits FROM raw")
def _(spark, sf):
    return raw(spark, sf).select("seq", F.expr(QUAL).alias("quality"), F.bit_count(F.expr(QUAL)).alias("bits"))


@query("quality_summary", f"q AS (SELECT stream, {QUAL} AS quality FROM raw), b AS (SELECT stream, CASE i {NAMES} END AS flag FROM q, range(36) r(i) WHERE (quality >> CAST(i AS INT)) & 1 = 1) SELECT stream, flag, count(*) AS rows FROM b GROUP BY ALL")
def _(spark, sf):
    d = raw(spark, sf).select("stream", F.explode(bit_names(F.expr(QUAL))).alias("flag"))
    return d.groupBy("stream", "flag").agg(F.count("*").alias("rows"))


@query("quality_masks", f"SELECT seq FROM raw WHERE (qty & 3) = 3 AND ({QUAL} & {BIT['SOURCE_DISCONNECTED'] | BIT['SNAPSHOT_STALE']}) = 0")
def _(spark, sf):
    return raw(spark, sf).where(masks_pass(F.col("qty"), 3, F.expr(QUAL), BIT["SOURCE_DISCONNECTED"] | BIT["SNAPSHOT_STALE"])).select("seq")


@query("invalid_reasons", "SELECT CASE WHEN qty = 0 THEN 'EMPTY' WHEN price % 17 = 0 THEN 'OFFSET' WHEN price % 13 = 0 THEN 'TEXT' ELSE 'NONE' END AS reason, count(*) AS rows FROM raw GROUP BY 1")
def _(spark, sf):
    r = F.when(F.col("qty") == 0, "EMPTY").when(F.col("price") % 17 == 0, "OFFSET").when(F.col("price") % 13 == 0, "TEXT").otherwise("NONE")
    return raw(spark, sf).groupBy(r.alias("reason")).agg(F.count("*").alias("rows"))


DEDUPE = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query("dedupe_canonical", f"WITH o AS (SELECT {DEDUPE}, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem) SELECT {DEDUPE}, copies FROM o WHERE i = 1", with_raw=False)
def _(spark, sf):
    return merge_tiers(table(spark, sf, "lineitem").select(*DEDUPE.split(", ")), ["l_orderkey", "l_linenumber"], "l_shipdate")


@query("hot_cold_merge", "h AS (SELECT seq, price, 0 AS tier FROM raw WHERE seq >= (SELECT max(seq) * 3 // 10 FROM raw) UNION ALL SELECT seq, price + 1, 1 FROM raw WHERE seq < (SELECT max(seq) * 4 // 10 FROM raw)) SELECT seq, arg_min(price, tier) AS price, CAST(min(tier) AS INTEGER) AS tier, count(*) AS copies FROM h GROUP BY seq")
def _(spark, sf):
    d = raw(spark, sf)
    top = d.agg(F.max("seq").alias("top"))  # one row
    d = d.join(F.broadcast(top))
    hot, cold = d.where("seq >= top * 3 div 10").select("seq", "price", F.lit(0).alias("tier")), d.where("seq < top * 4 div 10").select("seq", (F.col("price") + 1).alias("price"), F.lit(1).alias("tier"))
    return merge_tiers(hot.unionByName(cold), ["seq"], "tier")


@query("reconcile", """WITH o AS (SELECT o_orderkey, o_custkey % 8 AS channel, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
b AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, channel, CASE WHEN o_orderkey % 11 = 0 THEN st || '?' ELSE st END AS st, pr FROM o WHERE o_orderkey % 13 <> 0
  UNION ALL SELECT o_orderkey, channel, st, pr FROM o WHERE o_orderkey % 19 = 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0),
c1 AS (SELECT o_orderkey, min(channel) AS channel, count(*) AS n, min(st) AS st, max(st) AS st2, min(pr) AS pr, max(pr) AS pr2 FROM o GROUP BY 1),
b1 AS (SELECT o_orderkey, min(channel) AS channel, count(*) AS n, min(st) AS st, max(st) AS st2, min(pr) AS pr, max(pr) AS pr2 FROM b GROUP BY 1),
j AS (SELECT coalesce(c1.channel, b1.channel) AS channel, c1.n AS cn, b1.n AS bn, c1.st <> b1.st OR c1.pr <> b1.pr OR c1.st <> c1.st2 OR c1.pr <> c1.pr2 OR b1.st <> b1.st2 OR b1.pr <> b1.pr2 AS differs FROM c1 FULL JOIN b1 ON c1.o_orderkey = b1.o_orderkey),
g AS (SELECT channel, count(cn) AS capture_rows, count(*) FILTER (WHERE cn IS NOT NULL AND bn IS NOT NULL) AS backup_matches, count(*) FILTER (WHERE bn IS NULL) AS missing_rows, count(*) FILTER (WHERE cn IS NULL) AS backup_only_rows,
  count(*) FILTER (WHERE cn > 1 OR bn > 1) AS repeated_keys, count(*) FILTER (WHERE cn IS NOT NULL AND bn IS NOT NULL AND differs) AS differing_rows FROM j GROUP BY channel)
SELECT *, 2 * backup_matches AS fields_compared, CASE WHEN missing_rows = 0 AND backup_only_rows = 0 AND differing_rows = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM g""", with_raw=False)
def _(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 8).alias("channel"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"))
    b = o.where(k % 13 != 0).withColumn("st", F.when(k % 11 == 0, F.concat("st", F.lit("?"))).otherwise(F.col("st"))).withColumn("o_orderkey", F.when(k % 17 == 0, -k).otherwise(k))
    twice = o.where((k % 19 == 0) & (k % 13 != 0) & (k % 17 != 0))
    return reconcile(o, b.unionByName(twice), ["o_orderkey"], ["st", "pr"], "channel")


@query("idempotent_publish", "k AS (SELECT instrument_id, qty, count(*) AS n, min(price) AS price, count(DISTINCT price) AS versions FROM raw GROUP BY ALL) SELECT instrument_id, qty, price, n AS offers, CASE WHEN versions > 1 THEN 'CONFLICT' WHEN n > 1 THEN 'DUPLICATE' ELSE 'PUBLISHED' END AS outcome FROM k")
def _(spark, sf):
    return offered(raw(spark, sf).select("instrument_id", "qty", "price"), ["instrument_id", "qty"], "price")


@query("distinct_parents", "SELECT stream, qty AS occurrence, count(*) AS locators FROM raw GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return raw(spark, sf).groupBy("stream", F.col("qty").alias("occurrence")).agg(F.count("*").alias("locators")).where("locators > 1")


def _mix(name: str, x: str) -> str:
    """Columns that end in ``name``: the splitmix step of x, in 128-bit unsigned arithmetic."""
    wrap, a, b = 1 << 64, hashing.MIX_A, hashing.MIX_B
    return f"""(({x})::UHUGEINT + {hashing.GAMMA}) % {wrap} AS {name}0, (xor({name}0, {name}0 >> 30) * {a}) % {wrap} AS {name}1,
(xor({name}1, {name}1 >> 27) * {b}) % {wrap} AS {name}2, xor({name}2, {name}2 >> 31) AS {name}"""


_LANE = int(hashing.splitmix(hashing.LANE_KEY)[0])  # lane 0's part of a draw
RULE = faults.FaultRule(seed=7, drop_one_in=9, duplicate_one_in=11, copies=2, mutate_one_in=5, xor_mask=3)
LOCATOR = ("stream", "capture_date", "seq", "start_pos", "end_pos")
INJECTED = POS_SQL + f""", n AS (SELECT stream, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS capture_date, seq, start_pos, end_pos, price, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS ordinal FROM placed),
o AS (SELECT *, {_mix("o", f"xor(ordinal::UHUGEINT, {hashing.ORDINAL_KEY}::UHUGEINT)")} FROM n),
w AS (SELECT *, xor(o, xor({_LANE}::UHUGEINT, {RULE.seed}::UHUGEINT)) AS own FROM o),
f AS (SELECT *, {", ".join(_mix(x, f"xor(own, {p}::UHUGEINT)") for x, p in (("d", faults.DROP), ("c", faults.DUPLICATE), ("m", faults.MUTATE)))} FROM w),
k AS (SELECT *, CASE WHEN m % {RULE.mutate_one_in} = 0 THEN xor(price, {RULE.xor_mask}) ELSE price END AS now, unnest(range(1, CASE WHEN c % {RULE.duplicate_one_in} = 0 THEN {RULE.copies + 2} ELSE 2 END)) AS occurrence FROM f WHERE d % {RULE.drop_one_in} <> 0)"""
PARENT = "stream AS parent_stream, capture_date AS parent_capture_date, seq AS parent_seq, start_pos AS parent_start_pos, end_pos AS parent_end_pos"


def _located(spark, sf):
    return positions(raw(spark, sf)).withColumn("capture_date", F.date_format("ts", "yyyyMMdd").cast("int"))


def _injected(spark, sf):
    return injected.inject(_located(spark, sf), ["stream"], "seq", "price", RULE, LOCATOR)


@query("injected_records", INJECTED + f" SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY ordinal, occurrence) AS synthetic_seq, now AS price, price AS before, now IS DISTINCT FROM price AS mutated, CAST(occurrence AS INTEGER) AS occurrence, {PARENT} FROM k")
def _(spark, sf):
    return _injected(spark, sf)[0]


@query("injected_dropped", INJECTED + f" SELECT {PARENT} FROM f WHERE d % {RULE.drop_one_in} = 0")
def _(spark, sf):
    return _injected(spark, sf)[1]


@query("parent_lineage", INJECTED + f", s AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ordinal, occurrence) AS synthetic_seq FROM k) SELECT s.stream, s.synthetic_seq, CAST(s.occurrence AS INTEGER) AS occurrence, p.kind, p.qty FROM s JOIN placed p USING (stream, seq, start_pos, end_pos)")
def _(spark, sf):
    return injected.with_parents(_injected(spark, sf)[0], _located(spark, sf), LOCATOR, ["kind", "qty"]).select("stream", "synthetic_seq", "occurrence", "kind", "qty")


@query("queue_high_water", "q AS (SELECT stream, sum(CASE WHEN kind IN ('click', 'view') THEN 1 WHEN kind IN ('purchase', 'error') THEN -1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq) AS depth FROM raw) SELECT stream, CAST(max(depth) AS BIGINT) AS high_water FROM q GROUP BY stream")
def _(spark, sf):
    step = F.when(F.col("kind").isin("click", "view"), 1).when(F.col("kind").isin("purchase", "error"), -1).otherwise(0).cast("long")
    return prefix(raw(spark, sf), ["stream"], "seq", {"depth": ("sum", step)}).groupBy("stream").agg(F.max("depth").alias("high_water"))


@query("faulted_replay")
def _(spark, sf):
    return faults.transform(raw(spark, sf).select("seq", "stream", "price"), ["stream"], "seq", "price", faults.FaultRule(seed=7, drop_one_in=9, duplicate_one_in=11, copies=2, mutate_one_in=5, xor_mask=3, reorder_window=16))
