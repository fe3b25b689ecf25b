"""Ticks, books and latest state. A field without meaning is null and its validity bit is unset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import flag
from ..functions.fixed import div
from .ordered import prefix

#: Fields that have a validity bit, the place in the list is the bit.
VALIDITY = ("price", "qty", "amount", "matched_qty", "primary_order_id", "buy_order_id", "sell_order_id", "side", "order_type", "aggressor", "phase", "exchange_time")
VALID = {n: 1 << i for i, n in enumerate(VALIDITY)}

#: Shenzhen order sides and types.
SIDES = {49: "BUY", 50: "SELL", 71: "BORROW", 70: "LEND"}
ORDER_TYPES = {49: "MARKET", 50: "LIMIT", 85: "BEST_OWN"}


def tick_fields(action: Column, price: Column, qty: Column, money: Column, buy: Column, sell: Column, side: Column) -> dict[str, Column]:
    """Shanghai ticks: A adds and D deletes an order, T trades, S changes the phase; which fields mean something."""
    is_ = lambda *x: action.isin(*x)
    out = {
        "price": F.when(is_("A", "T"), price), "qty": F.when(is_("A", "D", "T"), qty), "amount": F.when(is_("T"), money),
        "buy_order_id": F.when(is_("T") | (is_("A", "D") & (side == "B")), buy), "sell_order_id": F.when(is_("T") | (is_("A", "D") & (side == "S")), sell),
        "side": F.when(is_("A", "D"), side), "aggressor": F.when(is_("T"), side),
    }
    bits = F.lit(0).cast("long")
    for n, c in out.items():
        bits = bits.bitwiseOR(F.when(c.isNotNull(), F.lit(VALID[n])).otherwise(F.lit(0)).cast("long"))
    return out | {"validity": bits}


def matched_qty(raw: Column) -> tuple[Column, Column]:
    """Whole units of a number in thousandths; anything else is invalid and flagged, never rounded."""
    ok = raw.isNotNull() & (raw >= 0) & (raw % 1000 == 0)
    return F.when(ok, div(raw, 1000)), flag("NON_INTEGRAL_MATCHED_QTY", ~ok)


def enum_name(code: Column, names: dict[int, str]) -> Column:
    """The name or UNKNOWN."""
    out = None
    for k, v in names.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise("UNKNOWN")


def cancel_side(bid: Column, offer: Column) -> tuple[Column, Column]:
    """The side of a cancel if exactly one id is set; else null and flagged."""
    one = (bid != 0) != (offer != 0)
    return F.when(one, F.when(bid != 0, "BUY").otherwise("SELL")), flag("AMBIGUOUS_ORDER_REFERENCE", ~one)


def weighted_price(levels: Column) -> Column:
    """sum(p * q) / sum(q), truncated, of an array of struct(p, q); null without quantity."""
    wide = lambda c: c.cast("decimal(19,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    num = F.aggregate(levels, zero, lambda a, x: (a + wide(x["p"]) * wide(x["q"])).cast("decimal(38,0)"))
    den = F.aggregate(levels, zero, lambda a, x: (a + wide(x["q"])).cast("decimal(38,0)"))
    return F.when(den != 0, F.call_function("div", num, den).cast("long"))


def latest(df: DataFrame, keys: Sequence[str], cursor: Sequence[str]) -> DataFrame:
    """The whole row with the largest cursor for each key; a null in it is a null, older values never show."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*cursor)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, tie: str, value: Sequence[str], width: int = 3_600_000_000_000) -> DataFrame:
    """left plus, for each row, ``value`` of the right row with the largest (at, tie) not after it; at equal
    times the right row counts. The last value runs over the union of both, cut into buckets of ``width`` (an hour of
    nanoseconds), so that a key with very many rows is many tasks."""
    cols = [*keys, at, tie]
    l_only = [c for c in left.columns if c not in cols]
    v = F.struct(*value)
    lt = left.select(*cols, F.struct(*l_only).alias("__l"), F.lit(None).cast(right.select(v.alias("v")).schema["v"].dataType).alias("__r"), F.lit(1).alias("__side"))
    rt = right.select(*cols, F.lit(None).cast(left.select(F.struct(*l_only).alias("v")).schema["v"].dataType).alias("__l"), v.alias("__r"), F.lit(0).alias("__side"))
    out = prefix(lt.unionByName(rt), keys, at, {"__got": ("last", F.col("__r"))}, width=width, ties=["__side", tie]).where("__side = 1")
    return out.select(*cols, *[F.col(f"__l.{c}").alias(c) for c in l_only], *[F.col(f"__got.{c}").alias(c) for c in value])


def mux(df: DataFrame, epoch: Sequence[str], clock: str, ties: Sequence[str], width: int = 60_000_000_000) -> DataFrame:
    """df plus place, from 1: the one order of an epoch's rows over all streams, by receive time, then stream, sequence and
    sub-index (``ties``). Epochs' clocks are never compared. Counts by ``width`` of the clock are carried, so no epoch is one task."""
    return prefix(df, epoch, clock, {"place": ("sum", F.lit(1).cast("long"))}, width=width, ties=ties)


def accumulated(df: DataFrame, keys: Sequence[str], order: str, price: str, qty: str, lot: int, most_volume: int, most_turnover: int) -> DataFrame:
    """df plus accepted, volume and turnover: each row's whole lots, as many as leave both totals within their limits.

    Keys that never reach a limit, as their totals tell, are running sums; only the others are walked row by row, so those
    keys must be bounded (an instrument's day). Nothing is accepted of a row whose price or quantity is null or not above zero.
    """
    p, q, keys = F.col(price), F.col(qty), list(keys)
    d = df.withColumn("accepted", F.when((p > 0) & (q > 0), q - q % lot).otherwise(0).cast("long"))
    wide = F.col("accepted").cast("decimal(19,0)")
    full = d.groupBy(*keys).agg(F.sum(wide).alias("__v"), F.sum(wide * F.coalesce(p, F.lit(0)).cast("decimal(19,0)")).alias("__t"))
    full = full.where((F.col("__v") > most_volume) | (F.col("__t") > most_turnover) | F.col("__t").isNull()).select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    on = [d[k].eqNullSafe(full[f"__k_{k}"]) for k in keys]
    free = prefix(d.join(full, on, "left_anti"), keys, order, {"volume": ("sum", F.col("accepted")), "turnover": ("sum", F.col("accepted") * F.coalesce(p, F.lit(0)))})

    def walk(rows):
        rows = rows.sort_values(order)
        volume = turnover = 0
        out = []
        for want, at in zip(rows["accepted"], rows[price]):
            take = 0
            if want:
                take = min(int(want), most_volume - volume, (most_turnover - turnover) // int(at))
                take -= take % lot
            volume, turnover = volume + take, turnover + take * (int(at) if take else 0)
            out.append((take, volume, turnover))
        rows["accepted"], rows["volume"], rows["turnover"] = zip(*out)
        return rows

    held = d.join(full, on, "left_semi")
    held = held.groupBy(*keys).applyInPandas(walk, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", volume long, turnover long")
    return free.select(*held.columns).unionByName(held)


def book_sides(orders: DataFrame, keys: Sequence[str], bid: Column, price: str, qty: str, order: str, depth: int = 10, queue: int = 50) -> DataFrame:
    """One row per keys and side (bid true or false): actual_depth, the best ``depth`` levels (price, qty, orders), best
    first, and the quantities of the best level's first ``queue`` orders with the number of all its orders.

    Levels are pre-aggregated and ranked before they are gathered, so a group holds at most depth levels and queue orders
    whatever the size of the book. Orders without a price or side are in no level; equal places in a queue go by quantity."""
    keys, side = list(keys), "is_bid"
    d = orders.withColumn(side, bid).where(F.col(side).isNotNull() & F.col(price).isNotNull())
    better = F.when(F.col(side), -F.col(price)).otherwise(F.col(price))
    levels = d.groupBy(*keys, side, price).agg(F.sum(qty).alias("q"), F.count("*").alias("n"))
    actual = levels.groupBy(*keys, side).agg(F.count("*").alias("actual_depth"))
    at = levels.withColumn("at", F.row_number().over(Window.partitionBy(*keys, side).orderBy(better))).where(F.col("at") <= depth)
    level = F.struct("at", F.col(price).alias("price"), F.col("q").alias("qty"), F.col("n").alias("orders"))
    top = at.groupBy(*keys, side).agg(F.sort_array(F.collect_list(level)).alias("levels"))
    top = top.withColumn("levels", F.transform("levels", lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty"), x["orders"].alias("orders"))))
    queued = d.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, side).orderBy(better, order, qty))).where(F.col("__rank") <= queue)
    queued = queued.groupBy(*keys, side).agg(F.min(better).alias("__best"), F.sort_array(F.collect_list(F.struct("__rank", better.alias("b"), F.col(qty).alias("q")))).alias("__o"))
    first = F.transform(F.filter("__o", lambda x: x["b"] == F.col("__best")), lambda x: x["q"])
    out = actual
    for part in (top, queued.select(*keys, side, first.alias("queue"))):
        part = part.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, side]})
        out = out.join(part, [out[k].eqNullSafe(part[f"__k_{k}"]) for k in [*keys, side]]).drop(*[f"__k_{k}" for k in [*keys, side]])
    return out.withColumn("queue_orders", F.col("levels")[0]["orders"])
