"""Synthetic instruments and a seeded feed whose invariants hold by construction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stable_draw

#: The message kinds a feed can carry, by venue group.
KINDS = ("snapshot", "order", "trade")


#: Fixed values in universe: services, first ids, price bases, multipliers, moduli, ticks and lots.
def universe(spark: SparkSession, shanghai: int, shenzhen: int, derivatives: int) -> DataFrame:
    """Closed-form instruments; only column arithmetic. Ids have a fixed width, so the numbers of instruments are bounded."""
    if not (0 <= shanghai <= 100_000 and 0 <= shenzhen <= 999_999 and 0 <= derivatives <= 10_000):
        raise ValueError("too many instruments for the width of their ids")
    i = F.col("id")
    cash = lambda by: F.lit(10000) + (i * by % 19000) * 10
    sh = spark.range(shanghai).select(F.lit(101).alias("service_id"), (i + 600000).cast("string").alias("security_id"), cash(7919).alias("reference_price_milli"), F.lit(10).alias("tick_size_milli"), F.lit(100).alias("lot_size"), F.lit(False).alias("option"))
    sz = spark.range(shenzhen).select(F.lit(102), F.lpad((i + 1).cast("string"), 6, "0"), cash(7877), F.lit(10), F.lit(100), F.lit(False))
    dv = spark.range(derivatives).select(F.lit(103), F.concat(F.lit("D"), F.lpad(i.cast("string"), 4, "0")), F.lit(500000) + (i * 12347 % 45000) * 100, F.lit(100), F.lit(1), i % 2 == 1)
    return sh.union(sz).union(dv)


def generate(instruments: DataFrame, ticks: int, seed: int) -> DataFrame:
    """``ticks`` steps for each instrument: a price walk inside the day's limits, OHLC, cumulative volume and
    turnover. State is sequential within an instrument and independent between instruments."""

    def walk(pdf):
        import pandas as pd

        row = pdf.iloc[0]
        ref, tick = int(row.reference_price_milli), int(row.tick_size_milli)
        pct = 20 if row.service_id == 103 else 10
        low, high = -(-ref * (100 - pct) // 100 // tick) * tick, ref * (100 + pct) // 100 // tick * tick
        lane = int.from_bytes(str(row.security_id).encode()[-7:], "big")
        d = stable_draw(seed, np.arange(ticks), 11, lane)
        last, out, volume, turnover, o, h, lo = ref // tick * tick, [], 0, 0, None, None, None
        for k in range(ticks):
            last = min(max(last + (int(d[k] % np.uint64(5)) - 2) * tick, low), high)
            q = (1 + int((d[k] >> np.uint64(8)) % np.uint64(20))) * int(row.lot_size)
            volume, turnover = volume + q, turnover + q * last
            o = last if o is None else o
            h, lo = max(last, h or last), min(last, lo or last)
            out.append((row.service_id, row.security_id, k, o, h, lo, last, volume, turnover, last - tick, last + tick))
        return pd.DataFrame(out, columns=["service_id", "security_id", "step", "open", "high", "low", "last", "volume", "turnover", "best_bid", "best_ask"])

    schema = "service_id int, security_id string, step long, open long, high long, low long, last long, volume long, turnover long, best_bid long, best_ask long"
    return instruments.groupBy("service_id", "security_id").applyInPandas(walk, schema)
