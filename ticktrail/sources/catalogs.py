"""Small dimensions of a feed - message kinds, subscriptions - and the bounds of its configuration."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The roles of each venue's message kinds, 28 in all; venue and place make a kind's key.
CATALOG = {
    "SH": ("trade", "snapshot", "trade", "order"),
    "SZ": ("trade", "order", "snapshot", "snapshot", "order", "trade", "snapshot", "trade"),
    "CF": ("snapshot", "snapshot"), "SF": ("snapshot", "snapshot", "snapshot", "snapshot"), "CZ": ("snapshot", "snapshot"),
    "DC": ("snapshot", "snapshot", "order", "order"), "GF": ("snapshot", "snapshot", "order", "order"),
}
#: The four streams and which message keys each must, may and must not carry.
STREAMS = {
    1001: (("SH.snapshot",), ("SH.index",), ()), 1002: (("SH.tick",), (), ()),
    2001: (("SZ.snapshot",), ("SZ.index",), ("SZ.combined",)), 2002: (("SZ.order", "SZ.trade"), (), ("SZ.combined",)),
}


def message_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, i, r) for v, roles in CATALOG.items() for i, r in enumerate(roles)], "venue string, kind int, role string")


def subscription_spec(spark: SparkSession) -> DataFrame:
    rows = [(s, k, p) for s, sets in STREAMS.items() for p, keys in zip(("required", "optional", "forbidden"), sets) for k in keys]
    return spark.createDataFrame(rows, "source_stream_id int, message_key string, policy string")


def subscription_faults(spec: DataFrame, seen: DataFrame) -> DataFrame:
    """Required keys that a stream lacks, and forbidden ones that it has; seen: source_stream_id, message_key."""
    on, have = ["source_stream_id", "message_key"], seen.select("source_stream_id", "message_key").distinct()
    lacks = spec.where("policy = 'required'").join(have, on, "left_anti").withColumn("fault", F.lit("missing"))
    bad = spec.where("policy = 'forbidden'").join(have, on, "left_semi").withColumn("fault", F.lit("forbidden"))
    return lacks.unionByName(bad).select(*on, "fault")


@dataclass(frozen=True)
class FeedConfig:
    shanghai: int = 3000
    shenzhen: int = 2000
    derivatives_per_market: int = 64
    book_depth: int = 10
    orders_per_level: int = 50
    min_step_ms: int = 1
    max_step_ms: int = 3000
    start_date: int = 20240229
    start_time: int = 93000000
    extra: dict = field(default_factory=dict)

    def validate(self) -> str:
        """An empty text, or what is wrong."""
        if not 1 <= self.book_depth <= 50:
            return "book_depth must be from 1 to 50"
        if not 1 <= self.orders_per_level <= 100:
            return "orders_per_level must be from 1 to 100"
        if self.min_step_ms > self.max_step_ms:
            return "min_step_ms must not exceed max_step_ms"
        try:
            day = date(self.start_date // 10000, self.start_date // 100 % 100, self.start_date % 100)
        except ValueError:
            return "start_date must be a date"
        if day.weekday() >= 5 or day.year == 9999:
            return "start_date must be a weekday before the year 9999"
        if not (93000000 <= self.start_time <= 113000000 or 130000000 <= self.start_time <= 150000000) or self.start_time // 100000 % 100 > 59 or self.start_time // 1000 % 100 > 59:
            return "start_time must be inside a session"
        if not (0 <= self.shanghai <= 100_000 and 0 <= self.shenzhen <= 100_000 and 0 <= self.derivatives_per_market <= 10_000):
            return "instrument counts are out of range"
        return "" if self.shanghai + self.shenzhen + self.derivatives_per_market else "the universe must hold an instrument"
