"""The mapping of the driver's tables to an event log, and the register of queries.

events plays the log: event_id is the ingress sequence, pmod(user_id, 4) the stream, user_id the
instrument; signup is a logon, error a disconnect, click an order, purchase a trade, view a snapshot;
round(value * 100) is the price in cents and props.k the quantity. The mapping is ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import recv_ns

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RAW_SQL = """raw AS (
  SELECT event_id AS seq, user_id AS instrument_id, user_id % 4 AS stream, event_type AS kind, ts,
         CAST(round(value * 100) AS BIGINT) AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty,
         length(props) AS body, epoch_us(ts) * 1000 AS recv_ns
  FROM events)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("instrument_id"), F.pmod("user_id", F.lit(4)).cast("long").alias("stream"),
        F.col("event_type").alias("kind"), "ts", F.round(F.col("value") * 100).cast("long").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("qty"), F.length("props").cast("long").alias("body"), recv_ns(F.col("ts")).alias("recv_ns"),
    )


def query(name: str, sql: str | None = None, with_raw: bool = True):
    """Registers fn(spark, sf) and its SQL; ``sql`` may continue the CTEs after raw."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = f"WITH {RAW_SQL}{'' if sql.lstrip().startswith('SELECT') else ', '}{sql}" if with_raw else sql
        return fn

    return put
