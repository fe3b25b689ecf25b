"""Streaming forms: the session state machine, windowed counts and idempotent publishing.

State is one small struct per stream-day. Rows of a micro-batch are applied in sequence order; a row at or
below the last applied sequence is late: it is passed on, flagged, and doesn't change state. Any split of
the input into batches that keeps log order gives the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.bits import BIT
from ..operators.control import DECODE_ERROR, DISCONNECTED, FAILURE, SUCCESS

OUT = "stream long, seq long, connection_epoch long, logged_in boolean, quality long, late boolean"
STATE = "last_seq long, epoch long, logged_in int, disconnected int, switched int, poisoned int, address long"


def _step(s: list, kind, address):
    """One transition on (last_seq, epoch, logged_in, disconnected, switched, poisoned, address)."""
    if kind == DECODE_ERROR:
        s[2], s[5] = 0, 1
    elif s[5]:
        return
    elif kind == SUCCESS:
        s[1], s[2], s[3] = s[1] + 1, 1, 0
        s[4], s[6] = int(s[6] is not None and s[6] != address), address
    elif kind in (FAILURE, DISCONNECTED):
        s[2] = 0
        s[3] = 1 if kind == DISCONNECTED else s[3]


def _quality(s: list) -> int:
    q = 0 if s[2] else BIT["SESSION_UNKNOWN"] | (BIT["SOURCE_DISCONNECTED"] if s[3] else 0)
    return q | (BIT["CONNECTION_SWITCHED"] if s[4] else 0)


def attribute(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s = list(state.get) if state.exists else [-1, 0, 0, 0, 0, 0, None]
    rows = sorted((r for pdf in pdfs for r in pdf[["seq", "ctype", "address"]].itertuples(index=False, name=None)), key=lambda r: r[0])
    out = []
    for seq, kind, address in rows:
        late = seq <= s[0]
        if not late:
            s[0] = seq
            _step(s, kind, address)
        out.append((key[0], seq, s[1], bool(s[2]), _quality(s), late))
    state.update(tuple(s))
    yield pd.DataFrame(out, columns=["stream", "seq", "connection_epoch", "logged_in", "quality", "late"])


def session_stream(df: DataFrame) -> DataFrame:
    """df: stream, seq, ctype, address (a stream)."""
    return df.groupBy("stream").applyInPandasWithState(attribute, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_trades(df: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Trades and quantity per instrument and window; the watermark bounds state."""
    d = df.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    return d.groupBy(F.window("event_time", width), "instrument_id").agg(F.count("*").alias("trades"), F.sum("qty").alias("qty"))


def publish_to(df: DataFrame, path: str, checkpoint: str, key: list[str], payload: str):
    """Each micro-batch is published idempotently: a replayed batch appends nothing, a conflict stops the query."""
    from ..operators.lake import publish

    return df.writeStream.foreachBatch(lambda batch, _: publish(batch, path, key, payload)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
