"""Running values along a log without one task for a whole stream.

A stream-day is one namespace; a plain window over it would put it in one task. Here rows are cut into
buckets of consecutive sequence numbers: each bucket is summarised by a partial aggregate, the few
summaries are carried forward by a small window, and the rows of a bucket are finished in a window of
their own. Every operator that follows log order is built on this.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET = 65_536
#: Rows of a task where a whole table is dealt by a key.
TASK_ROWS = 500_000


def prefix(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, tuple[str, Column]], inclusive: bool = True, width: int = BUCKET, ties: Sequence[str] = ()) -> DataFrame:
    """df plus a column for each name: (kind, expression) with kind sum, max, min, bit_or or last (the last
    that isn't null), over the rows of the same keys up to this row, itself included or not. ``order`` is
    an integer column, with ``ties`` unique within keys; ``width`` of it make a bucket."""
    keys = list(keys)
    d = df.withColumn("__b", F.floor(F.col(order) / width))
    for n, (_, e) in values.items():
        d = d.withColumn(f"__v_{n}", e)
    whole = {"sum": F.sum, "max": F.max, "min": F.min, "bit_or": F.bit_or}

    def summary(n, kind):
        v = F.col(f"__v_{n}")
        got = F.max_by(v, F.when(v.isNotNull(), F.struct(order, *ties) if ties else F.col(order))) if kind == "last" else whole[kind](v)
        return got.alias(f"__s_{n}")

    def over(col, kind, w):
        return F.last(col, ignorenulls=True).over(w) if kind == "last" else whole[kind](col).over(w)

    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*keys, "__b").agg(*[summary(n, k) for n, (k, _) in values.items()])
    carry = sums.select(*keys, "__b", *[over(F.col(f"__s_{n}"), k, before).alias(f"__c_{n}") for n, (k, _) in values.items()])
    carry = carry.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__kb"), *[f"__c_{n}" for n in values])
    on = [d[k].eqNullSafe(carry[f"__k_{k}"]) for k in keys] + [d["__b"] == carry["__kb"]]
    inside = Window.partitionBy(*keys, "__b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = d
    for n, (k, _) in values.items():
        out = out.withColumn(f"__w_{n}", over(F.col(f"__v_{n}"), k, inside))
    out = out.join(carry, on, "left")
    for n, (k, _) in values.items():
        c, w = F.col(f"__c_{n}"), F.col(f"__w_{n}")
        both = {"sum": c + w, "bit_or": c.bitwiseOR(w), "max": F.greatest(c, w), "min": F.least(c, w), "last": F.coalesce(w, c)}[k]
        out = out.withColumn(n, F.coalesce(both, c, w))
    return out.drop("__b", "__kb", *[f"__k_{k}" for k in keys], *[f"__{p}_{n}" for n in values for p in "vcw"])


def scanned(df: DataFrame, keys: Sequence[str], order: str, step: Callable, schema: str) -> DataFrame:
    """A recurrence along ``order`` that no partial aggregate expresses. ``step(rows, state)`` gets a run of rows of one
    group as a pandas frame and what it returned beside the rows before (None at a group's start), and
    returns the rows of ``schema`` and its state. Spark sorts on disk and hands a group over in Arrow batches,
    so memory goes by a batch however many rows a group has; a group is one task."""
    keys = list(keys)

    def run(frames):
        group, state = None, None
        for pdf in frames:
            ids = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(pdf) else []
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                rows = pdf.iloc[a:b]
                now = tuple(None if pd.isna(v) else v for v in (rows[k].iloc[0] for k in keys))
                if now != group:
                    group, state = now, None
                out, state = step(rows, state)
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: about TASK_ROWS each whatever the session's setting, so that what sorts and hash maps
    of a task hold doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def previous(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], width: int = BUCKET) -> DataFrame:
    """df plus prev, a struct of ``cols`` of the row before."""
    return prefix(df, keys, order, {"prev": ("last", F.struct(*cols))}, inclusive=False, width=width)
