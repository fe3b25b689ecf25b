"""Injected faults: drop, duplicate, mutate and reorder by keyed draws on a record's ordinal, so that one
fault never shifts another's choice. Sequences are numbered anew afterwards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import selected, stable_draw
from ..operators.ordered import prefix

#: The purposes of draws.
DROP, DUPLICATE, MUTATE, REORDER = 0x64726F705F763031, 0x6475706C5F763031, 0x6D7574615F763031, 0x72656F72645F7631
#: Rows that are reordered together; a longer chunk is a group of its own.
GROUP = 16_384


@dataclass(frozen=True)
class FaultRule:
    seed: int = 0
    drop_one_in: int = 0
    duplicate_one_in: int = 0
    copies: int = 1
    mutate_one_in: int = 0
    xor_mask: int = 0
    reorder_window: int = 0


def numbered(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """df plus ordinal, from 0 in each namespace."""
    return prefix(df, keys, order, {"ordinal": ("sum", F.lit(1).cast("long"))}).withColumn("ordinal", F.col("ordinal") - 1)


def dropped(df: DataFrame, keys: Sequence[str], order: str, rule: FaultRule) -> DataFrame:
    """The rows that transform leaves out, with ordinal."""
    return numbered(df, keys, order).where(selected(F.col("ordinal"), rule.seed, DROP, rule.drop_one_in))


def reordered(pdf: pd.DataFrame, seed: int, window: int) -> pd.DataFrame:
    """pdf, whole chunks of one namespace of ``window`` consecutive new_seq each (the last may be shorter), with each chunk's
    rows shuffled. Swaps go from a chunk's end down, in all chunks at once; a draw goes by the chunk's number and the rows not yet placed."""
    pdf = pdf.sort_values("new_seq")
    place, first = np.arange(len(pdf)), np.arange(0, len(pdf), window)
    chunk = (int(pdf["new_seq"].iloc[0]) - 1) // window + np.arange(len(first))
    left = np.arange(min(window, len(pdf)), 1, -1)
    draws = stable_draw(seed, chunk[:, None], REORDER, left[None, :]) % left.astype(np.uint64)
    long = np.minimum(window, len(pdf) - first)
    for i, n in enumerate(left):
        k = len(first) - int(long[-1] < n)  # only the last chunk can be short
        a, b = first[:k] + n - 1, first[:k] + draws[:k, i].astype(np.int64)
        place[a], place[b] = place[b], place[a]
    out = pdf.iloc[place].copy()
    out["new_seq"] = pdf["new_seq"].to_numpy()
    return out


def transform(df: DataFrame, keys: Sequence[str], order: str, value: str, rule: FaultRule) -> DataFrame:
    """df's rows after the faults, with ordinal, copy and new_seq (from 1 in each namespace)."""
    d = numbered(df, keys, order)
    d = d.where(~selected(F.col("ordinal"), rule.seed, DROP, rule.drop_one_in))
    d = d.withColumn(value, F.when(selected(F.col("ordinal"), rule.seed, MUTATE, rule.mutate_one_in), F.col(value).bitwiseXOR(F.lit(rule.xor_mask).cast("long"))).otherwise(F.col(value)))
    n = F.when(selected(F.col("ordinal"), rule.seed, DUPLICATE, rule.duplicate_one_in), 1 + rule.copies).otherwise(1)
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))
    d = d.withColumn("__at", F.col("ordinal") * (rule.copies + 1) + F.col("copy"))
    d = prefix(d, keys, "__at", {"new_seq": ("sum", F.lit(1).cast("long"))})
    if rule.reorder_window > 1:
        rows = max(1, GROUP // rule.reorder_window) * rule.reorder_window  # whole chunks
        d = d.withColumn("__group", F.expr(f"(new_seq - 1) div {rows}"))
        d = d.groupBy(*keys, "__group").applyInPandas(lambda pdf: reordered(pdf, rule.seed, rule.reorder_window), d.schema).drop("__group")
    return d.drop("__at")
