"""Factors: ratios and windows with validity. A zero denominator is invalid, never zero."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import scanned


def imbalance(bid: Column, ask: Column) -> Column:
    return F.try_divide((bid - ask).cast("double"), (bid + ask).cast("double"))


def microprice(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    """(ask * bid_qty + bid * ask_qty) / (bid_qty + ask_qty), with a wide exact numerator."""
    w = lambda c: c.cast("decimal(19,0)")
    num = (w(ask) * w(bid_qty)).cast("decimal(38,0)") + (w(bid) * w(ask_qty)).cast("decimal(38,0)")
    return F.try_divide(num.cast("double"), (bid_qty + ask_qty).cast("double"))


def sliding(df: DataFrame, keys: Sequence[str], at: str, width: int, values: dict[str, Column], chunks: int = 16) -> DataFrame:
    """df plus an aggregate for each name over the rows of the same keys within ``width`` nanoseconds up to
    and including this row's time. Keys are cut into chunks of ``chunks`` widths; only the last width of a
    chunk is copied to the next one, so a key with very many rows is many tasks."""
    span = width * max(1, chunks)
    b = F.floor(F.col(at) / span)
    late = F.col(at) >= (b + 1) * span - width
    d = df.withColumn("__own", b).withColumn("__b", F.explode(F.when(late, F.array(b, b + 1)).otherwise(F.array(b))))
    w = Window.partitionBy(*keys, "__b").orderBy(at).rangeBetween(-width, 0)
    d = d.select("*", *[v.over(w).alias(n) for n, v in values.items()])
    return d.where(F.col("__own").eqNullSafe(F.col("__b"))).drop("__own", "__b")


@dataclass(frozen=True)
class FactorSpec:
    """A factor: what it needs, when its output counts, and how it is computed."""

    factor_id: str
    version: int
    window_ns: int
    min_rows: int = 1
    required_validity: int = 0
    forbidden_quality: int = 0
    apply: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)

    def canonical(self) -> str:
        d = asdict(self)
        d.pop("apply")
        return json.dumps({k: str(v) for k, v in d.items()}, sort_keys=True, separators=(",", ":"))

    @property
    def identity(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


def run_factor(df: DataFrame, spec: FactorSpec, keys: Sequence[str], at: str, inputs: str) -> DataFrame:
    """spec.apply's column value, valid and identity per row: valid needs warmup inside the window, the
    required validity bits and no forbidden quality bit. A value that is null is never valid."""
    from ..functions.bits import masks_pass

    d = sliding(spec.apply(df), keys, at, spec.window_ns, {"__n": F.count(inputs)})
    ok = (F.col("__n") >= spec.min_rows) & F.col("value").isNotNull() & masks_pass(F.col("validity"), spec.required_validity, F.col("quality"), spec.forbidden_quality)
    return d.withColumn("valid", ok).withColumn("input_spec", F.lit(spec.identity)).drop("__n")


def ewma(df: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean of a key's values so far, the first one taken whole; a null value leaves it as it is."""
    d = df.select(*keys, order, value)

    def step(rows, state):
        x = rows[value].to_numpy(np.float64, na_value=np.nan)
        known, out = np.flatnonzero(~np.isnan(x)), np.full(len(x), np.nan)
        if len(known):
            begun = np.r_[[] if state is None else [state], x[known]]
            out[known] = pd.Series(begun).ewm(alpha=alpha, adjust=False).mean().to_numpy()[-len(known):]
        held = pd.Series(np.r_[np.nan if state is None else state, out]).ffill().to_numpy()[1:]
        return rows.assign(ewma=held), None if np.isnan(held[-1]) else float(held[-1])

    return scanned(d, keys, order, step, ", ".join(f"{c} {t}" for c, t in d.dtypes) + ", ewma double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null, not zero, where whole is zero."""
    return part.cast("double") / F.nullif(whole, F.lit(0).cast("long")).cast("double")
