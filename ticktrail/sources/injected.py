"""Synthetic logs: a log's records after faults, kept apart from it, each with the locator of its parent.

An injected log is a folder with three Parquet tables: ``records``, ``dropped`` (the locators of parents that a rule
dropped) and ``manifest``, one row that is written last; a folder without it is unfinished and isn't read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .faults import FaultRule, dropped, transform


def rule_digest(rule: FaultRule) -> str:
    text = json.dumps({k: str(v) for k, v in asdict(rule).items()}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def inject(log: DataFrame, keys: Sequence[str], order: str, value: str, rule: FaultRule, locator: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, dropped). A record has the keys, its synthetic sequence from 1 on, value, before (the parent's value),
    mutated, occurrence (from 1) and parent_<column> for each column of ``locator``; dropped has the parents' alone."""
    parent = [F.col(c).alias(f"parent_{c}") for c in locator]
    d = log.select(*dict.fromkeys([*keys, order, value]), F.col(value).alias("before"), *parent)
    kept = transform(d, keys, order, value, rule).withColumnRenamed("copy", "occurrence")
    names = [f"parent_{c}" for c in locator]
    records = kept.select(*keys, F.col("new_seq").alias("synthetic_seq"), value, "before", (~F.col(value).eqNullSafe(F.col("before"))).alias("mutated"), "occurrence", *names)
    return records, dropped(d, keys, order, rule).select(*names)


def write_injected(log: DataFrame, path: str, keys: Sequence[str], order: str, value: str, rule: FaultRule, locator: Sequence[str], run: str, parent_identity: str) -> None:
    """Writes an injected log. A path that exists is refused, so neither a real log nor an earlier run is overwritten."""
    spark = log.sparkSession
    records, gone = inject(log, keys, order, value, rule, locator)
    records.write.mode("errorifexists").parquet(f"{path}/records")
    gone.write.mode("errorifexists").parquet(f"{path}/dropped")
    n = spark.read.parquet(f"{path}/records").agg(F.count("*").alias("records"))
    n = n.crossJoin(spark.read.parquet(f"{path}/dropped").agg(F.count("*").alias("dropped")))  # a row by a row
    facts = {"synthetic": True, "run": run, "parent_identity": parent_identity, "fault_rule_sha256": rule_digest(rule), "fault_seed": rule.seed}
    n.select("*", *[F.lit(v).alias(k) for k, v in facts.items()]).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")


def read_injected(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """records, dropped and manifest."""
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("records", "dropped", "manifest"))


def injected_faults(records: DataFrame, gone: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(fault, found): what a sound injected log can't hold, and how often; empty for a sound one."""
    parent = [c for c in records.columns if c.startswith("parent_")]
    copies = records.groupBy(*parent).agg(F.count("*").alias("n"), F.max("occurrence").alias("top"), F.min("occurrence").alias("low"), F.count_distinct("occurrence").alias("kinds"))
    runs = records.groupBy(*keys).agg(F.count("*").alias("n"), F.min("synthetic_seq").alias("low"), F.max("synthetic_seq").alias("top"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"d.{c}")) for c in parent]
    on = same[0]
    for x in same[1:]:
        on = on & x
    counted = records.agg(F.count("*").alias("r")).crossJoin(gone.agg(F.count("*").alias("g")))  # a row by a row
    checks = {
        "sequence_not_gapless": runs.where("low <> 1 OR top <> n"),
        "sequence_repeated": records.groupBy(*keys, "synthetic_seq").count().where("count > 1"),
        "occurrences_not_gapless": copies.where("low <> 1 OR top <> n OR kinds <> n"),
        "dropped_and_kept": copies.alias("k").join(gone.alias("d"), on, "left_semi"),
        "dropped_twice": gone.groupBy(*gone.columns).count().where("count > 1"),
        "mutation_mislabelled": records.where(~F.col("mutated").eqNullSafe(~F.col(_value(records, keys)).eqNullSafe(F.col("before")))),
        "not_as_the_manifest_counts": manifest.crossJoin(counted).where("records <> r OR dropped <> g"),
    }
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count("*").alias("found")).select(F.lit(name).alias("fault"), "found")
        out = row if out is None else out.unionByName(row)
    return out.where("found > 0")


def _value(records: DataFrame, keys: Sequence[str]) -> str:
    fixed = {*keys, "synthetic_seq", "before", "mutated", "occurrence"}
    return next(c for c in records.columns if c not in fixed and not c.startswith("parent_"))


def with_parents(records: DataFrame, log: DataFrame, locator: Sequence[str], take: Sequence[str]) -> DataFrame:
    """records plus ``take`` of the parent, met by its whole locator; names of the records' own columns can't be taken."""
    p = log.select(*[F.col(c).alias(f"parent_{c}") for c in locator], *take)
    return records.join(p, [f"parent_{c}" for c in locator])
