"""Stored history: layout, lineage, manifests, merging and reconciliation."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_history(df: DataFrame, path: str, partitions: Sequence[str], sort: Sequence[str], buckets: int = 32, key: str = "instrument_id") -> None:
    """Parquet partitioned by date, market or type and a hash bucket, never by security; rows sorted within files."""
    d = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    d.repartition(*partitions, "bucket").sortWithinPartitions(*partitions, "bucket", *sort).write.mode("errorifexists").option("compression", "zstd").partitionBy(*partitions, "bucket").parquet(path)


def lineage(df: DataFrame, group: Sequence[str], cursor: str, quality: str) -> DataFrame:
    return df.groupBy(*group).agg(F.min(cursor).alias("min_cursor"), F.max(cursor).alias("max_cursor"), F.count("*").alias("rows"), F.bit_or(quality).alias("quality_union"))


def reconcile(capture: DataFrame, backup: DataFrame, key: Sequence[str], fields: Sequence[str], group: str) -> DataFrame:
    """Per group: keys of the capture, matches, keys that the backup lacks and that only it has, keys that come more than once
    on either side, fields compared, differing keys and a verdict. Both sides are first brought to one row a key, so
    repeated keys multiply nothing; a key whose copies disagree on a side differs. Both hold the group's column."""

    def one(df, p):
        row = F.struct(*fields)
        return df.groupBy(*key).agg(F.min(row).alias(f"__{p}"), (F.min(row) != F.max(row)).alias(f"__{p}x"), F.count("*").alias(f"__{p}n"), F.min(group).alias(f"__{p}g"))

    d = one(capture, "c").join(one(backup, "b"), list(key), "full_outer")
    here, there = F.col("__cn").isNotNull(), F.col("__bn").isNotNull()
    differs = ~F.col("__c").eqNullSafe(F.col("__b")) | F.col("__cx") | F.col("__bx")
    g = d.groupBy(F.coalesce("__cg", "__bg").alias(group)).agg(
        F.count_if(here).alias("capture_rows"), F.count_if(here & there).alias("backup_matches"), F.count_if(here & ~there).alias("missing_rows"),
        F.count_if(there & ~here).alias("backup_only_rows"), F.count_if((F.col("__cn") > 1) | (F.col("__bn") > 1)).alias("repeated_keys"),
        (F.count_if(here & there) * len(fields)).alias("fields_compared"), F.count_if(here & there & differs).alias("differing_rows"),
    )
    clean = (F.col("missing_rows") == 0) & (F.col("backup_only_rows") == 0) & (F.col("differing_rows") == 0)
    return g.withColumn("result", F.when(clean, "PASS").otherwise("FAIL"))


def offered(rows: DataFrame, key: Sequence[str], payload: str) -> DataFrame:
    """Per key: offers, and what publishing them does: CONFLICT where payloads disagree, else DUPLICATE or PUBLISHED."""
    g = rows.groupBy(*key).agg(F.count("*").alias("offers"), F.min(payload).alias(payload), (F.min(payload) != F.max(payload)).alias("__x"))
    outcome = F.when(F.col("__x"), "CONFLICT").when(F.col("offers") > 1, "DUPLICATE").otherwise("PUBLISHED")
    return g.withColumn("outcome", outcome).drop("__x")


def merge_tiers(rows: DataFrame, key: Sequence[str], tier: str) -> DataFrame:
    """One whole row a key, that of the smallest tier (equal tiers: the smallest row), and copies, how many there were."""
    rest = [c for c in rows.columns if c not in key and c != tier]
    g = rows.groupBy(*key).agg(F.min(F.struct(tier, *rest)).alias("__r"), F.count("*").alias("copies"))
    return g.select(*key, *[F.col(f"__r.{c}").alias(c) for c in (tier, *rest)], "copies")


def manifest_json(columns: Sequence[str]) -> Column:
    """Canonical JSON of the columns: sorted names, numbers as strings, no nulls left out."""
    return F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in sorted(columns)]))


def manifest_chain(segments: DataFrame, keys: Sequence[str], segment: str, columns: Sequence[str]) -> DataFrame:
    """Per log: segments and chain, a hash over its closed segments in order: each link is the hash of the link before and the
    segment's manifest, the first begins with the empty text. A log has few segments beside its records; their manifests of some
    hundred bytes are gathered by log."""
    rows = segments.select(*keys, F.struct(segment, manifest_json(columns).alias("m")).alias("s"))
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"))
    chain = F.aggregate("s", F.lit(""), lambda a, x: F.sha2(F.concat(a, x["m"]), 256))
    return g.select(*keys, F.size("s").cast("long").alias("segments"), chain.alias("chain"))


def run_manifest(inputs: DataFrame, config: dict, factors: Sequence[str], rules: Sequence[str]) -> DataFrame:
    """One row: manifest and run_id, its hash. inputs: a row for each log that the run reads, all its columns (ranges, chain) are
    taken; config: names and values; factors and rules: their identities. Equal runs have equal ids, whatever the order of rows."""
    one = F.array_join(F.array_sort(F.collect_list(manifest_json(inputs.columns))), ",")
    text = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"))
    ends = text({str(k): str(v) for k, v in config.items()}), text(sorted(factors)), text(sorted(rules))
    body = F.concat(F.lit(f'{{"config":{ends[0]},"factors":{ends[1]},"inputs":['), one, F.lit(f'],"rules":{ends[2]}}}'))
    return inputs.agg(body.alias("manifest")).withColumn("run_id", F.sha2("manifest", 256))


def publish(batch: DataFrame, path: str, key: Sequence[str], payload: str) -> int:
    """Idempotent keyed publish: new keys are appended, a key with the same payload is accepted again, another
    payload under a known key refuses the batch. Returns how many rows were appended."""
    spark = batch.sparkSession
    one = batch.groupBy(*key).agg(F.min(payload).alias(payload), F.countDistinct(payload).alias("__n"))
    try:
        old = spark.read.parquet(path).select(*key, F.col(payload).alias("__old"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], batch.select(*key, F.col(payload).alias("__old")).schema)
    both = one.join(old, list(key), "left")
    bad = both.where((F.col("__n") > 1) | (F.col("__old").isNotNull() & (F.col("__old") != F.col(payload))))
    if not bad.isEmpty():
        raise ValueError("a published key came with another payload")
    new = both.where(F.col("__old").isNull()).select(*key, payload)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n
