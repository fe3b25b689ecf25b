"""Mixing sources to target weights.

1. A document's size is its number of words. Each source's documents, ordered by a hash of their ids, form
   one stream of words, cut into blocks of ``block`` words: block i holds words i*block .. (i+1)*block - 1.
2. Sources get targets by weight; a target stops at ``max_epochs`` times its source's size and the excess
   is shared again by weight.
3. The mix is a sequence of slots, one block each, dealt over output shards. A shard's counts of sources
   are drawn multinomially by what each source has left to give, so the totals meet the targets exactly
   (in whole blocks) whatever the draws. Only the shards x sources table of counts is on the driver; its
   size is bounded by ``max_cells``.
4. A slot's place in its shard is a pseudorandom permutation; its number within its source maps through
   the source's own permutation of block indices, a new one for each epoch: every block comes once before
   any comes twice, and never more than ``max_epochs`` times.
5. Slots meet blocks by (source, index).

The prefix sums of step 1 are in two levels, (source, bucket) and within a bucket of about ``bucket_rows``
documents, so a source that holds a third of all rows is no single task.

Null and empty texts have size 0 and are never taken. A null source is a source, the last one. Repeated
rows are documents of their own. An empty table gives an empty mix. The stage keeps all columns, whatever their names: they
travel as one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batch, table, whole_rows, written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    block: int = 128
    max_epochs: int = 3
    shards: int = 256
    max_sources: int = 100_000
    max_cells: int = 2_000_000
    bucket_rows: int = 4000
    seed: int = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets_of(sizes: list[int], weights: list[float], max_epochs: int) -> list[float]:
    """Shares of sum(sizes) by weight, none above max_epochs times its size; excess goes by weight to the rest."""
    out, cap = [0.0] * len(sizes), [float(max_epochs * s) for s in sizes]
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap[i]
        free -= set(over)
        left -= sum(cap[i] for i in over)
    return out


def draw_counts(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources counts. Each row is drawn multinomially by the slots still to give, held to them;
    what a bound holds back goes to the sources with most left. Columns sum to slots."""
    total, left = int(slots.sum()), slots.astype(np.int64).copy()
    out = np.zeros((shards, len(slots)), np.int64)
    for j in range(shards):
        n = total * (j + 1) // shards - total * j // shards
        if not n:
            continue
        rng = np.random.default_rng([seed, j])
        c = np.minimum(rng.multinomial(n, left / left.sum()), left)
        while (lack := n - int(c.sum())) > 0:
            rest = left - c
            more = np.minimum(rest, rng.multinomial(lack, rest / rest.sum()))
            c += more
        out[j] = c
        left -= c
    return out


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: a Feistel network on the next even power of two,
    walked until the value is below n. All arguments are arrays of one length."""
    n = np.asarray(n, np.uint64)
    half = np.ones(len(n), np.uint64)
    while (low := (np.uint64(1) << (half * np.uint64(2))) < n).any():
        half[low] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    y, todo = np.asarray(x, np.uint64).copy(), np.arange(len(n))
    key = np.asarray(key, np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = y[todo] >> h, y[todo] & m
        for r in range(4):
            f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        y[todo] = (left << h) | right
        todo = todo[y[todo] >= n[todo]]
    return y.astype(np.int64)


@dataclass
class MixPlan:
    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    counts: np.ndarray  # shards x sources
    params: MixParams

    def blocks(self) -> np.ndarray:
        return -(-np.array(self.sizes, np.int64) // self.params.block)


def plan_mix(sized: DataFrame, p: MixParams) -> MixPlan:
    """sized: source, size. Collects one row for each source, at most max_sources."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(p.max_sources + 1).collect()
    if len(rows) > p.max_sources:
        raise ValueError(f"more than {p.max_sources} sources")
    names, sizes = [r[0] for r in rows], [int(r[1]) for r in rows]
    weights = [p.weights[i % len(p.weights)] for i in range(len(names))]
    targets = targets_of(sizes, weights, p.max_epochs)
    blocks = -(-np.array(sizes, np.int64) // p.block)
    # A block of a source holds size/blocks words on average: so many slots meet its target.
    slots = np.array([round(t * b / s) if s else 0 for t, b, s in zip(targets, blocks.tolist(), sizes)], np.int64)
    slots = np.minimum(slots, p.max_epochs * blocks)
    shards = max(1, min(p.shards, p.max_cells // max(1, len(names)), int(slots.sum())))
    return MixPlan(names, sizes, targets, draw_counts(slots, shards, p.seed), p)


def positions(sized: DataFrame, plan: MixPlan) -> DataFrame:
    """sized plus src (the source's number) and start (words of its source before the document).
    sized must be written: it is read more than once and must not change."""
    p, spark = plan.params, sized.sparkSession
    # At most max_sources short rows: a proven bound.
    numbers = spark.createDataFrame([(i, x) for i, x in enumerate(plan.names)], "src int, source string")
    known = sized.join(F.broadcast(numbers), sized["source"].eqNullSafe(numbers["source"])).drop(numbers["source"])
    buckets = max(1, -(-sized.count() // p.bucket_rows))
    known = known.withColumn("__b", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(p.seed)), F.lit(buckets)))
    before = Window.partitionBy("src").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = known.groupBy("src", "__b").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("src", "__b").orderBy(F.xxhash64("doc_id", "text_hash", F.lit(p.seed + 1)), "doc_id", "text_hash", "size", *[c for c in ("at",) if c in sized.columns])
    known = known.withColumn("__in", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return known.join(bases, ["src", "__b"]).withColumn("start", F.col("base") + F.col("__in")).drop("__b", "base", "__in")


def slots_of(spark: SparkSession, plan: MixPlan) -> DataFrame:
    """(shard, slot, src, block, epoch): the mix, one row for each slot."""
    p, counts, blocks = plan.params, plan.counts, plan.blocks()
    total = int(counts.sum())
    sent = spark.sparkContext.broadcast((counts, np.cumsum(counts, axis=0) - counts, np.cumsum(counts.sum(axis=1)), blocks))

    def run(batch):
        per, before, ends, n_blocks = sent.value
        i = batch.column("id").to_numpy()
        shard = np.searchsorted(ends, i, side="right")
        size = per.sum(axis=1)
        slot = i - (ends[shard] - size[shard])
        rank = permute(slot, size[shard], shard.astype(np.uint64) * np.uint64(0x1000193) + np.uint64(p.seed))
        src, k = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        for s in np.unique(shard):
            own = shard == s
            cum = np.cumsum(per[s])
            src[own] = a = np.searchsorted(cum, rank[own], side="right")
            k[own] = before[s, a] + rank[own] - (cum[a] - per[s, a])
        epoch = k // n_blocks[src]
        key = (src * 131 + epoch).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(p.seed)
        return {"shard": shard, "slot": slot, "src": src, "block": permute(k % n_blocks[src], n_blocks[src], key), "epoch": epoch}

    parts = max(1, min(4096, total // 50_000 + 1))
    return by_batch(spark.range(0, total, 1, parts), run, "shard int, slot long, src int, block long, epoch int")


def pieces_of(placed: DataFrame, block: int) -> DataFrame:
    """Blocks as the parts of documents in them: placed's columns, block, from and n (words of the document)."""
    held = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    first, last = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return held.withColumn("from", first - F.col("start")).withColumn("n", last - first)


@dataclass
class Mix:
    plan: MixPlan
    placed: DataFrame  # documents with src, size, start
    taken: DataFrame  # src, block, and the piece's document, with shard, slot, epoch


def mix(sized: DataFrame, params: MixParams | None = None) -> Mix:
    """sized: doc_id, text_hash, source, size and, where rows are to be told apart, their number ``at``; a written table."""
    p = params or MixParams()
    plan = plan_mix(sized, p)
    placed = positions(sized, plan)
    return Mix(plan, placed, slots_of(sized.sparkSession, plan).join(pieces_of(placed, p.block), ["src", "block"]))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and how many of its words the mix takes."""
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", size_of(F.col("text")).alias("size")), "sizes")
    m = mix(sized)
    took = m.taken.groupBy("src", "start", "doc_id", "size").agg(F.sum("n").alias("taken"))
    # Placed documents with words are unique by (src, start); those without are never taken.
    rest = m.placed.where("size = 0").select("src", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    words = m.placed.where("size > 0").select("src", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    every = took.unionByName(words).groupBy("src", "start", "doc_id", "size").agg(F.sum("taken").alias("taken")).unionByName(rest)
    info = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(zip(m.plan.sizes, m.plan.targets))], "src int, source_size long, target double")
    return every.join(F.broadcast(info), "src").select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as the mix takes them. A document appears once for each epoch that
    takes some of its words, with those words (joined by a space where only parts are taken, verbatim
    where all are). Columns stay as they are; n_chars follows the text. Documents without words go."""
    keyed = written(docs.select(F.monotonically_increasing_id().alias("at"), whole_rows(docs).alias("row")), "to-mix")
    text = F.col("row.text")
    sized = written(keyed.select("row.doc_id", F.xxhash64(text).alias("text_hash"), "row.source", size_of(text).alias("size"), "at"), "sizes")
    m = mix(sized)
    parts = m.taken.groupBy("at", "epoch").agg(
        F.sum("n").alias("n"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("from", "n"))).alias("parts")
    )
    # A document comes once an epoch at most: short rows, past which the texts are streamed.
    both = keyed.join(parts.hint("shuffle_hash"), "at")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    # The outer transform binds the words once, however many parts a long text has.
    part = lambda w: F.transform("parts", lambda x: F.slice(w, (x["from"] + 1).cast("int"), x["n"].cast("int")))
    some = F.transform(F.array(words), lambda w: F.array_join(F.flatten(part(w)), " "))[0]
    both = both.select("row", F.when(F.col("n") == F.col("size"), text).otherwise(some).alias("new"))
    made = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return both.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
