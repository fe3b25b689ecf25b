"""Exact top-k search with a bit-sliced index.

Vectors become integers, floor(1024 * x). Rows are packed into blocks of at most ``block_values`` numbers;
a block keeps, for each component, bit slices (bitmaps over its rows, two's complement) of the component
without its ``drop`` lowest bits. For a query the slices are added with bitmap arithmetic: each set digit
of a query component (in signed-digit form) adds that component's slices at its weight, by carry-save
adders on 64 rows at a time. The sum's slices are then read from the most significant downward to find
the k-th coarse score. What was dropped moves a score by an amount with a known bound, so every row
whose coarse score could still reach the k-th is a boundary row; those are scored exactly by integer
inner products, and ties go to the smaller id. Results are exact whatever ``drop`` is.

Queries are a stated set and meet all rows block by block. Row blocks are dealt to at most ``lanes`` lanes and query
blocks to groups; a task keeps the k best rows of each query of its group while the blocks of its lane
pass, so at most lanes x k rows a query are merged, however many blocks there are.

Vectors that are null, or hold a null or a non-finite component, take no part. A vector meets only
vectors of its own length. Repeated rows are rows of their own: a query is kept only from its own row.
A null id takes part as a candidate, after other ids in ties, and is never a query. Components beyond
2^23 after scaling go into wide blocks, which are scored exactly without slices; a score beyond a long is
the nearest long, and ranks and ties go by that. A scaled component beyond 2^1000 counts as 2^1000.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, table, written

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class TopKParams:
    k: int = 10
    scale: float = 1024.0
    drop: int = 5
    block_values: int = 1 << 20
    query_block: int = 128
    largest: int = 1 << 23
    lanes: int = 512
    group_blocks: int = 256


def quantise(v, scale: float) -> np.ndarray | None:
    """Components as whole numbers in floats, or None if the vector takes no part."""
    if v is None:
        return None
    a = np.array([np.nan if x is None else x for x in v] if isinstance(v, list) else v, np.float64)
    if not np.isfinite(a).all():
        return None
    with np.errstate(over="ignore"):
        return np.clip(np.floor(a * scale), -(2.0**1000), 2.0**1000)


def blocks(vectors: DataFrame, is_query: Column, p: TopKParams) -> DataFrame:
    """(block, dim, wide, n, ids, nulls, queries, values): rows of one partition and length, packed."""

    def pack(block, dim, wide, ids, qs, values):
        x = np.concatenate(values)
        null = np.array([i is None for i in ids], bool)
        return block, dim, wide, len(ids), np.array([0 if i is None else i for i in ids], np.int64).tobytes(), null.tobytes(), np.array(qs, bool).tobytes(), x.astype(np.float64 if wide else np.int32).tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId() << 32, 0
        held: dict[tuple[int, bool], tuple[list, list, list]] = {}
        names = ("block", "dim", "wide", "n", "ids", "nulls", "queries", "values")

        def out(kind):
            nonlocal made
            row = pack(part + made, *kind, *held.pop(kind))
            made += 1
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, row)}, schema=arrow)

        for batch in batches:
            for i, q, v in zip(batch.column("id").to_pylist(), batch.column("q").to_pylist(), batch.column("v").to_pylist()):
                x = quantise(v, p.scale)
                if x is None:
                    continue
                kind = len(x), bool(np.abs(x).max(initial=0) > p.largest)
                ids, qs, values = held.setdefault(kind, ([], [], []))
                ids.append(i)
                qs.append(bool(q) and i is not None)
                values.append(x[None])
                if len(ids) >= max(64, p.block_values // max(1, len(x))):
                    yield out(kind)
        for kind in list(held):
            yield out(kind)

    arrow = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("wide", pa.bool_()), ("n", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("queries", pa.binary()), ("values", pa.binary())])
    kind = "block long, dim int, wide boolean, n int, ids binary, nulls binary, queries binary, values binary"
    return vectors.select(F.col("vec_id").alias("id"), is_query.alias("q"), F.col("embedding").alias("v")).mapInArrow(run, kind)


def _bits(mask: np.ndarray) -> np.ndarray:
    """A boolean array as 64-bit words, first row lowest."""
    packed = np.packbits(mask, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def _rows(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def digits(q: int) -> list[tuple[int, int]]:
    """Signed digits (sign, power) of q, no two neighbours set."""
    out, at = [], 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            out.append((d, at))
            q -= d
        q >>= 1
        at += 1
    return out


class SlicedBlock:
    """Slices of one block of rows."""

    def __init__(self, x: np.ndarray, drop: int):
        self.x, self.drop, self.n = x, drop, len(x)
        coarse = x >> drop
        self.width = max(1, int(np.abs(coarse).max(initial=0)).bit_length()) + 1
        self.slices = [[_bits((coarse[:, d] >> b) & 1 == 1) for b in range(self.width)] for d in range(x.shape[1])]
        self.all = _bits(np.ones(self.n, bool))
        self.zero = np.zeros_like(self.all)

    def coarse_sum(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices (two's complement, lowest first) of sum(q * coarse), and how many."""
        terms = [(s, w, d) for d in range(len(q)) for s, w in digits(int(q[d]))]
        top = int(np.abs(q).sum()).bit_length() + self.width + 1
        columns: list[list[np.ndarray]] = [[] for _ in range(top + 1)]
        constant = 0
        for sign, w, d in terms:
            s = self.slices[d]
            # Two's complement: value = sum(bit * 2^b) - sign_bit * 2^(width-1). A bit that counts -2^k is
            # the inverted bit at 2^k less the constant 2^k.
            for b, bits in enumerate(s):
                negative = (b == self.width - 1) != (sign < 0)
                columns[w + b].append(~bits if negative else bits)
                constant -= (1 << (w + b)) if negative else 0
        constant &= (1 << (top + 1)) - 1
        for k in range(top + 1):
            if constant >> k & 1:
                columns[k].append(np.full_like(self.all, ONES))
        out = []
        for k in range(top + 1):
            col = columns[k]
            carry = columns[k + 1] if k < top else None
            while len(col) >= 3:
                a, b, c = col.pop(), col.pop(), col.pop()
                ab = a ^ b
                col.insert(0, ab ^ c)
                if carry is not None:
                    carry.append((a & b) | (ab & c))
            if len(col) == 2:
                a, b = col
                col[:] = [a ^ b]
                if carry is not None:
                    carry.append(a & b)
            out.append(col[0] if col else self.zero)
        return out, top + 1

    def top(self, q: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best, and their exact scores."""
        live = self.all.copy()
        if own is not None:
            live[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        if int(np.bitwise_count(live).sum()) > k:
            s, width = self.coarse_sum(q)
            s[-1] = ~s[-1]  # sign flipped: unsigned order
            sure, even, kth = self.zero, live, 0
            for b in range(width - 1, -1, -1):
                x = sure | (even & s[b])
                n = int(np.bitwise_count(x).sum())
                if n >= k:
                    even = even & s[b]
                    kth |= 1 << b
                else:
                    sure = x
                    even = even & ~s[b]
            # The dropped bits of a component add between 0 and 2^drop - 1, times the query's component.
            low = (1 << self.drop) - 1
            slack = -(-int(np.abs(q).sum()) * low // (1 << self.drop))
            live = live & self.at_least(s, max(0, kth - slack))
        rows = _rows(live, self.n)
        return rows, self.x[rows] @ q

    def at_least(self, s: list[np.ndarray], value: int) -> np.ndarray:
        more, even = self.zero, np.full_like(self.all, ONES)
        for b in range(len(s) - 1, -1, -1):
            if value >> b & 1:
                even = even & s[b]
            else:
                more = more | (even & s[b])
                even = even & ~s[b]
        return more | even


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with q, whole numbers in floats; beyond a long they are the nearest long."""
    if x.size and np.abs(x).max() * np.abs(q).max(initial=0) * len(q) < 2.0**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole)), -(1 << 63)), (1 << 63) - 1) for row in x], np.int64)


class WideBlock:
    """A block of rows with components beyond ``largest``: scored exactly, all of them."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)

    def top(self, q: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(self.n)
        rows = rows if own is None else rows[rows != own]
        return rows, exact_scores(self.x[rows], q)


class Best:
    """The k best partners of one query so far."""

    def __init__(self, home: int, at: int, query_id: int, q: np.ndarray, wide: bool):
        self.home, self.at, self.query_id, self.q, self.wide = home, at, query_id, q, wide
        self.score, self.ids, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def meet(self, number: int, block, ids: np.ndarray, null: np.ndarray, k: int) -> None:
        own = self.at if self.home == number else None
        if self.wide and isinstance(block, SlicedBlock):
            block = WideBlock(block.x.astype(np.float64))
        rows, score = block.top(self.q.astype(np.float64) if isinstance(block, WideBlock) else self.q, k, own)
        score, ids, null = np.concatenate([self.score, score]), np.concatenate([self.ids, ids[rows]]), np.concatenate([self.null, null[rows]])
        # ~score falls as score rises and, unlike -score, never overflows.
        best = np.lexsort((ids, null, ~score))[:k]
        self.score, self.ids, self.null = score[best], ids[best], null[best]


def values_of(row: dict) -> np.ndarray:
    """A block's numbers: whole numbers as longs, or in floats if the block is wide."""
    x = np.frombuffer(row["values"], np.float64 if row["wide"] else np.int32).reshape(row["n"], row["dim"])
    return x if row["wide"] else x.astype(np.int64)


def search(vectors: DataFrame, is_query: Column, params: TopKParams | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors(vec_id, embedding) for the rows where is_query holds."""
    p = params or TopKParams()
    bounded_batches(vectors.sparkSession)
    built = written(blocks(vectors, is_query, p), "vector-blocks")

    def queries_of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["values"], np.float64 if row["wide"] else np.int32).reshape(row["n"], row["dim"])
                at = np.flatnonzero(np.frombuffer(row["queries"], bool))
                for i in range(0, len(at), p.query_block):
                    a = at[i : i + p.query_block]
                    made = {"block": row["block"], "dim": row["dim"], "wide": row["wide"], "n": len(a), "ids": ids[a].tobytes(), "nulls": a.astype(np.int32).tobytes(), "values": x[a].tobytes()}
                    yield pa.RecordBatch.from_pydict({k: [v] for k, v in made.items()}, schema=qarrow)

    names = ("block", "dim", "wide", "n", "ids", "nulls", "values")  # of queries, nulls holds their places in the block
    qarrow = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("wide", pa.bool_()), ("n", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("values", pa.binary())])
    asked = written(built.mapInArrow(queries_of, "block long, dim int, wide boolean, n int, ids binary, nulls binary, values binary"), "query-blocks")
    # A task holds the queries of a group and streams the row blocks of a lane past them: it returns k rows a query,
    # however many blocks it sees. Lanes and groups are numbered, so that a task is one pair of them.
    lanes = max(1, min(built.count(), p.lanes))
    groups = max(1, -(-asked.count() // p.group_blocks))
    lane, group = F.pmod(F.xxhash64("block"), F.lit(lanes)), F.pmod(F.xxhash64("block", "nulls"), F.lit(groups))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = built.select(lane.alias("lane"), F.lit(1).alias("kind"), *names).withColumn("group", spread(groups))
    queries = asked.select(group.alias("group"), F.lit(0).alias("kind"), *names).withColumn("lane", spread(lanes))
    work = rows.unionByName(queries).repartition(lanes * groups, "lane", "group").sortWithinPartitions("lane", "group", "kind", "block")

    def find(batches):
        now, held = None, {}

        def out():
            every = [b for qs in held.values() for b in qs]
            held.clear()
            cols = {"qrow": [], "query_id": [], "vec_id": [], "score": []}
            for b in every:
                cols["qrow"] += [f"{b.home}-{b.at}"] * len(b.score)
                cols["query_id"] += [b.query_id] * len(b.score)
                cols["vec_id"] += [None if n else i for i, n in zip(b.ids.tolist(), b.null.tolist())]
                cols["score"] += b.score.tolist()
            return pa.RecordBatch.from_pydict(cols, schema=farrow)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("lane", "group", "kind", *names)}
                if now != (row["lane"], row["group"]):
                    yield out()
                    now = row["lane"], row["group"]
                x, ids = values_of(row), np.frombuffer(row["ids"], np.int64)
                if row["kind"] == 0:
                    places = np.frombuffer(row["nulls"], np.int32).tolist()
                    held.setdefault(row["dim"], []).extend(Best(row["block"], at, qid, q, row["wide"]) for at, qid, q in zip(places, ids.tolist(), x))
                elif held.get(row["dim"]):
                    block = WideBlock(x) if row["wide"] else SlicedBlock(x, p.drop)
                    for b in held[row["dim"]]:
                        b.meet(row["block"], block, ids, np.frombuffer(row["nulls"], bool), p.k)
        yield out()

    farrow = pa.schema([("qrow", pa.string()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    local = written(work.mapInArrow(find, "qrow string, query_id long, vec_id long, score long"), "lane-tops")
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    best = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every vector whose id is divisible by 100, among all other rows."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
