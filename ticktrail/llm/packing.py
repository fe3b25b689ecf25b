"""Packing: shortest-pack-first over the length histogram.

Documents become token ids (then one end id) and are cut into pieces of at most ``capacity`` ids: full
pieces and a rest. Pieces are counted by length; the histogram, at most ``capacity`` numbers, is all that
the driver sees. It places lengths longest first: the pieces of a length go into the open packs with the
most room, by updating counts of packing patterns, and new packs open only where no room is left. A
pattern is thus a list of lengths with a count; the number of patterns depends on the lengths there are,
not on the documents.

Patterns meet pieces by (length, rank): rank numbers the pieces of a length by two-level prefix sums, per
(length, bucket) and within a bucket, so a length that a third of all pieces share is no single task.

The ids are those of the ``tokenizers`` library with add_special_tokens=False. Texts without a special
token's string take the equal and faster byte-pair merges of tiktoken over the same ranks (where the
ranks' file is given); the two are compared in the tests.

Null texts are empty: one piece with the end id. Repeated rows are documents of their own. An empty
table has no sequences.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batch, table, written

END = 0


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@dataclass(frozen=True)
class PackParams:
    """tokenizer: a file for the tokenizers library; ranks and pattern: the same vocabulary for tiktoken, or None."""

    tokenizer: str = field(default_factory=lambda: public_path("byte_bpe_50k.json"))
    ranks: str | None = field(default_factory=lambda: public_path("byte_bpe_50k.tiktoken"))
    pattern: str = field(default_factory=public_pattern)
    capacity: int = 1024
    bucket_rows: int = 4000
    seed: int = 9


_tokenizers: dict = {}


def encoder(p: PackParams):
    """A function of a text that returns its ids; loaded once for each Python worker."""
    if p in _tokenizers:
        return _tokenizers[p]
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(p.tokenizer)
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    if p.ranks is None:
        _tokenizers[p] = plain
        return plain
    import tiktoken

    with open(p.ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def ids(text: str):
        if any(s in text for s in special):
            return plain(text)
        return fast.encode_ordinary(text)

    _tokenizers[p] = ids
    return ids


def pieces(docs: DataFrame, p: PackParams, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every document's ids, cut at multiples of capacity."""

    def run(batch):
        enc = encoder(p)
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        kept = []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = np.array([*enc(text or ""), END], "<u4")
            for at in range(0, len(ids), p.capacity):
                part = ids[at : at + p.capacity]
                out["doc_id"].append(i)
                out["start"].append(at)
                out["length"].append(len(part))
                out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                out["doc_tokens"].append(len(ids))
                if keep_ids:
                    kept.append(part.astype(np.int32))
        return out | ({"ids": kept} if keep_ids else {})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    return by_batch(docs.select("doc_id", "text"), run, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, count) that use up the histogram. Packs with most room are filled first."""
    room: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, count]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        made = []
        while left:
            most = max((r for r, packs in room.items() if packs), default=0)
            if most < length:
                made.append((capacity - length, [(length,), left]))
                break
            pack = room[most][-1]
            take = min(left, pack[1])
            left -= take
            pack[1] -= take
            if not pack[1]:
                room[most].pop()
            made.append((most - length, [(*pack[0], length), take]))
            if most - length >= length and left:  # the same packs may take this length again
                room[most - length].append(made.pop()[1])
        for r, pack in made:
            room[r].append(pack)
    return [(tuple(pack), n) for r in sorted(room) for pack, n in room[r] if n]


def runs_of(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first_rank, count, first_sequence, offset): which pieces of a length a pattern's slot takes."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            out.append((x, rank[x], n, sequence, offset))
            rank[x] += n
            offset += x
        sequence += n
    return out


def ranked(cut: DataFrame, p: PackParams) -> DataFrame:
    """cut (written) with rank, from 0, among the pieces of its length."""
    buckets = max(1, -(-cut.count() // p.bucket_rows))
    known = cut.withColumn("__b", F.pmod(F.xxhash64("doc_id", "start", F.lit(p.seed)), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = known.groupBy("length", "__b").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "__b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    known = known.withColumn("__in", F.row_number().over(within) - 1)
    return known.join(bases, ["length", "__b"]).withColumn("rank", F.col("base") + F.col("__in")).drop("__b", "base", "__in")


def pack(docs: DataFrame, params: PackParams | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for docs(doc_id, text)."""
    p = params or PackParams()
    cut = written(pieces(docs, p, keep_ids), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    runs = runs_of(shortest_pack_first(histogram, p.capacity))
    runs_df = docs.sparkSession.createDataFrame(runs, "length long, first_rank long, n long, first_sequence long, offset long")
    # The runs of patterns depend on the histogram's at most ``capacity`` lengths: a proven bound.
    found = ranked(cut, p).join(F.broadcast(runs_df), "length").where("rank >= first_rank AND rank < first_rank + n")
    out = found.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, length): the token sequences of pack(keep_ids=True); a group holds at most capacity ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    return whole.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), "length")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of docs and their places."""
    return pack(docs.select("doc_id", "text"))
