"""N-gram Jaccard join: a MinHash LSH forest proposes, exact comparison decides.

1. A document is its set of word shingles (five words; a shorter document is one shingle). Documents with
   equal sets form one node; only nodes go on, with the number of their copies.
2. Each of ``trees`` MinHash signatures of ``longest`` values is a path in a prefix trie, kept as bytes whose
   order is the trie's. A trie's nodes at a depth are runs of equal prefixes of the sorted paths.
3. Nodes match at the longest prefix first; the matched prefix is shortened, value by value, until the measured
   recall reaches the target. Recall is measured against exact pairs: in the pass that makes the signatures every
   document is compared exactly with a sample of at most ``sample`` documents, and a similar pair tells the longest
   prefix that the two share in any tree. A depth's recall is the mean, over sampled documents that have
   links, of the share of links that meet at that depth; one pair right at the threshold, at the recall that the
   formula gives it, stands beside them, so that few links are no proof for a long prefix. As prefixes nest,
   groups at the final depth hold those of all longer ones and are formed once.
4. Nodes of a group are linked to its smallest node - as many rows as nodes, never pairs - and components
   of that graph are candidate groups.
5. A candidate group is compared exactly, all nodes with all, in blocks of about ``chunk`` nodes by
   ``chunk``. A block's intersections are matrix products; it returns one row per node (its links) and a
   spanning forest, not pairs. So no link inside a candidate group is lost, whatever its size or shape, at the
   cost of shingle sets being copied once for every ``chunk`` nodes they are compared with. A group of several
   blocks is first cut into bands of set sizes, each wide enough that two sets right at the threshold lie in
   one band or in neighbours; blocks of bands further apart hold no link and are not formed.
6. Links join nodes to classes.

Documents without words link to nothing and are classes of their own; null texts likewise. Rows that
repeat an id are documents of their own as long as the id is used for output only; a node's text is found by
its id and its text's hash, so rows that share an id, or have none, meet their own node only. Ties can't occur:
the class id is the smallest id. An empty table gives no rows.

Memory: the sample's shingles are broadcast, at most ``sample`` whole texts of 8 bytes a word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, by_batch, kept, scratch, table, utf8, whole_rows, written
from .components import components

P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    threshold: float = 0.8
    trees: int = 24
    longest: int = 8
    recall: float = 0.999
    sample: int = 512
    chunk: int = 768
    seed: int = 17

    def chance(self, similarity: float, depth: int) -> float:
        """That two sets of this similarity share a prefix of this depth in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    @property
    def band(self) -> float:
        """Width of a band of logarithms of set sizes; a little more than two linked sets can differ by."""
        return max(-math.log(max(self.threshold, 1e-9)), 1e-6) * 1.000001


class _Words(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


_words = _Words()


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles, over the whole text."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(w))
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h = h * P + w[k : len(w) - n + 1 + k]
    h ^= h >> np.uint64(31)
    h *= Q
    h ^= h >> np.uint64(29)
    return np.unique(h)


def set_hash(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


class Forest:
    """A set's paths: in each tree, ``longest`` MinHash values."""

    def __init__(self, p: JoinParams):
        rng = np.random.default_rng(p.seed)
        self.p, self.size = p, p.trees * p.longest
        self.a = rng.integers(0, 1 << 32, self.size, dtype=np.uint32)
        self.b = rng.integers(0, 1 << 31, self.size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def paths(self, s: np.ndarray) -> np.ndarray:
        """trees x longest values."""
        x = (s >> np.uint64(32)).astype(np.uint32)
        sig = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 512):
            np.minimum(sig, ((x[at : at + 512, None] ^ self.a) * self.b).min(axis=0), out=sig)
        return sig.reshape(self.p.trees, self.p.longest)


def shared_depth(a: np.ndarray, b: np.ndarray) -> int:
    """The longest prefix that two signatures share in any tree."""
    return int(np.cumprod(a == b, axis=1).sum(axis=1).max(initial=0))


class Sample:
    """Exact comparison of any set with a few: an index from shingles to the sample's sets."""

    def __init__(self, texts: list[bytes], p: JoinParams):
        forest, self.t = Forest(p), p.threshold
        sets = list({set_hash(s): s for s in (shingles(t, p.words) for t in texts) if len(s)}.items())
        self.nodes, sets = [n for n, _ in sets], [s for _, s in sets]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.paths = [forest.paths(s) for s in sets]
        flat = np.concatenate([np.empty(0, np.uint64), *sets])
        own = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.own, self.bounds = own[order], np.append(first, len(flat))

    def similar(self, node: bytes, s: np.ndarray, paths: np.ndarray) -> list[int]:
        """For each sampled set, but the node's own, of at least the threshold's similarity: its number * 16 + the
        depth at which the two meet."""
        if not len(self.keys):
            return []
        at = np.searchsorted(self.keys, s)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == s]
        if not len(at):
            return []
        lo, n = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        places = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        inter = np.bincount(self.own[places], minlength=len(self.sizes))
        close = np.flatnonzero(inter * (1 + self.t) >= self.t * (self.sizes + len(s)) - 1e-9)
        return [int(k) * 16 + min(15, shared_depth(self.paths[k], paths)) for k in close if self.nodes[k] != node]


def sample_of(docs: DataFrame, p: JoinParams) -> Sample:
    """At most p.sample different texts, chosen by a hash of the text: the same at every run."""
    n, span = docs.count(), 1 << 40
    rows = docs.select(utf8().alias("text")).withColumn("h", F.xxhash64("text", F.lit(p.seed))).where(F.length("text") > 0)
    if n > p.sample:
        rows = rows.where(F.pmod("h", F.lit(span)) < -(-span * 2 * p.sample // n))
    chosen = rows.dropDuplicates(["text"]).orderBy("h", "text").limit(p.sample)
    return Sample([bytes(r[0]) for r in chosen.select("text").collect()], p)


def signed(docs: DataFrame, key: str, p: JoinParams, sample: Sample) -> DataFrame:
    """(id, text_hash, node, size, paths, met): node is the hash of the shingle set, null where there are no words;
    paths are a tree's number and values as bytes; met is what Sample.similar says."""
    sent = docs.sparkSession.sparkContext.broadcast(sample)
    held = {}

    def run(batch):
        if "f" not in held:
            held["f"] = Forest(p)
        node, size, paths, met = [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text, p.words)
            node.append(set_hash(s))
            size.append(len(s))
            if not len(s):
                paths.append(None)
                met.append(None)
                continue
            sig = held["f"].paths(s)
            met.append(sent.value.similar(node[-1], s, sig) or None)
            paths.append([bytes((t,)) + row.tobytes() for t, row in enumerate(sig.byteswap())])
        return {"id": batch.column("id"), "text_hash": batch.column("text_hash"), "node": node, "size": size, "paths": paths, "met": met}

    if p.trees > 256 or p.longest > 15:
        raise ValueError("at most 256 trees of 15 values")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(utf8()).alias("text_hash"), utf8().alias("text"))
    return by_batch(rows, run, f"id {kind}, text_hash long, node binary, size int, paths array<binary>, met array<int>")


def measured_recall(signs: DataFrame, p: JoinParams) -> dict[int, float]:
    """Recall by depth, from the sample's exact links. At most p.sample times 16 rows are collected."""
    met = signs.where("met IS NOT NULL").select("node", F.explode("met").alias("m")).distinct()
    links: dict[int, dict[int, int]] = {}
    for m, n in met.groupBy("m").count().collect():
        links.setdefault(m // 16, {})[m % 16] = n
    out = {}
    for depth in range(1, p.longest + 1):
        shares = [sum(n for d, n in x.items() if d >= depth) / sum(x.values()) for x in links.values()]
        out[depth] = (sum(shares) + p.chance(p.threshold, depth)) / (len(shares) + 1)
    return out


def final_depth(recall: dict[int, float], p: JoinParams) -> int:
    """Shortens the matched prefix from the longest until the target is reached."""
    depth = p.longest
    while depth > 1 and recall[depth] < p.recall:
        depth -= 1
    return depth


def candidate_groups(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, root) of nodes(node, paths) that share a prefix of this depth with another node, through any chain.
    The sorted paths are walked once: equal prefixes are neighbours there."""
    trie = nodes.select("node", F.explode("paths").alias("path"))
    trie = trie.select("node", F.substring("path", 1, 1 + 4 * depth).alias("prefix"))
    groups = trie.groupBy("prefix").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return components(trie.join(groups, "prefix").select(F.col("node").alias("u"), "v"))


def links_between(a: list[np.ndarray], b: list[np.ndarray], threshold: float, columns: int = 4096) -> np.ndarray:
    """Boolean matrix: Jaccard similarity of a's and b's sets is at least threshold. Exact."""
    n, m = len(a), len(b)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if n * m <= 16:
        inter = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], np.float64)
    else:
        flat = np.concatenate([*a, *b])
        own = np.repeat(np.arange(n + m), np.concatenate([na, nb]))
        order = np.argsort(flat, kind="stable")
        flat, own = flat[order], own[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        col = np.cumsum(new) - 1
        keep = np.bincount(col)[col] > 1
        col, own = col[keep], own[keep]
        col = np.cumsum(np.r_[True, col[1:] != col[:-1]]) - 1 if len(col) else col
        inter = np.zeros((n, m))
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
            lo, hi = np.searchsorted(col, (at, at + columns))
            x = np.zeros((n + m, columns), np.float32)
            x[own[lo:hi], col[lo:hi] - at] = 1
            inter += x[:n] @ x[n:].T
    return inter * (1 + threshold) >= threshold * (na[:, None] + nb[None]) - 1e-9


def forest_of(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest row of its component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None], len(label)).min(axis=1, initial=len(label)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def compare_block(nodes: list[bytes], chunks: list[int], copies: list[int], sets: list[np.ndarray], i: int, j: int, t: float):
    """(node, links, root) for the nodes of a block that have links: within chunk i, or between i and j."""
    order = np.argsort(chunks, kind="stable") if i != j else np.arange(len(nodes))
    first = [k for k in order if chunks[k] == i]
    second = [k for k in order if chunks[k] == j] if i != j else first
    at = first + (second if i != j else [])
    if not first or not second or len(at) < 2:
        return []
    got = links_between([sets[k] for k in first], [sets[k] for k in second], t)
    if i == j:
        np.fill_diagonal(got, False)
        full = got
    else:
        full = np.zeros((len(at), len(at)), bool)
        full[: len(first), len(first) :] = got
        full[len(first) :, : len(first)] = got.T
    weight = full @ np.array([copies[k] for k in at], np.int64)
    root = forest_of(full)
    return [(nodes[k], int(w), nodes[at[r]]) for k, w, r in zip(at, weight, root) if w]


def members(nodes: DataFrame, groups: DataFrame, p: JoinParams) -> DataFrame:
    """(node, rep0, hash0, copies, grp, chunk, others, alone): a node's chunk in its group and the chunks that it is compared
    with, its own included. A group of up to p.chunk nodes is one chunk; in others a chunk is part of a band."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    known = nodes.select("node", F.col("rep").alias("rep0"), F.col("rep_hash").alias("hash0"), "copies", "size")
    d = written(groups.join(sizes, "root").join(known, "node"), "members")
    d = d.withColumn("alone", F.col("n") <= p.chunk).withColumn("band", F.floor(F.log("size") / p.band))
    counts = d.where("NOT alone").groupBy("root", "band").agg(F.ceil(F.count("*") / p.chunk).alias("chunks"))
    bands = counts.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", "chunks"))).alias("bands"))
    d = d.join(bands, "root", "left")  # a row for every p.chunk nodes at most; Spark broadcasts it by measured size

    def name(band, k):
        return band * 10_000_000 + k

    def chunks_of(band):
        n = F.coalesce(F.try_element_at("bands", band), F.lit(0).cast("long"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: name(band, k))).otherwise(F.array().cast("array<long>"))

    band, zero = F.col("band"), F.lit(0).cast("long")
    own = name(band, F.pmod(F.xxhash64("node"), F.try_element_at("bands", band)))
    return d.select(
        "node", "rep0", "hash0", "copies", F.col("root").alias("grp"), F.when(F.col("alone"), zero).otherwise(own).alias("chunk"),
        F.when(F.col("alone"), F.array(zero)).otherwise(F.concat(*[chunks_of(band + k) for k in (-1, 0, 1)])).alias("others"), "alone",
    )


def compared(docs: DataFrame, key: str, nodes: DataFrame, groups: DataFrame, p: JoinParams) -> DataFrame:
    """(node, links, root, alone): links counts documents; alone marks groups of one block, whose root is final."""
    texts = docs.select(F.col(key).alias("rep"), F.xxhash64(utf8()).alias("text_hash"), utf8().alias("text"))
    # The texts move once and are streamed past the members, which are short rows.
    wanted = members(nodes, groups, p).hint("shuffle_hash")
    both = texts.join(wanted, F.col("rep").eqNullSafe(F.col("rep0")) & (F.col("text_hash") == F.col("hash0")))

    def cut(batch):
        s = [shingles(t, p.words) for t in batch.column("text").to_pylist()]
        ok = [set_hash(x) == n for x, n in zip(s, batch.column("node").to_pylist())]
        kept = batch.filter(pa.array(ok, pa.bool_()))
        return {c: kept.column(c) for c in kinds} | {"s": [x.tobytes() for x, o in zip(s, ok) if o]}

    kinds = {"node": "binary", "copies": "long", "grp": "binary", "chunk": "long", "others": "array<long>", "alone": "boolean"}
    sets = by_batch(both.select(*kinds, "text"), cut, ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", s binary")
    sets = sets.withColumn("o", F.explode("others")).withColumn("i", F.least("chunk", "o")).withColumn("j", F.greatest("chunk", "o")).drop("o", "others")
    dealt = sets.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")
    arrow = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("root", pa.binary()), ("alone", pa.bool_())])

    def run(batches):
        held, now = {}, None  # node -> (chunk, copies, set) of the current block
        rows = []

        def close():
            if len(held) > 1:
                nodes_ = list(held)
                ch, co, se = zip(*held.values())
                rows.extend((*r, now[3]) for r in compare_block(nodes_, list(ch), list(co), list(se), now[1], now[2], p.threshold))
            held.clear()

        def flush():
            cols = list(zip(*rows)) or [[]] * 4
            out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow)], schema=arrow)
            rows.clear()
            return out

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("grp", "i", "j", "alone", "node", "chunk", "copies", "s")]
            for *block, node, chunk, copies, s in zip(*cols):
                if now != block:
                    close()
                    now = block
                held[node] = (chunk, copies, np.frombuffer(s, np.uint64))
            if len(rows) > 5000:
                yield flush()
        if now:
            close()
        yield flush()

    return dealt.mapInArrow(run, "node binary, links long, root binary, alone boolean")


def join_ngrams(docs: DataFrame, key: str = "doc_id", params: JoinParams | None = None) -> DataFrame:
    """(id, class_id, n_links): the class's smallest id and the number of other documents that are similar. The result is
    a written table; what was written on the way to it is gone."""
    with scratch(docs.sparkSession):
        return kept(written(_join(docs, key, params or JoinParams()), "classes"))


def _join(docs: DataFrame, key: str, p: JoinParams) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    signs = written(signed(docs, key, p, sample_of(docs, p)), "signatures")
    depth = final_depth(measured_recall(signs, p), p)
    # A node's text is that of its smallest id; among rows that share this id, of the smallest hash.
    nodes = signs.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("null"), "id", "text_hash")).alias("least"),
        F.count("*").alias("copies"), F.first("size").alias("size"), F.first("paths").alias("paths"),
    )
    nodes = written(nodes.select("node", F.col("least.id").alias("rep"), F.col("least.text_hash").alias("rep_hash"), "copies", "size", "paths"), "nodes")
    with scratch(spark):
        groups = kept(written(candidate_groups(nodes, depth), "groups"))
    with scratch(spark):
        found = kept(written(compared(docs, key, nodes, groups, p), "links"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("NOT alone").select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = found.where("alone").select("node", "root").unionByName(components(edges))
    classes = roots.join(nodes.select("node", "rep"), "node")
    least = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = classes.join(least, "root").select("node", "class_id").join(links, "node")
    info = nodes.select("node", "rep", "copies").join(known, "node", "left").select(
        "node", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    ids = signs.select("id", "node")
    full = ids.where("node IS NOT NULL").join(info, "node").select("id", "class_id", "n_links")
    bare = ids.where("node IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(bare)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join_ngrams(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, the first by id. Columns stay as they are, whatever their
    names: they travel as one struct."""
    order = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    at = F.struct(F.col("doc_id").alias("d"), order.alias("r"))
    keyed = written(docs.select(at.alias("at"), whole_rows(docs).alias("row")), "to-join")
    found = join_ngrams(keyed.select("at", "row.text"), "at")
    firsts = found.where(F.col("id") == F.col("class_id")).select(F.col("id").alias("at"))
    rows = keyed.select("at", "row").join(firsts.hint("shuffle_hash"), "at", "left_semi")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
