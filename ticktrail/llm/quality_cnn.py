"""Quality classifier: a byte-level convolutional network in numpy.

A byte is embedded in EMBED numbers; filters WIDTH bytes wide move over overlapping chunks that together cover the
whole document: STRIDE bytes at a time at one alignment, and features are pooled over all alignments, so that a byte
more at a text's front moves no feature much. Each filter is max-pooled over a chunk; the largest,
mean and smallest of a document's chunk maxima feed one logistic output. As WIDTH is twice STRIDE, a filter is two
half filters applied to neighbouring blocks, so a chunk's convolution is one matrix product and nothing
is copied for the overlap.

Training is on the driver, on at most ``max_rows`` labelled documents, each with its whole text: filters learn
from every chunk at one alignment, and the output layer is fitted to the features that scoring computes. The driver's memory
goes by those rows' texts. Scoring reads every byte of every text, batch by batch, and shuffles nothing. Null and empty texts are one chunk of padding and get the score that the
network gives it. Repeated rows are scored each; of rows that repeat an id training takes one. Without labels every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, hash_sample, label_ids, one_row_an_id, remainder, table, utf8

EMBED, STRIDE, WIDTH = 8, 6, 12
CHUNK = 510  # bytes; a multiple of STRIDE
PER = CHUNK // STRIDE  # filter positions of a chunk
SHIFTS = range(STRIDE)  # alignments of the filters: pooled over all, they step one byte at a time
PIECE = 64  # chunks whose products training holds at once


@dataclass(frozen=True)
class CnnParams:
    """max_rows bounds the labelled rows that training collects; their texts are whole."""

    filters: int = 32
    max_rows: int = 2400
    epochs: int = 14
    batch: int = 64
    rate: float = 0.004
    seed: int = 5


def blocks_of(data: bytes) -> np.ndarray:
    """The bytes as rows of STRIDE, padded with zero bytes to at least WIDTH."""
    size = max(WIDTH, -(-len(data) // STRIDE) * STRIDE)
    return np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, STRIDE)


def summary(tops: np.ndarray) -> np.ndarray:
    """Largest, mean and smallest of the chunks' maxima, per filter."""
    return np.concatenate([tops.max(axis=0), tops.mean(axis=0), tops.min(axis=0)])


@dataclass
class Cnn:
    emb: np.ndarray  # 256 x EMBED
    w: np.ndarray  # (STRIDE * EMBED) x 2F: first and second half of each filter
    b: np.ndarray  # F
    v: np.ndarray  # 3F: weights of the chunks' maxima in summary()
    c: float
    mu: np.ndarray
    sd: np.ndarray

    @property
    def filters(self) -> int:
        return len(self.b)

    def halves(self, blocks: np.ndarray) -> np.ndarray:
        return self.emb[blocks].reshape(len(blocks), -1) @ self.w

    def tops(self, data: bytes, pieces: int = 4096) -> np.ndarray:
        """Each filter's maximum over each chunk, at one alignment. A chunk starts every CHUNK bytes and ends a filter's
        width into the next, so chunks overlap."""
        blocks, f = blocks_of(data), self.filters
        tops = []
        pieces = pieces // PER * PER
        for at in range(0, max(1, len(blocks) - 1), pieces):
            h = self.halves(blocks[at : at + pieces + 1])
            z = h[:-1, :f] + h[1:, f:]
            tops.append(np.maximum.reduceat(z, np.arange(0, len(z), PER), axis=0))
        return np.concatenate(tops)

    def pooled(self, data: bytes) -> np.ndarray:
        """summary() of the document's chunks, each filter at its best over SHIFTS."""
        top = self.tops(data)
        for shift in SHIFTS[1:]:
            if len(data) >= shift + WIDTH:
                more = self.tops(data[shift:])
                np.maximum(top[: len(more)], more, out=top[: len(more)])
        return summary(np.maximum(top + self.b, 0))

    def score(self, data: bytes) -> float:
        z = float((self.pooled(data) - self.mu) / self.sd @ self.v + self.c)
        return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


class Chunks:
    """The chunks of whole texts: at is a chunk's first block in flat, wins its filter positions."""

    def __init__(self, texts: list[bytes]):
        blocks = [blocks_of(t) for t in texts]
        sizes = np.array([len(b) for b in blocks])
        self.flat = np.concatenate(blocks)
        self.n = -(-(sizes - 1) // PER)
        self.first = np.cumsum(self.n) - self.n
        own = np.repeat(np.arange(len(texts)), self.n)
        k = (np.arange(len(own)) - self.first[own]) * PER
        self.at, self.wins = (np.cumsum(sizes) - sizes)[own] + k, np.minimum(PER, sizes[own] - 1 - k)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of these texts, and which of the rows each belongs to."""
        own = np.repeat(np.arange(len(rows)), self.n[rows])
        skipped = np.cumsum(self.n[rows]) - self.n[rows]
        return self.first[rows][own] + np.arange(len(own)) - skipped[own], own

    def tops(self, emb: np.ndarray, w: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over each chunk, and the block of flat where it starts."""
        f, tops, rows = w.shape[1] // 2, [], []
        for s in range(0, len(which), PIECE):
            at, wins = self.at[which[s : s + PIECE]], self.wins[which[s : s + PIECE]]
            blocks = self.flat[np.minimum(at[:, None] + np.arange(PER + 1), len(self.flat) - 1)]
            h = (emb[blocks].reshape(-1, STRIDE * EMBED) @ w).reshape(len(at), PER + 1, 2 * f)
            z = h[:, :-1, :f] + h[:, 1:, f:]
            z[np.arange(PER) >= wins[:, None]] = -np.inf  # a filter doesn't reach over a text's end
            best = z.argmax(axis=1)
            tops.append(np.take_along_axis(z, best[:, None], axis=1)[:, 0])
            rows.append(best + at[:, None])
        return np.concatenate(tops), np.concatenate(rows)


def fit(texts: list[bytes], y: np.ndarray, p: CnnParams) -> Cnn:
    """Adam on the logistic loss over whole texts. Classes weigh the same in the filters' training; the
    output layer is then fitted to the true shares by Newton steps."""
    rng = np.random.default_rng(p.seed)
    f = p.filters
    par = {
        "emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "w": rng.normal(0, (STRIDE * EMBED * 2) ** -0.5, (STRIDE * EMBED, 2 * f)).astype(np.float32),
        "b": np.zeros(f, np.float32), "v": rng.normal(0, 0.1, 2 * f).astype(np.float32), "c": np.zeros(1, np.float32),
    }
    model = lambda mu, sd: Cnn(par["emb"], par["w"], par["b"], par["v"], float(par["c"][0]), mu, sd)
    one, zero = np.ones(3 * f, np.float32), np.zeros(3 * f, np.float32)
    if len(set(y.tolist())) < 2:
        m = model(zero, one)
        m.v = zero
        m.c = 0.0
        return m
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in par.items()}
    chunks = Chunks(texts)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    step = 0
    for _ in range(p.epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), p.batch):
            at = order[s : s + p.batch]
            which, own = chunks.of(at)
            top, row = chunks.tops(par["emb"], par["w"], which)
            a = np.maximum(top + par["b"], 0)
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            n = np.bincount(own, minlength=len(at))[:, None]
            mx, mean = np.maximum.reduceat(a, first, axis=0), np.add.reduceat(a, first, axis=0) / n
            feat = np.concatenate([mx, mean], axis=1)
            q = 1 / (1 + np.exp(-np.clip(feat @ par["v"] + par["c"][0], -30, 30)))
            d = ((q - y[at]) * weight[at] / len(at)).astype(np.float32)
            g = {"v": feat.T @ d, "c": np.array([d.sum()], np.float32)}
            df = d[:, None] * par["v"][None]
            da = (df[:, f:] / n)[own] + df[:, :f][own] * (a == mx[own])
            da *= a > 0
            g["b"] = da.sum(axis=0)
            ci, fi = np.nonzero(da)
            ri, val = row[ci, fi], da[ci, fi]
            hot, to = np.unique(np.concatenate([ri, ri + 1]), return_inverse=True)
            x = par["emb"][chunks.flat[hot]].reshape(len(hot), -1)
            dh = np.zeros((len(hot), 2 * f), np.float32)
            np.add.at(dh, (to, np.concatenate([fi, fi + f])), np.concatenate([val, val]))
            g["w"] = x.T @ dh
            dx = (dh @ par["w"].T).reshape(-1, EMBED)
            ge = np.zeros_like(par["emb"])
            np.add.at(ge, chunks.flat[hot].reshape(-1), dx)
            g["emb"] = ge
            step += 1
            for k in par:
                m1, m2 = mom[k]
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.001 * (g[k] ** 2 - m2)
                par[k] -= p.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-7)
    body = model(zero, one)
    feats = np.array([body.pooled(t) for t in texts])
    mu, sd = feats.mean(axis=0), feats.std(axis=0) + 1e-3
    xs = np.concatenate([(feats - mu) / sd, np.ones((len(texts), 1))], axis=1)
    beta = np.zeros(3 * f + 1)
    ridge = np.r_[np.full(3 * f, 1.0), 1e-6]
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(xs @ beta, -30, 30)))
        grad = xs.T @ (q - y) + ridge * beta
        hess = (xs * (q * (1 - q))[:, None]).T @ xs + np.diag(ridge + 1e-6)
        delta = np.linalg.solve(hess, grad)
        beta -= delta
        if np.abs(delta).max() < 1e-6:
            break
    return Cnn(par["emb"], par["w"], par["b"], beta[:-1], float(beta[-1]), mu, sd)


def train(docs: DataFrame, labels: DataFrame, params: CnnParams | None = None, folds: int = 3, held_out: int = 1) -> Cnn:
    p = params or CnnParams()
    known = label_ids(labels, "quality", folds, held_out)
    chosen = hash_sample(known, p.max_rows, p.seed).join(known, "doc_id")  # at most max_rows ids: bounded broadcast
    got = one_row_an_id(docs, chosen).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    x, y = got.column("text").to_pylist(), got.column("y").to_numpy()
    return fit([x[i] for i in order], y[order].astype(np.float32), p)


def score(docs: DataFrame, model: Cnn, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        return {k: batch.column(k) for k in keep} | {"score": [sent.value.score(t) for t in batch.column("_text").to_pylist()]}

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return by_batch(docs.select(*keep, utf8().alias("_text")), run, f"{kinds}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; ids with crc32 mod 3 = 1 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
