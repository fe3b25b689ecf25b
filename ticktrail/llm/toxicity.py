"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) in numpy.

The classifier is linear over hashed words and word beginnings. It is trained on the driver from a
bounded sample: confirmed toxic documents (positives) and documents without a toxic label (unlabelled,
whatever their true class), with the risk

    pi * E_p[loss(+)] + max(0, E_u[loss(-)] - pi * E_p[loss(-)])

where ``pi`` is the class prior. When the bracket turns negative its gradient is reversed, which keeps a
flexible model from fitting the unlabelled toxic documents as clean. Scoring maps whole texts, one batch
at a time, with a broadcast of 2^18 floats; nothing is shuffled.

Null and empty texts have no words and score as the model's bias says; text of any length is scored
whole. Repeated rows are scored each; of rows that repeat an id training takes one. Without a toxic label to learn from every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, by_batch, hash_sample, in_order, label_ids, one_row_an_id, remainder, table, utf8

BITS = 18
MASK = (1 << BITS) - 1
PREFIXES = (4, 5, 7)
STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_"


@dataclass(frozen=True)
class ToxicityParams:
    """max_positive and max_unlabelled bound the rows that training collects; a row has at most 2^18 features."""

    max_positive: int = 3000
    max_unlabelled: int = 8000
    epochs: int = 15
    batch: int = 256
    rate: float = 0.25
    l2: float = 1e-4
    ratio: float = 2.0
    support: int = 3
    z: float = 4.0
    seed: int = 11


def word_features(word: bytes) -> set[int]:
    """Hashed indices of a word and its beginnings, by code points."""
    s = word.strip(STRIP).decode("utf-8", "replace").lower()
    if not s:
        return set()
    out = {xxhash.xxh3_64_intdigest("w" + s) & MASK}
    for k in PREFIXES:
        if len(s) < k:
            break
        out.add(xxhash.xxh3_64_intdigest("p" + s[:k]) & MASK)
    return out


def features(text: bytes) -> np.ndarray:
    found: set[int] = set()
    for w in set(text.split()):
        found |= word_features(w)
    return np.array(sorted(found), np.int32)


@dataclass
class LinearModel:
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function of a text; a word's sum of weights is looked up once and kept while it fits."""
        known: dict[bytes, float] = {}
        at = np.flatnonzero(self.weights)
        weights, bias = dict(zip(at.tolist(), self.weights[at].tolist())), self.bias

        def score(text: bytes) -> float:
            if len(known) > 250_000:
                known.clear()
            total = bias
            for w in set(text.split()):
                v = known.get(w)
                if v is None:
                    v = known[w] = sum(weights.get(i, 0.0) for i in word_features(w))
                total += v
            return 1.0 / (1.0 + np.exp(-min(max(total, -30.0), 30.0)))

        return score


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, p: ToxicityParams) -> LinearModel:
    """Adagrad on the non-negative risk with the logistic loss."""
    rng = np.random.default_rng(p.seed)
    w, g2, b, gb2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2), 0.0, 1e-2
    if not positive or not unlabelled:
        return LinearModel(w.astype(np.float32), -30.0)

    def flat(rows, at):
        n = np.array([len(rows[i]) for i in at])
        return np.concatenate([rows[i] for i in at]).astype(np.int64), np.repeat(np.arange(len(at)), n), len(at)

    sig = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    steps = max(1, len(unlabelled) // p.batch)
    small = max(8, min(len(positive), p.batch // 2))
    for epoch in range(p.epochs):
        order = rng.permutation(len(unlabelled))
        for s in range(steps):
            ip, gp, n_p = flat(positive, rng.integers(0, len(positive), small))
            iu, gu, n_u = flat(unlabelled, order[s * p.batch : (s + 1) * p.batch])
            zp = b + np.bincount(gp, w[ip], n_p)
            zu = b + np.bincount(gu, w[iu], n_u)
            sp, su = sig(zp), sig(zu)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                dp = prior * (sp - 1) / n_p - prior * sp / n_p
                du = su / n_u
            else:
                dp, du = prior * sp / n_p, -su / n_u
            grad = np.bincount(ip, dp[gp], 1 << BITS) + np.bincount(iu, du[gu], 1 << BITS)
            at = np.flatnonzero(grad)
            g = grad[at] + p.l2 * w[at]
            g2[at] += g * g
            w[at] -= p.rate * g / np.sqrt(g2[at])
            db = dp.sum() + du.sum()
            gb2 += db * db
            b -= p.rate * db / np.sqrt(gb2)
    return LinearModel(w.astype(np.float32), float(b))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], p: ToxicityParams) -> np.ndarray:
    """Features that are ``ratio`` times as frequent among positives, ``z`` standard deviations above chance
    and in ``support`` positives; the rest are noise that a positive-unlabelled fit learns by heart."""
    count = lambda rows: np.bincount(np.concatenate(rows) if rows else np.empty(0, np.int64), minlength=1 << BITS)
    pos, unl, n_p, n_u = count(positive), count(unlabelled), len(positive), len(unlabelled)
    share = n_p / max(1, n_p + n_u)
    chance = (pos + unl) * share
    far = pos - chance >= p.z * np.sqrt(chance * (1 - share))
    return far & (pos >= p.support) & ((pos + 0.5) * n_u > p.ratio * (unl + 0.5) * n_p)


def calibrated(model: LinearModel, unlabelled: list[np.ndarray], share: float) -> LinearModel:
    """Moves the bias so that the expected share of toxic documents among the unlabelled scores 0.5 or more,
    but never a document without any telling feature."""
    z = np.sort([float(model.weights[f].sum()) for f in unlabelled])
    at = min(len(z) - 1, max(0, int(round(len(z) * (1 - share)))))
    lower = z[z < z[at]]
    cut = (z[at] + lower[-1]) / 2 if len(lower) else z[at]
    return LinearModel(model.weights, -max(float(cut), 0.05))


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None, folds: int = 5, held_out: int = 0) -> LinearModel:
    """Collects at most max_positive + max_unlabelled rows of hashed features; texts stay on the executors."""
    p = params or ToxicityParams()
    known = label_ids(labels, "toxic", folds, held_out)
    prior, n_known = known.agg(F.avg(F.col("y").cast("double")), F.count("*")).first()
    prior = float(prior or 0.0)
    pos = hash_sample(known.where("y = 1"), p.max_positive, p.seed).select("doc_id", F.lit(1).alias("y"))
    ids = docs.where(F.col("doc_id").isNotNull() & (remainder(folds) != held_out)).select("doc_id")
    # Sampled with room for max_positive more: positives among them leave after sampling.
    unl = hash_sample(ids, p.max_unlabelled + p.max_positive, p.seed + 1).join(known.where("y = 1"), "doc_id", "left_anti")
    unl = in_order(unl, p.max_unlabelled, p.seed + 1).select("doc_id", F.lit(0).alias("y"))
    # At most max_positive + max_unlabelled ids: a proven bound for a broadcast.
    chosen = pos.unionByName(unl).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = one_row_an_id(docs, chosen).join(F.broadcast(chosen), "doc_id")

    def run(batch):
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "f": [features(t) for t in batch.column("text").to_pylist()]}

    got = by_batch(rows, run, "doc_id long, y int, f array<int>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    f, y = got.column("f").combine_chunks(), got.column("y").to_numpy()
    flat, off = f.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(f.offsets.to_numpy()))])
    rows = [flat[off[i] : off[i + 1]] for i in order]
    y = y[order]
    positive, unlabelled = [r for r, v in zip(rows, y) if v], [r for r, v in zip(rows, y) if not v]
    ok = telling(positive, unlabelled, p)
    positive, unlabelled = [r[ok[r]] for r in positive], [r[ok[r]] for r in unlabelled]
    model = fit_nnpu(positive, unlabelled, prior, p)
    if not positive or not unlabelled:
        return model
    # Labels cover this share of the documents, so the unlabelled rows hold what is left of the prior.
    covered = min(1.0, n_known / max(1, ids.count()))
    return calibrated(model, unlabelled, prior * (1 - covered) / max(1e-9, 1 - prior * covered))


def score(docs: DataFrame, model: LinearModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held = {}

    def run(batch):
        if "f" not in held:
            held["f"] = sent.value.scorer()
        out = {k: batch.column(k) for k in keep}
        return out | {"score": [held["f"](t) for t in batch.column("_text").to_pylist()]}

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return by_batch(docs.select(*keep, utf8().alias("_text")), run, f"{kinds}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; ids with crc32 mod 5 = 0 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops the documents whose score is 0.5 or more. Columns stay as they are."""
    sent = spark.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")))
    held = {}

    def run(batches):
        score = held.setdefault("f", sent.value.scorer())
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([score((t or "").encode()) < 0.5 for t in texts], pa.bool_()))

    bounded_batches(spark)
    return docs.mapInArrow(run, docs.schema)
