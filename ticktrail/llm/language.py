"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training takes a documented bound of about ``per_language`` documents of each language, chosen by a hash
of the id; the counts are summed by Spark and come to the driver as at most languages x 2^bits numbers.
The log-probability matrix is broadcast. A batch's texts are one sparse matrix, a row for each text with an entry for each
n-gram, and its product with the log-probabilities is their scores; it is made in slices of bounded size,
over which a long text's score adds up.

Null texts and texts without a letter are ``und`` with score 0. Repeated rows are scored each. Labels
that are null teach nothing. With no label at all every document is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, remainder, table

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    """per_language bounds the expected rows of a language that training reads; max_languages, as many as ISO 639
    has, the matrix; piece the characters and cells the numbers that a slice of a batch holds."""

    bits: int = 14
    orders: tuple[int, ...] = (1, 2, 3)
    per_language: int = 3000
    max_languages: int = 8000
    alpha: float = 0.5
    piece: int = 1 << 16
    cells: int = 1 << 21
    seed: int = 7


def slices(texts: list[str], piece: int, overlap: int):
    """Lists of (text's number, part, starts): whole texts, lower-cased first, then cut after every ``piece`` characters.
    n-grams may start at the first ``starts`` characters of a part; a part reaches ``overlap`` further."""
    held, size = [], 0
    for i, text in enumerate(texts):
        low = text.lower()
        for at in range(0, len(low), piece):
            part = low[at : at + piece + overlap]
            held.append((i, part, min(piece, len(low) - at)))
            size += len(part)
            if size >= piece:
                yield held
                held, size = [], 0
    if held:
        yield held


def ngrams(texts: list[str], p: LanguageParams, piece: int | None = None):
    """(owner, feature) arrays: the hashed n-grams of the texts, in the texts' order, slice by slice."""
    top, shift = max(p.orders), np.uint32(32 - p.bits)
    for held in slices(texts, piece or p.piece, top - 1):
        number, parts, starts = zip(*held)
        lens = np.array([len(x) for x in parts])
        c = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
        part = np.repeat(np.arange(len(parts)), lens)
        place = np.arange(len(c)) - (np.cumsum(lens) - lens)[part]
        free, may = lens[part] - place, place < np.array(starts)[part]
        h, owners, features = np.zeros(len(c), np.uint32), [], []
        for k in range(top):
            n = max(0, len(c) - k)
            h = (h[:n] ^ c[k:]) * np.uint32(0x9E3779B1) + np.uint32(k + 1)
            if k + 1 in p.orders:
                ok = np.flatnonzero(may[:n] & (free[:n] > k))
                use = h[ok]
                owners.append(part[ok])
                features.append(((use ^ (use >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> shift)
        own, feature = np.concatenate(owners), np.concatenate(features)
        order = np.argsort(own, kind="stable")
        yield np.array(number)[own[order]], feature[order]


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # 2^bits x languages, float32
    prior: np.ndarray
    params: LanguageParams

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        known = [bool(t and self.languages and LETTER.search(t)) for t in texts]
        if not any(known):
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        z, n = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts))
        piece = max(1024, min(self.params.piece, self.params.cells // (len(self.languages) * len(self.params.orders))))
        for own, feature in ngrams([t if k else "" for t, k in zip(texts, known)], self.params, piece):
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            z[own[first]] += np.add.reduceat(self.logp[feature], first, axis=0, dtype=np.float64)
            n += np.bincount(own, minlength=len(texts))
        best = z.argmax(axis=1)
        # n-grams of a text depend on each other; the posterior takes the mean evidence of up to 50.
        q = np.exp((z - z.max(axis=1, keepdims=True)) * (np.minimum(n, 50) / np.maximum(n, 1))[:, None])
        score = 1.0 / q.sum(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], [float(s) if k else 0.0 for s, k in zip(score, known)]


def train(docs: DataFrame, params: LanguageParams | None = None, folds: int = 5, held_out: int = 0) -> LanguageModel:
    """docs: doc_id, text, lang."""
    p = params or LanguageParams()
    known = docs.where(F.col("lang").isNotNull() & (remainder(folds) != held_out))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.max_languages + 1).collect()}
    if len(counts) > p.max_languages:
        raise ValueError(f"more than {p.max_languages} languages; raise max_languages")
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((1 << p.bits, 0), np.float32), np.zeros(0), p)
    span = 1 << 30
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(span, -(-span * p.per_language // counts[lang]))))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(p.seed)), F.lit(span))
    code = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
    rows = known.where(draw < share[F.col("lang")]).select(code[F.col("lang")].alias("y"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batch):
        y = np.asarray(batch.column("y").to_pylist(), np.int64)
        cells, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for own, feature in ngrams(batch.column("text").to_pylist(), p):
            cell, n = np.unique((y[own] << p.bits) + feature, return_counts=True)
            cells.append(cell)
            counts.append(n)
        cell, at = np.unique(np.concatenate(cells), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(cell)).astype(np.int64)
        return {"y": cell >> p.bits, "b": cell & ((1 << p.bits) - 1), "n": n}

    got = by_batch(rows, run, "y int, b int, n long").groupBy("y", "b").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros((1 << p.bits, len(languages)))
    m[got.column("b").to_numpy(), got.column("y").to_numpy()] = got.column("n").to_numpy()
    m += p.alpha
    logp = np.log(m / m.sum(axis=0)).astype(np.float32)
    prior = np.log(np.array([counts[x] for x in languages], float) / sum(counts.values()))
    return LanguageModel(languages, logp, prior, p)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        lang, score = sent.value.predict(batch.column("_text").to_pylist())
        return {k: batch.column(k) for k in keep} | {"lang_pred": lang, "score": score}

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return by_batch(docs.select(*keep, F.col("text").alias("_text")), run, f"{kinds}, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; ids with crc32 mod 5 = 0 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")
