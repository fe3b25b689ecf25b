"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each rule
that failed; a policy is a versioned set of bits, so applying another policy, or asking what a rule alone
changes, reads the ledger and never the texts. Ablations are bitwise aggregates over the ledger.

Null and empty texts have no words: they fail MIN_WORDS. Repeated rows are judged each. Measures cover
whole texts of any length and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, by_batch, table, utf8, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A rule's name is its bit: the place in this tuple. New rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("min_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of the rules."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))


BASE = Policy(1, ("min_words", "repeated_words"))
FULL = Policy(2, tuple(BIT))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window found at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    code: dict[bytes, int] = {}
    c = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    v = len(code)
    if v == n:
        return 0
    key = c[: n - window + 1].copy()
    size = v
    for k in range(1, window):
        if size * v >= 1 << 62:  # windows are numbered anew before the product would overflow
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            size = int(key.max()) + 1
        key = key * v + c[k : n - window + 1 + k]
        size *= v
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    eq = key[order[1:]] == key[order[:-1]]
    same[order[1:][eq]] = True
    same[order[:-1][eq]] = True
    at = np.flatnonzero(same)
    if not len(at):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word)."""
    words = text.split()
    s = text.decode("utf-8", "replace")
    chars = len(s) - sum(s.count(c) for c in WS)
    symbols = sum(text.count(c.encode()) for c in SYMBOLS)
    seen, dup, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words), lines


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, measurements, failed): failed holds one bit for each rule of RULES."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

    def run(batch):
        got = list(zip(*[measure(t) for t in batch.column("text").to_pylist()])) or [()] * len(names)
        return {key: batch.column(key)} | {n: list(v) for n, v in zip(names, got)}

    kind = docs.schema[key].dataType.simpleString()
    rows = by_batch(docs.select(key, utf8().alias("text")), run, f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names))
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def fails(policy: Policy, failed: str | Column = "failed") -> Column:
    col = F.col(failed) if isinstance(failed, str) else failed
    return col.bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with policy_version and kept."""
    return led.withColumn("policy_version", F.lit(policy.version)).withColumn("kept", ~fails(policy))


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects. One pass with
    partial sums; the result has as many rows as the policy has rules."""
    bits = F.col("failed").bitwiseAND(F.lit(policy.mask))
    sums = [F.sum((bits.bitwiseAND(F.lit(BIT[r])) != 0).cast("long")).alias(f"f_{r}") for r in policy.rules]
    sums += [F.sum((bits == BIT[r]).cast("long")).alias(f"o_{r}") for r in policy.rules]
    one = led.agg(F.count("*").alias("n"), *sums)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(f"f_{r}", F.lit(0)).alias("n_failed"), F.coalesce(f"o_{r}", F.lit(0)).alias("n_only")) for r in policy.rules])
    return one.select(F.lit(policy.version).alias("policy_version"), F.col("n").alias("n_documents"), F.explode(rows).alias("r")).select("policy_version", "n_documents", "r.*")


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger as a table of its own: whatever policy comes next, the texts aren't read again."""
    return written(ledger(docs), "ledger")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the full policy rejects, and rejects alone, over all documents."""
    return ablations(stored_ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), FULL)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and the verdict of the full policy for every document."""
    led = apply_policy(stored_ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), FULL)
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails(BASE).alias("base_failed"), "kept", F.col("failed").alias("failed_bits"),
    )


OP8_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
win AS (
  SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 3))) AS i FROM w)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2),
repw AS (
  SELECT doc_id, count(DISTINCT j)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines, count(*)::BIGINT AS n_lines FROM lines GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN repw USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 32 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""

#: rule, bit and whether a document fails it, over what OP8_SQL makes of the documents.
ABLATIONS_SQL = "WITH one AS (" + OP8_SQL + """),
rules(rule, bit) AS (VALUES ('min_words', 1), ('repeated_words', 2), ('short_words', 4), ('long_words', 8), ('symbols', 16), ('repeated_lines', 32))
SELECT 2 AS policy_version, (SELECT count(*) FROM one)::BIGINT AS n_documents, rule,
       count(*) FILTER (WHERE failed_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (WHERE failed_bits = bit)::BIGINT AS n_only
FROM rules, one GROUP BY rule, bit
"""
