"""Line dedup: lines that many documents share go, but for the document with the largest id.

Normalised lines are exploded and hashed to 128 bits, documents are counted per hash, and lines over the
threshold are dropped; what stays is joined again by position.

A document is a distinct doc_id; rows without one hold lines but count for none and are never the keeper, and rows
that repeat a doc_id share its fate. Equal rows lose equal lines, so a row is known by its doc_id and its
text's hash: rows that share an id, or have none, don't crowd into one group.

Skew: a very common line is counted by partial aggregates before the shuffles. Lines travel as hashes only. Each
text moves once, to meet the hashes that it loses; those are the built side of a hash join, so texts are
streamed and not sorted, and Spark splits a partition that is too large.

Null and empty texts are one empty line. Columns besides text and doc_id pass through unchanged, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, by_batch, table, utf8, whole_rows, written

STRIP = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None if the key has fewer code points. bytes.lower() changes A-Z only."""
    key = line.strip(STRIP)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())


def text_hash(text: str | Column = "text") -> Column:
    return F.xxhash64(utf8(text))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, hash): each row's distinct hashes of long lines."""

    def run(batch):
        at, out = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = {line_hash(x, min_chars) for x in text.split(b"\n")} - {None} if len(text) >= min_chars else ()
            at += [i] * len(found)
            out += found
        at = pa.array(at, pa.int64())
        return {"doc_id": batch.column("doc_id").take(at), "text_hash": batch.column("text_hash").take(at), "hash": out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", text_hash().alias("text_hash"), utf8().alias("text")), run, f"doc_id {kind}, text_hash long, hash binary")


def dropped_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, hashes): for each row that loses lines, the hashes of their keys."""
    lines = written(line_hashes(docs, min_chars), "line-hashes")
    shared = lines.groupBy("hash").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # Written: its measured size decides between broadcast and shuffle, and Spark can split a common line's rows.
    shared = written(shared.select("hash", "keeper"), "shared-lines")
    gone = lines.join(shared, "hash").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("hash").alias("hashes"))


def _with_dropped(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(row, hashes) for every row of docs; hashes is null where nothing goes."""
    gone = dropped_hashes(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "id", "text_hash": "of"}).hint("shuffle_hash")
    rows = docs.select(whole_rows(docs).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (text_hash("row.text") == F.col("of"))
    return rows.join(gone, same, "left").select("row", "hashes")


def split_kept(text: bytes, dropped, min_chars: int) -> tuple[list[bytes], int]:
    """Kept lines and the number of all lines."""
    lines = text.split(b"\n")
    if dropped is None or not len(dropped):
        return lines, len(lines)
    gone = set(dropped)
    return [x for x in lines if line_hash(x, min_chars) not in gone], len(lines)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with shared lines taken out of text; null stays null where nothing is dropped, n_chars follows the text.
    Rows that lose nothing pass through a batch as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, hashes = batch.column("row"), batch.column("hashes")
            cols = dict(zip(names, row.flatten()))
            hit = hashes.is_valid()
            if hit.true_count:
                texts = cols["text"].filter(hit).to_pylist()
                new = [b"\n".join(split_kept((t or "").encode(), d, min_chars)[0]).decode() for t, d in zip(texts, hashes.filter(hit).to_pylist())]
                cols["text"] = pc.replace_with_mask(cols["text"], hit, pa.array(new, cols["text"].type))
                if "n_chars" in cols:
                    cols["n_chars"] = pc.replace_with_mask(cols["n_chars"], hit, pa.array([len(t) for t in new], cols["n_chars"].type))
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    bounded_batches(docs.sparkSession)
    return _with_dropped(docs, min_chars, min_docs).mapInArrow(run, docs.schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them go, and a digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _with_dropped(docs, MIN_CHARS, MIN_DOCS).select("row.doc_id", utf8("row.text").alias("text"), F.col("hashes").alias("dropped"))

    def run(batch):
        n, gone, sha = [], [], []
        for text, dropped in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist()):
            kept, lines = split_kept(text, dropped, MIN_CHARS)
            n.append(lines)
            gone.append(lines - len(kept))
            sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_lines": n, "n_dropped": gone, "kept_sha256": sha}

    return by_batch(found, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
