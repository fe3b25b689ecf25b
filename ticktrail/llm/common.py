"""What the operators of this subpackage share: tables, written intermediates, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch; a row that is larger is a batch of its own. Rows alone bound nothing, as texts differ.
BATCH_BYTES = 4 << 20
#: ASCII white space, as the contracts' ``[\x20\x09-\x0D]`` has it. ``bytes.split()`` and
#: ``bytes.strip()`` use the same six characters.
WS = " \t\n\x0b\x0c\r"
#: Tables written in the innermost scratch block, and those it hands on.
_written: list[str] = []
_passed: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes; one value for all operators, so no plan built earlier is changed."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, where they are one process, a temporary folder
    stands in for it; on a cluster a missing setting is an error, as executors would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="llm-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage in a way that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what ``written`` made inside the block, but for tables that ``kept`` names: results that are read
    after the block must have been written elsewhere or been kept."""
    global _written
    outer, _written = _written, []
    passed = len(_passed)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for x in _written:
            path = jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(conf).delete(path, True)
        _written = outer + _passed[passed:]
        del _passed[passed:]


def kept(df: DataFrame) -> DataFrame:
    """Hands the table that ``written`` made last on to the block around this ``scratch``, if there is one."""
    _passed.append(_written.pop())
    return df


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: T.StructType | str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns a dict of columns in the schema's order."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _array(x, kind: pa.DataType):
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    if isinstance(x, pa.Array):
        return x if x.type == kind else x.cast(kind)
    return pa.array(x, type=kind)


def whole_rows(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that names of ours can't meet names of its columns."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def id_text(col: str | Column = "doc_id") -> Column:
    """An id as the text that the contracts hash; null counts as empty text."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def remainder(n: int, col: str | Column = "doc_id") -> Column:
    return F.crc32(id_text(col).cast("binary")) % n


def utf8(col: str | Column = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def label_ids(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y) of the labelled rows that may be learned from; repeated labels count once, the larger one."""
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder(folds) != held_out))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )


def hash_sample(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """(doc_id): at most ``rows`` different ids, chosen by a hash of the id: the same at every run. A threshold on the
    hash lets through about a third more than asked, so that no task sends its own ``rows`` ids to be ranked; it
    goes by the estimated number of different ids, so repeated ids crowd out no others."""
    n, span = df.select(F.approx_count_distinct("doc_id")).first()[0], 1 << 40
    if n > rows:
        share = min(span, -(-span * (rows + rows // 3 + 100) // n))
        df = df.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(span)) < share)
    return in_order(df.select("doc_id").distinct(), rows, seed)


def in_order(ids: DataFrame, rows: int, seed: int) -> DataFrame:
    """The first ``rows`` ids by hash."""
    return ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(rows)


def one_row_an_id(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text) of the chosen ids, one row for each: of rows that repeat an id, the one with the smallest text.
    chosen must be bounded: it is broadcast, and what comes back is as many rows."""
    rows = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"))
