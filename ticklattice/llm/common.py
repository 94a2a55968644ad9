"""Helpers that the operators of this subpackage share.

Python batches: an operator that runs numpy or a native library over texts
takes Arrow batches and cuts them into pieces of at most ``PIECE_BYTES`` of
text (one longer text is a piece of its own), so the memory of a worker is a
multiple of the longest single text and not of the batch.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 2 << 20
#: Rows of an Arrow batch: with texts of a few KB a batch is a few MB.
BATCH_ROWS = 1024
#: Masters whose driver and executor are one process, so that a folder of this machine is shared.
LOCAL = re.compile(r"local(\[|$)")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns of df, cast; other columns go, whatever their names.

    A column is found by its exact name, so an extra column that differs only
    in case, or that has a name this package uses inside, does no harm.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(n)}").cast(t).alias(n) for n, t in types.items()])


def rows_by(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose doc_id is (left_semi) or is not (left_anti) in ids, its only column; all columns stay, whatever their names."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.join(ids.toDF("id").distinct(), F.col(f"c{names.index('doc_id')}").eqNullSafe(F.col("id")), how).toDF(*names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where it is set; only a local master gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not LOCAL.match(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='ticklattice-')}"
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so an executor
    that is lost later costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch, column: str | int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of batch with at most limit bytes of text each."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
