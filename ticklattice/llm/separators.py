"""Token counts by a separator scan over flat token files (operator 1).

A flat token file is the ids of documents one after the other, of equal width
(little-endian), every document ended by a separator id, without an index. It
is read as blocks, each by its own offset. Each block is searched for the separator by one vector
comparison; documents that run over block boundaries are stitched by prefix
sums over the blocks' summaries, first within groups of blocks and then over
the groups, so no task sees more than GROUP summaries of a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode
from .common import column, pick, pieces, small_batches, table, written

#: The id that the rank file leaves free.
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 15
GROUP = 1 << 12
#: Blocks of a file that one row of the listing stands for (64 MB of two-byte ids), and that are read in one go.
RANGE_BLOCKS, READ_BLOCKS = 1 << 10, 1 << 5
#: Tasks that read files, at most; a task then reads several ranges.
MOST_TASKS = 50_000


def token_blocks(docs: DataFrame, rank_file: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The flat token stream of docs (doc_id, text) in blocks: (file, block, ids binary, ended array<bigint>).

    Each partition is one file. ended: the doc_ids whose separator is in the
    block, in order; the scan does not look at it. A null text is empty: its
    separator alone.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("ended", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, held, n, ended = TaskContext.get().partitionId(), 0, [], 0, []

        def full(size: int) -> pa.RecordBatch:
            nonlocal block, held, n, ended
            flat = np.concatenate(held)
            here = int((flat[:size] == SEPARATOR).sum())
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([file], [block], [flat[:size].tobytes()], [ended[:here]]), schema)], schema=schema)
            block, held, n, ended = block + 1, [flat[size:]], len(flat) - size, ended[here:]
            return out

        for batch in batches:
            for piece in pieces(batch, "text"):
                for doc, text in zip(column(piece, "doc_id").to_pylist(), column(piece, "text").to_pylist()):
                    held.append(np.array([*encode(text or "", rank_file), SEPARATOR], dtype="<u2"))
                    n += len(held[-1])
                    ended.append(doc)
                    while n >= block_tokens:
                        yield full(block_tokens)
        if n:
            yield full(n)

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "file bigint, block bigint, ids binary, ended array<bigint>")


def opened(path: str) -> fs.NativeFile:
    """A file of the listing for reads at any position, on the executor that asks."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, id_bytes: int = 2, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """Flat token files under path, of ids of id_bytes each, as blocks (file, block, ids) of block_tokens ids.

    Only names and lengths are listed. Each range of range_blocks blocks is
    read by its own offset, so one large file is spread over many tasks and a
    task holds a few blocks, however long the file is. An empty file has no block.
    The store must be one that pyarrow.fs opens (local, hdfs, s3, gs, abfs).
    """
    step = block_tokens * id_bytes
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    part = step * range_blocks
    total = files.agg(F.sum(F.ceil(F.col("length") / part))).first()[0] or 1
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {part})")).alias("part"))
    ranges = ranges.select(F.xxhash64("path").alias("file"), "path", "length", "part").repartition(min(int(total), MOST_TASKS), "path", "part")
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, blocks = row["part"] * range_blocks, -(-row["length"] // step)
                with opened(row["path"]) as file:
                    for at in range(first, min(first + range_blocks, blocks), READ_BLOCKS):
                        some = range(at, min(at + READ_BLOCKS, first + range_blocks, blocks))
                        raw = [file.read_at(min(step, row["length"] - k * step), k * step) for k in some]
                        yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(raw, pa.binary())], schema=schema)

    return ranges.mapInArrow(run, "file bigint, block bigint, ids binary")


def scan(blocks: DataFrame, separator: int = SEPARATOR, keep: tuple[str, ...] = (), id_bytes: int = 2) -> DataFrame:
    """(file, block, nth, n_tokens) for each document that ends in a block; nth counts from 0 in the block.

    blocks: (file, block, ids binary) and the columns of keep, which are
    arrays of one value per separator and come out as single values.
    The separator itself is not counted. Tokens after the last separator of a
    file belong to no ended document. Null ids are an empty block; bytes after
    the last whole id (of id_bytes, little-endian) are ignored.
    """
    types = {c: dict(blocks.dtypes)[c] for c in keep}
    base = pick(blocks, file="bigint", block="bigint", ids="binary", **types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, where = [], []
            for raw in column(batch, "ids").to_pylist():
                ids = np.frombuffer(raw or b"", dtype=f"<u{id_bytes}", count=len(raw or b"") // id_bytes)
                sizes.append(len(ids))
                where.append(np.flatnonzero(ids == separator))
            cols = [column(batch, "file"), column(batch, "block"), pa.array(sizes, pa.int64()), pa.array(where, pa.list_(pa.int32())), *(column(batch, c) for c in keep)]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "block", "size", "at", *keep])

    ddl = ", ".join(["file bigint, block bigint, size bigint, at array<int>", *(f"{c} {t}" for c, t in types.items())])
    # read twice below, by the blocks and by their groups: written, so that blocks are made and searched once
    found = written(base.mapInArrow(run, ddl), "scan")
    group = F.floor(F.col("block") / GROUP)
    in_group = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = found.withColumn("group", group)
    summed = summed.withColumn("off", F.coalesce(F.sum("size").over(in_group), F.lit(0)))
    summed = summed.withColumn("last", F.max(F.when(F.size("at") > 0, F.col("off") + F.element_at("at", -1))).over(in_group))
    # the same two prefix scans over whole groups
    of_group = summed.groupBy("file", "group").agg(
        F.sum("size").alias("g_size"), F.max(F.when(F.size("at") > 0, F.col("off") + F.element_at("at", -1))).alias("g_last")
    )
    over_groups = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    of_group = of_group.withColumn("g_off", F.coalesce(F.sum("g_size").over(over_groups), F.lit(0)))
    of_group = of_group.withColumn("g_before", F.max(F.col("g_off") + F.col("g_last")).over(over_groups))
    joined = summed.join(of_group.select("file", "group", "g_off", "g_before"), ["file", "group"])
    before = F.coalesce(F.col("g_off") + F.col("last"), F.col("g_before"), F.lit(-1))
    start = F.col("g_off") + F.col("off")
    each = joined.select("file", "block", before.alias("before"), start.alias("start"), "at", *keep, F.posexplode("at").alias("nth", "pos"))
    previous = F.when(F.col("nth") > 0, F.col("start") + F.get("at", F.col("nth") - 1)).otherwise(F.col("before"))
    return each.select("file", "block", "nth", (F.col("start") + F.col("pos") - previous - 1).alias("n_tokens"), *(F.get(c, F.col("nth")).alias(c) for c in keep))


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every row of documents, scanned from their flat token stream."""
    blocks = token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return scan(blocks, keep=("ended",)).select(F.col("ended").alias("doc_id"), "n_tokens")


QUERIES = {"op1_separator_scan": op1_separator_scan}
ORACLES: dict[str, str] = {}
