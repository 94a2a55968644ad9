"""Training windows over tokens with the book's state at each commit, and the packed binary files of such windows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMIT = 3
#: Fixed values of a packed file: its first bytes, its version, the length of its header, the numbers of a state.
MAGIC, VERSION, HEADER, FIELDS = b"PKDW", 1, 64, 12
_HEAD = "<4sIQIII"
_COMMITS = "array<struct<at: int, post: array<float>, pre: array<float>>>"
_RECORDS = pa.schema([("file", pa.string()), ("idx", pa.int64()), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32())), ("commits", pa.list_(pa.struct([("at", pa.int32()), ("post", pa.list_(pa.float32())), ("pre", pa.list_(pa.float32()))])))])


def recon_windows(tokens: DataFrame, states: DataFrame, context: int = 512, stride: int = 2048, most: int = 200, key: str = "instrument_id") -> DataFrame:
    """(key, start_pos, x, y, commits): windows of context tokens at every stride, y one token later than x.

    tokens has (key, pos, token) with pos from 0 without gaps, states (key, pos,
    state) of commits. commits are the first most commits in x that have a
    state: their place in x, that state, and the state of the commit before
    (null for the first). A window that the tokens do not fill is left out;
    empty tables give none. One key's states are ordered in one task.
    """
    before = Window.partitionBy(key).orderBy("pos")
    known = states.select(key, "pos", F.col("state").cast("array<float>").alias("post"), F.lag(F.col("state").cast("array<float>")).over(before).alias("pre"))
    # a token is met by the windows that begin up to context before it; those met by none go before the join
    met = tokens.select(key, "pos", "token", F.greatest(F.ceil((F.col("pos") - context) / stride), F.lit(0)).alias("a"), F.floor(F.col("pos") / stride).alias("b")).where("a <= b")
    each = met.join(known, [key, "pos"], "left").select(key, F.explode(F.sequence("a", "b")).alias("k"), F.struct("pos", "token", "post", "pre").alias("t"))
    held = each.groupBy(key, "k").agg(F.array_sort(F.collect_list("t")).alias("t")).where(F.size("t") == context + 1)
    found = f"filter(transform(slice(t, 1, {context}), (e, i) -> struct(e.token as token, i as at, e.post as post, e.pre as pre)), c -> c.token = {COMMIT} and c.post is not null)"
    return held.select(
        key, (F.col("k") * stride).alias("start_pos"), F.expr(f"transform(slice(t, 1, {context}), e -> e.token)").alias("x"), F.expr(f"transform(slice(t, 2, {context}), e -> e.token)").alias("y"),
        F.expr(f"transform(slice({found}, 1, {most}), c -> struct(c.at as at, c.post as post, c.pre as pre))").cast(_COMMITS).alias("commits"),
    )


def record(context: int, most: int) -> np.dtype:
    """One window of a packed file."""
    return np.dtype([
        ("x", "<i2", (context,)), ("y", "<i2", (context,)), ("commit_pos", "<i2", (most,)), ("post_state", "<f4", (most, FIELDS)),
        ("pre_state", "<f4", (most, FIELDS)), ("pre_valid", "u1", (most,)), ("n_commits", "<i4"),
    ])


def _pack(rows: list[dict], kind: np.dtype) -> bytes:
    out = np.zeros(len(rows), dtype=kind)
    for to, row in zip(out, rows):
        to["x"], to["y"], to["n_commits"] = row["x"], row["y"], len(row["commits"])
        for k, c in enumerate(row["commits"]):
            to["commit_pos"][k], to["post_state"][k] = c["at"], c["post"]
            if c["pre"] is not None:
                to["pre_state"][k], to["pre_valid"][k] = c["pre"], 1
    return out.tobytes()


def write_packed(windows: DataFrame, path: str, context: int = 512, most: int = 200, rows: int = 4096, key: str = "instrument_id") -> int:
    """Writes windows as packed files of at most rows windows under path; returns how many windows were written.

    A task writes its own files anew when it is run again, in the same order.
    """
    kind = record(context, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(at, recursive=True)
        part, held, files = TaskContext.get().partitionId(), [], 0

        def flush(these: list[dict]) -> pa.RecordBatch:
            head = struct.pack(_HEAD, MAGIC, VERSION, len(these), context, most, kind.itemsize)
            with store.open_output_stream(f"{at}/part-{part:05d}-{files:05d}.pkdw") as out:
                out.write(head.ljust(HEADER, b"\0"))
                out.write(_pack(these, kind))
            return pa.RecordBatch.from_arrays([pa.array([len(these)], pa.int64())], names=["n"])

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= rows:
                yield flush(held[:rows])
                held, files = held[rows:], files + 1
        if held:
            yield flush(held)

    ordered = windows.sortWithinPartitions(key, "start_pos").select("x", "y", "commits")
    return ordered.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _header(raw: bytes, file: str, length: int) -> tuple[int, np.dtype]:
    if len(raw) < HEADER or raw[:4] != MAGIC:
        raise ValueError(f"{file} is no packed file")
    _, version, n, context, most, size = struct.unpack(_HEAD, raw[: struct.calcsize(_HEAD)])
    kind = record(context, most)
    if version != VERSION:
        raise ValueError(f"{file} has version {version}")
    if size != kind.itemsize or length != HEADER + n * size:
        raise ValueError(f"{file} has not the length that its header gives")
    return n, kind


def read_packed(spark: SparkSession, path: str, rows: int = 1024) -> DataFrame:
    """(file, idx, x, y, commits) of the packed files under path, read by ranges of so many windows; fails for a file that its header contradicts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pkdw").load(path).select("path", "length")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = fs.FileSystem.from_uri(file)
                with store.open_input_file(at) as f:
                    n, _ = _header(f.read(HEADER), file, length)
                starts = range(0, n, rows)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(starts), pa.string()), pa.array([length] * len(starts), pa.int64()), pa.array(list(starts), pa.int64())], names=["path", "length", "start"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = fs.FileSystem.from_uri(file)
                with store.open_input_file(at) as f:
                    n, kind = _header(f.read(HEADER), file, length)
                    f.seek(HEADER + start * kind.itemsize)
                    data = np.frombuffer(f.read(min(rows, n - start) * kind.itemsize), dtype=kind)
                for a in range(0, len(data), 64):
                    part = data[a : a + 64]
                    commits = [
                        [{"at": int(r["commit_pos"][k]), "post": r["post_state"][k].tolist(), "pre": r["pre_state"][k].tolist() if r["pre_valid"][k] else None} for k in range(r["n_commits"])]
                        for r in part
                    ]
                    columns = [[file] * len(part), range(start + a, start + a + len(part)), part["x"].tolist(), part["y"].tolist(), commits]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, _RECORDS)], schema=_RECORDS)

    spread = files.mapInArrow(ranges, "path string, length bigint, start bigint").repartition("path", "start")
    return spread.mapInArrow(read, f"file string, idx bigint, x array<int>, y array<int>, commits {_COMMITS}")
