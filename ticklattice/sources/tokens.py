"""Token files: two bytes a token, little-endian, and the text and JSON beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = 126
#: Tokens after which a line of the text form ends: the begin and the end of a file, and a commit.
BREAKS = (1, 2, 3)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, token) of the token files under path; fails for an odd length or an id outside the vocabulary."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    schema = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("token", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(raw) % 2:
                    raise ValueError(f"{file} has an odd number of bytes")
                ids = np.frombuffer(raw, dtype="<u2")
                if len(ids) and ids.max() >= VOCABULARY:
                    raise ValueError(f"{file} holds an id of {ids.max()}")
                for a in range(0, len(ids), 1 << 16):
                    part = ids[a : a + (1 << 16)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array(part)], schema=schema)

    return files.mapInArrow(run, "file string, pos bigint, token int")


def packed(tokens: DataFrame, key: str = "instrument_id") -> DataFrame:
    """(key, content): the bytes of each key's token file, in order of pos."""
    held = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    two = F.expr("aggregate(transform(t, x -> concat(lpad(hex(x.token), 2, '0'), '00')), '', (a, x) -> concat(a, x))")
    return held.select(key, F.unhex(two).alias("content"))


def text_lines(tokens: DataFrame, name: Column, key: str = "instrument_id") -> DataFrame:
    """(key, line, text): names of the tokens, a new line after each commit and after a file's begin and end."""
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = tokens.select(key, "pos", name.alias("name"), F.coalesce(F.sum(F.col("token").isin(*BREAKS).cast("int")).over(before), F.lit(0)).alias("line"))
    lines = numbered.groupBy(key, "line").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("t"))
    return lines.select(key, "line", F.array_join(F.col("t.name"), " ").alias("text"))


def metadata(tokens: DataFrame, key: str = "instrument_id") -> DataFrame:
    """(key, json): what stands beside a token file."""
    counts = tokens.groupBy(key).agg(F.count("*").alias("tokens"), F.sum((F.col("token") == 3).cast("int")).alias("commits"))
    return counts.select(key, F.to_json(F.struct(F.lit(VOCABULARY).alias("vocab_size"), "tokens", "commits")).alias("json"))


def decode(name: str) -> str:
    """SQL for the lower bound of a size token, the ticks of a price token, the letter of an action or a side."""
    return {
        "size": "case when token between 117 and 118 then token - 117 when token between 119 and 125 then cast(pow(2, token - 118) as int) end",
        "price_ticks": "case when token between 13 and 115 then token - 64 end",
        "action": "case token when 4 then 'A' when 5 then 'C' when 6 then 'M' when 7 then 'T' when 8 then 'F' when 9 then 'R' end",
        "side": "case token when 10 then 'B' when 11 then 'A' when 12 then ' ' end",
    }[name]
