"""Byte-level BPE encoding and decoding with a local rank file (operator 5)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, pieces, small_batches, table

#: Characters after which a long text may be cut, at the next safe boundary.
CUT = 1 << 14
#: Before a lone space that follows and precedes other characters every match
#: of the pattern ends: no alternative goes on from a non-space to a space.
SAFE = re.compile(r"(?<=\S)(?= \S)")
#: A run of blanks too long for the pattern's engine to step back over. All of it but the last is one match
#: of the pattern, and the last too where the text ends; nothing before it goes on into blanks.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@lru_cache(maxsize=4)
def encoding(rank_file: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, cut: int = CUT) -> Iterator[str]:
    """Consecutive parts of text, cut only where no match of the pattern can span."""
    start = 0
    while len(text) - start > cut:
        at = SAFE.search(text, start + cut)
        if at is None:
            break
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


def encode(text: str, rank_file: str, cut: int = CUT) -> list[int]:
    enc, ids, start = encoding(rank_file), [], 0
    for run in BLANKS.finditer(text) if len(text) >= 4096 else ():
        end = run.end() - (run.end() < len(text))
        ids += [t for part in parts(text[start : run.start()], cut) for t in enc.encode_ordinary(part)]
        ids += enc._encode_single_piece(text[run.start() : end])
        start = end
    if not start and len(text) <= cut:
        return enc.encode_ordinary(text)
    return ids + [t for part in parts(text[start:], cut) for t in enc.encode_ordinary(part)]


def decode(ids: list[int], rank_file: str) -> bytes:
    """The raw bytes of ids, one part after the other; they need not be whole characters."""
    return encoding(rank_file).decode_bytes(ids)


def map_texts(docs: DataFrame, make: Callable[[list[int]], tuple], schema: pa.Schema, ddl: str, rank_file: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = [make(encode(t or "", rank_file)) for t in column(piece, "text").to_pylist()]
                cols = [column(piece, "doc_id"), *(pa.array(x, f.type) for x, f in zip(zip(*rows), list(schema)[1:]))]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, ddl)


def encode_frame(docs: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text); a null text is empty and has no ids.

    Rows stand for themselves: repeated rows give repeated results, an empty
    table gives none, and columns other than the two are ignored.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return map_texts(docs, lambda ids: (ids,), schema, "doc_id bigint, ids array<int>", rank_file)


def decode_frame(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, bytes) of each row (doc_id, ids); null ids are none."""
    small_batches(encoded.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode(ids or [], rank_file) for ids in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, pa.binary())], schema=schema)

    return pick(encoded, doc_id="bigint", ids="array<int>").mapInArrow(run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, rank_file: str) -> DataFrame:
    """Digests of both directions in one pass: n_tokens, ids_sha256, decoded_sha256 for each row."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digests(ids: list[int]) -> tuple:
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decode(ids, rank_file)).hexdigest()

    return map_texts(docs, digests, schema, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", rank_file)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: every kept document with its digests."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select("*", F.lit("byte_bpe_50k").alias("vocabulary"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
