"""Counts of token contexts of every length up to a longest one, from one pass over windows.

The tokens before a token, the last one first, are a string of bytes; of strings
in order, those that share a context of any length are neighbours. Windows are
dealt by their last NEAR tokens, so a task holds every window that shares a
context of that length or more; shorter contexts are added up from the tasks'
own sums. Windows travel in compressed blocks, not as rows, and no text is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: Tokens by which windows are dealt; tokens of a run with its own beginning; windows sent together; windows of a group.
NEAR, RUN, SENT, HELD = 5, 1 << 18, 1 << 18, 400_000
#: Tokens that a byte can say; 0 stands for none. Contexts with others are not counted here.
LEAST, MOST = 1, 254
#: Stands for a null token where numbers are counted.
NULL = -(1 << 31)
SUMS = "ord int, ctx bigint, token int, trained bigint, tested bigint, bits double"

_BLOCK = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("windows", pa.binary())])
_SUMS = pa.schema([("ord", pa.int32()), ("ctx", pa.int64()), ("token", pa.int32()), ("trained", pa.int64()), ("tested", pa.int64()), ("bits", pa.float64())])


def strange(token: str) -> str:
    """SQL for a token that no byte can say."""
    return f"({token} is null or {token} not between {LEAST} and {MOST})"


def windows_of(codes: np.ndarray, longest: int) -> np.ndarray:
    """(n - longest, longest): the codes before each one from the longest-th on, the last first, none behind a 0."""
    found = np.lib.stride_tricks.sliding_window_view(codes[:-1], longest)[:, ::-1]
    if (codes == 0).any():
        found = found * np.logical_and.accumulate(found != 0, axis=1)
    return np.ascontiguousarray(found, np.uint8)


def _dealt(windows: np.ndarray, parts: int) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    for k in range(NEAR):
        h = (h + windows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(16)) % np.uint64(parts)


def _blocks(windows: np.ndarray, tokens: np.ndarray, training: np.ndarray, parts: int) -> pa.RecordBatch:
    part = _dealt(windows, parts).astype(np.int32)
    order = np.argsort(part, kind="stable")
    found, begin = np.unique(part[order], return_index=True)
    rows = [order[a:b] for a, b in zip(begin, [*begin[1:], len(order)])]
    raw = [windows[r].T.tobytes() + training[r].tobytes() + tokens[r].tobytes() for r in rows]
    codec = pa.Codec("zstd", 3)
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array([len(r) for r in rows], pa.int32()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], schema=_BLOCK)


def window_sums(windows: np.ndarray, tokens: np.ndarray, training: np.ndarray) -> dict[str, np.ndarray]:
    """SUMS of all windows that share their last NEAR tokens: by order the tested tokens and their bits; by short context and token the counts.

    tokens: NULL equals no other token but counts for its context.
    """
    longest = windows.shape[1]
    padded = np.zeros((len(windows), -(-longest // 8) * 8), np.uint8)
    padded[:, :longest] = windows
    keys = padded.view(">u8").astype(np.uint64)
    by_context = np.lexsort(keys.T[::-1])
    by_token = by_context[np.argsort(tokens[by_context], kind="stable")]
    place = np.empty(len(windows), np.int64)
    place[by_context] = np.arange(len(windows))

    def shared(order: np.ndarray) -> np.ndarray:
        """The tokens that each window of the order shares with the one before."""
        differ = windows[order[1:]] != windows[order[:-1]]
        return np.concatenate([[-1], np.where(differ.any(axis=1), differ.argmax(axis=1), longest)])

    def cut(cum: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return cum[np.append(starts[1:], len(windows))] - cum[starts]

    context_shared, token_shared = shared(by_context), shared(by_token)
    token_shared[1:][tokens[by_token[1:]] != tokens[by_token[:-1]]] = -1
    cum = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    context_trained, token_trained, token_tested = cum(training[by_context]), cum(training[by_token]), cum(1 - training[by_token])
    place, known = place[by_token], tokens[by_token] != NULL
    out: dict[str, list] = {n: [] for n in _SUMS.names}

    def add(ord_, ctx, token, trained, tested, bits) -> None:
        for column, value in zip(out.values(), np.broadcast_arrays(ord_, ctx, token, trained, tested, bits)):
            column.append(value)

    for k in range(NEAR, longest + 1):
        starts = np.flatnonzero(context_shared < k)
        total = cut(context_trained, starts)
        pairs = np.flatnonzero(token_shared < k)
        tested = cut(token_tested, pairs)
        use = (tested > 0) & (windows[by_token[pairs], k - 1] != 0)
        if use.any():
            pairs, tested, trained = pairs[use], tested[use], cut(token_trained, pairs)[use]
            of = np.searchsorted(starts, place[pairs], side="right") - 1
            bits = tested * np.log2((np.where(known[pairs], trained, 0) + 1.0) / (total[of] + 126.0))
            add([k], 0, 0, 0, tested.sum(), bits.sum())
    pairs = np.flatnonzero(token_shared < NEAR - 1)
    short = windows[by_token[pairs], : NEAR - 1].astype(np.int64)
    add(0, (short << (8 * np.arange(NEAR - 1))).sum(axis=1), tokens[by_token[pairs]], cut(token_trained, pairs), cut(token_tested, pairs), 0.0)
    return {n: np.concatenate(c) for n, c in out.items()}


def context_sums(halves: DataFrame, longest: int) -> DataFrame:
    """(ord, n, bits): of each order up to the longest, the tokens tested after a context of that length and the sum of their log2 probabilities.

    halves: (instrument_id, training, pos, token), pos without gaps. A probability
    is (c + 1) / (total + 126) of the counts where training is 1; it is asked
    where training is 0. Contexts that hold a strange token are left out.
    """
    parts = halves.count() // HELD + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, before, held = None, None, []
        for batch in batches:
            *names, own, token = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1] + [batch.columns[-1].fill_null(NULL)])
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)) + 1
            for a, b in zip([0, *changes], [*changes, len(token)]):
                if of != (now := tuple(c[a] for c in names)):
                    of, before = now, np.zeros(longest, np.uint8)
                t = token[a:b]
                codes = np.concatenate([before, np.where((t < LEAST) | (t > MOST), 0, t).astype(np.uint8)])
                before = codes[-longest:]
                windows = windows_of(codes, longest)
                use = own[a:b] & (windows[:, 0] != 0)
                held.append((windows[use], t[use].astype(np.int32), np.full(int(use.sum()), now[1], np.uint8)))
            if sum(len(h[1]) for h in held) >= SENT:
                yield _blocks(*(np.concatenate(c) for c in zip(*held)), parts)
                held = []
        if held:
            yield _blocks(*(np.concatenate(c) for c in zip(*held)), parts)

    def count(group: pa.Table) -> pa.Table:
        codec, found = pa.Codec("zstd"), []
        for n, block in zip(group.column("n").to_pylist(), group.column("windows").to_pylist()):
            raw = np.frombuffer(codec.decompress(block, n * (longest + 5)), np.uint8)
            found.append((raw[: n * longest].reshape(longest, n).T, raw[n * (longest + 1) :].view(np.int32), raw[n * longest : n * (longest + 1)]))
        sums = window_sums(*(np.ascontiguousarray(np.concatenate(c)) for c in zip(*found)))
        return pa.Table.from_arrays([pa.array(sums[f.name], f.type) for f in _SUMS], schema=_SUMS)

    # a run begins with the tokens before it, so that a long half is many runs
    run = f"pos div {RUN}"
    runs = halves.selectExpr("instrument_id", "training", f"explode(if(pos % {RUN} >= {RUN - longest}, array({run}, {run} + 1), array({run}))) as run", "pos", "token")
    runs = runs.selectExpr("instrument_id", "training", "run", f"run = {run} as own", "pos", "token")
    dealt = runs.repartition("instrument_id", "training", "run").sortWithinPartitions("instrument_id", "training", "run", "pos").drop("pos")
    blocks = dealt.mapInArrow(send, "part int, n int, windows binary")
    path = shared_path(halves.sparkSession, "context-sums")
    blocks.groupBy("part").applyInArrow(count, SUMS).write.parquet(path)
    sums = halves.sparkSession.read.schema(SUMS).parquet(path)
    long = sums.where("ord > 0").groupBy("ord").agg(F.sum("tested").alias("n"), F.sum("bits").alias("bits"))
    return long.unionByName(_short(sums.where("ord = 0")))


def _short(sums: DataFrame) -> DataFrame:
    """The same of the orders under NEAR, from counts by context and token."""
    added = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("trained").alias("trained"), F.sum("tested").alias("tested"))
    each = added(sums, "ctx", "token").selectExpr("*", f"explode(sequence(1, {NEAR - 1})) as ord").where("(shiftright(ctx, 8 * (ord - 1)) & 255) <> 0")
    pairs = added(each.withColumn("ctx", F.expr("ctx & (shiftleft(1L, 8 * ord) - 1)")), "ord", "ctx", "token")
    totals = pairs.groupBy("ord", "ctx").agg(F.sum("trained").alias("total"))
    bits = f"tested * log2((if(token = {NULL}, 0, trained) + 1D) / (total + 126D))"
    return pairs.where("tested > 0").join(totals, ["ord", "ctx"]).groupBy("ord").agg(F.sum("tested").alias("n"), F.sum(F.expr(bits)).alias("bits"))
