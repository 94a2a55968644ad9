"""Windows and their packed files against plain Python, recovery over several micro-batches, restarts."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklattice.sources import windows
from ticklattice.streaming.recovery import FATES, MESSAGES, backoff, stream_fates, supervise


def made(spark, lengths, seed=5):
    """Tokens, states of most commits, and both as lists."""
    rng, tokens, states = random.Random(seed), [], []
    for inst, n in lengths.items():
        for pos in range(n):
            token = rng.choice((3, 4, 10, 70))
            tokens.append((inst, pos, token))
            if token == 3 and rng.random() < 0.9:
                states.append((inst, pos, [float(rng.randint(0, 9)) for _ in range(windows.FIELDS)]))
    return spark.createDataFrame(tokens, "instrument_id bigint, pos bigint, token int"), spark.createDataFrame(states, "instrument_id bigint, pos bigint, state array<double>"), tokens, states


def plain(tokens, states, context, stride, most):
    out = {}
    for inst in {t[0] for t in tokens}:
        ids = [t[2] for t in tokens if t[0] == inst]
        held = [(p, s) for i, p, s in states if i == inst]
        for start in range(0, len(ids) - context, stride):
            inside = [(k, p - start, s) for k, (p, s) in enumerate(held) if start <= p < start + context][:most]
            out[inst, start] = ids[start : start + context], ids[start + 1 : start + context + 1], [(at, s, held[k - 1][1] if k else None) for k, at, s in inside]
    return out


def found(rows):
    return [(list(r["x"]), list(r["y"]), [(c["at"], list(c["post"]), None if c["pre"] is None else list(c["pre"])) for c in r["commits"]]) for r in rows]


@pytest.mark.parametrize("context,stride,most", [(8, 4, 3), (8, 20, 5), (5, 5, 1)])
def test_windows_against_plain_slices(spark, context, stride, most):
    df, known, tokens, states = made(spark, {1: 50, 2: context + 1, 3: context, 4: 1})
    got = windows.recon_windows(df, known, context, stride, most).collect()
    want = plain(tokens, states, context, stride, most)
    assert dict(zip([(r["instrument_id"], r["start_pos"]) for r in got], found(got))) == want and len(got) == len(want) > 2
    assert windows.recon_windows(df.limit(0), known, context, stride, most).count() == 0
    assert all(not r["commits"] for r in windows.recon_windows(df, known.limit(0), context, stride, most).collect())


def test_packed_files(spark, tmp_path):
    df, known, tokens, states = made(spark, {1: 60, 2: 40})
    path = f"file://{tmp_path}/packed"
    rows = windows.recon_windows(df, known, 8, 4, 3)
    want = plain(tokens, states, 8, 4, 3)
    assert windows.write_packed(rows, path, 8, 3, rows=5) == len(want)
    back = windows.read_packed(spark, path, rows=2)
    assert sorted(map(repr, found(back.collect()))) == sorted(map(repr, want.values()))
    # the layout, read without the library's own reader
    files = sorted((tmp_path / "packed").glob("*.pkdw"))
    raw = files[0].read_bytes()
    magic, version, n, context, most, size = struct.unpack("<4sIQIII", raw[:28])
    assert (magic, version, context, most, size) == (b"PKDW", 1, 8, 3, 8 * 4 + 3 * 2 + 3 * 12 * 8 + 3 + 4) and len(raw) == 64 + n * size
    assert np.frombuffer(raw[64 : 64 + 16], "<i2").tolist() in [x for x, _, _ in want.values()]
    for name, bad in (("short", raw[:40]), ("magic", b"NOPE" + raw[4:]), ("version", raw[:4] + b"\x02" + raw[5:]), ("cut", raw[:-1])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.pkdw").write_bytes(bad)
        with pytest.raises(Exception, match="no packed file|has version|has not the length"):
            windows.read_packed(spark, f"file://{tmp_path}/{name}").collect()
    assert windows.write_packed(rows.limit(0), f"file://{tmp_path}/none", 8, 3) == 0


def streamed(spark, folder, batches, limit):
    source, sink, marks = (str(folder / x) for x in ("in", "out", "marks"))
    for batch in batches:
        spark.createDataFrame(batch, MESSAGES).coalesce(1).write.mode("append").parquet(source)
        query = stream_fates(spark.readStream.schema(MESSAGES).parquet(source), limit).writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(sink)
        query.awaitTermination()
    return {(r["instrument_id"], r["seq"]): r["fate"] for r in spark.read.schema(FATES).parquet(sink).collect()}


def test_recovery_over_micro_batches(spark, tmp_path):
    kinds = ["event", "clear", "event", "event", "level", "event", "end", "event", "level", "event", "clear", "event", "end", "clear", "event", "event", "event", "event", "end", "clear", "event"]
    # the first end stands at 4, the others before their events
    rows = [(1, k, k, kind, {6: 4, 12: 10, 18: 0}.get(k, k)) for k, kind in enumerate(kinds)]
    got = streamed(spark, tmp_path, [rows[:5], rows[5:12], [*rows[12:], (2, 99, 99, "event", 99)]], 3)
    events = {k: got.get((1, k)) for k, kind in enumerate(kinds) if kind == "event"}
    assert events == {0: "live", 2: "discarded", 3: "discarded", 5: "replayed", 7: "live", 9: None, 11: "replayed", 14: "lost", 15: "lost", 16: "lost", 17: None, 20: None}
    assert got[1, 6] == "end" and got[1, 4] == "level" and got[2, 99] == "live"


class Query:
    def __init__(self, fails, progress=None):
        self.fails, self.lastProgress = fails, progress

    def awaitTermination(self):
        if self.fails:
            raise RuntimeError("lost")


def test_restarts():
    assert [backoff(n) for n in range(8)] == [1, 2, 4, 8, 16, 30, 30, 30]
    runs, log, waits = iter([Query(True), Query(True), Query(True, {"batchId": 1}), Query(False)]), [], []
    assert supervise(lambda: next(runs), log.append, sleep=waits.append) == 3
    assert waits == [2, 4, 2] and [e["event"] for e in log] == ["gap_start", "gap_end"] * 3
    with pytest.raises(RuntimeError):
        supervise(lambda: Query(True), log.append, attempts=2, sleep=waits.append)
    assert waits == [2, 4, 2, 2]
