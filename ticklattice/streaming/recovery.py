"""Recovery of books as a stream: what a snapshot lets through, and restarts of a query that fails."""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_path

MESSAGES = "instrument_id bigint, seq bigint, ts_ns bigint, kind string, number bigint"
FATES = "instrument_id bigint, seq bigint, kind string, fate string"
#: Fixed value: messages that are held while a snapshot loads; beyond it nothing is replayed.
BUFFER_LIMIT = 100000


def stream_fates(messages: DataFrame, limit: int = BUFFER_LIMIT) -> DataFrame:
    """(instrument_id, seq, kind, fate) of a stream of messages (instrument_id, seq, kind, number).

    A clear, or a level outside a snapshot, begins a snapshot; events are held
    from then on, and a clear lets go of those held before. At its end those
    with a number beyond that of the end are replayed, the others discarded;
    after more than limit events all that were held are lost. Outside a snapshot
    events are live. Held events come out with the end, so those of a snapshot
    that does not end do not come out. Micro-batches must come in order of seq.
    """

    def advance(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        loading, over, held = pickle.loads(state.get[0]) if state.exists else (False, False, [])
        out = []
        for seq, kind, number in pd.concat(pdfs).sort_values("seq")[["seq", "kind", "number"]].itertuples(index=False, name=None):
            if kind == "event":
                if not loading:
                    out.append((key[0], seq, kind, "live"))
                elif len(held) < limit:
                    held.append((seq, number))
                else:
                    over = True
                continue
            if kind == "clear" or kind == "level" and not loading:
                loading, over, held = True, False, []
            elif kind == "end" and loading:
                out += [(key[0], s, "event", "lost" if over else "replayed" if n > number else "discarded") for s, n in held]
                loading, over, held = False, False, []
            out.append((key[0], seq, kind, kind))
        state.update((pickle.dumps((loading, over, held)),))
        yield pd.DataFrame(out, columns=["instrument_id", "seq", "kind", "fate"])

    return messages.groupBy("instrument_id").applyInPandasWithState(advance, FATES, "held binary", "append", GroupStateTimeout.NoTimeout)


def fates_as_stream(messages: DataFrame) -> DataFrame:
    """messages written to the shared folder, streamed from there, and their fates."""
    spark = messages.sparkSession
    source, sink, marks = (shared_path(spark, name) for name in ("feed-in", "feed-out", "feed-marks"))
    names = [c.split(" ")[0] for c in MESSAGES.split(", ")]
    messages.select(*names).write.parquet(source)
    run = stream_fates(spark.readStream.schema(MESSAGES).parquet(source)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).start(sink)
    run.awaitTermination()
    return spark.read.schema(FATES).parquet(sink)


def backoff(attempt: int) -> int:
    """Seconds before an attempt to connect again."""
    return min(2 ** min(attempt, 5), 30)


def supervise(start: Callable[[], StreamingQuery], log: Callable[[dict], None], attempts: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs the query that start gives until it ends of itself; starts it again from its checkpoint when it fails.

    Each failure is logged as gap_start and each start after one as gap_end. A
    query that made progress begins the waits anew. After so many failures in a
    row the last is raised. Returns the number of failures.
    """
    failures = row = 0
    while True:
        query = None
        try:
            query = start()
            if failures:
                log({"event": "gap_end", "attempt": row})
            query.awaitTermination()
            return failures
        except Exception as error:
            row = 0 if query is not None and query.lastProgress else row
            failures, row = failures + 1, row + 1
            log({"event": "gap_start", "attempt": row, "wait_s": backoff(row), "cause": type(error).__name__})
            if attempts is not None and row >= attempts:
                raise
            sleep(backoff(row))
