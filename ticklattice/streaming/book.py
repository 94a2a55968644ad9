"""The order book as a stream: state by instrument, best prices at every commit."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.book import DEPTH, Book
from ..sources.events import F_LAST, MBO_SCHEMA
from ..sources.shared import shared_path

COMMITS = "instrument_id bigint, seq bigint, ts_ns bigint, bid bigint, ask bigint, bid_size bigint, ask_size bigint, n_bids int, n_asks int"
_NAMES = [c.split(" ")[0] for c in COMMITS.split(", ")]
_EVENT = ("seq", "ts_ns", "order_id", "action", "side", "price_fp", "size", "flags")


def _advance(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Applies one micro-batch of an instrument in order of seq; the book goes on in the state."""
    book = Book()
    if state.exists:
        book.restore(pickle.loads(state.get[0]))
    out = []
    for seq, ts, order, action, side, price, size, flags in pd.concat(pdfs).sort_values("seq")[list(_EVENT)].itertuples(index=False, name=None):
        book.apply(action, order, side, price, size)
        if flags & F_LAST:
            bids, asks = book.sides["B"], book.sides["A"]
            (bid, bid_size), (ask, ask_size) = bids.best(), asks.best()
            out.append((key[0], seq, ts, bid, ask, bid_size, ask_size, min(DEPTH, len(bids.keys)), min(DEPTH, len(asks.keys))))
    state.update((pickle.dumps(book.held()),))
    frame = pd.DataFrame(out, columns=_NAMES)
    for k, name in enumerate(_NAMES):
        if name in ("bid", "ask"):
            frame[name] = pd.array([r[k] for r in out], dtype="Int64")
    yield frame


def stream_commits(events: DataFrame) -> DataFrame:
    """The commits of a stream of market-by-order events.

    Micro-batches must come in order of seq; inside one the order is free. A
    worker holds one instrument's share of a micro-batch, so the trigger bounds
    it. The state of an instrument is its live orders and levels.
    """
    return events.groupBy("instrument_id").applyInPandasWithState(_advance, COMMITS, "book binary", "append", GroupStateTimeout.NoTimeout)


def replayed_as_stream(mbo: DataFrame) -> DataFrame:
    """mbo written to the shared folder, streamed from there, and the commits that came out."""
    spark = mbo.sparkSession
    source, sink, marks = (shared_path(spark, name) for name in ("stream-in", "stream-out", "stream-marks"))
    mbo.write.parquet(source)
    events = spark.readStream.schema(MBO_SCHEMA).parquet(source)
    run = stream_commits(events).writeStream.format("parquet").outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).start(sink)
    run.awaitTermination()
    return spark.read.schema(COMMITS).parquet(sink)
