"""Ten features of the last events before each commit, against the best prices at that commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK = 200
TICK = 250000000
NAMES = ["cancel_rate_bid", "cancel_rate_ask", "add_rate_bid", "add_rate_ask", "trade_aggression", "message_rate", "cancel_add_ratio", "bbo_change_count", "price_momentum_ticks", "flow_toxicity"]

_AT_BEST = f"(e.side = 'B' and abs(e.price_fp - bid) < {TICK * 6 // 10} or e.side = 'A' and abs(e.price_fp - ask) < {TICK * 6 // 10})"
_COUNTS = {
    **{f"{kind}_rate_{side}": f"size(filter(frame, e -> e.action = '{a}' and e.side = '{s}' and {_AT_BEST})) / n" for kind, a in (("cancel", "C"), ("add", "A")) for side, s in (("bid", "B"), ("ask", "A"))},
    "buys": "aggregate(filter(frame, e -> e.action in ('T', 'F') and e.side = 'B'), 0D, (a, e) -> a + e.size)",
    "sells": "aggregate(filter(frame, e -> e.action in ('T', 'F') and e.side <> 'B'), 0D, (a, e) -> a + e.size)",
    "adds": "size(filter(frame, e -> e.action = 'A'))",
    "cancels": "size(filter(frame, e -> e.action = 'C'))",
    "trades": "size(filter(frame, e -> e.action in ('T', 'F')))",
    "resting": "filter(frame, e -> e.action in ('A', 'C'))",
    "moved": f"(element_at(frame, -1).price_fp - frame[0].price_fp) / {TICK}D",
    "span": "if(n < 2, 1D, greatest(element_at(frame, -1).ts_ns - frame[0].ts_ns, 0) / 1e9D)",
}
_FEATURES = {
    "trade_aggression": "if(buys + sells > 0, (buys - sells) / (buys + sells), 0D)",
    "message_rate": "n / greatest(span, 0.001D)",
    "cancel_add_ratio": "case when adds > 0 then cancels / adds when cancels > 0 then 2D else 0D end",
    "bbo_change_count": f"size(filter(zip_with(slice(resting, 2, greatest(size(resting) - 1, 0)), slice(resting, 1, greatest(size(resting) - 1, 0)), (e, p) -> e.side = p.side and abs(e.price_fp - p.price_fp) > {TICK // 10} and {_AT_BEST}), x -> x))",
    "price_momentum_ticks": "moved",
    "flow_toxicity": "if(trades > 0, abs(moved) / trades, 0D)",
}


def lookback_features(book: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """(instrument_id, seq, the ten features) for each commit of a replayed book.

    The events of a commit are the last ``lookback`` of its instrument up to its
    time, later ones of the same time included. One window collects them, a
    second passes on the frame at the last event of a time; both have one order,
    so the rows are dealt and sorted once. A missing best price is met by none.
    """
    order = Window.partitionBy("instrument_id").orderBy("ts_ns", "seq")
    same = Window.partitionBy("instrument_id", "ts_ns").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    rows = book.select("instrument_id", "seq", "ts_ns", "bid", "ask", "is_commit", F.struct("action", "side", "price_fp", "size", "ts_ns").alias("e"))
    rows = rows.withColumn("frame", F.collect_list("e").over(order.rowsBetween(1 - lookback, 0))).withColumn("frame", F.last("frame").over(same))
    rows = rows.where("is_commit = 1").withColumn("n", F.size("frame"))
    rows = rows.select("instrument_id", "seq", "bid", "ask", "n", *[F.expr(x).alias(k) for k, x in _COUNTS.items()])
    rows = rows.withColumns({k: F.expr(x).cast("double") for k, x in _FEATURES.items()})
    return rows.select("instrument_id", "seq", *NAMES)
