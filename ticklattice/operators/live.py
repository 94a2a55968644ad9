"""The live feed: messages of parallel arrays to market-by-order events, and what recovers a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.events import F_LAST

#: Codes of the feed. Anything else is a new order, and a buy.
NEW, CHANGE, DELETE = 1, 2, 3
BUY, SELL = 1, 2
DEPTH, TRADE = 160, 150


def price_to_fixed(price: Column) -> Column:
    return F.round(price * 1e9).cast("bigint")


def source_time(seconds: Column, nanos: Column) -> Column:
    return seconds * 1000000000 + nanos


def gateway_time(seconds: Column, micros: Column) -> Column:
    return seconds * 1000000000 + micros * 1000


def action_of(update: Column) -> Column:
    return F.when(update == CHANGE, "M").when(update == DELETE, "C").otherwise("A")


def side_of(transaction: Column) -> Column:
    return F.when(transaction == SELL, "A").otherwise("B")


def depth_messages(feed: DataFrame, size: int = 8) -> DataFrame:
    """Messages as the feed sends them, from single events (instrument_id, seq, ts_ns, action, side, order_id, price_fp,
    size): up to size neighbouring book events of an instrument in parallel arrays, trades alone."""
    code = F.when(F.col("action") == "M", CHANGE).when(F.col("action") == "C", DELETE).otherwise(NEW)
    one = F.struct(
        "seq", code.alias("update_type"), F.when(F.col("side") == "B", BUY).otherwise(SELL).alias("transaction_type"),
        (F.col("price_fp") / 1e9).alias("depth_price"), F.col("size").alias("depth_size"), F.concat(F.lit("x"), F.col("order_id").cast("string")).alias("exchange_order_id"),
        F.floor(F.col("ts_ns") / 1000000000).alias("ssboe"), F.floor(F.col("ts_ns") % 1000000000 / 1000).alias("usecs"),
    )
    trade = F.col("action") == "T"
    group = F.struct(F.floor(F.col("seq") / size).alias("block"), F.when(trade, F.col("seq")).alias("trade"))
    held = feed.groupBy("instrument_id", group.alias("m")).agg(F.array_sort(F.collect_list(one)).alias("e"))
    arrays = [F.col(f"e.{c}").alias(c) for c in ("seq", "update_type", "transaction_type", "depth_price", "depth_size", "exchange_order_id", "ssboe", "usecs")]
    return held.select("instrument_id", F.when(F.col("m.trade").isNull(), DEPTH).otherwise(TRADE).alias("template_id"), *arrays)


def events_of(messages: DataFrame) -> DataFrame:
    """(instrument_id, seq, ts_ns, action, side, order_key, price_fp, size, flags) of depth messages and last trades.

    The elements of a depth message are events in their order, the last of
    them with the last-of-batch bit. A trade is one event without an order.
    Messages of other templates are passed over.
    """
    arrays = ["seq", "update_type", "transaction_type", "depth_price", "depth_size", "exchange_order_id", "ssboe", "usecs"]
    routed = messages.where(F.col("template_id").isin(DEPTH, TRADE))
    each = routed.select("instrument_id", "template_id", F.size("seq").alias("n"), F.posexplode(F.arrays_zip(*arrays)).alias("at", "e"))
    trade = F.col("template_id") == TRADE
    return each.select(
        "instrument_id", "e.seq", gateway_time(F.col("e.ssboe"), F.col("e.usecs")).cast("bigint").alias("ts_ns"),
        F.when(trade, "T").otherwise(action_of(F.col("e.update_type"))).alias("action"), side_of(F.col("e.transaction_type")).alias("side"),
        F.when(~trade, F.col("e.exchange_order_id")).alias("order_key"), price_to_fixed(F.col("e.depth_price")).alias("price_fp"), F.col("e.depth_size").alias("size"),
        F.when(trade | (F.col("at") == F.col("n") - 1), F_LAST).otherwise(0).alias("flags"),
    )


def live_events(feed: DataFrame, order_numbers: DataFrame) -> DataFrame:
    """The events of a feed with orders numbered by first appearance, from one; trades have number 0."""
    found = events_of(depth_messages(feed)).join(order_numbers, "order_key", "left")
    number = F.when(F.col("action") == "T", F.lit(0)).otherwise(F.col("number"))
    return found.select("instrument_id", "seq", "ts_ns", "action", "side", number.cast("bigint").alias("order_number"), "price_fp", "size", "flags")
