"""Order book replay: one ordered pass over the events of each instrument.

A book depends on every earlier event of its instrument, so the replay is a
fold: events are dealt by instrument and sorted by seq within partitions, and a
task streams through them, holding the live orders of one instrument at a time.
Everything that follows (commits, causes, features, tokens) is relational.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.events import F_LAST

DEPTH = 10
LEVEL = "array<struct<price_fp:bigint,size:bigint>>"
EVENT = ["instrument_id", "seq", "ts_ns", "order_id", "action", "side", "price_fp", "size"]
BOOK_SCHEMA = (
    "instrument_id bigint, seq bigint, ts_ns bigint, order_id bigint, action string, side string, price_fp bigint, size bigint, "
    "is_commit int, pre_bid bigint, pre_ask bigint, bid bigint, ask bigint, bid_size bigint, ask_size bigint, n_bids int, n_asks int"
)
TOPS = f", bids {LEVEL}, asks {LEVEL}"


class Side:
    """Sizes by price; prices sorted so that the best is last."""

    def __init__(self, sign: int):
        self.sign, self.sizes, self.keys = sign, {}, []

    def add(self, price: int, size: int) -> None:
        if price not in self.sizes:
            self.sizes[price] = 0
            insort(self.keys, self.sign * price)
        self.sizes[price] += size

    def take(self, price: int, size: int) -> None:
        held = self.sizes.get(price)
        if held is None:
            return
        if held <= size:
            del self.sizes[price]
            del self.keys[bisect_left(self.keys, self.sign * price)]
        else:
            self.sizes[price] = held - size

    def best(self) -> tuple[int | None, int]:
        if not self.keys:
            return None, 0
        price = self.sign * self.keys[-1]
        return price, self.sizes[price]

    def top(self) -> list[int]:
        """The best prices, best first."""
        return [self.sign * k for k in self.keys[: -DEPTH - 1 : -1]]


class Tops:
    """The recorded levels of one side, as columns: where each list begins, prices, sizes."""

    def __init__(self) -> None:
        self.begin, self.prices, self.sizes = [], [], []

    def add(self, side: Side | None) -> None:
        self.begin.append(None if side is None else len(self.prices))
        if side is not None:
            top = side.top()
            self.prices += top
            self.sizes += [side.sizes[p] for p in top]

    def array(self) -> pa.Array:
        levels = pa.StructArray.from_arrays([pa.array(self.prices, pa.int64()), pa.array(self.sizes, pa.int64())], names=["price_fp", "size"])
        return pa.ListArray.from_arrays(pa.array([*self.begin, len(self.prices)], pa.int32()), levels)


class Book:
    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.orders: dict[int, tuple[str, int, int]] = {}
        self.sides = {"B": Side(1), "A": Side(-1)}

    def held(self) -> tuple[dict, dict]:
        """What restore() needs: live orders, and sizes by price of each side."""
        return self.orders, {name: side.sizes for name, side in self.sides.items()}

    def restore(self, held: tuple[dict, dict]) -> None:
        self.orders = held[0]
        for name, sizes in held[1].items():
            side = self.sides[name]
            side.sizes, side.keys = sizes, sorted(side.sign * price for price in sizes)

    def drop(self, order: int) -> tuple[str, int, int] | None:
        held = self.orders.pop(order, None)
        if held:
            self.sides[held[0]].take(held[1], held[2])
        return held

    def put(self, order: int, side: str, price: int, size: int) -> None:
        side = "B" if side == "B" else "A"  # every other side is an ask
        self.orders[order] = (side, price, size)
        self.sides[side].add(price, size)

    def apply(self, action: str, order: int, side: str, price: int, size: int) -> None:
        """Add; cancel (all of the stored order); modify (known orders only); fill (size is what
        remains); clear. A trade and an unknown order leave the book as it is."""
        if action == "A":
            self.put(order, side, price, size)
        elif action == "C":
            self.drop(order)
        elif action == "M":
            if self.drop(order):
                self.put(order, side, price, size)
        elif action == "F":
            held = self.drop(order)
            if held and size > 0:
                self.put(order, held[0], held[1], size)
        elif action == "R":
            self.clear()


def replay(mbo: DataFrame, tops: bool = True) -> DataFrame:
    """Every event with the best prices before and after it, and, if tops, the best levels at commits.

    The event's own columns pass through as they are; only what the book adds is built, by columns.
    """
    names = [c.split(" ")[0] for c in BOOK_SCHEMA.split(", ")]
    types = [pa.int32()] + [pa.int64()] * 6 + [pa.int32()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, book = None, Book()
        for batch in batches:
            made: list[list] = [[] for _ in types]
            sides = Tops(), Tops()
            for inst, order, action, side, price, size, flags in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6, 7, 8))):
                if inst != now:
                    now, book = inst, Book()
                pre_bid, pre_ask = book.sides["B"].best()[0], book.sides["A"].best()[0]
                book.apply(action, order, side, price, size)
                bids, asks = book.sides["B"], book.sides["A"]
                (bid, bid_size), (ask, ask_size) = bids.best(), asks.best()
                commit = flags & F_LAST != 0
                for column, value in zip(made, (int(commit), pre_bid, pre_ask, bid, ask, bid_size, ask_size, min(DEPTH, len(bids.keys)), min(DEPTH, len(asks.keys)))):
                    column.append(value)
                if tops:
                    sides[0].add(bids if commit else None)
                    sides[1].add(asks if commit else None)
            columns = [batch.column(k) for k in range(8)] + [pa.array(c, t) for c, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(columns + [s.array() for s in sides if tops], names=names + ["bids", "asks"] * tops)

    dealt = mbo.select(*EVENT, "flags").repartition("instrument_id").sortWithinPartitions("instrument_id", "seq")
    return dealt.mapInArrow(run, BOOK_SCHEMA + TOPS * tops)


def levels(book: DataFrame) -> DataFrame:
    """(instrument_id, seq, side, lvl, price_fp, size): the recorded levels at every commit, best first."""
    one = lambda side, col: book.where("is_commit = 1").selectExpr("instrument_id", "seq", f"'{side}' as side", f"posexplode({col}) as (lvl, l)")
    return one("B", "bids").unionByName(one("A", "asks")).selectExpr("instrument_id", "seq", "side", "lvl", "l.price_fp", "l.size")
