"""The book fold on hand-made events, and the averages against a plain loop."""

import math
import random

from pyspark.sql import functions as F

from ticklattice.operators.book import Book, replay
from ticklattice.operators.ema import ema
from ticklattice.operators.serial import serial_trades
from ticklattice.sources.events import MBO_SCHEMA


def best(book):
    return book.sides["B"].best(), book.sides["A"].best()


def test_book_rules():
    b = Book()
    b.apply("A", 1, "B", 100, 5)
    b.apply("A", 2, "B", 101, 3)
    b.apply("A", 3, "N", 105, 2)  # any other side is an ask
    assert best(b) == ((101, 3), (105, 2))
    b.apply("T", 0, "B", 101, 99)  # a trade changes nothing
    b.apply("C", 77, "B", 101, 3)  # nor does an unknown order
    b.apply("M", 78, "B", 200, 3)
    assert best(b) == ((101, 3), (105, 2))
    b.apply("F", 2, "A", 999, 1)  # what remains, at the stored price and side
    assert best(b)[0] == (101, 1)
    b.apply("M", 2, "A", 104, 4)
    assert best(b) == ((100, 5), (104, 4))
    b.apply("F", 2, "A", 104, 0)
    assert best(b)[1] == (105, 2)
    b.apply("R", 0, "N", 0, 0)
    assert best(b) == ((None, 0), (None, 0))


def test_repeated_add_leaves_the_old_level():
    b = Book()
    b.apply("A", 1, "B", 100, 5)
    b.apply("A", 1, "B", 99, 2)
    b.apply("C", 1, "B", 0, 0)
    assert b.sides["B"].best() == (100, 5)


def test_replay_by_instrument(spark):
    rows = [(1, 10, 7, 1, "A", "B", 100, 5, 0), (2, 20, 8, 2, "A", "A", 110, 1, 128), (3, 30, 7, 3, "A", "A", 120, 1, 128), (4, 40, 7, 1, "C", "B", 0, 0, 128)]
    out = {r["seq"]: r for r in replay(spark.createDataFrame(rows, MBO_SCHEMA)).collect()}
    assert (out[3]["bid"], out[3]["ask"], out[3]["pre_ask"]) == (100, 120, None)
    assert (out[4]["bid"], out[4]["pre_bid"], out[4]["n_bids"]) == (None, 100, 0)
    assert out[2]["bid"] is None and [tuple(x) for x in out[2]["asks"]] == [(110, 1)] and out[1]["bids"] is None
    assert replay(spark.createDataFrame([], MBO_SCHEMA)).count() == 0


def test_average_over_block_bounds(spark):
    rng = random.Random(1)
    rows = [(1, k, rng.random() < 0.7, float(rng.randint(-5, 5))) for k in range(700)]
    df = spark.createDataFrame(rows, "instrument_id bigint, seq bigint, u boolean, x double")
    got = [r["v"] for r in ema(df, "v", F.col("u"), F.col("x"), 2).orderBy("seq").collect()]
    v = 0.0
    for (_, _, u, x), g in zip(rows, got):
        v = v * math.exp(-math.log(2) / 2) + x if u else v
        assert abs(v - g) < 1e-9


def test_serial_trades(spark):
    rows = [("a", 1, 10, 30), ("a", 2, 20, 25), ("a", 3, 30, 40), ("b", 4, 20, 99), ("b", 5, 98, 100), ("b", 6, 99, 99), ("b", 7, 99, 120)]
    df = spark.createDataFrame(rows, "g string, seq bigint, ts_ns bigint, exit_ts bigint")
    assert sorted(r["seq"] for r in serial_trades(df, ["g"], ["seq"]).collect()) == [1, 3, 4, 6, 7]
