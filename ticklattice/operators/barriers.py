"""First passage of prices through barriers: labels of target, stop or horizon.

One ordered pass over the ticks of an instrument keeps the barriers that are
open in two heaps by price and in a queue by time, so a tick costs what it
closes and not what is open.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

OUTCOMES = "instrument_id bigint, seq bigint, ts_ns bigint, ofi_fast double, direction int, target_ticks int, stop_ticks int, outcome int, exit_ts bigint, pnl_ticks double"


def parse_geometries(text: str) -> list[tuple[int, int]]:
    """Pairs of target and stop ticks from "T:S,T:S,..."; ValueError for anything else."""
    pairs = []
    for part in text.split(","):
        target, _, stop = part.strip().partition(":")
        if not (target.isdigit() and stop.isdigit() and int(target) and int(stop)):
            raise ValueError(f"no pair of ticks: {part!r}")
        pairs.append((int(target), int(stop)))
    return pairs


class Open:
    """The open barriers of one instrument."""

    def __init__(self) -> None:
        self.waiting: list[tuple] = []  # entered at the last tick's time: only later ticks count
        self.above: list[tuple] = []
        self.below: list[tuple] = []
        self.ends: deque[tuple[int, int]] = deque()
        self.alive: dict[int, tuple] = {}
        self.n = 0

    def enter(self, entry: tuple, price2: int, direction: int, geometries: list[tuple[int, int]], tick: int, end: int) -> None:
        for target, stop in geometries:
            up, down = (target, stop) if direction > 0 else (stop, target)
            self.alive[self.n] = (*entry, target, stop)
            self.waiting.append((entry[2], self.n, price2 + 2 * up * tick, price2 - 2 * down * tick, direction, end))
            self.n += 1

    def start(self, ts: int) -> None:
        """Opens what was entered before ts."""
        later = []
        for w in self.waiting:
            if w[0] < ts:
                _, k, up, down, direction, end = w
                heappush(self.above, (up, k, 1 if direction > 0 else 0))
                heappush(self.below, (-down, k, 0 if direction > 0 else 1))
                self.ends.append((end, k))
            else:
                later.append(w)
        self.waiting = later

    def close(self, ts: int, price2: int) -> Iterator[tuple[int, int]]:
        """(barrier, outcome) of all that this tick closes: the horizon before the prices."""
        while self.ends and self.ends[0][0] < ts:
            k = self.ends.popleft()[1]
            if k in self.alive:
                yield k, -1
        for heap, level in ((self.above, price2), (self.below, -price2)):
            while heap and heap[0][0] <= level:
                _, k, outcome = heappop(heap)
                if k in self.alive:
                    yield k, outcome


def barrier_labels(ticks: DataFrame, geometries: list[tuple[int, int]], horizon_ns: int, tick: int) -> DataFrame:
    """A label for each entry and geometry.

    ticks: (instrument_id, seq, ts_ns, price2, direction, entry2, ofi_fast), in
    order of seq; price2 and entry2 are twice the fixed-point mid and entry
    price, direction is 1, -1, or null where nothing is entered. Ticks after
    the entry's time count. The first one beyond the horizon closes with -1,
    else the first at the target (1) or the stop (0); without any, the last
    tick of the instrument closes with -1.
    """
    names = [c.split(" ")[0] for c in OUTCOMES.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in OUTCOMES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, book, last = None, Open(), (0, 0)

        def closed(k: int, outcome: int, ts: int, price2: int) -> tuple:
            inst, seq, entered, ofi, direction, entry2, target, stop = book.alive.pop(k)
            return inst, seq, entered, ofi, direction, target, stop, outcome, ts, (price2 - entry2) * direction / (2 * tick)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(names), schema)], schema=schema)

        for batch in batches:
            out = []
            for inst, seq, ts, price2, direction, entry2, ofi in zip(*(c.to_pylist() for c in batch.columns)):
                if inst != of:
                    out += [closed(k, -1, *last) for k in list(book.alive)]
                    of, book = inst, Open()
                book.start(ts)
                out += [closed(k, outcome, ts, price2) for k, outcome in book.close(ts, price2)]
                if direction is not None:
                    book.enter((inst, seq, ts, ofi, direction, entry2), entry2, direction, geometries, tick, ts + horizon_ns)
                last = ts, price2
            yield batch_of(out)
        yield batch_of([closed(k, -1, *last) for k in list(book.alive)])

    kept = ticks.select("instrument_id", "seq", "ts_ns", "price2", "direction", "entry2", "ofi_fast")
    return kept.repartition("instrument_id").sortWithinPartitions("instrument_id", "seq").mapInArrow(run, OUTCOMES)
