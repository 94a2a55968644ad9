"""Order-flow state at every commit: averages of trades, adds, cancels and queue imbalance.

An average counts updates, not time: it decays by half over its half-life in
updates of its own and then takes the new value. All of them go on in one fold
over the events of an instrument, which hold only what they are now. Sums are
whole numbers of 2**-96 relative to the last full half-life, so that they
neither drift nor overflow, and each average is rounded once.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import pyarrow as pa
from pyspark.sql import DataFrame

from .ema import SCALES

#: Of each average: when an event updates it, and by what.
EVENT_FLOWS = {
    "trade_flow": ("action in ('T', 'F')", "case when side = 'B' then size else -size end"),
    "cancel_bid": ("action = 'C' and side = 'B'", "size"),
    "cancel_ask": ("action = 'C' and side <> 'B'", "size"),
    "add_bid": ("action = 'A' and side = 'B'", "size"),
    "add_ask": ("action = 'A' and side <> 'B'", "size"),
    "event_intensity": ("1 = 1", "1"),
    "trade_intensity": ("action = 'T'", "1"),
}
NAMES = [f"{f}_{s}" for f in [*EVENT_FLOWS, "ofi"] for s in SCALES]
FLOW_SCHEMA = "instrument_id bigint, seq bigint, ts_ns bigint, " + ", ".join(f"{n} double" for n in NAMES) + ", inter_event_time_ns bigint, event_rate double"

_FLOWS = list(EVENT_FLOWS)
_OFI, _EVERY, _TRADES = len(_FLOWS), _FLOWS.index("event_intensity"), _FLOWS.index("trade_intensity")
_BY_ACTION = {("C", True): "cancel_bid", ("C", False): "cancel_ask", ("A", True): "add_bid", ("A", False): "add_ask"}


def _growth(half_life: int) -> list[int]:
    """2 ** (r / half_life) for each r below half_life, in units of 2**-96."""
    with localcontext(prec=60):
        step = int(Decimal(2) ** (Decimal(1) / half_life) * 2**160)
    powers = [1 << 160]
    while len(powers) < half_life:
        powers.append(powers[-1] * step >> 160)
    return [p >> 64 for p in powers]


_GROWTH = [_growth(h) for h in SCALES.values()]


def queue_change(now: int | None, size: int, before: int | None, size_before: int) -> int:
    """Of one side: what its best queue gained since the last commit; a higher price counts as improved on either side."""
    if now is None:
        return 0 if before is None else -size_before
    if before is None or now > before:
        return size
    return size - size_before if now == before else -size_before


def flow_states(book: DataFrame) -> DataFrame:
    """Every commit with its averages, the time between events and the event rate.

    The averages of the queue imbalance count the commits where it is not zero.
    The time between events stays as it was where the clock goes back.
    """
    kept = ["instrument_id", "seq", "ts_ns", "action", "side", "size", "is_commit", "bid", "ask", "bid_size", "ask_size"]
    names = [c.split(" ")[0] for c in FLOW_SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.float64() if n in NAMES or n == "event_rate" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, values, last, dt, best = None, [], None, 0, (None, 0, None, 0)
        counts, sums, stale = [], [], set()
        scales = [(k, len(grow), grow) for k, grow in enumerate(_GROWTH)]

        def update(flow: int, x: int) -> None:
            counts[flow] += 1
            n, held = counts[flow], sums[flow]
            for k, half_life, grow in scales:
                r = n % half_life
                held[k] = (held[k] if r else held[k] >> 1) + x * grow[r]
            stale.add(flow)

        for batch in batches:
            out = []
            for inst, seq, ts, action, side, size, commit, bid, ask, bid_size, ask_size in zip(*(c.to_pylist() for c in batch.columns)):
                if inst != of:
                    of, values, last, dt, best = inst, [0.0] * len(NAMES), None, 0, (None, 0, None, 0)
                    counts, sums = [0] * (_OFI + 1), [[0] * len(scales) for _ in range(_OFI + 1)]
                    stale.clear()
                if last is not None and ts >= last:
                    dt = ts - last
                last = ts
                update(_EVERY, 1)
                if action in ("T", "F"):
                    update(0, size if side == "B" else -size)
                    if action == "T":
                        update(_TRADES, 1)
                elif (action, side == "B") in _BY_ACTION:
                    update(_FLOWS.index(_BY_ACTION[action, side == "B"]), size)
                if commit:
                    ofi = queue_change(bid, bid_size, best[0], best[1]) - queue_change(ask, ask_size, best[2], best[3])
                    if ofi:
                        update(_OFI, ofi)
                    best = bid, bid_size, ask, ask_size
                    for flow in stale:
                        for k, half_life, grow in scales:
                            values[flow * len(scales) + k] = sums[flow][k] / grow[counts[flow] % half_life]
                    stale.clear()
                    out.append((inst, seq, ts, *values, dt, 1e9 / dt if dt > 0 else 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(names), schema)], schema=schema)

    return book.select(*kept).repartition("instrument_id").sortWithinPartitions("instrument_id", "seq").mapInArrow(run, FLOW_SCHEMA)
