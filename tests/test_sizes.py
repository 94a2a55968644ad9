"""Plans that must hold on longer tables than the others' tests have."""

import decimal
import math
import random
import threading
from collections import Counter

import pytest

from ticklattice import catalogue
from ticklattice.operators import flow, ngrams
from ticklattice.operators.ema import SCALES
from ticklattice.plans.dialect import spark_sql
from ticklattice.plans.folds import MAX_ORDER


def plain_perplexity(halves, longest):
    """By order, from texts: a missing token is left out of its text and equals no other."""
    grams = {True: [], False: []}
    for (_, training), tokens in halves.items():
        for at, token in enumerate(tokens):
            for k in range(1, min(at, longest) + 1):
                if tokens[at - k] is not None:
                    grams[training == 1].append((k, " ".join(str(t) for t in tokens[at - k : at] if t is not None), token))
    counts, totals = Counter(grams[True]), Counter(g[:2] for g in grams[True])
    bits = {}
    for k, context, token in grams[False]:
        c = 0 if token is None else counts[k, context, token]
        bits.setdefault(k, []).append(math.log2((c + 1) / (totals[k, context] + 126)))
    return {k: (len(b), round(2 ** -(sum(b) / len(b)), 6)) for k, b in bits.items()}


@pytest.mark.parametrize("odd", [False, True])
def test_contexts_without_texts(spark, monkeypatch, odd):
    monkeypatch.setattr(ngrams, "RUN", 64)
    monkeypatch.setattr(ngrams, "HELD", 300)
    monkeypatch.setattr(ngrams, "SENT", 200)
    rng = random.Random(7)
    choices = [4, 5, 10, 117] + ([None, 300, -2, 0] if odd else [])
    halves = {}
    for inst, n in ((1, 500), (2, 90), (3, 4)):
        tokens = [rng.choice(choices) if rng.random() < 0.4 else (4, 10, 80, 117, 3)[k % 5] for k in range(n)]
        halves[inst, 1], halves[inst, 0] = tokens[: n * 4 // 5], tokens[n * 4 // 5 :]
    rows = [(i, t, p + (0 if t else len(halves[i, 1])), token) for (i, t), tokens in halves.items() for p, token in enumerate(tokens)]
    frames = catalogue.Frames(spark, None, "{order_perplexity}")
    frames.made["halves"] = spark.createDataFrame(rows, "instrument_id bigint, training int, pos bigint, token int")
    got = {r["ord"]: (r["n"], round(r["perplexity"], 6)) for r in frames["order_perplexity"].collect()}
    assert got == plain_perplexity(halves, MAX_ORDER)
    assert ("contexts" in frames.made) == odd  # thirty texts a token only where a token is no byte


BACKWARD = ["direction_metrics", "direction_targets", "snapshot_recovery", "recovery_degraded", "quote_checks_gated"]


@pytest.mark.parametrize("name", BACKWARD)
def test_no_frame_is_walked_anew_for_each_row(spark, name):
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    assert "unboundedpreceding" in plan.replace(" ", "") and "unboundedfollowing" not in plan.replace(" ", "")


def test_frames_read_backward(spark):
    rows = [(i, k, None if (k * 7 + i) % 3 else k) for i in range(3) for k in range(20)]
    x = spark.createDataFrame(rows, "g int, k int, v int")
    sql = "select *, FIRSTV(v) over f as later, FIRSTV(v) over (partition by g order by k, v rows between current row and unbounded following) as now, min(v) over f as least from {x} window f as (partition by g order by k rows between 1 following and unbounded following)"
    for r in spark.sql(spark_sql(sql), x=x).collect():
        after = [v for g, k, v in rows if g == r["g"] and k > r["k"] and v is not None]
        assert (r["later"], r["now"], r["least"]) == ((after or [None])[0], r["k"] if r["v"] is not None else (after or [None])[0], min(after, default=None))


def plain_fates(messages):
    """By number of a message, in one pass: what is held goes with the next clear or end."""
    fates, held, loading = {}, [], False
    last_end = max((seq for seq, kind, _ in messages if kind == "end"), default=-1)
    for seq, kind, number in messages:
        if kind == "event":
            if loading:
                held.append((seq, number))
            fates[seq] = "buffered" if loading else "live"
            continue
        fates[seq] = kind
        if kind == "clear":
            fates |= {s: "dropped" for s, _ in held if s < last_end}
        elif kind == "end":
            fates |= {s: "replayed" if n > number else "discarded" for s, n in held}
        held, loading = held if kind == "level" else [], kind != "end"
    return fates


def test_fates_of_a_long_feed(spark):
    rng = random.Random(3)
    kinds = lambda n: rng.choices(["event", "clear", "level", "end"], [90, 2, 2, 3 if n < 59_000 else 0])[0]
    feeds = {1: [(n, kinds(n), n - rng.randrange(40)) for n in range(60_000)], 2: [(n, kinds(n), n) for n in range(50)]}
    frames = catalogue.Frames(spark, None, catalogue.PLANS["snapshot_recovery"])
    frames.made["messages"] = spark.createDataFrame([(i, *m) for i, feed in feeds.items() for m in feed], "instrument_id bigint, seq bigint, kind string, number bigint")
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)  # with frames walked anew for each row it is not done by then
    stop.start()
    try:
        got = frames.plan(catalogue.PLANS["snapshot_recovery"]).collect()
    finally:
        stop.cancel()
    assert len(got) == 60_050 and len({r["fate"] for r in got}) == 8
    assert {(r["instrument_id"], r["seq"]): r["fate"] for r in got} == {(i, seq): fate for i, feed in feeds.items() for seq, fate in plain_fates(feed).items()}


def exact_average(updates, half_life):
    with decimal.localcontext(prec=50):
        decay, x = decimal.Decimal(2) ** (decimal.Decimal(-1) / half_life), decimal.Decimal(0)
        for v in updates:
            x = x * decay + v
        return float(x)


def test_averages_of_long_series_neither_drift_nor_overflow(spark):
    n = 60_000  # with more than 51,200 updates of the fast average, 2 ** (n / 50) is no double
    book = spark.range(n).selectExpr("1L as instrument_id", "id as seq", "id as ts_ns", "'A' as action", "if(id % 2 = 0, 'B', 'A') as side", "1 + id * 7919 % 100 as size",
        f"int(id >= {n - 2}) as is_commit", "100L as bid", "200L as ask", "1 + id * 31 % 50 as bid_size", "1L as ask_size")
    got = flow.flow_states(book).orderBy("seq").collect()
    assert [r["seq"] for r in got] == [n - 2, n - 1]
    sizes = [1 + i * 7919 % 100 for i in range(n)]
    for scale, half_life in SCALES.items():
        want = {"event_intensity": [1] * n, "add_bid": sizes[::2], "add_ask": sizes[1::2], "trade_flow": []}
        assert {k: got[1][f"{k}_{scale}"] for k in want} == {k: exact_average(v, half_life) for k, v in want.items()}
