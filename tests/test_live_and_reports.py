"""Barriers, the live feed, token files, exports and reports on hand-made rows."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklattice.operators import barriers, live
from ticklattice.sources import events, reports, tokens

TICKS = "instrument_id bigint, seq bigint, ts_ns bigint, price2 bigint, direction int, entry2 bigint, ofi_fast double"


def labels(spark, rows, geometries, horizon):
    got = barriers.barrier_labels(spark.createDataFrame(rows, TICKS), geometries, horizon, 10).collect()
    return {(r["seq"], r["target_ticks"], r["stop_ticks"]): (r["outcome"], r["exit_ts"], round(r["pnl_ticks"], 6)) for r in got}


def test_barriers_against_a_plain_scan(spark):
    rng = random.Random(3)
    rows, ts = [], {1: 0, 2: 0}
    for seq in range(400):
        inst = rng.choice((1, 2))
        ts[inst] += rng.choice((0, 1, 5))
        price2 = 2000 + rng.randint(-60, 60)
        enters = rng.random() < 0.4
        rows.append((inst, seq, ts[inst], price2, rng.choice((1, -1)) if enters else None, price2 + rng.randint(-5, 5), 0.5))
    geometries = barriers.parse_geometries("2:1, 1:2,3:3")
    want = {}
    for inst, seq, at, _, direction, entry2, _ in rows:
        ticks = [r for r in rows if r[0] == inst]
        for t, s in geometries if direction else ():
            hit = None
            for r in ticks:
                if r[2] <= at or r[1] <= seq:
                    continue
                move = (r[3] - entry2) * direction
                if r[2] > at + 40:
                    hit = -1, r
                elif move >= 20 * t:
                    hit = 1, r
                elif move <= -20 * s:
                    hit = 0, r
                if hit:
                    break
            outcome, r = hit or (-1, ticks[-1])
            want[seq, t, s] = outcome, r[2], round((r[3] - entry2) * direction / 20, 6)
    assert labels(spark, rows, geometries, 40) == want and {v[0] for v in want.values()} == {-1, 0, 1}
    assert labels(spark, [], geometries, 40) == {}
    for bad in ("", "3", "0:1", "a:b", "1:2,"):
        with pytest.raises(ValueError):
            barriers.parse_geometries(bad)


def test_depth_messages_to_events(spark):
    rows = [(7, 160, [1, 2, 3], [1, 2, 9], [1, 2, 5], [100.25, 99.999999999, -0.5], [5, 6, 7], ["b", "a", "b"], [10, 10, 10], [3, 4, 5]), (7, 150, [4], [1], [2], [1.0], [2], ["z"], [11], [0]), (7, 75, [5], [1], [1], [1.0], [1], ["q"], [1], [1])]
    ddl = "instrument_id bigint, template_id int, seq array<bigint>, update_type array<int>, transaction_type array<int>, depth_price array<double>, depth_size array<bigint>, exchange_order_id array<string>, ssboe array<bigint>, usecs array<bigint>"
    got = {r["seq"]: r for r in live.events_of(spark.createDataFrame(rows, ddl)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert [got[k]["action"] for k in (1, 2, 3, 4)] == ["A", "M", "A", "T"]
    assert [got[k]["side"] for k in (1, 2, 3, 4)] == ["B", "A", "B", "A"]
    assert [got[k]["flags"] for k in (1, 2, 3, 4)] == [0, 0, 128, 128]
    assert got[1]["price_fp"] == 100250000000 and got[3]["price_fp"] == -500000000 and got[1]["ts_ns"] == 10000003000 and got[4]["order_key"] is None


def test_token_files(spark, tmp_path):
    rows = [(1, k, t) for k, t in enumerate([1, 4, 10, 64, 118, 3, 9, 3, 2])] + [(2, 0, 1), (2, 1, 2)]
    df = spark.createDataFrame(rows, "instrument_id bigint, pos bigint, token int")
    for r in tokens.packed(df).collect():
        (tmp_path / f"{r['instrument_id']}.bin").write_bytes(bytes(r["content"]))
    back = tokens.read_tokens(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [r["token"] for r in back] == [t for _, _, t in rows]
    lines = {(r["instrument_id"], r["line"]): r["text"] for r in tokens.text_lines(df, F.col("token").cast("string")).collect()}
    assert lines == {(1, 0): "1", (1, 1): "4 10 64 118 3", (1, 2): "9 3", (1, 3): "2", (2, 0): "1", (2, 1): "2"}
    assert {json.loads(r["json"])["commits"] for r in tokens.metadata(df).collect()} == {2, 0}
    assert df.where("token = 118").select(F.expr(tokens.decode("size"))).first()[0] == 1
    for name, raw in (("odd.bin", b"abc"), ("big.bin", np.array([126], dtype="<u2").tobytes())):
        (tmp_path / "x").mkdir(exist_ok=True)
        (tmp_path / "x" / name).write_bytes(raw)
        with pytest.raises(Exception, match="odd number|holds an id"):
            tokens.read_tokens(spark, str(tmp_path / "x" / name)).collect()


def test_day_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    row = spark.createDataFrame([(1, 2, 3, 4, "A", "B", 5, 6, 128)], events.MBO_SCHEMA)
    for stem in ("20220103", "2022-01-04-events", "notes"):
        row.toPandas().to_parquet(raw / f"{stem}.parquet")
    assert sorted(r["date"] for r in events.read_mbo(spark, str(raw)).collect()) == [20220103, 20220104]
    events.write_days(row.withColumn("date", F.lit(20220105)).union(row.withColumn("date", F.lit(20220103))), str(tmp_path / "days"))
    assert [tuple(r) for r in events.day_counts(spark, str(tmp_path / "days")).collect()] == [(20220103, 1), (20220105, 1)]
    assert reports.day_path("/raw/", "2022-01-03") == "/raw/glbx-mdp3-20220103.mbo.dbn.zst"
    (raw / "20220106.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        events.read_mbo(spark, str(raw)).collect()
    assert events.read_mbo(spark, str(raw), skip_corrupt=True).count() == 2


def test_partial_reports_captures_and_logs(spark, tmp_path):
    folds = spark.createDataFrame([(0, 1.5), (1, -0.5), (2, 0.25)], "split int, expectancy double")
    reports.write_partial(folds.where("split < 2"), str(tmp_path / "a" / "b"))
    reports.write_partial(folds.where("split > 0"), str(tmp_path / "a" / "c"))
    got = reports.read_partials(spark, str(tmp_path / "a"), "split int, expectancy double").orderBy("split")
    assert got.collect() == folds.collect()
    assert reports.markdown(got, "Folds").splitlines()[2:5] == ["| split | expectancy |", "| --- | --- |", "| 0 | 1.5 |"]
    assert reports.curve([(1, 2.0), (2, 1.0)], 4) == "  1 #### 2.0000\n  2 ## 1.0000\n"
    raw = spark.createDataFrame([(k, k, bytes([k, 255])) for k in range(25)], "template_id int, receive_ns bigint, raw binary")
    reports.write_capture(raw, str(tmp_path / "capture"), rows=4)
    assert len(list((tmp_path / "capture").glob("*.json.gz"))) >= 7
    assert reports.read_capture(spark, str(tmp_path / "capture")).orderBy("template_id").collect() == raw.collect()
    line = reports.health_lines(spark.createDataFrame([(1, "gap", 7)], "ts_ms bigint, event string, missing int")).first()[0]
    assert json.loads(line) == {"ts_ms": 1, "event": "gap", "missing": 7}
