"""Purge and embargo against a plain scan, and tree training by folds."""

import random

from ticklattice import catalogue
from ticklattice.operators import training
from ticklattice.plans.folds import EMBARGO_ROWS, PURGE_ROWS, T_POINTS, _T_CRITICAL


def test_purge_and_embargo_by_row_offsets(spark):
    rng = random.Random(5)
    sizes = [rng.choice((120, 700, 4630)) for _ in range(60)]
    days, at = [], 0
    for k, n in enumerate(sizes):
        days.append((k, k, n, at, at + n, k // 10))
        at += n
    frames = catalogue.Frames(spark, None, "{roles} {blocks}")
    frames.made["days"] = spark.createDataFrame(days, "day bigint, day_no int, n bigint, row_start bigint, row_end bigint, grp int")
    blocks = {}
    for r in frames["blocks"].collect():
        blocks.setdefault(r["split"], []).append((r["block_start"], r["block_end"]))
    got = {(r["split"], r["day"]): r["role"] for r in frames["roles"].collect()}
    pairs = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    assert len(got) == 15 * 60 and [len(blocks[k]) for k in range(15)] == [1 if b == a + 1 else 2 for a, b in pairs]
    for split, (a, b) in enumerate(pairs):
        assert sorted(blocks[split])[0][0] == days[a * 10][3] and sorted(blocks[split])[-1][1] == days[b * 10 + 9][4]
        for day, _, _, start, end, grp in days:
            near = any(end > max(0, s - PURGE_ROWS) and start < s or start < e + EMBARGO_ROWS and end > e for s, e in blocks[split])
            assert got[split, day] == ("test" if grp in (a, b) else "excluded" if near else "train")
    assert {"train", "test", "excluded"} == {*got.values()}


def test_points_of_the_t_distribution(spark):
    rows = spark.createDataFrame([(k,) for k in (1, 5, 6, 14, 30, 44, 99, 100, 500)], "df int").selectExpr("df", f"{_T_CRITICAL} as t")
    got = {r["df"]: round(r["t"], 6) for r in rows.collect()}
    assert got == {1: 12.706, 5: 2.571, 6: 2.771, 14: 2.202, 30: 2.042, 44: 2.015, 99: 1.985, 100: 1.984, 500: 1.96} and len(T_POINTS) == 12


def test_trees_by_folds(spark):
    rng = random.Random(6)
    rows = []
    for k in range(600):
        x, y = rng.random(), rng.random()
        rows.append((k % 20, k, int(x > 0.5), x, None if k % 50 == 0 else y))
    df = spark.createDataFrame(rows, "day bigint, seq bigint, label int, x double, y double")
    roles = spark.createDataFrame([(s, d, d, "test" if d // 5 == s else "train") for s in (0, 1) for d in range(20)], "split int, day bigint, day_no int, role string")
    got = training.fold_predictions(df, roles, ["x", "y"], [0, 1], rounds=5).collect()
    assert len(got) == 300 and {r["split"] for r in got} == {0, 1}
    assert sum((r["p"] > 0.5) == (r["label"] == 1) for r in got) >= 290
    alone = training.fold_predictions(df.where("label = 1"), roles, ["x", "y"], [0], rounds=5)
    assert {r["p"] for r in alone.collect()} == {None}
