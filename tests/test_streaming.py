"""The streamed book over several micro-batches, look-backs at equal times, and tree files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from ticklattice.operators.book import replay
from ticklattice.operators.lookback import lookback_features
from ticklattice.sources.events import MBO_SCHEMA
from ticklattice.sources.trees import load_trees, probability, signal, standardised
from ticklattice.streaming.book import COMMITS, stream_commits

ROWS = [
    (1, 10, 7, 1, "A", "B", 1000000000, 5, 0),
    (2, 20, 8, 2, "A", "A", 9000000000, 1, 128),
    (3, 30, 7, 3, "A", "A", 2000000000, 1, 128),
    (4, 40, 7, 1, "M", "B", 1250000000, 5, 128),
    (5, 50, 7, 0, "T", "B", 2000000000, 1, 128),
    (6, 50, 7, 1, "C", "B", 1250000000, 5, 128),
]


def test_stream_goes_on_from_its_state(spark, tmp_path):
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    rows = spark.createDataFrame(ROWS, MBO_SCHEMA)
    for lo, hi in ((1, 3), (4, 6)):
        rows.where(F.col("seq").between(lo, hi)).coalesce(1).write.mode("append").parquet(source)
        run = stream_commits(spark.readStream.schema(MBO_SCHEMA).parquet(source)).writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(sink)
        run.awaitTermination()
    names = [c.split(" ")[0] for c in COMMITS.split(", ")]
    want = replay(rows).where("is_commit = 1").select(*names).orderBy("seq").collect()
    assert spark.read.parquet(sink).select(*names).orderBy("seq").collect() == want and len(want) == 5


def test_lookback(spark):
    out = {r["seq"]: r for r in lookback_features(replay(spark.createDataFrame(ROWS, MBO_SCHEMA))).collect()}
    assert sorted(out) == [2, 3, 4, 5, 6]
    # the event of seq 6 has the time of seq 5, so it is in the look-back of either
    assert out[5]["cancel_rate_bid"] == 1 / 5 and out[5]["trade_aggression"] == 1.0 and out[5]["cancel_add_ratio"] == 0.5
    assert out[6]["cancel_rate_bid"] == 0 and out[6]["price_momentum_ticks"] == 1.0 and out[6]["flow_toxicity"] == 1.0
    assert out[2]["message_rate"] == 1.0 and out[3]["message_rate"] == 2 / 0.001
    assert lookback_features(replay(spark.createDataFrame([], MBO_SCHEMA))).count() == 0


def test_trees(spark, tmp_path):
    tree = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [0.5, 0, 0], "default_left": [0, 0, 0], "base_weights": [0, -1.0, 2.0]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"learner": {"gradient_booster": {"model": {"trees": [tree]}}, "learner_model_param": {"base_score": "5E-1", "num_feature": "1"}}}))
    model = load_trees(spark, str(path))
    df = spark.createDataFrame([(0, 0.4), (1, 0.5), (2, float("nan")), (3, None)], "i int, x double")
    p = [r[0] for r in df.orderBy("i").select(probability(model, [F.col("x")])).collect()]
    assert p == pytest.approx([1 / (1 + math.exp(1)), *[1 / (1 + math.exp(-2))] * 3])
    z = df.orderBy("i").select(*standardised([F.col("x")], [0.4], [0.0])).collect()
    assert [r[0] for r in z] == pytest.approx([0.0, 0.1, 0.0, 0.0])
    both = spark.createDataFrame([(0.4, 0.9), (0.5, 0.9), (0.5, 0.5)], "d double, l double").select(signal(F.col("d"), F.col("l"))).collect()
    assert [r[0] for r in both] == [0, 1, -1]
    for text in ('{"this": 1}', "nothing", '{"learner": {"gradient_booster": {"model": {"trees": []}}, "learner_model_param": {"base_score": "0.5"}}}'):
        path.write_text(text)
        with pytest.raises(ValueError):
            load_trees(spark, str(path))
