"""Queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ticklattice import catalogue

SF = "/root/testdata/sf0.001"
SOME = ["lob_window", "stream_book", "recovery_gaps", "bbo_ring_match", "book_verify", "state_machine", "mbo_projection", "book_bbo_commits", "book_top10", "bbo_cause", "tokenize", "barrier_labels", "serial_trades", "lob_static", "flow_ofi", "cpcv_purge", "markov_order2", "direction_targets", "multi_geometry_labels", "cross_fold_report", "live_events", "exported_days", "markov_sweep", "snapshot_recovery", "latency_percentiles", "flow_averages", "token_windows", "cpcv_boundaries", "recon_windows", "packed_windows", "stream_recovery", "snapshot_compact", "quote_checks_gated"]


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    cur = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(norm(r[n]) for n in names) for r in df.collect()) == sorted(tuple(map(norm, r)) for r in cur.fetchall())


def test_entry_points():
    import __spark_entry__ as e

    assert {*catalogue.QUERIES} <= {*e.queries()} and {*e.oracle_sql()} <= {*e.queries()}
    assert Path(SF).exists()
