"""Serial trading: one position at a time in each group, taken greedily in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def serial_trades(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The candidates that are taken: each at or after the exit of the one taken before it.

    candidates: keys, order, ts_ns and exit_ts among their columns. A group
    is streamed in order; only the time from which the next may start is held.
    """
    schema = candidates.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, free = None, None
        for pdf in batches:
            keep = []
            for k, ts, leave in zip(zip(*(pdf[c] for c in keys)), pdf.ts_ns.tolist(), pdf.exit_ts.tolist()):
                if k != group:
                    group, free = k, None
                take = free is None or ts >= free
                if take:
                    free = leave
                keep.append(take)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    return candidates.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
