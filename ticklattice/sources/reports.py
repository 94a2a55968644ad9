"""Reports and logs: partial results of folds as JSON, tables as text, captured messages, health events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTIAL = "fold-results-partial.json"


def day_path(folder: str, date: str) -> str:
    """Where a day's raw file lies."""
    return f"{folder.rstrip('/')}/glbx-mdp3-{date.replace('-', '')}.mbo.dbn.zst"


def write_partial(folds: DataFrame, path: str) -> None:
    folds.write.mode("overwrite").option("compression", "none").json(f"{path}/{PARTIAL}")


def read_partials(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The folds of all partial results under path, however deep; a fold that stands in several counts once."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return rows.dropDuplicates(["split"])


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a table; for reports of aggregates, not for data."""
    head = rows.columns
    body = rows.limit(most).collect()
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in head) + " |" for r in body]) + "\n"


def curve(values: list[tuple[int, float]], width: int = 40) -> str:
    """One line of text for each value, its length in proportion."""
    top = max((v for _, v in values), default=1.0) or 1.0
    return "".join(f"{k:>3} {'#' * max(1, round(width * v / top))} {v:.4f}\n" for k, v in values)


def write_capture(messages: DataFrame, path: str, rows: int = 10000) -> None:
    """Raw messages (template_id, receive_ns, raw) as gzipped JSON lines of at most so many rows a file."""
    out = messages.select("template_id", "receive_ns", F.base64("raw").alias("payload"))
    out.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", rows).json(path)


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("template_id int, receive_ns bigint, payload string").json(path)
    return rows.select("template_id", "receive_ns", F.unbase64("payload").alias("raw"))


def health_lines(events: DataFrame) -> DataFrame:
    """(value): one JSON object for each row of events (ts_ms, event, and fields of any kind)."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))
