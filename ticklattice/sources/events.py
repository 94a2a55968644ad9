"""Event sources: the market-by-order schema and its projection from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The last-of-batch bit of flags.
F_LAST = 0x80
MBO_SCHEMA = "seq bigint, ts_ns bigint, instrument_id bigint, order_id bigint, action string, side string, price_fp bigint, size bigint, flags int"

PROJECTION = """
with p as (
  select event_id as seq, unix_micros(cast(ts as timestamp)) * 1000 as ts_ns, user_id % 50 as instrument_id, event_type, value,
         cast(get_json_object(props, '$.k') as int) as k from {events}),
q as (
  select *, case when event_type in ('view', 'click') then 'A' when event_type = 'error' then 'C' when event_type = 'signup' then 'M'
                 when k < 2 then 'R' when k % 5 = 0 then 'F' else 'T' end as action,
         case when k % 2 = 0 then 'B' else 'A' end as side from p)
select seq, ts_ns, instrument_id,
       case action when 'A' then seq when 'T' then 0
            else coalesce(last_value(case when action = 'A' then seq end) ignore nulls over (
              partition by instrument_id order by seq rows between unbounded preceding and 1 preceding), -1) end as order_id,
       action, side,
       100000000000 + (case when side = 'B' then -1 else 1 end) * 250000000 * (1 + cast(floor(value) as bigint) % 20) as price_fp,
       cast(1 + k as bigint) as size, case when seq % 3 <> 0 then 128 else 0 end as flags
from q
"""


def mbo_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as market-by-order events, one order of arrival (seq) over all instruments."""
    return spark.sql(PROJECTION, events=spark.read.parquet(f"{sf_dir}/events.parquet"))



def valid_levels(levels: str) -> str:
    """SQL for the defined levels of an array of (price, size) in their order; those behind an undefined one move up."""
    return f"filter({levels}, l -> l.price > 0 and l.price < 9223372036854775807 and l.size > 0)"


def _dated() -> Column:
    """The date in the stem of a file: YYYYMMDD or YYYY-MM-DD, with or without -events, or a folder date=YYYYMMDD."""
    stem = F.regexp_extract(F.input_file_name(), r"(\d{4}-?\d{2}-?\d{2})(?:-events)?(?:\.parquet$|/)", 1)
    return F.replace(stem, F.lit("-"), F.lit("")).try_cast("int")


def read_mbo(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame:
    """Day files of market-by-order events with the date of their stem; others are passed over. Broken files fail unless skip_corrupt."""
    rows = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).schema(MBO_SCHEMA).parquet(path)
    return rows.withColumn("date", _dated()).where("date between 19000101 and 20991231")


def write_days(rows: DataFrame, path: str) -> None:
    """One zstd Parquet partition for each date."""
    rows.repartition("date").write.mode("overwrite").partitionBy("date").option("compression", "zstd").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """What write_days wrote; a filter on the date prunes folders, others reach the files."""
    return spark.read.parquet(path).where("date between 19000101 and 20991231")


def day_counts(spark: SparkSession, path: str) -> DataFrame:
    """(date, n) of day files in order of date, counted from their footers."""
    return read_days(spark, path).groupBy("date").agg(F.count("*").alias("n")).orderBy("date")
