"""Rate limits and concurrency as windows over request times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minute_waits(requests: DataFrame, key: str, ts: str, rpm: int) -> DataFrame:
    """requests with `in_window` (earlier requests within the last 60 s, lower edge out) and `wait_ms` (0 where one more fits)."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(key).orderBy("_us").rangeBetween(-59_999_999, -1)
    rows = requests.withColumn("_us", us).withColumn("in_window", F.count("*").over(window)).withColumn("_old", F.min("_us").over(window))
    return rows.withColumn("wait_ms", F.when(F.col("in_window") < rpm, F.lit(0)).otherwise(60_000 - F.floor((F.col("_us") - F.col("_old")) / 1000)).cast("long")).drop("_us", "_old")


def daily(requests: DataFrame, key: str, ts: str, order: str, rpd: int) -> DataFrame:
    """requests with `today` (the how manieth of its UTC day) and `admitted`."""
    day = Window.partitionBy(key, F.to_date(F.col(ts).cast("timestamp"))).orderBy(ts, order)
    return requests.withColumn("today", F.row_number().over(day)).withColumn("admitted", F.col("today") <= rpd)


def most_at_once(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, most): the largest number of half-open intervals that overlap."""
    edges = intervals.select(key, F.col(start).alias("t"), F.lit(1).alias("d")).union(intervals.select(key, F.col(end).alias("t"), F.lit(-1).alias("d")))
    along = Window.partitionBy(key).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("n", F.sum("d").over(along)).groupBy(key).agg(F.max("n").alias("most"))


def burst_tokens(events: DataFrame, key: str, ts: str, text: str, order: str, millis: int = 100) -> DataFrame:
    """(key, slot, text): the texts of each slot of so many milliseconds, joined in order."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (millis * 1000)).cast("long")
    return events.groupBy(key, slot.alias("slot")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ts, order, text))), lambda s: s[text]), "").alias("text"))


def latest(events: DataFrame, key: str, ts: str, order: str, value: str) -> DataFrame:
    """(key, value): the last event of each key; what a reducer of an event stream keeps."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(ts, order)).alias(value))


def in_force(requests: DataFrame, limits: DataFrame, key: str, ts: str, values: list[str], width: str = "DAY") -> DataFrame:
    """requests with the values of the last of limits (key, ts, values) at or before their time; null before the first.

    Both are cut by day (or `width`), so no key is one task: a day knows its own limits and the last one before it, which comes from a
    window over the limits and the days alone. Of limits at one time the largest values hold. Extra columns of requests stay.
    """
    t = F.col(ts).cast("timestamp")
    day = lambda df: df.withColumn("_day", F.date_trunc(width, t))
    value = F.struct(*values)
    told = day(limits.where(F.col(ts).isNotNull()).select(key, ts, value.alias("_v"))).groupBy(key, "_day", ts).agg(F.max("_v").alias("_v"))
    asked = day(requests)
    ends = told.groupBy(key, "_day").agg(F.max_by("_v", ts).alias("_v"))
    days = asked.select(key, "_day").distinct().join(ends, [key, "_day"], "full")
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(key, "_day", F.last("_v", ignorenulls=True).over(before).alias("_before"))
    # what holds from each change to the next of its day, matched by position rather than by a range join
    name = "_request"
    rows = asked.withColumn(name, F.struct(*[F.col(c) for c in requests.columns])).select(key, "_day", F.col(ts).alias("_t"), F.lit(1).alias("_kind"), name, F.lit(None).cast(told.schema["_v"].dataType).alias("_v"))
    changes = told.select(key, "_day", F.col(ts).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema[name].dataType).alias(name), "_v")
    along = Window.partitionBy(key, "_day").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.unionByName(changes).withColumn("_now", F.last("_v", ignorenulls=True).over(along)).where("_kind = 1")
    on = (seen[key].eqNullSafe(carried[key])) & (seen["_day"].eqNullSafe(carried["_day"]))
    out = seen.join(carried, on, "left").withColumn("_now", F.coalesce("_now", "_before"))
    return out.select(*(F.col(f"{name}.{c}").alias(c) for c in requests.columns), *(F.col(f"_now.{v}").alias(v) for v in values))


def with_live_limits(requests: DataFrame, read_limits, key: str, ts: str, values: list[str], sink):
    """A streaming writer of requests with the limits in force: limits are read anew (read_limits(spark)) for each micro-batch, so a change is
    seen from the next one on; sink(rows, batch) writes, and has to be the same for a batch that comes again."""

    def each(batch: DataFrame, number: int) -> None:
        sink(in_force(batch, read_limits(batch.sparkSession), key, ts, values), number)

    return requests.writeStream.foreachBatch(each)


def utc_day(ts: Column) -> Column:
    """The UTC day of a time, in a session whose zone is UTC."""
    return F.to_date(ts.cast("timestamp"))


def next_utc_day(ts: Column) -> Column:
    """The day at whose start a daily count begins anew."""
    return F.date_add(utc_day(ts), 1)


def back_off(retry: Column, base: float = 2.0, most: float = 8.0) -> Column:
    """Seconds to wait before a retry."""
    return F.least(F.lit(most), F.pow(F.lit(base), retry))
