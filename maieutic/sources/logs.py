"""Event logs: lines of `time | LEVEL | event | JSON`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = r"(?s)^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) \| (\w+) \| (\w+) \| (.*)$"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The events of log files."""
    return parse_lines(spark.read.text(path).select(F.lit(None).cast("long").alias("line_no"), F.col("value").alias("line")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """line_no, ts, level, event, payload for each line of that form; payload is null unless it is a JSON object. Other lines are left out."""
    part = lambda i: F.regexp_extract("line", LINE, i)
    rows = lines.where(F.rlike("line", F.lit(LINE))).select("line_no", F.try_to_timestamp(F.replace(part(1), F.lit(","), F.lit(".")), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), part(2).alias("level"), part(3).alias("event"), part(4).alias("raw"))
    valid = F.get_json_object("raw", "$").isNotNull() & F.startswith(F.ltrim("raw"), F.lit("{"))
    return rows.select("line_no", "ts", "level", "event", F.when(valid, F.col("raw")).alias("payload"))


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event once, under the first of its line numbers: logs repeat lines."""
    return events.groupBy("ts", "level", "event", "payload").agg(F.min("line_no").alias("line_no"))


def event_counts(events: DataFrame) -> DataFrame:
    """event, level, n, unreadable, first_ts, last_ts."""
    return events.groupBy("event", "level").agg(F.count("*").alias("n"), F.count_if(F.col("payload").isNull()).alias("unreadable"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def gaps(events: DataFrame, bucket: str = "day") -> DataFrame:
    """event, n, mean_gap_s, max_gap_s: seconds from one event to the next of its kind.

    Windows run over the events of one part of the time (bucket) and, from the last event of
    a part to the first of the next part that has any, over one row an event and part.
    """
    rows = events.where("ts is not null").select("event", "line_no", F.date_trunc(bucket, "ts").alias("part"), F.unix_micros("ts").alias("at"))
    inside = Window.partitionBy("event", "part").orderBy("at", "line_no")
    between = Window.partitionBy("event").orderBy("part")
    edges = rows.groupBy("event", "part").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    each = rows.select("event", (F.col("at") - F.lag("at").over(inside)).alias("gap")).unionByName(edges.select("event", (F.col("first") - F.lag("last").over(between)).alias("gap")))
    g = each.withColumn("gap", F.col("gap") / 1e6)
    return g.groupBy("event").agg(F.count("gap").alias("n"), F.round(F.avg("gap"), 6).alias("mean_gap_s"), F.max("gap").alias("max_gap_s"))
