"""Stateless event labelling on a stream: the same column expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.plans.market import session_class


def labelled(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the session class and date; works on batch and streaming frames."""
    return events.withColumns({"session": session_class(F.col(ts)), "filing_date": F.to_date(ts)})


def session_counts(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events by day and session class, with a watermark for late ones."""
    timed = labelled(events, ts).withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", "1 day"), "session").count()
