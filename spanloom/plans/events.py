"""Batch forms of the streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.plans.registry import query
from spanloom.runtime import table
from spanloom.streaming import windows as W


@query("event_windowed_counts", "select strftime(time_bucket(interval '30 minutes', ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2")
def windowed_counts(spark, sf_dir):
    d = W.windowed_counts(table(spark, sf_dir, "events"))
    return d.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("event_cooccurrence", "select a.user_id, a.event_id as a_id, b.event_id as b_id from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval '10 minutes'")
def cooccurrence(spark, sf_dir):
    return W.cooccurrence(table(spark, sf_dir, "events"))
