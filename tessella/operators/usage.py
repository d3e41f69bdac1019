"""Usage analytics (ANA): conditional aggregates and windows over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _round(c: Column) -> Column:
    return F.round(c, 6)


def query_analytics(log: DataFrame, by: str) -> DataFrame:
    """ANA1: total, successful, rate (0 on none) and mean time."""
    ok = F.count_if(F.col("status") == "completed")
    return log.groupBy(by).agg(F.count("*").alias("total"), ok.alias("successful"), _round(100.0 * ok / F.greatest(F.count("*"), F.lit(1))).alias("success_rate"), _round(F.avg("processing_time")).alias("avg_time"))


def running_average(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """ANA4: the average of each key up to and with each row.

    Rows are summed per day first, and a row adds its own day's rows to the days before: no window holds more than a key's day.
    """
    rows = log.withColumn("_day", F.to_date("ts"))
    days = rows.groupBy(key, "_day").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(key, "_day", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    today = Window.partitionBy(key, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(days, [key, "_day"]).withColumn("running_avg", _round((F.col("_s0") + F.sum(value).over(today)) / (F.col("_n0") + F.count(value).over(today)))).drop("_day", "_s0", "_n0")


def api_usage_stats(usage: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """ANA5: per key totals, successes, failures, today's, mean time, last use and success %."""
    recent = usage.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    total, ok = F.count("*"), F.count_if((F.col("status_code") >= 200) & (F.col("status_code") < 300))
    return recent.groupBy("api_key_id").agg(
        total.alias("total"), ok.alias("successful"), F.count_if(F.col("status_code") >= 400).alias("failed"), F.count_if(F.to_date("ts") == F.to_date(as_of)).alias("today"),
        _round(F.avg("response_time_ms")).alias("avg_ms"), F.max("ts").alias("last_used"), _round(100.0 * ok / F.greatest(total, F.lit(1))).alias("success_rate"),
    )


def top_endpoints(usage: DataFrame, k: int = 10) -> DataFrame:
    """ANA6"""
    return usage.groupBy("endpoint", "method").agg(F.count("*").alias("requests"), _round(F.avg("response_time_ms")).alias("avg_ms")).orderBy(F.desc("requests"), "endpoint", "method").limit(k)


def rate_limit_check(usage: DataFrame, per_minute: int | None = 60, per_hour: int | None = 1000, per_day: int | None = 10000) -> DataFrame:
    """ANA7: earlier requests in the minute, hour and day before each one (lower edge included), and whether a limit is reached.

    A window holds two days of a key and no more: each request stands in its own day and, to be counted only, in the next.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    day = F.floor(micros / 86_400_000_000)
    at = Window.partitionBy("api_key_id", "_day").orderBy(micros)
    out, blocked = usage.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_day", F.when(F.col("_own"), day).otherwise(day + 1)), F.lit(False)
    for name, seconds, limit in (("minute", 60, per_minute), ("hour", 3600, per_hour), ("day", 86400, per_day)):
        out = out.withColumn(f"last_{name}", F.count("*").over(at.rangeBetween(-seconds * 1_000_000, -1)))
        if limit is not None:
            blocked = blocked | (F.col(f"last_{name}") >= limit)
    return out.withColumn("blocked", blocked).where("_own").drop("_own", "_day")


def key_usage_rollup(usage: DataFrame) -> DataFrame:
    """ANA8"""
    return usage.groupBy("api_key_id").agg(F.count("*").alias("usage_count"), F.max("ts").alias("last_used"), F.max_by("endpoint", F.struct("ts", "event_id")).alias("last_endpoint"))


def metric_summary(points: DataFrame, since: Column) -> DataFrame:
    """ANA9: count, extremes, mean, latest value and first and last time of each metric."""
    return points.where(F.col("ts") >= since).groupBy("metric").agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), _round(F.avg("value")).alias("avg"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def metric_retention(points: DataFrame, as_of: Column, newest: int = 1000, seconds: int = 3600) -> DataFrame:
    """ANA10: the newest points of each metric that are not too old."""
    order = Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("event_id"))
    young = points.where(F.col("ts") >= as_of - F.make_dt_interval(secs=F.lit(seconds)))
    return young.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= newest).drop("_n")


def newest_points(points: DataFrame, keep: int = 1_000, retention_days: float = 7) -> DataFrame:
    """ANA5: (metric, n, min, max, avg, latest, first_at, latest_at) of each metric's newest ``keep`` points, of those not older than ``retention_days`` before its newest.

    Only what is young enough goes into the window, which stops at ``keep`` rows of a metric; equal times are taken by value.
    """
    fine = points.where("metric is not null and value is not null and ts is not null")
    rows = fine.select("metric", F.col("value").cast("double").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    young = rows.join(F.broadcast(rows.groupBy("metric").agg(F.max("at").alias("_newest"))), "metric").where(F.col("at") > F.col("_newest") - int(retention_days * 86_400_000_000))
    order = Window.partitionBy("metric").orderBy(F.desc("at"), F.desc("value"))
    held = young.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep)
    last = F.struct("at", "value")
    return held.groupBy("metric").agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.max(last)["value"].alias("latest"), F.min("at").alias("first_at"), F.max("at").alias("latest_at"),
    )


def health_summary(log: DataFrame) -> DataFrame:
    """ANA11: success rate and status; a rate below 95 is degraded before unhealthy is ever asked, as in the service it mirrors."""
    rate = 100.0 * F.count_if(F.col("status") == "completed") / F.greatest(F.count("*"), F.lit(1))
    return log.groupBy("collection").agg(F.count("*").alias("requests"), _round(rate).alias("success_rate")).withColumn("state", F.when(F.col("success_rate") < 95, "degraded").when(F.col("success_rate") < 80, "unhealthy").otherwise("healthy"))


def benchmark_stats(runs: DataFrame) -> DataFrame:
    """ANA13: per strategy the durations' mean, extremes and sample deviation (0 for one run), quality and chunks."""
    return runs.groupBy("strategy").agg(
        F.count("*").alias("runs"), _round(F.avg("duration")).alias("avg_duration"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"),
        _round(F.coalesce(F.stddev_samp("duration"), F.lit(0.0))).alias("std_duration"), _round(F.avg("quality")).alias("avg_quality"), _round(F.avg("chunk_count")).alias("avg_chunks"),
    )


def benchmark_comparison(stats: DataFrame) -> DataFrame:
    """ANA14: each strategy's gain over the slowest, whether it is the best, and whether it varies much."""
    # one row a strategy, so the one window holds few rows
    every = Window.partitionBy(F.lit(1))
    ends = stats.withColumn("best", F.min_by("strategy", F.struct("avg_duration", "strategy")).over(every)).withColumn("worst", F.max("avg_duration").over(every))
    return ends.select("strategy", (F.col("strategy") == F.col("best")).alias("best"), _round(100 * (F.col("worst") - F.col("avg_duration")) / F.col("worst")).alias("gain"), (F.col("std_duration") > 0.5 * F.col("avg_duration")).alias("varies"))


def cache_hit_report(log: DataFrame, key: str, ttl: int) -> DataFrame:
    """ANA15: a request is a hit when its key's last miss is at most ``ttl`` seconds old.

    Requests come by key and time and are read in a stream: a task holds a batch and one key's last miss, not the key's requests.
    From a miss on, the next one is found by a search among the sorted times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, miss = None, None
        for batch in batches:
            keys, times = batch.column(0), batch.column(1).to_numpy()
            new = np.ones(len(times), bool)
            if len(times) > 1:
                new[1:] = ~pc.fill_null(pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)), False).to_numpy(zero_copy_only=False)
            edges, misses = [*np.flatnonzero(new).tolist(), len(times)], 0
            for a, b in zip(edges[:-1], edges[1:]):
                own = keys[a].as_py()
                if own != last:
                    last, miss = own, None
                at = a
                while True:
                    at = at if miss is None else a + int(np.searchsorted(times[a:b], miss + ttl * 1_000_000, "right"))
                    if at >= b:
                        break
                    miss, misses = int(times[at]), misses + 1
            yield pa.RecordBatch.from_pydict({"n": [len(times)], "hits": [len(times) - misses]})

    rows = log.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    totals = rows.repartition("_key").sortWithinPartitions("_key", "_at").mapInArrow(run, "n long, hits long")
    return totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")).withColumn("hit_rate", _round(100.0 * F.col("hits") / F.nullif(F.col("requests"), F.lit(0))))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """ANA17: ratings' count and mean, positive from 4, negative up to 2."""
    return feedback.agg(F.count("rating").alias("n"), _round(F.avg("rating")).alias("mean"), F.count_if(F.col("rating") >= 4).alias("positive"), F.count_if(F.col("rating") <= 2).alias("negative"))


def activity_rollup(events: DataFrame) -> DataFrame:
    """ANA21: activity by type and outcome."""
    return events.groupBy("query_type", "status").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def metric_periods(points: DataFrame, period: str) -> DataFrame:
    """ANA22: extremes, mean and samples of each metric in each period."""
    return points.groupBy("metric", F.window("ts", period).alias("w")).agg(F.min("value").alias("min"), F.max("value").alias("max"), _round(F.avg("value")).alias("avg"), F.count("*").alias("samples")).select("metric", F.col("w.start").alias("period"), "min", "max", "avg", "samples")


def metric_history(points: DataFrame, metric: str, since: Column) -> DataFrame:
    """ANA12: the points of one metric from a time on, oldest first."""
    return points.where((F.col("metric") == metric) & (F.col("ts") >= since)).orderBy("ts", "event_id")


def performance_flags(log: DataFrame, slow: float = 5.0, memory: float = 100.0) -> DataFrame:
    """ANA20: entries of each service and level, and how many are errors, slower than ``slow`` seconds or above ``memory`` MB; nulls are neither."""
    return log.groupBy("service", "level").agg(
        F.count("*").alias("n"), F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"), F.count_if(F.col("seconds") > slow).alias("slow"), F.count_if(F.col("memory_mb") > memory).alias("heavy"),
    )


def active_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    """ANA25: sessions that are active and not expired, the latest used first."""
    return sessions.where(F.col("is_active") & (F.col("expires_at") > as_of)).orderBy(F.desc("last_used"), "session_id")


def stage_durations(records: DataFrame) -> DataFrame:
    """ANA26: finished records of each status and their mean and longest seconds; records without both times don't count."""
    took = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    return records.withColumn("_s", took).where("_s is not null").groupBy("status").agg(F.count("*").alias("n"), _round(F.avg("_s")).alias("avg_seconds"), F.max("_s").alias("max_seconds"))
