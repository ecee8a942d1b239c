"""Processing ledger: roll-ups, timings, recovery, cooldowns and cache status over an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockquery.functions.bands import ratio


def run_rollup(events: DataFrame) -> DataFrame:
    """Sums over a run's events; ratios are 0 on an empty denominator."""
    failed = F.col("status") == "failed"
    return events.groupBy("run_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(failed).alias("n_failed"),
        F.round(F.sum("duration_ms"), 4).alias("total_ms"),
        F.round(F.max("duration_ms"), 4).alias("max_ms"),
        F.round(ratio(F.count_if(failed), F.count("*")), 6).alias("failed_rate"),
        F.min("started_at").alias("first_at"),
        F.max("started_at").alias("last_at"),
    )


def step_timing_pivot(events: DataFrame, steps: list[str]) -> DataFrame:
    """One column a step: the duration of its last event in the run."""
    return events.groupBy("run_id").agg(*[last_of(s).alias(f"{s}_ms") for s in steps], F.count("*").alias("n_events"))


def last_of(step: str) -> F.Column:
    own = F.col("step_name") == step
    return F.round(F.max_by(F.when(own, F.col("duration_ms")), F.when(own, F.struct("started_at", "event_id"))), 4)


def slowest_step(events: DataFrame) -> DataFrame:
    """The longest event of a run, the first on ties."""
    best = F.min_by(F.struct("step_name", "duration_ms", "event_id"), F.struct(-F.col("duration_ms"), F.col("event_id")))
    return events.groupBy("run_id").agg(best.alias("b"), F.count_if(F.col("duration_ms") > 50).alias("n_slow")).select(
        "run_id", "b.step_name", F.round("b.duration_ms", 4).alias("duration_ms"), "b.event_id", "n_slow"
    )


def timeline(events: DataFrame) -> DataFrame:
    """Newest first within a run, the newest flagged."""
    order = Window.partitionBy("run_id").orderBy(F.desc("started_at"), F.desc("event_id"))
    return events.select("run_id", "event_id", "step_name", F.row_number().over(order).alias("place")).withColumn("latest", F.col("place") == 1)


def latest_run(events: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("event_id", "step_name", "status", "started_at"), F.struct("started_at", "event_id"))
    return events.groupBy("run_id").agg(best.alias("b"), F.count("*").alias("n_events")).select("run_id", "b.*", "n_events")


def recover_abandoned(events: DataFrame) -> DataFrame:
    """Runs whose last event is still ``started`` fail; running it again changes nothing."""
    last = latest_run(events)
    open_ = F.col("status") == "started"
    return last.select("run_id", F.when(open_, "failed").otherwise(F.col("status")).alias("status"), F.when(open_, "PROCESS_RESTART_ABORTED").alias("error_code"), open_.alias("recovered"))


def cooldown_gaps(events: DataFrame, seconds: int) -> DataFrame:
    """Events of a key that fall within the cooldown of the event before."""
    order = Window.partitionBy("run_id").orderBy("started_at", "event_id")
    at = F.unix_micros(F.col("started_at").cast("timestamp"))
    gap = at - F.lag(at).over(order)
    return events.select("run_id", "event_id", F.coalesce(gap, F.lit(-1)).alias("gap_us"), F.coalesce(gap < seconds * 1_000_000, F.lit(False)).alias("cooling"))


def cache_status(events: DataFrame) -> DataFrame:
    """hit, partial, miss or not_applicable over a run's calls."""
    s = F.col("cache_status")
    status = (
        F.when(F.count(s) == 0, "not_applicable")
        .when(F.bool_and(s == "hit"), "hit")
        .when(F.bool_or(s == "hit"), "partial")
        .when(F.bool_and(s == "miss"), "miss")
        .otherwise("not_applicable")
    )
    return events.groupBy("run_id").agg(status.alias("cache_status"), F.count_if(s == "hit").alias("n_hit"), F.count_if(s == "miss").alias("n_miss"))


def audit_latest(audit: DataFrame) -> DataFrame:
    """Current state out of an append-only audit: the last decision of each key, with the number before it."""
    last = F.max_by(F.struct("event_id", "status", "duration_ms"), F.struct("started_at", "event_id"))
    return audit.groupBy("run_id", "step_name").agg(last.alias("b"), (F.count("*") - 1).alias("n_before")).select(
        "run_id", "step_name", "b.event_id", "b.status", F.round("b.duration_ms", 4).alias("duration_ms"), "n_before"
    )


def error_classes(message: F.Column) -> F.Column:
    """Ordered substring classes of an error message."""
    low = F.lower(message)
    return (
        F.when(message.isNull(), "none")
        .when(low.rlike("rate.?limit|429"), "rate_limit")
        .when(low.rlike("timeout|timed out"), "timeout")
        .when(low.rlike("auth|401|403"), "auth")
        .when(low.rlike("abort|restart"), "aborted")
        .otherwise("other")
    )
