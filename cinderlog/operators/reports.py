"""Operational reports over the log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cinderlog.fixed import SLO_ERROR_RATE, SLO_P95_MS
from cinderlog.functions.times import ntz
from cinderlog.operators import ranks


def received_since(as_of: Column, minutes: int) -> Column:
    """Rows received within the last minutes; a bare column bound for the scan."""
    return F.col("received_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def lag_micros() -> Column:
    return _micros(F.col("received_at")) - _micros(F.col("timestamp"))


def ingest_freshness(logs: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """How many rows came in lately, the newest, and how long ago that was."""
    recent = logs.where(received_since(as_of, minutes))
    return recent.agg(F.count(F.lit(1)).alias("recent"), F.max("received_at").alias("newest")).select(
        "recent", "newest", ((_micros(as_of) - _micros(F.col("newest"))) / 1e6).alias("lag_seconds")
    )


def minute_gaps(logs: DataFrame, start, end) -> DataFrame:
    """Events per minute between two times, zero minutes included.

    Counts are formed first, so the join carries at most one row per minute.
    """
    first, last = F.date_trunc("minute", ntz(start)), F.date_trunc("minute", ntz(end))
    minute = F.date_trunc("minute", "timestamp").cast("timestamp_ntz")
    inside = (F.col("timestamp") >= first.cast("timestamp_ntz")) & (
        F.col("timestamp") < last.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1))
    )
    if "event_date" in logs.columns:
        inside &= (F.col("event_date") >= F.to_date(first)) & (F.col("event_date") <= F.to_date(last))
    counts = logs.where(inside).groupBy(minute.alias("minute")).agg(F.count("id").alias("n"))
    spine = logs.sparkSession.range(1).select(
        F.explode(
            F.sequence(first.cast("timestamp_ntz"), last.cast("timestamp_ntz"), F.expr("interval 1 minute"))
        ).alias("minute")
    )
    return spine.join(counts, "minute", "left").select(
        "minute", F.coalesce("n", F.lit(0)).cast("bigint").alias("event_count")
    )


def schema_violations(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count_if(F.col("service_name").isNull() | F.col("body").isNull()).alias("violations")
    )


def write_throughput(logs: DataFrame, as_of: Column | None = None, minutes: int = 5) -> DataFrame:
    """Rows received per second, of the last minutes or of the whole table."""
    rows = logs if as_of is None else logs.where(received_since(as_of, minutes))
    second = F.date_trunc("second", "received_at").cast("timestamp_ntz")
    return rows.groupBy(second.alias("second")).agg(F.count(F.lit(1)).alias("events_per_second"))


def partition_stats(logs: DataFrame, latest: int = 14, day: str = "event_date") -> DataFrame:
    """Rows and content bytes of the latest days."""
    size = F.octet_length("body") + F.coalesce(F.octet_length("log_attributes"), F.lit(0))
    per_day = logs.groupBy(F.col(day).alias("event_date")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(size).cast("bigint").alias("content_bytes")
    )
    return per_day.orderBy(F.desc("event_date")).limit(latest)


def partition_coverage(logs: DataFrame, first: str, last: str, day: str = "event_date") -> DataFrame:
    """Days of a range without any data."""
    days = logs.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias(
            "event_date"
        )
    )
    present = logs.select(F.col(day).alias("event_date")).distinct()
    return days.join(present, "event_date", "left_anti").withColumnRenamed("event_date", "missing_date")


def ingest_lag(logs: DataFrame, slices: int | None = None) -> DataFrame:
    """Delay between event and write per service: mean, largest and p95 in seconds."""
    lags = logs.select("service_name", lag_micros().alias("lag_us"))
    totals = {
        "rows": (F.count(F.lit(1)), "sum"),
        "total_us": (F.sum("lag_us"), "sum"),
        "max_us": (F.max("lag_us"), "max"),
    }
    found = ranks.values_at_ranks(
        lags, ["service_name"], "lag_us", {"p95_us": ranks.nearest_rank(95)}, totals, slices
    )
    return found.select(
        "service_name",
        "rows",
        (F.col("total_us") / F.col("rows") / 1e6).alias("avg_lag_seconds"),
        (F.col("max_us") / 1e6).alias("max_lag_seconds"),
        (F.col("p95_us") / 1e6).alias("p95_lag_seconds"),
    )


def latency_summary(requests: DataFrame, by: str = "service_name", slices: int | None = None) -> DataFrame:
    """Requests, errors, rate per second and p95 latency of completed requests.

    Input columns: the group column, timestamp, status, duration_ms.
    """
    totals = {
        "requests": (F.count(F.lit(1)), "sum"),
        "errors": (F.count_if(F.col("status") >= 500), "sum"),
        "_begin": (F.min(_micros(F.col("timestamp"))), "min"),
        "_end": (F.max(_micros(F.col("timestamp"))), "max"),
    }
    found = ranks.values_at_ranks(
        requests, [by], "duration_ms", {"p95_ms": ranks.nearest_rank(95)}, totals, slices
    )
    seconds = (F.col("_end") - F.col("_begin")) / 1e6
    return found.select(
        by,
        "requests",
        "errors",
        (F.col("errors") / F.col("requests")).alias("error_rate"),
        F.when(seconds > 0, F.col("requests") / seconds).alias("rate"),
        "p95_ms",
    )


def slo_check(
    summary: DataFrame, p95_ms: dict[str, int] = SLO_P95_MS, max_error_rate: float = SLO_ERROR_RATE
) -> DataFrame:
    """Compare each measured row with the objective of every metric; bounds are strict."""
    goals = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(b).alias("bound")) for m, b in p95_ms.items()])
    rows = summary.withColumn("goal", F.explode(goals))
    fast = F.col("p95_ms") < F.col("goal.bound")
    healthy = F.col("error_rate") < max_error_rate
    return rows.select(
        "service_name", F.col("goal.metric").alias("metric"), fast.alias("p95_ok"), healthy.alias("errors_ok"),
        (fast & healthy).alias("passed"),
    )


def throughput_windows(logs: DataFrame, seconds: int = 10, ts: str = "timestamp") -> DataFrame:
    """Events and rate of each tumbling window that has events."""
    start = F.window(F.col(ts), f"{int(seconds)} seconds")["start"]
    return logs.groupBy(start.cast("timestamp_ntz").alias("window_start")).agg(
        F.count(F.lit(1)).alias("events")
    ).withColumn("rate", F.col("events") / F.lit(float(seconds)))


def throughput_summary(windows: DataFrame, seconds: int = 10) -> DataFrame:
    """Peak and mean rate over all windows of the run, empty ones included."""
    span = (F.max(_micros(F.col("window_start"))) - F.min(_micros(F.col("window_start")))) / 1e6
    total = windows.agg(
        F.sum("events").alias("events"),
        (span / seconds + 1).cast("bigint").alias("windows"),
        F.max("rate").alias("peak_rate"),
    )
    return total.withColumn("mean_rate", F.col("events") / (F.col("windows") * F.lit(float(seconds))))
