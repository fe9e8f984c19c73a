"""Spans: correlation with logs, trees and time per service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cinderlog.session import durable


def correlate(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every log row with the span it was written in, if that span is known.

    Rows without ids cannot match; they bypass the join, where they would all
    hash to one partition.
    """
    ids = ["trace_id", "span_id"]
    has_ids = F.col("trace_id").isNotNull() & F.col("span_id").isNotNull()
    extra = [c for c in spans.columns if c not in ids]
    renamed = spans.select(*ids, *[F.col(c).alias(f"span_{c}") for c in extra])
    joined = logs.where(has_ids).join(renamed, ids, "left")
    alone = logs.where(~has_ids).withColumns(
        {f"span_{f.name}": F.lit(None).cast(f.dataType) for f in spans.schema if f.name in extra}
    )
    return joined.unionByName(alone)


def trace_tree(spans: DataFrame) -> DataFrame:
    """Depth and root of every span.

    Each round doubles the distance a span has looked up, so a tree of depth d
    takes log2(d) joins. Spans that reached their root leave the open set. A
    span below a missing parent, or in a loop, gets no root and no depth. A span that
    was delivered several times is looked up once, with its smallest parent, and
    all its rows get the answer; rows without ids get none.
    """
    once = spans.where("trace_id is not null and span_id is not null").groupBy("trace_id", "span_id").agg(
        F.min(F.coalesce("parent_span_id", F.lit(""))).alias("parent_span_id")
    )
    root = F.coalesce(F.col("parent_span_id"), F.lit("")) == ""
    state = durable(
        once.select(
            "trace_id",
            "span_id",
            F.when(root, F.col("span_id")).otherwise(F.col("parent_span_id")).alias("up"),
            F.when(root, 0).otherwise(1).cast("bigint").alias("dist"),
            F.when(root, F.lit("rooted")).otherwise(F.lit("open")).alias("status"),
        )
    )
    is_open = F.col("status") == "open"
    remaining = state.where(is_open).count()
    while remaining:
        above = state.select(
            "trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"),
            F.col("dist").alias("dist2"), F.col("status").alias("status2"),
        )
        moved = (
            state.where(is_open)
            .join(above, ["trace_id", "up"], "left")
            .select(
                "trace_id",
                "span_id",
                F.coalesce("up2", "up").alias("up"),
                (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
                F.coalesce("status2", F.lit("orphan")).alias("status"),
            )
        )
        state = durable(state.where(~is_open).unionByName(moved))
        left = state.where(is_open).count()
        if left == remaining:
            break  # nothing but loops is left
        remaining = left
    rooted = F.col("status") == "rooted"
    found = state.select(
        "trace_id", "span_id", F.when(rooted, F.col("up")).alias("root_span_id"), F.when(rooted, F.col("dist")).alias("depth")
    )
    return spans.join(found, ["trace_id", "span_id"], "left")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def trace_breakdown(spans: DataFrame) -> DataFrame:
    """Per trace and service: spans and summed time, next to the trace's totals.

    The window runs over one row per service of a trace, not over spans.
    """
    per_service = spans.groupBy("trace_id", "service_name").agg(
        F.count(F.lit(1)).alias("spans"),
        F.sum(_micros("end_time") - _micros("start_time")).alias("service_us"),
        F.count_if(F.col("status") == "ERROR").alias("error_spans"),
        F.min(_micros("start_time")).alias("_start"),
        F.max(_micros("end_time")).alias("_end"),
    )
    trace = Window.partitionBy("trace_id")
    return per_service.select(
        "trace_id",
        "service_name",
        "spans",
        "error_spans",
        "service_us",
        (F.max("_end").over(trace) - F.min("_start").over(trace)).alias("trace_us"),
        F.sum("spans").over(trace).alias("trace_spans"),
    )
