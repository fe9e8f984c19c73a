"""Searching the stored table through the index its loads were written with."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderlog import fixed
from cinderlog.functions import text
from cinderlog.operators import search, sinks, terms
from cinderlog.operators.search import LogQuery


def matching(spark: SparkSession, path: str, q: LogQuery, extra: str = "", config: str = "english") -> DataFrame:
    """All rows of the table at ``path`` that a query asks for.

    A keyword is answered from the postings: of loads that have them, only days with
    a hit are read, and no body is tested. Bodies of loads without an index of this
    configuration are tested one by one, so the result is whole either way. One row per day with
    a hit comes to the driver; a query spans at most ``q.max_range_days``.
    """
    logs = sinks.read_logs(spark, path, extra)
    if not q.keyword:
        return search.filtered(logs, q)
    indexed, others = sinks.split_by_index(spark, path, logs, config)
    hits = terms.posted_ids(sinks.read_terms(spark, path), q.keyword, config, q.start, q.end)
    days = [r["event_date"] for r in hits.select("event_date").distinct().collect()]
    near = search.filtered(indexed, replace(q, keyword=None)).where(F.col("event_date").isin(days))
    found = near.join(hits, ["event_date", "id"], "left_semi")
    tested = search.filtered(others, replace(q, keyword=None)).where(text.matches(F.col("body"), q.keyword, config))
    return found.unionByName(tested)


def page(spark: SparkSession, path: str, q: LogQuery, extra: str = "", config: str = "english") -> DataFrame:
    """One page of ``matching`` in (timestamp, id) order."""
    return matching(spark, path, q, extra, config).orderBy("timestamp", "id").limit(q.limit).select(*fixed.LOG_COLUMNS)
