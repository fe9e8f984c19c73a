"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive byte runs of their text until a group has one
member or its texts have ended. Texts are compared by their bytes alone; no
digest decides equality. Every round is one aggregation over (group, run), whose
partial counts are combined before the shuffle, and one join whose hot groups
adaptive execution splits. A group is never gathered. Only texts that still
share all their bytes with another one are carried to the next round, and runs
grow by ``GROWTH`` each round, so rounds grow with the logarithm of the longest
text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.common import BLANK, id_and_text, settle

HEAD = 64
GROWTH = 8


def exact_groups(docs: DataFrame, head: int = HEAD, growth: int = GROWTH, carry: bool = False) -> DataFrame:
    """One row per input row with its group of equal texts.

    ``docs`` has doc_id and text; other columns are ignored, or kept in
    ``whole`` with ``carry``.
    Texts are equal when identical after all of ``[\\x20\\x09-\\x0D]`` is
    deleted. Of a group the row with the most code points, then the smallest
    doc_id, is kept.

    Returns doc_id, keep_id, group_size, kept, text_sha256. NULL and empty texts
    (and those of white space only) form one group. Rows that repeat an id are
    separate members, and exactly one row of a group is kept; a NULL id comes
    after all others. An empty table gives an empty result.
    """
    body = F.regexp_replace("text", BLANK + "+", "").cast("binary")
    docs = id_and_text(docs, carry)
    bare = docs.select(*["whole"] * carry, "doc_id", F.char_length("text").alias("n_chars"), body.alias("rest")).withColumn(
        "head", F.substring("rest", 1, head)
    )
    heads = bare.groupBy("head").agg(F.count("*").alias("n"))
    first = bare.join(heads, "head").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars",
        F.sha2("rest", 256).alias("text_sha256"), F.lit(0).cast("long").alias("group"),
        (F.col("n") > 1).alias("open"), F.when(F.col("n") > 1, F.col("rest")).alias("rest"), *["whole"] * carry,
    )
    start = state = settle(first, "radix")
    closed = state.where(~F.col("open")).select("row", "doc_id", "n_chars", "text_sha256", F.col("row").alias("group"))
    width = head * growth
    open_rows = state.where("open")
    while not open_rows.isEmpty():
        state = settle(_split(open_rows, width), "radix")
        closed = closed.unionByName(state.where(~F.col("open")).select(closed.columns))
        open_rows = state.where("open")
        width *= growth
    chosen = _choose(closed)
    if carry:
        chosen = chosen.join(start.select("row", "whole"), "row")
    return chosen.drop("row")


def _split(rows: DataFrame, width: int) -> DataFrame:
    """One round: split each group by the next ``width`` bytes."""
    run = rows.withColumn("run", F.substring("rest", 1, width))
    groups = run.groupBy("group", "run").agg(F.count("*").alias("n"), F.min("row").alias("next"))
    goes_on = (F.col("n") > 1) & (F.octet_length("run") == width)
    return run.join(groups, ["group", "run"]).select(
        "row", "doc_id", "n_chars", "text_sha256", F.col("next").alias("group"), goes_on.alias("open"),
        F.when(goes_on, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
    )


def _choose(rows: DataFrame) -> DataFrame:
    rank = F.struct("n_chars", -F.col("doc_id"), -F.col("row"))
    best = rows.groupBy("group").agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))
    return rows.join(best, "group").select(
        "row", "doc_id", (-F.col("best")["col2"]).alias("keep_id"), "group_size",
        (F.col("row") == -F.col("best")["col3"]).alias("kept"), "text_sha256",
    )
