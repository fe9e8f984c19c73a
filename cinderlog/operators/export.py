"""Pack producer events into batches and write them in wire form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cinderlog import fixed
from cinderlog.functions.times import format_rfc3339
from cinderlog.operators import ranks
from cinderlog.session import durable

_FAN = 256  # chunks composed by one task


def _next_starts(ts: np.ndarray, size: np.ndarray, max_events: int, max_bytes: int, interval_us: int) -> np.ndarray:
    """For a batch starting at each row, the row where the following batch starts."""
    at = np.arange(len(ts))
    ends = np.cumsum(size)
    by_bytes = np.searchsorted(ends, ends - size + max_bytes, "left") + 1
    by_time = np.maximum(np.searchsorted(ts, ts + interval_us, "left"), at + 1)
    return np.minimum(np.minimum(at + max_events, by_bytes), np.minimum(by_time, len(ts)))


def pack_batches(
    events: DataFrame,
    producer: str,
    order: list[str],
    size: str,
    max_events: int = fixed.PACK_MAX_EVENTS,
    max_bytes: int = fixed.PACK_MAX_BYTES,
    interval_seconds: float = fixed.PACK_INTERVAL_SECONDS,
    chunk_rows: int = 50_000,
    slices: int | None = None,
) -> DataFrame:
    """Add ``batch_no`` per producer: a batch closes at ``max_events`` events, at
    ``max_bytes`` estimated bytes, or when the interval has passed since its first event.

    ``order[0]`` is the event time. Where a batch ends depends only on where it
    starts and on fewer than ``max_events`` rows behind, so a producer of any
    size is cut into chunks: each chunk tabulates, for every possible start
    among its first rows, where the first batch of the next chunk starts. These
    small tables compose to the true start of every chunk, and all chunks are
    then packed at once.
    """
    if chunk_rows < max_events:
        raise ValueError("chunk_rows must not be below max_events")
    interval_us = int(interval_seconds * 1_000_000)
    if interval_us <= 0 or max_events < 1:
        raise ValueError("the interval and the batch size must be positive")
    columns = events.columns
    placed = ranks.positions(events, [producer], order, "_pos", slices).withColumns(
        {
            "_chunk": F.expr(f"_pos div {chunk_rows}"),
            "_us": F.unix_micros(F.col(order[0]).cast("timestamp")),
            "_size": F.col(size).cast("bigint"),
        }
    )
    # Each chunk also sees the first rows of the next one.
    halo = (F.col("_chunk") > 0) & (F.col("_pos") - F.col("_chunk") * chunk_rows < max_events)
    seen = placed.select(
        producer, "_pos", "_us", "_size",
        F.explode(
            F.when(halo, F.array(F.col("_chunk"), F.col("_chunk") - 1)).otherwise(F.array("_chunk"))
        ).alias("_chunk"),
    )

    def tabulate(key, table):
        table = table.sort_by("_pos")
        own = int(np.searchsorted(table["_pos"].to_numpy(), (key[1].as_py() + 1) * chunk_rows))
        after = _next_starts(
            table["_us"].to_numpy(), table["_size"].to_numpy(), max_events, max_bytes, interval_us
        )[:own]
        count = np.ones(own, dtype=np.int64)
        while (inside := after < own).any():
            step = after[inside]
            count[inside], after[inside] = count[inside] + count[step], after[step]
        return pa.table(
            {
                "producer": pa.array([key[0].as_py()], pa.string()),
                "chunk": pa.array([key[1].as_py()], pa.int64()),
                "exits": pa.array([(after - own)[:max_events]], pa.list_(pa.int64())),
                "counts": pa.array([count[:max_events]], pa.list_(pa.int64())),
            }
        )

    tables = durable(
        seen.groupBy(producer, "_chunk").applyInArrow(
            tabulate, "producer string, chunk bigint, exits array<bigint>, counts array<bigint>"
        )
    )
    starts = _chunk_starts(tables, max_events)

    def number(key, table):
        table = table.sort_by("_pos")
        entry, done = table["_entry"][0].as_py(), table["_done"][0].as_py()
        after = _next_starts(
            table["_us"].to_numpy(), table["_size"].to_numpy(), max_events, max_bytes, interval_us
        )
        opened = np.zeros(len(table), dtype=np.int64)
        while entry < len(opened):
            opened[entry] = 1
            entry = int(after[entry])
        batch_no = pa.array(done - 1 + np.cumsum(opened), pa.int64())
        return table.select(columns).append_column("batch_no", batch_no)

    joined = placed.join(
        starts.withColumnRenamed("producer", producer).withColumnRenamed("chunk", "_chunk"), [producer, "_chunk"]
    )
    schema = T.StructType([*events.schema.fields, T.StructField("batch_no", T.LongType())])
    return joined.select(*placed.columns, "_entry", "_done").groupBy(producer, "_chunk").applyInArrow(number, schema)


def _chunk_starts(tables: DataFrame, max_events: int) -> DataFrame:
    """First batch start of every chunk and the batches opened before it.

    Tables compose associatively, so they are combined in a tree: no task holds
    more than ``_FAN`` of them however many chunks a producer has.
    """
    if tables.agg(F.max("chunk")).first()[0] in (None, 0):
        return tables.select("producer", "chunk", F.lit(0).cast("bigint").alias("_entry"), F.lit(0).cast("bigint").alias("_done"))
    parent = F.expr(f"chunk div {_FAN}")
    families = tables.groupBy("producer", parent.alias("parent")).agg(
        F.sort_array(F.collect_list(F.struct("chunk", "exits", "counts"))).alias("kids")
    )

    def through(state, kid):
        return F.struct(
            F.get(kid["exits"], state["entry"].cast("int")).alias("entry"),
            (state["n"] + F.coalesce(F.get(kid["counts"], state["entry"].cast("int")), F.lit(0))).alias("n"),
        )

    first = F.transform(
        F.sequence(F.lit(0), F.lit(max_events - 1)),
        lambda k: F.struct(k.cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("n")),
    )
    composed = families.select(
        "producer",
        F.col("parent").alias("chunk"),
        F.aggregate("kids", first, lambda acc, kid: F.transform(acc, lambda s: through(s, kid))).alias("f"),
    ).select("producer", "chunk", F.col("f.entry").alias("exits"), F.col("f.n").alias("counts"))
    above = _chunk_starts(durable(composed), max_events)

    # Walk each family from its own start, keeping the state before every kid.
    state = "struct<entry: bigint, n: bigint>"
    start = F.struct(
        F.struct(F.col("_entry").alias("entry"), F.col("_done").alias("n")).cast(state).alias("now"),
        F.array().cast("array<struct<chunk: bigint, entry: bigint, n: bigint>>").alias("seen"),
    )
    walked = F.aggregate(
        "kids",
        start,
        lambda acc, kid: F.struct(
            through(acc["now"], kid).cast(state).alias("now"),
            F.concat(
                acc["seen"],
                F.array(
                    F.struct(
                        kid["chunk"].alias("chunk"), acc["now"]["entry"].alias("entry"), acc["now"]["n"].alias("n")
                    )
                ),
            ).alias("seen"),
        ),
    )
    joined = families.join(above.withColumnRenamed("chunk", "parent"), ["producer", "parent"])
    return joined.select("producer", F.explode(walked["seen"]).alias("k")).select(
        "producer", F.col("k.chunk").alias("chunk"), F.col("k.entry").alias("_entry"), F.col("k.n").alias("_done")
    )


def field_value(f: Column) -> Column:
    """A typed field as VARIANT; durations become milliseconds, bad JSON stays text."""
    kind = f["type"]
    return (
        F.when(kind.isin("string", "error"), f["string_val"].cast("variant"))
        .when(kind == "int64", f["int64_val"].cast("variant"))
        .when(kind == "float64", f["float64_val"].cast("variant"))
        .when(kind == "bool", f["bool_val"].cast("variant"))
        .when(kind == "duration", (f["int64_val"] / F.lit(1e6)).cast("variant"))
        .when(
            kind.isin("any", "object", "string_slice", "map"),
            F.coalesce(F.try_parse_json(f["json_val"]), f["json_val"].cast("variant")),
        )
        .otherwise(f["string_val"].cast("variant"))
    )


def wire_event(
    timestamp: Column, severity: Column, message: Column, fields: Column, resource: dict[str, Column]
) -> Column:
    """JSON text of one event.

    ``resource`` maps the five resource keys to their values. trace_id and
    span_id fields move to the top level; of fields with one key the last wins.
    """
    lifted = ("trace_id", "span_id")

    def lift(name):
        hits = F.filter(fields, lambda f: f["key"] == name)
        return F.try_element_at(F.transform(hits, field_value), F.lit(-1)).alias(name)

    def last_of_each_key(bound):
        is_last = lambda f, i: F.array_position(bound["back"], f["key"]) == F.size(bound["fields"]) - i
        return F.filter(bound["fields"], lambda f, i: ~f["key"].isin(*lifted) & is_last(f, i))

    def as_map(kept):
        return F.map_from_entries(F.transform(kept, lambda f: F.struct(f["key"], field_value(f))))

    # One-element arrays bind intermediate results, which are then computed once.
    back = F.reverse(F.transform(fields, lambda f: f["key"]))
    kept = F.transform(F.array(F.struct(fields.alias("fields"), back.alias("back"))), last_of_each_key)
    attributes = F.transform(F.filter(kept, lambda k: F.size(k) > 0), as_map)
    return F.to_json(
        F.struct(
            format_rfc3339(timestamp).alias("timestamp"),
            resource[fixed.RESOURCE_KEYS[0]].alias("service_name"),
            severity.alias("severity"),
            message.alias("body"),
            *map(lift, lifted),
            F.struct(*[resource[k].alias(k) for k in fixed.RESOURCE_KEYS]).alias("resource_attributes"),
            F.get(attributes, F.lit(0)).alias("log_attributes"),
        )
    )


def wire_batches(packed: DataFrame, producer: str, order: list[str], event: str = "event") -> DataFrame:
    """One payload per batch; a batch is bounded by the packing limits."""
    grouped = packed.groupBy(producer, "batch_no").agg(
        F.sort_array(F.collect_list(F.struct(*order, event))).alias("_events")
    )
    joined = F.concat_ws(",", F.transform("_events", lambda e: e[event]))
    return grouped.select(
        producer,
        "batch_no",
        F.size("_events").cast("bigint").alias("n_events"),
        F.concat(F.lit('{"events":['), joined, F.lit("]}")).alias("payload"),
    )
