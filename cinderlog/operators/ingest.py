"""Decode, check and accept event batches.

A payload is one row and stays one row until its events are known to be
accepted: violations and the verdict are computed inside the row, so ingest
needs no shuffle. The size guard bounds what such a row can hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cinderlog import fixed
from cinderlog.functions import severity
from cinderlog.functions.arrays import unnest
from cinderlog.functions.keys import utf8_text
from cinderlog.functions.times import parse_rfc3339
from cinderlog.operators import ranks
from cinderlog.operators.sanitize import sanitize_column
from cinderlog.schema import WIRE_BATCH_DDL, WIRE_MAPS, WIRE_STRINGS, WIRE_TIMES


def size_guard(payloads: DataFrame, max_bytes: int = fixed.MAX_PAYLOAD_BYTES) -> DataFrame:
    """Mark payloads above the byte limit and drop their text before any parse."""
    size = F.octet_length("payload")
    known = F.col("problem") if "problem" in payloads.columns else F.lit(None).cast("string")
    return payloads.select(
        "batch_id",
        size.alias("payload_bytes"),
        F.when(known.isNotNull(), known).when(size > max_bytes, F.lit(fixed.PROBLEM_TOO_LARGE)).alias("problem"),
        F.when(known.isNull() & (size <= max_bytes), F.col("payload")).alias("payload"),
    )


def _text(value: Column) -> Column:
    return F.coalesce(F.variant_get(value, "$", "string"), F.lit(""))


def _is_text(value: Column) -> Column:
    return value.isNull() | F.schema_of_variant(value).isin("STRING", "VOID")


def _is_time(value: Column) -> Column:
    text = F.variant_get(value, "$", "string")
    return _is_text(value) & (text.isNull() | parse_rfc3339(text).isNotNull())


def _well_typed(event: Column) -> Column:
    checks = [_is_text(event[c]) for c in WIRE_STRINGS] + [_is_time(event[c]) for c in WIRE_TIMES]
    return reduce(lambda a, b: a & b, checks)


def _typed(event: Column) -> Column:
    ts = parse_rfc3339(F.variant_get(event["timestamp"], "$", "string"))
    return F.struct(
        ts.cast("timestamp_ntz").alias("timestamp"),
        *[_text(event[c]).alias(c) for c in WIRE_STRINGS if c != "id"],
        *[event[c].alias(c) for c in WIRE_MAPS],
    )


def _beyond_double(text: Column) -> Column:
    """Whether a number of a JSON text exceeds 64-bit floats; only texts that may have one are cut up."""
    outside = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""')
    numbers = F.regexp_extract_all(outside, F.lit(r"-?[0-9][0-9.eE+-]*"), F.lit(0))
    huge = F.exists(numbers, lambda n: F.coalesce(F.abs(n.try_cast("double")) == float("inf"), F.lit(False)))
    return F.when(text.rlike(r"[0-9][eE]\+?[0-9]{3}|[0-9]{309}"), huge).otherwise(F.lit(False))


def decode(payloads: DataFrame, max_bytes: int = fixed.MAX_PAYLOAD_BYTES) -> DataFrame:
    """One row per batch with its ``events`` array, or the problem that stops it.

    A JSON error or a field of the wrong type anywhere rejects the whole batch.
    Unknown keys are ignored; a missing or null field reads as empty. Text after
    the JSON value is ignored. Field names match case-sensitively.
    """
    guarded = size_guard(payloads, max_bytes)
    # A top-level null is an empty request.
    raw = utf8_text(F.col("payload"))
    text = F.when(F.btrim(raw, F.lit(" \t\n\r")) == "null", F.lit("{}")).otherwise(raw)
    parsed = guarded.withColumns(
        {"_doc": F.from_json(text, WIRE_BATCH_DDL, {"mode": "PERMISSIVE"}), "_huge": _beyond_double(raw)}
    ).drop("payload")
    doc = F.col("_doc")
    events = F.coalesce(doc["events"], F.array())
    bad = F.col("_huge") | doc.isNull() | doc["_corrupt_record"].isNotNull() | ~F.forall(events, _well_typed)
    checked = parsed.withColumn(
        "problem", F.coalesce("problem", F.when(F.coalesce(bad, F.lit(True)), F.lit(fixed.PROBLEM_JSON)))
    )
    return checked.select(
        "batch_id",
        "payload_bytes",
        "problem",
        F.when(F.col("problem").isNull(), F.transform(events, _typed)).alias("events"),
    )


def decoded_events(decoded: DataFrame) -> DataFrame:
    """One row per event with its place in the batch."""
    return unnest(decoded, F.col("events"), "event_index", "e", ["batch_id"]).select("batch_id", "event_index", "e.*")


def _violation(when: Column, index: Column, field: str, message: str) -> Column:
    name = F.concat(F.lit("events["), index.cast("string"), F.lit(f"].{field}"))
    return F.when(when, F.struct(name.alias("field"), F.lit(message).alias("message")))


def _event_violations(event: Column, index: Column) -> Column:
    """Violations of one event, in field order; null slots where a field is fine."""
    no_time = event["timestamp"].isNull() | (event["timestamp"] == F.lit("0001-01-01").cast("timestamp_ntz"))
    keys = F.coalesce(F.size(F.array_distinct(F.map_keys(event["log_attributes"]))), F.lit(0))
    return F.array(
        _violation(no_time, index, "timestamp", fixed.MSG_TIMESTAMP),
        _violation(~severity.is_known(event["severity"]), index, "severity", fixed.MSG_SEVERITY),
        _violation(event["body"] == "", index, "body", fixed.MSG_EMPTY),
        _violation(F.octet_length(event["body"]) > fixed.MAX_BODY_BYTES, index, "body", fixed.MSG_BODY_LONG),
        _violation(event["service_name"] == "", index, "service_name", fixed.MSG_EMPTY),
        _violation(
            F.octet_length(event["service_name"]) > fixed.MAX_SERVICE_BYTES,
            index, "service_name", fixed.MSG_SERVICE_LONG,
        ),
        _violation(keys > fixed.MAX_ENTRY_ATTRIBUTES, index, "log_attributes", fixed.MSG_ATTR_COUNT),
    )


def check(decoded: DataFrame, max_events: int = fixed.MAX_BATCH_EVENTS) -> DataFrame:
    """Add every ``violation`` of a decoded batch and its final ``problem``."""
    n = F.size("events")
    empty = F.array(F.struct(F.lit("events").alias("field"), F.lit(fixed.MSG_NO_EVENTS).alias("message")))
    too_many = F.array(
        F.when(
            n > max_events,
            F.struct(
                F.lit("events").alias("field"),
                F.format_string(fixed.MSG_BATCH_SIZE, n, F.lit(max_events)).alias("message"),
            ),
        )
    )
    per_event = F.flatten(F.transform("events", _event_violations))
    found = F.when(n == 0, empty).otherwise(F.array_compact(F.concat(too_many, per_event)))
    checked = decoded.withColumn("violations", F.when(F.col("events").isNotNull(), found))
    return checked.withColumn(
        "problem",
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(
            F.size("violations") > 0, F.lit(fixed.PROBLEM_VALIDATION)
        ),
    )


def violations(checked: DataFrame) -> DataFrame:
    return unnest(checked, F.col("violations"), "violation_index", "v", ["batch_id"]).select(
        "batch_id", "violation_index", "v.field", "v.message"
    )


def verdicts(checked: DataFrame) -> DataFrame:
    """One row per batch: accepted or not, why not, and the counts."""
    return checked.select(
        "batch_id",
        F.col("problem").isNull().alias("accepted"),
        "problem",
        F.coalesce(F.size("events"), F.lit(0)).cast("bigint").alias("n_events"),
        F.coalesce(F.size("violations"), F.lit(0)).cast("bigint").alias("n_violations"),
    )


def acks(checked: DataFrame) -> DataFrame:
    """Receipt of each accepted batch; the id is derived, so a retry repeats it."""
    receipt = F.struct(
        F.md5(F.col("batch_id").cast("string")).alias("batch_id"),
        F.size("events").cast("bigint").alias("accepted"),
        F.lit(fixed.ESTIMATED_PROCESSING_MS).alias("estimated_processing_ms"),
    )
    kept = F.when(F.col("problem").isNull(), F.array(receipt))
    return unnest(checked, kept, "_i", "r", []).select("r.*")


def accepted_events(checked: DataFrame) -> DataFrame:
    """Events of accepted batches.

    The test sits inside the exploded array: as a filter it would be pushed
    below the projections and parse every payload a second time.
    """
    kept = F.when(F.col("problem").isNull(), F.col("events"))
    return unnest(checked, kept, "event_index", "e", ["batch_id"]).select("batch_id", "event_index", "e.*")


def sanitize_events(events: DataFrame) -> DataFrame:
    """Sanitise ``log_attributes`` to JSON text and keep the warnings per event."""
    return sanitize_column(events, "log_attributes").withColumn(
        "resource_attributes", F.to_json("resource_attributes")
    )


def null_normalize(events: DataFrame) -> DataFrame:
    """Empty optional text and empty attribute objects become NULL."""
    changes = {c: F.nullif(F.col(c), F.lit("")) for c in ("trace_id", "span_id", "severity_text", "schema_url")}
    for c in ("resource_attributes", "log_attributes"):
        text = F.col(c)
        changes[c] = F.when(F.json_object_keys(text).isNotNull() & (F.size(F.json_object_keys(text)) > 0), text)
    return events.withColumns({k: v for k, v in changes.items() if k in events.columns})


def assign_ids(events: DataFrame, base: int = 0, materialize: bool = True) -> DataFrame:
    """Dense ids above ``base``, rising in the order rows are written.

    Events of one batch lie together, so their ids rise with their place in it.
    """
    numbered = ranks.row_numbers(events, "_pos", materialize)
    return numbered.withColumn("id", (F.col("_pos") + F.lit(base + 1)).cast("bigint")).drop("_pos")


def stamp_received(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Write time, whatever the client sent."""
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    return events.withColumn("received_at", now)


def clean_events(checked: DataFrame) -> DataFrame:
    """Accepted events, sanitised and normalised."""
    return null_normalize(sanitize_events(accepted_events(checked)).drop("attr_warnings"))


def to_log_rows(
    checked: DataFrame, base: int = 0, now: Column | None = None, materialize: bool = True
) -> DataFrame:
    """Accepted events as log rows with ids and the write time."""
    rows = stamp_received(assign_ids(clean_events(checked), base, materialize), now)
    return rows.select(*fixed.LOG_COLUMNS)
