"""Row types shared by the operators."""

from __future__ import annotations

# Table layout. Attributes are VARIANT at rest: the writer shreds them, so a
# predicate on one attribute reads only that attribute's column.
LOG_DDL = (
    "id bigint, trace_id string, span_id string, timestamp timestamp_ntz, received_at timestamp_ntz, "
    "service_name string, severity string, severity_text string, body string, "
    "resource_attributes variant, log_attributes variant, schema_url string"
)

# Wire form. Scalars are decoded as VARIANT so that a number where a string
# belongs can be told from a string.
_WIRE_SCALARS = [
    "id", "trace_id", "span_id", "timestamp", "received_at", "service_name", "severity",
    "severity_text", "body", "schema_url",
]
WIRE_STRINGS = [c for c in _WIRE_SCALARS if c not in ("timestamp", "received_at")]
WIRE_TIMES = ["timestamp", "received_at"]
WIRE_MAPS = ["resource_attributes", "log_attributes"]
WIRE_EVENT_DDL = "struct<{}>".format(
    ", ".join([f"{c}: variant" for c in _WIRE_SCALARS] + [f"{c}: map<string, variant>" for c in WIRE_MAPS])
)
WIRE_BATCH_DDL = f"struct<events: array<{WIRE_EVENT_DDL}>, _corrupt_record: string>"
