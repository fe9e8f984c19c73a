"""Opaque page cursors: URL-safe base64 without padding over a small JSON object."""

from __future__ import annotations

import base64
import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from cinderlog.fixed import ERR_CURSOR
from cinderlog.functions.keys import utf8_text
from cinderlog.functions.times import format_rfc3339, parse_rfc3339


@dataclass(frozen=True)
class Cursor:
    """Position after the row with this timestamp (UTC, zone-less) and id."""

    timestamp: dt.datetime
    id: int


def encode(cursor: Cursor) -> str:
    ts = cursor.timestamp.isoformat(timespec="microseconds")
    ts = ts.rstrip("0").rstrip(".")
    text = json.dumps({"ts": ts + "Z", "id": cursor.id}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode(token: str) -> Cursor:
    try:
        if not token.replace("-", "").replace("_", "").isalnum() or not token.isascii():
            raise ValueError("not base64url")
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
    except ValueError as e:
        raise ValueError(ERR_CURSOR) from e
    try:
        doc = json.loads(raw)
        ts = dt.datetime.fromisoformat(doc["ts"])
        if ts.tzinfo is None:
            raise ValueError("time zone missing")
        return Cursor(ts.astimezone(dt.timezone.utc).replace(tzinfo=None), int(doc["id"]))
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(ERR_CURSOR) from e


def encode_column(ts: Column, row_id: Column) -> Column:
    text = F.concat(
        F.lit('{"ts":"'), format_rfc3339(ts), F.lit('","id":'), row_id.cast("string"), F.lit("}")
    )
    # base64 breaks long lines; characters without a counterpart are deleted.
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\r\n", "-_")


def decode_column(token: Column) -> Column:
    """Struct of timestamp and id; null where the token is not a cursor."""
    padded = F.concat(F.translate(token, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(token), F.lit(4))))
    doc = F.from_json(utf8_text(F.try_to_binary(padded, F.lit("base64"))), "struct<ts: string, id: bigint>")
    ts = parse_rfc3339(doc["ts"])
    return F.when(
        ts.isNotNull() & doc["id"].isNotNull(),
        F.struct(ts.cast("timestamp_ntz").alias("timestamp"), doc["id"].alias("id")),
    )
