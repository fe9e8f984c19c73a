"""Attribute key cleaning and byte sizes as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cinderlog.fixed import MAX_ATTR_KEY_BYTES, SIZE_ENVELOPE, SIZE_PER_FIELD


def clean_key(key: Column) -> Column:
    """Letters, digits, underscore and dot, first a letter; one ``_`` per other byte.

    Reading the UTF-8 bytes as Latin-1 makes one character of each byte, so a
    character pattern works bytewise.
    """
    head = F.substring(F.encode(key, "UTF-8"), 1, MAX_ATTR_KEY_BYTES)
    body = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^A-Za-z0-9_.]", "_")
    first = F.regexp_replace(body, r"^[^A-Za-z]", "_")
    return F.when(F.length(key) == 0, F.lit("_")).otherwise(first)


def utf8_text(raw: Column) -> Column:
    """Text of bytes that should be UTF-8; what is not becomes U+FFFD and no error."""
    return F.make_valid_utf8(raw.cast("string"))


def estimate_size(message: Column, fields: Column) -> Column:
    """Rough serialised bytes of a producer event with its field array."""
    per_field = F.aggregate(
        fields,
        F.lit(0),
        lambda n, f: n
        + F.octet_length(f["key"])
        + F.lit(SIZE_PER_FIELD)
        + F.coalesce(F.octet_length(f["string_val"]), F.lit(0)),
    )
    return F.lit(SIZE_ENVELOPE) + F.octet_length(message) + F.coalesce(per_field, F.lit(0))
