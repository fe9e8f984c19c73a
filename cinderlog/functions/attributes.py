"""Predicates and paths over VARIANT attribute columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, functions as F


def as_variant(col: Column, kind: str = "json") -> Column:
    """Attributes as VARIANT, parsed when the column holds JSON text."""
    return F.try_parse_json(col) if kind == "json" else col


def path_of(keys: Sequence[str]) -> str | None:
    """Variant path for object keys, or None if a key cannot be written as one."""
    parts = []
    for key in keys:
        if '"' in key and "'" in key:
            return None
        quote = "'" if '"' in key else '"'
        parts.append(f"[{quote}{key}{quote}]")
    return "$" + "".join(parts)


def attr(col: Column, keys: Sequence[str] | str, kind: str = "variant") -> Column:
    """Value below nested object keys, cast to ``kind``; null if absent or not castable."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    path = path_of(keys)
    if path is not None:
        return F.try_variant_get(col, path, kind)
    value = col
    for key in keys:
        value = F.try_variant_get(value, "$", "map<string,variant>")[F.lit(key)]
    return F.try_variant_get(value, "$", kind)


def attr_text(col: Column, keys: Sequence[str] | str) -> Column:
    """Text form of a value, as ``->>`` gives it: null for JSON null, JSON for containers."""
    return attr(col, keys, "string")


def has_key(col: Column, key: str) -> Column:
    """Top-level key test; a key holding JSON null exists."""
    return attr(col, key).isNotNull()


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _same_scalar(value: Column, wanted) -> Column:
    if wanted is None:
        return F.coalesce(F.is_variant_null(value), F.lit(False))
    if isinstance(wanted, bool):
        same = (_type(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    elif isinstance(wanted, str):
        # The equality alone comes first so that it can reach the scan.
        same = (F.try_variant_get(value, "$", "string") == F.lit(wanted)) & (_type(value) == "STRING")
    else:
        numeric = _type(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        if isinstance(wanted, int) and abs(wanted) < 10**37:
            equal = F.try_variant_get(value, "$", "decimal(38,0)") == F.lit(str(wanted)).cast("decimal(38,0)")
            equal = equal & (
                F.try_variant_get(value, "$", "double") == F.lit(float(wanted))
            )
        else:
            equal = F.try_variant_get(value, "$", "double") == F.lit(float(wanted))
        same = numeric & equal
    return F.coalesce(same, F.lit(False))


def _any_element(elements: Column, wanted) -> Column:
    return F.coalesce(F.exists(elements, lambda e: _contains(e, wanted, False)), F.lit(False))


def _contains(value: Column, wanted, top: bool) -> Column:
    if isinstance(wanted, dict):
        test = F.coalesce(_type(value).startswith("OBJECT<"), F.lit(False))
        for key, inner in wanted.items():
            test = test & _contains(attr(value, key), inner, False)
        return test
    elements = F.try_variant_get(value, "$", "array<variant>")
    if isinstance(wanted, list):
        test = F.coalesce(_type(value).startswith("ARRAY<"), F.lit(False))
        for inner in wanted:
            test = test & _any_element(elements, inner)
        return test
    same = _same_scalar(value, wanted)
    if top:
        same = same | _any_element(elements, wanted)
    return same


def _string_leaves(wanted, keys=()) -> Iterator[tuple[list[str], str]]:
    if isinstance(wanted, dict):
        for key, inner in wanted.items():
            yield from _string_leaves(inner, (*keys, key))
    elif isinstance(wanted, str) and keys:
        yield list(keys), wanted


def _words(wanted) -> Iterator[str]:
    """All keys and texts of a literal."""
    if isinstance(wanted, dict):
        for key, inner in wanted.items():
            yield key
            yield from _words(inner)
    elif isinstance(wanted, list):
        for inner in wanted:
            yield from _words(inner)
    elif isinstance(wanted, str):
        yield wanted


def contains(col: Column, wanted: dict | list | str | int | float | bool | None) -> Column:
    """JSON containment of a literal, compiled to column expressions.

    Objects match if every wanted key is there with a containing value; arrays
    ignore order and repeats; scalars match by type and value; a bare scalar is
    also found inside a top-level array. String leaves are repeated as plain
    path equalities in front, which the scan can apply to shredded columns.
    """
    test = _contains(col, wanted, True)
    for keys, text in _string_leaves(wanted):
        test = (attr_text(col, keys) == F.lit(text)) & test
    return test


def contains_text(col: Column, wanted: dict | list | str | int | float | bool | None) -> Column:
    """``contains`` for JSON text.

    Text without a backslash spells every key and value out, so rows in which
    one is missing are dropped before any parse.
    """
    spelled = [F.contains(col, F.lit(w)) for w in dict.fromkeys(_words(wanted)) if w]
    maybe = F.lit(True)
    for test in spelled:
        maybe = maybe & test
    return (F.contains(col, F.lit("\\")) | maybe) & contains(F.try_parse_json(col), wanted)
