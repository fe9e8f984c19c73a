"""Attribute sanitising.

Most objects are well named at every level: native expressions, unrolled over the
levels of the VARIANT objects, recognise that and leave them as they are. Only the
others cross to Python, where a small recursive helper rewrites them batch by
batch. A native rewriting by the same unrolled walk was written and measured: its
plan is so large and its lambdas so slow that it took twice the time.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cinderlog import fixed
from cinderlog.functions.arrays import unnest

WARNINGS = T.ArrayType(T.StructType().add("kind", "string").add("path", "string"))
RESULT = T.StructType().add("attributes", "string").add("warnings", WARNINGS)

_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_INNER = _LETTERS | frozenset(b"0123456789_.")
_TO_INNER = bytes(b if b in _INNER else 0x5F for b in range(256))


def _clean_key(key: str) -> tuple[str, tuple[str, ...]]:
    """The clean name and the kinds of its corrections."""
    raw = key.encode("utf-8", "replace")
    cut = ("key-truncated",) if len(raw) > fixed.MAX_ATTR_KEY_BYTES else ()
    raw = raw[: fixed.MAX_ATTR_KEY_BYTES]
    if not raw:
        return "_", ("key-empty",)
    clean = raw.translate(_TO_INNER)
    if clean[0] not in _LETTERS:
        clean = b"_" + clean[1:]
    return clean.decode("ascii"), cut if clean == raw else (*cut, "key-rewritten")


# Keys come again in most objects; over-long ones aren't remembered.
_known_key = lru_cache(maxsize=1 << 16)(_clean_key)


def _cut_text(text: str) -> str:
    """First bytes of an oversized text; every byte of a cut character becomes U+FFFD."""
    head = text.encode("utf-8", "replace")[: fixed.MAX_ATTR_VALUE_BYTES]
    kept = head.decode("utf-8", "ignore")
    return kept + "�" * (len(head) - len(kept.encode("utf-8")))


def sanitize_object(raw: dict) -> tuple[dict, list[tuple[str, str]]]:
    """Sanitised copy of an attribute object and one warning per correction.

    Keys are visited in byte order and a later value wins a name clash.
    """
    root: dict = {}
    warnings: list[tuple[str, str]] = []
    used = 0

    def warn(kind, path):
        warnings.append((kind, path))

    def admit(target, name, path, value):
        nonlocal used
        if used >= fixed.MAX_ATTR_KEYS:
            warn("key-limit", path)
            return False
        used += 1
        # A character has four bytes at most.
        long = isinstance(value, str) and 4 * len(value) > fixed.MAX_ATTR_VALUE_BYTES
        if long and len(value.encode("utf-8", "replace")) > fixed.MAX_ATTR_VALUE_BYTES:
            warn("value-truncated", path)
            value = _cut_text(value)
        target[name] = value
        return True

    def visit(source, target, prefix, depth):
        """``target`` None means below the depth limit: leaves go to the root."""
        for key in sorted(source):
            value = source[key]
            name, kinds = (_known_key if len(key) <= fixed.MAX_ATTR_KEY_BYTES else _clean_key)(key)
            for kind in kinds:
                warn(kind, key)
            path = f"{prefix}.{name}" if prefix else name
            if not prefix and name.startswith(tuple(fixed.RESERVED_PREFIXES)):
                warn("reserved", path)
            elif not isinstance(value, dict):
                admit(root if target is None else target, path if target is None else name, path, value)
            elif target is None:
                visit(value, None, path, depth + 1)
            elif depth >= fixed.MAX_ATTR_DEPTH:
                warn("flattened", path)
                visit(value, None, path, depth + 1)
            else:
                nested: dict = {}
                if admit(target, name, path, nested):
                    visit(value, nested, path, depth + 1)

    visit(raw, root, "", 1)
    return root, warnings


@F.arrow_udf(RESULT)
def _sanitize_text(texts: pa.Array) -> pa.Array:
    out, kinds, paths, ends = [], [], [], [0]
    for text in texts.to_pylist():
        if text is None:
            out.append(None)
        else:
            clean, warnings = sanitize_object(json.loads(text))
            out.append(json.dumps(clean, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            for kind, path in warnings:
                kinds.append(kind)
                paths.append(path)
        ends.append(len(kinds))
    each = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(paths, pa.string())], ["kind", "path"])
    warned = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), warned], ["attributes", "warnings"])


# SQL text: building the unrolled check from Column objects takes the driver much longer.
OBJECT = "map<string,variant>"
# A first underscore is what any other sign would become.
_NAME = f"^[A-Za-z_][A-Za-z0-9_.]{{0,{fixed.MAX_ATTR_KEY_BYTES - 1}}}$"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _named(value: str, var: str, body: str) -> str:
    """``body`` with ``var`` bound to ``value``, which is so computed once."""
    return f"transform(array({value}), {var} -> {body})[0]"


def _object(value: str) -> str:
    """The fields of a VARIANT object, NULL for any other value."""
    return f"try_variant_get({value}, '$', '{OBJECT}')"


def _reserved(name: str) -> str:
    return "(" + " OR ".join(f"startswith({name}, '{p}')" for p in fixed.RESERVED_PREFIXES) + ")"


def _fits(text: str) -> str:
    """Whether a leaf's JSON text is surely no oversized string; its quotes don't count."""
    return f"(octet_length({text}) - IF(startswith({text}, '\"'), 2, 0) <= {fixed.MAX_ATTR_VALUE_BYTES})"


def _clean_level(fields: str, text: str, depth: int) -> str:
    k, v, o = f"k{depth}", f"v{depth}", f"o{depth}"
    name = f"{k} RLIKE '{_NAME}'" + (f" AND NOT {_reserved(k)}" if depth == 1 else "")
    inner = _clean_level(o, text, depth + 1) if depth < fixed.MAX_ATTR_DEPTH else "false"
    # A short text has no long leaf.
    leaf = f"octet_length({text}) <= {fixed.MAX_ATTR_VALUE_BYTES} OR {_fits(f'to_json({v})')}"
    value = _named(_object(v), o, f"IF({o} IS NULL, {leaf}, {inner})")
    return f"(forall(map_keys({fields}), {k} -> {name}) AND forall(map_values({fields}), {v} -> {value}))"


def is_clean(name: str, text: str) -> Column:
    """True only where sanitising the ``map<string, variant>`` ``name`` with JSON ``text`` would change nothing.

    Every key stands before a quote and a colon, so those bound the number of keys.
    """
    name, text = _quoted(name), _quoted(text)
    return F.expr(
        f"octet_length({text}) - octet_length(replace({text}, '\":', ':')) <= {fixed.MAX_ATTR_KEYS} "
        f"AND size(array_distinct(map_keys({name}))) = size(map_keys({name})) AND {_clean_level(name, text, 1)}"
    )


def sanitize_column(df: DataFrame, name: str) -> DataFrame:
    """Replace a ``map<string, variant>`` by sanitised JSON text; add ``attr_warnings``.

    Rows that need no change are null to the Python function, so their
    attributes are not sent to it.
    """
    marked = df.withColumn("_text", F.to_json(name))
    marked = marked.withColumn("_clean", F.coalesce(is_clean(name, "_text"), F.lit(True)))
    fixed_up = marked.withColumn("_fixed", _sanitize_text(F.when(~F.col("_clean"), F.col("_text"))))
    return fixed_up.withColumns(
        {
            name: F.when(F.col("_clean"), F.col("_text")).otherwise(F.col("_fixed.attributes")),
            "attr_warnings": F.when(F.col("_clean"), F.array().cast(WARNINGS)).otherwise(F.col("_fixed.warnings")),
        }
    ).drop("_text", "_clean", "_fixed")


def warnings(events: DataFrame) -> DataFrame:
    """One row per correction with the index of its event."""
    return unnest(events, F.col("attr_warnings"), "warning_index", "w", ["batch_id", "event_index"]).select(
        "batch_id", "event_index", "warning_index", "w.kind", "w.path"
    )
