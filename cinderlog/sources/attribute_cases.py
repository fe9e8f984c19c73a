"""Attribute objects for the sanitiser, made by rule: inputs with what the contract makes of them.

Each case is SQL text valid in Spark and DuckDB; ``@`` stands for the event's id.
"""

from __future__ import annotations

from typing import NamedTuple

from cinderlog.fixed import MAX_ATTR_DEPTH, MAX_ATTR_KEY_BYTES, MAX_ATTR_KEYS, MAX_ATTR_VALUE_BYTES, RESERVED_PREFIXES


class Case(NamedTuple):
    sent: str
    clean: str
    warned: list[tuple[str, str]]


def _text(value: str) -> str:
    return f"'{value}'"


# One character of each class of bytes, and how many bytes it has.
CLASSES = [("q", 1), ("Q", 1), ("7", 1), ("_", 1), (".", 1), ("-", 1), (" ", 1), ("ü", 2), ("字", 3), ("𝄞", 4)]


def _characters() -> list[Case]:
    """Every class of bytes as the first, an inner and the last character of a key."""
    out = []
    for char, size in CLASSES:
        for before, after in (("", "bc"), ("a", "c"), ("ab", "")):
            kept = char.isascii() and (char.isalpha() if not before else char.isalnum() or char in "_.")
            key, name = before + char + after, before + (char if kept else "_" * size) + after
            # A letter-only rule for the first byte turns an underscore into itself.
            warned = [] if name == key else [("key-rewritten", _text(key))]
            out.append(Case(_text(f'{{"{key}":@}}'), _text(f'{{"{name}":@}}'), warned))
    return out


def _depths() -> list[Case]:
    """One key in one key, from one level to three beyond the limit."""
    out = []
    for depth in range(1, MAX_ATTR_DEPTH + 4):
        keys = [f"n{i}" for i in range(1, depth + 1)]
        nest = lambda ks, leaf: "".join(f'{{"{k}":' for k in ks) + leaf + "}" * len(ks)
        if depth <= MAX_ATTR_DEPTH:
            out.append(Case(_text(nest(keys, "@")), _text(nest(keys, "@")), []))
            continue
        inner = nest(keys[: MAX_ATTR_DEPTH - 1], "{}")
        path = ".".join(keys)
        warned = [("flattened", _text(".".join(keys[:MAX_ATTR_DEPTH])))]
        out.append(Case(_text(nest(keys, "@")), _text(f'{inner[:-1]},"{path}":@}}'), warned))
    return out


def _counts() -> list[Case]:
    """Numbers of keys around the limit, at the root and below one key."""
    out = []
    for n in range(MAX_ATTR_KEYS - 1, MAX_ATTR_KEYS + 2):
        for inside in (0, 1):
            body = lambda m: ",".join(f'"c{i:04d}":@' for i in range(m))
            wrap = lambda text: f'{{"o":{{{text}}}}}' if inside else f"{{{text}}}"
            room = MAX_ATTR_KEYS - inside
            warned = [("key-limit", _text(("o." if inside else "") + f"c{i:04d}")) for i in range(room, n)]
            out.append(Case(_text(wrap(body(n))), _text(wrap(body(min(n, room)))), warned))
    return out


def _lengths() -> list[Case]:
    """Values and keys one byte short of, at and beyond their limits."""
    out = []
    for n in range(MAX_ATTR_VALUE_BYTES - 1, MAX_ATTR_VALUE_BYTES + 2):
        text = lambda m: f"'{{\"id\":@,\"v\":\"' || repeat('v', {m}) || '\"}}'"
        warned = [("value-truncated", "'v'")] if n > MAX_ATTR_VALUE_BYTES else []
        out.append(Case(text(n), text(min(n, MAX_ATTR_VALUE_BYTES)), warned))
    for n in range(MAX_ATTR_KEY_BYTES - 1, MAX_ATTR_KEY_BYTES + 2):
        text = lambda m: f"'{{\"' || repeat('k', {m}) || '\":@}}'"
        warned = [("key-truncated", f"repeat('k', {n})")] if n > MAX_ATTR_KEY_BYTES else []
        out.append(Case(text(n), text(min(n, MAX_ATTR_KEY_BYTES)), warned))
    return out


def _others() -> list[Case]:
    """Reserved names at the root and below it, names that clash, lists, empty objects."""
    out = []
    for prefix in RESERVED_PREFIXES:
        out.append(Case(
            _text(f'{{"in":{{"{prefix}x":@}},"{prefix}x":1,"{prefix[:-1]}x":2}}'),
            _text("{" + ",".join(sorted([f'"in":{{"{prefix}x":@}}', f'"{prefix[:-1]}x":2'])) + "}"),
            [("reserved", _text(prefix + "x"))]))
    clash = [("key-rewritten", _text("w x")), ("key-rewritten", _text("w-x"))]
    out.append(Case(_text('{"w x":1,"w-x":@}'), _text('{"w_x":@}'), clash))
    out.append(Case(_text('{"id":@,"list":[{"w x":{"y":1}}]}'), _text('{"id":@,"list":[{"w x":{"y":1}}]}'), []))
    out.append(Case(_text("{}"), _text("{}"), []))
    plain = _text('{"flag":true,"id":@,"k":1.5,"none":null,"s":"plain"}')
    return out + [Case(plain, plain, [])]


def _cases() -> list[Case]:
    made = _characters() + _depths() + _counts() + _lengths() + _others()
    return made + made[-1:] * (64 - len(made))


CASES = _cases()
