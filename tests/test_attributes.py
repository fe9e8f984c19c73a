"""Containment against a direct reading of its rules."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from cinderlog.functions import attributes


def holds(value, wanted, top=True):
    if isinstance(wanted, dict):
        return isinstance(value, dict) and all(k in value and holds(value[k], w, False) for k, w in wanted.items())
    if isinstance(wanted, list):
        return isinstance(value, list) and all(any(holds(v, w, False) for v in value) for w in wanted)
    if isinstance(value, list):
        return top and any(not isinstance(v, list) and holds(v, wanted, False) for v in value)
    if isinstance(value, bool) or isinstance(wanted, bool):
        return value is wanted
    return type(value) is not dict and value == wanted and (value is None) == (wanted is None)


DOCS = [
    {}, {"a": 1}, {"a": "1"}, {"a": True}, {"a": None}, {"a": 1.5}, {"a": 1.0}, {"a": {"b": "x", "c": [1, 2]}},
    {"a": [1, "x", {"b": "x"}]}, {"a": [[1, 2], 3]}, [1, "x", None, {"a": 1}], [], "x", 1, None, {"a.b": "x"},
    {"q\"uo": 1}, {"q'\"": "both"}, {"a": 2**40}, {"a": {}},
]


def test_containment(spark):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "i int, j string").cache()
    wanted = DOCS + [{"a": [1]}, {"a": [{"b": "x"}]}, {"a": ["x", 1]}, [{"a": 1}], [[1]]]
    tests = rows.select(
        "i",
        *[attributes.contains(F.try_parse_json("j"), w).alias(f"w{n}") for n, w in enumerate(wanted)],
        *[attributes.contains_text(F.col("j"), w).alias(f"t{n}") for n, w in enumerate(wanted)],
    ).collect()
    for row, (n, w) in itertools.product(tests, enumerate(wanted)):
        doc = DOCS[row["i"]]
        assert bool(row[f"w{n}"]) == holds(doc, w), (doc, w)
        assert bool(row[f"t{n}"]) == holds(doc, w), (doc, w)


def drawn(rng, depth=0):
    """A random value over few names and leaves, so that containment often holds."""
    kind = rng.random()
    if depth < 3 and kind < 0.4:
        return {k: drawn(rng, depth + 1) for k in rng.sample("abc", rng.randint(0, 3))}
    if depth < 3 and kind < 0.6:
        return [drawn(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([0, 1, True, None, "a", "0", 0.5])


def test_containment_of_random_objects(spark):
    rng = random.Random(20)
    docs = [drawn(rng) for _ in range(120)]
    wanted = [drawn(rng, 1) for _ in range(40)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string")
    got = rows.select("i", *[attributes.contains_text(F.col("j"), w).alias(f"w{n}") for n, w in enumerate(wanted)]).collect()
    found = [(row["i"], n, bool(row[f"w{n}"])) for row in got for n in range(len(wanted))]
    assert found == [(i, n, holds(docs[i], wanted[n])) for i, n, _ in found]
    assert any(hit for _, _, hit in found)


def test_escaped_text_is_still_found(spark):
    """The wanted text in full, escaped in the JSON; another text escaped alike is no match."""
    escape = lambda text: "".join(f"\\u{ord(c):04x}" for c in text)
    rows = spark.createDataFrame([(f'{{"role":"{escape(word)}"}}',) for word in ("wanted", "unwanted")] + [('{"role":"other"}',)], "j string")
    hits = rows.where(attributes.contains_text(F.col("j"), {"role": "wanted"})).collect()
    assert [json.loads(r.j) for r in hits] == [{"role": "wanted"}]


@pytest.mark.parametrize("key, expected", [("a.b", "x"), ('q"uo', "1"), ("q'\"", "both"), ("none", None)])
def test_odd_keys(spark, key, expected):
    doc = json.dumps({"a.b": "x", 'q"uo': 1, "q'\"": "both", "n": None})
    row = spark.createDataFrame([(doc,)], "j string").select(
        attributes.attr_text(F.try_parse_json("j"), key).alias("v"),
        attributes.has_key(F.try_parse_json("j"), "n").alias("n"),
        attributes.has_key(F.try_parse_json("j"), "zz").alias("z"),
    ).first()
    assert (row["v"], row["n"], row["z"]) == (expected, True, False)
