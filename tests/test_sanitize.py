"""Attribute sanitising: the helper itself and its agreement with the native fast path."""

import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from cinderlog.fixed import MAX_ATTR_VALUE_BYTES
from cinderlog.operators.sanitize import is_clean, sanitize_column, sanitize_object, warnings as warning_rows
from cinderlog.sources.attribute_cases import CASES
from pyspark.sql import functions as F


def applied(sql, number=41):
    """The text a case's SQL stands for."""
    parts = []
    for piece in sql.split(" || "):
        if piece.startswith("repeat("):
            char, n = piece[len("repeat("):-1].split(", ")
            parts.append(char.strip("'") * int(n))
        else:
            parts.append(piece[1:-1])
    return "".join(parts).replace("@", str(number))


@pytest.mark.parametrize("slot", range(len(CASES)))
def test_helper_follows_the_contract(slot):
    case = CASES[slot]
    clean, warned = sanitize_object(json.loads(applied(case.sent)))
    assert clean == json.loads(applied(case.clean))
    assert warned == [(kind, applied(path)) for kind, path in case.warned]


def test_cases_by_both_ways(spark):
    """Rows through both ways together; exactly those that change need Python."""
    rows = spark.createDataFrame([(i, applied(c.sent)) for i, c in enumerate(CASES)], "event_index int, j string")
    parsed = rows.select("event_index", F.lit(0).alias("batch_id"), F.from_json("j", "map<string,variant>").alias("log_attributes"))
    got = {r.event_index: r for r in sanitize_column(parsed, "log_attributes").collect()}
    for i, case in enumerate(CASES):
        assert json.loads(got[i].log_attributes) == json.loads(applied(case.clean)), case
        assert [(w.kind, w.path) for w in got[i].attr_warnings] == [(k, applied(p)) for k, p in case.warned]
    changed = parsed.withColumn("t", F.to_json("log_attributes")).where(~is_clean("log_attributes", "t")).select("event_index")
    assert sorted(r.event_index for r in changed.collect()) == [i for i, c in enumerate(CASES) if c.sent != c.clean]


def test_ingest_events_stay_native(spark, sf_dir):
    from cinderlog.operators import ingest
    from cinderlog.sources import tables

    events = ingest.accepted_events(ingest.check(ingest.decode(tables.payloads(spark, sf_dir))))
    python = events.withColumn("t", F.to_json("log_attributes")).where(~is_clean("log_attributes", "t"))
    assert events.count() > 0 and python.count() == 0


def test_empty_keys_and_cut_characters():
    clean, warned = sanitize_object({"": 5, "t": "x" * (MAX_ATTR_VALUE_BYTES - 1) + "𝄞"})
    assert clean == {"_": 5, "t": "x" * (MAX_ATTR_VALUE_BYTES - 1) + "\ufffd"}
    assert warned == [("key-empty", ""), ("value-truncated", "t")]


keys = st.one_of(st.from_regex(r"[a-z][a-z0-9_.]{0,5}", fullmatch=True), st.text(max_size=4))
values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.text(max_size=4),
    lambda inner: st.lists(inner, max_size=2) | st.dictionaries(keys, inner, max_size=3),
    max_leaves=6,
)
objects = st.dictionaries(keys, values, max_size=4)


def test_column_equals_helper(spark):
    """Rows on the native path must be exactly those the helper would not change."""
    samples = []

    @settings(max_examples=150, database=None, derandomize=True, suppress_health_check=[HealthCheck.too_slow])
    @given(objects)
    def collect(raw):
        samples.append(raw)

    collect()
    samples += [{"s": "{not an object"}, {"o": {}}, {}, {"q\"": {"": {"a b": [1, {"c": 2}]}}, "z": {"y": {"x": {"w": {"v": {"u": "t", "2": []}}}}}}]
    rows = spark.createDataFrame(
        [(i, json.dumps(s, ensure_ascii=True)) for i, s in enumerate(samples)], "event_index int, log_attributes string"
    )
    parsed = rows.withColumn("log_attributes", F.from_json("log_attributes", "map<string,variant>")).withColumn("batch_id", F.lit(0))
    done = sanitize_column(parsed, "log_attributes")
    got = {r["event_index"]: r for r in done.collect()}
    for i, raw in enumerate(samples):
        clean, warned = sanitize_object(raw)
        assert json.loads(got[i]["log_attributes"]) == clean, raw
        assert [(w["kind"], w["path"]) for w in got[i]["attr_warnings"]] == warned
    assert warning_rows(done).count() == sum(len(sanitize_object(s)[1]) for s in samples)


def test_duplicate_keys_last_wins(spark):
    rows = spark.createDataFrame([('{"a":1,"b":0,"a":2}',)], "j string")
    done = sanitize_column(rows.select(F.from_json("j", "map<string,variant>").alias("j")), "j").first()
    assert json.loads(done["j"]) == {"a": 2, "b": 0}


def test_a_key_is_cleaned_once_however_often_it_comes():
    from cinderlog.operators import sanitize

    before = sanitize._known_key.cache_info().misses
    for i in range(50):
        assert sanitize_object({"once only": i}) == ({"once_only": i}, [("key-rewritten", "once only")])
    assert sanitize._known_key.cache_info().misses == before + 1
    long = "k" * 300
    assert sanitize_object({long: 1}) == ({"k" * 255: 1}, [("key-truncated", long)])
    assert sanitize._known_key.cache_info().misses == before + 1
