"""Terms, stems and the term index."""

import pytest
from pyspark.sql import functions as F

from cinderlog.functions import text
from cinderlog.operators import terms

# Published sample of the English Snowball vocabulary.
SAMPLE = """
consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist
consistency consist|consistent consist|consistently consist|consisting consist|consists consist
consolation consol|consolations consol|consolatory consolatori|console consol|consoled consol|consoles consol
consolidate consolid|consolidated consolid|consolidating consolid|consoling consol|consolingly consol
consols consol|consonant conson|consort consort|knack knack|knackeries knackeri|knacks knack|knag knag
knave knave|knaves knave|knavish knavish|kneaded knead|kneading knead|knee knee|kneel kneel|kneeled kneel
kneeling kneel|kneels kneel|knees knee|knell knell|knelt knelt|knew knew|knick knick|knif knif|knife knife
knight knight|knightly knight|knights knight|knit knit|knits knit|knitted knit|knitting knit|knives knive
knob knob|knobs knob|knock knock|knocked knock|knocker knocker|knockers knocker|knocking knock|knocks knock
knopp knopp|knot knot|knots knot
"""
# By rule: each line shows one of them.
RULES = """
caresses caress|ties tie|cries cri|gas gas|this this|gaps gap|kiwis kiwi|hopping hop|hoping hope|luxuriated luxuri
agreed agre|feed feed|cry cri|by by|say say|relational relat|conditional condit|generously generous|communism communism
skies sky|dying die|news news|inning inning|proceed proceed|using use|yes yes|syzygy syzygi|saying say|a a|ox ox
"""


def pairs(block):
    return [p.split() for line in block.strip().splitlines() for p in line.split("|")]


@pytest.mark.parametrize("word, expected", pairs(SAMPLE) + pairs(RULES))
def test_stem(word, expected):
    assert text.stem(word) == expected


def test_terms(spark):
    body = "The Payments FAILED; payment-gateway's timeouts: café naïve x200 don't 42"
    row = spark.createDataFrame([(body,), (None,), ("the and",)], "b string").select(
        text.terms(F.col("b")).alias("e"), text.terms(F.col("b"), "simple").alias("s")
    ).collect()
    assert row[0]["e"] == ["payment", "fail", "gateway", "timeout", "café", "naïv", "x200", "42"]
    assert row[0]["s"][:3] == ["the", "payments", "failed"]
    assert row[2]["e"] == []


def test_start_letters_are_kept_by_stemming(spark, sf_dir):
    """The search looks only at words that start like the keyword's stem."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.explode(text.tokens(F.col("text"))).alias("w")
    ).distinct().collect()
    vocabulary = {r["w"] for r in words} | {w for w, _ in pairs(SAMPLE) + pairs(RULES)} | set(text.STEM_WHOLE)
    for word in vocabulary:
        stem = text.stem(word)
        if len(stem) > 1:
            assert text.word_start(word) == text.word_start(stem), word
        else:
            assert word[:1] == stem, word


def test_search_equals_stored_terms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    stored = docs.withColumn("body_terms", text.terms(F.col("body"))).cache()
    index = terms.term_index(docs.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))).cache()
    for keyword in ("license", "the licenses", "thing using", "a", "zzz", "ties", "x"):
        direct = {r["id"] for r in stored.where(text.matches(F.col("body"), keyword)).collect()}
        by_terms = {r["id"] for r in stored.where(text.matches_terms(F.col("body_terms"), keyword)).collect()}
        by_index = {r["id"] for r in terms.matching_ids(index, keyword).collect()}
        assert direct == by_terms == by_index, keyword


def test_index_files_are_sorted_and_pruned(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id as id", "text as body", "timestamp_ntz'2024-01-01 00:00:00' as timestamp"
    )
    path = str(tmp_path / "terms")
    terms.write_term_index(terms.term_index(docs, "simple"), path)
    stored = spark.read.schema("term string, id bigint, event_date date").parquet(path)
    assert stored.count() == terms.term_index(docs, "simple").count()
