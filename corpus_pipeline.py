"""A corpus made ready for training, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a frame that is written and read again as the next one's ``docs``. All but
the last return rows of ``documents`` with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderlog.llm import ngram_join, radix_dedup, spaced_seeds, toxicity, word_table
from cinderlog.llm.common import prepare, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text isn't predicted to be toxic."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(docs, labels, carry=True).where("predicted = 0").select("whole.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    prepare(spark)
    return radix_dedup.exact_groups(docs, carry=True).where("kept").select("whole.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by similar 5-word shingles, that of the smallest doc_id."""
    prepare(spark)
    return ngram_join.link_documents(docs, carry=True).where("kept").select("whole.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark."""
    items = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return spaced_seeds.find_leaks(docs, items, carry=True).where("not contaminated").select("whole.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text decoded from them."""
    prepare(spark)
    return word_table.encode_and_decode(docs)


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark), ("BPE encoding and decoding", encode),
]

# A trained network decides in the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = prepare(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
