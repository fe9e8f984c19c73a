"""Inputs shared by the tests of this folder."""

import duckdb

from cinderlog.llm.common import prepare

# Empty, blank, NULL, repeated, very long, odd white space and code points, special strings.
LONG = "Wordy tail-end's 12 half. " * 9000
ODD = [
    (1, "The cat sat on the mat. The end"), (2, ""), (3, None), (4, " \t\n\x0b\x0c\r "), (5, "the cat  sat on\nthe MAT. the end"),
    (6, "a b  c \x1c d \x85"), (7, "x<|endoftext|>y <|endoftext|> z"), (8, "naïve Ünïcode 日本語 \U0001F600 end"),
    (9, LONG), (10, "don't we'll I'm it's 'tis x'sy"), (11, "The cat sat on the mat. The end"), (11, "The cat sat on the mat. The end"),
    (12, "a" * 5000), (None, "without an id"), (None, None), (13, "\n\n\nlines\n\n"), (14, "é combining ́ alone"),
]


def odd_docs(spark):
    """Rows of ODD with further columns whose names operators use inside."""
    prepare(spark)
    rows = [(i, t, "key", 7, None, 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, ord int, block string, score double")


def no_docs(spark):
    prepare(spark)
    return spark.createDataFrame([], "doc_id long, text string")


def sample_texts(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return {k: sorted(v, key=repr) for k, v in out.items()}
