"""Token counts of texts of any length by overlap resynchronisation.

A text longer than ``CHUNK`` characters is cut into chunks that reach
``overlap`` characters into their successor, and the chunks are encoded in
different tasks. Two neighbours are spliced at a place where a unit of the
vocabulary's pattern begins in both. Such a place is proven stable: the pattern
looks at no text before a unit's begin, and the left chunk's units before the
place were ended by characters inside it, ``MARGIN`` before its end. So from the first chunk on, by
induction, the spliced units are those of the whole text. Where two neighbours
have no such place in common, the document is done again with a wider overlap,
at last as one chunk.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm import bytebpe
from cinderlog.llm.common import id_and_text, settle

CHUNK = 32_768
OVERLAP = 256
WIDER = 16
# Characters before a cut that may still change the units beside it: the longest
# special string and contraction of the vocabulary are shorter.
MARGIN = 16
LIMIT = 1024
PIECES = "row long, doc_id long, n_bytes long, size long, i long, start long, piece string"
MARKS = "row long, doc_id long, n_bytes long, size long, i long, total long, head map<long,long>, tail map<long,long>"


def count_tokens(
    docs: DataFrame, vocabulary: str = bytebpe.VOCABULARY, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    ``docs`` has doc_id and text; other columns are ignored. NULL and empty texts have no tokens.
    Special strings inside texts are handled as the library does by default.
    Rows are counted one by one, whether ids repeat or are NULL.
    """
    docs, size = id_and_text(docs), F.char_length("text")
    small = docs.where(size <= chunk).mapInArrow(_count(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    long = docs.where(size > chunk).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text"
    )
    # Written, so that the row numbers stay as they are.
    left, out = settle(long, "long-texts"), small
    while not left.isEmpty():
        counted = settle(_spliced(left, vocabulary, chunk, overlap), "token-splices")
        out = out.unionByName(counted.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"))
        left = left.join(counted.where("n_tokens is null").select("row"), "row", "left_semi")
        overlap, chunk = overlap * WIDER, chunk * (WIDER // 2)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _count(vocabulary: str):
    def count(source):
        bpe = bytebpe.shared(vocabulary)
        for batch in source:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array([len(bpe.encode(t)) // 2 for t in texts], pa.int64()),
            })

    return count


def _spliced(texts: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """row, doc_id, n_bytes, n_tokens (NULL where some neighbours do not align)."""
    pieces = texts.mapInArrow(_cut(chunk, overlap), PIECES).repartition("row", "i")
    marks = pieces.mapInArrow(_encode(vocabulary, chunk, overlap), MARKS)
    after = F.lead("head").over(Window.partitionBy("row").orderBy("i"))
    common = F.array_intersect(F.map_keys("tail"), F.map_keys("after"))
    at = F.array_min(common)
    # Tokens of the left chunk before the splice, less those of the right one.
    splice = F.when(F.col("i") == F.col("size") - 1, F.col("total")).otherwise(
        F.try_element_at("tail", F.col("at")) - F.try_element_at("after", F.col("at"))
    )
    joined = marks.withColumn("after", after).withColumn("at", at).withColumn("part", splice)
    whole = F.when(F.count("part") == F.count("*"), F.sum("part"))
    return joined.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), whole.alias("n_tokens")
    )


def _cut(chunk: int, overlap: int):
    def cut(source):
        for batch in source:
            for row in batch.to_pylist():
                text = row["text"]
                size = -(-len(text) // chunk)
                for i in range(size):
                    yield pa.RecordBatch.from_pydict({
                        "row": [row["row"]], "doc_id": pa.array([row["doc_id"]], pa.int64()), "n_bytes": [row["n_bytes"]],
                        "size": [size], "i": [i], "start": [i * chunk], "piece": [text[i * chunk : (i + 1) * chunk + overlap]],
                    })

    return cut


def _encode(vocabulary: str, chunk: int, overlap: int):
    """Encode pieces with offsets; head and tail map unit begins in the overlaps to tokens before them."""

    def encode(source):
        library = bytebpe.shared(vocabulary).tokenizer
        for batch in source:
            for row in batch.to_pylist():
                got = library.encode(row["piece"], add_special_tokens=False)
                start, begins = row["start"], unit_begins(got)
                tail = {start + a: n for a, n in begins if chunk <= a <= len(row["piece"]) - MARGIN}
                head = {start + a: n for a, n in begins if 0 < a < overlap}
                yield pa.RecordBatch.from_pydict({
                    "row": [row["row"]], "doc_id": pa.array([row["doc_id"]], pa.int64()), "n_bytes": [row["n_bytes"]],
                    "size": [row["size"]], "i": [row["i"]], "total": [len(got.ids)],
                    "head": pa.array([list(head.items())], pa.map_(pa.int64(), pa.int64())),
                    "tail": pa.array([list(tail.items())], pa.map_(pa.int64(), pa.int64())),
                })

    return encode


def unit_begins(encoding) -> list[tuple[int, int]]:
    """(character, tokens before it) of each unit of the pattern in an encoding."""
    units, offsets = encoding.word_ids, encoding.offsets
    return [
        (offsets[k][0], k) for k in range(1, len(units))
        if units[k] != units[k - 1] and units[k] is not None and units[k - 1] is not None
    ]
