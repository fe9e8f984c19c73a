"""Word-coded blocks of documents, and questions they put to the whole corpus.

A block holds some megabytes of documents as numbers into its own list of
distinct words. What a block needs to know of all the others (the ids of its
words, the counts of its n-grams) is asked once per distinct key: its keys are
dealt to parts by hash, each part answers from all blocks' keys, and the answers
come back in the order of the questions. So a frequent word crosses the network
once per block, not once per occurrence, and no part grows with a hot key.

Blocks are written as a table bucketed by block number; answers join it without
moving it again.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.common import id_and_text, settle
from cinderlog.session import scratch_path

BLOCK_BYTES = 32 << 20
PART_BYTES = 24 << 20
COLUMNS = "block long, doc_ids array<long>, sizes array<int>, n_words long, codes binary, words binary"
ANSWERS = "block long, part int, k string, answer binary"
QUESTIONS = "part int, block long, question binary"


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """One decoded row of a block table."""

    def __init__(self, row: dict) -> None:
        self.block, self.doc_ids = row["block"], row["doc_ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.codes = unpack(row["codes"], np.uint32)
        self.words = row["words"].split(b"\n") if row["words"] else []


def _build(fold: bool, limit: int):
    def build(source):
        base, seq = TaskContext.get().partitionId() << 32, 0
        numbers, codes, doc_ids, sizes, held = _Numbers(), array("I"), [], [], 0

        def block():
            raw = np.frombuffer(codes, np.uint32)
            order = np.argsort(-np.bincount(raw, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = list(numbers)
            return pa.RecordBatch.from_arrays([
                pa.array([base + seq], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int32())), pa.array([len(words)], pa.int64()),
                pa.array([pack(rank[raw])], pa.binary()), pa.array([b"\n".join(words[i] for i in order.tolist())], pa.binary()),
            ], names=["block", "doc_ids", "sizes", "n_words", "codes", "words"])

        for batch in source:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                # bytes.split() cuts at exactly [\x20\x09-\x0D]+, bytes.lower() changes A-Z only.
                words = (text.lower() if fold else text).split()
                codes.extend(map(numbers.__getitem__, words))
                doc_ids.append(doc_id)
                sizes.append(len(words))
                held += len(text)
                if held >= limit:
                    yield block()
                    seq += 1
                    numbers, codes, doc_ids, sizes, held = _Numbers(), array("I"), [], [], 0
        if doc_ids:
            yield block()

    return build


class BlockTable:
    def __init__(self, docs: DataFrame, fold: bool, limit: int = BLOCK_BYTES) -> None:
        self.spark = docs.sparkSession
        self.name = f"llm_blocks_{uuid.uuid4().hex}"
        made = id_and_text(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_build(fold, limit), COLUMNS)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = scratch_path(self.spark, "blocks")
        made.write.option("path", path).bucketBy(buckets, "block").saveAsTable(self.name)
        self.frame = self.spark.table(self.name)
        self.n_words = self.frame.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first().n

    def parts(self, keys: int, width: int) -> int:
        """How many parts keep ``keys`` keys of ``width`` bytes within memory."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-keys * width // PART_BYTES))

    def ask(self, questions, answer, parts: int, label: str, given: DataFrame | None = None) -> DataFrame:
        """Answers (block, part, k, answer), written.

        ``questions(block, given)`` yields (part, bytes); ``answer(rows)`` gets all
        (block, bytes) of one part and yields (block, kind of answer, bytes). Tasks are as
        many as parts, so that what a task holds doesn't grow with the corpus.
        """
        asked = self.with_answers(given).mapInArrow(_asking(questions), QUESTIONS)
        dealt = asked.repartition(parts, "part").sortWithinPartitions("part", "block")
        return settle(dealt.mapInArrow(_answering(answer), ANSWERS), label)

    def with_answers(self, given: DataFrame | None) -> DataFrame:
        """The blocks, each with its answers as a map from (kind and part) to bytes."""
        if given is None:
            return self.frame.withColumn("answers", F.array().cast("array<struct<k:string,part:int,answer:binary>>"))
        lists = given.where("block >= 0").groupBy("block").agg(
            F.collect_list(F.struct("k", "part", "answer")).alias("answers")
        )
        return self.frame.join(lists, "block", "left")

    def forget(self) -> None:
        """Take the table's name back. Its files stay below the shared folder for frames that read them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def rows_of(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict[str, dict[int, bytes]]]]:
    """Blocks with their answers, one at a time."""
    for batch in source:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            given: dict[str, dict[int, bytes]] = {}
            for a in row.pop("answers") or []:
                given.setdefault(a["k"], {})[a["part"]] = a["answer"]
            yield Block(row), given


def _asking(questions):
    def ask(source):
        for block, given in rows_of(source):
            parts, raw = [], []
            for part, question in questions(block, given):
                parts.append(part)
                raw.append(question)
            yield pa.RecordBatch.from_arrays([
                pa.array(parts, pa.int32()), pa.array([block.block] * len(parts), pa.int64()), pa.array(raw, pa.binary()),
            ], names=["part", "block", "question"])

    return ask


def _answering(answer):
    def run(source):
        part, held = None, []

        def give():
            out = list(answer(held))
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _, _ in out], pa.int64()), pa.array([part] * len(out), pa.int32()),
                pa.array([k for _, k, _ in out], pa.string()), pa.array([x for _, _, x in out], pa.binary()),
            ], names=["block", "part", "k", "answer"])

        for batch in source:
            for p, b, q in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part and held:
                    yield give()
                    held = []
                part = p
                held.append((b, q))
        if held:
            yield give()

    return run
