"""Token files of directly addressable codes.

Ids are cut into chunks of ``BITS`` bits. Level 0 holds the lowest chunk of every
id; a bitmap says which ids go on, and level 1 holds the next chunk of those
only, and so on. A directory of set bits before each block of the bitmap gives
the place of an id's next chunk in constant time, so any id can be read without
decoding its neighbours.

A file is a Parquet file whose rows are segments: whole documents in ascending
doc_id order, about ``SEGMENT`` ids each, with the documents' ids and ends beside
the coded ids. Spark writes and reads them, so they can lie in any store.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm import bytebpe
from cinderlog.llm.common import id_and_text
from cinderlog.session import scratch_path

BITS = 8
BLOCK = 512
SEGMENT = 1 << 18
END_ID = 0
MAGIC = b"DAC1"
SEGMENTS = "part int, seq int, doc_ids array<long>, ends array<long>, codes binary"


class DirectCodes:
    """One segment: levels of chunks with bitmaps and rank directories."""

    def __init__(self, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.n, self.levels = n, levels

    @classmethod
    def of(cls, ids: np.ndarray) -> DirectCodes:
        rest, levels = np.asarray(ids, np.uint32), []
        n = len(rest)
        while not levels or len(rest):
            more = rest >> BITS
            goes_on = more > 0
            bits = np.packbits(goes_on, bitorder="little")
            ones = np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK), dtype=np.uint32) if len(rest) else np.zeros(0, np.uint32)
            levels.append(((rest & 255).astype(np.uint8), bits, np.cumsum(ones, dtype=np.uint32) - ones))
            rest = more[goes_on]
        return cls(n, levels)

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<QB", self.n, len(self.levels))]
        for chunks, bits, ranks in self.levels:
            out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> DirectCodes:
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n, depth = struct.unpack_from("<QB", raw, 4)
        at, levels = 13, []
        for _ in range(depth):
            (size,) = struct.unpack_from("<Q", raw, at)
            at += 8
            parts = []
            for kind, count in ((np.uint8, size), (np.uint8, -(-size // 8)), (np.dtype("<u4"), -(-size // BLOCK))):
                parts.append(np.frombuffer(raw, kind, count, at))
                at += parts[-1].nbytes
            levels.append(tuple(parts))
        return cls(n, levels)

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one look at each of its chunks."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (BITS * depth)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            begin = i - i % BLOCK
            before = np.unpackbits(bits[begin >> 3 : (i >> 3) + 1], bitorder="little")[: i - begin]
            i = int(ranks[begin // BLOCK]) + int(before.sum())
        return value

    def decode(self) -> np.ndarray:
        value = np.zeros(self.n, np.uint32)
        at = np.arange(self.n)
        for depth, (chunks, bits, _) in enumerate(self.levels):
            value[at] |= chunks.astype(np.uint32) << np.uint32(BITS * depth)
            at = at[np.unpackbits(bits, bitorder="little", count=len(at)).astype(bool)]
        return value


def write_tokens(docs: DataFrame, path: str, vocabulary: str = bytebpe.VOCABULARY, end_id: int = END_ID) -> None:
    """Encode texts and write them in ascending doc_id order.

    ``docs`` has doc_id and text; other columns are ignored. Documents are dealt to tasks by ranges
    of doc_id; rows that share an id follow each other, those without one come
    first. ``end_id`` follows every document, so an empty or NULL text has one
    id. An empty table writes no segment.
    """
    tie = F.xxhash64("text")
    placed = id_and_text(docs).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    placed.mapInArrow(_segments(vocabulary, end_id), SEGMENTS).write.parquet(path)


def _segments(vocabulary: str, end_id: int):
    def build(source):
        bpe, part, seq = bytebpe.shared(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        doc_ids, ends, held, size = [], [], [], 0

        def segment():
            ids = np.frombuffer(b"".join(held), "<u2")
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "doc_ids": [doc_ids], "ends": [ends], "codes": [DirectCodes.of(ids).to_bytes()]},
                schema=pa.schema([
                    ("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                    ("ends", pa.list_(pa.int64())), ("codes", pa.binary()),
                ]),
            )

        for batch in source:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = bpe.encode(text) + end
                held.append(raw)
                size += len(raw) // 2
                doc_ids.append(doc_id)
                ends.append(size)
                if size >= SEGMENT:
                    yield segment()
                    seq += 1
                    doc_ids, ends, held, size = [], [], [], 0
        if doc_ids:
            yield segment()

    return build


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document of a token file, read back from its codes.

    Returns doc_id, start (ids of all documents before it in the file), n_tokens
    (with the end id), ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), part, seq and place (where its segment is and where it lies in it).
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.select("part", "seq", F.coalesce(F.element_at("ends", -1), F.lit(0)).alias("n"))
    # One row per file goes into the first sum, one row per segment of a file into the second.
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part").select(
        "part", "seq", (F.col("inside") + F.col("before")).alias("begin")
    )
    return segments.mapInArrow(
        _documents, "part int, seq int, place long, doc_id long, n_tokens long, ids_crc32 long"
    ).join(begins, ["part", "seq"]).select(
        "doc_id", (F.col("begin") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "place"
    )


def _documents(source):
    for batch in source:
        for row in batch.to_pylist():
            ids = DirectCodes.from_bytes(row["codes"]).decode().astype("<u4")
            ends = row["ends"]
            starts = [0, *ends[:-1]]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([row["part"]] * len(ends), pa.int32()), "seq": pa.array([row["seq"]] * len(ends), pa.int32()),
                "place": pa.array(starts, pa.int64()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "n_tokens": pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
            })


def token_at(spark, path: str, part: int, seq: int, place: int) -> int:
    """One id of one segment, read without decoding the others."""
    row = spark.read.schema(SEGMENTS).parquet(path).where((F.col("part") == part) & (F.col("seq") == seq)).first()
    return DirectCodes.from_bytes(bytes(row.codes))[place]


def write_and_read(docs: DataFrame, vocabulary: str = bytebpe.VOCABULARY) -> DataFrame:
    """Round trip through a token file in the shared folder."""
    path = scratch_path(docs.sparkSession, "direct-codes")
    write_tokens(docs, path, vocabulary)
    return read_tokens(docs.sparkSession, path)
