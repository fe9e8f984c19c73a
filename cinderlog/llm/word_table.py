"""BPE encoding and decoding through a table of distinct words.

Texts are split into words at ``[\\x20\\x09-\\x0D]+``, which the vocabulary's
normaliser and pattern never join across. Each distinct word of the corpus is
encoded once, by the part of the word table it belongs to, and its ids return to
every block by position. Decoding joins the distinct ids of each block with the
vocabulary's table of (id, piece); a block then reads its texts from the pieces it
got back.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.blocks import BlockTable, pack, rows_of, unpack
from cinderlog.llm.common import tokenizer_path

VOCABULARY = "word_bpe_49k.json"
LOT = 20_000


@functools.cache
def library(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path(vocabulary))
    made.no_truncation()
    made.no_padding()
    return made


def pieces(spark, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece) of a vocabulary."""
    rows = sorted((i, p) for p, i in library(vocabulary).get_vocab(with_added_tokens=True).items())
    return spark.createDataFrame(rows, "id int, piece string")


def deal(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which words are asked, part by part, and where each part begins."""
    part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _questions(parts: int):
    def ask(block, _):
        order, begins = deal(block.words, parts)
        for p in np.flatnonzero(np.diff(begins)).tolist():
            yield p, b"\n".join(block.words[i] for i in order[begins[p] : begins[p + 1]].tolist())

    return ask


def _encode(vocabulary: str):
    def answer(rows):
        asked = [(b, q.split(b"\n")) for b, q in rows]
        table = dict.fromkeys(w for _, words in asked for w in words)
        distinct = list(table)
        for at in range(0, len(distinct), LOT):
            lot = distinct[at : at + LOT]
            got = library(vocabulary).encode_batch_fast([w.decode() for w in lot], add_special_tokens=False)
            table.update((w, np.array(e.ids, np.uint32)) for w, e in zip(lot, got, strict=True))
        for b, words in asked:
            ids = [table[w] for w in words]
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
            first, second = pack(sizes), pack(np.concatenate(ids))
            yield b, "ids", len(first).to_bytes(8, "little") + first + second

    return answer


def _ids(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids per word, ids) of an answer."""
    n = int.from_bytes(raw[:8], "little")
    return unpack(raw[8 : 8 + n], np.uint32), unpack(raw[8 + n :], np.uint32)


def _distinct_ids(source):
    """The distinct ids of each block, from all its answers together."""
    for batch in source:
        for block, held in zip(batch.column("block").to_pylist(), batch.column("answers"), strict=True):
            ids = np.unique(np.concatenate([_ids(answer.as_py())[1] for answer in held.values]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), block), pa.int64()), pa.array(ids, pa.int32())], names=["block", "id"]
            )


def pieces_of_blocks(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Answers that hold, for each block, the pieces of all ids in it: as many as the vocabulary has at most.

    A block's answers meet before their ids are listed, so an id makes one row for each
    block and not one for each part that answered.
    """
    gathered = answers.groupBy("block").agg(F.collect_list("answer").alias("answers"))
    used = gathered.mapInArrow(_distinct_ids, "block long, id int")
    found = used.join(known, "id").groupBy("block").agg(F.to_json(F.collect_list(F.struct("id", "piece"))).alias("answer"))
    return found.select("block", F.lit(0).alias("part"), F.lit("pieces").alias("k"), F.col("answer").cast("binary").alias("answer"))


def _documents(parts: int):
    """Ids and decoded text of each document of a block."""

    def read(source):
        for block, given in rows_of(source):
            order, begins = deal(block.words, parts)
            sizes, flat = np.zeros(len(order), np.int64), []
            for p in np.flatnonzero(np.diff(begins)).tolist():
                sizes[order[begins[p] : begins[p + 1]]], ids = _ids(given["ids"][p])
                flat.append(ids)
            pieces = {r["id"]: r["piece"] for r in json.loads(given["pieces"][0])} if flat else {}
            table = np.full(max(pieces, default=0) + 1, None, object)
            table[list(pieces)] = list(pieces.values())
            flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
            # Where each word's ids begin in the answers, which follow the order asked.
            starts = np.zeros(len(order), np.int64)
            starts[order] = np.cumsum(sizes[order]) - sizes[order]
            ends = np.cumsum(block.sizes)
            for doc_id, a, b in zip(block.doc_ids, (ends - block.sizes).tolist(), ends.tolist(), strict=True):
                codes = block.codes[a:b]
                n = sizes[codes]
                at = np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                ids = flat[at]
                yield doc_id, ids, " ".join(table[ids])

    return read


def _rows(read, digest: bool):
    def run(source):
        lot: list[tuple] = []
        held = 0
        for doc_id, ids, text in read(source):
            if digest:
                joined = " ".join(map(str, ids.tolist())).encode()
                lot.append((doc_id, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            else:
                lot.append((doc_id, len(ids), ids.tolist(), text))
            held += 64 if digest else len(text)
            if held > 4 << 20:
                yield _batch(lot, digest)
                lot, held = [], 0
        if lot:
            yield _batch(lot, digest)

    return run


def _batch(lot: list[tuple], digest: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string() if digest else pa.list_(pa.int64()), pa.string()]
    names = ["doc_id", "n_tokens", "ids_sha256" if digest else "ids", "decoded_sha256" if digest else "decoded"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lot, strict=True), kinds, strict=True)], names=names)


def encode_and_decode(docs: DataFrame, vocabulary: str = VOCABULARY, digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids, decoded (the ids decoded again).

    ``docs`` has doc_id and text; other columns are ignored. Ids are those of the tokenizers
    library without added special tokens; ``decoded`` is what its decode gives
    with special tokens kept, for a vocabulary without a decoder: the pieces,
    joined by one blank. With ``digest`` the hex SHA-256 of the decimal ids joined
    by blanks and of the decoded text take their places, as ids_sha256 and
    decoded_sha256.

    A NULL or empty text has no ids. Rows are encoded one by one, whether ids
    repeat or are NULL.
    """
    spark = docs.sparkSession
    if library(vocabulary).decoder is not None:
        raise ValueError("this vocabulary joins its pieces by a rule of its own")
    table = BlockTable(docs, fold=False)
    parts = table.parts(table.n_words, 32)
    answers = table.ask(_questions(parts), _encode(vocabulary), parts, "word-ids")
    shown = pieces_of_blocks(answers, pieces(spark, vocabulary))
    read = _documents(parts)
    kind = "doc_id long, n_tokens long, " + (
        "ids_sha256 string, decoded_sha256 string" if digest else "ids array<long>, decoded string"
    )
    out = table.with_answers(answers.unionByName(shown)).mapInArrow(_rows(read, digest), kind)
    table.forget()
    return out
