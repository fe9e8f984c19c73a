"""Tokens of two vocabularies aligned by the bytes they cover.

A byte-level BPE (A) reads a blank and the text, a piece BPE (B) reads the text and
puts that blank before it itself, so both cover the same bytes. Two tokens are
linked if their byte ranges overlap, and where a token of each ends at the same
byte, the tokens since the last such place form a group.

Links are made by merging both lists of token ends in lockstep: numpy state
vectors hold the next A and the next B token of every lane of a block; a
step links the two of each lane, cuts where both end together and advances what
ends first. Lanes that are through are compacted away. A lane is a document, or a
stretch of a long one that begins and ends where both have a token end, so that one long text
doesn't keep a vector of one lane going.

How often an id pair is linked in the whole corpus is a Spark aggregation over each
block's distinct pairs; the counts return to the blocks by a join on the pair.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm import hashing
from cinderlog.llm.blocks import pack, unpack
from cinderlog.llm.bytebpe import ByteBPE, byte_letters
from cinderlog.llm.common import id_and_text, settle, tokenizer_path

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Text of a block; some fifty bytes of arrays stand beside each of its bytes.
BLOCK_BYTES = 1 << 20
# Bytes of a lane at least, if the text is longer.
LANE = 2048
MOST = 400_000
SPACE = "▁"
CUT = re.compile(r"(?<=[^ ]) (?=[^ ])")
BLOCKS = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "digests array<string>, pairs array<long>, counts array<long>, codes binary"
)
OUT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


class Pieces(dict):
    """Ids of B, four bytes each, for each piece of text between single blanks, remembered up to ``MOST`` of them.

    No entry of the vocabulary goes on behind a blank that follows another character, so no
    merge crosses such a place; the library puts the blank before each piece again.
    """

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST:
            self.clear()
        self[piece] = ids = array("i", self.encode(piece)).tobytes()
        return ids


class PieceBPE:
    def __init__(self, vocabulary: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(vocabulary))
        shown = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(shown)
        ]
        self.whole = lambda text: np.array(model.encode(text), np.int32)
        # Otherwise pieces of text can't be encoded one by one.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in shown)
        self.known = Pieces(model.encode)

    def encode(self, text: str) -> np.ndarray:
        if not self.apart or SPACE in text:
            return self.whole(text)
        even = "  " not in text and text[0] != " " and text[-1] != " "
        return np.frombuffer(b"".join(map(self.known.__getitem__, text.split(" ") if even else CUT.split(text))), np.int32)


class Vocabularies:
    """Both encoders, and each entry's bytes, byte count and decimal id with what may follow it."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = ByteBPE(a, plain=True), PieceBPE(b)
        back = {c: i for i, c in byte_letters().items()}
        entries = self.a.tokenizer.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            # The library's own bytes; an entry outside the byte letters stands for no byte.
            a_bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else b""
        self.bytes = [np.array(x, object) for x in (a_bytes, self.b.bytes)]
        self.sizes = [np.array([len(t) for t in x], np.int64) for x in (a_bytes, self.b.bytes)]
        most = max(map(len, self.sizes))
        shown = [str(i) for i in range(most)]
        self.shown = {mark: np.array([s + mark for s in shown], object) for mark in ",|;"}


@functools.cache
def shared(a: str, b: str) -> Vocabularies:
    return Vocabularies(a, b)


def tokens(both: Vocabularies, text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of A and B, or None where there are none or one of them doesn't cover the text's bytes."""
    if not text:
        return None
    a, b = np.frombuffer(both.a.encode(" " + text), np.uint16).astype(np.int32), both.b.encode(text)
    want = b" " + text.encode()
    for ids, table in zip((a, b), both.bytes, strict=True):
        if b"".join(table[ids]) != want:
            return None
    return a, b


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Byte places that cut a text into lanes: token ends of both, ``lane`` bytes apart at least; its end at last."""
    size = int(ends_a[-1])
    out, at = [], lane
    while at < size:
        near = ends_a[np.searchsorted(ends_a, at) : np.searchsorted(ends_a, at + lane, "right")]
        place = np.searchsorted(ends_b, near)
        met = near[ends_b[np.minimum(place, len(ends_b) - 1)] == near]
        # Without a common end nearby the lane grows.
        if len(met) and met[0] < size:
            out.append(int(met[0]))
            at = int(met[0])
        at += lane
    return np.array([*out, size], np.int64)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, begin_a: np.ndarray, begin_b: np.ndarray, stop_a: np.ndarray):
    """Links (a, b) and cuts (a, b) of all lanes at once, as token numbers.

    ``ends_*`` are the byte ends of all tokens, rising within a lane; lane i's tokens begin at
    begin_*[i], and its A tokens stop before stop_a[i]. Both lists of a lane end at the same byte.
    """
    at_a, at_b, stop = begin_a.copy(), begin_b.copy(), stop_a
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(at_a):
        links_a.append(at_a)
        links_b.append(at_b)
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        both = end_a == end_b
        cuts_a.append(at_a[both])
        cuts_b.append(at_b[both])
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        if (at_a >= stop).any():
            going = at_a < stop
            at_a, at_b, stop = at_a[going], at_b[going], stop[going]
    empty = [np.zeros(0, np.int32)]
    return tuple(np.concatenate(x or empty) for x in (links_a, links_b, cuts_a, cuts_b))


def written(both: Vocabularies, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3`` of one document; cuts are the last tokens of its groups."""
    mark_a, mark_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    mark_a[cut_a], mark_b[cut_b] = True, True
    out = np.empty(len(a) + len(b), object)
    # A token of A comes behind all B tokens of earlier groups, one of B behind all A tokens up to its group's.
    group_a = np.cumsum(mark_a) - mark_a
    group_b = np.cumsum(mark_b) - mark_b
    out[np.arange(len(a)) + np.concatenate([[0], cut_b + 1])[group_a]] = np.where(mark_a, both.shown["|"][a], both.shown[","][a])
    out[np.arange(len(b)) + cut_a[group_b] + 1] = np.where(mark_b, both.shown[";"][b], both.shown[","][b])
    return "".join(out)[:-1]


def align(both: Vocabularies, texts: list[str], lane: int = LANE) -> dict[str, np.ndarray | list]:
    """What a block of texts gives: counts by document, group digests, and all links with their documents."""
    found = [tokens(both, t) for t in texts]
    empty = np.zeros(0, np.int32)
    ids = [[x[side] if x else empty for x in found] for side in (0, 1)]
    begins = [np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64) for side in ids]
    flat = [np.concatenate(side) if side else empty for side in ids]
    ends = [np.cumsum(size[x]) for size, x in zip(both.sizes, flat, strict=True)]
    lane_a, lane_b, stop_a = [], [], []
    for i, x in enumerate(found):
        if x is None:
            continue
        own = [e[s[i] : s[i + 1]] for e, s in zip(ends, begins, strict=True)]
        start = own[0][0] - both.sizes[0][flat[0][begins[0][i]]]
        last = lanes(own[0] - start, own[1] - start, lane)
        cut = [begins[k][i] + np.searchsorted(own[k] - start, last) + 1 for k in (0, 1)]
        lane_a.append(np.concatenate([begins[0][i : i + 1], cut[0][:-1]]))
        lane_b.append(np.concatenate([begins[1][i : i + 1], cut[1][:-1]]))
        stop_a.append(cut[0])
    # Token numbers within a block fit 32 bits.
    lists = [np.concatenate(x or [empty]).astype(np.int32) for x in (lane_a, lane_b, stop_a)]
    link_a, link_b, cut_a, cut_b = lockstep(ends[0], ends[1], *lists)
    cut_a, cut_b = np.sort(cut_a), np.sort(cut_b)
    at = np.searchsorted(cut_a, begins[0])
    digests = []
    for i, x in enumerate(found):
        if x is None:
            digests.append("")
            continue
        mine = slice(at[i], at[i + 1])
        text = written(both, *x, cut_a[mine] - begins[0][i], cut_b[mine] - begins[1][i])
        digests.append(hashlib.sha256(text.encode()).hexdigest())
    owner = (np.searchsorted(begins[0], link_a, "right") - 1).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    key = flat[0][link_a].astype(np.int64) << 32 | flat[1][link_b]
    del link_a, link_b
    return {
        "n_a": np.diff(begins[0]), "n_b": np.diff(begins[1]), "n_groups": np.diff(at), "digests": digests,
        "n_links": np.bincount(owner, minlength=len(texts)), "keys": key[order],
    }


def _blocks(a: str, b: str, limit: int):
    def run(source: Iterator[pa.RecordBatch]):
        both, base, seq = shared(a, b), TaskContext.get().partitionId() << 32, 0
        for table in hashing.batches(source, "text", limit):
            texts = [t.decode() for t in table.column("text").to_pylist()]
            got = align(both, texts)
            codes, pairs = pd.factorize(got["keys"])
            n = np.bincount(codes, minlength=len(pairs))
            # Frequent pairs get small numbers, which pack well.
            rank = np.argsort(-n, kind="stable")
            place = np.empty(len(rank), np.uint32)
            place[rank] = np.arange(len(rank), dtype=np.uint32)
            lists = lambda x, kind=pa.int64(): pa.array([x], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([
                pa.array([base + seq], pa.int64()), lists(table.column("doc_id").to_pylist()),
                *[lists(got[k]) for k in ("n_a", "n_b", "n_groups", "n_links")], lists(got["digests"], pa.string()),
                lists(pairs[rank]), lists(n[rank]), pa.array([pack(place[codes])], pa.binary()),
            ], names=["block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pairs", "counts", "codes"])
            seq += 1

    return run


def _summed(source: Iterator[pa.RecordBatch]):
    """Per document the links whose count is their B id's highest, and the sum of counts over links."""
    for batch in source:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            codes = unpack(row["codes"].as_py(), np.uint32)
            known = row["known"].values
            place = known.field("i").to_numpy() if known is not None else np.zeros(0, np.int64)
            count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            if known is not None:
                count[place] = known.field("total").to_numpy()
                best[place] = known.field("best").to_numpy(zero_copy_only=False)
            n_links = row["n_links"].values.to_numpy()
            edge = np.concatenate([[0], np.cumsum(n_links)])
            sums = [np.concatenate([[0], np.cumsum(x[codes])]) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([
                row["doc_ids"].values, *[row[k].values for k in ("n_a", "n_b", "n_groups", "n_links")],
                *[pa.array(s[edge[1:]] - s[edge[:-1]], pa.int64()) for s in sums], row["digests"].values,
            ], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, total, best): links of each id pair in the corpus, and whether no pair with the same B id has more."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    total = settle(pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # A B id's pairs are combined in each task before they meet.
    most = total.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    return total.withColumn("b", b).join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align_documents(
    docs: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``docs`` has doc_id and text; other columns are ignored. Special strings inside texts are plain text.
    NULL and empty texts, and those whose tokens of A or B don't cover exactly a
    blank and the text (B has no sign for the blank's own stand-in), have no tokens: all zero, and ''
    as digest. Rows are aligned one by one, whether ids repeat or are NULL, and all
    count for the corpus. An empty table gives an empty result.
    """
    docs = id_and_text(docs).withColumn("text", F.col("text").cast("binary"))
    blocks = settle(docs.mapInArrow(_blocks(a, b, block_bytes), BLOCKS), "aligned-blocks")
    asked = blocks.select("block", F.posexplode("pairs").alias("i", "pair"))
    # A block's distinct pairs are bounded by the block's bytes.
    known = asked.join(pair_counts(blocks), "pair").groupBy("block").agg(
        F.collect_list(F.struct("i", "total", "best")).alias("known"))
    return blocks.drop("pairs", "counts").join(known, "block", "left").mapInArrow(_summed, OUT)
