"""Benchmark decontamination with spaced seeds.

Each mask keeps some of a run of words and ignores the others, so a run with
substituted words still has a hash in common with the original as long as one
mask ignores the substituted places. Masks are chosen by enumeration: however the
allowed substitutions are placed in a stretch, one mask keeps none of them, for
the window and for each shorter item's own size. Hashes of all places of the
benchmark are joined with those of all places of the documents; around each hit
the two word sequences are laid side by side and compared.

The benchmark is a stated query set: it is read in blocks of at most
``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes of text, each broadcast to one
pass over the documents, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm import hashing
from cinderlog.llm.common import id_and_text, settle, with_whole

WINDOW = 13
SHARE = 0.8
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20
BITS = 22
# Masks of one size at most, and the size up to which they are enumerated.
MOST_MASKS = 5
ENUMERATED = 14


def misses(size: int, share: float) -> int:
    """How many of ``size`` words may differ when at least ``share`` of them are equal."""
    return min(sum(equal >= share * size for equal in range(size)), size - 1)


@functools.cache
def masks_for(size: int, wrong: int) -> tuple[tuple[int, ...], ...]:
    """Masks of which, wherever ``wrong`` of ``size`` words differ, one fits at some place on equal words only.

    The heaviest weight that at most ``MOST_MASKS`` masks can do. A run of equal
    words, which the pigeonhole leaves in any case, is the mask where no such
    weight is found or the size is too large to enumerate.
    """
    if size <= ENUMERATED:
        placings = list(itertools.combinations(range(size), wrong))
        run = -(-(size - wrong) // (wrong + 1))
        for weight in range(size - wrong, run, -1):
            if found := _cover(size, placings, weight):
                return found
    return (tuple(range(-(-(size - wrong) // (wrong + 1)))),)


def _cover(size: int, placings: list[tuple[int, ...]], weight: int) -> tuple[tuple[int, ...], ...] | None:
    """Few masks of ``weight`` that leave no placing out, chosen greedily, or None."""
    gains = {}
    for rest in itertools.combinations(range(1, size), weight - 1):
        mask = (0, *rest)
        shifted = [{place + by for place in mask} for by in range(size - mask[-1])]
        gains[mask] = sum(1 << bit for bit, placing in enumerate(placings) if any(own.isdisjoint(placing) for own in shifted))
    left, chosen = (1 << len(placings)) - 1, []
    while left and len(chosen) < MOST_MASKS:
        chosen.append(max(gains, key=lambda mask: ((gains[mask] & left).bit_count(), -mask[-1])))
        left &= ~gains[chosen[-1]]
    return None if left else tuple(chosen)


def mask_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of each place where the whole mask fits."""
    n = max(len(words) - mask[-1], 0)
    total = np.zeros(n, np.uint64)
    for j in mask:
        total = total * hashing.BASE + words[j : j + n]
    return hashing.mix(total)


class Block:
    """Seeds of some benchmark items: sorted hashes with their place among the items' words."""

    def __init__(self, ids: list[int], texts: list[bytes], window: int = WINDOW, share: float = SHARE) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.ids = ids
        self.words, self.begins = hashing.words(data, rows)
        # An item shorter than the window is compared as a whole, so it has the masks of its own size.
        stretch = np.minimum(np.diff(self.begins), window)
        self.tables = []
        for size in np.unique(stretch[stretch > 0]).tolist():
            own = np.flatnonzero(stretch == size)
            for mask in masks_for(size, misses(size, share)):
                self.tables.append((mask, *self._seeds(own, mask)))

    def _seeds(self, items: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted seeds of ``items``, their places, and a table of the seeds' leading bits."""
        counts = np.diff(self.begins)[items] - mask[-1]
        place = np.repeat(self.begins[items], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = mask_hashes(self.words, mask)[place]
        order = np.argsort(seed, kind="stable")
        bits = np.zeros(1 << min(BITS, 6 + len(seed).bit_length()), bool)
        bits[seed >> _unused(bits)] = True
        return seed[order], place[order].astype(np.int32), bits

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``words``, item, place in the item) of every equal seed."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for mask, seeds, place, bits in self.tables:
            own = mask_hashes(words, mask)
            at = np.flatnonzero(bits[own >> _unused(bits)])
            low, high = np.searchsorted(seeds, own[at], "left"), np.searchsorted(seeds, own[at], "right")
            n = high - low
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((np.repeat(at, n), place[which]))
        at, place = (np.concatenate(x) for x in zip(*found, strict=True))
        item = np.searchsorted(self.begins, place, "right") - 1
        return at, item, place - self.begins[item]


def _unused(bits: np.ndarray) -> np.uint64:
    """By how much a hash is shifted to be a place in ``bits``."""
    return np.uint64(64 - (len(bits).bit_length() - 1))


def overlap(words: np.ndarray, item: np.ndarray, shift: int, window: int, share: float) -> int:
    """Equal words in the best stretch of ``window`` words with word ``shift + j`` beside item word j, or 0.

    The stretch is the whole item if that is shorter. 0 if fewer than ``share``
    of its words are equal.
    """
    size = min(window, len(item))
    a, b = max(shift, 0), min(shift + len(item), len(words))
    if b - a < size:
        return 0
    same = np.concatenate([[0], np.cumsum(words[a:b] == item[a - shift : b - shift])])
    best = int((same[size:] - same[:-size]).max())
    return int(same[-1]) if best >= share * size else 0


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, block_items: int = BLOCK_ITEMS,
    block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids, n_matched_words.

    ``docs`` has doc_id and text; other columns are
    ignored, or kept in ``whole`` with ``carry``; ``benchmark`` has ``item_col`` and
    text. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document
    is contaminated by an item when some stretch of ``window`` words (or the whole
    item, if shorter) has at least ``share`` of its words equal at equal
    places. item_ids are sorted and distinct; n_matched_words is the largest
    number of equal words along one alignment.

    A NULL or empty text, or an empty benchmark, gives a clean row; items without
    words and items with a NULL id or text are ignored. Rows that repeat an id
    are judged one by one.
    """
    docs = id_and_text(docs, carry)
    items = settle(
        benchmark.select(F.col(item_col).cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
        .where("id is not null and text is not null"), "seed-items",
    )
    out = docs.select("*", F.array().cast("array<long>").alias("item_ids"), F.lit(0).alias("n"))
    blocks = _blocks(items, block_items, block_bytes)
    block = next(blocks, None)
    while block is not None:
        seeds = docs.sparkSession.sparkContext.broadcast(Block(*block, window, share))
        block = next(blocks, None)
        out = _scan(out, seeds, window, share, last=block is None)
        if block is not None:
            out = settle(out, "seed-leaks")
    return out.select(
        "doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"),
        F.col("n").alias("n_matched_words"), *["whole"] * carry,
    )


def _blocks(items: DataFrame, most: int, size: int):
    """The benchmark in blocks of bounded size, one in memory at a time."""
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        if ids and (len(ids) >= most or held + len(row.text) > size):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row.id)
        texts.append(bytes(row.text))
        held += len(row.text)
    if ids:
        yield ids, texts


def _scan(docs: DataFrame, block, window: int, share: float, last: bool) -> DataFrame:
    """Add the leaks of one block; the last pass hands no text on."""

    def scan(source):
        seeds = block.value
        for table in hashing.batches(source, "text"):
            found, begins = hashing.words(*hashing.flat(table, "text"))
            items, most = table.column("item_ids").to_pylist(), table.column("n").to_numpy().copy()
            place, item, at = seeds.hits(found)
            row = np.searchsorted(begins, place, "right") - 1
            pairs = np.unique(np.stack([row, item, place - at]), axis=1) if len(row) else np.zeros((3, 0), np.int64)
            for r, i, shift in pairs.T.tolist():
                own = found[begins[r] : begins[r + 1]]
                target = seeds.words[seeds.begins[i] : seeds.begins[i + 1]]
                n = overlap(own, target, shift - int(begins[r]), window, share)
                if n:
                    items[r].append(seeds.ids[i])
                    most[r] = max(most[r], n)
            texts = pa.nulls(len(items), pa.binary()) if last else table.column("text")
            out = pa.table({
                "doc_id": table.column("doc_id"), "text": texts, "item_ids": pa.array(items, pa.list_(pa.int64())),
                "n": pa.array(most, pa.int32()),
            })
            if "whole" in table.column_names:
                out = out.append_column("whole", table.column("whole"))
            yield from out.combine_chunks().to_batches()

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(
        scan, with_whole("doc_id long, text binary, item_ids array<long>, n int", docs)
    )
