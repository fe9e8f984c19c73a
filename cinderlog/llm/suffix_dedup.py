"""Repeated strings of a corpus by longest-previous-factor arrays.

A string of ``length`` bytes that occurs twice contains a gram of half that length
whose hash is the least of all grams in it, and both occurrences choose the
same one. So every text is marked at the least gram of each of its windows, about
two marks in a hundred bytes, and only marks with equal grams can belong to
equal strings. The context of a mark is all that a window with this mark can reach.

1. Marks are sorted by (gram, context) in Spark and read as a stream. A gram
   seen once is dropped. Equal contexts repeat as a whole.
2. Of the others with a repeated gram the context's bytes are fetched. The
   contexts of one gram are a local text whose suffixes, from each distance left
   of the gram, are put in suffix order: once by sorting, then for each distance by
   the byte before, as order at the next distance. Neighbours that agree on
   ``length`` bytes form runs; within a run the previous and next smaller
   positions in suffix order are the longest-previous-factor entries of at least
   ``length``: who has one has an earlier match.
3. Grams with more than ``HOT`` different contexts aren't gathered: each window of
   theirs becomes a row of its own, and equal ones meet in Spark's sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm import hashing
from cinderlog.llm.common import id_and_text, placed, settle

LENGTH = 200
HOT = 20_000
# Contexts sorted at a time.
LOT = 4096

U = np.uint64
MARKS = "key long, ord int, doc_id long, pos int, gram long, context long"
KINDS = "key long, ord int, pos int, gram long, kind int"
CONTEXTS = "bucket long, second long, doc_id long, key long, ord int, pos int, reach int, bytes binary"
FOUND = "key long, ord int, start int, stop int"
ALONE, REPEATED, FIRST = 1, 2, 3


def slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of values[i : i + width] for each i that has so many."""
    n = len(values)
    if n < width:
        return values[:0]
    room = -(-n // width) * width
    padded = np.empty(room, values.dtype)
    padded[:n], padded[n:] = values, values[-1]
    grid = padded.reshape(-1, width)
    down = best.accumulate(grid, axis=1).ravel()
    up = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(up[: n - width + 1], down[width - 1 : n])


def marks(data: np.ndarray, rows: np.ndarray, length: int):
    """(row, position, gram hash, context hash) of the marks of all rows."""
    gram, row_of = length // 2, np.searchsorted
    span = length - gram + 1
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sums = hashing.running(data)
    _, down = hashing.POWERS.get(len(sums))
    n = len(data) - gram + 1
    grams = hashing.mix((sums[gram:] - sums[:-gram]) * down[:n])
    least = slide(grams, span, np.minimum)
    # A window is within one row; others choose nothing.
    inside = np.zeros(len(least) + 1, np.int32)
    sizes = np.diff(rows)
    first, after = rows[:-1], np.maximum(rows[1:] - length + 1, rows[:-1])
    np.add.at(inside, np.minimum(first, len(least)), 1)
    np.add.at(inside, np.minimum(after, len(least)), -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, U(0))
    edge = np.zeros(span - 1, np.uint64)
    chosen = slide(np.concatenate([edge, least, edge]), span, np.maximum)
    at = np.flatnonzero((chosen[:n] == grams) & (grams > 0))
    row = row_of(rows, at, "right") - 1
    row = np.minimum(row, len(sizes) - 1)
    start = np.maximum(at - (length - gram), rows[row])
    stop = np.minimum(at + length, rows[row + 1])
    whole = (sums[stop] - sums[start]) * down[start]
    context = hashing.mix((whole ^ U(0xA5A5A5A5)) + (at - start).astype(np.uint64) * hashing.BASE + (stop - start).astype(np.uint64))
    return row, at - rows[row], grams[at], context


def _marks(length: int):
    def run(source):
        for table in hashing.batches(source, "text", 1 << 20):
            row, pos, gram, context = marks(*hashing.flat(table, "text"), length)
            own = table.select(["key", "ord", "doc_id"]).take(pa.array(row))
            columns = [*own.columns, pa.array(pos, pa.int32()), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))]
            yield from pa.table(columns, names=["key", "ord", "doc_id", "pos", "gram", "context"]).combine_chunks().to_batches()

    return run


def _kinds(source):
    """Of marks sorted by (gram, context, place): those with a gram seen before or after, and whether the context is."""
    held, twins = None, (False, False)
    for batch in source:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        gram, context = table.column("gram").to_numpy(), table.column("context").to_numpy()
        same_gram = gram[1:] == gram[:-1]
        same = same_gram & (context[1:] == context[:-1])
        gram_before, before = np.concatenate([[twins[0]], same_gram]), np.concatenate([[twins[1]], same])
        after = np.append(same, False)
        kind = np.where(before, REPEATED, np.where(after, FIRST, ALONE))
        many = gram_before | np.append(same_gram, False)
        held, twins = table.slice(len(gram) - 1), (bool(gram_before[-1]), bool(before[-1]))
        yield from _kept(table.slice(0, len(gram) - 1), many[:-1], kind[:-1])
    if held is not None and twins[0]:
        yield from _kept(held, np.array([True]), np.array([REPEATED if twins[1] else ALONE]))


def _kept(table: pa.Table, keep: np.ndarray, kind: np.ndarray):
    out = table.select(["key", "ord", "pos", "gram"]).append_column("kind", pa.array(kind, pa.int32()))
    yield from out.filter(pa.array(keep)).combine_chunks().to_batches()


def _contexts(length: int):
    """Bytes of the contexts of wanted marks, or, for hot grams, hashes of their windows."""
    reach = length - length // 2

    def run(source):
        for batch in source:
            out = {c: [] for c in ("bucket", "second", "doc_id", "key", "ord", "pos", "reach", "bytes")}
            for row in batch.to_pylist():
                text = row["text"]
                for m in row["marks"]:
                    if m["ord"] != row["ord"]:
                        continue
                    pos = m["pos"]
                    start = max(0, pos - reach)
                    piece = text[start : pos + length]
                    if not m["hot"]:
                        rows = [(m["gram"], 0, pos, pos - start, piece)]
                    else:
                        sums = hashing.running(np.frombuffer(piece, np.uint8))
                        at = np.arange(len(piece) - length + 1)
                        one = hashing.stretch(sums, at, at + length)
                        # A second, independent hash of the same window.
                        other = hashing.running(np.frombuffer(piece, np.uint8), hashing.BYTE_VALUES[::-1] ^ U(0x1F3D5B79))
                        two = hashing.stretch(other, at, at + length)
                        rows = [(a, b, start + i, -1, None) for i, (a, b) in enumerate(zip(
                            one.view(np.int64).tolist(), two.view(np.int64).tolist(), strict=True)) if start + i <= pos]
                    for bucket, second, place, left, raw in rows:
                        for c, v in zip(out, (bucket, second, row["doc_id"], row["key"], row["ord"], place, left, raw), strict=True):
                            out[c].append(v)
            kinds = dict(zip(out, (pa.int64(),) * 4 + (pa.int32(),) * 3 + (pa.binary(),), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in out.items()], names=list(out))

    return run


def earlier(rank: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Whether a previous or next smaller rank exists in the same run of the suffix order."""
    big = np.int64(len(rank) + 1)
    falling, rising = rank - run * big, rank + run * big
    out = np.zeros(len(rank), bool)
    out[1:] = np.minimum.accumulate(falling)[:-1] < falling[1:]
    out[:-1] |= np.minimum.accumulate(rising[::-1])[::-1][1:] < rising[:-1]
    return out


def matches(group: np.ndarray, pieces: list[bytes], left: np.ndarray, length: int, keep_first: bool):
    """(context, distance) of the windows with an equal one (an earlier one, if ``keep_first``) in their group.

    ``group`` rises; contexts of a group are in the order of their places. The
    window at distance d begins d bytes before the gram.
    """
    reach, n = length - length // 2, len(pieces)
    text = np.zeros((n, reach + length), np.uint8)
    right = np.array([len(p) for p in pieces]) - left
    for i, p in enumerate(pieces):
        text[i, reach - left[i] : reach + right[i]] = np.frombuffer(p, np.uint8)
    head = np.ascontiguousarray(group.astype(">u4")).view(np.uint8).reshape(n, 4)
    rows = np.ascontiguousarray(np.concatenate([head, text[:, reach:]], axis=1))
    order = np.argsort(rows.view(f"S{length + 4}").ravel(), kind="stable")
    out = []
    for distance in range(reach + 1):
        if distance:
            before = group[order] * 256 + text[order, reach - distance]
            order = order[np.argsort(before, kind="stable")]
        valid = order[(left[order] >= distance) & (right[order] >= length - distance)]
        if len(valid) < 2:
            continue
        near = np.flatnonzero(group[valid[1:]] == group[valid[:-1]])
        window = text[:, reach - distance : reach - distance + length]
        equal = np.zeros(len(valid) - 1, bool)
        equal[near] = (window[valid[near]] == window[valid[near + 1]]).all(axis=1)
        run = np.concatenate([[0], np.cumsum(~equal)])
        if keep_first:
            hit = earlier(valid, run)
        else:
            hit = np.append(equal, False) | np.concatenate([[False], equal])
        out.append((valid[hit], np.full(int(hit.sum()), distance)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matches(length: int, keep_first: bool):
    """Of contexts sorted by (bucket, second, place): stretches of the texts that repeat."""

    def local(table: pa.Table):
        bucket = table.column("bucket").to_numpy()
        group = np.concatenate([[0], np.cumsum(bucket[1:] != bucket[:-1])])
        pos = table.column("pos").to_numpy().astype(np.int64)
        who, distance = matches(group, table.column("bytes").to_pylist(), table.column("reach").to_numpy().astype(np.int64), length, keep_first)
        order = np.lexsort((distance, who))
        who, distance = who[order], distance[order]
        first = np.ones(len(who), bool)
        first[1:] = (who[1:] != who[:-1]) | (distance[1:] != distance[:-1] + 1)
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(who)) - 1 if len(begin) else begin
        return who[begin], pos[who[begin]] - distance[end], pos[who[begin]] - distance[begin] + length

    def found(table, who, start, stop):
        own = table.select(["key", "ord"]).take(pa.array(who))
        columns = [*own.columns, pa.array(start, pa.int32()), pa.array(stop, pa.int32())]
        yield from pa.table(columns, names=["key", "ord", "start", "stop"]).combine_chunks().to_batches()

    def windows(table: pa.Table, before: tuple | None):
        """Windows of hot grams by their hashes: neighbours decide. ``before`` is the last row seen."""
        columns = ("bucket", "second", "key", "ord", "pos")
        rows = np.stack([table.column(c).to_numpy().astype(np.int64) for c in columns])
        last, hit_before = before if before else (np.zeros(5, np.int64), False)
        if before:
            rows = np.concatenate([last[:, None], rows], axis=1)
        # Several marks can emit one and the same window.
        keep = np.ones(rows.shape[1], bool)
        keep[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        rows = rows[:, keep]
        same = np.concatenate([[hit_before], (rows[:2, 1:] == rows[:2, :-1]).all(axis=0)])
        hit = same if keep_first else same | np.append(same[1:], False)
        who = rows[:, hit]
        return (rows[:, -1], bool(same[-1])), pa.RecordBatch.from_arrays([
            pa.array(who[2]), pa.array(who[3], pa.int32()), pa.array(who[4], pa.int32()), pa.array(who[4] + length, pa.int32()),
        ], names=["key", "ord", "start", "stop"])

    def run(source):
        held, before = None, None
        for batch in source:
            table = pa.Table.from_batches([batch])
            hot = pa.compute.less(table.column("reach"), 0)
            if (one := table.filter(hot)).num_rows:
                before, out = windows(one, before)
                yield out
            table = table.filter(pa.compute.invert(hot))
            if table.num_rows:
                held = table if held is None else pa.concat_tables([held, table])
            if held is not None and held.num_rows >= LOT:
                own = held.column("bucket").to_numpy()
                cut = int(np.searchsorted(own, own[-1]))
                if cut:
                    yield from found(held, *local(held.slice(0, cut).combine_chunks()))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from found(held, *local(held.combine_chunks()))

    return run


def _cut(source):
    """Texts without the listed stretches."""
    for batch in source:
        out = {c: [] for c in ("doc_id", "n_bytes", "spans", "kept")}
        for row in batch.to_pylist():
            spans: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in row["found"] or [] if x["ord"] == row["ord"]):
                if spans and s[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s[1])
                else:
                    spans.append(list(s))
            text, at, kept = row["text"], 0, []
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            for c, v in zip(out, (row["doc_id"], len(text), [{"start": a, "stop": b} for a, b in spans], b"".join(kept)), strict=True):
                out[c].append(v)
        spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), spans, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """Texts without their repeated strings of ``length`` bytes.

    ``docs`` has doc_id and text; other columns are ignored; texts are taken as UTF-8 bytes and
    matches never cross documents. Without ``keep_first`` every byte is removed that
    some string of ``length`` bytes covers which also starts anywhere else, in the
    same text or another; with it, only bytes of strings that have an earlier
    occurrence, by (doc_id, place), so that the first one stays.

    Returns one row per input row: doc_id, n_bytes, spans (the maximal removed
    stretches, [start, stop) in bytes), kept (the remaining bytes).

    A NULL text is empty and, like all texts shorter than ``length``, loses nothing.
    Rows that repeat an id are different texts; a NULL id comes first. An empty
    table gives an empty result.
    """
    base = placed(id_and_text(docs)).withColumn("text", F.col("text").cast("binary"))
    found = base.mapInArrow(_marks(length), MARKS).repartition("gram").sortWithinPartitions("gram", "context", "doc_id", "key", "ord", "pos")
    kinds = settle(found.mapInArrow(_kinds, KINDS), "gram-marks")
    open_grams = kinds.groupBy("gram").agg(
        F.count_if(F.col("kind") != REPEATED).alias("contexts"), F.count_if(F.col("kind") == ALONE).alias("alone")
    ).where("contexts > 1").select("gram", (F.col("contexts") > hot).alias("hot"))
    wanted = kinds.where(F.col("kind") != REPEATED).join(open_grams, "gram").groupBy("key").agg(
        F.collect_list(F.struct("ord", "pos", "gram", "hot")).alias("marks"))
    contexts = base.join(wanted, "key").mapInArrow(_contexts(length), CONTEXTS)
    dealt = contexts.repartition("bucket").sortWithinPartitions("bucket", "second", "doc_id", "key", "ord", "pos")
    partial = settle(dealt.mapInArrow(_matches(length, keep_first), FOUND), "repeats")
    whole = kinds.where(F.col("kind").isin([REPEATED] if keep_first else [REPEATED, FIRST]))
    reach = length - length // 2
    texts = base.select("key", "ord", F.octet_length("text").alias("size"))
    ends = whole.join(texts, ["key", "ord"]).select(
        "key", "ord", F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), F.least(F.col("pos") + length, "size").alias("stop")
    ).where(F.col("stop") - F.col("start") >= length)
    every = partial.union(ends).groupBy("key").agg(F.collect_list(F.struct("ord", "start", "stop")).alias("found"))
    return base.join(every, "key", "left").select("doc_id", "ord", "text", "found").mapInArrow(
        _cut, "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary"
    )
