"""Deleted interpolation of n-gram models.

Maximum-likelihood estimates of all orders are mixed from the lowest up:

    p_k(w | h) = a * c(h w) / c(h) + (1 - a) * p_{k-1}(w | h'),

where h' drops the first word of h and the weight a belongs to the order and to
the bucket of c(h), one bucket per doubling. The lowest order is the contract's
smoothed word model. Weights are learned by expectation-maximisation on the
tokens of a held-out fold of the training rows, against counts from which that
fold is deleted; the final counts are of all training rows. Counts are kept of
every n-gram of the corpus, in parts that grow with it (see ``blocks``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm import hashing
from cinderlog.llm.blocks import BlockTable, pack, rows_of, unpack

ORDER = 3
# Text of a block; some thirty bytes of arrays stand beside each of its bytes.
BLOCK_BYTES = 8 << 20
FOLDS = 10
LEARN_FOLD = 1
BUCKETS = 24
# Steps per factor of ten in the statistics EM works on, whose size is thereby fixed.
FINE = 16
ROUNDS = 60
END, BEGIN = b"\x00end", b"\x00begin"
# Kinds of answers: counts of all training rows, and of those outside the learning fold.
ALL, DELETED = "all", "deleted"
STATS = "bucket int, ml int, low int, n long"


def fold_of(doc_id) -> int:
    """crc32 of the id's text modulo FOLDS; a NULL id counts as held out."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(np.float64))[1], BUCKETS - 1)


class Sequence:
    """Tokens of a block, or of its documents in one fold: for each its code and place; END closes a document."""

    def __init__(self, block, fold: int | None = None) -> None:
        n = len(block.words)
        data = np.frombuffer(b"".join([*block.words, END, BEGIN]), np.uint8)
        ends = np.cumsum([0, *map(len, block.words), len(END), len(BEGIN)])
        self.hashes = hashing.stretch(hashing.running(data), ends[:-1], ends[1:])
        folds = np.array([fold_of(i) for i in block.doc_ids], np.int8)
        sizes, codes = block.sizes, block.codes
        if fold is not None:
            codes = codes[np.repeat(folds == fold, sizes)]
            sizes, folds = sizes[folds == fold], folds[folds == fold]
        lengths = sizes + 1
        self.begins = np.cumsum(lengths) - lengths
        self.codes = np.full(int(lengths.sum()), n, np.int32)
        inner = np.ones(len(self.codes), bool)
        inner[self.begins + sizes] = False
        self.codes[inner] = codes
        self.place = (np.arange(len(self.codes)) - np.repeat(self.begins, lengths)).astype(np.int32)
        self.fold = np.repeat(folds, lengths)
        self.n_begin = n + 1

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, hashes) of the n-grams of one order; BEGIN stands before a document once."""
        if order == 1:
            return np.arange(len(self.codes)), self.hashes[self.codes]
        at = np.flatnonzero(self.place >= order - 2)
        total = np.zeros(len(at), np.uint64)
        for back in range(order - 1, -1, -1):
            code = self.codes[np.maximum(at - back, 0)]
            if back == order - 1:
                code = np.where(self.place[at] >= back, code, self.n_begin)
            total = total * hashing.BASE + self.hashes[code]
        return at, hashing.mix(total + np.uint64(order))

    def distinct(self, order: int, parts: int):
        """Distinct keys in the order asked, part begins, and of each n-gram its key's number."""
        at, keys = self.keys(order)
        unique, which = np.unique(keys, return_inverse=True)
        part = (unique % np.uint64(parts)).astype(np.int64)
        dealt = np.argsort(part, kind="stable")
        number = np.empty(len(dealt), np.int64)
        number[dealt] = np.arange(len(dealt))
        return at, unique[dealt], np.searchsorted(part[dealt], np.arange(parts + 1)), number[which]

    def counts(self, order: int, parts: int, answers: dict[int, bytes]):
        """For each token its n-gram's count as answered; 0 where there is none."""
        at, keys, begins, number = self.distinct(order, parts)
        found = np.zeros(len(keys), np.int64)
        for p in np.flatnonzero(np.diff(begins)).tolist():
            found[begins[p] : begins[p + 1]] = unpack(answers[p], np.uint64)
        out = np.zeros(len(self.codes), np.int64)
        out[at] = found[number]
        return out


def _questions(order: int, parts: int):
    def ask(block, _):
        seq = Sequence(block)
        at, keys, begins, number = seq.distinct(order, parts)
        fold = seq.fold[at]
        own = np.bincount(number[fold != 0], minlength=len(keys)).astype(np.uint32)
        learn = np.bincount(number[fold == LEARN_FOLD], minlength=len(keys)).astype(np.uint32)
        for p in np.flatnonzero(np.diff(begins)).tolist():
            a, b = begins[p], begins[p + 1]
            gaps = np.diff(keys[a:b], prepend=np.uint64(0))
            fields = [pack(gaps), pack(own[a:b]), pack(learn[a:b])]
            yield p, b"".join(len(f).to_bytes(8, "little") + f for f in fields)

    return ask


def _fields(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _sum(rows):
    """Answers of a part, over all blocks: of each key of a block its count, of those its documents in the
    learning fold hold the count without that fold, and a summary as block -1."""
    asked = [(b, _fields(q)) for b, q in rows]
    keys = [np.cumsum(unpack(f[0], np.uint64), dtype=np.uint64) for _, f in asked]
    unique, which = np.unique(np.concatenate(keys), return_inverse=True)
    # Sums of 32-bit counts are exact in 64-bit floats.
    both = np.stack([
        np.bincount(which, np.concatenate([unpack(f[i], np.uint32) for _, f in asked]), len(unique)).astype(np.uint64) for i in (1, 2)
    ])
    at = 0
    for (b, f), k in zip(asked, keys, strict=True):
        total, learn = both[:, which[at : at + len(k)]]
        yield b, ALL, pack(total)
        taught = unpack(f[2], np.uint32) > 0
        if taught.any():
            yield b, DELETED, pack((total - learn)[taught])
        at += len(k)
    summary = [(both[0] > 0).sum(), both[0].sum(), (both[0] > both[1]).sum(), (both[0] - both[1]).sum()]
    yield -1, "summary", np.array(summary, np.uint64).tobytes()


class Model:
    """Totals, weights by order and bucket, and the numbers of parts asked."""

    def __init__(self, order: int, parts: list[int], totals: np.ndarray, docs: np.ndarray) -> None:
        self.order, self.parts, self.totals, self.docs = order, parts, totals, docs
        self.weights: dict[int, np.ndarray] = {}

    def base(self, count: np.ndarray, deleted: bool) -> np.ndarray:
        v, n = self.totals[2:] if deleted else self.totals[:2]
        return (count + 0.1) / (n + 0.1 * (v + 1))

    def probabilities(self, seq: Sequence, given: dict, upto: int, deleted: bool):
        """p of the highest order, and the last step's estimate, lower p and context count."""
        def known(k):
            return seq.counts(k, self.parts[k - 1], given.get(f"{DELETED if deleted else ALL}-{k}", {}))

        count = known(1)
        unigram = count
        p = low = self.base(count, deleted)
        ml, context = np.zeros(len(p)), np.zeros(len(p), np.int64)
        for k in range(2, upto + 1):
            # The context's count is that of the previous order's n-gram one token before.
            context = np.zeros(len(count), np.int64)
            context[1:] = count[:-1]
            context[seq.place < k - 2] = 0
            if k == 2:
                context[seq.begins] = self.docs[int(deleted)]
            count = known(k)
            ml = np.where(context > 0, count / np.maximum(context, 1), 0.0)
            low = p
            if k in self.weights:
                a = np.where(context > 0, self.weights[k][bucket(context)], 0.0)
                p = a * ml + (1 - a) * low
        return p, ml, low, context, unigram


def _stats(model: Model, k: int):
    def run(source):
        for block, given in rows_of(source):
            seq = Sequence(block, LEARN_FOLD)
            if not len(seq.codes):
                continue
            _, ml, low, context, _ = model.probabilities(seq, given, k, deleted=True)
            here = context > 0
            step = lambda x: np.where(x > 0, np.round(np.log10(np.maximum(x, 1e-300)) * FINE), 1).astype(np.int64)
            # Steps lie between -300 * FINE and 1; a cell is one number of three digits.
            base = 512 * FINE
            coded = (bucket(context[here]) * base - step(ml[here]) + 1) * base - step(low[here]) + 1
            coded, n = np.unique(coded, return_counts=True)
            cells = [coded // base // base, 1 - coded // base % base, 1 - coded % base]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()) for c in cells] + [pa.array(n, pa.int64())], names=["bucket", "ml", "low", "n"]
            )

    return run


def expectation_maximisation(rows: list, rounds: int = ROUNDS) -> np.ndarray:
    """Weight of the higher order in each bucket; buckets without held-out tokens trust it half."""
    weights = np.full(BUCKETS, 0.5)
    cells = np.array([(r.bucket, r.ml, r.low, r.n) for r in rows], np.float64).reshape(-1, 4)
    b = cells[:, 0].astype(int)
    ml = np.where(cells[:, 1] == 1, 0.0, 10 ** (cells[:, 1] / FINE))
    low, n = 10 ** (cells[:, 2] / FINE), cells[:, 3]
    total = np.bincount(b, n, BUCKETS)
    for _ in range(rounds):
        high = weights[b] * ml
        share = np.bincount(b, n * high / (high + (1 - weights[b]) * low), BUCKETS)
        weights = np.where(total > 0, share / np.maximum(total, 1), weights)
        weights = np.clip(weights, 1e-6, 1 - 1e-6)
    return weights


def _scores(model: Model):
    def run(source):
        for block, given in rows_of(source):
            seq = Sequence(block)
            p, _, _, _, count = model.probabilities(seq, given, model.order, deleted=False)
            sums = lambda x: np.add.reduceat(x, seq.begins)
            n = len(block.doc_ids)
            yield pa.RecordBatch.from_arrays([
                pa.array(block.doc_ids, pa.int64()), pa.array(seq.fold[seq.begins] == 0),
                pa.array(block.sizes + 1, pa.int64()), pa.array(sums((count > 0).astype(np.int64)), pa.int64()),
                pa.array(np.full(n, int(model.totals[1])), pa.int64()),
                pa.array(sums(np.log10(model.base(count, False))), pa.float64()), pa.array(sums(np.log10(p)), pa.float64()),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per input row with the model's log10 probability of its text.

    ``docs`` has doc_id and text; other columns are ignored. Tokens are the words
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token. Rows
    whose crc32(doc_id as text) is 0 modulo 10 are held out and not learned from;
    of the others, those with remainder 1 teach the weights.

    A NULL or empty text is the end token alone. A NULL id counts as held out.
    Rows that repeat an id are scored and counted one by one. Without training
    rows all words have the probability of an unknown one. An empty table gives
    an empty result.
    """
    table = BlockTable(docs, fold=True, limit=BLOCK_BYTES)
    tokens = table.frame.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x + 1)), F.lit(0))).first()[0]
    answers, parts = None, []
    for k in range(1, order + 1):
        parts.append(table.parts(table.n_words if k == 1 else tokens, 16))
        own = table.ask(_questions(k, parts[-1]), _sum, parts[-1], f"ngrams-{k}").withColumn("k", F.concat("k", F.lit(f"-{k}")))
        answers = own if answers is None else answers.unionByName(own)
    summaries = answers.where("k = 'summary-1'").select("answer").toLocalIterator()
    totals = sum((np.frombuffer(r.answer, np.uint64).astype(np.int64) for r in summaries), np.zeros(4, np.int64))
    folds = table.frame.select(F.explode("doc_ids").alias("id")).select(
        F.when(F.col("id").isNull(), 0).otherwise(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS).alias("f")
    ).agg(F.count_if(F.col("f") != 0).alias("a"), F.count_if(F.col("f") == LEARN_FOLD).alias("b")).first()
    model = Model(order, parts, totals, np.array([folds.a, folds.a - folds.b]))
    for k in range(2, order + 1):
        lower = answers.where(F.col("k").isin([f"{DELETED}-{i}" for i in range(1, k + 1)]))
        stats = table.with_answers(lower).mapInArrow(_stats(model, k), STATS)
        rows = stats.groupBy("bucket", "ml", "low").agg(F.sum("n").alias("n")).collect()
        model.weights[k] = expectation_maximisation(rows)
    final = answers.where(F.col("k").startswith(f"{ALL}-"))
    out = table.with_answers(final).mapInArrow(_scores(model), SCORES)
    table.forget()
    return out
