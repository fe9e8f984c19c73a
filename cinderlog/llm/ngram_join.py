"""Exact Jaccard join of word 5-gram sets by universe partition and pigeonhole.

Two sets with a Jaccard similarity of at least 0.8 differ in at most a ninth of
their summed sizes. For each band of sizes the universe of shingles is hashed into
segments; a pair that differs in H shingles differs in at most H segments, so of
any H+1 segments one is equal. A set emits signatures of its first non-empty
segments, H+1 and a reserve, where H is the most its own size allows: an empty
segment says nothing and is not counted. Of a pair, the set that gets by with
fewer segments of the universe then has one of them, and its reserve more, in
common with the other. Where the sizes of a band allow a difference of one
shingle only, it costs less to give the whole set that difference: its signature
and those of its one-deletion neighbourhood are emitted instead.

The reserve pays for costly signatures. One that more than ``SMALL`` sets share
isn't expanded into pairs: its members are compared with a few centres, and a
signature whose members all end in one component needs no more work. The others
are skipped; a pair is still met elsewhere while the reserve covers what its sets
skip. Sets that skip more, and sets with too few non-empty segments, are joined among
themselves by their rarest shingles, so many that similar sets can't lack them all.
Most candidates share a passage and no more. Counts of shingles by the last bits of
their hashes bound from below in how many a pair differs; only where that bound allows
a link are the exact sets fetched, and they decide.

No group is gathered in a task: signatures are sorted by Spark and read as a
stream, and a set has one row per signature. Equal sets are one class throughout.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm import hashing
from cinderlog.llm.common import discard, id_and_text, row_key, settle, with_whole
from cinderlog.llm.components import components

WORDS = 5
RATIO = 1.5
PER_SEGMENT = 3.2
SMALL = 12
# Most rows of keys that are sent to every task instead of moving the texts to them.
MOST_SENT = 1 << 19
# Similar: 100 * intersection >= PERCENT * union.
PERCENT = 80

U = np.uint64
SHIFTS = np.array([0, 2, 4, 6], np.uint8)
SETS = "doc_id long, key long, n_shingles long, h1 long, h2 long, odd boolean, sketch binary"
SIGNATURES = "sig long, h1 long"
GROUPS = "sig long, h1 long, hot boolean"
SHINGLES = "h1 long, h2 long, n int, shingles binary"


def shingle_sets(table: pa.Table, column: str = "text", words: int = WORDS):
    """For each row its sorted distinct shingle hashes."""
    found, begins = hashing.words(*hashing.flat(table, column))
    grams, row = hashing.windows(found, begins, words)
    ends = np.searchsorted(row, np.arange(len(begins)))
    for i, (a, b) in enumerate(pairwise(begins.tolist())):
        n = b - a
        if n >= words:
            yield np.unique(grams[ends[i] : ends[i + 1]])
        elif n:
            whole, _ = hashing.windows(found[a:b], np.array([0, n]), n)
            yield hashing.mix(whole + U(n))
        else:
            yield np.zeros(0, np.uint64)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, as signed integers."""
    if not len(shingles):
        return 0, 0
    one = hashing.mix(shingles ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    two = hashing.mix(shingles * U(0x2545F4914F6CDD1D) + U(1)).sum(dtype=np.uint64)
    return tuple(int(x) for x in hashing.mix(np.array([one, two])).view(np.int64))


def band(n: int) -> int:
    """The number of the size band of ``n``: bands begin at powers of RATIO, rounded up."""
    b = int(np.floor(np.log(n) / np.log(RATIO)))
    while first_size(b + 1) <= n:
        b += 1
    while first_size(b) > n:
        b -= 1
    return b


def first_size(b: int) -> int:
    return int(np.ceil(RATIO**b))


def difference(a: int, b: int) -> int:
    """The most shingles in which similar sets of sizes a and b can differ."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def largest_partner(n: int) -> int:
    return n * 100 // PERCENT


def smallest_partner(n: int) -> int:
    return -(-n * PERCENT // 100)


def reserve(h: int) -> int:
    return h // 8 + (h >= 4)


def signatures(shingles: np.ndarray) -> tuple[np.ndarray, bool]:
    """All signatures of a set, and whether some scheme found too few segments.

    Scheme j is for pairs whose smaller set is in band j.
    """
    n, out, odd = len(shingles), [], False
    mixed = hashing.mix(shingles)
    for j in range(band(smallest_partner(n)), band(n) + 1):
        top = first_size(j + 1) - 1
        salt = U(j * 0x9E3779B1)
        if (most := difference(top, largest_partner(top))) <= 1:
            whole = mixed.sum(dtype=np.uint64)
            out.append(hashing.mix(np.concatenate([[whole], whole - mixed[: n * most]]) + salt))
            continue
        h = difference(n, largest_partner(n)) if band(n) == j else difference(n, min(n, top))
        segments = max(1, round(largest_partner(top) / PER_SEGMENT))
        at = (shingles >> U(16)) % U(segments)
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums = np.add.reduceat(mixed[order], starts)
        take = h + 1 + reserve(h)
        odd |= len(starts) < take
        out.append(hashing.mix(sums + at[starts] * hashing.BASE + salt)[:take])
    return np.concatenate(out), odd


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles have each value of their hashes' last bits, at most 3 of each: four counts to a byte.

    There are one to two values for each shingle, a power of two, and four at least.
    """
    if not len(shingles):
        return b""
    size = max(4, 1 << (len(shingles) - 1).bit_length())
    counts = np.minimum(np.bincount((shingles & U(size - 1)).astype(np.int64), minlength=size), 3).astype(np.uint8)
    return (counts.reshape(-1, 4) << SHIFTS).sum(axis=1, dtype=np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """The fewest shingles in which sets with these sketches differ; the larger is folded to what it is at the size of the other."""
    x, y = sorted((((np.frombuffer(v, np.uint8)[:, None] >> SHIFTS) & 3).astype(np.int64).ravel() for v in (a, b)), key=len)
    while len(y) > len(x):
        y = np.minimum(y[: len(y) // 2] + y[len(y) // 2 :], 3)
    return int(np.abs(x - y).sum())


def _sets(source):
    for table in hashing.batches(source, "text"):
        rows = [(len(s), *set_hash(s), bool(len(s)) and signatures(s)[1], sketch(s)) for s in shingle_sets(table)]
        columns = [pa.array(c) for c in zip(*rows, strict=True)]
        out = [table.column("doc_id"), table.column("key"), *columns]
        out = pa.table(out, names=["doc_id", "key", "n_shingles", "h1", "h2", "odd", "sketch"])
        if "whole" in table.column_names:
            out = out.append_column("whole", table.column("whole"))
        yield from out.combine_chunks().to_batches()


def _signatures(source):
    for table in hashing.batches(source, "text"):
        seen: dict[tuple[int, int], np.ndarray] = {}
        for shingles in shingle_sets(table):
            both = set_hash(shingles)
            if len(shingles) and both not in seen:
                seen[both] = signatures(shingles)[0]
        if seen:
            own = np.repeat(np.array([h for h, _ in seen], np.int64), [len(x) for x in seen.values()])
            yield _rows(np.stack([np.concatenate(list(seen.values())).view(np.int64), own]))


def _rows(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=["sig", "h1"])


def _shared(small: int):
    """Of rows sorted by (sig, h1): one per group and set, for each sig that at least two sets have.

    Groups are numbered, which packs better than their signatures. ``hot``: more than ``small``
    sets are in the group; no more rows than that wait for its end.
    """

    def run(source):
        base, n, going, held = TaskContext.get().partitionId() << 40, 0, False, np.zeros((2, 0), np.int64)

        def rows(found, number, hot):
            return pa.RecordBatch.from_arrays(
                [pa.array(base + number), pa.array(found[1]), pa.array(hot)], names=["sig", "h1", "hot"])

        for batch in source:
            found = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in (0, 1)])], axis=1)
            keep = np.ones(found.shape[1], bool)
            keep[1:] = (found[:, 1:] != found[:, :-1]).any(axis=0)
            found = found[:, keep]
            if not found.shape[1]:
                continue
            group = np.concatenate([[0], np.cumsum(found[0, 1:] != found[0, :-1])])
            sizes = np.bincount(group)
            hot = sizes > small
            # A group that was hot before goes on; its held row is out already.
            hot[0] |= going
            give = (hot | (sizes > 1))[group]
            give[0] &= not going
            ends = hot[-1]
            if not ends:
                give[group == group[-1]] = False
            yield rows(found[:, give], n + group[give], hot[group[give]])
            held = found[:, -1:] if ends else found[:, group == group[-1]]
            going, n = bool(ends), n + int(group[-1])
        if not going and held.shape[1] > 1:
            yield rows(held, np.full(held.shape[1], n), np.zeros(held.shape[1], bool))

    return run


def _shingles(source):
    for table in hashing.batches(source, "text"):
        rows = [(*set_hash(s), s.tobytes()) for s in shingle_sets(table)]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "shingles"])


def _explode(source):
    for batch in source:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        if sets:
            sizes = [len(x) for x in sets]
            columns = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("c", "n")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*columns, np.concatenate(sets))], names=["c", "n", "shingle"])


def _may_link(n: int, m: int, a: bytes, b: bytes) -> bool:
    """Whether sets of n and m shingles can link, by their sketches."""
    most = difference(n, m)
    return abs(n - m) <= most and least_difference(a, b) <= most


def _similar(n: int, m: int, a: bytes, b: bytes) -> bool:
    """Whether sets of n and m shingles, as bytes of these in order, link."""
    both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
    return 100 * both >= PERCENT * (n + m - both)


def _compared(pairs: DataFrame, of: DataFrame, column: str, holds) -> DataFrame:
    """Those of ``pairs`` (a, b: class numbers) of which ``holds(n, n_b, value, value_b)``, by ``column`` of ``of`` (c, n, column)."""

    def run(source):
        for batch in source:
            values = (batch.column(c).to_pylist() for c in ("n", "n_b", "value", "value_b"))
            keep = pa.array([holds(*v) for v in zip(*values, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    left = of.select(F.col("c").alias("a"), F.col("n").alias("n"), F.col(column).alias("value"))
    right = of.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col(column).alias("value_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "n_b", "value", "value_b")
    return both.mapInArrow(run, "a long, b long")


def _near(a: str = "n", b: str = "n_b") -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _reserve(a: Column, b: Column) -> Column:
    """``reserve(difference(a, b))`` of columns."""
    h = F.floor((a + b) * (100 - PERCENT) / (100 + PERCENT))
    return F.floor(h / 8) + (h >= 4).cast("long")


def _sent(keys: DataFrame) -> DataFrame:
    """``keys`` (written, a few longs each), to be broadcast if they are few enough, joined by shuffle if not."""
    return F.broadcast(keys) if keys.count() <= MOST_SENT else keys


def _stars(hot: DataFrame) -> DataFrame:
    """Members of hot signatures with centres of about their size, and neighbouring centres.

    The centre is the member with most hot signatures, so that copies agree on
    theirs. A pair must meet in an eighth of the member's: what isn't compared
    here leaves its signatures unsettled, and is met otherwise.
    """
    often = hot.groupBy("c").agg(F.count("*").alias("h"))
    size = F.floor(F.log(F.col("n").cast("double")) * 2 / F.log(F.lit(100 / PERCENT)))
    sized = hot.join(often, "c").select("sig", "c", "h", size.alias("size"))
    centres = sized.groupBy("sig", "size").agg(F.max(F.struct("h", "c")).alias("m")).select(
        "sig", "size", F.col("m.c").alias("b"), F.col("m.h").alias("h_b"))
    own = sized.join(centres, ["sig", "size"]).select(F.col("c").alias("a"), "h", "b")
    larger = centres.select("sig", (F.col("size") - 1).alias("size"), F.col("b").alias("other"))
    beside = centres.join(larger, ["sig", "size"]).select(F.col("b").alias("a"), F.col("h_b").alias("h"), F.col("other").alias("b"))
    met = own.union(beside).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("met"), F.first("h").alias("h"))
    return met.where("met * 8 >= h").select("a", "b")


class Join:
    """The stages of one join over ``docs`` (doc_id long, text string)."""

    def __init__(self, docs: DataFrame, small: int = SMALL, carry: bool = False) -> None:
        self.small, self.carry = small, carry
        docs = id_and_text(docs, carry)
        key = row_key(F.col("doc_id"), F.col("text"))
        texts = docs.select("doc_id", key.alias("key"), F.col("text").cast("binary").alias("text"), *["whole"] * carry)
        made = texts.mapInArrow(_sets, with_whole(SETS, texts))
        self.sets = settle(made.withColumn("nth", F.monotonically_increasing_id()), "sets")
        self.texts = texts.drop("whole")
        # A class is a set of shingles; its number is fixed once written.
        classes = self.sets.where("n_shingles > 0").groupBy("h1", "h2").agg(
            F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("odd").alias("odd"),
            F.first("sketch").alias("sketch"))
        self.classes = settle(classes.withColumn("c", F.monotonically_increasing_id()), "set-classes")
        self.links: list[DataFrame] = []

    def labels(self) -> DataFrame:
        """(c, label) of the classes that have links so far."""
        links = self.links[0]
        for more in self.links[1:]:
            links = links.union(more)
        return settle(components(links).select(F.col("node").alias("c"), "label"), "set-labels")

    def sets_of(self, wanted: DataFrame, make) -> DataFrame:
        """``make`` of the (c, n, shingles) of the written classes ``wanted`` (c), from a text of each; written.

        A class comes twice if a text with its key does.
        """
        at = settle(self.classes.join(wanted, "c", "left_semi").select("key", "h1", "h2", "c", "n"), "wanted")
        keys = settle(at.select("key").distinct(), "wanted-keys")
        found = self.texts.join(_sent(keys), "key", "left_semi").mapInArrow(_shingles, "h1 long, h2 long, shingles binary")
        # A key can bring texts of other classes.
        out = settle(make(found.join(_sent(at), ["h1", "h2"]).select("c", "n", "shingles")), "sets-of")
        discard(at, keys)
        return out

    def verify(self, pairs: DataFrame) -> None:
        """Add those of ``pairs`` (a, b: class numbers) that are similar to the links."""
        ordered = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fits = settle(ordered, "candidates")
        may = settle(_compared(fits, self.classes, "sketch", _may_link), "likely")
        discard(fits)
        wanted = settle(may.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "likely-classes")
        sets = self.sets_of(wanted, lambda found: found)
        self.links.append(settle(_compared(may, sets, "shingles", _similar), "links"))
        discard(may, wanted, sets)

    def run(self) -> None:
        spread = self.texts.mapInArrow(_signatures, SIGNATURES).repartition("sig").sortWithinPartitions("sig", "h1")
        shared = settle(spread.mapInArrow(_shared(self.small), GROUPS), "signatures")
        # Classes that share their first hash all take part.
        grouped = settle(shared.join(self.classes.select("h1", "c", "n", "odd"), "h1").drop("h1"), "signature-groups")
        discard(shared)
        hot = grouped.where("hot").drop("hot")
        self.verify(_stars(hot))
        labels = self.labels()
        label = F.coalesce("label", "c").alias("label")
        hot = hot.join(labels, "c", "left").select("sig", "c", label)
        unsettled = hot.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("sig")
        skipped = settle(hot.join(unsettled, "sig", "left_semi").groupBy("c").agg(F.count("*").alias("skipped")), "skipped")
        few = grouped.where("not hot").join(labels, "c", "left").join(skipped, "c", "left")
        few = settle(few.select("sig", "c", "n", "odd", label, F.coalesce("skipped", F.lit(0)).alias("skipped")), "few")
        discard(grouped, labels)
        self.verify(self._met(few))
        discard(few)
        self.verify(self._rest(skipped))
        discard(skipped)

    def _met(self, few: DataFrame) -> DataFrame:
        """Pairs in small groups and different components that share as many signatures as a link must."""
        other = few.select("sig", *(F.col(x).alias(f"{x}_b") for x in ("c", "n", "odd", "label", "skipped")))
        met = few.join(other, "sig").where((F.col("c") < F.col("c_b")) & (F.col("label") != F.col("label_b")) & _near())
        least = F.when(F.col("odd") | F.col("odd_b"), 0).otherwise(_reserve(F.col("n"), F.col("n_b")))
        counted = met.groupBy(F.col("c").alias("a"), F.col("c_b").alias("b")).agg(
            F.count("*").alias("met"), F.first(F.least("skipped", "skipped_b")).alias("skipped"), F.first(least).alias("least"))
        return counted.where(F.col("met") + F.col("skipped") > F.col("least")).select("a", "b")

    def _rest(self, skipped: DataFrame) -> DataFrame:
        """Pairs of sets that the partition doesn't settle, by their rarest shingles."""
        smallest = F.ceil(F.col("n") * PERCENT / 100)
        rest = self.classes.join(skipped, "c", "left").where(
            F.col("odd") | (F.coalesce("skipped", F.lit(0)) > _reserve(F.col("n"), smallest))).select("c")
        rest = settle(rest, "rest")
        each = lambda found: found.dropDuplicates(["c"]).mapInArrow(_explode, "c long, n long, shingle long")
        sets = self.sets_of(rest, each)
        often = sets.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
        known = sets.join(often, "shingle")
        # Shingles of one set only come first in its order; they meet nobody, just their number counts.
        one = Window.partitionBy("c")
        place = F.row_number().over(one.orderBy("df", "shingle")) + F.col("n") - F.count("*").over(one)
        rarest = known.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)
        kept = settle(rarest.join(self.labels(), "c", "left").select(
            "shingle", "c", "n", F.coalesce("label", "c").alias("label"), (F.col("n") - F.col("place") + 1).alias("left")), "rest-prefixes")
        discard(rest, sets)
        other = kept.select("shingle", *(F.col(x).alias(f"{x}_b") for x in ("c", "n", "label", "left")))
        # From the first common shingle on, enough of both sets must be left for the intersection.
        room = F.least("left", "left_b") * (100 + PERCENT) >= (F.col("n") + F.col("n_b")) * PERCENT
        met = kept.join(other, "shingle").where((F.col("c") < F.col("c_b")) & (F.col("label") != F.col("label_b")) & _near() & room)
        return met.select(F.col("c").alias("a"), F.col("c_b").alias("b")).distinct()

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id of each row, its number, and with ``carry`` whether it stays."""
        named = self.classes.join(self.labels(), "c", "left").withColumn("label", F.coalesce("label", "c"))
        lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        known = named.join(lowest, "label").select("h1", "h2", "component_id", "label")
        component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        rows = self.sets.drop("whole").join(known, ["h1", "h2"], "left")
        if not self.carry:
            return rows.select("doc_id", "n_shingles", component.alias("component_id"))
        # Of each component one row stays: that of the smallest id, of several or none the first read.
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "nth"))
        stay = rows.where("n_shingles > 0").groupBy("label").agg(first.alias("f")).select(F.col("f")["nth"].alias("nth"), F.lit(True).alias("first"))
        found = rows.join(stay, "nth", "left").select(
            "nth", "doc_id", "n_shingles", component.alias("component_id"),
            ((F.col("n_shingles") == 0) | F.coalesce("first", F.lit(False))).alias("kept"))
        return found.join(self.sets.select("nth", "whole"), "nth").drop("nth")


def link_documents(docs: DataFrame, small: int = SMALL, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    ``docs`` has doc_id and text; other columns are ignored. Words are ``[^\\x20\\x09-\\x0D]+``
    with A-Z lower-cased; a text's set are its distinct runs of five words, or
    all its words as one if it has fewer. Texts link when 100 * intersection >= 80 *
    union; component_id is the smallest doc_id reachable by links.

    A NULL or blank text has no shingles and its own id as component. Rows that
    repeat an id or a text are members like others. A NULL id never is a
    component_id unless no member has an id. An empty table gives an empty result.
    ``small`` is a matter of cost alone. With ``carry`` come the input row as ``whole``
    and ``kept``: true for one row of each component and for all without shingles.
    """
    join = Join(docs, small, carry)
    join.run()
    return join.result()
