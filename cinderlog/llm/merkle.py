"""A Merkle manifest of documents: digests of rows, trees by language, proofs.

The tree over each group's leaves is made level by level. Children of one parent
differ in their slot, ``pos % FANOUT``; conditional aggregates spread them into one
column each. Joining the columns gives the parent's digest, joining those to
the left and right of a slot gives its siblings. Parents become the next
level's children, an eighth as many. The groups' roots are leaves of one more tree.

Proofs come down the same levels: a node's proof is its own siblings and then its
parent's proof, so each level joins a table an eighth of its size, and only
the last one meets the leaves, still eight to a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.common import settle

FANOUT = 8
# monotonically_increasing_id keeps the row number below this bit.
ROW_BITS = 33
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<l:string,r:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, otherwise the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): digests of every row, and of what became of it."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
        F.col("text").cast("string").alias("text"),
    )
    row = lambda text: digest(*[field(text if f == "text" else F.col(f)) for f in FIELDS])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return rows.select(
        "doc_id", "lang", row(F.col("text")).alias("leaf"),
        F.when(hit, row(lower_ascii(F.col("text")))).alias("tampered"),
    )


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place of each within its group, and ``n``, the group's size.

    Ranges of (group, order) are sorted and written with their row numbers, so a group
    of any size spreads over many tasks and one table of (range, group) counts places it.
    Rows equal in all of ``order`` may lie in any order, but each copy has its own range key.
    """
    keys = [group, *order, "copy"]
    # A copy's number only spreads copies over ranges.
    ranged = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = settle(ranged.drop("copy").withColumn("at", F.monotonically_increasing_id()), "manifest-rows")
    part = F.shiftright("at", ROW_BITS)
    counts = rows.groupBy(part.alias("part"), group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(counts.select(
        "part", F.col(group).alias("g"), "first", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"),
        F.sum("here").over(Window.partitionBy(group)).alias("n"),
    ), "manifest-counts")
    # A table of one row per range and group; Spark broadcasts it if it is small.
    met = (part == F.col("part")) & F.col(group).eqNullSafe(F.col("g"))
    return rows.join(counts, met).select(
        *[c for c in rows.columns if c != "at"], (F.col("at") - F.col("first") + F.col("offset")).alias("pos"), "n")


def pivot(nodes: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """One row per parent of ``nodes`` (group, pos, n, digest): a column for each slot's digest, and for what it carries."""
    slots = [F.max(F.when(F.col("pos") % FANOUT == i, F.struct("digest", *carried))).alias(f"s{i}") for i in range(FANOUT)]
    return nodes.groupBy(group, F.expr(f"pos div {FANOUT}").alias("parent"), "n").agg(*slots)


def joined(slots: range) -> Column:
    return F.concat(F.lit(""), *[F.coalesce(F.col(f"s{i}.digest"), F.lit("")) for i in slots])


def parents(pivots: DataFrame, group: str) -> DataFrame:
    return pivots.select(
        group, F.col("parent").alias("pos"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
        F.sha2(joined(range(FANOUT)).cast("binary"), 256).alias("digest"))


def children(pivots: DataFrame, carried: list[str]) -> DataFrame:
    """One row per child again: its columns, its slot and its siblings to the left and right."""
    each = [
        F.when(F.col(f"s{i}").isNotNull(), F.struct(
            F.lit(i).alias("slot"), joined(range(i)).alias("l"), joined(range(i + 1, FANOUT)).alias("r"),
            *[F.col(f"s{i}.{c}").alias(c) for c in ("digest", *carried)]))
        for i in range(FANOUT)
    ]
    kept = [c for c in pivots.columns if c not in {f"s{i}" for i in range(FANOUT)}]
    return pivots.select(*kept, F.explode(F.array_compact(F.array(*each))).alias("c"))


class Tree:
    """All levels over ``nodes`` (group, pos, n, digest and what is carried), one tree per group."""

    def __init__(self, nodes: DataFrame, group: str, carried: list[str]) -> None:
        self.group, self.carried, self.levels = group, carried, []
        deep = nodes.agg(F.max("n")).first()[0] or 0
        self.lone = nodes.where("n = 1")
        tops = [self.lone.select(group, F.lit(0).alias("level"), "digest")]
        while deep > 1:
            level = len(self.levels)
            pivots = settle(pivot(nodes.where("n > 1"), group, [] if level else carried), f"manifest-level{level}")
            self.levels.append(pivots)
            nodes = parents(pivots, group)
            tops.append(nodes.where("n = 1").select(group, F.lit(level + 1).alias("level"), "digest"))
            deep = -(-deep // FANOUT)
        roots = tops[0]
        for top in tops[1:]:
            roots = roots.union(top)
        # (group, level, digest) of each group's root and the level it lies on.
        self.roots = settle(roots, "manifest-roots")

    def proofs(self, above: DataFrame, extra: list[str]) -> DataFrame:
        """One row per first node: group, what it carries, ``path`` (its steps up to the very top) and ``extra``.

        ``above`` has (group, level, path, extra) of the groups' roots.
        """
        g = self.group
        own = F.array(F.struct(F.col("c.l").alias("l"), F.col("c.r").alias("r")))
        down = self.at(above, len(self.levels), extra)
        for level in range(len(self.levels) - 1, -1, -1):
            pivots = self.levels[level].withColumnRenamed(g, "own_g")
            met = F.col("own_g").eqNullSafe(F.col(g)) & (F.col("parent") == F.col("pos"))
            below = children(pivots.join(down, met).drop("own_g", "pos", "n"), self.carried if level == 0 else [])
            path = F.concat(own, F.col("path")).alias("path")
            if level == 0:
                deep = below.select(g, *[f"c.{c}" for c in ("digest", *self.carried)], path, *extra)
                break
            down = below.select(g, (F.col("parent") * FANOUT + F.col("c.slot")).alias("pos"), path, *extra)
            down = settle(down.union(self.at(above, level, extra)), f"manifest-proofs{level}")
        lone = above.where("level = 0").select(F.col(g).alias("root_g"), "path", *extra)
        alone = self.lone.join(lone, F.col(g).eqNullSafe(F.col("root_g"))).select(g, "digest", *self.carried, "path", *extra)
        return deep.union(alone) if self.levels else alone

    def at(self, above: DataFrame, level: int, extra: list[str]) -> DataFrame:
        return above.where(F.col("level") == level).select(self.group, F.lit(0).cast("long").alias("pos"), "path", *extra)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are ignored.
    Leaves ascend by doc_id, NULL first, and of equal ids by digest; equal rows
    are equal leaves. A NULL lang is a group of its own, the first. A row with a
    NULL id is never tampered with. A single row is leaf, subroot and root at once with an
    empty proof. An empty table gives an empty result.
    """
    rows = numbered(leaves(docs), "lang", ["doc_id", "leaf"])
    tree = Tree(rows.withColumnRenamed("leaf", "digest"), "lang", ["doc_id", "tampered"])
    tops = numbered(tree.roots.withColumn("top", F.lit(0)), "top", ["lang"])
    crown = Tree(tops, "top", ["lang", "level"])
    apex = crown.roots.select("top", "level", F.array().cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("root"))
    above = crown.proofs(apex, ["root"]).select(
        "lang", F.col("level").alias("level"), "path", F.col("digest").alias("subroot"), "root")
    proofs = tree.proofs(settle(above, "manifest-subroots"), ["subroot", "root"])
    start = F.coalesce("tampered", "digest")
    folded = F.aggregate("path", start, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]).cast("binary"), 256))
    steps = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    return proofs.select(
        "doc_id", "lang", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(steps.cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
