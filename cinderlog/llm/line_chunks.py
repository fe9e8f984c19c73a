"""Line dedup by content-defined chunks, with DataFrame functions only.

``dedup_passages`` anchors at every run of ``LEAST`` lines: runs that occur more
than once are candidates by their hash, their bytes are then compared, and a chunk
that goes is a stretch of lines covered by runs that occurred before. Its bounds
depend on the content only, and a repeated passage goes whole.

``dedup_lines`` compares chunks only: a rolling hash over the hashes of the last
``WINDOW`` lines decides where one ends, so inserting or deleting lines moves only
the boundaries next to the edit. The lines of a repeated passage outside its inner
boundaries stay, and a passage of a few lines often has no chunk of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.common import id_and_text, placed, settle

WINDOW = 2
MEAN = 3
LEAST = 2


def chunk_spans(hashes: Column, window: int = WINDOW, mean: int = MEAN) -> Column:
    """array<struct<no, start, lines>> of the chunks of an array of line hashes.

    ``start`` counts from 0. A chunk ends behind line i when the hash of lines
    i-window+1..i is divisible by ``mean``, and behind the last line.
    """
    n = F.size(hashes)
    rolling = F.transform(hashes, lambda h, i: F.xxhash64(
        *[F.when(i >= b, F.try_element_at(hashes, i - b + 1)) for b in range(window)]
    ))
    inner = F.transform(
        F.filter(
            F.transform(rolling, lambda r, i: F.struct(i.alias("i"), r.alias("r"))),
            lambda x: (F.pmod(x["r"], F.lit(mean)) == 0) & (x["i"] < n - 1),
        ),
        lambda x: x["i"] + 1,
    )
    starts = F.concat(F.array(F.lit(0)), inner)
    ends = F.concat(inner, F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("lines")))


def _with_lines(docs: DataFrame) -> DataFrame:
    """placed() documents with their lines and the hashes of these."""
    lined = placed(docs).withColumn("lines", F.split("text", "\n", -1))
    return lined.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))


def _with_chunks(docs: DataFrame, window: int, mean: int) -> DataFrame:
    """placed() documents with their lines and chunk spans."""
    return _with_lines(docs).withColumn("spans", chunk_spans(F.col("hashes"), window, mean))


def _piece(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["start"] + 1, span["lines"]), "\n")


def repeated_chunks(docs: DataFrame, window: int = WINDOW, mean: int = MEAN, least: int = LEAST) -> DataFrame:
    """(key, ord, nos): for each document the chunk numbers to remove.

    Of equal chunks the first by (doc_id, place in the document) stays; a NULL id
    comes first. Rows of repeated chunks are the only ones whose text is
    compared, and counts are combined before every shuffle.
    """
    base = _with_chunks(docs, window, mean)
    numbered = base.select("key", "ord", F.posexplode(F.transform("spans", lambda s: F.struct(
        s["lines"].alias("n"), F.xxhash64(F.slice("hashes", s["start"] + 1, s["lines"])).alias("digest"),
    ))).alias("no", "chunk")).where(F.col("chunk.n") >= least).select("key", "ord", "no", F.col("chunk.digest").alias("digest"))
    marks = settle(numbered, "chunk-marks")
    often = marks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    wanted = (
        marks.join(often, "digest", "left_semi").groupBy("key")
        .agg(F.collect_list(F.struct("ord", "no")).alias("wanted"))
    )
    here = F.filter("wanted", lambda w: w["ord"] == F.col("ord"))
    texts = base.join(wanted, "key").select(
        "key", "ord", "doc_id", F.explode(F.transform(here, lambda w: F.struct(
            w["no"].alias("no"), _piece(F.col("lines"), F.get("spans", w["no"])).alias("piece"),
        ))).alias("c"),
    ).select("key", "ord", "doc_id", "c.no", F.col("c.piece").cast("binary").alias("piece"))
    texts = settle(texts, "chunk-texts")
    place = F.struct("doc_id", "key", "ord", "no")
    first = texts.groupBy("piece").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return (
        texts.join(first, "piece").where(~place.eqNullSafe(F.col("first")))
        .groupBy("key", "ord").agg(F.collect_list("no").alias("nos"))
    )


def dedup_lines(docs: DataFrame, window: int = WINDOW, mean: int = MEAN, least: int = LEAST) -> DataFrame:
    """Texts without repeated chunks; ``dedup_passages`` removes repeated passages whole.

    ``docs`` has doc_id and text; other columns are ignored. Lines end at ``\\n`` only. Returns
    one row per input row: doc_id, n_lines, n_chunks, n_removed_chunks,
    n_removed_lines, text (the lines that stay, joined by ``\\n``).

    A NULL or empty text has one empty line and loses nothing, since a chunk of
    one line is never removed. Of rows that repeat id and text the first stays
    whole. An empty table gives an empty result.
    """
    docs = id_and_text(docs)
    gone = settle(repeated_chunks(docs, window, mean, least), "chunk-gone")
    lists = gone.groupBy("key").agg(F.collect_list(F.struct("ord", "nos")).alias("gone"))
    base = _with_chunks(docs, window, mean)
    own = F.flatten(F.transform(F.filter("gone", lambda g: g["ord"] == F.col("ord")), lambda g: g["nos"]))
    joined = base.join(lists, "key", "left").withColumn("nos", F.coalesce(own, F.array().cast("array<int>")))
    kept = F.filter("spans", lambda s, i: ~F.array_contains("nos", i))
    removed = F.filter("spans", lambda s, i: F.array_contains("nos", i))
    return joined.select(
        "doc_id", F.size("lines").alias("n_lines"), F.size("spans").alias("n_chunks"),
        F.size("nos").alias("n_removed_chunks"),
        F.aggregate(removed, F.lit(0), lambda a, s: a + s["lines"]).alias("n_removed_lines"),
        F.array_join(F.transform(kept, lambda s: _piece(F.col("lines"), s)), "\n").alias("text"),
    )


def repeated_stretches(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, ord, start, lines): the stretches of each document covered by runs of ``least`` lines that occurred before.

    Before is by (doc_id, place in the document); a NULL id comes first. Stretches
    of one document neither overlap nor touch. Only runs whose hash occurs more
    than once have their text compared.
    """
    base = _with_lines(docs)
    runs = F.transform("hashes", lambda h, i: F.xxhash64(*[F.get("hashes", i + by) for by in range(least)]))
    runs = F.slice(runs, 1, F.greatest(F.size("hashes") - (least - 1), F.lit(0)))
    marks = settle(base.select("key", "ord", "doc_id", F.posexplode(runs).alias("no", "digest")), "run-marks")
    often = marks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    marks = settle(marks.join(often, "digest", "left_semi"), "run-often")
    wanted = marks.groupBy("key").agg(F.collect_list(F.struct("ord", "no", "digest")).alias("wanted"))
    here = F.filter("wanted", lambda w: w["ord"] == F.col("ord"))
    texts = base.join(wanted, "key").select("key", "ord", "doc_id", F.explode(F.transform(here, lambda w: F.struct(
        w["no"].alias("no"), w["digest"].alias("digest"),
        F.array_join(F.slice("lines", w["no"] + 1, least), "\n").cast("binary").alias("piece"),
    ))).alias("c")).select("key", "ord", "doc_id", "c.*")
    first = texts.groupBy("digest", "piece").agg(F.min(F.struct("doc_id", "key", "ord", "no")).alias("first"))
    later = marks.join(first.select("first.key", "first.ord", "first.no"), ["key", "ord", "no"], "left_anti")
    order = Window.partitionBy("key", "ord").orderBy("no")
    apart = F.coalesce(F.col("no") - F.lag("no").over(order) > least, F.lit(True))
    return (
        later.withColumn("apart", apart.cast("int")).withColumn("stretch", F.sum("apart").over(order))
        .groupBy("key", "ord", "stretch").agg(F.min("no").alias("start"), (F.max("no") - F.min("no") + least).alias("lines"))
        .select("key", "ord", "start", "lines")
    )


def dedup_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Texts without repeated passages of at least ``least`` lines.

    Columns, lines and odd rows as in ``dedup_lines``. A line goes when it lies in
    ``least`` neighbouring lines that occurred before, in an earlier document or
    further up; the first occurrence of a line always stays. A chunk is a
    longest stretch of lines that stay or of lines that go.
    """
    docs = id_and_text(docs)
    gone = settle(repeated_stretches(docs, least), "run-gone")
    lists = gone.groupBy("key").agg(F.collect_list(F.struct("ord", "start", "lines")).alias("all"))
    own = F.transform(F.filter("all", lambda g: g["ord"] == F.col("ord")), lambda g: F.struct(
        g["start"].alias("start"), g["lines"].alias("lines"),
    ))
    joined = _with_lines(docs).join(lists, "key", "left").withColumn(
        "gone", F.array_sort(F.coalesce(own, F.array().cast("array<struct<start:int,lines:int>>")))
    )
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["start"] + g["lines"]))
    ends = F.concat(F.transform("gone", lambda g: g["start"]), F.array(F.size("lines")))
    between = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("lines")))
    joined = joined.withColumn("kept", F.filter(between, lambda s: s["lines"] > 0))
    return joined.select(
        "doc_id", F.size("lines").alias("n_lines"), (F.size("kept") + F.size("gone")).alias("n_chunks"),
        F.size("gone").alias("n_removed_chunks"),
        F.aggregate("gone", F.lit(0), lambda a, s: a + s["lines"]).alias("n_removed_lines"),
        F.array_join(F.transform("kept", lambda s: _piece(F.col("lines"), s)), "\n").alias("text"),
    )
