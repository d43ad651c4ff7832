"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of WINDOW consecutive lines says whether a chunk may end after the
first of them, so a line added or dropped moves the boundaries near it only. A chunk includes the
windows of both its boundaries, so what draws a chunk lies in it, and equal lines give equal chunks
wherever they stand. The hash has CLASSES values; there is a chunking for each, with a boundary where
the hash has any other value. With three classes the first and the last window of a repeated run of
lines are both boundaries in one of the chunkings, whose chunks between them make up the run: every
repeat of WINDOW + 1 or more lines is found. Chunks of several lines that an earlier place of the
corpus has too are found by hash, compared byte by byte, and removed. All steps are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _dist


def line_hash(line: Column) -> Column:
    """24 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 6), 16, 10).cast("long")


def _let(value: Column, use) -> Column:
    """use(value) with value computed once; a plain column would be put in place of its name and computed for each element."""
    return F.transform(F.array(value), use)[0]


#: Lines that a boundary is drawn from, values of the rolling hash, its base, and the bytes below which a chunk stays.
WINDOW, CLASSES, BASE, LEAST_BYTES = 2, 3, 257, 16


def _classes(hashes: Column) -> Column:
    """Class of the rolling hash over the WINDOW lines from each line on; null where the text ends within them."""

    def rolled(h: Column, i: Column) -> Column:
        value = h
        for k in range(1, WINDOW):
            value = value * BASE + F.get(hashes, i + k)
        return F.pmod(value, F.lit(CLASSES))

    return F.transform(hashes, rolled)


def _chunks(lines: Column, classes: Column) -> Column:
    """(at, n, text) of the chunks of all chunkings: the first line, how many, and their text; also those of one line or few bytes."""
    n = F.size(lines)

    def cut(ends: Column) -> Column:
        def chunk(e: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(ends, i - 1) - 1).otherwise(F.lit(0))
            size = F.least(e + (WINDOW - 1), n) - at
            return F.struct(at.alias("at"), size.alias("n"), F.array_join(F.slice(lines, at + 1, size), "\n").alias("text"))

        return F.transform(ends, chunk)

    def ends(c: int) -> Column:
        return F.filter(F.sequence(F.lit(1), n), lambda e: (e == n) | (F.get(classes, e - 1) != c))

    return F.array_distinct(F.concat(*[_let(ends(c), cut) for c in range(CLASSES)]))


def with_chunks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with row_key and chunks: array of (at, n, text), each once."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    chunks = _let(lines, lambda w: _let(F.transform(w, line_hash), lambda h: _let(_classes(h), lambda c: _chunks(w, c))))
    return docs.withColumn("row_key", _dist.row_key("doc_id", "text")).withColumn("chunks", chunks)


def repeated_places(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(doc_id, row_key, places): (at, n) of the chunks of each row of docs(doc_id, text) to remove. hash_bits: fewer bits, as in tests, make hashes of different chunks meet."""
    each = with_chunks(docs).select("doc_id", "row_key", F.explode(F.filter("chunks", lambda c: (c["n"] > 1) & (F.octet_length(c["text"]) >= LEAST_BYTES))).alias("c")).select("doc_id", "row_key", "c.at", "c.n", F.col("c.text").alias("chunk"))
    each = each.withColumn("hash", F.shiftright(F.xxhash64("chunk"), 64 - hash_bits))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "at")
    slim = each.groupBy("hash").agg(F.min(place).alias("p0"), F.max(place).alias("p1")).where("p0 <> p1").select("hash")
    slim = _dist.materialize(slim, "hashes")
    met = each.join(_dist.small_or_shuffled(slim.select(F.col("hash").alias("__hash")), slim.count()), F.col("hash") == F.col("__hash")).drop("__hash")
    met = _dist.materialize(met, "met")
    # byte comparison of all chunks that share a hash
    groups = met.groupBy("hash").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"), F.min(place).alias("first"), F.count("*").alias("uses"))
    groups = _dist.materialize(groups.select("hash", (F.col("low") == F.col("high")).alias("same"), "first", "uses"), "groups")
    total = groups.agg(F.sum("uses")).first()[0] or 0
    here = F.struct("doc_id", "row_key", "at")
    later = F.col("first").isNotNull() & ~here.eqNullSafe(F.struct("first.doc_id", "first.row_key", "first.at"))
    same = groups.where("same").select("hash", "first", "uses")
    told = _dist.attach(met.select("doc_id", "row_key", "at", "n", "hash"), same, "hash", "uses", F.xxhash64("doc_id", "row_key", "at"), total)
    gone = told.where(later).select("doc_id", "row_key", "at", "n")
    clash = groups.where("not same").select(F.col("hash").alias("__hash"))
    n = clash.count()
    if n:  # different chunks with one hash: their texts are the key
        odd = met.join(_dist.small_or_shuffled(clash, n), F.col("hash") == F.col("__hash")).drop("__hash")
        firsts = odd.groupBy("chunk").agg(F.min(place).alias("first")).withColumnRenamed("chunk", "__chunk")
        gone = gone.union(odd.join(firsts, F.col("chunk") == F.col("__chunk")).where(later).select("doc_id", "row_key", "at", "n"))
    return gone.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("at", "n")).alias("places"))


def _without(docs: DataFrame, places: DataFrame, last: Callable[[Column], Column], made: dict[str, Column]) -> DataFrame:
    """docs(doc_id, text, ...) without the lines from each of a row's places(doc_id, row_key, places) to last(place), and columns `made`, which may use __places, __lines.n and __lines.kept; other columns stay but for clashing names."""
    named = places.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__row"), F.col("places").alias("__places"))
    others = [c for c in docs.columns if c not in {"doc_id", "text"} and c.lower() not in made]
    each = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("others"))
    each = each.withColumn("__key", _dist.row_key("doc_id", "text"))
    # lists have no fixed size, so their entries count as rows; beyond the limit texts are shuffled
    size = places.agg(F.count("*"), F.sum(F.size("places"))).first()
    out = each.join(_dist.small_or_shuffled(named, size[0] + (size[1] or 0)), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__row")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    start = lambda p: p["at"] if dict(places.dtypes)["places"].startswith("array<struct") else p
    covered = F.flatten(F.transform("__places", lambda p: F.sequence(start(p), last(p))))
    left = lambda w: F.when(F.col("__places").isNull(), w).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), covered), lambda i: F.get(w, i)))
    out = out.withColumn("__lines", _let(lines, lambda w: F.struct(F.size(w).cast("long").alias("n"), left(w).alias("kept"))))
    text = F.when(F.col("__places").isNull(), F.col("text")).otherwise(F.array_join("__lines.kept", "\n"))
    return out.select("doc_id", text.alias("text"), *[F.col("others")[c].alias(c) for c in others], *[v.alias(k) for k, v in made.items()])


def deduplicate_lines(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """docs(doc_id, text, ...) with the remaining text, and n_lines, removed_chunks, removed_lines of each row.

    Lines end at line feeds. Chunks of one line or under LEAST_BYTES bytes stay; of equal other chunks of several lines the one in the
    smallest doc_id (nulls last), then the first in its text, stays, wherever else they repeat, the same
    text included; a removed line has an equal one at an earlier place, so one of each line stays. Rows
    that repeat both doc_id and text count as one and get equal results. Null texts have one empty line
    and stay null. A long text is chunked in one task, whose memory holds its lines some times over.
    Other columns stay, a clashing name with the value computed here.
    """
    kind = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = _dist.materialize(repeated_places(kind, hash_bits), "places")
    removed = F.when(F.col("__places").isNull(), 0).otherwise(F.size("__places")).cast("long")
    return _without(docs, found, lambda p: p["at"] + p["n"] - 1, {"n_lines": F.col("__lines.n"), "removed_chunks": removed, "removed_lines": _gone()})


def _gone() -> Column:
    return (F.col("__lines.n") - F.size("__lines.kept")).cast("long")


#: Consecutive lines that make a passage.
PASSAGE = 2


def _digests(text: Column) -> Column:
    """SHA-256 of each PASSAGE consecutive lines; the one at i begins with line i."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    windows = lambda w: F.filter(F.transform(w, lambda x, i: F.when(i + PASSAGE <= F.size(w), F.unhex(F.sha2(F.array_join(F.slice(w, i + 1, PASSAGE), "\n"), 256)))), lambda x: x.isNotNull())
    return _let(lines, windows)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, places): first lines, from 0, of each row's passages that an earlier place has too."""
    each = docs.select("doc_id", _dist.row_key("doc_id", "text").alias("row_key"), F.posexplode(_digests(F.col("text"))).alias("no", "digest"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "no")
    groups = each.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("uses")).where("uses > 1")
    groups = _dist.materialize(groups, "passages")
    total = groups.agg(F.sum("uses")).first()[0] or 0
    salt = F.encode(F.xxhash64("doc_id", "row_key", "no").cast("string"), "utf-8")  # never as long as a digest
    told = _dist.attach(each, groups, "digest", "uses", salt, total)
    here = F.struct("doc_id", "row_key", "no")
    gone = told.where(F.col("first").isNotNull() & ~here.eqNullSafe(F.struct("first.doc_id", "first.row_key", "first.no")))
    return gone.groupBy("doc_id", "row_key").agg(F.collect_set("no").alias("places"))


def deduplicate_passages(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) without the lines of any PASSAGE or more consecutive lines that an earlier place has too; n_lines and removed_lines of each row.

    Places are ordered, rows that repeat one another counted and nulls kept as in deduplicate_lines.
    A removed line has an equal one at an earlier place, so one of each line stays.
    """
    kind = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = _dist.materialize(repeated_passages(kind), "repeats")
    return _without(docs, found, lambda p: p + (PASSAGE - 1), {"n_lines": F.col("__lines.n"), "removed_lines": _gone()})
