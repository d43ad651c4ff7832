"""Exact deduplication by recipes of content-defined chunks.

Every text is cut where a rolling hash of its bytes says so, which doesn't depend on what stands
before. A chunk is named by a short 64-bit identifier, which the SHA-256 of its bytes verifies:
chunks that share an identifier but not the digest get variants. Texts are equal when their
ordered identifier lists are. Only identifiers and digests move, never the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _dist
from ._words import BYTE_VALUES, CLASSES, powers, slices, text_bytes

WINDOW, MEAN_BITS, LEAST, MOST = 48, 11, 256, 16_384
_INVERSE = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) after replacing each run of ASCII white space by one space; null counts as empty."""
    raw, at = text_bytes(texts)
    space = ~CLASSES["space"][raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    inner = at[:-1][at[:-1] < len(raw)]
    keep[inner] = True  # a run ends where its text ends
    ends = np.concatenate([[0], np.cumsum(keep)])
    out = np.where(space, np.uint8(32), raw)[keep]
    return out, ends[at]


def boundaries(data: np.ndarray) -> np.ndarray:
    """True where the window of WINDOW bytes that ends here asks for a cut after it; the first window of a slice may reach into the text before, so callers pass one text or mask."""
    n = len(data)
    weight = powers(n + 1)
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[data] * weight[:n], dtype=np.uint64)])
    rolled = np.zeros(n, np.uint64)
    if n >= WINDOW:
        rolled[WINDOW - 1 :] = (sums[WINDOW:] - sums[: n - WINDOW + 1]) * inverse[: n - WINDOW + 1]
    out = (rolled >> np.uint64(64 - MEAN_BITS)) == 0
    out[: WINDOW - 1] = False
    return out


def cuts(marks: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the text at [start, end): marks at least LEAST apart, none over MOST apart."""
    out, last = [], start
    for m in marks:
        m = int(m) + 1
        if m < start + WINDOW:
            continue
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST and m < end:
            out.append(m)
            last = m
    while end - last > MOST:
        last += MOST
        out.append(last)
    if end > last or not out:
        out.append(end)
    return out


#: Of each row beside its doc_id, whose type is that of the table.
RECIPE = pa.schema([("doc_row", pa.int64()), ("text_sha256", pa.string()), ("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary()))])


def _recipes(id_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = normalise(part.column("text"))
                marks = np.flatnonzero(boundaries(data))
                bounds = np.searchsorted(marks, at)
                whole, ids, digests = [], [], []
                for i in range(len(at) - 1):
                    start, end = int(at[i]), int(at[i + 1])
                    whole.append(hashlib.sha256(data[start:end]).hexdigest())
                    mine, last = [], start
                    for cut in cuts(marks[bounds[i] : bounds[i + 1]], start, end):
                        mine.append(hashlib.sha256(data[last:cut]).digest())
                        last = cut
                    digests.append(mine)
                    ids.append([int.from_bytes(d[:8], "big", signed=True) >> (64 - id_bits) for d in mine])
                n = part.num_rows
                rows = pa.array(np.arange(row, row + n, dtype=np.int64))
                row += n
                made = [rows, pa.array(whole, pa.string()), pa.array(ids, RECIPE.field("ids").type), pa.array(digests, RECIPE.field("digests").type)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], schema=pa.schema([part.schema.field("doc_id"), *RECIPE]))

    return run


def recipes(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """(doc_id, doc_row, text_sha256, ids, variants) of each row of docs(doc_id, text).

    id_bits: length of a chunk's identifier; fewer bits, as in tests, make identifiers meet.
    variants: per chunk, which of the digests with that identifier it has (0 for the smallest);
    null where no identifier of the table has several digests.
    """
    table = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    made = _dist.materialize(_dist.small_batches(table).mapInArrow(_recipes(id_bits), f"doc_id {dict(table.dtypes)['doc_id']}, doc_row long, text_sha256 string, ids array<long>, digests array<binary>"), "recipes")
    chunks = made.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select(F.col("c.ids").alias("id"), F.col("c.digests").alias("digest"))
    distinct = chunks.groupBy("id", "digest").agg(F.count("*").alias("uses"))
    clash = distinct.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("digest", "uses"))).alias("found")).where("n > 1")
    odd = _dist.materialize(clash.select("id", F.posexplode("found").alias("variant", "f")).where("variant > 0").select("id", F.col("f.digest").alias("digest"), F.col("f.uses").alias("uses"), "variant"), "variants")
    if not odd.limit(1).count():
        return made.drop("digests").withColumn("variants", F.lit(None).cast("array<int>"))
    every = made.select("doc_row", F.posexplode(F.arrays_zip("ids", "digests")).alias("pos", "c")).select("doc_row", "pos", F.col("c.ids").alias("id"), F.col("c.digests").alias("digest"))
    total = odd.agg(F.sum("uses")).first()[0]
    told = _dist.attach(every, odd.withColumnRenamed("uses", "size"), "id", "size", F.xxhash64("doc_row", "pos"), total, extra=["digest"])
    lists = told.groupBy("doc_row").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("variant", F.lit(0)).alias("v")))).alias("vs"))
    return made.drop("digests").join(lists, "doc_row", "left").withColumn("variants", F.col("vs.v")).drop("vs")


def exact_duplicates(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, chunks.

    Texts are equal when identical after each run of ASCII white space became one space; null counts
    as empty. Of equal texts the row with the smallest doc_id, of any type with an order, stays (a null
    doc_id only if there is no other; of rows that repeat a doc_id, one). A long text is cut into more
    chunks; it takes memory for its bytes and 40 bytes a chunk in one task, and only the identifiers
    move. Empty tables give no rows; other columns don't matter.
    """
    made = recipes(docs, id_bits)
    made = made.withColumn("recipe", F.xxhash64("ids", "variants"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_row")
    groups = made.groupBy("recipe", "ids", "variants").agg(F.min(order).alias("keep"), F.count("*").alias("group_size"))
    groups = _dist.materialize(groups, "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    told = _dist.attach(made, groups, "recipe", "group_size", F.xxhash64("doc_row"), total, extra=["ids", "variants"])
    return told.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.doc_row") == F.col("doc_row")).alias("kept"), "text_sha256", F.size("ids").cast("long").alias("chunks"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without all but the first of equal texts; the columns of docs stay, whatever their names. Of rows with one doc_id and equal texts one stays, even if other columns differ."""
    key = F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\t-\r]+", " "), 256)
    found = exact_duplicates(docs.select("doc_id", "text"))
    return _dist.keep_marked(docs, found.select("doc_id", F.col("text_sha256").alias("row_key"), "kept"), key)
