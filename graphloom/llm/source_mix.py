"""Mixing of sources to target weights by blocks.

The words of each source, documents in pseudorandom order, are packed into blocks of a fixed length.
Each output shard draws multinomial source counts. A source's draws beyond its quota free slots of their
shards, which are given to the sources that were drawn too rarely, in pseudorandom order. The i-th slot
of a source takes block p(i) of its lap, p a keyed Feistel permutation of the source's block numbers, so
no block is used more often than another by over one. Slots and blocks meet in a join by block number.

Sources are a table like any other: their targets come from rounds of aggregates, shards draw groups of
sources first and then sources within a group. The driver holds sums, and a number for each GROUP sources.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _dist
from ._words import mix

WEIGHTS = (5.0, 2.0, 1.0)
#: Blocks that a source has at least; those of small sources are shorter, down to a word, so that whole blocks come near any target.
LEAST_BLOCKS = 64
#: Sources that are drawn as one by a shard and told apart after.
GROUP = 4096
#: Slots that a task expands, and slots that it holds at once.
TASK_SLOTS, HELD_SLOTS = 50_000, 500_000


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df, whose values of `order` are distinct, with their rank from 0. Ranks come from range partitions and their sizes, so no task sorts all rows."""
    parts = _dist.materialize(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()), name)
    counts = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1 + F.col("__before")
    return parts.join(F.broadcast(before), "__part").withColumn("rank", rank).drop("__part", "__before")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(words, weight, ...) with target: share times all words by weight, at most `most` times its own words; the excess is reshared by weight until none is above.

    With u words for each unit of weight, the sources with most * words < u * weight are full. Fewer
    units left raise u, which fills more sources, until no more are; each round is one aggregate.
    """
    full = lambda u: most * F.col("words") < u * F.col("weight")
    total, weight = sources.agg(F.sum("words"), F.sum("weight")).first()
    unit, n_full = share * (total or 0) / (weight or 1.0), 0
    while True:
        given, left, n = sources.agg(F.sum(F.when(full(unit), most * F.col("words"))), F.sum(F.when(~full(unit), F.col("weight"))), F.count(F.when(full(unit), 1))).first()
        if n == n_full or not left:
            return sources.withColumn("target", F.when(full(unit), most * F.col("words")).otherwise(unit * F.col("weight")))
        unit, n_full = (share * total - given) / left, n


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Image of each x in [0, n) under a pseudorandom permutation of [0, n): four Feistel rounds, walked until they end inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            left, right = right, left ^ (mix(right + np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def running(df: DataFrame, key: str, coarse: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of its key that come before: within (key, coarse), plus the totals of lower coarse groups. No task sees a key's rows all at once; coarse must not contradict the order."""
    totals = df.groupBy(key, coarse).agg(F.sum(value).alias("__sum"))
    before = totals.select(F.col(key).alias("__k"), F.col(coarse).alias("__c"), (F.sum("__sum").over(Window.partitionBy(key).orderBy(coarse)) - F.col("__sum")).alias("__before"))
    inside = df.withColumn("__in", F.sum(value).over(Window.partitionBy(key, coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    joined = inside.join(before, (F.col(key) == F.col("__k")) & (F.col(coarse) == F.col("__c")))
    return joined.withColumn(name, F.col("__before") + F.col("__in")).drop("__k", "__c", "__before", "__in")


def _group_draws(slots: list[int], shard_slots: int, seed: int):
    """Rows (shard, group, n) of shards: how many slots each group of sources gets."""
    total = sum(slots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chances = np.array(slots, float) / total
        for frame in frames:
            for shard in frame.id:
                n = min(shard_slots, total - shard * shard_slots)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(n, chances)
                some = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "group": some, "n": counts[some]})

    return run


def _source_draws(seed: int):
    """Rows (shard, sid, n) of rows (shard, group, n, slots), slots of the group's sources in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                slots = np.asarray(r.slots, float)
                counts = np.random.default_rng([seed, int(r.shard), int(r.group)]).multinomial(r.n, slots / slots.sum())
                some = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": r.shard, "sid": r.group * GROUP + some, "n": counts[some]})

    return run


def _permuted(n: int, key: int):
    """Rows (shard, unit) of rows (shard, at)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"shard": frame.shard, "unit": permute(frame["at"].to_numpy(), n, key)})

    return run


def _slots(seed: int):
    """Rows (shard, sid, slot, block) of rows (shard, sid, blocks, first, n)."""

    def expanded(takes: pd.DataFrame) -> pd.DataFrame:
        n = takes.n.to_numpy()
        slot = np.repeat(takes["first"].to_numpy() - np.cumsum(n) + n, n) + np.arange(n.sum())
        sid, blocks = np.repeat(takes.sid.to_numpy(), n), np.repeat(takes.blocks.to_numpy(), n)
        lap, within, block = slot // blocks, slot % blocks, np.empty(len(slot), np.int64)
        order = np.lexsort((lap, sid))
        starts = np.flatnonzero(np.append(True, (np.diff(sid[order]) != 0) | (np.diff(lap[order]) != 0)))
        for mine in np.split(order, starts[1:]):
            i = mine[0]
            block[mine] = permute(within[mine], int(blocks[i]), ((seed * 1_000_003 + int(sid[i])) << 8) + int(lap[i]))
        return pd.DataFrame({"shard": np.repeat(takes.shard.to_numpy(), n), "sid": sid, "slot": slot, "block": block})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = frame.n.cumsum().to_numpy() // HELD_SLOTS  # a row has no more than a shard's slots
            for part in np.unique(held):
                yield expanded(frame[held == part])

    return run


def _takes(spark, sources: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, sid, blocks, first, n): each shard's slots of each source, first: number of the source's slots before."""
    groups = sources.groupBy((F.floor(F.col("sid") / GROUP)).alias("group")).agg(F.sum("slots").alias("all"), F.transform(F.array_sort(F.collect_list(F.struct("sid", "slots"))), lambda x: x["slots"]).alias("slots"))
    groups = _dist.materialize(groups, "groups")
    top = [r["all"] for r in groups.select("group", "all").orderBy("group").collect()]
    shards = -(-total // shard_slots)
    drawn = spark.range(shards).mapInPandas(_group_draws(top, shard_slots, seed), "shard long, group long, n long")
    if len(top) <= 64:  # up to 64 * GROUP numbers
        told = drawn.join(F.broadcast(groups.select("group", "slots")), "group")
    else:
        drawn = _dist.materialize(drawn, "group-draws")
        facts = groups.join(drawn.groupBy("group").agg(F.count("*").alias("uses")), "group").select("group", "slots", "uses")
        told = _dist.attach(drawn, facts, "group", "uses", -1 - F.col("shard"), drawn.count(), parts=256)
    draws = _dist.materialize(told.select("shard", "group", "n", "slots").mapInPandas(_source_draws(seed), "shard long, sid long, n long"), "draws")
    counts = draws.groupBy("sid").agg(F.sum("n").alias("drawn"), F.count("*").alias("uses"))
    zero = F.lit(0).cast("long")
    quotas = _dist.materialize(sources.where("slots > 0").join(counts, "sid", "left").select("sid", "blocks", "slots", F.coalesce("drawn", zero).alias("drawn"), F.coalesce("uses", zero).alias("uses")), "quotas")
    placed = running(draws.withColumn("coarse", F.shiftright("shard", 10)), "sid", "coarse", ["shard"], "n", "first")
    placed = _dist.attach(placed, quotas, "sid", "uses", -1 - F.col("shard"), draws.count())
    inside = F.least("n", F.greatest(F.col("slots") - F.col("first"), zero))
    trimmed = _dist.materialize(placed.select("shard", "sid", "blocks", "first", inside.alias("n"), (F.col("n") - inside).alias("freed")), "trimmed")
    # slots freed in their shards, numbered, meet the missing ones of all sources in pseudorandom order
    free = trimmed.where("freed > 0").groupBy("shard").agg(F.sum("freed").alias("n")).withColumns({"one": zero, "coarse": F.shiftright("shard", 10)})
    free = running(free, "one", "coarse", ["shard"], "n", "at").select("shard", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at"))
    missing = quotas.where("slots > drawn").select("sid", "blocks", F.col("drawn").alias("first"), (F.col("slots") - F.col("drawn")).alias("n"), zero.alias("one"), F.shiftright("sid", 10).alias("coarse"))
    n_missing = missing.agg(F.sum("n")).first()[0] or 0
    missing = running(missing, "one", "coarse", ["sid"], "n", "at").select("sid", "blocks", "first", "at", F.explode(F.sequence(zero, F.col("n") - 1)).alias("i"))
    missing = missing.select((F.col("at") + F.col("i")).alias("unit"), "sid", "blocks", (F.col("first") + F.col("i")).alias("first"))
    columns = ["shard", "sid", "blocks", "first", "n"]
    takes = trimmed.where("n > 0").select(*columns)
    if n_missing:
        # missing has a row a slot, which Spark takes for a row a source: no broadcast
        settled = free.mapInPandas(_permuted(n_missing, seed), "shard long, unit long").join(missing.hint("merge"), "unit").withColumn("n", F.lit(1).cast("long"))
        takes = takes.union(settled.select(*columns))
    return takes


def mixture(docs: DataFrame, block_words: int = 128, shard_slots: int = 4096, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 1, texts: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(documents, pieces) of the mix of docs(doc_id, text, source).

    documents: doc_id, row, source, size, source_size, target of each row; size counts runs of other
    characters than ASCII white space, null texts none. pieces: shard, sid, slot, block, at_word, row,
    doc_id, source, from_word, words: what each slot of the output takes of which documents, at_word the
    place in the slot; with texts, text too, the words joined by spaces; None if there are no words. A
    null source is a source of its own, the last one. Rows that repeat one another share their words'
    places. A long text is split in one task and shuffled block by block.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    source = F.col("source").cast("string")
    key = F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))  # nulls last
    at = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), text)
    sized = docs.select("doc_id", source.alias("source"), key.alias("key"), F.size(split).cast("long").alias("size"), at.alias("at"), F.monotonically_increasing_id().alias("row"), *([text.alias("text")] if texts else []))
    sized = _dist.materialize(sized, "sized")
    found = sized.groupBy("key").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    found = numbered(found, "key", "sources").withColumnRenamed("rank", "sid").withColumn("sid", F.col("sid").cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    known = targets(_dist.materialize(found.withColumn("weight", weight), "weighted"), share, most)
    length = F.least(F.lit(block_words), F.greatest(F.lit(1), F.ceil(F.col("words") / LEAST_BLOCKS)))
    known = known.withColumn("length", length.cast("long")).withColumn("blocks", F.ceil(F.col("words") / F.col("length"))).withColumn("slots", F.when(F.col("words") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("words")), F.floor(most * F.col("blocks")))).otherwise(0).cast("long"))
    known = _dist.materialize(known.select("key", "docs", "sid", F.col("words").alias("source_size"), "target", "length", "blocks", "slots"), "known")
    total, rows = known.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    told = _dist.attach(sized, known.select("key", "docs", "sid", "source_size", "target", "length"), "key", "docs", F.concat(F.lit("#"), F.col("row").cast("string")), rows)
    documents = told.select("doc_id", "row", "source", "size", "source_size", "target")
    if not total:
        return documents, None
    bits = max(6, math.ceil(math.log2(rows / 20_000 + 1)))
    placed = told.where("size > 0").select("row", "doc_id", "source", "sid", "length", "size", "at", F.shiftright("at", 64 - bits).alias("coarse"), *(["text"] if texts else []))
    placed = running(placed, "sid", "coarse", ["at", "row"], "size", "start")
    first = F.floor(F.col("start") / F.col("length"))
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("length"))
    columns = ["row", "doc_id", "source", "sid"]
    if texts:
        placed = placed.withColumn("w", split)  # before blocks are told apart, so once a document
    parts = placed.select(*columns, "length", "start", "size", *(["w"] if texts else []), F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * F.col("length"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    parts = parts.select(*columns, "block", *(["w"] if texts else []), (begin - F.col("start")).alias("from_word"), (begin - F.col("block") * F.col("length")).alias("at_word"), (end - begin).alias("words"))
    if texts:
        parts = parts.withColumn("text", F.array_join(F.slice("w", (F.col("from_word") + 1).cast("int"), F.col("words").cast("int")), " ")).drop("w")
    takes = _takes(spark, known, total, shard_slots, seed)
    tasks = -(-total // max(TASK_SLOTS, total // 20_000))
    chosen = takes.repartition(tasks, "shard", "sid").mapInPandas(_slots(seed), "shard long, sid long, slot long, block long")
    # chosen has a row a slot, which Spark takes for a row a draw, as it doesn't know what the function adds: no broadcast
    pieces = chosen.hint("merge").join(parts, ["sid", "block"])
    return documents, pieces.select("shard", "sid", "slot", "block", "at_word", "row", "doc_id", "source", "from_word", "words", *(["text"] if texts else []))


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken (words that the mix takes of it, repeats counted), row.

    No document gives more than `most` (2) times its size. Reruns over the same rows agree. Empty tables
    give no rows; wordless documents give no words; other columns don't matter.
    """
    documents, pieces = mixture(docs, **options)
    zero = F.lit(0).cast("long")
    if pieces is None:
        return documents.select("doc_id", "source", "size", "source_size", "target", zero.alias("taken"), "row")
    sums = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(sums, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), "row")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: shard, slot, at_word, doc_id, source, from_word, words, text. A slot's pieces in the order of at_word are block_words words, fewer in small sources and at a source's end; slot numbers are those of a source, so a shard's slots are told apart by (source, slot)."""
    pieces = mixture(docs, texts=True, **options)[1]
    columns = ["shard", "slot", "at_word", "doc_id", "source", "from_word", "words", "text"]
    if pieces is None:
        kind = dict(docs.dtypes)["doc_id"]
        return docs.sparkSession.createDataFrame([], f"shard long, slot long, at_word long, doc_id {kind}, source string, from_word long, words long, text string")
    return pieces.select(*columns)
