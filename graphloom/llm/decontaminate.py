"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

All steps are DataFrame functions. Every window of a document's words is hashed inside one generated
loop and probes the broadcast hashes, in blocks if there are very many; the hits then meet the windows
by the SHA-256 of their words. Only hits move, as hashes and digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _dist

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same classes before lower-casing: a word with what stands before it, and what stands at the end.
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"
#: Hashes of windows in one broadcast: 8 bytes each, some 40 in its table. More of them are probed in blocks of this many.
BLOCK_WINDOWS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters keep their case. lower() does that, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def word_hashes(words_: Column) -> Column:
    """A 64-bit hash of each word, so that a window hashes numbers and not texts."""
    return F.transform(words_, lambda w: F.xxhash64(w))


def _digest(window: Column) -> Column:
    """SHA-256 of a window's words; words have no spaces."""
    return F.unhex(F.sha2(F.array_join(window, " "), 256))


def windows(benchmark: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Distinct windows of n consecutive item words (hash, digest, size, item_set), and the item_sets (item_set, items): items that have a window. An item of fewer words, but not none, is one window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumns({"size": F.least(F.size("w"), F.lit(n)), "h": word_hashes(F.col("w"))})
    each = items.select("item", "size", "w", "h", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    each = each.select("item", "size", F.xxhash64(F.slice("h", F.col("at"), F.col("size"))).alias("hash"), _digest(F.slice("w", F.col("at"), F.col("size"))).alias("digest"))
    found = each.groupBy("hash", "digest", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = _dist.materialize(found.withColumn("item_set", F.sha2(F.to_json("items"), 256)), "windows")
    return found.drop("items"), found.groupBy("item_set").agg(F.any_value("items").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, block: int = BLOCK_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, spans, item_sets) of each contaminated row of docs(doc_id, text), and the item sets of windows(). spans: sorted (first word, word after the last) of every occurrence."""
    found, item_sets = windows(benchmark, n)
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect()) or [n]  # at most n values
    hashes = found.select(F.col("hash").alias("__hash")).distinct()
    blocks = -(-hashes.count() // block) or 1
    split = docs.select("doc_id", _dist.row_key("doc_id", "text").alias("row_key"), words(F.col("text")).alias("w")).withColumn("h", word_hashes(F.col("w")))
    at = split.select("doc_id", "row_key", "w", "h", F.posexplode("h").alias("pos", "word")).drop("word")
    size = F.lit(sizes[0]) if len(sizes) == 1 else F.explode(F.array(*[F.lit(s) for s in sizes]))
    at = at.withColumn("size", size).where(F.col("pos") + F.col("size") <= F.size("h")).withColumn("hash", F.xxhash64(F.slice("h", F.col("pos") + 1, F.col("size"))))
    met = None
    for i in range(blocks):
        probe = hashes if blocks == 1 else hashes.where(F.pmod("__hash", F.lit(blocks)) == i)
        part = at.join(F.broadcast(probe), F.col("hash") == F.col("__hash")).select("doc_id", "row_key", "pos", "size", "hash", _digest(F.slice("w", F.col("pos") + 1, F.col("size"))).alias("digest"))
        met = part if met is None else met.unionByName(part)
    met = _dist.materialize(met, "probed")
    uses = met.groupBy("hash").agg(F.count("*").alias("uses"))
    facts = found.select("hash", "digest", "item_set").join(uses, "hash")
    sure = _dist.attach(met, facts, "hash", "uses", F.xxhash64("doc_id", "row_key", "pos"), met.count(), extra=["digest"]).where("item_set is not null")
    spans = F.array_sort(F.collect_set(F.struct("pos", (F.col("pos") + F.col("size")).alias("end")))).alias("spans")
    return sure.groupBy("doc_id", "row_key").agg(spans, F.array_sort(F.collect_set("item_set")).alias("item_sets")), item_sets


def covered(spans: Column) -> Column:
    """Words that sorted spans cover together."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))

    def add(acc: Column, s: Column) -> Column:
        fresh = F.greatest(s["end"] - F.greatest(s["pos"], acc["reach"]), F.lit(0))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["reach"], s["end"]).alias("reach"))

    return F.aggregate(spans, none, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, row_key.

    Words: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. n_hit: words inside
    any occurrence of a window of a benchmark item; n_items: items with occurring windows, whose ids,
    sorted as strings and joined by commas, items_sha256 digests (of no items, the empty string). Null
    texts have no words; wordless items no windows; a null item_id counts as an empty one. Rows that
    repeat one another get equal results. A long text is split in one task, whose memory holds its words
    once. Empty tables and extra columns are fine.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    met, item_sets = hits(docs, benchmark, n, block)
    met = _dist.materialize(met.select("doc_id", "row_key", covered(F.col("spans")).alias("n_hit"), "item_sets", F.xxhash64("item_sets").alias("combo")), "hits")
    # items of each distinct combination of item sets, of which there are few, however many documents have it
    combos = met.groupBy("combo", "item_sets").agg(F.count("*").alias("uses"))
    named = combos.select("combo", "item_sets", "uses", F.explode("item_sets").alias("item_set")).join(item_sets, "item_set").select("combo", "item_sets", "uses", F.explode("items").alias("item"))
    named = named.groupBy("combo", "item_sets", "uses").agg(F.array_sort(F.collect_set("item")).alias("items"))
    facts = named.select("combo", "item_sets", "uses", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    rows = met.count()
    told = _dist.attach(met, _dist.materialize(facts, "combos"), "combo", "uses", F.xxhash64("doc_id", "row_key"), rows, extra=["item_sets"])
    told = told.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__row"), "n_hit", "n_items", "items_sha256")
    each = docs.select("doc_id", _dist.row_key("doc_id", "text").alias("row_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = each.join(_dist.small_or_shuffled(told, rows), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__row")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"), "row_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", block: int = BLOCK_WINDOWS) -> DataFrame:
    """docs without contaminated rows, or (remove="spans") with the words of all occurrences cut from their texts; columns stay, whatever their names, null texts too."""
    text = F.col("text").cast("string")
    met = _dist.materialize(hits(docs.select("doc_id", text.alias("text")), benchmark, n, block)[0].select("doc_id", "row_key", *(["spans"] if remove == "spans" else [])), "hits")
    key = _dist.row_key("doc_id", text)
    rows = met.count()
    if not rows:
        return docs
    if remove == "documents":
        return _dist.matching(docs, met, rows, key, "left_anti")
    id_, row, spans = _dist.free_names(docs.columns, "__id", "__row", "__spans")
    # spans have no fixed size, so this join may shuffle texts
    joined = docs.join(met.toDF(id_, row, spans), F.col("doc_id").eqNullSafe(F.col(id_)) & (key == F.col(row)), "left")
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), 0)
    # places as sets, so the work grows with the words and the spans, not with their product
    inside = F.flatten(F.transform(spans, lambda s: F.sequence(s["pos"].cast("int"), s["end"].cast("int") - 1)))
    left = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), inside)
    rest = F.transform(F.array(pieces), lambda p: F.transform(left(p), lambda i: F.get(p, i)))[0]
    cut = F.when(F.col(spans).isNull(), text).otherwise(F.concat(F.array_join(rest, ""), F.regexp_extract(text, _TAIL, 0)))
    return joined.select(*[cut.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
