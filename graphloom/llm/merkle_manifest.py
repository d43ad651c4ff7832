"""A Merkle manifest of a dataset, its leaves placed by ranks in bitmaps.

Each group's ids form a bitmap that keeps only its words of 64 bits with a bit set; words of partitions
merge by OR. A popcount directory, a tree of 2^15 words a node, says how many leaves come before a
word, so a leaf's place is one look-up and one bit count, and no group is ever sorted. Places key slot
arrays of 3^6 nodes, each of which one row reduces by six levels; the reduced nodes are placed already.
Paths go down again the same way, so that each row gives its leaves' proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _dist
from .source_mix import numbered

ARITY, LEVELS = 3, 6
#: Nodes of a slot array.
SLOTS = ARITY**LEVELS
#: Children of a node of the directory are numbered by so many bits.
FAN_BITS = 15
#: Equal rows that are written out at once.
REPEATS = 10_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the values, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def before(rows: DataFrame, group: list[str], key: str, weight: str) -> DataFrame:
    """rows(group..., key, weight), one for each key of a group, with `before`: the weights of lower keys of its group. Keys are longs from 0; no window holds over 2^FAN_BITS rows."""
    most = rows.agg(F.max(key)).first()[0] or 0
    levels = [rows]
    while most >> FAN_BITS:
        above = levels[-1].withColumn(key, F.shiftright(key, FAN_BITS)).groupBy(*group, key).agg(F.sum(weight).alias(weight))
        levels.append(_dist.materialize(above, "directory"))
        most >>= FAN_BITS
    found = None
    for level in reversed(levels):
        parent = F.shiftright(key, FAN_BITS)
        mine = level.withColumn("before", F.sum(weight).over(Window.partitionBy(*group, parent).orderBy(key)) - F.col(weight))
        if found is not None:
            top = found.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(key).alias("__key"), F.col("before").alias("__before"))
            same = parent == F.col("__key")
            for g in group:
                same &= F.col(g) == F.col(f"__{g}")
            mine = mine.join(top, same).withColumn("before", F.col("before") + F.col("__before")).select(*level.columns, "before")
        found = mine
    return found


def _placed(rows: DataFrame) -> DataFrame:
    """rows(sid, leaves, doc_id, leaf, altered, n) with `place`, the number of leaves of its group before the first of its n equal ones."""
    low = rows.agg(F.min("doc_id")).first()[0] or 0
    word = F.coalesce(F.shiftright("doc_id", 6) - F.lit((low >> 6) - 1), F.lit(0).cast("long"))  # null ids come first
    bit = F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0).cast("long")).cast("int")
    rows = rows.withColumns({"word": word, "bit": bit})
    one, ones = F.lit(1).cast("long"), F.lit(-1).cast("long")
    bits = lambda shown: F.call_function("shiftleft", shown, F.col("bit"))
    words = _dist.materialize(rows.groupBy("sid", "word").agg(F.bit_or(bits(one)).alias("bits"), F.sum("n").alias("size")), "words")
    directory = before(words.select("sid", "word", "size"), ["sid"], "word", "size")
    facts = _dist.materialize(words.join(directory.drop("size"), ["sid", "word"]), "ranks")
    total = facts.agg(F.sum("size")).first()[0] or 0
    own = F.xxhash64("leaf", "bit")
    found = _dist.attach(rows, facts, "word", "size", own, total, extra=["sid"])
    place = F.col("before") + F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(bits(ones))))
    several = F.col("size") > F.bit_count("bits")
    single = found.where(~several).withColumn("place", place)
    columns = [*rows.columns, "place"]
    if not facts.where(several).limit(1).count():
        return single.select(*columns)
    # words in which ids repeat: leaves before the id by weights, before the leaf by its digest
    found = _dist.materialize(found.where(several), "repeated")
    ids = _dist.materialize(found.groupBy("sid", "word", "bit").agg(F.sum("n").alias("of_id"), F.countDistinct("leaf").alias("kinds")), "ids")
    lower = ids.withColumn("lower", F.sum("of_id").over(Window.partitionBy("sid", "word").orderBy("bit")) - F.col("of_id"))  # up to 64 rows
    found = _dist.attach(found, lower, "word", "of_id", own, total, extra=["sid", "bit"])
    found = _dist.materialize(found.withColumn("start", F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long")), "starts")
    group = ["sid", "word", "bit"]
    starts = found.groupBy(*group, "start").agg(F.sum("n").alias("weight"), F.count("*").alias("rows"))
    starts = _dist.materialize(before(_dist.materialize(starts, "start-sizes"), group, "start", "weight").withColumnRenamed("before", "earlier"), "earlier")
    found = _dist.attach(found, starts.drop("weight"), "start", "rows", F.xxhash64("altered"), found.count(), extra=group)
    same = Window.partitionBy(*group, "start").orderBy("leaf", "altered")  # rows whose digests begin alike, so very few
    inside = F.sum("n").over(same.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return single.select(*columns).union(found.withColumn("place", F.col("before") + F.col("lower") + F.col("earlier") + inside).select(*columns))


def depth(n: int) -> int:
    """Levels above n nodes until one remains."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def up(nodes: list[str]) -> list[str]:
    """The level above: each run's digest."""
    return [hashlib.sha256("".join(nodes[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(nodes), ARITY)]


def tree(nodes: list[str], levels: int) -> list[list[str]]:
    out = [nodes]
    for _ in range(levels):
        out.append(up(out[-1]))
    return out


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """(left, right) digests of the other nodes of the run of node `at`, level by level."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % ARITY
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + ARITY])))
        at //= ARITY
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def _local(n: int) -> int:
    """Levels that a slot array of a tree of n nodes reduces."""
    return depth(n) if n <= SLOTS else LEVELS


def _reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (sid, n, block, digest) of slot arrays."""
    for frame in frames:
        digests = [tree([s["digest"] for s in sorted(r.slots, key=lambda s: s["slot"])], _local(r.n))[-1][0] for r in frame.itertuples()]
        yield pd.DataFrame({"sid": frame.sid, "n": frame.n, "block": frame.block, "digest": digests})


PATH = "array<struct<left:string,right:string>>"


def _paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (sid, node, path) of the nodes of slot arrays with a path of their own."""
    for frame in frames:
        out = []
        for r in frame.itertuples():
            slots = sorted(r.slots, key=lambda s: s["slot"])
            levels = tree([s["digest"] for s in slots], _local(r.n))
            own = [(p["left"], p["right"]) for p in r.path]
            out += [(r.sid, r.block * SLOTS + s["slot"], siblings(levels, s["slot"]) + own) for s in slots]
        yield pd.DataFrame(out, columns=["sid", "node", "path"])


def _proofs(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                slots = sorted(r.slots, key=lambda s: s["slot"])
                levels = tree([s["digest"] for s in slots], _local(r.n))
                own = [(p["left"], p["right"]) for p in r.path]
                for s in slots:
                    path = siblings(levels, s["slot"]) + own
                    folded = fold(s["altered"] or s["digest"], path)
                    proof = hashlib.sha256("".join(x for p in path for x in p).encode()).hexdigest()
                    out.append((s["doc_id"], s["digest"], r.subroot, root, proof, folded, folded == root))
            yield pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def _arrays(nodes: DataFrame, *more: str) -> DataFrame:
    """(sid, n, block, slots) of nodes(sid, n, place, digest, ...), at most SLOTS in a row."""
    slot = F.struct((F.col("place") % SLOTS).cast("int").alias("slot"), "digest", *more)
    return nodes.groupBy("sid", "n", F.floor(F.col("place") / SLOTS).alias("block")).agg(F.collect_list(slot).alias("slots"))


def _grown(arrays: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(slot arrays by round, the roots (sid, digest)) of trees of at most `most` nodes."""
    rounds, roots = [arrays], []
    while True:
        made = _dist.materialize(rounds[-1].select("sid", "n", "block", "slots").mapInPandas(_reduce, "sid long, n long, block long, digest string"), f"{name}-nodes")
        roots.append(made.where(F.col("n") <= SLOTS).select("sid", "digest"))
        if most <= SLOTS:
            break
        most = -(-most // SLOTS)
        above = made.where(F.col("n") > SLOTS).select("sid", F.ceil(F.col("n") / SLOTS).alias("n"), F.col("block").alias("place"), "digest")
        rounds.append(_dist.materialize(_arrays(above), f"{name}-arrays"))
    found = roots[0]
    for r in roots[1:]:
        found = found.union(r)
    return rounds, _dist.materialize(found, f"{name}-roots")


def _down(rounds: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """rounds[0] with the path above each slot array; tops(sid, path): the path above each tree."""
    found = None
    for arrays in reversed(rounds):
        whole = arrays.where(F.col("n") <= SLOTS).join(tops, "sid")
        if found is not None:
            whole = whole.unionByName(arrays.where(F.col("n") > SLOTS).join(found.withColumnRenamed("node", "block"), ["sid", "block"]).select(whole.columns))
        if arrays is not rounds[0]:
            found = _dist.materialize(whole.select("sid", "n", "block", "slots", "path").mapInPandas(_paths, f"sid long, node long, path {PATH}"), f"{name}-paths")
    return whole


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs(doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of a row's columns. Each source's leaves, by ascending doc_id, are a tree of
    runs of three; its root (subroot) is a leaf of the tree over all sources, by their UTF-8 bytes, null
    first. proof_sha256: digest of the siblings on a leaf's way to the root, left to right, level by
    level. changed: columns as they are found when a row is verified; folded_root is what the row's leaf
    of them and the stored siblings give, verified whether that is the root.

    doc_id must be an integer; null comes first. Of rows with one source and doc_id, leaves ascend by
    their digests, and equal rows have places of their own. A group or an id may hold any part of the
    rows. Very long texts are only hashed. Empty tables give no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be an integer, not {kind}")
    now = [F.col(c) for c in COLUMNS]
    later = [(changed or {}).get(c, F.col(c)) for c in COLUMNS]
    source = F.col("source").cast("string")
    key = F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))
    altered = leaf_digest(later) if changed else F.lit(None).cast("string")
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf_digest(now)).alias("leaf"), F.unhex(altered).alias("altered"))
    rows = rows.withColumn("altered", F.nullif("altered", "leaf"))
    rows = _dist.materialize(rows.groupBy("key", "doc_id", "leaf", "altered").agg(F.count("*").alias("n")), "leaves")
    sources = _dist.materialize(rows.groupBy("key").agg(F.sum("n").alias("leaves"), F.count("*").alias("rows")), "sources")
    n_sources, most, total = sources.agg(F.count("*"), F.max("leaves"), F.sum("rows")).first()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not n_sources:
        return spark.createDataFrame([], schema)
    sources = _dist.materialize(numbered(sources, "key", "numbered").withColumnRenamed("rank", "sid"), "sids")
    told = _dist.attach(rows, sources, "key", "rows", F.hex("leaf"), total).drop("key", "rows")
    placed = _placed(_dist.materialize(told, "told"))
    # equal rows are written out in parts, so that one that repeats very often spreads
    parts = placed.where("n > 1").withColumn("at", F.explode(F.expr(f"sequence(place, place + n - 1, {REPEATS}L)"))).repartition("sid", "at")
    every = parts.withColumn("place", F.explode(F.expr(f"sequence(at, least(at + {REPEATS} - 1, place + n - 1))"))).drop("at").unionByName(placed.where("n = 1"))
    hexed = lambda c: F.lower(F.hex(c))
    nodes = every.select("sid", F.col("leaves").alias("n"), "place", hexed("leaf").alias("digest"), hexed("altered").alias("altered"), F.col("doc_id").cast("string").alias("doc_id"))  # pandas has no null integers
    rounds, subroots = _grown(_dist.materialize(_arrays(nodes, "altered", "doc_id"), "leaf-arrays"), most, "group")
    zero = F.lit(0).cast("long")
    upper = _arrays(subroots.select(zero.alias("sid"), F.lit(n_sources).cast("long").alias("n"), F.col("sid").alias("place"), "digest"))
    tops, roots = _grown(_dist.materialize(upper, "top-arrays"), n_sources, "top")
    root = roots.first().digest
    start = spark.range(1).select(F.col("id").alias("sid"), F.array().cast(PATH).alias("path"))
    by_source = _down(tops, start, "top").mapInPandas(_paths, f"sid long, node long, path {PATH}").select(F.col("node").alias("sid"), "path")
    by_source = _dist.materialize(by_source, "source-paths")
    found = _down(rounds, by_source, "group").join(subroots.withColumnRenamed("digest", "subroot"), "sid")
    return found.select("sid", "n", "block", "slots", "path", "subroot").mapInPandas(_proofs(root), schema.replace(f"doc_id {kind}", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast(kind))


def without_line_ends() -> dict[str, Column]:
    """Rows whose decimal doc_id has an even CRC-32 lose the line ends of their texts."""
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
