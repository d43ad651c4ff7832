"""Jaccard self-join of shingle sets with adaptive multi-match prefixes.

A document's set is its distinct word shingles, ordered by hash. Two sets with a Jaccard similarity of
t or more share at least m tokens among their first |r| - ceil(t |r|) + m ones, for any m: the longer
the prefix, the more of its tokens must match.

1. Copies: equal sets get one 64-bit identifier, checked against 128 bits.
2. Prefix rows (token, set) are counted in Spark. A set that has, for any of the levels of m, fewer
   than m tokens that another set has too can't link with any set and goes.
3. The level of each size band is the one whose tokens promise the fewest candidates. Pairs are counted
   over light tokens, those of few sets, and must share m tokens. Sets with m or more heavy tokens may
   share those only; their prefix grows to the whole set, of which all but the rarest tokens may go: they
   are linked to one set of each token that is left, not to all.
4. Sets so linked form clusters; whole shingle sets of those only are read again. Clusters are joined
   in blocks of bounded size, where each document takes the prefix length with the lowest estimated
   cost, pairs must share as many prefix tokens as the shorter of both asks for, and pairs of sets that
   aren't connected yet are verified exactly. A large cluster is cut in parts by the least hash of each
   set, which near copies mostly share; after the parts' own links, those parts meet that still have
   candidates in different components, and of them the sets with such candidates only.

Blocks give a spanning forest of the links, never all pairs of a group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _dist
from ._words import Words, shingles, signed, slices

#: Share of a set by which the levels lengthen a prefix.
LEVELS = (0.0, 0.025, 0.05)
#: Shingles in a part of a cluster, and in a pool of small clusters. A set with more is a part of its own.
PART_TOKENS, POOL_TOKENS = 500_000, 250_000
#: Sets that may have a light token. Pairs of a light token are at most half that for each of its rows.
LIGHT = 24


def overlap(size: int | np.ndarray, num: int, den: int):
    """The fewest tokens that a set of this size shares with a linked one."""
    return -(-num * size // den)


def _sets(k: int, seed: int):
    made = [(name, pa.int64()) for name in ("doc_row", "row_key", "size", "set_id", "set_check")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                tokens, at = shingles(words, words.hashes(), k)
                digests = b"".join(_digest(tokens[at[i] : at[i + 1]], seed) for i in range(len(at) - 1))
                ids = np.frombuffer(digests, np.int64).reshape(-1, 2)
                n = part.num_rows
                columns = [pa.array(np.arange(row, row + n, dtype=np.int64)), part.column("row_key"), pa.array(np.diff(at).astype(np.int64)), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], schema=pa.schema([part.schema.field("doc_id"), *made]))
                row += n

    return run


def _digest(tokens: np.ndarray, seed: int) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=seed.to_bytes(8, "big")).digest()


def _prefixes(k: int, num: int, den: int, seed: int):
    schema = pa.schema([("token", pa.int64()), ("set_id", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets of this task; one identifier each
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                tokens, at = shingles(words, words.hashes(), k)
                sizes = np.diff(at)
                lengths = np.minimum(sizes, sizes - overlap(sizes, num, den) + 1 + (LEVELS[-1] * sizes).astype(np.int64))
                ids = np.zeros(len(sizes), np.int64)
                for i in np.flatnonzero(sizes):
                    ids[i] = np.frombuffer(_digest(tokens[at[i] : at[i + 1]], seed), np.int64)[0]
                    if int(ids[i]) in seen:
                        lengths[i] = 0
                    seen.add(int(ids[i]))
                rank = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                pick = np.repeat(at[:-1], lengths) + rank
                yield pa.RecordBatch.from_arrays([pa.array(signed(tokens[pick])), pa.array(np.repeat(ids, lengths)), pa.array((np.repeat(sizes, lengths) << 32) | rank)], schema=schema)

    return run


def _levels(sizes, num: int, den: int):
    """Of each level: matches asked for, and length of the prefix."""
    for share in LEVELS:
        m = 1 + (share * sizes).astype(np.int64)
        yield m, np.minimum(sizes, sizes - overlap(sizes, num, den) + m)


def _costs(num: int, den: int):
    """Sets that may have links, with the candidates to expect at each level."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for set_id, places, tokens, uses in zip(frame.set_id, frame.place, frame.token, frame.uses, strict=True):
                places = np.asarray(places)
                size, ranks = int(places[0] >> 32), places & 0xFFFFFFFF
                costs = []
                for m, length in _levels(np.int64(size), num, den):
                    inside = int(np.searchsorted(ranks, length))
                    if inside < m:
                        break
                    costs.append(float(np.sort(np.asarray(uses)[:inside])[: inside - int(m) + 1].sum()))
                else:
                    out.append((set_id, size, band(size, num, den), tokens, uses, ranks, *costs))
            yield pd.DataFrame(out, columns=["set_id", "size", "band", "tokens", "uses", "ranks", *[f"cost{i}" for i in range(len(LEVELS))]])

    return run


def band(size: int, num: int, den: int) -> int:
    """Linked sets are in the same or in neighbouring bands."""
    return int(math.log(size) / math.log(den / num) + 1e-9)


def _kept(num: int, den: int, levels: dict[int, int]):
    """Rows (token, set_id, size, need): tokens of each set's prefix at the level of its band, and how many of them a linked set surely shares."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                own = levels.get(r.band, 0)
                least = min(own, levels.get(r.band - 1, own), levels.get(r.band + 1, own))
                inside = int(np.searchsorted(r.ranks, list(_levels(np.int64(r.size), num, den))[own][1]))
                need = 1 + int(LEVELS[least] * overlap(r.size, num, den))
                out.append(pd.DataFrame({"token": np.asarray(r.tokens)[:inside], "set_id": r.set_id, "size": r.size, "need": need}))
            yield pd.concat(out) if out else pd.DataFrame({"token": [], "set_id": [], "size": [], "need": []})

    return run


def _whole(k: int):
    """The whole shingle sets of rows (text, set_id, cluster, side, pool) in place of their texts."""
    kept = ["set_id", "cluster", "side", "pool"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                tokens, at = shingles(words, words.hashes(), k)
                packed = [tokens[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(packed, pa.binary())], names=[*kept, "tokens"])

    return run


def _tokens(k: int):
    """Rows (token, set_id) of rows (text, set_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                tokens, at = shingles(words, words.hashes(), k)
                ids = np.repeat(part.column("set_id").to_numpy(), np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(signed(tokens)), pa.array(ids)], names=["token", "set_id"])

    return run


def link_block(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Labels of the components of a block: sets of 64-bit tokens; only pairs of different sides are linked, or all if there is one side.

    The label is the first position of a component. Tokens are ordered by how many sets of the block
    have them; each set takes the prefix with the lowest estimated cost.
    """
    n = len(sets)
    labels = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, local, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(uses), np.int64)
    order[np.argsort(uses, kind="stable")] = np.arange(len(uses))
    rank = order[local]
    sort = np.lexsort((rank, owner))
    tokens, freq = rank[sort], uses[local][sort]
    at = np.concatenate([[0], np.cumsum(sizes)])
    shared = np.add.reduceat(np.append(freq > 1, 0).astype(np.int64), at[:-1])  # tokens that any other set has
    least = overlap(sizes, num, den)
    # the prefix of each set: scanning its postings costs their length, verifying costs about a set for each candidate
    total = np.concatenate([[0], np.cumsum(freq)])
    best = np.full(n, np.inf)
    length, asked = np.zeros(n, np.int64), np.ones(n, np.int64)
    for share in (0.0, 0.01, 0.02, 0.04, 0.08, 0.16):
        m = 1 + (share * sizes).astype(np.int64)
        p = np.minimum(sizes, sizes - least + m)
        m = np.minimum(m, p)
        scanned = (total[at[:-1] + p] - total[at[:-1]]).astype(float)
        cost = scanned + scanned / m * sizes / 4
        better = cost < best
        best[better], length[better], asked[better] = cost[better], p[better], m[better]
    alive = shared >= least
    length[~alive] = 0
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    pick = np.repeat(at[:-1], length) + within
    pick_owner = np.repeat(np.arange(n), length)
    some = freq[pick] > 1
    pick, pick_owner = pick[some], pick_owner[some]
    by_token = np.argsort(tokens[pick], kind="stable")
    post_token, post_owner = tokens[pick][by_token], pick_owner[by_token]
    starts = np.searchsorted(post_token, np.arange(len(uses) + 1))
    own_at = np.searchsorted(pick_owner, np.arange(n + 1))
    two = len(np.unique(side)) > 1
    marked = np.zeros(len(uses), bool)
    for r in np.flatnonzero(alive):
        mine = tokens[pick[own_at[r] : own_at[r + 1]]]
        if not len(mine):
            continue
        found = np.concatenate([post_owner[starts[t] : starts[t + 1]] for t in mine])
        found = found[found < r]
        if not len(found):
            continue
        hits = np.bincount(found, minlength=r)
        cand = np.flatnonzero(hits)
        pair = -(-num * (sizes[cand] + sizes[r]) // (num + den))  # tokens that a linked pair of these sizes shares
        good = (hits[cand] >= np.minimum(asked[cand], asked[r])) & (np.minimum(shared[cand], shared[r]) >= pair) & (np.minimum(sizes[cand], sizes[r]) >= pair)
        if two:
            good &= side[cand] != side[r]
        cand = cand[good]
        cand = cand[np.argsort(-hits[cand], kind="stable")]
        marked[tokens[at[r] : at[r + 1]]] = True
        while len(cand := cand[labels[cand] != labels[r]]):
            now, cand = cand[:128], cand[128:]
            lens = sizes[now]
            flat = np.repeat(at[now], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            both = np.add.reduceat(marked[tokens[flat]].astype(np.int64), np.cumsum(lens) - lens)
            for s in now[den * both >= num * (lens + sizes[r] - both)]:
                a, b = sorted((int(labels[s]), int(labels[r])))
                if a != b:
                    labels[labels == b] = a
        marked[tokens[at[r] : at[r + 1]]] = False
    return labels


def _blocks(num: int, den: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, cluster in frame.groupby("cluster", sort=True):
            cluster = cluster.drop_duplicates("set_id").sort_values("set_id", kind="stable")
            if len(cluster) < 2:
                continue
            ids = cluster.set_id.to_numpy()
            labels = link_block([np.frombuffer(t, np.uint64) for t in cluster.tokens], cluster.side.to_numpy(), num, den)
            linked = np.flatnonzero(labels != np.arange(len(ids)))
            a.append(ids[linked])
            b.append(ids[labels[linked]])
        return pd.DataFrame({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, seed: int = 0) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, row_key, kept.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a set is the distinct
    shingles of k words, of a shorter text the whole sequence. Sets link when den * |both| >= num *
    |either|; component_id is the smallest doc_id reachable by links, itself included. Null and
    wordless texts have empty sets and link with nothing: their component_id is their doc_id. kept:
    true for one row of each component, that with the smallest doc_id (null ids last; of rows that
    repeat a doc_id, one), and for each empty set. A doc_id may be of any type with an order. The set of
    a long text takes 8 bytes a word in the tasks that handle it. Empty tables give no rows; other
    columns don't matter.
    """
    table = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row_key", _dist.row_key("doc_id", "text"))
    table = _dist.small_batches(table)
    scan_schema = f"doc_id {dict(table.dtypes)['doc_id']}, doc_row long, row_key long, size long, set_id long, set_check long"
    for attempt in range(seed, seed + 5):
        rows = _dist.materialize(table.mapInArrow(_sets(k, attempt), scan_schema), "sets")
        sets = rows.where("size > 0").groupBy("set_id").agg(F.min("set_check").alias("c0"), F.max("set_check").alias("c1"), F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_row", "row_key")).alias("first"))
        sets = _dist.materialize(sets, "distinct")
        if not sets.where("c0 <> c1").limit(1).count():
            seed = attempt
            break
    else:
        raise RuntimeError("identifiers of shingle sets met for five seeds")
    edges = _links(table, sets, k, num, den, seed)
    roots = _dist.components(edges, "links")
    grouped = sets.join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").select("set_id", "copies", "first", F.coalesce("root", "set_id").alias("root"))
    grouped = _dist.materialize(grouped, "grouped")
    lows = grouped.groupBy("root").agg(F.min("first").alias("lowest"), F.count("*").alias("members"))
    facts = _dist.attach(grouped, lows, "root", "members", F.xxhash64("set_id", F.lit(1)), grouped.count())
    facts = _dist.materialize(facts.select("set_id", "copies", "lowest"), "facts")
    told = _dist.attach(rows, facts, "set_id", "copies", F.xxhash64("doc_row"), rows.count())
    empty = F.col("size") == 0
    return told.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("lowest.doc_id")).alias("component_id"),
        "row_key",
        (empty | F.coalesce(F.col("lowest.doc_row") == F.col("doc_row"), F.lit(False))).alias("kept"),
    )


def _texts(table: DataFrame, sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """The text of a document of each chosen set, with the columns of chosen."""
    first = sets.select("set_id", F.col("first.doc_id").alias("__id"), F.col("first.row_key").alias("__row"))
    named = _dist.materialize(chosen.join(first, "set_id"), "named")
    return table.join(_dist.small_or_shuffled(named, named.count()), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__row")))


def _links(table: DataFrame, sets: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    """Links (a, b) between set_ids that have the components of all links."""
    prefix = _dist.materialize(table.select("text").mapInArrow(_prefixes(k, num, den, seed), "token long, set_id long, place long"), "prefix")
    counts = prefix.groupBy("token").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi"), F.count("*").alias("uses")).where("lo <> hi")
    counts = _dist.materialize(counts.select("token", "uses"), "repeated")
    known = _dist.attach(prefix, counts, "token", "uses", F.xxhash64("set_id", "place"), counts.agg(F.sum("uses")).first()[0] or 0).where("uses is not null")
    found = known.groupBy("set_id").agg(F.array_sort(F.collect_set(F.struct("place", "token", "uses"))).alias("f")).select("set_id", "f.place", "f.token", "f.uses")
    costs = ", ".join(f"cost{i} double" for i in range(len(LEVELS)))
    promising = found.mapInPandas(_costs(num, den), f"set_id long, size long, band int, tokens array<long>, uses array<long>, ranks array<long>, {costs}")
    promising = _dist.materialize(promising, "promising")
    by_band = promising.groupBy("band").agg(*[F.sum(f"cost{i}").alias(f"cost{i}") for i in range(len(LEVELS))]).collect()  # bands: logarithm of the longest text
    levels = {r["band"]: min(range(len(LEVELS)), key=lambda i: r[f"cost{i}"]) for r in by_band}
    kept = _dist.materialize(promising.select("set_id", "size", "band", "tokens", "ranks").mapInPandas(_kept(num, den, levels), "token long, set_id long, size long, need long"), "kept")
    stars = kept.groupBy("token").agg(F.min("set_id").alias("b"), F.count("*").alias("uses")).where("uses > 1")
    stars = _dist.materialize(stars, "stars")
    total = stars.agg(F.sum("uses")).first()[0] or 0
    known = _dist.attach(kept, stars, "token", "uses", F.xxhash64("set_id", "token"), total).where("b is not null")
    by_set = known.groupBy("set_id").agg(F.first("need").alias("need"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("uses", "token"))).alias("all"))
    by_set = by_set.withColumn("heavy", F.filter("all", lambda x: x["uses"] > LIGHT)).withColumn("light", F.filter("all", lambda x: x["uses"] <= LIGHT)).withColumn("all", F.col("all.token"))
    by_set = _dist.materialize(by_set, "by_set")
    # light tokens: pairs that share enough of them
    one = by_set.select(F.explode("light.token").alias("token"), F.struct("set_id", "size", "need", F.size("heavy").alias("heavy")).alias("s"))
    lists = one.groupBy("token").agg(F.array_sort(F.collect_list("s")).alias("sets"))
    pairs = lists.select(F.explode(F.flatten(F.transform("sets", lambda x, i: F.transform(F.slice("sets", F.lit(1), i), lambda y: F.struct(y.alias("x"), x.alias("y")))))).alias("p"))
    pairs = pairs.where(F.least("p.x.size", "p.y.size") * den >= F.greatest("p.x.size", "p.y.size") * num)
    counted = pairs.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= F.least("p.x.need", "p.y.need") - F.least("p.x.heavy", "p.y.heavy"))
    counted = counted.select(F.col("p.x.set_id").alias("a"), F.col("p.y.set_id").alias("b"), F.least("p.x.need", "p.y.need").alias("least"))
    side = lambda c: by_set.select(F.col("set_id").alias(c), F.col("all").alias(f"{c}_tokens"))
    both = counted.join(side("a"), "a").join(side("b"), "b")
    pairs = _dist.materialize(both.where(F.size(F.array_intersect("a_tokens", "b_tokens")) >= F.col("least")).select("a", "b"), "pairs")
    # heavy tokens: whole sets of those that could do with heavy tokens alone, in order of frequency among them
    costly = _dist.materialize(by_set.where(F.size("heavy") >= F.col("need")).select("set_id"), "costly")
    rows = _dist.materialize(_texts(table, sets, costly).select("text", "set_id").mapInArrow(_tokens(k), "token long, set_id long"), "tokens")
    uses = rows.groupBy("token").agg(F.count("*").alias("uses")).where("uses > 1")
    uses = _dist.materialize(uses, "uses")
    known = _dist.attach(rows, uses, "token", "uses", F.xxhash64("set_id", "token"), uses.agg(F.sum("uses")).first()[0] or 0)
    size = F.size("all")
    rarest = F.slice(F.array_sort("all"), F.lit(1), (size - F.ceil(size * num / F.lit(den)) + 1).cast("int"))
    rest = known.groupBy("set_id").agg(F.collect_set(F.struct(F.coalesce("uses", F.lit(1)).alias("uses"), "token")).alias("all")).select("set_id", F.explode(rarest).alias("h")).where("h.uses > 1")
    # a set meets those of its size band and of the next one, as linked sets are in one or in neighbouring bands
    bands = promising.select(F.col("set_id").alias("__id"), "band")
    rest = rest.join(bands, F.col("set_id") == F.col("__id")).select("set_id", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "h")
    rest = _dist.materialize(rest.select("set_id", F.xxhash64("h.token", "band").alias("token")), "rarest")
    low = rest.groupBy("token").agg(F.min("set_id").alias("low"), F.count("*").alias("uses")).where("uses > 1")
    low = _dist.materialize(low, "heavy")
    joined = _dist.attach(rest, low, "token", "uses", F.xxhash64("set_id", "token"), low.agg(F.sum("uses")).first()[0] or 0)
    near = pairs.union(joined.where("low is not null and low <> set_id").select("set_id", "low")).distinct()
    clusters = _dist.components(near, "clusters")
    low = F.col("tokens")[0].alias("low")  # nearly the least hash of the set: near copies mostly have one
    sized = _dist.materialize(clusters.join(promising.select(F.col("set_id").alias("id"), "size", low), "id"), "sized")
    weights = sized.groupBy("root").agg(F.sum("size").alias("weight"), F.count("*").alias("members"))
    told = _dist.attach(sized, weights, "root", "members", F.xxhash64("id"), sized.count())
    told = _dist.materialize(told.select(F.col("id").alias("set_id"), "root", "size", "low", "weight"), "weighed")
    pools = max(1, math.ceil((sized.agg(F.sum("size")).first()[0] or 0) / POOL_TOKENS))
    zero = F.lit(0).cast("long")
    chosen = told.where(F.col("weight") <= PART_TOKENS).select("set_id", F.col("root").alias("cluster"), zero.alias("side"), F.pmod(F.xxhash64("root"), F.lit(pools)).alias("pool"))
    many = told.where(F.col("weight") > PART_TOKENS)
    large = many.limit(1).count() > 0
    if large:
        parts = _parts(many)
        chosen = chosen.union(parts.select("set_id", F.col("part").alias("cluster"), zero.alias("side"), F.col("part").alias("pool")))

    def links(rows: DataFrame) -> DataFrame:
        whole = _texts(table, sets, rows).select("text", "set_id", "cluster", "side", "pool").mapInArrow(_whole(k), "set_id long, cluster long, side long, pool long, tokens binary")
        return whole.groupBy("pool").applyInPandas(_blocks(num, den), "a long, b long")

    if not large:
        return links(chosen)
    inner = _dist.materialize(links(chosen), "inner")
    return inner.union(links(_open_blocks(parts, inner, pairs, rest)))


def _parts(sets: DataFrame) -> DataFrame:
    """(set_id, root, part): parts of large clusters, sets(set_id, root, size, low, weight), of about PART_TOKENS shingles at most. Sets with one low share a part, or parts of their own if they are many."""
    group = F.xxhash64("root", "low")
    groups = sets.groupBy("root", "low").agg(F.sum("size").alias("tokens"), F.count("*").alias("members")).withColumn("group", F.xxhash64("root", "low"))
    told = _dist.attach(sets.withColumn("group", group), groups, "group", "members", F.xxhash64("set_id"), sets.count(), extra=["root", "low"])
    own = F.xxhash64("root", "low", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("tokens") / PART_TOKENS)))
    shared = F.xxhash64("root", F.pmod(F.xxhash64("low"), F.ceil(F.col("weight") * 2 / PART_TOKENS)))
    return _dist.materialize(told.select("set_id", "root", F.when(F.col("tokens") * 2 > PART_TOKENS, own).otherwise(shared).alias("part")), "parts")


def _open_blocks(parts: DataFrame, inner: DataFrame, pairs: DataFrame, rest: DataFrame) -> DataFrame:
    """(set_id, cluster, side, pool): pairs of parts of a large cluster that candidates of different components connect, with the sets that have such candidates.

    What the parts' own links connect needs no further comparing, so a group of near copies that is spread
    over many parts leaves little; sets that share no candidate never meet.
    """
    roots = _dist.components(inner, "inner").withColumnRenamed("id", "set_id").withColumnRenamed("root", "component")
    members = _dist.materialize(parts.join(roots, "set_id", "left").select("set_id", "part", F.coalesce("component", "set_id").alias("component")), "members")
    side = lambda c: members.select(F.col("set_id").alias(c), F.col("part").alias(f"{c}_part"), F.col("component").alias(f"{c}_component"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("a_part <> b_part and a_component <> b_component")
    met = _dist.materialize(met.select("a", "b", F.least("a_part", "b_part").alias("p0"), F.greatest("a_part", "b_part").alias("p1")), "met")
    at = _dist.materialize(rest.join(members, "set_id"), "tokens-of-parts")
    by_part = at.groupBy("token", "part").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    token = by_part.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("part", "c0", "c1"))).alias("parts"), F.min("c0").alias("c0"), F.max("c1").alias("c1")).where("c0 <> c1 and size(parts) > 1")
    token = _dist.materialize(token.select("token", "parts"), "open-tokens")
    # tokens of one passage are in the same parts, so lists are made distinct before they are paired
    lists = token.select("parts").distinct()
    two = lists.select(F.explode(F.flatten(F.transform("parts", lambda x, i: F.transform(F.filter(F.slice("parts", F.lit(1), i), lambda y: (x["c0"] != x["c1"]) | (y["c0"] != y["c1"]) | (x["c0"] != y["c0"])), lambda y: F.struct(y["part"].alias("p0"), x["part"].alias("p1")))))).alias("p"))
    blocks = _dist.materialize(two.select("p.p0", "p.p1").union(met.select("p0", "p1")).distinct(), "blocks")
    uses = at.groupBy("token").agg(F.count("*").alias("uses"))
    open_ = _dist.attach(at.select("set_id", "token"), token.select("token", F.lit(True).alias("open")).join(uses, "token"), "token", "uses", F.xxhash64("set_id", "token"), at.count()).where("open").select("set_id")
    sets = open_.union(met.select("a")).union(met.select("b")).distinct().join(members.select("set_id", "part"), "set_id")
    sides = blocks.select(F.explode(F.array(F.struct(F.col("p0").alias("part")), F.struct(F.col("p1").alias("part")))).alias("s"), F.xxhash64("p0", "p1").alias("block")).select("s.part", "block")
    return sets.join(sides, "part").select("set_id", F.col("block").alias("cluster"), F.col("part").alias("side"), F.col("block").alias("pool"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs with one document of each component of near copies; the columns of docs stay, whatever their names. Of rows with one doc_id and text one stays, even if other columns differ, unless the text has no words."""
    found = near_duplicates(docs.select("doc_id", "text"), k, num, den)
    return _dist.keep_marked(docs, found.select("doc_id", "row_key", "kept"), _dist.row_key("doc_id", F.col("text").cast("string")))
