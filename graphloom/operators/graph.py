"""Undirected property graphs as two tables: nodes(id, ...) and edges(src, dst, ...) with src <= dst."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import materialize


def canonical(edges: DataFrame) -> DataFrame:
    """Each edge with its ends in order."""
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def both_ways(edges: DataFrame, *values: str) -> DataFrame:
    """(id, other, values...): every edge from both ends, a self-loop once."""
    forth = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), *values)
    return forth.union(edges.where("src <> dst").select("dst", "src", *values))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): edges of each node, a self-loop twice; nodes that the graph lacks have 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def edge_degrees(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(src, dst) with the sum of their ends' degrees, whether or not they are edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    a, b = ends.select(F.col("id").alias("src"), F.col("n").alias("a")), ends.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    zero = F.lit(0).cast("long")
    return pairs.join(a, "src", "left").join(b, "dst", "left").withColumn("degree", F.coalesce("a", zero) + F.coalesce("b", zero)).drop("a", "b")


def edge_lookup(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(src, dst, ...) with the edge's values in either direction, null if there is none."""
    values = [c for c in edges.columns if c not in ("src", "dst")]
    e = canonical(edges).select(F.col("src").alias("__a"), F.col("dst").alias("__b"), *values)
    return pairs.join(e, (F.least("src", "dst") == F.col("__a")) & (F.greatest("src", "dst") == F.col("__b")), "left").drop("__a", "__b")


def existence(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(src, dst) with both_nodes: the graph has both ends, and is_edge: it has an edge between them, in either direction."""
    a, b = (nodes.select(F.col("id").alias(f"__{x}"), F.lit(True).alias(f"__has_{x}")).distinct() for x in "ab")
    e = canonical(edges.select("src", "dst")).distinct().select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.lit(True).alias("__edge"))
    out = pairs.join(a, F.col("src") == F.col("__a"), "left").join(b, F.col("dst") == F.col("__b"), "left").join(e, (F.least("src", "dst") == F.col("__s")) & (F.greatest("src", "dst") == F.col("__d")), "left")
    return out.select(*pairs.columns, (F.col("__has_a").isNotNull() & F.col("__has_b").isNotNull()).alias("both_nodes"), F.col("__edge").isNotNull().alias("is_edge"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of gone(id) and their edges."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


#: Rows of pairs whose copies one task drops.
PART_ROWS = 1_200_000


def _code(c: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(c))


def coded(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, own, code) and edges(src, dst, ...) with codes: every distinct id of both tables as a number of its own; own: nodes has it. Codes are hashes, so edges need no join; should two ids share one, all are hashed anew."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(False).alias("own"))
    ids = materialize(nodes.select("id", F.lit(True).alias("own")).union(ends).groupBy("id").agg(F.max("own").alias("own")))
    seed = 0
    while ids.groupBy(_code("id", seed)).count().where("count > 1").limit(1).count():
        seed += 1
    return ids.withColumn("code", _code("id", seed)), edges.withColumns({"src": _code("src", seed), "dst": _code("dst", seed)})


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each connected component, by alternating stars, until every path has one link: logarithmic rounds, each written to the shared folder.

    Ids are numbers meanwhile, each link goes from the larger to the smaller one. Links stream past the
    least neighbour of each node, so tasks hold nodes, and copies of links are dropped in tasks of
    PART_ROWS; the joins of an id with very many links are split by adaptive execution.
    """
    edges = materialize(edges.where("src <> dst").select("src", "dst"))
    ids, links = coded(nodes, edges)
    pairs = links.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    while True:
        low = materialize(pairs.groupBy("a").agg(F.min("b").alias("m")))
        near = pairs.join(low.select(F.col("a").alias("b"), "m").hint("shuffle_hash"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = materialize(near.union(low))
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        near = large.join(low.hint("shuffle_hash"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-large.count() // PART_ROWS))
        links = materialize(near.repartition(tasks, "a", "b").distinct())
        roots = links.select(F.col("b").alias("a")).distinct()
        if links.count() == low.count() and not links.join(roots, "a", "left_semi").limit(1).count():  # one link each
            break
        pairs = links
    rooted = ids.join(links.select(F.col("a").alias("code"), F.col("b").alias("root")), "code", "left")
    rooted = materialize(rooted.select("id", F.coalesce("root", "code").alias("root")))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    return nodes.select("id").join(rooted.join(least, "root").select(F.col("id").alias("__id"), "component"), F.col("id").eqNullSafe(F.col("__id")), "left").select("id", "component")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): nodes of the component with the most nodes, of equal ones that with the smallest id."""
    found = materialize(components(nodes, edges))
    best = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return found.join(F.broadcast(best.select("component")), "component", "left_semi").select("id")


def frontier(nodes: DataFrame, edges: DataFrame, start: DataFrame, radius: int = 1) -> DataFrame:
    """(id): existing nodes of start(id) and all within radius edges of them."""
    reached = start.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    links = both_ways(edges)
    for _ in range(radius):
        reached = materialize(reached.union(links.join(reached, "id", "left_semi").select("other")).distinct())
    return reached


def incremental_choice(nodes: DataFrame, reached: DataFrame, clustered: DataFrame, updates: int, limit: float = 0.5, most: int = 10) -> DataFrame:
    """One row: frontier and graph sizes, and whether clustering only the frontier is allowed: two or more nodes, at most `limit` of the graph, some clustered before, fewer than `most` updates since the last full run."""
    n = nodes.agg(F.count("*").alias("nodes"))
    r = reached.agg(F.count("*").alias("frontier"))
    c = reached.join(clustered.select("id"), "id", "left_semi").agg(F.count("*").alias("clustered"))
    one = n.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(c))  # three one-row tables
    return one.withColumn("incremental", (F.col("frontier") >= 2) & (F.col("frontier") <= F.col("nodes") * limit) & (F.col("clustered") > 0) & F.lit(updates < most))


def singleton_clusters(nodes: DataFrame) -> DataFrame:
    """(id, level, cluster): every node of a graph without edges on its own, numbered by id.

    Ranks come from range partitions and their sizes, so no task sorts all nodes.
    """
    sorted_ = materialize(nodes.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()))
    counts = sorted_.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1 + F.col("before")
    return sorted_.join(F.broadcast(before), "part").select("id", F.lit(0).alias("level"), F.concat(F.lit("singleton-"), rank.cast("string")).alias("cluster"))


def modularity(edges: DataFrame, clusters: DataFrame, gamma: float = 1.0, weighted: bool = False) -> DataFrame:
    """One row: sum over clusters(id, cluster) of inside / m - gamma (degree / 2m)^2."""
    w = F.col("weight") if weighted else F.lit(1.0)
    c = clusters.select("id", "cluster")
    ends = edges.select("src", "dst", w.alias("w")).join(c.select(F.col("id").alias("src"), F.col("cluster").alias("ca")), "src").join(c.select(F.col("id").alias("dst"), F.col("cluster").alias("cb")), "dst")
    parts = ends.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("inside"), F.col("w").alias("deg")), F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("inside"), F.col("w").alias("deg")))).alias("p"))
    by = parts.groupBy("p.c").agg(F.sum("p.inside").alias("inside"), F.sum("p.deg").alias("deg"))
    sums = by.agg(F.sum("inside").alias("inside"), F.sum("deg").alias("two_m"), F.sum(F.col("deg") * F.col("deg")).alias("squares"))
    return sums.select((F.col("inside") * 2 / F.col("two_m") - gamma * F.col("squares") / (F.col("two_m") * F.col("two_m"))).alias("modularity"))


def modularity_sums(edges: DataFrame, clusters: DataFrame, weighted: bool = False) -> DataFrame:
    """(cluster, inside, degree): weights of edges(src, dst, weight) inside each cluster of clusters(id, cluster) and of all edge ends in it. Edges of which an end has no cluster don't count."""
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    end = lambda x: clusters.select(F.col("id").alias(x), F.col("cluster").alias(f"c_{x}"))
    ends = edges.select("src", "dst", w.alias("w")).join(end("src"), "src").join(end("dst"), "dst")
    at = lambda c, inside: F.struct(F.col(c).alias("cluster"), inside.alias("inside"), F.col("w").alias("degree"))
    both = F.array(at("c_src", F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0.0)), at("c_dst", F.lit(0.0)))
    return ends.select(F.inline(both)).groupBy("cluster").agg(F.sum("inside").alias("inside"), F.sum("degree").alias("degree"))


def updated_sums(sums: DataFrame, old_edges: DataFrame, new_edges: DataFrame, old_clusters: DataFrame, new_clusters: DataFrame, touched: DataFrame, weighted: bool = False) -> DataFrame:
    """modularity_sums() of the new edges and clusters from those of the old ones: only edges at a node of touched(id), or at one that changed its cluster, are summed. touched: an end of each edge that came, went or has another weight."""
    moved = old_clusters.select("id", "cluster").exceptAll(new_clusters.select("id", "cluster")).union(new_clusters.select("id", "cluster").exceptAll(old_clusters.select("id", "cluster")))
    near = materialize(touched.select("id").union(moved.select("id")).distinct())

    def part(edges: DataFrame, clusters: DataFrame) -> DataFrame:
        of = lambda x: edges.join(near.withColumnRenamed("id", x), x, "left_semi").select(*edges.columns)
        other = edges.join(near.withColumnRenamed("id", "src"), "src", "left_anti").select(*edges.columns).join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
        return modularity_sums(of("src").unionByName(other), clusters, weighted)

    gone = part(old_edges, old_clusters).select("cluster", (-F.col("inside")).alias("inside"), (-F.col("degree")).alias("degree"))
    every = sums.select("cluster", "inside", "degree").unionByName(gone).unionByName(part(new_edges, new_clusters))
    return every.groupBy("cluster").agg(F.sum("inside").alias("inside"), F.sum("degree").alias("degree")).where("degree > 0.5e-9")


def modularity_of(sums: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: the modularity of modularity_sums(); null without edges."""
    total = sums.agg(F.sum("inside").alias("inside"), F.sum("degree").alias("two_m"), F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    return total.select((F.col("inside") * 2 / F.col("two_m") - gamma * F.col("squares") / (F.col("two_m") * F.col("two_m"))).alias("modularity"))


def community_schema(membership: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per cluster of membership(id, level, cluster): nodes, incident edges (those that leave it too), chunk ids of chunks(id, chunk_id), occurrence: its distinct chunks over the most of any.

    Counts are exact; lists are of one community, which reports cut to a budget.
    """
    key = ["level", "cluster"]
    members = membership.groupBy(*key).agg(F.array_sort(F.collect_set("id")).alias("nodes"))
    around = both_ways(edges).join(membership, "id").select(*key, F.struct(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).alias("e")).groupBy(*key).agg(F.array_sort(F.collect_set("e")).alias("edges"))
    found = membership.join(chunks, "id").groupBy(*key).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    out = members.join(around, key, "left").join(found, key, "left")
    n = F.coalesce(F.size("chunk_ids"), F.lit(0))
    most = found.agg(F.max(F.size("chunk_ids")).alias("most"))
    return out.crossJoin(F.broadcast(most)).withColumn("occurrence", F.when(F.col("chunk_ids").isNull(), 0.0).otherwise(n / F.col("most"))).drop("most")


def community_counts(membership: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """community_schema() with numbers in place of lists: level, cluster, nodes, edges, chunks, occurrence. No row follows the size of a community."""
    key = ["level", "cluster"]
    members = membership.groupBy(*key).agg(F.count("*").alias("nodes"))
    m = membership.select("id", *key).repartition("id").distinct()  # dealt first: no task holds what it reads
    distinct = materialize(edges.where("src is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    at = lambda c, *more: m.select(F.col("id").alias(c), *more).hint("shuffle_hash")  # noqa: E731  edges stream past the members
    # edges of a community: ends at its members, less the edges of which it has both ends
    ends = both_ways(distinct).groupBy("id").agg(F.count("*").alias("n")).join(m, "id").groupBy(*key).agg(F.sum("n").alias("ends"))
    inside = distinct.where("src <> dst").join(at("src", *key), "src").join(at("dst", *key), ["dst", *key]).groupBy(*key).agg(F.count("*").alias("inside"))
    around = ends.join(inside, key, "left").select(*key, (F.col("ends") - F.coalesce("inside", F.lit(0))).alias("edges"))
    found = chunks.join(at("id", *key), "id").select(*key, "chunk_id").distinct().groupBy(*key).agg(F.count("*").alias("chunks"))
    zero = F.lit(0).cast("long")
    out = members.join(around, key, "left").join(found, key, "left").withColumns({"edges": F.coalesce("edges", zero), "chunks": F.coalesce("chunks", zero)})
    most = found.agg(F.max("chunks").alias("most"))
    return out.crossJoin(F.broadcast(most)).withColumn("occurrence", F.when(F.col("chunks") == 0, 0.0).otherwise(F.col("chunks") / F.col("most"))).drop("most")


def sub_communities(membership: DataFrame, next_level_only: bool = True) -> DataFrame:
    """(level, cluster, sub): clusters of the next level (or any deeper one) all of whose nodes are in the cluster."""
    a = membership.select("id", F.col("level").alias("l"), F.col("cluster").alias("c"))
    b = membership.select("id", F.col("level").alias("sl"), F.col("cluster").alias("sub"))
    deeper = F.col("sl") == F.col("l") + 1 if next_level_only else F.col("sl") > F.col("l")
    shared = a.join(b, "id").where(deeper).groupBy("l", "c", "sl", "sub").agg(F.count("*").alias("shared"))
    sizes = b.groupBy("sl", "sub").agg(F.count("*").alias("size"))
    return shared.join(sizes, ["sl", "sub"]).where("shared = size").select(F.col("l").alias("level"), F.col("c").alias("cluster"), "sub")


def edge_confidence(edges: DataFrame) -> DataFrame:
    """edges(confidence, occurrence_count: strings) with score 0.7 confidence + 0.3 min(count / 10, 1); missing ones count as 1."""
    conf = F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0))
    freq = F.coalesce(F.col("occurrence_count").try_cast("double"), F.lit(1.0))
    return edges.withColumn("score", conf * 0.7 + F.least(freq / 10, F.lit(1.0)) * 0.3)


#: Ranks that go to where the edges are.
BROADCAST_RANKS = 1_000_000


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 20, tolerance: float | None = None) -> DataFrame:
    """(id, rank): personalised PageRank from seeds(id) over weighted undirected edges; nodes without edges give their rank back to the seeds.

    Ids are numbers meanwhile. Each iteration is one join, in which edges stream past the ranks above 0,
    and one sum, and writes one row a node; with a tolerance it ends when the ranks' total change is below
    that times the number of nodes.
    """
    edges = materialize(edges.where("weight > 0 and src is not null").select("src", "dst", "weight"))
    ids, links = coded(nodes, edges)
    moves = both_ways(links, "weight")
    total = moves.groupBy(F.col("id").alias("code")).agg(F.sum("weight").alias("total"))
    chosen = seeds.select("id").distinct().withColumn("seed", F.lit(1.0))
    base = materialize(ids.where("own").join(chosen, "id", "left").join(total, "code", "left").select("id", "code", F.coalesce("seed", F.lit(0.0)).alias("seed"), "total"))
    n, n_nodes = base.agg(F.sum("seed"), F.count("*")).first()
    if not n:
        return base.select("id", F.lit(0.0).alias("rank"))
    ranks = base.select("code", "seed", "total", (F.col("seed") / n).alias("rank"))
    for _ in range(iterations):
        given = ranks.where("rank > 0 and total is not null").select(F.col("code").alias("id"), "rank", "total")
        given = F.broadcast(given) if given.count() <= BROADCAST_RANKS else given.hint("shuffle_hash")
        moved = moves.join(given, "id").groupBy(F.col("other").alias("code")).agg(F.sum(F.col("rank") * (F.col("weight") / F.col("total"))).alias("got"))
        dangling = ranks.where("total is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        fresh = ranks.select("code", "seed", "total", F.col("rank").alias("old")).join(moved, "code", "left").crossJoin(F.broadcast(dangling))
        ranks = materialize(fresh.select("code", "seed", "total", "old", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("seed") / n) + (1 - alpha) * F.col("seed") / n).alias("rank")))
        if tolerance is not None and ranks.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance * n_nodes:
            break
    return base.select("id", "code").join(ranks.select("code", "rank"), "code").select("id", "rank")


def fallback_seeds(nodes: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """The k nodes with the highest degree."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(k).select("id")


#: Equal parts of a node's steps: draws are whole numbers below about this, so intervals neither overlap nor leave gaps.
UNITS = 1 << 48
#: Edges of a node whose weights one window adds up.
BLOCK_EDGES = 4096
#: Cells that one row gives at once.
RUN = 1024


def steps(edges: DataFrame) -> DataFrame:
    """(id, cell, low, high, other, units, width): where a step from a node leads. A draw u below the node's units falls in cell u div width, and the one row of it with low <= u < high names the neighbour, in proportion to the weight.

    A node has as many cells as edges, so all its cells have two rows an edge at most and a drawn cell has
    two rows on average, whatever the degree; a hub's cells spread over all partitions. Units are added up
    in blocks of a node's edges, then over the blocks. units, width: those of `other`, for the step after.
    Edges without a positive weight are never taken.
    """
    links = both_ways(edges, "weight").where("weight > 0").groupBy("id", "other").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    links = materialize(links)
    sums = links.groupBy("id").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    unit = F.greatest(F.floor(F.col("weight") / F.col("total") * UNITS), F.lit(1)).cast("long")
    block = F.pmod(F.xxhash64("other"), F.ceil(F.col("n") / BLOCK_EDGES))
    placed = materialize(links.join(sums, "id").select("id", "other", "n", unit.alias("u"), block.alias("block")))
    blocks = placed.groupBy("id", "block").agg(F.sum("u").alias("u"), F.max("n").alias("n"))
    before = F.sum("u").over(Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("u")
    blocks = materialize(blocks.select("id", "block", "n", "u", before.alias("start")))
    nodes = blocks.groupBy("id").agg(F.sum("u").alias("units"), F.max("n").alias("n")).select("id", "units", F.ceil(F.col("units") / F.col("n")).alias("width"))
    high = F.sum("u").over(Window.partitionBy("id", "block").orderBy("other").rowsBetween(Window.unboundedPreceding, 0)) + F.col("start")
    ranges = placed.drop("n").join(blocks.select("id", "block", "start"), ["id", "block"]).withColumn("high", high).withColumn("low", F.col("high") - F.col("u"))
    ranges = ranges.join(nodes.select("id", F.col("width").alias("own")), "id").withColumns({"first": F.expr("low div own"), "last": F.expr("(high - 1) div own")})
    runs = ranges.withColumn("run", F.explode(F.sequence("first", "last", F.lit(RUN).cast("long"))))
    cells = runs.withColumn("cell", F.explode(F.sequence("run", F.least(F.col("run") + RUN - 1, "last"))))
    ahead = nodes.withColumnRenamed("id", "other")
    return cells.select("id", "cell", "low", "high", "other").join(ahead, "other").select("id", "cell", "low", "high", "other", "units", "width")


#: Steps whose nodes a walker carries before they are written.
CARRIED = 8


def coded_walks(nodes: DataFrame, edges: DataFrame, n: int = 10, length: int = 40, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(start, no, path), ids(id, code): walks() in codes of nodes.

    The cells of steps() are dealt and kept once, so a step moves walkers alone: numbers, and the nodes of
    CARRIED steps at most. These are written, and meet at the end. Draws are hashes of start and number.
    """
    ids, links = coded(nodes, edges.where("src is not null").select("src", "dst", "weight"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = steps(links).repartition(parts, "id", "cell").persist(StorageLevel.DISK_ONLY)
    try:
        table.count()  # a join knows how they are dealt only once they are
        own = table.groupBy(F.col("other").alias("code")).agg(F.first("units").alias("units"), F.first("width").alias("width"))  # every node with an edge is another's neighbour, or its own
        start = ids.where("own").join(own, "code", "left").withColumn("no", F.explode(F.sequence(F.lit(1), F.lit(n))))
        now = start.select(F.col("code").alias("start"), "no", F.col("code").alias("at"), "units", "width", F.array("code").alias("path"))
        cells = table.select(F.col("id").alias("__at"), F.col("cell").alias("__cell"), "low", "high", "other", F.col("units").alias("__units"), F.col("width").alias("__width"))
        written = []
        for step in range(length - 1):
            drawn = now.withColumn("draw", F.pmod(F.xxhash64("start", "no", F.lit(seed * 1000 + step)), F.col("units"))).withColumn("cell", F.expr("draw div width"))
            met = drawn.join(cells, (F.col("at") == F.col("__at")) & (F.col("cell") == F.col("__cell")) & (F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high")), "left")
            path = F.when(F.col("other").isNull(), F.col("path")).otherwise(F.concat("path", F.array("other")))
            now = met.select("start", "no", F.coalesce("other", "at").alias("at"), F.col("__units").alias("units"), F.col("__width").alias("width"), path.alias("path"))
            if step % CARRIED == CARRIED - 1:
                written.append(materialize(now))
                now = written[-1].withColumn("path", F.array().cast("array<bigint>"))
        written.append(materialize(now))
    finally:
        table.unpersist()
    out = written[0].select("start", "no", "path")
    for more in written[1:]:
        out = out.join(more.select("start", "no", F.col("path").alias("more")), ["start", "no"]).select("start", "no", F.concat("path", "more").alias("path"))
    return out, ids


def walks(nodes: DataFrame, edges: DataFrame, n: int = 10, length: int = 40, seed: int = 1) -> DataFrame:
    """(walk, path): random walks from every node, neighbours drawn by edge weight; from nodes without edges they don't leave. Each step is one hash join of the walkers with the cells of steps(), two rows a walker on average, also at hubs."""
    found, ids = coded_walks(nodes, edges, n, length, seed)
    named = found.select("start", "no", F.posexplode("path").alias("place", "code")).join(ids.select("code", "id"), "code").groupBy("start", "no").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("p"))
    return named.select(F.concat_ws("/", F.col("p")[0]["id"], F.col("no").cast("string")).alias("walk"), F.col("p.id").alias("path"))


#: Walks that one task trains on.
WALKS = 50_000


def node2vec(nodes: DataFrame, edges: DataFrame, dims: int = 1536, n: int = 10, length: int = 40, window: int = 2, epochs: int = 3, seed: int = 1) -> DataFrame:
    """(id, embedding) from skip-grams over random walks, whose words are codes of nodes."""
    from pyspark.ml.feature import Word2Vec

    found, ids = coded_walks(nodes, edges, n, length, seed)
    paths = materialize(found.select("path")).select(F.col("path").cast("array<string>").alias("path"))  # read for the vocabulary and for training
    parts = max(1, paths.count() // WALKS)
    model = Word2Vec(vectorSize=dims, windowSize=window, maxIter=epochs, minCount=0, seed=seed, numPartitions=parts, inputCol="path", outputCol="v").fit(paths)
    from pyspark.ml.functions import vector_to_array

    vectors = model.getVectors().select(F.col("word").cast("long").alias("code"), vector_to_array("vector", "float32").alias("embedding"))
    return vectors.join(ids.where("own").select("code", "id"), "code").select("id", "embedding")
