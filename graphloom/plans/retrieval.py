"""Retrieval: contexts of the local, global, naive, grounded and multi-hop modes, within token budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.budget import within_budget
from ..functions.text import csv_row, n_tokens
from ..operators.graph import both_ways, edge_degrees

#: How budgets measure a text: text -> tokens.
Size = Callable[[Column], Column]


def related_communities(hits: DataFrame, membership: DataFrame, reports: DataFrame, level: int = 2, budget: int = 3200, single: bool = False, size: Size = n_tokens) -> DataFrame:
    """reports(cluster, report, rating) of the clusters up to a level that the hits(id) are in, most hits first, then best rated, within the budget; single: the first only."""
    counted = hits.select("id").join(membership, "id").where(F.col("level") <= level).groupBy("cluster").agg(F.count("*").alias("hits"))
    rows = counted.join(reports, "cluster").withColumn("tokens", size(F.col("report")))
    out = within_budget(rows, "tokens", budget, [F.desc("hits"), F.desc("rating"), F.col("cluster")])
    return out.orderBy(F.desc("hits"), F.desc("rating"), "cluster").limit(1) if single else out


def related_chunks(hits: DataFrame, node_chunks: DataFrame, edges: DataFrame, chunks: DataFrame, budget: int = 4000, size: Size = n_tokens) -> DataFrame:
    """(chunk_id, ord, relations, content): chunks of hits(id, ord) under the first hit that has them, in order of hits, then by how many one-hop neighbours share them, within the budget."""
    own = hits.join(node_chunks, "id").groupBy("chunk_id").agg(F.min_by(F.struct("ord", "id"), "ord").alias("h"))
    near = own.select("chunk_id", F.col("h.id").alias("id")).join(both_ways(edges), "id").select("chunk_id", F.col("other").alias("id")).distinct().join(node_chunks, ["id", "chunk_id"], "left_semi")
    shared = near.groupBy("chunk_id").agg(F.count("*").alias("relations"))
    rows = own.join(shared, "chunk_id", "left").join(chunks.select("chunk_id", "content"), "chunk_id").select("chunk_id", F.col("h.ord").alias("ord"), F.coalesce("relations", F.lit(0).cast("long")).alias("relations"), "content", size(F.col("content")).alias("tokens"))
    return within_budget(rows, "tokens", budget, [F.col("ord"), F.desc("relations"), F.col("chunk_id")]).drop("tokens")


def related_edges(hits: DataFrame, edges: DataFrame, budget: int = 4800, size: Size = n_tokens) -> DataFrame:
    """(src, dst, weight, description, rank): distinct edges at hits(id), those between nodes of high degree first, then heavy ones, within the budget of their descriptions."""
    at = both_ways(edges).join(hits.select("id").distinct(), "id", "left_semi").select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).distinct()
    rows = edge_degrees(at, edges).withColumnRenamed("degree", "rank").join(edges, ["src", "dst"]).withColumn("tokens", size(F.col("description")))
    return within_budget(rows, "tokens", budget, [F.desc("rank"), F.desc("weight"), F.col("src"), F.col("dst")]).select("src", "dst", "weight", "description", "rank")


def section(rows: DataFrame, header: list[str], cells: list[Column], order: list[Column]) -> DataFrame:
    """One row: CSV text of a few ordered rows, numbered, under a header."""
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    lines = rows.withColumn("__n", number).select("__n", csv_row(F.col("__n") - 1, *cells).alias("line"))
    head = ",\t".join(f'"{h}"' for h in ["id", *header])
    return lines.agg(F.array_sort(F.collect_list(F.struct("__n", "line"))).alias("l")).select(F.concat_ws("\n", F.lit(head), F.col("l.line")).alias("text"))


def local_context(hits: DataFrame, nodes: DataFrame, reports: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: the four fenced sections of a local query's context, from rows that are within their budgets."""
    parts = [
        ("Reports", section(reports, ["content"], [F.col("report")], [F.desc("hits"), F.desc("rating"), F.col("cluster")])),
        ("Entities", section(hits.join(nodes, "id"), ["entity", "type", "description", "rank"], [F.col("entity_name"), F.col("entity_type"), F.col("description"), F.col("degree")], [F.col("ord")])),
        ("Relationships", section(edges, ["source", "target", "description", "weight", "rank"], [F.col("src"), F.col("dst"), F.col("description"), F.col("weight"), F.col("rank")], [F.desc("rank"), F.desc("weight"), F.col("src"), F.col("dst")])),
        ("Sources", section(chunks, ["content"], [F.col("content")], [F.col("ord"), F.desc("relations"), F.col("chunk_id")])),
    ]
    out = None
    for i, (title, df) in enumerate(parts):
        one = df.select(F.concat(F.lit(f"-----{title}-----\n```csv\n"), "text", F.lit("\n```")).alias(f"s{i}"))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out.select(F.concat_ws("\n", "s0", "s1", "s2", "s3").alias("context"))


def global_selection(communities: DataFrame, reports: DataFrame, level: int = 2, most: int = 512, least_rating: float = 0) -> DataFrame:
    """(cluster, occurrence, rating, report): the `most` communities up to a level with the highest occurrence, whose reports are rated high enough, by occurrence and rating."""
    top = communities.where(F.col("level") <= level).orderBy(F.desc("occurrence"), "cluster").limit(most)
    return top.join(reports, "cluster").where(F.coalesce("rating", F.lit(0.0)) >= least_rating).select("cluster", "occurrence", "rating", "report")


POINTS = "points array<struct<description:string,score:double>>"


def reduce_points(answers: DataFrame, budget: int = 16384, size: Size = n_tokens) -> DataFrame:
    """(analyst, pos, description, score) of answers(analyst, answer: JSON of POINTS): points with a description, score 1 if none, above 0, best first, within the budget."""
    each = answers.select("analyst", F.posexplode(F.from_json("answer", POINTS)["points"]).alias("pos", "p")).where("p.description is not null")
    rows = each.select("analyst", "pos", F.col("p.description").alias("description"), F.coalesce("p.score", F.lit(1.0)).alias("score")).where("score > 0").withColumn("tokens", size(F.col("description")))
    return within_budget(rows, "tokens", budget, [F.desc("score"), F.col("analyst"), F.col("pos")]).drop("tokens")


def naive_context(hits: DataFrame, chunks: DataFrame, budget: int = 12000, size: Size = n_tokens) -> DataFrame:
    """One row: contents of the hits' chunks(chunk_id, ord) in order, within the budget, with a mark between them."""
    rows = hits.join(chunks.select("chunk_id", "content"), "chunk_id").withColumn("tokens", size(F.col("content")))
    fit = within_budget(rows, "tokens", budget, [F.col("ord")])
    return fit.agg(F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("c")).select(F.array_join("c.content", "--New Chunk--\n").alias("context"))


def grounded_context(hits: DataFrame, registry: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ord, canonical_name, entity_type, aliases, description, neighbours) of the hits that the registry knows."""
    near = both_ways(edges).join(hits.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("neighbours"))
    rows = hits.join(registry.select(F.col("entity_id").alias("id"), "canonical_name", "entity_type", "aliases"), "id")
    return rows.join(nodes.select("id", "description"), "id", "left").join(near, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0).cast("long")))


def validate_answer(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(answer_id, used, answer, confidence): retrieved(answer_id, ord, canonical_name, aliases) entities that an answer names, in order, joined by " and " if the answer has that or an ampersand, else by ", "; confidence min(1, 0.4 used / retrieved + 0.6 share of used among the first ten)."""
    rows = answers.select("answer_id", F.lower("answer").alias("said")).join(retrieved, "answer_id")
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = rows.withColumn("hit", F.exists(names, lambda n: (n != "") & F.contains("said", F.lower(n))))
    used = F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("ord", F.col("canonical_name").alias("name")))))
    g = rows.groupBy("answer_id").agg(F.first("said").alias("said"), F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("used"), F.sum((F.col("hit") & (F.col("ord") < 10)).cast("int")).alias("top"), used.alias("u"))
    text = F.when(F.contains("said", F.lit(" and ")) | F.contains("said", F.lit(" & ")), F.array_join("u.name", " and ")).otherwise(F.array_join("u.name", ", "))
    conf = F.least(F.lit(1.0), 0.4 * F.col("used") / F.col("n") + 0.6 * F.when(F.col("used") > 0, F.col("top") / F.col("used")).otherwise(0.0))
    return g.select("answer_id", "used", text.alias("answer"), conf.alias("confidence"))


#: Patterns of questions that ask for several steps, and for an overview of all; letter case doesn't matter.
MULTIHOP = (r"\bwho.*also\b", r"\bboth.*and\b", r"\bconnect(?:ion|ed|s)?\b", r"\brelationship\b", r"\bcompared?\b", r"\bin common\b", r"\bbetween\b", r"\brelated to\b", r"\bassociate with\b")
OVERVIEW = (r"\bthemes?\b", r"\boverall\b", r"\bin general\b", r"\bsummariz(?:e|ing)\b", r"\bacross\b", r"\bmain ideas?\b", r"\bhigh-level\b", r"\bbroad view\b")


def route(question: Column, least: int = 1) -> Column:
    """multihop if `least` or more of its patterns match, else global likewise, else local."""
    hits = lambda patterns: sum((question.rlike(f"(?i){p}").cast("int") for p in patterns), F.lit(0))
    return F.when(hits(MULTIHOP) >= least, "multihop").when(hits(OVERVIEW) >= least, "global").otherwise("local")


def sub_questions(answer: Column) -> Column:
    """A JSON array of questions, or else one of each line, list marks dropped."""
    parsed = F.from_json(answer, "array<string>")
    lines = F.filter(F.transform(F.split(answer, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)])\s*", ""), r"\s+$", "")), lambda x: x != "")
    return F.when(answer.rlike(r"^\s*\["), F.coalesce(parsed, lines)).otherwise(lines)


#: Words that begin sentences and are no names.
NO_NAMES = ("The", "This", "That", "These", "Those", "A", "An")


def harvest(context: Column) -> Column:
    """Names in a context, distinct: of each paragraph what is quoted, capitalised words but NO_NAMES, then runs of capitalised words."""
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), 1)
    word = r"(?U)\b([A-Z][a-z]+)\b"
    run = r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"

    def of(paragraph: Column) -> Column:
        words = F.filter(found(paragraph, word), lambda w: ~w.isin(*NO_NAMES))
        return F.concat(found(paragraph, '"([^"]+)"'), words, found(paragraph, run))

    return F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(context, F.lit("")), "\n\n", -1), of)))


def merge_hops(contexts: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """contexts(by..., hop, pos, content) with later hops first, one of each first 80 characters, within a budget of a quarter of the characters."""
    seen = Window.partitionBy(*by, F.substring("content", 1, 80)).orderBy(F.desc("hop"), "pos")
    one = contexts.withColumn("__n", F.row_number().over(seen)).where("__n = 1").drop("__n")
    used = F.sum(F.floor(F.length("content") / 4)).over(Window.partitionBy(*by).orderBy(F.desc("hop"), "pos").rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("__used", used).where(F.col("__used") <= budget).drop("__used")


def pack_rows(rows: DataFrame, by: list[str], text: Column, order: list[Column], budget: Column | int, size: Size = n_tokens) -> DataFrame:
    """rows of each community within a budget of the tokens of their text."""
    return within_budget(rows.withColumn("tokens", size(text)), "tokens", budget, order, by)


def pack_communities(membership: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int = 12000, size: Size = n_tokens) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) rows of each cluster for its report: the budget is split by their counts, each part sorted by degree."""
    key = ["level", "cluster"]
    n = membership.join(nodes, "id")
    e = both_ways(edges, "description", "weight").join(membership, "id").select(*key, F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), "description", "weight").dropDuplicates([*key, "src", "dst"])
    e = edge_degrees(e, edges)
    counts = n.groupBy(*key).agg(F.count("*").alias("nn")).join(e.groupBy(*key).agg(F.count("*").alias("ne")), key, "left")
    share = counts.select(*key, F.floor(budget * F.col("nn") / (F.col("nn") + F.coalesce("ne", F.lit(0)))).alias("for_nodes"))
    kept_n = pack_rows(n.join(share, key), key, F.concat_ws(" ", "entity_name", "description"), [F.desc("degree"), F.col("id")], F.col("for_nodes"), size)
    kept_e = pack_rows(e.join(share, key), key, F.col("description"), [F.desc("degree"), F.col("src"), F.col("dst")], budget - F.col("for_nodes"), size)
    return kept_n.drop("for_nodes", "tokens"), kept_e.drop("for_nodes", "tokens")


def pack_sub_reports(subs: DataFrame, reports: DataFrame, membership: DataFrame, budget: int = 12000, size: Size = n_tokens) -> tuple[DataFrame, DataFrame]:
    """(reports, members left) of large clusters: reports of their sub(level, cluster, sub) by occurrence within the budget, and members that none of those covers."""
    rows = subs.join(reports.select(F.col("cluster").alias("sub"), "report", "occurrence"), "sub").withColumn("tokens", size(F.col("report")))
    kept = within_budget(rows, "tokens", budget, [F.desc("occurrence"), F.col("sub")], ["level", "cluster"])
    covered = kept.select("cluster", "sub").join(membership.select(F.col("cluster").alias("sub"), "id"), "sub").select("cluster", "id").distinct()
    left = membership.join(subs.select("level", "cluster").distinct(), ["level", "cluster"], "left_semi").join(covered, ["cluster", "id"], "left_anti")
    return kept.drop("tokens"), left


def report_text(report: Column) -> Column:
    """Markdown of a report struct(title, summary, findings array<struct<summary, explanation>>)."""
    parts = F.transform(report["findings"], lambda f: F.concat(F.lit("## "), F.coalesce(f["summary"], F.lit("")), F.lit("\n\n"), F.coalesce(f["explanation"], F.lit(""))))
    return F.concat(F.lit("# "), report["title"], F.lit("\n\n"), report["summary"], F.lit("\n\n"), F.array_join(parts, "\n\n"))
