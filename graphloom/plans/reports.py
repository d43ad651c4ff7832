"""Community reports by a model, level by level from the deepest one up."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model import Model
from ..functions.text import csv_row, n_tokens, response_to_json
from ..operators.extraction import call_model
from ..operators.graph import both_ways
from ..sources.store import materialize
from .retrieval import Size, pack_communities, pack_sub_reports, report_text

#: Nodes or edges beyond which a community is told by the reports of its sub-communities.
LARGE = 100
ASK = "Write a report on this community of entities as JSON with title, summary, rating (0 to 10), rating_explanation and findings [{summary, explanation}].\n"
REPORT = "title string, summary string, rating double, rating_explanation string, findings array<struct<summary:string,explanation:string>>"
COLUMNS = ["level", "cluster", "occurrence", "title", "rating", "report", "report_json"]


def offline_reporter(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model: names the entities of most links, counts rows, and finds each relation's description."""
    out = []
    for p in prompts:
        parts = {name: body.strip().split("\n")[1:] for name, body in re.findall(r"-----(\w+)-----\n(.*?)(?=\n-----|\Z)", p, re.S)}
        cell = lambda row, i: (row.split(",\t") + [""] * 9)[i].strip('"')
        names = [cell(r, 1) for r in parts.get("Entities", [])] or [cell(r, 1) for r in parts.get("Reports", [])]
        links = parts.get("Relationships", [])
        title = " and ".join(names[:2])
        summary = f"{len(names)} entities, {len(links)} relationships: " + ", ".join(names)
        findings = [{"summary": f"{cell(r, 1)} and {cell(r, 2)}", "explanation": cell(r, 3)} for r in links]
        out.append(json.dumps({"title": title, "summary": summary, "rating": round(min(10.0, 1 + math.log2(1 + len(names) + len(links))), 2), "rating_explanation": "by its size", "findings": findings}))
    return out


def _lines(rows: DataFrame, order: list[Column], *cells: Column) -> DataFrame:
    """(level, cluster, text): CSV lines of the rows of each community, which a budget has cut before."""
    line = csv_row(*cells)
    return rows.groupBy("level", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def describe(members: DataFrame, nodes: DataFrame, edges: DataFrame, subs: DataFrame, reports: DataFrame, budget: int, size: Size = n_tokens) -> DataFrame:
    """(level, cluster, prompt) of the communities of one level: entities and relations within the budget, or for large ones the reports of their sub-communities and what those don't cover."""
    key = ["level", "cluster"]
    inside = both_ways(edges).join(members, "id").groupBy(*key).agg((F.count("*") / 2).alias("links"))
    sizes = members.groupBy(*key).agg(F.count("*").alias("n")).join(inside, key, "left")
    large = materialize(sizes.where((F.col("n") > LARGE) | (F.col("links") > LARGE)).select(*key))
    told, left = pack_sub_reports(subs.join(large, key, "left_semi"), reports, members.join(large, key, "left_semi"), budget // 2, size)
    rest = materialize(members.join(large, key, "left_anti").unionByName(left.select(*members.columns)).unionByName(members.join(large, key, "left_semi").join(subs.select(*key).distinct(), key, "left_anti")).distinct())
    n, e = pack_communities(rest, nodes, edges, budget // 2 if large.limit(1).count() else budget, size)
    names = nodes.select("id", "entity_name")
    e = e.join(names.select(F.col("id").alias("src"), F.col("entity_name").alias("from")), "src", "left").join(names.select(F.col("id").alias("dst"), F.col("entity_name").alias("to")), "dst", "left")
    sections = [
        ("Reports", "id,report", _lines(told, [-F.col("occurrence"), F.col("sub")], F.col("sub"), F.regexp_replace("report", r"\s+", " "))),
        ("Entities", "id,entity,type,description,degree", _lines(n, [-F.col("degree"), F.col("id")], F.col("id"), F.col("entity_name"), F.col("entity_type"), F.col("description"), F.col("degree"))),
        ("Relationships", "id,source,target,description,rank", _lines(e, [-F.col("degree"), F.col("src"), F.col("dst")], F.lit("r"), F.coalesce("from", "src"), F.coalesce("to", "dst"), F.col("description"), F.col("degree"))),
    ]
    out = members.select(*key).distinct()
    for title, head, lines in sections:
        out = out.join(lines.withColumnRenamed("text", title), key, "left")
    texts = [F.when(F.col(title).isNotNull(), F.concat(F.lit(f"-----{title}-----\n{head}\n"), F.col(title))) for title, head, _ in sections]
    return out.select(*key, F.concat(F.lit(ASK), F.concat_ws("\n", *texts)).alias("prompt"))


def community_reports(membership: DataFrame, nodes: DataFrame, edges: DataFrame, schema: DataFrame, subs: DataFrame, model: Model = offline_reporter, budget: int = 12000, existing: DataFrame | None = None, only: DataFrame | None = None, size: Size = n_tokens) -> DataFrame:
    """COLUMNS of each community of membership(id, level, cluster): the model's report on it, as Markdown and as JSON.

    Levels are told from the deepest up, so that large communities can use the reports below them.
    existing: reports that stay unless `only`(cluster) names their cluster; those of clusters that the
    schema(level, cluster, occurrence) no longer has go. nodes(id, entity_name, entity_type, description,
    degree), edges(src, dst, description, weight), subs(level, cluster, sub).
    """
    keys = schema.select("level", "cluster", "occurrence")
    done = None
    if existing is not None:
        kept = existing.join(only.select("cluster").distinct(), "cluster", "left_anti") if only is not None else existing.limit(0)
        done = materialize(kept.drop("level", "occurrence").join(keys, "cluster").select(*COLUMNS))
    levels = sorted((r.level for r in membership.select("level").distinct().collect()), reverse=True)  # as many as resolutions
    for level in levels:
        members = membership.where(F.col("level") == level).select("id", "level", "cluster")
        if done is not None:
            members = members.join(done.select("cluster"), "cluster", "left_anti").select("id", "level", "cluster")
        empty = members.sparkSession.createDataFrame([], "cluster string, report string, occurrence double")
        asked = describe(materialize(members), nodes, edges, subs.where(F.col("level") == level), done.select("cluster", "report", "occurrence") if done is not None else empty, budget, size)
        told = call_model(asked, F.col("prompt"), model).select("level", "cluster", response_to_json(F.col("output")).alias("report_json"))
        parsed = told.withColumn("r", F.from_json("report_json", REPORT))
        rows = parsed.join(keys.drop("level"), "cluster").select("level", "cluster", "occurrence", F.col("r.title").alias("title"), F.coalesce("r.rating", F.lit(0.0)).alias("rating"), F.coalesce(report_text(F.col("r")), F.lit("")).alias("report"), "report_json")
        done = materialize(rows if done is None else done.unionByName(rows.select(*COLUMNS)))
    if done is None:  # no communities
        done = membership.sparkSession.createDataFrame([], "level int, cluster string, occurrence double, title string, rating double, report string, report_json string")
    return done


def stale_reports(reports: DataFrame, schema: DataFrame) -> DataFrame:
    """(cluster) of reports whose community the schema no longer has."""
    return reports.select("cluster").distinct().join(schema.select("cluster"), "cluster", "left_anti")


def budget_row(*cells: Column) -> Column:
    """A CSV row with inner quotes doubled, as it is counted against a budget."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), '"', '""'), F.lit('"')) for c in cells])


def row_tokens(*cells: Column) -> Column:
    return n_tokens(budget_row(*cells))
