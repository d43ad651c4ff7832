"""Answers beyond one context: map and reduce over reports, multi-hop merging, grounding, fused retrievers."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.budget import greedy_bins
from ..functions.model import Model
from ..functions.text import csv_row, n_tokens
from ..operators import vectors
from ..operators.extraction import call_model
from .retrieval import Size, harvest, merge_hops, reduce_points, sub_questions

MAP = "Points of these reports that help to answer the question, as JSON {points: [{description, score}]}.\n"


def offline_mapper(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model: every report line is a point, scored by the question's words that it has."""
    out = []
    for p in prompts:
        question, _, rows = p.removeprefix(MAP).partition("\n")
        asked = set(question.lower().split())
        points = [{"description": r.split(",\t")[1].strip('"'), "score": 1 + len(asked & set(r.lower().split()))} for r in rows.split("\n")[1:] if ",\t" in r]
        out.append(json.dumps({"points": points}))
    return out


def global_points(chosen: DataFrame, question: str, model: Model, budget: int = 16384, size: Size = n_tokens) -> str | None:
    """The text of the points that a model makes of groups of chosen(cluster, occurrence, rating, report) within the budget; the best within the budget, by analyst; None without points."""
    order = ["neg_occurrence", "neg_rating", "cluster"]
    rows = chosen.select("cluster", "report", "rating", "occurrence", (-F.col("occurrence")).alias("neg_occurrence"), (-F.col("rating")).alias("neg_rating"), size(F.col("report")).alias("tokens"), F.lit(0).alias("one"))
    bins = greedy_bins(rows, "cluster", "tokens", budget, order, ["one"])  # of the communities that a query considers
    line = csv_row(F.col("cluster"), F.regexp_replace("report", r"\s+", " "), F.col("rating"), F.col("occurrence"))
    groups = rows.join(bins, ["one", "cluster"]).groupBy("bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    prompt = F.concat(F.lit(f"{MAP}{question.strip().replace(chr(10), ' ')}\nid,content,rating,importance\n"), "lines")
    told = call_model(groups, prompt, model, 1).select(F.col("bin").alias("analyst"), F.col("output").alias("answer"))
    points = reduce_points(told, budget, size).orderBy(F.desc("score"), "analyst", "pos").collect()
    return "\n".join(f"----Analyst {r.analyst}----\nImportance Score: {r.score:g}\n{r.description}\n" for r in points) or None


def decompose(question: str, model: Callable[[str], str], most: int = 4) -> list[str]:
    """At most `most` sub-questions that a model makes of a question; the question itself if there are none."""
    said = model(f"Split into at most {most} simpler questions, a JSON array of strings:\n{question}")
    spark = SparkSession.getActiveSession()
    parts = spark.createDataFrame([(said,)], "a string").select(sub_questions(F.col("a")).alias("q")).first().q
    return list(parts or [])[:most] or [question]


def hop_pieces(context: str) -> tuple[list[str], list[str]]:
    """(source lines, names) of a local context."""
    spark = SparkSession.getActiveSession()
    names = spark.createDataFrame([(context,)], "c string").select(harvest(F.col("c")).alias("n")).first().n
    sources = context.rpartition("-----Sources-----")[2] if "-----Sources-----" in context else context
    lines = [x for x in sources.split("\n") if x.strip() and not x.startswith(("```", '"id"'))]
    return lines, list(names)


def merge_hop_texts(spark: SparkSession, states: list[list[str]], budget: int) -> str:
    """Pieces of all hops, later hops first, without repeats, within the budget."""
    rows = [(0, hop, pos, text) for hop, pieces in enumerate(states) for pos, text in enumerate(pieces)]
    table = spark.createDataFrame(rows, "one int, hop int, pos int, content string")
    kept = merge_hops(table, budget, ["one"]).orderBy(F.desc("hop"), "pos").collect()
    return "\n\n".join(r.content for r in kept)


def entity_list(rows: list) -> str:
    return "\n".join(f"- {r.canonical_name}: {r.description or ''}" for r in rows)


def grounded_prompt(question: str, rows: list, fallback: str) -> str:
    return f"Answer in under ten words with names from this list only, separated by commas, or say: {fallback}\n{entity_list(rows)}\n\nQuestion: {question}"


def named_in(answer: str, rows: list) -> list[tuple[str, str]]:
    """(id, canonical name) of rows that an answer names, by any of their names, whatever the case."""
    said = answer.lower()
    return [(r.id, r.canonical_name) for r in rows if any(n.lower() in said for n in [r.canonical_name, *(r.aliases or [])] if n)]


def joined(answer: str, names: list[str]) -> str:
    """Names joined as the answer joins them: by " and " if it has that or an ampersand, else by commas."""
    low = answer.lower()
    return (" and " if " and " in low or " & " in low else ", ").join(names)


def confidence(used: list[str], retrieved: list[str]) -> float:
    """min(1, 0.4 used / retrieved + 0.6 share of used among the first ten); 0 if nothing was used or retrieved."""
    if not used or not retrieved:
        return 0.0
    return min(1.0, 0.4 * len(used) / len(retrieved) + 0.6 * len(set(used) & set(retrieved[:10])) / len(used))


FUSIONS = ("weighted_avg", "reciprocal_rank", "rrf")


def hybrid(spark: SparkSession, question: str, retrievers: list[Callable[[str], str]], weights: list[float] | None = None, fusion: str = "rrf", k: int = 20) -> str:
    """Passages of several retrievers, fused; those that fail or find nothing are left out. Equal weights unless given."""
    if fusion not in FUSIONS:
        raise ValueError(f"fusion: {fusion}")
    if weights is not None and len(weights) != len(retrievers):
        raise ValueError("a weight for each retriever")
    rows = []
    for i, r in enumerate(retrievers):
        try:
            found = r(question)
        except Exception:
            continue
        if found:
            rows.append((i, float(weights[i]) if weights else 1.0 / len(retrievers), found))
    if not rows:
        return ""
    table = spark.createDataFrame(rows, "retriever_pos int, weight double, result string")
    if fusion == "weighted_avg":
        fused = vectors.weighted_fusion(table, k).collect()
        weight = {i: w for i, w, _ in rows}
        fused.sort(key=lambda r: (-weight[r.retriever_pos], r.retriever_pos, r.pos))
    else:
        fused = vectors.reciprocal_rank_fusion(table, k).collect()
    return "\n\n".join(r.passage for r in fused)
