"""Answer metrics, experiment comparison, and caches of model answers as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_words


def exact_match(prediction: Column, gold: Column) -> Column:
    """1.0 if both normalise to the same words once lower-cased."""
    norm = lambda c: F.array_join(answer_words(F.lower(c)), " ")
    return (norm(prediction) == norm(gold)).cast("double")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 over the sets of words; without gold words 1.0 if there are no predicted ones either."""
    p, g = F.array_distinct(answer_words(prediction)), F.array_distinct(answer_words(gold))
    both = F.size(F.array_intersect(p, g)).cast("double")
    none = F.when(F.size(g) == 0, (F.size(p) == 0).cast("double"))
    return F.coalesce(none, F.when((F.size(p) == 0) | (both == 0), 0.0).otherwise(2 * both / (F.size(p) + F.size(g))))


def context_recall(context: Column, facts: Column) -> Column:
    """Share of supporting facts that the context contains, whatever the case; 1 without facts, 0 without context."""
    found = F.size(F.filter(facts, lambda f: F.contains(F.lower(context), F.lower(f))))
    return F.when(F.coalesce(F.size(facts), F.lit(0)) < 1, 1.0).when(F.coalesce(context, F.lit("")) == "", 0.0).otherwise(found / F.size(facts))


def entity_overlap(predicted: Column, gold: Column) -> Column:
    """Share of the gold names, upper-cased, that were predicted; 1 without gold names."""
    up = lambda c: F.array_distinct(F.transform(c, F.upper))
    return F.when(F.size(gold) == 0, 1.0).otherwise(F.size(F.array_intersect(up(predicted), up(gold))) / F.size(up(gold)))


def metric_means(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by..., metric, score): means of metric columns, in long form."""
    means = rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])
    return means.unpivot(by, metrics, "metric", "score")


def experiment_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mode, metric, a, b, delta) of two runs(mode, metric, score), for what both have."""
    return a.withColumnRenamed("score", "a").join(b.withColumnRenamed("score", "b"), ["mode", "metric"]).withColumn("delta", F.col("b") - F.col("a"))


def paired_significance(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, delta, significant) of pairs(a, b): |t| over 1.96; equal differences count if they aren't 0; fewer than two pairs never do."""
    d = F.col("b") - F.col("a")
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("delta"), F.var_samp(d).alias("v"))
    t = F.abs(F.col("delta")) / F.sqrt(F.col("v") / F.col("n"))
    return g.select(*by, "n", "delta", F.when(F.col("n") < 2, False).when(F.col("v") < 1e-18, F.abs("delta") > 0).otherwise(t > 1.96).alias("significant"))


def cache_lookup(prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of prompts(args_hash, ...) against cache(args_hash, answer)."""
    return prompts.join(cache, "args_hash"), prompts.join(cache.select("args_hash"), "args_hash", "left_anti")


def cache_stats(lookups: DataFrame) -> DataFrame:
    """One row: entries, models, hit_rate of lookups(args_hash, model, hit)."""
    return lookups.agg(F.countDistinct("args_hash").alias("entries"), F.countDistinct("model").alias("models"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """(dataset, run_id, score, delta, won): the last run of each dataset of runs(dataset, run_id, mtime, mode, score), best mode against naive."""
    last = runs.groupBy("dataset").agg(F.max_by("run_id", F.struct("mtime", "run_id")).alias("run_id"))
    rows = runs.join(last, ["dataset", "run_id"])
    naive = rows.groupBy("dataset", "run_id").agg(F.max(F.when(F.col("mode") == "naive", F.col("score"))).alias("naive"), F.max(F.when(F.col("mode") != "naive", F.col("score"))).alias("score"))
    return naive.select("dataset", "run_id", "score", (F.col("score") - F.col("naive")).alias("delta"), (F.col("score") > F.col("naive")).alias("won"))


def markdown(rows: DataFrame) -> str:
    """A Markdown table of all rows of a report, read one after the other."""
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows.toLocalIterator())])
