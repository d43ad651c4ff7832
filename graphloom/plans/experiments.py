"""Experiments: plugins by stage, a runner over datasets, metrics and modes, results as tables, comparisons."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, graph, vectors
from ..sources import datasets
from ..sources.store import Store, materialize
from . import answers, evaluation, retrieval
from .engine import Config, Engine, QueryParam

#: Stages of plugins.
STAGES = ("chunker", "entity_extractor", "retriever", "reranker", "generator")
_plugins: dict[str, dict[str, Callable]] = {s: {} for s in STAGES}


def register(stage: str, name: str):
    """Put a function or class under a name of a stage."""
    if stage not in _plugins:
        raise ValueError(f"unknown stage {stage!r}; stages: {list(STAGES)}")

    def put(plugin):
        _plugins[stage][name] = plugin
        return plugin

    return put


def resolve(stage: str, name: str) -> Callable:
    if stage not in _plugins:
        raise KeyError(f"unknown stage {stage!r}; stages: {list(STAGES)}")
    if name not in _plugins[stage]:
        raise KeyError(f"no {stage} {name!r}; there are {list(_plugins[stage])}")
    return _plugins[stage][name]


def registered(stage: str) -> list[str]:
    return list(_plugins.get(stage, {}))


def unregister(stage: str | None = None) -> None:
    """Forget the plugins of a stage, or of all."""
    for s in STAGES if stage is None else [stage]:
        _plugins.get(s, {}).clear()


def install() -> None:
    """Register the library's own plugins. Chunkers: (docs, size, overlap) -> chunks; retrievers: (engine, question, param) -> context; rerankers: (passages, question, scorer, k) -> passages."""
    register("chunker", "token_size")(chunking.token_windows)
    register("chunker", "separator")(chunking.separator_chunks)
    for mode in ("local", "global", "naive", "multihop"):
        register("retriever", mode)(lambda engine, question, param, mode=mode: engine.context(question, QueryParam(**{**vars(param), "mode": mode})) or "")
    register("retriever", "adaptive")(adaptive)
    register("retriever", "hipporag")(ranked_nodes)
    register("retriever", "hybrid")(lambda engine, question, param: answers.hybrid(engine.spark, question, [lambda q, m=m: resolve("retriever", m)(engine, q, param) for m in ("local", "naive")]))
    register("retriever", "raptor")(tree_search)
    register("reranker", "cross_encoder")(vectors.rerank)


def adaptive(engine: Engine, question: str, param: QueryParam) -> str:
    """The context of the retriever that the question's wording asks for."""
    mode = engine.spark.createDataFrame([(question,)], "q string").select(retrieval.route(F.col("q")).alias("m")).first().m
    return resolve("retriever", mode)(engine, question, param)


def ranked_nodes(engine: Engine, question: str, param: QueryParam, k: int = 20) -> str:
    """The k nodes with the highest personalised PageRank from the entities nearest to the question, or those of the highest degree without any."""
    s = engine.store
    nodes = s.read("entities").withColumnRenamed("entity_id", "id")
    edges = s.read("relationships")
    seeds = engine._hits("entity_vectors", question, param.top_k).select("id")
    if not seeds.limit(1).count():
        seeds = graph.fallback_seeds(nodes, edges)
    ranks = graph.pagerank(nodes.select("id"), edges, seeds, tolerance=1e-6)
    top = ranks.orderBy(F.desc("rank"), "id").limit(k).join(nodes, "id").orderBy(F.desc("rank"), "id").collect()
    return "\n\n".join(f"{r.entity_name}: {r.description}" for r in top)


def tree_search(engine: Engine, question: str, param: QueryParam) -> str:
    """Contents of the summary tree's nodes, of all levels, whose vectors have the greatest dot product with the question's. The tree is built anew when the chunks have changed."""
    s = engine.store
    mark = json.dumps(s.state()["chunks"], sort_keys=True)
    if not s.has("tree") or s.read("tree_of").first().version != mark:
        leaves = s.read("chunks").select(F.col("chunk_id").alias("node_id"), "content").join(s.read("chunk_vectors").select(F.col("id").alias("node_id"), "embedding"), "node_id")
        s.commit(tree=vectors.build_tree(leaves), tree_of=engine.spark.createDataFrame([(mark,)], "version string"))
    vector = [float(x) for x in engine.config.embed([question])[0]]
    rows = s.read("tree").select(F.col("node_id").alias("id"), "content", "embedding")
    return "\n\n".join(r.content for r in vectors.top_k(rows, vector, param.top_k, measure="dot").collect())


#: Metrics that a suite may have: columns prediction, gold, context and facts to a score.
METRICS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "exact_match": lambda p, g, c, f: evaluation.exact_match(p, g),
    "token_f1": lambda p, g, c, f: evaluation.token_f1(p, g),
    "context_recall": lambda p, g, c, f: evaluation.context_recall(c, f),
}


@dataclass
class Suite:
    """Metrics by name; baseline: exact match and token F1."""

    names: list[str] = field(default_factory=lambda: ["exact_match", "token_f1"])

    def __post_init__(self):
        unknown = [n for n in self.names if n not in METRICS]
        if unknown:
            raise ValueError(f"unknown metrics: {unknown}")

    def add(self, name: str, metric: Callable[[Column, Column, Column, Column], Column]) -> None:
        METRICS[name] = metric
        self.names = [*self.names, name]

    def remove(self, name: str) -> None:
        self.names = [n for n in self.names if n != name]

    def score(self, rows: DataFrame) -> DataFrame:
        """rows(prediction, gold, context, facts) with a column for each metric."""
        return rows.withColumns({n: METRICS[n](F.col("prediction"), F.col("gold"), F.col("context"), F.col("facts")) for n in self.names})


#: What a judge is asked, and the columns that it is shown.
JUDGEMENTS = {
    "faithfulness": ("Is this answer supported by the context?", ("context", "prediction")),
    "answer_relevance": ("Does this answer meet the question?", ("question", "prediction")),
}


def judged(rows: DataFrame, judge: Callable[[list[str]], list[float]], question: str = JUDGEMENTS["faithfulness"][0], shown: Sequence[str] = ("context", "prediction"), name: str = "score", batch: int = 16) -> DataFrame:
    """rows with a judge model's score of each, 0 to 1, asked `batch` prompts at a time on executors.

    A prompt is the question and the shown columns, nulls left out. A batch that fails is asked prompt by
    prompt; what still fails, or gets no number, has a null score, which means leave out.
    """

    def numbers(prompts: list[str]) -> list[float | None]:
        told = [float(x) for x in judge(prompts)]
        if len(told) != len(prompts):
            raise ValueError(f"{len(told)} scores for {len(prompts)} prompts")
        return [None if x != x else min(1.0, max(0.0, x)) for x in told]

    def alone(prompt: str) -> float | None:
        try:
            return numbers([prompt])[0]
        except Exception:  # a row without a score
            return None

    def scores(prompts: pd.Series) -> pd.Series:
        out: list[float | None] = []
        asked = prompts.tolist()
        for i in range(0, len(asked), batch):
            part = asked[i : i + batch]
            try:
                out += numbers(part)
            except Exception:
                out += [alone(p) for p in part]
        return pd.Series(out, dtype="float64")

    return rows.withColumn(name, F.pandas_udf(scores, "double")(F.concat_ws("\n", F.lit(question), *[F.col(c) for c in shown])))


def judged_all(rows: DataFrame, judge: Callable[[list[str]], list[float]], batch: int = 16) -> DataFrame:
    """rows(question, prediction, context, ...) with a column for each of JUDGEMENTS."""
    for name, (question, shown) in JUDGEMENTS.items():
        rows = judged(rows, judge, question, shown, name, batch)
    return rows


@dataclass
class Experiment:
    """What a run does. variant: other values for the engine's config."""

    name: str
    dataset: str
    questions_path: str
    corpus_path: str
    modes: list[str] = field(default_factory=lambda: ["local", "naive"])
    metrics: list[str] = field(default_factory=lambda: ["exact_match", "token_f1"])
    max_samples: int | None = None
    max_corpus_samples: int | None = None
    param: dict = field(default_factory=dict)
    variant: dict = field(default_factory=dict)


class Results:
    """Runs of experiments in a store: scores(run_id, experiment, dataset, mtime, mode, metric, score) and predictions."""

    def __init__(self, store: Store):
        self.store = store

    def save(self, run_id: str, scores: DataFrame, predictions: DataFrame) -> str:
        put = lambda name, df: df if not self.store.has(name) else self.store.read(name).where(F.col("run_id") != run_id).unionByName(df)
        self.store.commit(scores=put("scores", scores), predictions=put("predictions", predictions))
        return run_id

    def load(self, run_id: str) -> DataFrame:
        return self.store.read("scores").where(F.col("run_id") == run_id)

    def runs(self, experiment: str | None = None) -> list[str]:
        """Ids of the runs, of one experiment if asked, sorted."""
        if not self.store.has("scores"):
            return []
        rows = self.store.read("scores")
        rows = rows.where(F.col("experiment") == experiment) if experiment else rows
        return [r.run_id for r in rows.select("run_id").distinct().orderBy("run_id").collect()]

    def export(self, run_id: str, folder: str) -> str:
        """A run's scores as JSON under its name, other characters than letters, digits, points and hyphens replaced."""
        path = f"{folder}/{re.sub(r'[^A-Za-z0-9.-]', '_', run_id)}"
        self.load(run_id).coalesce(1).write.mode("overwrite").json(path)
        return path


def run(spark: SparkSession, x: Experiment, path: str, results: Results | None = None, config: Config | None = None) -> DataFrame:
    """(mode, metric, score) of an experiment: the corpus is indexed, each question answered in each mode, answers scored; kept in results if given."""
    suite = Suite(x.metrics)
    asked, corpus = datasets.load(spark, x.dataset, x.questions_path, x.corpus_path, x.max_samples, x.max_corpus_samples)
    config = config or Config()
    for key, value in x.variant.items():
        setattr(config, key, value)
    engine = Engine(spark, path, config)
    engine.insert_documents(corpus.select(F.col("id").alias("doc_id"), F.concat_ws("\n", "title", "content").alias("content")))
    rows = []
    for q in asked.collect():  # the questions of a benchmark
        for mode in x.modes:
            param = QueryParam.of({**x.param, "mode": mode})
            context = engine.context(q.question, param) or ""
            rows.append((mode, q.id, engine.query(q.question, param), q.answer, context, q.supporting_facts or []))
    table = spark.createDataFrame(rows, "mode string, question_id string, prediction string, gold string, context string, facts array<string>")
    scored = materialize(suite.score(table))
    means = materialize(evaluation.metric_means(scored, ["mode"], suite.names))
    if results:
        now = time.time()
        run_id = f"{x.name}-{int(now * 1000)}"
        results.save(run_id, means.select(F.lit(run_id).alias("run_id"), F.lit(x.name).alias("experiment"), F.lit(x.dataset).alias("dataset"), F.lit(now).alias("mtime"), "mode", "metric", "score"), scored.withColumn("run_id", F.lit(run_id)))
    return means


def compare(spark: SparkSession, shared: dict, a: dict, b: dict, path: str) -> DataFrame:
    """(mode, metric, a, b, delta) of two variants of one experiment: shared settings with each one's own over them."""
    scores = [run(spark, Experiment(**{**shared, **own}), f"{path}/{name}") for name, own in (("a", a), ("b", b))]
    return evaluation.experiment_delta(*scores)


def examples(questions: DataFrame, most: int = 20) -> DataFrame:
    """The first questions that have supporting facts, for prompts with examples."""
    return questions.where(F.size("supporting_facts") > 0).orderBy("id").limit(most)
