"""Vector tables: exact top-k, thresholds, rank fusion, reranking, summary trees."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import materialize
from .vector_index import exact


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k(vectors: DataFrame, query: list[float], k: int, threshold: float | None = None, measure: str = "cosine", tie: str = "id") -> DataFrame:
    """vectors(id, embedding, ...) most similar to a query vector: similarity, distance = 1 - similarity; equal ones by id. An exact scan with a bounded heap per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = dot(F.col("embedding"), q) / F.lit(math.sqrt(sum(x * x for x in query)) or 1.0) / F.sqrt(dot(F.col("embedding"), F.col("embedding"))) if measure == "cosine" else dot(F.col("embedding"), q)
    scored = vectors.withColumn("similarity", sim)
    if threshold is not None:
        scored = scored.where(F.col("similarity") >= threshold)
    return scored.withColumn("distance", 1 - F.col("similarity")).orderBy(F.desc("similarity"), tie).limit(k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, rank) for queries(query_id, embedding), a stated set, against all vectors: an exact scan of blocks by blocks."""
    return exact(vectors, queries, k)


def embed(rows: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], batch: int = 32) -> DataFrame:
    """rows with the embedding of a text column, in batches."""
    columns = rows.columns

    def run(frames):
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            parts = [model(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield frame.assign(embedding=[v.tolist() for p in parts for v in np.asarray(p, np.float32)])

    return rows.select(*columns).mapInPandas(run, ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + ", embedding array<float>")


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic offline embedder: signed hashed words, unit length."""

    def model(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1 if h & (1 << 20) else -1
            out[i] /= max(float(np.linalg.norm(out[i])), 1e-9)
        return out

    return model


def weighted_fusion(passages: DataFrame, k: int) -> DataFrame:
    """(retriever_pos, pos, passage) of passages(retriever_pos, weight, result): passages between blank lines, those of heavier retrievers first; repeats stay."""
    each = passages.select("retriever_pos", "weight", F.posexplode(F.split("result", "\n\n", -1)).alias("pos", "passage")).withColumn("passage", F.regexp_replace("passage", r"^\s+|\s+$", "")).where("passage <> ''")
    return each.orderBy(F.desc("weight"), "retriever_pos", "pos").limit(k).select("retriever_pos", "pos", "passage")


def reciprocal_rank_fusion(passages: DataFrame, k: int, c: int = 60) -> DataFrame:
    """(passage, score): equal passages' weight / (c + rank + 1) summed, ranks from 0; equal scores by first place."""
    each = passages.select("retriever_pos", "weight", F.posexplode(F.filter(F.transform(F.split("result", "\n\n", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")).alias("pos", "passage"))
    scored = each.groupBy("passage").agg(F.sum(F.col("weight") / (F.col("pos") + c + 1)).alias("score"), F.min(F.struct("retriever_pos", "pos")).alias("first"))
    return scored.orderBy(F.desc(F.round("score", 12)), "first").limit(k).select("passage", "score")


def rerank(passages: DataFrame, query: str, score: Callable[[list[tuple[str, str]]], list[float]], k: int = 20) -> DataFrame:
    """The k passages(pos, passage) that a scorer of (query, passage) pairs rates highest."""

    def run(frames):
        for frame in frames:
            yield frame.assign(score=np.asarray(score([(query, p) for p in frame["passage"]]), float))

    rated = passages.select("pos", "passage").mapInPandas(run, f"pos {dict(passages.dtypes)['pos']}, passage string, score double")
    return rated.orderBy(F.desc("score"), "pos").limit(k)


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """Share of the query's words that a passage has: an offline stand-in for a cross-encoder."""
    out = []
    for q, p in pairs:
        a, b = set(q.lower().split()), set(p.lower().split())
        out.append(len(a & b) / max(len(a), 1))
    return out


def tree_level(nodes: DataFrame, level: int, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """nodes(node_id, embedding, content) with the cluster of the next level: clamp(floor(sqrt(n)), 2, 5) clusters, one for two nodes or fewer."""
    from pyspark.ml.clustering import GaussianMixture, KMeans
    from pyspark.ml.functions import array_to_vector

    n = nodes.count()
    if n <= 2:
        return nodes.withColumn("cluster", F.lit(0))
    k = min(max(int(math.sqrt(n)), 2), 5)
    table = nodes.withColumn("v", array_to_vector(F.col("embedding")))
    model = (GaussianMixture if method == "gmm" else KMeans)(k=k, seed=seed + level, featuresCol="v", predictionCol="cluster").fit(table)
    return model.transform(table).select(*nodes.columns, "cluster")


def build_tree(leaves: DataFrame, summarise: Callable[[str], str] | None = None, levels: int = 3, method: str = "kmeans") -> DataFrame:
    """(node_id, parent_id, level, content, embedding): leaves(node_id, content, embedding), and summaries of their clusters level by level. A summary: the model's of the joined contents cut to 4000 characters, or their first 500; its embedding: the mean."""
    tell = F.pandas_udf(lambda s: s.map(summarise), "string") if summarise else (lambda c: F.substring(c, 1, 500))
    now, out = leaves.select("node_id", "content", "embedding"), None
    for level in range(levels):
        placed = materialize(tree_level(now, level, method))
        name = F.concat(F.lit(f"s{level + 1}-"), F.col("cluster").cast("string"))
        done = placed.select("node_id", name.alias("parent_id"), F.lit(level).alias("level"), "content", "embedding")
        out = done if out is None else out.unionByName(done)
        # a summary reads 4000 characters, so no more than the first contents of a cluster are gathered
        rank = F.sum(F.length("content") + 1).over(Window.partitionBy("cluster").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1))
        first = placed.withColumn("before", F.coalesce(rank, F.lit(0))).where("before < 4000").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("node_id", F.substring("content", 1, 4000).alias("c")))).alias("cs"))
        dims = placed.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        joined = first.join(dims, "cluster")
        now = materialize(joined.select(name.alias("node_id"), tell(F.substring(F.array_join("cs.c", "\n"), 1, 4000)).alias("content"), F.transform("v.x", lambda x: x.cast("float")).alias("embedding")))
        if now.count() <= 1:
            break
    return out.unionByName(now.select("node_id", F.lit(None).cast("string").alias("parent_id"), F.lit(level + 1).alias("level"), "content", "embedding"))
