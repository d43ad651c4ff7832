"""Nearest neighbours by an inverted file: k-means cells as a partitioned table, probed by their centres.

Centres are trained on a bounded sample and kept with the table. A vector lies in the cell of its
nearest centre. A query reads the cells of its nearest centres only, takes OVERFETCH times k of each
cell without deleted rows, and ranks what it finds. Queries are a table: they meet cells in a join by
cell, blocks of queries with blocks of a cell's vectors, so neither side goes to the driver.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import Change, Store, materialize

#: Rows that centres are trained on, at most; all rows are indexed.
SAMPLE = 100_000
#: Rows that are asked for when the number of probes is set, their neighbours, and the part of those that must be found.
ASKED, NEAR, RECALL = 256, 10, 0.97
#: Candidates that a cell gives a query, as a multiple of k.
OVERFETCH = 3
#: Vectors of a cell, and queries, that meet at once.
CELL_ROWS, QUERY_ROWS = 4096, 1024


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), float) if len(column) else np.zeros((0, 1))


def train_centres(vectors: DataFrame, cells: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centres by spherical k-means over at most SAMPLE of vectors(id, embedding), the ones with the least hashes of their ids; fewer rows than cells give as many centres as there are rows."""
    chosen = vectors.where("embedding is not null").orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), "id").limit(SAMPLE).select("embedding")
    rows = _unit(_matrix(chosen.toPandas()["embedding"]))
    rows = np.unique(rows, axis=0)
    if len(rows) <= cells:
        return rows
    centres = rows[np.random.default_rng(seed).choice(len(rows), cells, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(rows[i : i + 8192] @ centres.T, axis=1) for i in range(0, len(rows), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        some = np.linalg.norm(sums, axis=1) > 0
        centres[some] = _unit(sums[some])
    return centres


def _cells(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for frame in frames:
            yield frame.assign(cell=np.argmax(_unit(_matrix(frame["embedding"])) @ centres.T, axis=1).astype(np.int32) if len(frame) else [])

    return run


def _probes(shared, n: int):
    """Rows (query_id, embedding, cell): each query once for each of its n nearest cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for frame in frames:
            sims = _unit(_matrix(frame["embedding"])) @ centres.T
            some = min(n, len(centres))
            near = np.argpartition(-sims, some - 1, axis=1)[:, :some]
            yield frame.loc[frame.index.repeat(some)].assign(cell=near.ravel().astype(np.int32))

    return run


def _cell_ranks(shared):
    """Rows (place): which of a query's nearest cells, from 0, the cell of its neighbour is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for frame in frames:
            sims = _unit(_matrix(frame["embedding"])) @ centres.T if len(frame) else np.zeros((0, 1))
            own = sims[np.arange(len(frame)), frame["cell"].to_numpy(int)]
            yield pd.DataFrame({"place": (sims > own[:, None]).sum(axis=1)})

    return run


def _best(k: int):
    """Of one block of a cell and one block of queries the k most similar vectors of each query."""

    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        sims = _unit(_matrix(queries["embedding"])) @ _unit(_matrix(vectors["embedding"])).T
        some = min(k, sims.shape[1])
        edge = -np.partition(-sims, some - 1, axis=1)[:, some - 1]
        # all that equal the last of the k stay, so that ties are settled by id later
        at, of = np.nonzero(sims >= edge[:, None])
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[at], "id": vectors["id"].to_numpy()[of], "similarity": sims[at, of]})

    return run


class VectorIndex:
    """An index of vectors(id, embedding) in a store: `{name}_centres`, `{name}_cells` bucketed by cell, `{name}_deleted`."""

    def __init__(self, store: Store, name: str = "ivf"):
        self.store, self.spark, self.name = store, store.spark, name

    def _centres(self, change: Change | None = None) -> np.ndarray:
        rows = (change or self.store).read(f"{self.name}_centres").orderBy("cell").toPandas()
        return _matrix(rows["embedding"])

    def _placed(self, vectors: DataFrame, centres: np.ndarray) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(centres)
        kind = dict(vectors.dtypes)
        return vectors.where("embedding is not null").select("id", "embedding").mapInPandas(_cells(shared), f"id {kind['id']}, embedding {kind['embedding']}, cell int")

    @contextlib.contextmanager
    def _change(self, change: Change | None) -> Iterator[Change]:
        """A change of its own, published at the end, or one that its owner publishes."""
        mine = change or self.store.change()
        yield mine
        if change is None:
            mine.publish()

    def build(self, vectors: DataFrame, cells: int | None = None, change: Change | None = None) -> int:
        """Index all of vectors(id, embedding) anew; cells: about the root of their number by default, 4096 at most. Returns the number of cells. Rows with null embeddings aren't found. change: a change to write in, here and below."""
        if cells is None:
            cells = min(4096, max(1, round(math.sqrt(vectors.count()))))
        centres = train_centres(vectors, cells)
        with self._change(change) as change:
            change.put(f"{self.name}_centres", self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, embedding array<double>"))
            change.state.pop(f"{self.name}_cells", None)
            change.merge(f"{self.name}_cells", self._placed(vectors, centres) if len(centres) else vectors.select("id", "embedding", F.lit(0).alias("cell")).limit(0), "cell")
            change.put(f"{self.name}_deleted", vectors.select("id").limit(0))
            probes = self._probes_for(vectors, change.read(f"{self.name}_cells"), centres)
            change.put(f"{self.name}_probes", self.spark.createDataFrame([(probes,)], "probes int"))
        return len(centres)

    def _probes_for(self, vectors: DataFrame, cells: DataFrame, centres: np.ndarray) -> int:
        """The least number of cells that hold RECALL of the exact NEAR neighbours of ASKED of the vectors."""
        known = vectors.where("embedding is not null").select("id", "embedding")
        asked = materialize(known.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(2)), "id").limit(ASKED).select(F.col("id").alias("query_id"), "embedding"))
        near = exact(known, asked, NEAR).select("query_id", "id").join(cells.select("id", "cell"), "id").join(F.broadcast(asked), "query_id")  # ASKED rows
        shared = self.spark.sparkContext.broadcast(centres)
        places = sorted(r.place for r in near.select("embedding", "cell").mapInPandas(_cell_ranks(shared), "place long").collect())  # ASKED * NEAR numbers
        return places[math.ceil(RECALL * len(places)) - 1] + 1 if places else 1

    def add(self, vectors: DataFrame, change: Change | None = None) -> None:
        """Put vectors in, in place of those of the same ids; only the cells that they lie in are written. The centres stay."""
        with self._change(change) as change:
            name, centres = f"{self.name}_cells", self._centres(change)
            if not len(centres):
                self.build(vectors, change=change)
                return
            new = materialize(self._placed(vectors, centres))
            old = change.read(name).join(new.select("id"), "id", "left_semi").select("id", "cell")
            change.merge(name, new, "cell", materialize(old))
            deleted = change.read(f"{self.name}_deleted")
            change.put(f"{self.name}_deleted", materialize(deleted.join(new.select("id"), "id", "left_anti")))

    def delete(self, ids: DataFrame, change: Change | None = None) -> None:
        """Mark ids(id) as deleted; compact() takes them out."""
        with self._change(change) as change:
            change.put(f"{self.name}_deleted", materialize(change.read(f"{self.name}_deleted").union(ids.select("id")).distinct()))

    def compact(self, change: Change | None = None) -> None:
        with self._change(change) as change:
            name, deleted = f"{self.name}_cells", change.read(f"{self.name}_deleted")
            change.merge(name, change.read(name).limit(0), "cell", materialize(change.read(name).join(deleted, "id", "left_semi").select("id", "cell")))
            change.put(f"{self.name}_deleted", materialize(deleted.limit(0)))

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, similarity, rank): the k vectors of the probed cells most similar by cosine to each of queries(query_id, embedding); equal ones by id. Fewer than k if the cells have no more. probes: the number that build() found, by default."""
        centres = self._centres()
        qid, kind = dict(queries.dtypes)["query_id"], dict(queries.dtypes)["embedding"]
        schema = f"query_id {qid}, id {dict(self.store.read(f'{self.name}_cells').dtypes)['id']}, similarity double"
        if not len(centres):
            return self.spark.createDataFrame([], f"{schema}, rank int")
        probes = probes or self.store.read(f"{self.name}_probes").first().probes
        shared = self.spark.sparkContext.broadcast(centres)
        asked = queries.where("embedding is not null").select("query_id", "embedding").mapInPandas(_probes(shared, probes), f"query_id {qid}, embedding {kind}, cell int")
        return _ranked(self._blocks(asked, OVERFETCH * k, schema), k)

    def _blocks(self, asked: DataFrame, most: int, schema: str) -> DataFrame:
        """Candidates of cells and probes(query_id, embedding, cell), both cut in blocks, so that no cell and no set of queries is in one task."""
        asked = materialize(asked)
        cells = self.store.read(f"{self.name}_cells").join(self.store.read(f"{self.name}_deleted"), "id", "left_anti")
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).join(asked.groupBy("cell").agg(F.count("*").alias("q")), "cell")
        sizes = F.broadcast(materialize(sizes.select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("vb"), F.ceil(F.col("q") / QUERY_ROWS).cast("int").alias("qb"))))  # a row for each cell
        part = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("string")), F.col(n)).cast("int")
        left = cells.join(sizes, "cell").select("id", "embedding", "cell", part("id", "vb").alias("v"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"))
        right = asked.join(sizes, "cell").select("query_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("v"), part("query_id", "qb").alias("q"))
        return left.groupBy("cell", "v", "q").cogroup(right.groupBy("cell", "v", "q")).applyInPandas(_best(most), schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """search() over all vectors: blocks of vectors and of queries meet as rows of a join of block numbers, in which no side is whole anywhere."""
    n, q = vectors.count(), queries.count()
    vb, qb = max(1, -(-n // CELL_ROWS)), max(1, -(-q // QUERY_ROWS))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(vectors.dtypes)['id']}, similarity double"
    part = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(n)).cast("int")
    left = vectors.where("embedding is not null").select("id", "embedding", part("id", vb).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"))
    right = queries.where("embedding is not null").select("query_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(vb - 1))).alias("v"), part("query_id", qb).alias("q"))
    return _ranked(left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInPandas(_best(k), schema), k)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: queries, wanted pairs, and the part of wanted(query_id, id) that is in found."""
    hit = wanted.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), (F.count("hit") / F.count("*")).alias("recall"))
