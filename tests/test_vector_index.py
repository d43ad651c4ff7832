"""The inverted file against brute force."""

import numpy as np

from graphloom.operators import vector_index as vi
from graphloom.operators import vectors
from graphloom.plans.engine import Config, Engine, QueryParam
from graphloom.sources.store import Store


def table(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in rows], "id long, embedding array<float>").repartition(3)


def brute(rows, queries, k):
    unit = lambda v: np.array(v, float) / max(np.linalg.norm(v), 1e-12)
    known = [(i, unit(v)) for i, v in rows if v is not None]
    return {q: sorted(known, key=lambda x: (-round(float(x[1] @ unit(v)), 9), x[0]))[:k] for q, v in queries}


def test_search_add_delete(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "CELL_ROWS", 40)
    monkeypatch.setattr(vi, "QUERY_ROWS", 16)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16)) * 4
    rows = [(i, np.float32(middles[i % 12] + rng.normal(size=16))) for i in range(600)] + [(1000, None), (1001, np.zeros(16))]
    rows += [(2000 + i, rows[0][1]) for i in range(5)]  # equal ones
    v = table(spark, rows)
    asked = [(i, r) for i, r in rows[:60]]
    queries = table(spark, asked).withColumnRenamed("id", "query_id")
    want = {(q, i) for q, near in brute(rows, asked, 5).items() for i, _ in near}
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    assert pairs(vectors.top_k_each(v, queries, 5)) == want
    index = vi.VectorIndex(Store(spark, str(tmp_path / "s"), buckets=8))
    cells = index.build(v)
    assert pairs(index.search(queries, 5, cells)) == want
    assert index.store.read("ivf_probes").first().probes < cells / 2
    assert len(pairs(index.search(queries, 5)) & want) >= 0.9 * len(want)
    # ranks, no deleted rows
    index.delete(v.where("id % 2 = 0"))
    odd = {(q, i) for q, near in brute([r for r in rows if r[0] % 2], asked, 5).items() for i, _ in near}
    assert pairs(index.search(queries, 5, cells)) == odd
    index.compact()
    assert index.store.read("ivf_cells").where("id % 2 = 0").count() == 0 and index.store.read("ivf_deleted").count() == 0
    before = index.store.state()["ivf_cells"]["files"]
    index.add(table(spark, [(0, rows[1][1]), (1, rows[1][1])]))
    after = index.store.state()["ivf_cells"]["files"]
    assert sum(before.get(k) != after.get(k) for k in after) <= 3
    now = [(0, rows[1][1])] + [r for r in rows if r[0] % 2]
    assert pairs(index.search(queries, 5, cells)) == {(q, i) for q, near in brute(now, asked, 5).items() for i, _ in near}
    assert {r.rank for r in index.search(queries, 2, cells).collect()} == {1, 2}


def test_empty_and_tiny_tables(spark, tmp_path):
    index = vi.VectorIndex(Store(spark, str(tmp_path / "s"), buckets=2))
    assert index.build(table(spark, [])) == 0
    queries = table(spark, [(1, [1.0, 0.0])]).withColumnRenamed("id", "query_id")
    assert index.search(queries, 3).count() == 0
    index.build(table(spark, [(7, [1.0, 1.0]), (8, [1.0, 1.0])]))
    assert [(r.id, r["rank"]) for r in index.search(queries, 3).orderBy("rank").collect()] == [(7, 1), (8, 2)]
    assert index.search(queries.limit(0), 3).count() == 0
    found = vi.recall(index.search(queries, 3), vi.exact(table(spark, [(7, [1.0, 1.0]), (9, [0.0, 1.0])]), queries, 2)).first()
    assert (found.queries, found.wanted, found.recall) == (1, 2, 0.5)


def test_an_engine_keeps_its_indexes(spark, tmp_path):
    config = Config(buckets=2, enable_communities=False, vector_index=True)
    engine = Engine(spark, str(tmp_path / "e"), config)
    docs = lambda rows: spark.createDataFrame(rows, "doc_id string, content string")
    engine.insert_documents(docs([("1", "Alice met Bob."), ("2", "Carol slept.")]))
    engine.insert_documents(docs([("1", "Alice met Dora.")]))
    for name in ("chunk_vectors", "entity_vectors"):
        cells, gone = (engine.store.read(f"{name}_index_{part}") for part in ("cells", "deleted"))
        assert {r.id for r in cells.join(gone, "id", "left_anti").collect()} == {r.id for r in engine.store.read(name).collect()}
    assert "Dora" in engine.query("Dora", QueryParam(mode="naive", only_need_context=True))
