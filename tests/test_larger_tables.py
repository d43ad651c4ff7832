"""Steps whose memory, pairs or rounds grew faster than their tables."""

import os

import duckdb
import pytest
from graphloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def same_as_sql(spark, name, folder=DATA):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    df = catalog.QUERIES[name](spark, folder)
    rel = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({catalog.SQL[name]})")
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(key, (tuple(r) for r in df.collect()))) == sorted(map(key, rel.fetchall()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["community_schema", "community_schema_all"])
def test_community_schema_holds_no_lists(spark, name):
    assert "collect_" not in plan(catalog.QUERIES[name](spark, DATA))
    assert same_as_sql(spark, name)


def test_manifest_compares_only_what_has_no_exact_match(spark, monkeypatch):
    from graphloom.operators import registry

    asked = []
    kept = registry.fuzzy_pairs
    monkeypatch.setattr(registry, "fuzzy_pairs", lambda q, *more: asked.append({r.query_id for r in q.collect()}) or kept(q, *more))
    reg = spark.createDataFrame([(f"e{k}", f"Supplier#{k:06d}", "X", [], k) for k in range(30)], "entity_id string, canonical_name string, entity_type string, aliases array<string>, reg_order long")
    m = spark.createDataFrame([(f"m{k}", f"SUPPLIER#{k:06d}", "X") for k in range(30)] + [("odd", "Sopplier#000007", "X")], "entity_id string, entity_name string, entity_type string")
    links = {r.entity_id: r.linked_id for r in registry.link_manifest(m, reg, 0.92).collect()}
    assert links == {f"m{k}": f"e{k}" for k in range(30)} | {"odd": "e7"}
    fuzzy = {r.query_id: r.entity_id for r in registry.resolve_fuzzy(m.select(m.entity_id.alias("query_id"), m.entity_name.alias("name"), "entity_type"), reg, 0.92).collect()}
    assert fuzzy == links and asked == [{"odd"}, {"odd"}]


def test_nested_communities_of_larger_nations(spark, tmp_path):
    for f in ("nation", "customer"):
        df = spark.read.parquet(f"{DATA}/{f}.parquet")
        if f == "customer":
            n = df.count()
            df = df.selectExpr("c_custkey", "c_nationkey", "explode(sequence(0, 99)) k").selectExpr(f"c_custkey + {n} * k c_custkey", "c_nationkey")
        df.write.parquet(f"{tmp_path}/{f}.parquet")
    con = duckdb.connect()
    for f in ("nation", "customer"):
        con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{tmp_path}/{f}.parquet/*.parquet'")
    want = set(con.sql(f"SELECT id, level, cluster, parent FROM ({catalog.SQL['nested_communities']})").fetchall())
    found = catalog.QUERIES["nested_communities"](spark, str(tmp_path)).select("id", "level", "cluster", "parent").collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_node2vec_trains_in_several_tasks(spark, monkeypatch):
    from graphloom.operators import graph
    from pyspark.ml import feature

    parts, kept = [], feature.Word2Vec.fit
    monkeypatch.setattr(graph, "WALKS", 10, raising=False)
    monkeypatch.setattr(feature.Word2Vec, "fit", lambda self, df: parts.append(self.getNumPartitions()) or kept(self, df))
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 1.0) for k in range(19)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(20)], "id string")
    found = graph.node2vec(nodes, edges, dims=4, n=2, length=3).collect()
    assert {r.id for r in found} == {f"n{k}" for k in range(20)} and all(len(r.embedding) == 4 for r in found)
    assert parts == [4]
