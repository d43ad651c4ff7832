"""Rows that only larger tables have, and steps whose memory or disk grew faster than their tables."""

import duckdb
import pytest
from graphloom.llm import source_mix
from graphloom.operators import clustering, graph
from graphloom.plans.catalog import QUERIES
from test_larger_tables import DATA, same_as_sql


def test_delta_status_of_odd_rows(spark, tmp_path):
    """Null, blank and padded texts, ids that are null or repeat: a row each, hashed as it is."""
    texts = ["NULL", "''", "'  '", "' a'", "'a' || chr(10)", "'a'", "'a changed'", "'b' || chr(160)"]
    ids = ["NULL", *map(str, (0, 1, 10, 13, 17, 26, 130, -10))]
    rows = ", ".join(f"({i}, {t})" for i in ids for t in texts + ["'a'"])
    duckdb.sql(f"COPY (SELECT CAST(i AS BIGINT) AS doc_id, CAST(t AS VARCHAR) AS text FROM (VALUES {rows}) v(i, t)) TO '{tmp_path}/documents.parquet'")
    assert same_as_sql(spark, "delta_status", str(tmp_path))


def test_slots_of_a_mix_are_not_broadcast(spark):
    """Slots are many more than the draws that Spark knows the size of: they meet blocks in a shuffle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (source_mix.taken(docs), source_mix.mixed_texts(docs)):
        assert len(df.collect()) >= 1000
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        joins = [line for line in final.splitlines() if "Join" in line]
        assert any("SortMergeJoin" in j and "block#" in j for j in joins)
        assert not any("BroadcastHashJoin" in j and ("block#" in j or "unit#" in j) for j in joins)


@pytest.mark.parametrize("name", ["rel_combine", "contribution_index"])
def test_facts_move_as_numbers(spark, name):
    """No text goes through a shuffle: names, keys and chunk ids are made where a key's rows have met."""
    df = QUERIES[name](spark, DATA)
    kinds, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "RepartitionByExpression":
            kinds.append(node.schema().catalogString())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert len(kinds) >= 2 and not any("string" in k for k in kinds)
    assert same_as_sql(spark, name)


def test_rounds_of_moves_leave_links_where_they_are(spark, monkeypatch):
    """A round sums up communities; the links, dealt once, are not dealt again."""
    plans, kept = [], clustering.materialize
    monkeypatch.setattr(clustering, "materialize", lambda df: ("goes" in df.columns and plans.append(df._jdf.queryExecution().executedPlan().toString())) or kept(df))
    pairs = [(x + 6 * g, y + 6 * g) for g in range(2) for x in range(6) for y in range(x)] + [(0, 6)]
    links = spark.createDataFrame([(0, a, b, 1.0, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))], "layer int, a long, b long, weight double, gamma double")
    start = spark.range(12).selectExpr("0 layer", "id", "id community")
    found, moved = clustering._moves(kept(links), kept(start), 1, 8)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert moved and sorted(map(sorted, groups.values())) == [[*range(6)], [*range(6, 12)]]
    dealt = [line for p in plans for line in p.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY" not in line]
    assert plans and len(dealt) <= len(plans)


def test_steps_of_walks_move_walkers_alone(spark, monkeypatch):
    """The table of steps is dealt once, not at each step; a walker carries no more than its last nodes."""
    plans, kept = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: ("path" in df.columns and plans.append(df._jdf.queryExecution().executedPlan().toString())) or kept(df))
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        edges = spark.createDataFrame([(f"n{k}", f"n{(k + 1) % 20}", 1.0) for k in range(20)], "src string, dst string, weight double")
        nodes = spark.createDataFrame([(f"n{k}",) for k in range(20)] + [("lonely",)], "id string")
        found = {r.walk: r.path for r in graph.walks(nodes, edges, 2, 12).collect()}
    finally:
        spark.conf.set(name, before)
    assert set(found) == {f"{i}/{k}" for i in [*(f"n{k}" for k in range(20)), "lonely"] for k in (1, 2)}
    assert all(len(p) == 12 and all((int(a[1:]) - int(b[1:])) % 20 in (1, 19) for a, b in zip(p, p[1:], strict=False)) for w, p in found.items() if w[0] == "n")
    assert found["lonely/1"] == found["lonely/2"] == ["lonely"]
    assert len(plans) == 2 and "Exchange hashpartitioning(at#" in plans[0] and not any("Exchange hashpartitioning(__at#" in p for p in plans)


def test_node2vec_has_all_dimensions(spark, tmp_path):
    """The registered query trains vectors as long as the operator's own, those of the reference."""
    spark.range(6).selectExpr("id l_orderkey", "id l_partkey", "id % 2 l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(2).selectExpr("id s_suppkey", "id % 2 s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    found = QUERIES["node2vec"](spark, str(tmp_path)).collect()
    assert {r.id for r in found} == {*(f"P{i}" for i in range(6)), "S0", "S1", "N0", "N1"}
    assert all(r.dims == 1536 and r.norm > 0 for r in found)
