"""Graph steps and mentions on larger tables: what a task holds and what moves doesn't grow faster than the tables."""

import random
import re

import pytest
from graphloom.operators import graph, registry
from graphloom.plans import catalog
from graphloom.plans import fixtures as X
from pyspark.sql import functions as F
from test_larger_tables import DATA, plan, same_as_sql


def test_few_names_are_compared_where_texts_are_read(spark):
    df = catalog.QUERIES["entity_mentions"](spark, DATA)
    assert "Generate" not in plan(df) and "strategy=broadcast" in plan(df)
    assert same_as_sql(spark, "entity_mentions")


@pytest.mark.parametrize("few", [0, 64])
def test_mentions_write_only_triples_of_names(spark, monkeypatch, few):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abÉ ") for _ in range(n))
    texts = [(k, word(draw.randrange(0, 60))) for k in range(60)] + [(60, None), (60, "ABBA"), (61, "xyz" * 50)]
    names = [(f"e{k}", word(draw.randrange(1, 7)), [word(4), ""]) for k in range(15)] + [("e15", None, ["x"])]
    written, kept = [], registry.materialize
    monkeypatch.setattr(registry, "FEW_NAMES", few)
    monkeypatch.setattr(registry, "materialize", lambda df: written.append(kept(df)) or written[-1])
    found = registry.mentions(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(names, "entity_id string, canonical_name string, aliases array<string>")).collect()
    spelled = {(e, n.lower()) for e, c, more in names for n in [c, *more] if n}
    want = {(k, e) for k, t in texts if t for e, n in spelled if n in t.lower()}
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    triples = {n[i : i + 3] for _, n in spelled for i in range(len(n) - 2)}
    for df in written:
        if "text_id" in df.columns:
            assert {r.gram for r in df.collect()} <= triples


def test_edges_are_summed_in_as_many_tasks_as_lines_need(spark, monkeypatch):
    monkeypatch.setattr(X, "PART_LINES", 100, raising=False)
    lines = X.read(spark, DATA, "lineitem").count()
    assert f"RepartitionByExpression [l_partkey#0], {-(-lines // 100)}" in re.sub(r"#\d+L?", "#0", plan(X.edges(spark, DATA)))
    assert "count(" not in plan(X.nodes(spark, DATA))
    assert all(same_as_sql(spark, name) for name in ("node_degree", "singleton_clusters"))


def test_nodes_of_missing_keys(spark, tmp_path):
    spark.createDataFrame([(1, 2, None), (2, None, 3), (3, 2, 2), (4, 2, 2)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2, 1), (5, None)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    found = [r.id for r in X.nodes(spark, str(tmp_path)).collect()]
    assert sorted(map(str, found)) == ["N1", "None", "P2", "S2", "S3", "S5"]


def brute_components(nodes, edges):
    label = {x: x for x in [*nodes, *[x for e in edges for x in e]]}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {x: label[x] for x in nodes}


@pytest.mark.parametrize("seeds", [1, 2])
def test_components_move_numbers(spark, monkeypatch, seeds):
    draw = random.Random(seeds)
    pairs = [(f"n{draw.randrange(150)}", f"n{draw.randrange(150)}") for _ in range(110)] + [(f"p{k}", f"p{k + 1}") for k in range(70)] + [("hub", f"h{k}") for k in range(50)] + [("x", "x"), ("a only end", "n3")]
    nodes = sorted({x for p in pairs for x in p if x != "a only end"}) + ["lonely"]
    moved, kept, code = [], graph.materialize, graph._code
    monkeypatch.setattr(graph, "PART_ROWS", 40)
    monkeypatch.setattr(graph, "materialize", lambda df: moved.append(dict(df.dtypes)) or kept(df))
    if seeds == 2:  # the first codes of some ids are equal
        monkeypatch.setattr(graph, "_code", lambda c, seed: code(c, seed) if seed else F.pmod(code(c, 0), F.lit(50)))
    edges = spark.createDataFrame(pairs + pairs[:20], "src string, dst string")
    found = graph.components(spark.createDataFrame([(x,) for x in nodes] + [(None,)], "id string"), edges).collect()
    want = {**brute_components(nodes, pairs), None: None}
    assert len(found) == len(want) and {r.id: r.component for r in found} == want
    links = [m for m in moved if set(m) in ({"a", "b"}, {"a", "m"})]
    assert links and all(set(m.values()) == {"bigint"} for m in links)


def test_merged_edges_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(X, "PART_LINES", 100)
    lines = X.read(spark, DATA, "lineitem").count()
    assert f"RepartitionByExpression [src#0, dst#0], {-(-lines // 100) * 2}" in re.sub(r"#\d+L?", "#0", plan(catalog.QUERIES["edge_merge_existing"](spark, DATA)))
    assert same_as_sql(spark, "edge_merge_existing_all")


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_ranks_move_numbers(spark, monkeypatch, few):
    draw = random.Random(9)
    weights = {tuple(sorted((f"n{draw.randrange(30)}", f"n{draw.randrange(30)}"))): float(draw.randrange(0, 4)) for _ in range(60)}
    nodes, seeds, written, kept = [f"n{k}" for k in range(30)] + ["lonely"], ["n1", "lonely", "gone"], [], graph.materialize
    monkeypatch.setattr(graph, "BROADCAST_RANKS", few, raising=False)
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(df.dtypes) or kept(df))
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src string, dst string, weight double")
    table = lambda ids: spark.createDataFrame([(x,) for x in ids], "id string")
    found = {r.id: r["rank"] for r in graph.pagerank(table(nodes), edges, table(seeds), iterations=7).collect()}
    around = {x: {} for x in nodes}
    for (a, b), w in weights.items():
        if w:
            around[a][b] = around[b][a] = w
    seed = {x: (x in seeds) / 2 for x in nodes}
    rank = dict(seed)
    for _ in range(7):
        loose = sum(rank[x] for x in nodes if not around[x])
        got = {x: sum(rank[y] * w / sum(around[y].values()) for y, w in around[x].items()) for x in nodes}
        rank = {x: 0.85 * (got[x] + loose * seed[x]) + 0.15 * seed[x] for x in nodes}
    assert found == pytest.approx(rank, abs=1e-12)
    assert all(dict(t).get("id") is None or "other" not in dict(t) for t in written)  # no table of moves by text
    assert sum({"rank", "old"} <= set(dict(t)) and "id" not in dict(t) for t in written) == 7


def test_ppr_is_its_sql(spark):
    assert same_as_sql(spark, "ppr_fixed_iterations_all")


def test_communities_count_edges_without_a_row_for_each(spark):
    df = catalog.QUERIES["community_schema"](spark, DATA)
    assert not re.search(r"Aggregate \[level[^]]*, src", plan(df))
    assert same_as_sql(spark, "community_schema") and same_as_sql(spark, "modularity")


def test_counts_of_overlapping_communities(spark):
    draw = random.Random(4)
    members = sorted({(f"n{draw.randrange(20)}", draw.randrange(2), f"c{draw.randrange(4)}") for _ in range(60)})
    edges = [(f"n{draw.randrange(24)}", f"n{draw.randrange(24)}") for _ in range(70)] + [("n1", "n1"), ("n1", None), (None, "n2"), ("n2", "n3"), ("n3", "n2")]
    chunks = [(f"n{draw.randrange(24)}", f"k{draw.randrange(30)}") for _ in range(80)]
    found = graph.community_counts(*(spark.createDataFrame(rows, t) for rows, t in ((members, "id string, level int, cluster string"), (edges, "src string, dst string"), (chunks, "id string, chunk_id string")))).collect()
    want = {}
    for level, cluster in {m[1:] for m in members}:
        own = {m[0] for m in members if m[1:] == (level, cluster)}
        around = {tuple(sorted((a, b or a))) for a, b in edges if a and (a in own or b in own)}
        want[level, cluster] = (len(own), len(around), len({k for x, k in chunks if x in own}))
    most = max(n for _, _, n in want.values())
    assert {(r.level, r.cluster): (r.nodes, r.edges, r.chunks) for r in found} == want
    assert all(abs(r.occurrence - r.chunks / most) < 1e-12 for r in found)
