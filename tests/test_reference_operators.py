import pytest
from pyspark.sql import functions as F

from graphloom.functions import budget
from graphloom.functions import text as T
from graphloom.operators import chunking, clustering, extraction, graph, merge, registry, tables, vectors
from graphloom.plans import evaluation, retrieval
from graphloom.plans.engine import FAIL, Config, Engine, QueryParam
from graphloom.sources.store import Store, import_json, materialize


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_splitter_goldens():
    split = lambda text, seps, size, overlap: chunking.separator_pieces(text, seps, size, overlap)
    assert split("1234567890", [], 5, 2) == ["12345", "45678", "7890"]
    assert split("1234567890", [], 5, 0) == ["12345", "67890"]
    assert split("One is here. Two is there.", [".", "\n"], 16, 0) == ["One is here.", " Two is there."]
    # groups over the size stay whole beside others, and the first separator of the list that fits counts
    assert split("a.bbbbbbbb.c", ["."], 4, 0) == ["a.", "bbbbbbbb.", "c"] and split("a.bbbbbbbb.c", ["."], 4, 1) == ["a.", ".bbb", ".c"]
    assert [("a\n\nb"[x:y]) for x, y in chunking.spans("a\n\nb", ["\n", "\n\n"])] == ["a\n", "\n", "b"]
    assert [("a--b"[x:y]) for k in ("start", "") for x, y in chunking.spans("a--b", ["--"], k)] == ["a", "--b", "a", "b"]
    with pytest.raises(ValueError):
        chunking.token_windows(None, 5, 5)


def test_json_goldens():
    assert T.response_json('Well: {"a": 1, "b": {"c": "x"}} done') == {"a": 1, "b": {"c": "x"}}
    assert T.response_json("{a: {b: yes}, c: 2") == {"a": {"b": "yes"}, "c": 2}
    assert T.response_json('{a: null, b: TRUE, c: true, d: None, e: 1.5, f: "x"') == {"a": None, "b": "TRUE", "c": True, "d": "None", "e": 1.5, "f": "x"}
    assert T.response_json('{"name": "Ann", "n": 1.5, "ok": true')["n"] == 1.5
    assert T.response_json("nothing") == {}


def test_names_and_ids(spark):
    r = one(spark, n=T.registry_name(F.lit("  Dr. Prof  Jane   Doe\t")), e=T.entity_id(F.lit(" Ann ")), e2=T.entity_id(F.lit("ANN")), r1=T.relationship_id(F.lit("a"), F.lit("b"), F.lit("X")), r2=T.relationship_id(F.lit("b"), F.lit("a"), F.lit(" x")), t=T.entity_type(F.lit(" ")), c=T.clean(F.lit(" a&amp;\x07b\n"), True))
    assert (r.n, r.t, r.c) == ("jane doe", '"UNKNOWN"', "a&b") and r.e == r.e2 and r.r1 == r.r2


def test_budget_and_bins(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate((3, 3, 9, 1))], "g string, i int, n int")
    assert [r.i for r in budget.within_budget(df, "n", 8, ["i"], ["g"]).orderBy("i").collect()] == [0, 1]
    assert budget.within_budget(df, "n", 0, ["i"], ["g"]).count() == 0
    assert [r.bin for r in budget.greedy_bins(df, "i", "n", 8, ["i"], ["g"]).orderBy("i").collect()] == [0, 0, 1, 2]


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    rows = spark.createDataFrame([(2, None, "z"), (3, "c", "q")], "k int, v string, w string")
    assert sorted(tables.upsert(t, rows, "k", merge=True).collect()) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "q")]
    assert tables.upsert(t, rows, "k").where("k = 2").first().v is None
    got = tables.multi_get(t, spark.createDataFrame([(0, 2), (1, 9)], "pos int, k int"), "k", ["v"]).orderBy("pos").collect()
    assert [r.v for r in got] == ["b", None]


def test_extraction_and_merge(spark):
    out = '("entity"<|>Ann<|>person<|>writes)##("relationship"<|>Ann<|>Bob<|>knows<|>2.5)##("relationship"<|>Bob<|>Cy<|>met<|>x)##("entity"<|>short)<|COMPLETE|>'
    e, r = extraction.parse_records(spark.createDataFrame([("d", "c", out)], "doc_id string, chunk_id string, output string"))
    assert sorted((x.entity_name, x.entity_type, x.implicit) for x in e.collect()) == [("ANN", "PERSON", False), ("BOB", '"UNKNOWN"', True), ("CY", '"UNKNOWN"', True)]
    assert sorted((x.src, x.tgt, x.weight) for x in r.collect()) == [("ANN", "BOB", 2.5), ("BOB", "CY", 1.0)]

    def fragile(prompts):
        if len(prompts) > 1 or "bad" in prompts[0]:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    told = extraction.call_model(spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "i int, p string"), F.col("p"), fragile)
    assert {x.i: (x.output, x.error) for x in told.collect()} == {1: ("A", None), 2: (None, "no"), 3: ("C", None)}
    facts = spark.createDataFrame([(1, "x", "B"), (2, "x", "A"), (3, "x", "A"), (4, "x", "B")], "doc int, e string, v string")
    assert merge.modal(facts, "e", "v", ["doc"]).first().v == "B"


def test_extraction_reads_whole_texts(spark, tmp_path):
    """Names after the first 400 characters, after the eighth of a chunk and in the last token window."""
    from graphloom.plans.q_graph import model_extraction

    text = " ".join(["plain"] * 100 + [f"Name{i}" for i in range(20)] + ["plain"] * 3000 + ["Last"])
    spark.createDataFrame([(1, text), (2, "Alice met Bob."), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.entity_name) for r in model_extraction(spark, str(tmp_path)).collect()}
    assert found == {*((1, f"NAME{i}") for i in range(20)), (1, "LAST"), (2, "ALICE"), (2, "BOB")}


def test_registry(spark):
    reg = spark.createDataFrame([("e1", "Charles Dickens", "PERSON", ["Boz"], {}, 1), ("e2", "Charles Dickins", "PERSON", [], {}, 2), ("e3", "Of", "X", [], {}, 3)], "entity_id string, canonical_name string, entity_type string, aliases array<string>, metadata map<string,string>, reg_order int")
    q = spark.createDataFrame([("a", "mr charles dickens", "PERSON"), ("b", "boz", ""), ("c", "Charles Dickenz", "PERSON"), ("d", "nobody at all", "")], "query_id string, name string, entity_type string")
    assert {r.query_id: r.entity_id for r in registry.resolve_fuzzy(q, reg, 0.85).collect()} == {"a": "e1", "b": "e1", "c": "e1", "d": None}
    assert {r.entity_id for r in registry.candidates(q.where("query_id = 'c'"), reg, 0.85, 3).collect()} == {"e1", "e2"}
    texts = spark.createDataFrame([(1, "novels of CHARLES DICKENS"), (2, "boz"), (3, "")], "text_id int, text string")
    assert sorted(tuple(r) for r in registry.mentions(texts, reg).collect()) == [(1, "e1"), (1, "e3"), (2, "e1")]


def graph_of(spark, pairs):
    e = spark.createDataFrame([(min(p), max(p), 1.0) for p in pairs], "src string, dst string, weight double")
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e


def test_graph_goldens(spark):
    n, e = graph_of(spark, ["AB", "AC", "AD", "AA"])
    assert {r.id: r.degree for r in graph.degrees(n.union(spark.createDataFrame([("Z",)], "id string")), e).collect()} == {"A": 5, "B": 1, "C": 1, "D": 1, "Z": 0}
    n, e = graph_of(spark, ["AB", "CD", "EF"])
    assert sorted(r.id for r in graph.largest_component(n, e).collect()) == ["A", "B"]
    got = graph.edge_confidence(spark.createDataFrame([("0.9", "5"), (None, None)], "confidence string, occurrence_count string")).collect()
    assert [round(r.score, 9) for r in got] == [0.78, 0.73]
    n, e = graph_of(spark, ["AB", "BC", "AC", "CD", "DE", "EF", "DF"])
    ranks = {r.id: r.rank for r in graph.pagerank(n, e, n.where("id = 'A'"), iterations=50, tolerance=1e-9).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["A"] > ranks["F"]


def test_clusters(spark):
    n, e = graph_of(spark, ["AB", "BC", "AC", "CD", "DE", "EF", "DF"])
    found = clustering.leiden(n, e, (1.0,)).collect()
    assert sorted(found) == sorted(clustering.leiden(n, e, (1.0,)).collect())
    by = {}
    for r in found:
        by.setdefault(r.cluster, set()).add(r.id)
    assert sorted(map(sorted, by.values())) == [["A", "B", "C"], ["D", "E", "F"]] and set(by) == {"l0_c0", "l0_c1"}
    m = clustering.leiden(n, e, (1.0,))
    inc = clustering.incremental_leiden(n, e, m, n.where("id = 'A'"), 3)
    rows = {r.id: r.cluster for r in inc.collect()}
    assert rows["A"].startswith("inc-3-l0-") and rows["F"].startswith("l0_") and len(rows) == 6
    single = graph.singleton_clusters(n).collect()
    assert {r.id: r.cluster for r in single} == {c: f"singleton-{i}" for i, c in enumerate("ABCDEF")}


def test_clusters_of_planted_groups(spark):
    """Eight dense groups with a few links between them: modularity near that of the groups, at each resolution; connected clusters."""
    import random

    rng = random.Random(6)
    pairs = {(f"g{i // 12}n{i}", f"g{j // 12}n{j}") for i in range(96) for j in range(i) if rng.random() < (0.6 if i // 12 == j // 12 else 0.01)}
    e = spark.createDataFrame([(min(p), max(p), 1.0) for p in pairs], "src string, dst string, weight double")
    n = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    found = materialize(clustering.leiden(n, e))
    planted = graph.modularity(e, n.withColumn("cluster", F.substring("id", 1, 2))).first().modularity
    for level, gamma in enumerate((2.0, 1.0, 0.5)):
        m = found.where(f"level = {level}")
        assert m.count() == n.count()
        if gamma == 1:
            assert graph.modularity(e, m).first().modularity > planted - 0.02
        inner = e.join(m.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst").where("a = b")
        assert graph.components(n, inner.select("src", "dst")).select("component").distinct().count() == m.select("cluster").distinct().count()


def test_graph_queries_of_whole_tables(spark, tmp_path):
    """Degrees and the largest component against brute force over all orders."""
    from graphloom.plans.q_graph import QUERIES, SQL

    lines, home = [(i, i // 2, i % 6) for i in range(60)], [(i, i % 2) for i in range(7)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(home, "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    pairs = {(f"P{p}", f"S{x}") for _, p, x in lines} | {(f"N{n}", f"S{x}") for x, n in home}
    degree = {"gone": 0}
    for end in (x for p in pairs for x in p):
        degree[end] = degree.get(end, 0) + 1
    assert {r.id: r.degree for r in QUERIES["node_degree_all"](spark, str(tmp_path)).collect()} == degree
    found = {min(degree)}
    for _ in degree:
        found |= {x for p in pairs if found & set(p) for x in p}
    largest = max((found, set(degree) - found - {"gone"}), key=len)
    assert {r.id for r in QUERIES["largest_component_all"](spark, str(tmp_path)).collect()} == largest
    assert not any(part in sql for sql in SQL.values() for part in ("l_orderkey % 4 = 0", "o_orderkey % 5 = 0", "c_custkey % 3 <> 0"))


def test_merging_and_fusion_of_whole_texts(spark, tmp_path):
    """Turns that first differ after 60 characters stay two; items that begin alike are two passages."""
    from graphloom.plans.q_query import QUERIES

    spark.createDataFrame([(1, 0, "x" * 61 + "a"), (1, 1, "x" * 61 + "b"), (1, 2, "x" * 80 + "c"), (1, 3, "x" * 80 + "d")], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert {r.hop for r in QUERIES["multihop_merge_all"](spark, str(tmp_path)).collect()} == {0, 1, 3}
    spark.createDataFrame([(i, "the same beginning of text " + "ab"[i % 2]) for i in range(2)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name in ("weighted_fusion_all", "rrf_fusion_all"):
        assert len({r.passage for r in QUERIES[name](spark, str(tmp_path)).collect()}) == 5, name


def test_node2vec_has_all_nodes(spark, tmp_path):
    """Nodes of all orders and suppliers, over 200 of them."""
    from graphloom.plans.q_graph import node2vec

    spark.range(230).selectExpr("id l_orderkey", "id l_partkey", "id % 7 l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(8).selectExpr("id s_suppkey", "id % 2 s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    found = node2vec(spark, str(tmp_path)).collect()
    assert {r.id for r in found} == {*(f"P{i}" for i in range(230)), *(f"S{i}" for i in range(8)), "N0", "N1"} and len(found) == 240
    assert all(r.dims == 16 and r.norm > 0 for r in found)


def test_vectors_and_fusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0])], "id int, embedding array<float>")
    assert [r.id for r in vectors.top_k(v, [1.0, 0.0], 2).collect()] == [1, 2]
    assert vectors.top_k(v, [1.0, 0.0], 5, 0.2).count() == 2
    p = spark.createDataFrame([(0, 0.3, "a\n\nb"), (1, 0.7, "b\n\nc")], "retriever_pos int, weight double, result string")
    assert [r.passage for r in vectors.weighted_fusion(p, 3).collect()] == ["b", "c", "a"]
    assert vectors.reciprocal_rank_fusion(p, 1).first().passage == "b"


def test_metrics(spark):
    r = one(spark, em=evaluation.exact_match(F.lit("The Cat!"), F.lit("cat")), f=evaluation.token_f1(F.lit("a big cat"), F.lit("cat")), none=evaluation.token_f1(F.lit(""), F.lit("")), c=evaluation.context_recall(F.lit("x One"), F.array(F.lit("one"), F.lit("two"), F.lit("three"))))
    assert r.em == 1 and r.f == pytest.approx(2 / 3) and r.none == 1 and r.c == pytest.approx(1 / 3)
    pairs = spark.createDataFrame([("m", 0.1, 0.2), ("m", 0.2, 0.3), ("m", 0.3, 0.4)], "k string, a double, b double")
    s = evaluation.paired_significance(pairs, ["k"]).first()
    assert s.delta == pytest.approx(0.1) and s.significant
    asked = {"Compare both": "multihop", "What do Alice and Bob have in common?": "multihop", "What is between A and B?": "multihop", "Which authors are RELATED TO Kant?": "multihop", "Alice, who also wrote X": "multihop", "Give a high-level broad view": "global", "What are the main themes overall?": "global", "Themes in common": "multihop", "Where is it?": "local", "overviews of accrosstics": "local", None: "local"}
    assert {x.q: x.m for x in spark.createDataFrame([(q,) for q in asked], "q string").select("q", retrieval.route(F.col("q")).alias("m")).collect()} == asked


def test_store_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a = spark.range(3)
    first = store.commit(a=a)
    with pytest.raises(Exception):
        store.commit(a=spark.range(9), b=spark.range(2).select(F.raise_error(F.lit("x")).alias("y")))
    assert store.read("a").count() == 3 and not store.has("b")
    store.commit(a=spark.range(5))
    store.rollback(first)
    assert store.read("a").count() == 3
    (tmp_path / "old.json").write_text('{"k": {"n": 1}, "j": [2]}')
    assert import_json(spark, store, "kv", str(tmp_path / "old.json")) and not import_json(spark, store, "kv", "nowhere")
    assert {r.key: r.value for r in store.read("kv").collect()} == {"k": '{"n":1}', "j": "[2]"}


def test_engine_and_stream(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), Config(chunk_tokens=20, chunk_overlap=2))
    assert engine.insert(["Alice met Bob in Paris.", "Bob wrote to Carol about Rome.", " "]) == 2
    assert engine.insert(["Alice met Bob in Paris."]) == 0
    assert engine.mentioned("alice and CAROL") == ["ALICE", "CAROL"]
    local = engine.query("Who met Bob?", QueryParam(mode="local", only_need_context=True))
    assert all(f"-----{t}-----" in local for t in ("Reports", "Entities", "Relationships", "Sources")) and "BOB" in local
    assert "Paris" in engine.query("Paris", QueryParam(mode="naive", only_need_context=True))
    assert "".join(engine.stream("Rome", QueryParam(mode="naive"))) == engine.query("Rome", QueryParam(mode="naive"))
    before = {r.entity_name for r in engine.store.read("entities").collect()}
    doc = engine.store.read("documents").where("content like 'Bob%'").first().doc_id
    assert engine.insert_documents(spark.createDataFrame([(doc, "Bob wrote to Dora.")], "doc_id string, content string")) == 1
    after = {r.entity_name for r in engine.store.read("entities").collect()}
    assert "CAROL" in before and "CAROL" not in after and "DORA" in after and "ALICE" in after
    from graphloom.streaming.ingest import ingest

    spark.createDataFrame([("new", "Eve found Mallory.", 1), ("new", "Eve found Trent.", 2)], "doc_id string, content string, seq long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, content string, seq long").parquet(str(tmp_path / "in"))
    ingest(stream, engine, str(tmp_path / "cp")).awaitTermination()
    names = {r.entity_name for r in engine.store.read("entities").collect()}
    assert "TRENT" in names and "MALLORY" not in names
    assert FAIL and QueryParam.of({"level": 1, "max_hops": 3}).level == 1 and Config(api_key="x").for_logs()["api_key"] == "***"
