"""Experiments, caches, reports, links, aliases, datasets and GraphML."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import model as M
from graphloom.operators import extraction, registry
from graphloom.plans import answers, evaluation, experiments, reports
from graphloom.plans.engine import UNGROUNDED, Config, Engine, QueryParam
from graphloom.sources import datasets
from graphloom.sources.graphml import read_graphml, write_graphml
from graphloom.sources.store import Store


def test_messages_labels_and_cache(spark, tmp_path):
    assert M.messages("q", "a", "r") == [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}, {"role": "user", "content": "r"}]
    assert M.messages("q", shape="blocks") == [{"role": "user", "content": [{"text": "q"}]}]
    assert spark.range(1).select(M.label(F.lit("3-a/b c"))).first()[0] == "_3_a_b_c"
    assert spark.range(1).select(reports.budget_row(F.lit('a"b'), F.lit(1))).first()[0] == '"a""b","1"'
    cache, asked = M.AnswerCache(Store(spark, str(tmp_path / "c"))), []

    def ask(todo, prompt):
        rows = todo.collect()
        asked.extend(r.prompt for r in rows)
        return spark.createDataFrame([(r.args_hash, r.prompt.upper()) for r in rows], "args_hash string, output string")

    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "p string")
    for _ in range(2):
        assert sorted(r.output for r in cache.call(rows, F.col("p"), ask, prefix="x").collect()) == ["A", "A", "B"]
    assert sorted(asked) == ["a", "b"]
    cache.clear("x")
    assert cache.rows().count() == 0


def test_extraction_stages(spark):
    chunks = spark.createDataFrame([("d", f"c{i}", t) for i, t in enumerate(["Ann met Bob", "tuple", "bad", "Cy"])], "doc_id string, chunk_id string, content string")

    def model(prompts):
        out = []
        for p in prompts:
            if p == "bad":
                raise ValueError("no")
            out.append('("entity"<|>Zoe<|>person<|>x)' if p == "tuple" else extraction.offline_extractor([p])[0])
        return out

    told, entities, rels = extraction.extract(chunks, model, batch=4)
    assert {r.entity_name for r in entities.collect()} == {"ANN", "BOB", "CY", "ZOE"} and rels.count() == 1
    assert {r.chunk_id for r in told.where("output is null").collect()} == {"c2"}

    def grouped(prompts):
        if prompts[0].startswith(extraction.GROUP_MARK):
            return [json.dumps({"c0": {"entities": [{"name": "Grouped", "type": "x", "description": "y"}], "relationships": []}})]
        return model(prompts)

    names = {r.entity_name for r in extraction.extract(chunks.coalesce(1), grouped, grouped=True)[1].collect()}
    assert names == {"GROUPED", "CY", "ZOE"}
    find = extraction.recogniser(lambda: lambda texts, kinds, relations: [([("Ann", kinds[0])], [("Ann", relations[0], "Bob"), ("ann", "is_a", "ANN")]) for _ in texts])
    assert [(r["source"], r["target"]) for r in json.loads(find(["x"])[0])["relationships"]] == [("ann", "ANN")]
    facts = spark.createDataFrame([("e1", "Ann", f"c{i}") for i in range(3)], "entity_id string, entity_name string, chunk_id string")
    found = extraction.extract_aliases(facts, chunks, lambda p: ['["Annie", "ANN", " "]'] * len(p))
    assert [tuple(r) for r in found.collect()] == [("e1", "Annie")]

    def broken(prompts):
        raise ValueError("no")

    with pytest.raises(RuntimeError):
        extraction.extract_aliases(facts, chunks, broken)


def test_fuzzy_names_against_brute_force(spark):
    """All pairs at low and high thresholds, names without a common letter pair too."""
    from graphloom.functions.text import similarity

    names = ["abc", "a.b.c", "acme corp", "acme  Corp.", "corp acme", "x", "zz", "aab", "baa", "Charles Dickens", "charles dickins", "dickens charles", "éa", "aé", "1234", "4321", "12345"]
    reg = spark.createDataFrame([(f"e{i}", n, "X", [], i) for i, n in enumerate(names)], "entity_id string, canonical_name string, entity_type string, aliases array<string>, reg_order int")
    asked = spark.createDataFrame([(f"q{i}", n, "X") for i, n in enumerate(names)], "query_id string, name string, entity_type string")
    norm = {n: r[0] for n, r in zip(names, asked.select(registry.registry_name(F.col("name"))).collect())}
    for threshold in (0.3, 0.7, 0.92):
        want = {(f"q{i}", f"e{j}") for i, a in enumerate(names) for j, b in enumerate(names) if similarity(norm[a], norm[b]) >= threshold}
        assert {(r.query_id, r.entity_id) for r in registry.fuzzy_pairs(asked, reg, threshold).collect()} == want


def test_names_of_hops(spark):
    from graphloom.plans.retrieval import harvest

    long_name = "q" * 70
    text = f'The "{long_name}" of Paris and New York\nCity. "open\n\nThis "a" An éAbc Zoë Xyz9'
    got = spark.createDataFrame([(text,), (None,), ("",)], "c string").select(harvest(F.col("c")).alias("n")).collect()
    assert list(got[0].n) == [long_name, "Paris", "New", "York", "City", "The", "New York\nCity", "a", "This", "An"]
    assert got[1].n == got[2].n == []


def test_linking(spark, tmp_path):
    reg = spark.createDataFrame([("e1", "Charles Dickens", "P", ["Boz"], {}, 1), ("e2", "Charles Dickins", "P", [], {}, 2), ("e3", "Ann", "P", [], {}, 3)], "entity_id string, canonical_name string, entity_type string, aliases array<string>, metadata map<string,string>, reg_order int")
    m = spark.createDataFrame([("d", "m1", "boz", "P"), ("d", "m2", "Charles Dickenz", "P"), ("d", "m3", "Nobody", "P")], "doc_id string, entity_id string, entity_name string, entity_type string")
    links = lambda **k: {r.entity_id: r.linked_id for r in registry.link_manifest(m, reg, 0.85, **k).collect()}
    assert links() == {"m1": "e1", "m2": "m2", "m3": "m3"}
    assert links(decide=lambda prompts: ['{"entity_id": "e2"}'] * len(prompts))["m2"] == "e2"
    assert links(decide=lambda prompts: ['{"entity_id": "e9"}'] * len(prompts))["m2"] == "m2"
    rels = spark.createDataFrame([("m1", "m2", "X"), ("m1", "m3", "X")], "src_id string, tgt_id string, relation_type string")
    linked = registry.link_manifest(m, reg, 0.85, lambda p: ['{"entity_id": "e1"}'] * len(p))
    e, r = registry.apply_links(m, rels, linked)
    assert {x.entity_id for x in e.collect()} == {"e1", "m3"} and [(x.src_id, x.tgt_id) for x in r.collect()] == [("e1", "m3")]
    registry.export_registry(reg, str(tmp_path / "r"))
    again = registry.import_registry(spark, str(tmp_path / "r"))
    assert {(x.entity_id, tuple(x.aliases)) for x in again.collect()} == {("e1", ("Boz",)), ("e2", ()), ("e3", ())}
    assert registry.remove(reg, reg.where("entity_id = 'e1'")).count() == 2


def test_global_points_and_joining(spark):
    chosen = spark.createDataFrame([("a", 1.0, 5.0, "about rivers and towns"), ("b", 0.5, 4.0, "about kings"), ("c", 0.2, 1.0, "about rivers")], "cluster string, occurrence double, rating double, report string")
    text = answers.global_points(chosen, "which rivers", answers.offline_mapper, 6)
    assert text.startswith("----Analyst") and "rivers" in text and text.count("----Analyst") == 1
    assert answers.global_points(chosen, "which rivers", answers.offline_mapper, 1000).count("----Analyst 0----") == 3
    assert answers.joined("A and B", ["x", "y"]) == "x and y" and answers.joined("A, B", ["x", "y"]) == "x, y"
    assert answers.confidence(["a"], ["a", "b"]) == pytest.approx(0.8) and answers.confidence([], ["a"]) == 0
    fused = answers.hybrid(spark, "q", [lambda q: "a\n\nb", lambda q: 1 / 0, lambda q: "b"])
    assert fused == "b\n\na"
    with pytest.raises(ValueError):
        answers.hybrid(spark, "q", [], fusion="other")


def test_datasets(spark, tmp_path):
    rows = spark.createDataFrame([(0, None, "q0", "a0", [("T", "f1"), ("U", "g"), ("T", "f2")]), (1, "x", "q1", "a1", [("T", "f1"), ("", "h"), ("T", "f")])], "pos int, id string, query string, answer string, evidence_list array<struct<title:string,fact:string>>")
    asked, docs = datasets.merged_facts(rows)
    assert {r.title: (r.id, r.content) for r in docs.collect()} == {"T": ("doc_0", "f1\nf2"), "U": ("doc_1", "g")}
    assert {r.id: r.supporting_facts for r in asked.collect()} == {"multihoprag_0": ["f1", "g", "f2"], "x": ["f1", "h", "f"]}
    got = spark.createDataFrame([("[['T', ['a', 'b']]]",), ('[["U", "c"]]',), ("junk",)], "c string").select(datasets.literal_contexts(F.col("c")).alias("c")).collect()
    assert [[(x.title, x.sentences) for x in r.c] for r in got] == [[("T", ["a", "b"])], [("U", ["c"])], []]
    rows = spark.createDataFrame([(0, "i", "q", "a", [("T", ["x", "y"])], ["T", "V"]), (1, "j", "q", "a", [("V", ["z"])], ["V"])], "pos int, id string, question string, answer string, context array<struct<title:string,sentences:array<string>>>, titles array<string>")
    asked, docs = datasets.supported_titles(rows)
    assert {r.id: r.supporting_facts for r in asked.collect()} == {"i": ["T"], "j": ["V"]} and {r.content for r in docs.collect()} == {"x y", "z"}
    rows = spark.createDataFrame([(0, None, "q", "a", [(1, "T", "x"), (2, "T", "y"), (1, "T", "again"), (3, "", "z")], [("one",), (None,), ("two",), ("three",)])], "pos int, id string, question string, answer string, paragraphs array<struct<idx:int,title:string,paragraph_text:string>>, decomposition array<struct<answer:string>>")
    asked, docs = datasets.paragraphs(rows)
    assert asked.first().supporting_facts == ["one", "two"] and {(r.id, r.content) for r in docs.collect()} == {("musique_doc_0", "x"), ("musique_doc_1", "y")}


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x < y & \"z\""), ("b", None)], "id string, description string")
    edges = spark.createDataFrame([("a", "b", 2.5)], "src string, dst string, weight double")
    write_graphml(nodes, edges, str(tmp_path / "g.graphml"))
    n, e = read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: r.attributes for r in n.collect()} == {"a": {"description": 'x < y & "z"'}, "b": {}}
    assert [(r.src, r.dst, r.attributes) for r in e.collect()] == [("a", "b", {"weight": "2.5"})]


def test_runner_and_modes(spark, tmp_path):
    """One index, all modes, plugins, results, and a report."""
    (tmp_path / "q.json").write_text(json.dumps([{"question": "Who met Bob?", "answer": "ALICE", "supporting_facts": ["Alice met Bob"]}]))
    (tmp_path / "c.json").write_text(json.dumps([{"title": "One", "content": "Alice met Bob in Paris."}, {"title": "Two", "content": "Bob wrote to Carol about Rome."}, {"title": "Three", "content": " "}]))
    results = experiments.Results(Store(spark, str(tmp_path / "r")))
    x = experiments.Experiment("first try", "multihop_rag", str(tmp_path / "q.json"), str(tmp_path / "c.json"), modes=["naive"], metrics=["token_f1", "context_recall"])
    means = experiments.run(spark, x, str(tmp_path / "e"), results, Config(answer=lambda p: "alice"))
    assert {(r["mode"], r.metric): r.score for r in means.collect()} == {("naive", "token_f1"): 1.0, ("naive", "context_recall"): 1.0}
    (run_id,) = results.runs("first try")
    assert results.load(run_id).count() == 2 and results.runs("other") == [] and "| naive |" in evaluation.markdown(means)
    with pytest.raises(ValueError):
        experiments.Suite(["bleu"])
    engine = Engine(spark, str(tmp_path / "e"), Config(answer=lambda p: "Said by Bob and alice", cache_answers=True, answer_stream=lambda p: iter(["a", "b"])))
    found = engine.grounded("Who met Bob?")
    assert set(found.canonical_entities) == {"ALICE", "BOB"} and " and " in found.answer and 0 < found.confidence <= 1
    engine.config.answer, engine.config.cache_answers = (lambda p: "nothing of use"), False
    assert engine.grounded("Who met Bob?").answer == UNGROUNDED
    assert {r.canonical_name for r in engine.grounded_rows("bob, CAROL", mode="naive")} == {"BOB", "CAROL"}
    assert "ALICE" in {r.canonical_name for r in engine.grounded_rows("Bob", 20, "multihop")}
    assert "----Analyst" in engine.query("Who met Bob?", QueryParam(mode="global", only_need_context=True))
    engine.config.answer = lambda p: '["Who met Bob?", "Where is Rome?"]'
    hops = engine.query("Who met Bob and where is Rome?", QueryParam(mode="multihop", only_need_context=True))
    assert "Rome" in hops and "Paris" in hops
    assert list(engine.stream("Rome", QueryParam(mode="naive"))) == ["a", "b"]
    experiments.install()
    assert "naive" in experiments.registered("retriever") and "ALICE" in experiments.resolve("retriever", "hipporag")(engine, "Bob", QueryParam())
    assert experiments.resolve("retriever", "adaptive")(engine, "Where is Rome?", QueryParam())
    with pytest.raises(KeyError):
        experiments.resolve("retriever", "none")
    report = engine.store.read("reports").first()
    assert report.report.startswith("# ") and json.loads(report.report_json)["rating"] > 0 and engine.integrity()[0] == engine.integrity()[1]
