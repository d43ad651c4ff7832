"""Entities whose ids share names: one canonical id, remaps carried to other documents' relationships."""

import random
from collections import Counter, defaultdict

import pytest
from graphloom.functions.text import UNKNOWN_TYPE
from graphloom.operators import clustering, graph, merge
from graphloom.plans.engine import Config, Engine
from pyspark.sql import functions as F
from test_changes import index_is_whole, state_of

FACTS_E = "doc_id string, chunk_id string, ord long, entity_id string, entity_name string, entity_type string, description string"
FACTS_R = "doc_id string, chunk_id string, ord long, relationship_id string, src string, tgt string, relation_type string, description string, weight double"


def put(engine, docs):
    """Replace the facts of documents {doc: ([(id, name, type)], [(src, tgt)])}; None deletes one."""
    e = [(d, f"c{d}", i, *x, f"{x[1]} in {d}") for d, v in docs.items() for i, x in enumerate((v or ([], []))[0])]
    r = [(d, f"c{d}", i, f"{a}-{b}", a, b, "RELATED", f"{d} says", 1.0) for d, v in docs.items() for i, (a, b) in enumerate((v or ([], []))[1])]
    spark = engine.spark

    def work(change):
        engine._facts(change, spark.createDataFrame([(d,) for d in docs], "doc_id string"), spark.createDataFrame(e, FACTS_E), spark.createDataFrame(r, FACTS_R))
        return len(docs)

    engine._retrying(work)


def canonical(engine):
    out = defaultdict(set)
    for r in engine.store.read("identities").collect():
        out[r.entity_id].add(r.canonical_id)
    assert all(len(v) == 1 for v in out.values())
    return {k: v.pop() for k, v in out.items()}


def plain(facts, previous):
    """{id: canonical id} by the stated rule."""
    group = {i: i for i, _, _ in facts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    names = defaultdict(set)
    for i, n, _ in facts:
        names[n].add(i)
    for ids in names.values():
        first, *rest = ids
        for other in rest:
            group[root(other)] = root(first)
    members = defaultdict(set)
    for i in group:
        members[root(i)].add(i)
    out = {}
    for ids in members.values():
        kept = sorted(ids & set(previous.values()))
        counts = Counter((i, t) for i, _, t in facts if i in ids)
        top = max((t != UNKNOWN_TYPE, n, t) for (i, t), n in counts.items())
        chosen = kept[0] if kept else min(i for (i, t), n in counts.items() if (t != UNKNOWN_TYPE, n, t) == top)
        out.update(dict.fromkeys(ids, chosen if len(ids) > 1 else next(iter(ids))))
    return out


def edges_by_hand(docs, same):
    out = Counter()
    for v in docs.values():
        for a, b in v[1]:
            a, b = sorted((same.get(a, a), same.get(b, b)))
            if a != b:
                out[a, b] += 1.0
    return dict(out)


def edges(engine):
    return {(r.src, r.dst): r.weight for r in engine.store.read("relationships").collect()}


def holds(engine, docs, previous):
    """The engine's tables equal those made by hand from the documents, and a full rebuild row for row."""
    same = plain([x for v in docs.values() for x in v[0]], previous)
    assert canonical(engine) == same
    assert {r.entity_id for r in engine.store.read("entities").collect()} == set(same.values())
    assert edges(engine) == edges_by_hand(docs, same)
    assert engine.integrity()[0] == engine.integrity()[1] == len(set(same.values()))
    index_is_whole(engine)
    kept = state_of(engine)
    engine.rebuild()
    assert state_of(engine) == kept and canonical(engine) == same
    return same


def test_a_changed_canonical_id_reaches_other_documents(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), Config(buckets=1, enable_communities=False))
    docs = {
        "1": ([("a", "ANN", "PERSON"), ("b", "BOB", "PERSON")], [("a", "b")]),
        "2": ([("x", "ANNE", "PERSON"), ("b", "BOB", "PERSON")], [("x", "b")]),
    }
    put(engine, docs)
    same = holds(engine, docs, {})
    assert same == {"a": "a", "b": "b", "x": "x"} and edges(engine) == {("a", "b"): 1.0, ("b", "x"): 1.0}
    docs["3"] = ([("a", "ANNE", "PERSON")], [])  # says that both are one
    put(engine, {"3": docs["3"]})
    same = holds(engine, docs, same)
    assert same["x"] == "a" and edges(engine) == {("a", "b"): 2.0}
    docs["1"], docs["3"] = ([("b", "BOB", "PERSON")], []), ([("y", "ANNE", "PERSON")], [("x", "y")])  # a is gone: another id has to stand for them
    put(engine, {d: docs[d] for d in "13"})
    same = holds(engine, docs, same)
    assert same["x"] == same["y"] and edges(engine) == {tuple(sorted((same["x"], "b"))): 1.0}
    del docs["3"]
    put(engine, {"3": None})
    assert holds(engine, docs, same) == {"b": "b", "x": "x"}


def test_random_changes_equal_a_rebuild(spark, tmp_path):
    draw = random.Random(7)
    engine = Engine(spark, str(tmp_path / "e"), Config(buckets=1, enable_communities=False))

    def document():
        ents = [(f"i{draw.randrange(8)}", f"N{draw.randrange(9)}", draw.choice(["PERSON", "GEO", UNKNOWN_TYPE])) for _ in range(draw.randrange(1, 4))]
        ids = sorted({i for i, _, _ in ents})
        return ents, [(draw.choice(ids), draw.choice(ids)) for _ in range(3)]

    docs, same = {}, {}
    for step in range(3):
        batch = {str(draw.randrange(8)): document() for _ in range(3)}
        gone = {d: None for d in draw.sample(sorted(docs), min(len(docs), step % 2 * 2))}
        put(engine, batch | gone)
        docs = {d: v for d, v in (docs | batch).items() if d not in gone}
        same = holds(engine, docs, same)


def test_one_name_of_very_many_ids(spark):
    many = [(f"i{k:04d}", "SAME", "PERSON" if k else UNKNOWN_TYPE) for k in range(2000)] + [("i0500", "OTHER", "PERSON"), ("z", "OTHER", "GEO"), ("alone", "ALONE", "GEO"), ("alone", "ALSO", "GEO")]
    facts = spark.createDataFrame(many, "entity_id string, entity_name string, entity_type string")
    before = spark.createDataFrame([], "entity_id string, entity_name string, canonical_id string")
    found = {r.entity_id: r.canonical_id for r in merge.identities(facts, before).collect()}
    assert found == plain(many, {}) and found["z"] == "i0500" and found["alone"] == "alone"
    assert merge.identities(facts.limit(0), before).count() == 0


def test_modularity_is_kept_and_a_drop_clusters_all_anew(spark, tmp_path, monkeypatch):
    by_letter = lambda ids, *_, **__: ids.select("id", F.lit(0).alias("level"), F.substring("id", 1, 1).alias("cluster"))
    for name in ("leiden", "incremental_leiden"):  # how nodes are clustered isn't the question here
        monkeypatch.setattr(clustering, name, by_letter)

    def clique(doc, names):
        ids = [(n, n.upper(), "PERSON") for n in names]
        return ids, [(a, b) for a in names for b in names if a < b]

    engine = Engine(spark, str(tmp_path / "e"), Config(buckets=1, resolutions=(1.0,), frontier_limit=1.0))
    docs = {str(k): clique(k, [f"{'abcd'[k]}{i}" for i in range(3)]) for k in range(4)}
    docs["bridge"] = [(n, n.upper(), "PERSON") for n in ("a0", "b0", "c0", "d0")], [("a0", "b0"), ("b0", "c0"), ("c0", "d0")]
    put(engine, docs)
    state = lambda: engine.store.read("clustering").first()
    full = lambda: graph.modularity(engine.store.read("relationships"), engine.store.read("membership").where("level = 0")).first()[0]
    assert state().updates == 0 and state().baseline == state().modularity == pytest.approx(full())
    put(engine, {"more": ([("a1", "A1", "PERSON"), ("e", "E", "PERSON")], [("a1", "e")])})
    assert state().updates == 1 and state().modularity == pytest.approx(full())
    engine.config.modularity_drop = -1.0  # any change is a drop
    put(engine, {"more": None})
    assert state().updates == 0 and state().baseline == state().modularity == pytest.approx(full())
