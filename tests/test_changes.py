"""Changes of a corpus: failed model calls, configurations, deletions, the contribution index, streams."""

import functools

from graphloom.operators import extraction, merge
from graphloom.plans.engine import Config, Engine, fingerprint
from graphloom.streaming.ingest import ingest


def names(engine):
    return {r.entity_name for r in engine.store.read("entities").collect()}


def index_is_whole(engine):
    """The kept index equals one built anew from the facts."""
    kept = sorted((r.key, r.doc_id) for r in engine.contributions().collect())
    anew = merge.contributions(engine.store.read("doc_entity"), engine.store.read("doc_relationship"))
    assert kept == sorted((r.key, r.doc_id) for r in anew.collect())


def state_of(engine):
    """Derived tables as values."""
    s = engine.store
    return (
        sorted((r.entity_id, r.entity_name, r.entity_type, r.description) for r in s.read("entities").collect()),
        sorted((r.src, r.dst, r.weight, r.description) for r in s.read("relationships").collect()),
        sorted((r.id, tuple(r.embedding)) for r in s.read("entity_vectors").collect()),
    )


def test_failed_chunks_are_asked_again(spark, tmp_path):
    flag = tmp_path / "down"
    flag.write_text("")

    def extractor(prompts):
        import os

        if os.path.exists(str(flag)) and any("Bob" in p for p in prompts):
            raise ConnectionError("no model")
        return extraction.offline_extractor(prompts)

    engine = Engine(spark, str(tmp_path / "e"), Config(chunk_tokens=6, chunk_overlap=0, extractor=extractor, buckets=2, enable_communities=False))
    texts = ["Alice likes tea and milk and Bob likes cake.", "Carol slept."]
    assert engine.insert(texts) == 2
    assert "ALICE" in names(engine) and "BOB" not in names(engine)
    failed = engine.store.read("failed_chunks").collect()
    assert [(r.attempts, r.error) for r in failed] == [(1, "no model")]
    flag.unlink()
    assert engine.insert(["Dora sang."]) == 2
    assert {"ALICE", "BOB", "CAROL", "DORA"} <= names(engine) and engine.store.read("failed_chunks").count() == 0
    index_is_whole(engine)
    assert engine.insert(texts) == 0
    kept = state_of(engine)
    engine.rebuild()
    assert state_of(engine) == kept


def test_index_and_tables_through_inserts_changes_and_deletions(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), Config(chunk_tokens=20, chunk_overlap=0, buckets=2, enable_communities=False))
    docs = lambda rows: spark.createDataFrame(rows, "doc_id string, content string")
    assert engine.insert_documents(docs([("1", "Alice met Bob."), ("2", "Bob met Carol."), ("3", "Dora met Alice.")])) == 3
    index_is_whole(engine)
    assert engine.insert_documents(docs([("2", "Bob met Eve.")])) == 1
    index_is_whole(engine)
    assert "CAROL" not in names(engine)
    assert engine.delete_documents(docs([("3", ""), ("9", "")])) == 1
    assert "DORA" not in names(engine) and "ALICE" in names(engine) and engine.store.read("chunks").where("doc_id = '3'").count() == 0
    index_is_whole(engine)
    kept = state_of(engine)
    engine.rebuild()
    assert state_of(engine) == kept
    assert engine.delete_documents(docs([("3", "")])) == 0
    assert engine.delete_documents(docs([("1", ""), ("2", "")])) == 2
    assert names(engine) == set() and engine.contributions().count() == 0


def test_an_insert_begins_anew_after_another_writer(spark, tmp_path):
    one, two = (Engine(spark, str(tmp_path / "e"), Config(buckets=2, enable_communities=False)) for _ in range(2))
    one.insert("Alice met Bob.")
    once = []

    def also(change):
        if not once:
            once.append(two.insert("Carol met Dora."))

    docs = spark.createDataFrame([("x", "Eve met Frank.")], "doc_id string, content string")
    assert one.insert_documents(docs, also=also) == 1
    assert {"ALICE", "BOB", "CAROL", "DORA", "EVE", "FRANK"} == names(one)
    index_is_whole(one)


def test_configurations_differ_by_what_shapes_facts():
    def extractor(k):
        return lambda prompts: [str(k)] * len(prompts)

    base = Config()
    assert base.facts_hash() == Config().facts_hash() == Config(report_tokens=5).facts_hash()
    others = [Config(chunk_tokens=7, chunk_overlap=1), Config(gleaning=1), Config(extractor=lambda p: p), Config(extractor=lambda p: p[:0]), Config(extractor=extractor(1)), Config(extractor=extractor(2)), Config(extractor=functools.partial(max, 1)), Config(aliases=lambda p: p)]
    assert len({c.facts_hash() for c in [base, *others]}) == len(others) + 1
    assert fingerprint(extractor(1)) == fingerprint(extractor(1))

    class Model:
        def __init__(self, version):
            self.version = version

        def __call__(self, prompts):
            return prompts

    assert Config(extractor=Model("a")).facts_hash() != Config(extractor=Model("b")).facts_hash()


def test_streams_keep_the_latest_across_batches(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), Config(buckets=2, enable_communities=False))
    schema = "doc_id string, content string, seq long"

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest(stream, engine, str(tmp_path / "cp")).awaitTermination()

    feed(("a", "Alice five.", 5), ("a", "Alice four and Zed.", 4), ("b", "Bob one.", 1))
    feed(("a", "Alice three and Yan.", 3), ("b", "Bob two and Carl.", 2), ("b", "Bob two and Carl.", 2))
    assert names(engine) == {"ALICE", "BOB", "CARL"}
    assert engine.store.state()["batch-of-documents"]["mark"] == 1
    feed(("a", "Alice six and Will.", 6), (None, "Nobody.", 1))
    assert "WILL" in names(engine) and {(r.doc_id, r.seq) for r in engine.store.read("stream_progress").collect()} == {("a", 6), ("b", 2)}
