"""Aliases are facts of documents: combined over them, gone with them."""

import json

from graphloom.plans.engine import Config, Engine

def test_aliases_follow_their_documents(spark, tmp_path):
    # what the model finds in a text
    other = {"annals": ["Annie", "ANNA"], "boston": ["Annie", "A. Lee"], "cellar": []}

    def find(prompts):
        return [json.dumps(next(v for k, v in other.items() if k in p)) for p in prompts]

    def extract(prompts):
        return [json.dumps({"entities": [{"name": "Anna", "type": "person", "description": "d"}], "relationships": []}) for _ in prompts]

    engine = Engine(spark, str(tmp_path / "store"), Config(extractor=extract, aliases=find, enable_communities=False, buckets=2))
    docs = lambda rows: spark.createDataFrame(rows, "doc_id string, content string")
    aliases = lambda: {r.entity_name: r.aliases for r in engine.store.read("entities").collect()}
    engine.insert_documents(docs([("a", "annals"), ("b", "boston"), ("c", "cellar")]))
    assert aliases() == {"ANNA": ["A. Lee", "Annie"]}  # a name in another case is no alias
    assert [r.aliases for r in engine.registry().collect()] == [["A. Lee", "Annie"]]
    engine.delete_documents(docs([("b", "")]).select("doc_id"))
    assert aliases() == {"ANNA": ["Annie"]}
    engine.insert_documents(docs([("a", "cellar again")]))
    assert aliases() == {"ANNA": []}
