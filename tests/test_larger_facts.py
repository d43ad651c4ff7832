"""Facts and their merging on larger tables: what is shuffled is short, and texts are cut once."""

import re

import pytest
from graphloom.functions import text as T
from graphloom.operators import extraction, merge
from graphloom.plans import catalog
from pyspark.sql import functions as F
from test_larger_tables import DATA, plan, same_as_sql


def hashed_after_moving(df):
    """Ids are made above the last step that moves rows."""
    lines = plan(df).splitlines()
    hashed = [i for i, line in enumerate(lines) if "sha2(" in line]
    moved = [i for i, line in enumerate(lines) if "RepartitionByExpression" in line]
    return bool(moved) and max(hashed) < min(moved)


@pytest.mark.parametrize("name", ["rel_combine", "entity_combine", "contribution_index", "doc_entity_accumulate", "doc_rel_accumulate"])
def test_ids_are_made_of_what_is_left(spark, name):
    assert hashed_after_moving(catalog.QUERIES[name](spark, DATA))
    assert same_as_sql(spark, name)


def test_combined_entities_by_documents(spark):
    rows = [(1, "e", "B", "X", ["d"], ["c1"]), (2, "e", "A", "X", ["d", "b"], ["c2"]), (3, "e", "A", "Y", ["", "a"], ["c1"]), (4, "e", "B", "Y", [], []), (5, "f", None, None, ["z"], ["c9"])]
    m = spark.createDataFrame(rows, "doc_id int, entity_id string, entity_name string, entity_type string, descriptions array<string>, source_chunk_ids array<string>")
    found = {tuple(r) for r in merge.combine_entities(m).collect()}
    assert found == {("e", "B", "X", "a<SEP>b<SEP>d", "c1<SEP>c2"), ("f", None, None, "z", "c9")}


def test_index_has_one_null_key(spark):
    e = spark.createDataFrame([(1, None, "A"), (2, "x", None)], "doc_id int, entity_id string, entity_name string")
    r = spark.createDataFrame([(3, None)], "doc_id int, relationship_id string")
    assert {r.key: r.doc_ids for r in merge.contribution_index(e, r).collect()} == {None: [1, 2, 3], "entity::x": [2], "entity_name::A": [1]}


def test_affected_documents_leave_facts_where_they_are(spark):
    df = catalog.QUERIES["affected_documents"](spark, DATA)
    assert plan(df).count("strategy=broadcast") >= 3
    assert same_as_sql(spark, "affected_documents")


@pytest.mark.parametrize("name", ["parse_tuple_entities", "parse_tuple_relationships"])
def test_outputs_are_cut_once(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert len(re.findall(r"regexp_extract\(", plan(df))) == 1
    assert name == "parse_tuple_entities" or same_as_sql(spark, name)  # its SQL takes each chunk id for one row, sf0.001 has one twice


def test_parsed_entities_of_odd_outputs(spark):
    outs = [('("entity"<|>a<|> <|>x)##("relationship"<|>A<|>b<|>y<|>2)##("entity"<|> <|>t<|>no name)##("entity"<|>b<|>t<|>late)', 1), (None, 2), ("", 3), ('("relationship"<|> <|>Q<|>r<|>k<|>-.5)', 4)]
    texts = spark.createDataFrame([(c, str(c), o) for o, c in outs], "doc_id int, chunk_id string, output string")
    e, r = extraction.parse_records(texts)
    assert {tuple(x) for x in e.select("chunk_id", "ord", "entity_name", "entity_type", "implicit").collect()} == {("1", 1, "B", '"UNKNOWN"', True), ("1", 1, "A", '"UNKNOWN"', True), ("1", 3, "B", "T", False), ("4", 0, "Q", '"UNKNOWN"', True), ("4", 0, "R", '"UNKNOWN"', True)}
    old = extraction.with_endpoints(e.where("not implicit"), r)
    assert sorted(map(str, old.collect())) == sorted(map(str, e.select(*old.columns).collect()))
    assert {tuple(x) for x in r.select("chunk_id", "ord", "src", "tgt", "weight").collect()} == {("1", 1, "A", "B", 2.0), ("4", 0, "Q", "R", -0.5)}


def test_strip_is_what_the_pattern_did(spark):
    pattern = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    df = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.udf(lambda k: f"{chr(k)} \n{chr(k)}a{chr(k)}b\n{chr(k)}\r\n{chr(k)}", "string")("id").alias("t"))
    assert not df.where(T.strip(F.col("t")) != F.regexp_replace("t", f"^{pattern}+|{pattern}+$", "")).count()
    assert spark.createDataFrame([("",), (" 　",), (None,)], "t string").select(T.strip(F.col("t"))).collect() == [("",), ("",), (None,)]


def test_clustering_rounds_move_numbers(spark, monkeypatch):
    from graphloom.operators import clustering

    kinds, kept = [], clustering._moves
    monkeypatch.setattr(clustering, "_moves", lambda links, start, *a: kinds.append((dict(links.dtypes)["a"], dict(start.dtypes)["community"])) or kept(links, start, *a))
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(5) for j in range(i)] + [("x0", "y0")]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    start = spark.createDataFrame([(f"x{i}", "old") for i in range(3)], "id string, community string")
    found = clustering.communities(edges, (1.0,), start=start).collect()
    assert set(kinds) == {("bigint", "bigint")}
    groups = {}
    for r in found:
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[f"{g}{i}" for i in range(5)] for g in "xy"]
