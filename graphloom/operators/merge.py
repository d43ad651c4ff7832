"""Facts of documents to entities and relationships of the corpus, and what an update touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import UNKNOWN_TYPE, join_unique
from ..sources.store import materialize
from . import graph

#: Rows of a table of keys that may be broadcast.
BROADCAST_ROWS = 1_000_000


def _distinct(lists: str) -> Column:
    """Sorted distinct entries of a group's lists."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(lists))))


def _values(column: str) -> Column:
    """Sorted distinct values of a group, without nulls."""
    return F.sort_array(F.collect_set(column))


def accumulate_entities(facts: DataFrame, by: str = "entity_id") -> DataFrame:
    """One row per (doc_id, entity_id) of facts(doc_id, entity_id, entity_name, entity_type, description, chunk_id, ord): the first name and type (of those at one place the smallest), sorted distinct descriptions and chunk ids, and aliases if facts have lists of them.

    by: another column that tells entities apart, such as what ids are made of: short keys make short rows, and ids can be made of the result.
    """
    more = [_distinct("aliases").alias("aliases")] if "aliases" in facts.columns else []
    return facts.groupBy("doc_id", by).agg(F.min_by("entity_name", F.struct("ord", "entity_name")).alias("entity_name"), F.min_by("entity_type", F.struct("ord", "entity_type")).alias("entity_type"), _values("description").alias("descriptions"), _values("chunk_id").alias("source_chunk_ids"), *more)


#: What an accumulated relationship keeps of its first row, unless what tells it apart says it already.
ENDS = ("src", "tgt", "relation_type")


def accumulate_relationships(facts: DataFrame, by: str = "relationship_id") -> DataFrame:
    """One row per (doc_id, relationship_id): first endpoints and type, if facts have them, summed weight, sorted distinct chunk ids. by: as in accumulate_entities()."""
    ends = [c for c in ENDS if c in facts.columns]
    first = [F.min_by(F.struct(*ends), "ord").alias("first")] if ends else []
    rows = facts.groupBy("doc_id", by).agg(*first, F.sum("weight").alias("weight"), _values("chunk_id").alias("source_chunk_ids"))
    return rows.select("doc_id", by, *(["first.*"] if ends else []), "weight", "source_chunk_ids")


def modal(facts: DataFrame, by: str, value: str, position: list[str]) -> DataFrame:
    """(by, value): the most frequent value of each group; of equal counts the one seen first."""
    counted = facts.groupBy(by, value).agg(F.count("*").alias("n"), F.min(F.struct(*position)).alias("first"))
    best = F.min_by(value, F.struct((-F.col("n")).alias("n"), "first", value))
    return counted.groupBy(by).agg(best.alias(value))


def combine_entities(manifest: DataFrame, by: str = "entity_id") -> DataFrame:
    """Corpus entities of manifest(doc_id, entity_id, entity_name, entity_type, descriptions, source_chunk_ids): modal name and type, joined descriptions and sources; aliases, if documents have them, sorted and without the name itself in any case. by: as in accumulate_entities().

    Rows go to their entity's partition once: first an entity's rows of equal name and type meet, then these few.
    """
    told = ["aliases"] if "aliases" in manifest.columns else []
    rows = manifest.select("doc_id", by, "entity_name", "entity_type", "descriptions", "source_chunk_ids", *told).repartition(by)
    lists = ["descriptions", "source_chunk_ids", *told]
    same = rows.groupBy(by, "entity_name", "entity_type").agg(F.count("*").alias("n"), F.min(F.struct("doc_id")).alias("first"), *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in lists])
    ranks = {c: Window.partitionBy(by, c) for c in ("entity_name", "entity_type")}
    ranked = same.withColumns({f"__{c}": F.struct((-F.sum("n").over(w)).alias("n"), F.min("first").over(w).alias("first"), F.col(c).alias("value")) for c, w in ranks.items()})
    whole = ranked.groupBy(by).agg(*[F.min(f"__{c}")["value"].alias(c) for c in ranks], *[F.flatten(F.collect_list(c)).alias(f"__{c}") for c in lists])
    others = [F.filter(F.array_sort(F.array_distinct(f"__{c}")), lambda a: F.lower(a) != F.lower("entity_name")).alias(c) for c in told]
    return whole.select(by, "entity_name", "entity_type", join_unique(F.col("__descriptions")).alias("description"), join_unique(F.col("__source_chunk_ids")).alias("source_id"), *others)


def combine_relationships(manifest: DataFrame, by: str = "relationship_id", chunk: Callable[[Column, Column], Column] = lambda doc, c: c) -> DataFrame:
    """Corpus relationships of manifest(doc_id, relationship_id, src, tgt, relation_type, weight, source_chunk_ids). by: as in accumulate_entities(); ends and type are left out if the manifest lacks them.

    chunk(doc_id, chunk): the text of a chunk id, made where a relationship's rows have met: what moves may be a number.
    """
    ends = [c for c in ENDS if c in manifest.columns]
    first = [F.min_by(F.struct(*ends), "doc_id").alias("first")] if ends else []
    chunks = F.transform("source_chunk_ids", lambda c: chunk(F.col("doc_id"), c))
    rows = manifest.repartition(by).groupBy(by).agg(*first, F.sum("weight").alias("weight"), F.flatten(F.collect_list(chunks)).alias("s"))
    return rows.select(by, *(["first.*"] if ends else []), "weight", join_unique(F.col("s")).alias("source_id"), F.lit(1).alias("order"))


def merge_nodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(id, entity_type, descriptions, source_ids) after merging: the type that most rows have (existing ones first among equals), unions of the lists."""
    both = existing.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    kind = modal(both, "id", "entity_type", ["age", "entity_type"])
    lists = both.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("descriptions")))).alias("descriptions"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_ids")))).alias("source_ids"))
    return kind.join(lists, "id")


def merge_edges(existing: DataFrame, new: DataFrame, nodes: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, new endpoints): weights of edges(src, dst, weight, order) summed, the least order; endpoints that nodes(id) lacks become unknown ones. tasks: over how many tasks the edges are dealt, the session's number if None."""
    both = existing.unionByName(new).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", "order")
    dealt = both.repartition(tasks, "src", "dst") if tasks else both
    merged = dealt.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.min("order").alias("order"))
    ends = both.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return merged, ends.withColumn("entity_type", F.lit(UNKNOWN_TYPE))


def canonical_entities(facts: DataFrame, preferred: DataFrame) -> DataFrame:
    """(entity_name, entity_id): the id that each name had before (preferred), or else the one whose type is known and most frequent (of equal counts the last by name), or else the smallest."""
    counted = facts.groupBy("entity_name", "entity_id", "entity_type").agg(F.count("*").alias("n"))
    rank = F.struct((F.col("entity_type") != UNKNOWN_TYPE).alias("known"), "n", "entity_type")
    best = counted.groupBy("entity_name").agg(F.max(F.struct(rank.alias("rank"))).alias("top"))
    ids = counted.join(best, "entity_name").where(rank == F.col("top.rank")).groupBy("entity_name").agg(F.min("entity_id").alias("entity_id"))
    return ids.join(preferred.select("entity_name", F.col("entity_id").alias("old")), "entity_name", "left").select("entity_name", F.coalesce("old", "entity_id").alias("entity_id"))


def identities(facts: DataFrame, previous: DataFrame) -> DataFrame:
    """(entity_id, entity_name, canonical_id) for each id and name that occur together in facts(entity_id, entity_name, entity_type): ids that share a name, also over other ids and names, are one entity and get one canonical id.

    The canonical id is one that previous(entity_id, entity_name, canonical_id) had as such, as long as facts
    have it (the smallest of several); else it is chosen by canonical_entities(). An id that shares no name
    is its own. Ids meet through the smallest id of each name, so no name pairs all of its ids.
    """
    each = materialize(facts.select("entity_id", "entity_name").distinct())
    hubs = each.groupBy("entity_name").agg(F.min("entity_id").alias("src"), F.count("*").alias("n")).where("n > 1")
    links = materialize(each.join(hubs, "entity_name").where("entity_id <> src").select("src", F.col("entity_id").alias("dst")).distinct())
    own = each.withColumn("canonical_id", F.col("entity_id"))
    if links.isEmpty():
        return own
    nodes = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    groups = materialize(graph.components(nodes, links).select(F.col("id").alias("entity_id"), F.col("component").alias("group")))
    before = groups.join(previous.select(F.col("canonical_id").alias("entity_id")).distinct(), "entity_id", "left_semi").groupBy("group").agg(F.min("entity_id").alias("entity_id"))
    counted = facts.join(groups, "entity_id").select(F.col("group").alias("entity_name"), "entity_id", "entity_type")
    chosen = canonical_entities(counted, before.withColumnRenamed("group", "entity_name")).select(F.col("entity_name").alias("group"), F.col("entity_id").alias("chosen"))
    found = groups.join(chosen, "group").select("entity_id", "chosen")
    return own.join(found, "entity_id", "left").select("entity_id", "entity_name", F.coalesce("chosen", "canonical_id").alias("canonical_id"))


def remap_of(identities: DataFrame) -> DataFrame:
    """(old_id, new_id): the ids of identities that aren't canonical, with the ones that are."""
    return identities.where("entity_id <> canonical_id").select(F.col("entity_id").alias("old_id"), F.col("canonical_id").alias("new_id")).distinct()


def remap_entities(rows: DataFrame, remap: DataFrame) -> DataFrame:
    """rows(entity_id, ...) with the ids that remap(old_id, new_id) names replaced."""
    return rows.join(remap, F.col("entity_id") == F.col("old_id"), "left").withColumn("entity_id", F.coalesce("new_id", "entity_id")).drop("old_id", "new_id")


def contributions(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(key, doc_id): a row for each document that contributes to an entity, an entity name or a relationship."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}::"), F.col(c)).alias("key")
    return entities.select(key("entity", "entity_id"), "doc_id").union(entities.select(key("entity_name", "entity_name"), "doc_id")).union(rels.select(key("relationship", "relationship_id"), "doc_id")).distinct()


def contribution_index(entities: DataFrame, rels: DataFrame, entity: str = "entity_id", relationship: str = "relationship_id", named: Callable[[str, Column], Column] = lambda kind, c: c, name: str = "entity_name") -> DataFrame:
    """(key, doc_ids): which documents contribute to each entity, entity name and relationship. A view over the facts, so it is never stale.

    entity, name, relationship: the columns that tell them apart, which named(kind, column) turns into their part of the key; short ones make short rows. If one column tells entities and names apart, its rows move once for both.
    """
    kinds = {"entity": (entities, entity), "entity_name": (entities, name), "relationship": (rels, relationship)}
    rows = None
    for i, (kind, (facts, c)) in enumerate(kinds.items()):
        if kind == "entity_name" and name == entity:
            continue
        number = F.when(F.col(c).isNull(), 0).otherwise(i).cast("byte")  # null is one key, whatever its kind
        each = facts.select(number.alias("kind"), F.col(c).alias("__key"), "doc_id")
        rows = rows.union(each) if rows else each
    lists = rows.repartition("kind", "__key").groupBy("kind", "__key").agg(_values("doc_id").alias("doc_ids"))
    if name == entity:
        both = F.when((F.col("kind") == 0) & F.col("__key").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("kind").cast("int")))
        lists = lists.select(F.explode(both).alias("kind"), "__key", "doc_ids")
    key = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        key = F.when(F.col("kind") == i, F.concat(F.lit(f"{kind}::"), named(kind, F.col("__key")))).otherwise(key)
    return lists.select(key.alias("key"), "doc_ids")


def affected_documents(entities: DataFrame, rels: DataFrame, changed: DataFrame, entity: str = "entity_id", relationship: str = "relationship_id") -> DataFrame:
    """(doc_id): documents that share an entity, a name or a relationship with the changed ones, themselves included. entity, relationship: the columns that tell them apart.

    Keys of the changed documents are written first; unless they are very many, facts meet them where they are.
    """
    ids = changed.select("doc_id").distinct()
    few = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    own = {name: materialize(facts.join(few(ids), "doc_id", "left_semi").select(*columns).distinct()) for name, facts, columns in (("e", entities, [entity, "entity_name"]), ("r", rels, [relationship]))}
    touched = lambda facts, name, c: facts.join(few(own[name].select(c).distinct()), c, "left_semi").select("doc_id")
    return touched(entities, "e", entity).union(touched(entities, "e", "entity_name")).union(touched(rels, "r", relationship)).distinct()


def remap_relationships(rels: DataFrame, remap: DataFrame) -> DataFrame:
    """rels with ends that remap(old_id, new_id) names replaced; ends that meet go."""
    a, b = (remap.select(F.col("old_id").alias(f"{x}_old"), F.col("new_id").alias(f"{x}_new")) for x in "ab")
    out = rels.join(a, F.col("src") == F.col("a_old"), "left").join(b, F.col("tgt") == F.col("b_old"), "left")
    out = out.withColumns({"src": F.coalesce("a_new", "src"), "tgt": F.coalesce("b_new", "tgt")}).drop("a_old", "a_new", "b_old", "b_new")
    return out.where("src <> tgt")


def integrity(manifest: DataFrame, nodes: DataFrame) -> DataFrame:
    """(expected, found): distinct entities of a manifest, and how many of them the graph has."""
    ids = manifest.select("entity_id").distinct()
    return ids.agg(F.count("*").alias("expected")).crossJoin(F.broadcast(ids.join(nodes.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").agg(F.count("*").alias("found"))))


def needs_summary(descriptions: DataFrame, tokens: Column, least: int = 500) -> tuple[DataFrame, DataFrame]:
    """(short, long): rows that keep their description, and those that a model should summarise."""
    counted = descriptions.withColumn("tokens", tokens)
    return counted.where(F.col("tokens") < least), counted.where(F.col("tokens") >= least)


