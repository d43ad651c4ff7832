"""Entity registry: names and aliases, exact and fuzzy resolution, mentions in texts, linking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fuzzy_ratio, registry_name, relationship_id
from ..sources.store import materialize


def register(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """registry(entity_id, canonical_name, entity_type, aliases, metadata, reg_order) with rows put in: aliases and metadata are merged, name, type and order replaced."""
    old = registry.select("entity_id", F.col("aliases").alias("old_aliases"), F.col("metadata").alias("old_metadata"))
    new = rows.join(old, "entity_id", "left")
    none = F.array().cast("array<string>")
    aliases = F.array_sort(F.array_union(F.coalesce("old_aliases", none), F.coalesce("aliases", none)))
    fresh = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    metadata = F.map_concat(F.map_filter(F.coalesce("old_metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    merged = new.select("entity_id", "canonical_name", "entity_type", aliases.alias("aliases"), metadata.alias("metadata"), "reg_order")
    return registry.join(rows.select("entity_id"), "entity_id", "left_anti").select(*merged.columns).unionByName(merged)


def add_aliases(registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """registry with the aliases of aliases(entity_id, alias) that differ from the name once normalised."""
    found = aliases.groupBy("entity_id").agg(F.collect_set("alias").alias("found"))
    fits = F.filter(F.coalesce("found", F.array().cast("array<string>")), lambda a: registry_name(a) != registry_name(F.col("canonical_name")))
    return registry.join(found, "entity_id", "left").withColumn("aliases", F.array_sort(F.array_union("aliases", fits))).drop("found")


def alias_index(registry: DataFrame) -> DataFrame:
    """(name, entity_id): normalised names and aliases; the last registration wins a name."""
    rows = registry.select("entity_id", "reg_order", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("raw")).select("entity_id", "reg_order", registry_name(F.col("raw")).alias("name"))
    return rows.groupBy("name").agg(F.max_by("entity_id", F.struct("reg_order", "entity_id")).alias("entity_id"))


def resolve_exact(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """queries(query_id, name) with entity_id, null if no name or alias is the same once normalised."""
    index = alias_index(registry).withColumnRenamed("name", "__name")
    return queries.withColumn("__key", registry_name(F.col("name"))).join(index, F.col("__key") == F.col("__name"), "left").drop("__key", "__name")


def _letters(name: Column) -> Column:
    """A name's letters, each with its number among equal ones: a bag as a set."""
    letters = F.split(name, "")
    return F.transform(F.filter(letters, lambda c: c != ""), lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).cast("string")))


def _pairs_of_letters(name: Column) -> Column:
    """A name's pairs of letters that follow each other, each with its number among equal ones."""
    pairs = F.transform(F.sequence(F.lit(0), F.length(name) - 2), lambda i: F.substring(name, i + 1, F.lit(2)))
    return F.transform(F.array(pairs), lambda p: F.transform(p, lambda x, i: F.concat(x, F.size(F.filter(F.slice(p, 1, i + 1), lambda y: y == x)).cast("string"))))[0]


def rare_prefix(features: DataFrame, need: Column) -> DataFrame:
    """(name, n, feature): of each name's features(name, n, size, feature) the rarest, as many as there are beyond `need`, and one. Two names that share `need` features share one of these."""
    uses = features.groupBy("feature").agg(F.count("*").alias("uses"))
    ordered = features.join(uses, "feature").groupBy("name", "n", "size").agg(F.array_sort(F.collect_list(F.struct("uses", "feature"))).alias("l"))
    return ordered.select("name", "n", F.explode(F.slice("l", F.lit(1), (F.col("size") - need + 1).cast("int"))).alias("l")).select("name", "n", "l.feature")


def near_names(asked: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(a, b, na, nb): names of asked(a) and names(b), with their lengths, that can have a ratio of at least threshold; none that has is missing.

    A ratio of t asks for m = t (a + b) / 2 equal letters in blocks between which at least one letter is
    left over, a + b - 2 m in all: so for 3 m - (a + b) - 1 equal pairs of letters, and b is t / (2 - t) a
    or longer. Names long enough for that to be one or more meet at one of their rarest pairs of letters;
    shorter ones, and all below thresholds of two thirds, at one of their rarest letters, of which they
    share t / (2 - t) a. What meets is cut by length and by common letters inside the join, so pairs that
    can't be near are never written, and then by common pairs of letters.
    """
    t = threshold
    every = materialize(names.select(F.col("b").alias("name")).union(asked.select("a")).where("name <> ''").distinct().withColumns({"n": F.length("name"), "bag": _letters(F.col("name"))}))
    least_pairs = F.ceil(F.col("n") * (2 / (2 - t) * (1.5 * t - 1)) - 1 - 1e-9)
    long_ = (least_pairs >= 1) & (F.col("n") >= 2)
    pairs = materialize(every.where(long_).select("name", "n", _pairs_of_letters(F.col("name")).alias("pairs")))
    side = lambda prefix, of, c: prefix.join(of.select(F.col(c).alias("name")).distinct(), "name", "left_semi").join(numbered, "name").select(F.col("name").alias(c), F.col("n").alias(f"n{c}"), F.col("codes").alias(f"codes_{c}"), "feature")
    # letters as numbers, which are compared faster than texts
    numbered = every.select("name", F.transform("bag", lambda x: F.ascii(x) * F.lit(1 << 32) + F.substring(x, F.lit(2), F.length(x)).cast("long")).alias("codes"))
    sums = F.col("na") + F.col("nb")
    fits = F.when(2 * F.least("na", "nb") < t * sums - 1e-9, False).otherwise(2 * F.size(F.array_intersect("codes_a", "codes_b")) >= t * sums - 1e-9)

    by_pair = rare_prefix(pairs.select("name", "n", F.size("pairs").alias("size"), F.explode("pairs").alias("feature")), least_pairs)
    met = side(by_pair, asked, "a").join(side(by_pair, names, "b"), "feature").where(fits).select("a", "b", "na", "nb").distinct()
    of = lambda c: pairs.select(F.col("name").alias(c), F.col("pairs").alias(f"pairs_{c}"))
    shared = F.size(F.array_intersect("pairs_a", "pairs_b"))
    met = met.join(of("a"), "a").join(of("b"), "b").where(shared >= (F.col("na") + F.col("nb")) * (1.5 * t - 1) - 1 - 1e-9).select("a", "b", "na", "nb")

    some = every.where(~long_)  # and names of their lengths
    reach = some.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    few = every.crossJoin(F.broadcast(reach)).where(F.col("n") * t <= F.col("most") * (2 - t) + 1e-9).drop("most")  # a table of one row
    by_letter = rare_prefix(few.select("name", "n", F.size("bag").alias("size"), F.explode("bag").alias("feature")), F.ceil(F.col("n") * (t / (2 - t)) - 1e-9))
    by_letter = by_letter.withColumn("long", long_)
    ends = [side(by_letter.where(w), x, c) for x, c in ((asked, "a"), (names, "b")) for w in ("not long", "long")]
    meet = lambda x, y: x.join(y, "feature").where(fits).select("a", "b", "na", "nb")
    short = meet(ends[0], ends[2]).union(meet(ends[0], ends[3])).union(meet(ends[1], ends[2])).distinct()
    return met.union(short).distinct()


def fuzzy_pairs(queries: DataFrame, registry: DataFrame, threshold: float) -> DataFrame:
    """(query_id, entity_id, reg_order, score, entity_type, query_type): names with a ratio of at least threshold, which is above 0. Only pairs of near_names() are compared. Names without letters match nothing."""
    names = registry.select("entity_id", "reg_order", "entity_type", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("raw")).select("entity_id", "reg_order", "entity_type", registry_name(F.col("raw")).alias("b")).distinct()
    asked = queries.select("query_id", F.coalesce("entity_type", F.lit("")).alias("query_type"), registry_name(F.col("name")).alias("a"))
    near = near_names(asked, names, threshold)
    scored = near.select("a", "b", fuzzy_ratio(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= threshold)
    return asked.join(scored, "a").join(names, "b").groupBy("query_id", "entity_id", "reg_order", "entity_type", "query_type").agg(F.max("score").alias("score"))


def _unmatched(queries: DataFrame, exact: DataFrame) -> DataFrame:
    """queries(query_id, ...) without an exact match in exact(query_id, exact); only these are compared with other names."""
    return queries.join(exact.where("exact is null").select("query_id"), "query_id", "left_semi")


def resolve_fuzzy(queries: DataFrame, registry: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(query_id, entity_id): the exact match, or else the first registered entity whose ratio is enough."""
    exact = materialize(resolve_exact(queries, registry).select("query_id", F.col("entity_id").alias("exact")))
    near = fuzzy_pairs(_unmatched(queries, exact), registry, threshold).groupBy("query_id").agg(F.min_by("entity_id", "reg_order").alias("near"))
    return exact.join(near, "query_id", "left").select("query_id", F.coalesce("exact", "near").alias("entity_id"))


def candidates(queries: DataFrame, registry: DataFrame, threshold: float = 0.92, limit: int = 3) -> DataFrame:
    """(query_id, entity_id, score, rank): the best entities of the query's type, or of unknown type on either side."""
    from pyspark.sql.window import Window

    near = fuzzy_pairs(queries, registry, threshold)
    open_ = F.col("entity_type").isin("", '"UNKNOWN"', "UNKNOWN") | F.col("query_type").isin("", '"UNKNOWN"', "UNKNOWN")
    near = near.where(open_ | (F.col("entity_type") == F.col("query_type")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "reg_order"))
    return near.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "entity_id", "score", "rank")


#: Names that each text is compared with where it is read.
FEW_NAMES = 64


def mentions(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """(text_id, entity_id): entities of which a name or alias is part of the text, whatever the case; one row for each.

    Up to FEW_NAMES names are compared with each text where it is read. Of more, a name is looked for where
    its rarest letter triple stands, so no text meets every name: triples of texts, ids only and none that
    no name has, meet triples of names in a hash join; the texts of what is left are fetched after and
    compared. Names of one or two letters meet letters and pairs.
    """
    names = materialize(registry.select("entity_id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("raw")).select("entity_id", F.lower("raw").alias("name")).where("name <> ''").distinct())
    low = texts.where("text <> ''").select("text_id", F.lower("text").alias("text"))
    if names.count() <= FEW_NAMES:
        return low.join(F.broadcast(names), F.contains("text", "name")).select("text_id", "entity_id").distinct()
    letters = lambda c: F.split(c, "")
    at = lambda w, i: F.coalesce(F.get(w, i), F.lit(""))  # noqa: E731  letters of an array, as a substring walks the text from its start
    runs = lambda w, n: F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.concat(*[at(w, i + j) for j in range(n)]))
    distinct = lambda c, n: F.transform(F.array(letters(c)), lambda w: F.array_distinct(runs(w, n)))[0]
    inside = materialize(names.where(F.length("name") >= 3).select("entity_id", "name", F.explode(F.filter(distinct(F.col("name"), 3), lambda g: F.length(g) == 3)).alias("gram")))
    grams = materialize(low.select("text_id", F.explode(distinct(F.col("text"), 3)).alias("gram")).join(inside.select("gram").distinct(), "gram", "left_semi").select("text_id", "gram").distinct())
    uses = grams.groupBy("gram").agg(F.count("*").alias("uses"))
    rare = inside.join(uses, "gram", "left").groupBy("entity_id", "name").agg(F.min_by("gram", F.struct(F.coalesce("uses", F.lit(0).cast("long")).alias("u"), "gram")).alias("gram"))
    met = grams.join(rare, "gram").select(F.col("text_id").alias("__id"), "entity_id", "name")
    found = low.join(met, F.col("text_id").eqNullSafe(F.col("__id"))).where(F.contains("text", "name")).select("text_id", "entity_id")
    few = names.where(F.length("name") < 3).select("entity_id", F.col("name").alias("gram"))
    short = low.select("text_id", F.explode(F.array_distinct(F.concat(distinct(F.col("text"), 1), distinct(F.col("text"), 2)))).alias("gram")).join(few, "gram").select("text_id", "entity_id")
    return found.union(short).distinct()


def link_manifest(manifest: DataFrame, registry: DataFrame, threshold: float = 0.92, decide: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """manifest(entity_id, entity_name, entity_type, ...) with linked_id: the exact registry entity, or else the only fuzzy candidate, or else the one of several that a model decides for, or else its own id.

    decide: a model asked with the name and the candidates' ids and names; its answer {"entity_id": ...} counts
    if that is one of them.
    """
    queries = manifest.select(F.col("entity_id").alias("query_id"), F.col("entity_name").alias("name"), "entity_type").dropDuplicates(["query_id"])
    exact = materialize(resolve_exact(queries, registry).select("query_id", F.col("entity_id").alias("exact")))
    near = candidates(_unmatched(queries, exact), registry, threshold, 3).join(registry.select("entity_id", "canonical_name"), "entity_id")
    near = near.groupBy("query_id").agg(F.count("*").alias("n"), F.first("entity_id").alias("only"), F.array_sort(F.collect_list(F.struct("rank", "entity_id", "canonical_name"))).alias("options"))
    links = materialize(exact.join(near, "query_id", "left"))
    chosen = F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")))
    if decide:
        from .extraction import call_model

        asked = links.where("exact is null and n > 1").join(queries, "query_id").select("query_id", "name", "options")
        listed = F.array_join(F.transform("options", lambda o: F.concat(o["entity_id"], F.lit(": "), o["canonical_name"])), "\n")
        told = call_model(asked, F.concat(F.lit("Which of these is "), "name", F.lit('? Answer {"entity_id": ...}\n'), listed), decide)
        said = F.from_json("output", "entity_id string")["entity_id"]
        links = links.join(told.where(F.array_contains(F.transform("options", lambda o: o["entity_id"]), said)).select("query_id", said.alias("decided")), "query_id", "left")
        chosen = F.coalesce(chosen, F.col("decided"))
    links = links.select(F.col("query_id").alias("entity_id"), chosen.alias("found"))
    return manifest.join(links, "entity_id", "left").withColumn("linked_id", F.coalesce("found", "entity_id")).drop("found")


def apply_links(entities: DataFrame, rels: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with entity ids replaced by the linked ones: entities meet under one id, relationships get the keys of their new ends, those whose ends meet go."""
    remap = linked.where("linked_id <> entity_id").select(F.col("entity_id").alias("old_id"), F.col("linked_id").alias("new_id")).distinct()
    e = entities.join(remap, F.col("entity_id") == F.col("old_id"), "left").withColumn("entity_id", F.coalesce("new_id", "entity_id")).drop("old_id", "new_id")
    r = rels
    for end in ("src_id", "tgt_id"):
        r = r.join(remap, F.col(end) == F.col("old_id"), "left").withColumn(end, F.coalesce("new_id", end)).drop("old_id", "new_id")
    return e, r.where("src_id <> tgt_id").withColumn("relationship_id", relationship_id(F.col("src_id"), F.col("tgt_id"), F.col("relation_type")))


def remove(registry: DataFrame, gone: DataFrame) -> DataFrame:
    """registry without the entities of gone(entity_id), and so without their names."""
    return registry.join(gone.select("entity_id").distinct(), "entity_id", "left_anti")


def by_type(registry: DataFrame, kind: str) -> DataFrame:
    return registry.where(F.col("entity_type") == kind)


def export_registry(registry: DataFrame, path: str) -> None:
    """JSON lines, one an entity, aliases as a list, in the order of registration."""
    registry.select("entity_id", "canonical_name", "entity_type", "aliases", "metadata", "reg_order").orderBy("reg_order", "entity_id").write.mode("overwrite").json(path)


def import_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("entity_id string, canonical_name string, entity_type string, aliases array<string>, metadata map<string,string>, reg_order long").json(path)
