"""Graph-shaped tables derived from the relational ones, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


def entity_id(key: Column) -> Column:
    """The id of a lower-case name."""
    return F.concat(F.lit("entity_"), F.sha2(F.concat(F.lit("default:"), key), 256))


def relationship_id(key: Column) -> Column:
    """The id of both ends in order and the type, with bars between."""
    return F.concat(F.lit("rel_"), F.sha2(key, 256))


def _ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their orders' customers, a document's lines in one partition: they move while they are numbers."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey", "l_suppkey").repartition("l_orderkey")
    return lines.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def chunk_id(doc: Column, line: Column) -> Column:
    return F.concat_ws("-", doc.cast("string"), line.cast("string"))


def _number(kind: int, a: Column | str, b: Column | str | None = None) -> Column:
    """What names an entity or a relationship, as numbers."""
    long = lambda c: (F.lit(c) if c is None else F.col(c)).cast("long")
    return F.struct(F.lit(kind).cast("byte").alias("kind"), long(a).alias("a"), long(b).alias("b"))


def entity_type(no: Column) -> Column:
    return F.when(no["kind"] == 0, "CUSTOMER").when(no["kind"] == 1, "PART").otherwise("SUPPLIER")


def entity_name(no: Column) -> Column:
    return F.concat(entity_type(no), F.lit("#"), no["a"].cast("string"))


def relationship_ends(no: Column) -> dict[str, Column]:
    """src, tgt and relation_type of a relationship's numbers."""
    bought = no["kind"] == 0
    src = F.concat(F.when(bought, "CUSTOMER#").otherwise("SUPPLIER#"), no["a"].cast("string"))
    return {"src": src, "tgt": F.concat(F.lit("PART#"), no["b"].cast("string")), "relation_type": F.when(bought, "BOUGHT").otherwise("SUPPLIES")}


def relationship_key(no: Column) -> Column:
    """What a relationship's id is made of."""
    src, tgt, kind = relationship_ends(no).values()
    return F.concat_ws("|", F.least(src, tgt), F.greatest(src, tgt), F.lower(kind))


def doc_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of manifests: an order is a document, its lines are chunks, customers, parts and suppliers are entities. Rows in order: ord. entity_key: what the id is made of; entity_no: what that is made of, null if it is null."""
    each = _ordered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("description"), F.explode(F.array(_number(0, "o_custkey"), _number(1, "l_partkey"), _number(2, "l_suppkey"))).alias("e"))
    no, name = F.col("e"), entity_name(F.col("e"))
    key = F.lower(name)
    return each.select("doc_id", entity_id(key).alias("entity_id"), key.alias("entity_key"), F.when(no["a"].isNotNull(), no).alias("entity_no"), name.alias("entity_name"), entity_type(no).alias("entity_type"), "description", chunk_id(F.col("doc_id"), F.col("line")).alias("chunk_id"), (F.col("line") * 10 + no["kind"]).cast("long").alias("ord"))


DOC_ENTITIES = """
l0 AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e0 AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, l_returnflag AS description, 'CUSTOMER#' || o_custkey AS entity_name, 'CUSTOMER' AS entity_type, 0 AS place FROM l0
 UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, 'PART#' || l_partkey, 'PART', 1 FROM l0
 UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, 'SUPPLIER#' || l_suppkey, 'SUPPLIER', 2 FROM l0),
ents AS (SELECT doc_id, 'entity_' || sha256('default:' || lower(entity_name)) AS entity_id, entity_name, entity_type, description, doc_id || '-' || line AS chunk_id, CAST(line * 10 + place AS BIGINT) AS ord FROM e0)
"""


def doc_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of manifests: a line links its order's customer with its part, and the part with its supplier. relationship_key: what the id is made of; relationship_no: what that, the ends and the type are made of."""
    each = _ordered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("ord"), "l_quantity", F.explode(F.array(_number(0, "o_custkey", "l_partkey"), _number(1, "l_suppkey", "l_partkey"))).alias("r"))
    no = F.col("r")
    key, weight = relationship_key(no), F.when(no["kind"] == 0, F.col("l_quantity")).otherwise(F.lit(1)).cast("double")
    return each.select("doc_id", relationship_id(key).alias("relationship_id"), key.alias("relationship_key"), no.alias("relationship_no"), *[c.alias(k) for k, c in relationship_ends(no).items()], weight.alias("weight"), chunk_id(F.col("doc_id"), F.col("ord")).alias("chunk_id"), "ord")


DOC_RELATIONSHIPS = """
l1 AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r0 AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, 'CUSTOMER#' || o_custkey AS src, 'PART#' || l_partkey AS tgt, 'BOUGHT' AS relation_type, CAST(l_quantity AS DOUBLE) AS weight FROM l1
 UNION ALL SELECT l_orderkey, l_linenumber, 'SUPPLIER#' || l_suppkey, 'PART#' || l_partkey, 'SUPPLIES', 1.0 FROM l1),
rels AS (SELECT doc_id, 'rel_' || sha256(least(src, tgt) || '|' || greatest(src, tgt) || '|' || lower(relation_type)) AS relationship_id, src, tgt, relation_type, weight, doc_id || '-' || line AS chunk_id, CAST(line AS BIGINT) AS ord FROM r0)
"""


#: Lines that one task sums up.
PART_LINES = 1_200_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Over how many tasks lines, or the edges that they give, are dealt."""
    return max(spark.sparkContext.defaultParallelism, -(-read(spark, sf_dir, "lineitem").count() // PART_LINES))


def _supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt by part over as many tasks as they need: what a task holds doesn't follow the table, and a part's edges lie in one task."""
    return read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey").repartition(tasks(spark, sf_dir), "l_partkey")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An undirected graph of suppliers, parts and nations over all orders: src < dst, weight, description, chunk."""
    supplies = _supplies(spark, sf_dir).groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"), F.min("l_orderkey").alias("o"))
    a = supplies.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"), "weight", F.concat(F.lit("c"), F.col("o").cast("string")).alias("chunk_id"))
    home = read(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("src"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("dst"), F.lit(2.0).alias("weight"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("chunk_id"))
    return a.unionByName(home)


EDGES = """
edges AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS weight, 'c' || min(l_orderkey) AS chunk_id FROM lineitem GROUP BY l_suppkey, l_partkey
 UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 2.0, 'n' || s_nationkey FROM supplier),
nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges(): distinct keys of its tables, for which no pair is summed."""
    key = lambda kind, c: F.struct(F.when(F.col(c).isNotNull(), kind).alias("kind"), F.col(c).cast("long").alias("key"))  # noqa: E731  null is one node, whatever its kind
    ends = _supplies(spark, sf_dir).select(F.inline(F.array(key("P", "l_partkey"), key("S", "l_suppkey"))))
    home = read(spark, sf_dir, "supplier").select(F.inline(F.array(key("N", "s_nationkey"), key("S", "s_suppkey"))))
    return ends.union(home).distinct().select(F.concat("kind", F.col("key").cast("string")).alias("id"))


def _customer(c: str) -> Column:
    return F.concat(F.lit("C"), F.col(c).cast("string"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of customers, ids as keys: level 0 by market segment, level 1 by segment and nation."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey")
    zero = c.select("id", F.lit(0).alias("level"), F.col("c_mktsegment").alias("cluster"))
    return zero.unionByName(c.select("id", F.lit(1).alias("level"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("cluster")))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """members() by name."""
    return members(spark, sf_dir).withColumn("id", _customer("id"))


MEMBERSHIP = """
membership AS (SELECT 'C' || c_custkey AS id, 0 AS level, c_mktsegment AS cluster FROM customer UNION ALL SELECT 'C' || c_custkey, 1, c_mktsegment || '-' || c_nationkey FROM customer)
"""


def customer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with consecutive keys, and customers of orders with consecutive keys, know each other: src < dst as keys, weight, chunk: the first order."""
    c = read(spark, sf_dir, "customer").select("c_custkey")
    chain = c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"), F.lit(0).cast("long").alias("o")).join(c.select(F.col("c_custkey").alias("b")), "b", "left_semi")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    near = o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("o_custkey").alias("a")).join(o, "o_orderkey").where("a <> o_custkey")
    both = chain.select("a", "b", "o").union(near.select("a", F.col("o_custkey").alias("b"), F.col("o_orderkey").alias("o")))
    return both.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").cast("double").alias("weight"), F.min("o").alias("chunk_id"))


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_links() by name."""
    a, b = _customer("src"), _customer("dst")
    return customer_links(spark, sf_dir).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "weight", F.concat(F.lit("o"), F.col("chunk_id").cast("string")).alias("chunk_id"))


CUSTOMER_EDGES = """
near0 AS (SELECT c_custkey AS a, c_custkey + 1 AS b, 0 AS o FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT x.o_custkey, y.o_custkey, y.o_orderkey FROM orders x JOIN orders y ON y.o_orderkey = x.o_orderkey + 1 WHERE x.o_custkey <> y.o_custkey),
cedges AS (SELECT least('C' || a, 'C' || b) AS src, greatest('C' || a, 'C' || b) AS dst, CAST(count(*) AS DOUBLE) AS weight, 'o' || min(o) AS chunk_id FROM near0 GROUP BY 1, 2)
"""
