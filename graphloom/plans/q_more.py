"""Queries of existence, labels, budget rows, stale rows, registry look-ups and dataset readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import model as M
from ..operators import graph, registry
from ..sources import datasets
from . import fixtures as X
from . import reports
from .q_graph import _registry

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL for the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {X.EDGES}, q AS (SELECT dst AS src, src AS dst FROM edges UNION ALL SELECT id, 'gone' FROM nodes) SELECT q.src, q.dst, q.src IN (SELECT id FROM nodes) AND q.dst IN (SELECT id FROM nodes) AS both_nodes, e.src IS NOT NULL AS is_edge FROM q LEFT JOIN edges e ON least(q.src, q.dst) = e.src AND greatest(q.src, q.dst) = e.dst")
def graph_existence(s, d):
    """Whether nodes and edges exist, asked for in the other direction and with a node that the graph lacks."""
    e, n = X.edges(s, d), X.nodes(s, d)
    asked = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).union(n.select("id", F.lit("gone")))
    return graph.existence(asked, n, e)


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(coalesce(lang, '') || '/' || doc_id || '-' || coalesce(source, ''), '[^A-Za-z0-9_]', '_', 'g'), '^([0-9])', '_\1') AS label, sha256('"' || replace(coalesce(text, ''), '"', '""') || '","' || doc_id || '"') AS row_text FROM documents""")
def labels_and_rows(s, d):
    """Namespaces as labels, and CSV rows with doubled quotes as they are counted against a budget."""
    docs = X.read(s, d, "documents")
    name = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("-"), F.coalesce("source", F.lit("")))
    return docs.select("doc_id", M.label(name).alias("label"), F.sha2(reports.budget_row(F.col("text"), F.col("doc_id")), 256).alias("row_text"))


@query(f"WITH {X.MEMBERSHIP} SELECT DISTINCT cluster || CASE WHEN level = 0 THEN '' ELSE ' old' END AS cluster FROM membership WHERE level = 1")
def stale_reports(s, d):
    """Reports of clusters under names that the schema no longer has."""
    m = X.membership(s, d)
    old = m.select(F.concat("cluster", F.when(F.col("level") == 0, "").otherwise(" old")).alias("cluster"))
    return reports.stale_reports(old, m.select("level", "cluster"))


@query("SELECT 's' || s_suppkey AS entity_id, s_name AS canonical_name FROM supplier WHERE s_nationkey >= 5")
def registry_remove(s, d):
    r = _registry(s, d)
    left = registry.remove(r, r.where("cast(metadata['nation'] as int) < 5").select("entity_id"))
    return registry.by_type(left, "SUPPLIER").select("entity_id", "canonical_name")


@query("SELECT coalesce(CASE WHEN conv_id % 2 = 0 THEN 'id' || conv_id || '-' || turn END, 'q_' || pos) AS id, question, answer FROM (SELECT conv_id, turn, text AS question, role AS answer, conv_id * 1000 + turn AS pos FROM conversations) ORDER BY pos LIMIT 200")
def dataset_questions(s, d):
    """The first 200 questions, with default ids for those without one."""
    c = X.read(s, d, "conversations")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("id"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))).alias("id"), F.col("text").alias("question"), F.col("role").alias("answer"), F.array().cast("array<string>").alias("supporting_facts"))
    return datasets.questions(rows, 200).select("id", "question", "answer")


@query("SELECT 'doc_' || doc_id AS id, source AS title, md5(text) AS content FROM documents WHERE regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''")
def dataset_corpus(s, d):
    """Documents as a corpus: default ids, blank contents dropped; each content as its digest."""
    rows = X.read(s, d, "documents").select(F.col("doc_id").alias("pos"), F.lit(None).cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"))
    return datasets.corpus(rows).withColumn("content", F.md5("content"))


@query("""WITH e AS (SELECT conv_id AS pos, turn AS n, 't' || (conv_id % 40) AS title, role AS fact FROM conversations), f AS (SELECT title, fact, min((pos, n)) AS first FROM e GROUP BY 1, 2)
SELECT 'doc_' || (row_number() OVER (ORDER BY min(first)) - 1) AS id, title, string_agg(fact, chr(10) ORDER BY first) AS content FROM f GROUP BY title""")
def dataset_merged_facts(s, d):
    """Facts of one title joined once each, titles numbered as they come; here no fact is part of another."""
    rows = X.read(s, d, "conversations").groupBy(F.col("conv_id").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.struct(F.concat(F.lit("t"), (F.col("conv_id") % 40).cast("string")).alias("title"), x["role"].alias("fact"))).alias("evidence_list"))
    rows = rows.select("pos", F.lit(None).cast("string").alias("id"), F.lit("").alias("query"), F.lit("").alias("answer"), "evidence_list")
    return datasets.merged_facts(rows)[1]
