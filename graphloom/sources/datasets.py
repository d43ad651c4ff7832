"""Question answering datasets from local JSON: questions(id, question, answer, supporting_facts) and corpus(id, title, content)."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array file with their position."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{schema}>>").alias("rows"))
    return text.select(F.posexplode("rows").alias("pos", "r")).select("pos", "r.*")


def questions(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows(pos, id, question, answer, supporting_facts) with default ids q_{pos}; the first `most` rows."""
    rows = rows.orderBy("pos").limit(most) if most is not None else rows
    return rows.select(F.coalesce("id", F.concat(F.lit("q_"), F.col("pos").cast("string"))).alias("id"), "question", "answer", "supporting_facts")


def corpus(rows: DataFrame, most: int | None = None, limit_first: bool = False) -> DataFrame:
    """rows(pos, id, title, content) with default ids doc_{pos}, blank contents dropped; most: before (limit_first) or after dropping."""
    rows = rows.orderBy("pos").limit(most) if most is not None and limit_first else rows
    kept = rows.where(F.regexp_replace("content", r"\s", "") != "")
    kept = kept.orderBy("pos").limit(most) if most is not None and not limit_first else kept
    return kept.select(F.coalesce("id", F.concat(F.lit("doc_"), F.col("pos").cast("string"))).alias("id"), "title", "content")


def distinct_contexts(rows: DataFrame) -> DataFrame:
    """(id, title, content): contexts array<struct<title, sentences>> of rows(pos, context), the first of each title; the id is the title's MD5."""
    each = rows.select("pos", F.posexplode("context").alias("at", "c")).select("pos", "at", "c.title", F.concat_ws("\n", "c.title", F.array_join("c.sentences", " ")).alias("content"))
    first = each.groupBy("title").agg(F.min_by("content", F.struct("pos", "at")).alias("content"))
    return first.select(F.md5("title").alias("id"), "title", "content")


def running_contexts(rows: DataFrame) -> DataFrame:
    """(id, title, content): every context array<struct<title, body>> of rows(pos, context), numbered as they come, none dropped. Numbers are sums of the rows before, by position range."""
    sizes = rows.select("pos", "context", F.size("context").alias("n"), F.floor(F.col("pos") / 10_000).alias("part"))
    totals = sizes.groupBy("part").agg(F.sum("n").alias("t"))
    before = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    inside = sizes.withColumn("inside", F.sum("n").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    each = inside.join(F.broadcast(before), "part").select((F.col("before") + F.col("inside")).alias("first"), F.posexplode("context").alias("at", "c"))
    return each.select(F.concat(F.lit("doc_"), (F.col("first") + F.col("at")).cast("string")).alias("id"), "c.title", F.col("c.body").alias("content"))


def merged_facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, corpus) of rows(pos, id, query, answer, evidence_list array<struct<title, fact>>): facts of a title joined by line feeds in order, a fact that the text so far has left out; titles numbered as they come.

    Facts of a title are one article's; other titles don't meet them.
    """
    each = rows.select("pos", F.posexplode("evidence_list").alias("at", "e")).select("pos", "at", F.coalesce("e.title", F.lit("")).alias("title"), F.coalesce("e.fact", F.lit("")).alias("fact"))
    first = F.struct("pos", "at")
    add = lambda text, x: F.when(F.contains(text, x["fact"]), text).when(text == "", x["fact"]).otherwise(F.concat(text, F.lit("\n"), x["fact"]))
    texts = each.where("title <> ''").groupBy("title").agg(F.min(first).alias("first"), F.array_sort(F.collect_list(F.struct("pos", "at", "fact"))).alias("facts"))
    texts = texts.select("title", "first", F.aggregate("facts", F.lit(""), add).alias("content"))
    facts = each.where("fact <> ''").groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "fact"))), lambda x: x["fact"]).alias("supporting_facts"))
    asked = rows.join(facts, "pos", "left").select(F.coalesce("id", F.concat(F.lit("multihoprag_"), F.col("pos").cast("string"))).alias("id"), F.col("query").alias("question"), "answer", F.coalesce("supporting_facts", F.array().cast("array<string>")).alias("supporting_facts"))
    return asked, _numbered(texts, "first", "doc_")


def supported_titles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, corpus) of rows(pos, id, question, answer, context array<struct<title, sentences>>, titles): sentences joined by spaces, the first text of each title; supporting facts are those of titles that the rows so far have as contexts."""
    each = rows.select("pos", F.posexplode("context").alias("at", "c")).select("pos", "at", "c.title", F.array_join("c.sentences", " ").alias("content"))
    docs = each.groupBy("title").agg(F.min_by("content", F.struct("pos", "at")).alias("content"), F.min("pos").alias("since"))
    wanted = rows.select("pos", F.posexplode("titles").alias("n", "title")).join(docs.select("title", "since"), "title").where(F.col("since") <= F.col("pos"))
    facts = wanted.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]).alias("supporting_facts"))
    asked = rows.join(facts, "pos", "left").select(F.coalesce("id", F.concat(F.lit("hotpot_"), F.col("pos").cast("string"))).alias("id"), "question", "answer", F.coalesce("supporting_facts", F.array().cast("array<string>")).alias("supporting_facts"))
    return asked, docs.select(F.concat(F.lit("hotpot_"), F.md5("title")).alias("id"), "title", "content")


def paragraphs(rows: DataFrame, most_facts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(questions, corpus) of rows(pos, id, question, answer, paragraphs array<struct<idx, title, paragraph_text>>, decomposition array<struct<answer>>): the first paragraph of each title and idx, numbered as they come; supporting facts are the answers of the first steps."""
    each = rows.select("pos", F.posexplode("paragraphs").alias("at", "p")).select("pos", "at", "p.title", "p.idx", F.col("p.paragraph_text").alias("content")).where("title <> '' and content <> ''")
    docs = each.groupBy("title", "idx").agg(F.min(F.struct("pos", "at", "content")).alias("f")).select("title", F.struct("f.pos", "f.at").alias("first"), F.col("f.content").alias("content"))
    steps = F.filter(F.transform("decomposition", lambda d: d["answer"]), lambda a: F.coalesce(a, F.lit("")) != "")
    asked = rows.select(F.coalesce("id", F.concat(F.lit("musique_"), F.col("pos").cast("string"))).alias("id"), "question", "answer", F.coalesce(F.slice(steps, 1, most_facts), F.array().cast("array<string>")).alias("supporting_facts"))
    return asked, _numbered(docs, "first", "musique_doc_")


def literal_contexts(text: Column) -> Column:
    """Contexts that are stored as a literal of nested lists [[title, [sentence, ...]], ...], in JSON or with single quotes."""

    def read(values: pd.Series) -> pd.Series:
        def one(v):
            for parse in (json.loads, ast.literal_eval):
                try:
                    return json.dumps([{"title": str(t), "sentences": [str(x) for x in (s if isinstance(s, list) else [s])]} for t, s in parse(v)])
                except (ValueError, SyntaxError, TypeError):
                    pass
            return "[]"

        return values.map(one, na_action="ignore")

    return F.from_json(F.pandas_udf(read, "string")(text), "array<struct<title:string,sentences:array<string>>>")


def _numbered(rows: DataFrame, order: str, prefix: str) -> DataFrame:
    """(id, title, content) with ids numbered in order, by range partitions and their sizes."""
    parts = materialize(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    return parts.join(F.broadcast(before), "part").select(F.concat(F.lit(prefix), rank.cast("string")).alias("id"), "title", "content")


#: Row schemas of the datasets' question files, by name.
SCHEMAS = {
    "multihop_rag": "id string, question string, answer string, supporting_facts array<string>",
    "hotpotqa": "id string, question string, answer string, supporting_facts array<string>",
    "musique": "id string, question string, answer string, supporting_facts array<string>",
    "2wiki": "id string, question string, answer string, supporting_facts array<string>",
}
CORPUS = "id string, title string, content string"


def load(spark: SparkSession, name: str, questions_path: str, corpus_path: str | None = None, most: int | None = None, most_corpus: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, corpus) of a dataset in local files; multihop_rag cuts its corpus before blank contents go, the others after."""
    if name not in SCHEMAS:
        raise ValueError(f"unknown dataset: {name}")
    if not corpus_path:
        raise ValueError(f"corpus_path is needed for {name}")
    asked = questions(read_rows(spark, questions_path, SCHEMAS[name].replace(" ", ":").replace(",:", ",")), most)
    return asked, corpus(read_rows(spark, corpus_path, CORPUS.replace(" ", ":").replace(",:", ",")), most_corpus, name == "multihop_rag")
