"""Calls of language models: message shapes, and answers kept by the hash of their arguments.

A model is a function from a list of prompts to a list of answers, applied to Arrow batches on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store, materialize

Model = Callable[[list[str]], list[str]]


def messages(prompt: str, answer: str | None = None, *more: str, shape: str = "plain") -> list[dict]:
    """User and assistant turns in order, as {"role", "content"}; shape "blocks": contents are lists of {"text"}."""
    turns = [t for t in (prompt, answer, *more) if t is not None]
    content = (lambda t: [{"text": t}]) if shape == "blocks" else (lambda t: t)
    return [{"role": "assistant" if i % 2 else "user", "content": content(t)} for i, t in enumerate(turns)]


def label(namespace: Column) -> Column:
    """A namespace as a label: other characters than letters, digits and underscores become underscores, and a digit in front gets one."""
    name = F.regexp_replace(namespace, r"[^A-Za-z0-9_]", "_")
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)


def args_hash(*args: Column) -> Column:
    """A key of a call's arguments; null and empty ones differ."""
    return F.md5(F.to_json(F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)]), {"ignoreNullFields": "false"}))


class AnswerCache:
    """Answers of models as a table (args_hash, model, prefix, answer) in a store."""

    SCHEMA = "args_hash string, model string, prefix string, answer string"

    def __init__(self, store: Store, name: str = "answers"):
        self.store, self.name = store, name

    def rows(self) -> DataFrame:
        return self.store.read(self.name) if self.store.has(self.name) else self.store.spark.createDataFrame([], self.SCHEMA)

    def put(self, rows: DataFrame) -> None:
        """Add rows of the table's columns; the last answer to a key counts."""
        fresh = materialize(rows.select("args_hash", "model", "prefix", "answer").dropDuplicates(["args_hash"]))
        self.store.commit(**{self.name: self.rows().join(fresh.select("args_hash"), "args_hash", "left_anti").unionByName(fresh)})

    def clear(self, prefix: str | None = None) -> None:
        """Forget all answers, or those of a prefix."""
        self.store.commit(**{self.name: self.rows().where(F.col("prefix") != prefix) if prefix else self.store.spark.createDataFrame([], self.SCHEMA)})

    def call(self, rows: DataFrame, prompt: Column, ask: Callable[[DataFrame, Column], DataFrame], model: str = "model", prefix: str = "") -> DataFrame:
        """rows with output: kept answers, and those of ask(rows, prompt) -> rows with output, for prompts not yet known, each asked once; they are kept."""
        keyed = rows.withColumn("args_hash", args_hash(F.lit(model), F.lit(prefix), prompt)).withColumn("prompt", prompt)
        known = self.rows().select("args_hash", F.col("answer").alias("output"))
        todo = keyed.select("args_hash", "prompt").dropDuplicates(["args_hash"]).join(known.select("args_hash"), "args_hash", "left_anti")
        told = materialize(ask(todo, F.col("prompt")).select("args_hash", "output"))
        self.put(told.where("output is not null").select("args_hash", F.lit(model).alias("model"), F.lit(prefix).alias("prefix"), F.col("output").alias("answer")))
        return keyed.join(self.rows().select("args_hash", F.col("answer").alias("output")), "args_hash", "left").drop("args_hash", "prompt")
