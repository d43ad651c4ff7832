"""Helpers for distributed plans: tables in the shared folder, joins under skew, components."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast when its rows have a fixed size of some tens of bytes.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch: 10,000 texts, Spark's own number, may be gigabytes at once where texts are long.
ARROW_ROWS = 1000
_made: list[tuple[SparkSession, str]] = []


def in_one_process(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; local-cluster has executors of its own."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary folder only where it is unset and Spark runs in one process."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not in_one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = tempfile.mkdtemp(prefix="graphloom-")
    spark.sparkContext.setCheckpointDir(set_to)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors lose nothing of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone by now
            return


def row_key(*columns: str | Column) -> Column:
    """A 64-bit key of a row's columns that also tells nulls apart from empty texts."""
    found = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*[x for c in found for x in (c, c.isNull())])


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of short rows if its counted rows are few enough; else leave it to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def small_batches(df: DataFrame) -> DataFrame:
    """df, for functions over Arrow batches of texts; the session's batches have at most ARROW_ROWS rows from here on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= ARROW_ROWS:
        df.sparkSession.conf.set(name, str(ARROW_ROWS))
    return df


def free_names(columns: list[str], *names: str) -> list[str]:
    """Each name, lengthened by underscores until no column has it, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df, dots in their names taken literally."""
    return [F.col(f"`{c}`") for c in df.columns]


def matching(docs: DataFrame, keys: DataFrame, rows: int, key: Column, how: str) -> DataFrame:
    """docs semi- or anti-joined with keys(doc_id, row_key) by doc_id and by key, a column of docs; nulls equal nulls."""
    id_, row = free_names(docs.columns, "__id", "__row")
    named = keys.select(F.col("doc_id").alias(id_), F.col("row_key").alias(row))
    return docs.join(small_or_shuffled(named, rows), F.col("doc_id").eqNullSafe(F.col(id_)) & (key == F.col(row)), how)


def keep_marked(docs: DataFrame, marks: DataFrame, key: Column) -> DataFrame:
    """Rows of docs that marks(doc_id, row_key, kept) keeps; key computes row_key from a row of docs.

    Only ids and keys are joined back, so long texts are not shuffled unless very many rows go. Where
    marks keep one of several rows with one doc_id and key, one row stays even if other columns differ:
    the first by its JSON text. Where they keep all of them, all stay. Columns may be of any type that
    JSON has, maps included.
    """
    fate = materialize(marks.groupBy("doc_id", "row_key").agg(F.sum(F.col("kept").cast("long")).alias("left"), F.count("*").alias("n")), "marks")
    gone, repeated = fate.where("left = 0"), fate.where("left > 0 and left < n")
    n_gone, n_repeated = gone.count(), repeated.count()
    out = matching(docs, gone, n_gone, key, "left_anti") if n_gone else docs
    if not n_repeated:
        return out
    row = F.struct(*columns_of(docs))
    again = matching(docs, repeated, n_repeated, key, "left_semi").select(F.col("doc_id"), key.alias("key"), row.alias("row"))
    once = again.groupBy("doc_id", "key").agg(F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row")).select("row.*")
    return matching(out, repeated, n_repeated, key, "left_anti").unionByName(once)


def attach(rows: DataFrame, facts: DataFrame, key: str, size: str, salt: Column, total: int, parts: int = 2000, extra: list[str] | None = None) -> DataFrame:
    """Left join of rows with facts (one row for each key) when some keys hold a large share of the rows.

    size: column of facts with the number of rows of that key; total: the rows. Keys with over
    total / parts rows are fewer than `parts`, so those facts can be broadcast whatever the input is.
    Rows of such keys take a salt in place of the key and spread over the shuffle of the others.
    extra: more columns that must agree.
    """
    extra = extra or []
    least = max(total // parts, 1000)
    values = [c for c in facts.columns if c not in {key, *extra}]

    def renamed(df: DataFrame, mark: str) -> DataFrame:
        return df.select(F.col(key).alias(f"__{mark}_key"), *[F.col(c).alias(f"__{mark}_x{i}") for i, c in enumerate(extra)], F.struct(*values).alias(f"__{mark}"))

    def equal(mark: str, left: Column) -> Column:
        out = left == F.col(f"__{mark}_key")
        for i, c in enumerate(extra):
            out &= F.col(c).eqNullSafe(F.col(f"__{mark}_x{i}"))
        return out

    heavy, light = renamed(facts.where(F.col(size) > least), "h"), renamed(facts.where(F.col(size) <= least), "l")
    out = rows.join(F.broadcast(heavy), equal("h", F.col(key)), "left")
    out = out.withColumn("__k", F.when(F.col("__h").isNull(), F.col(key)).otherwise(salt))
    out = out.join(light, equal("l", F.col("__k")) & F.col("__h").isNull(), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col("__h")[c], F.col("__l")[c]).alias(c) for c in values if c not in rows.columns])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root): the smallest id reachable from each id of edges(a, b).

    Each round links every id to the smallest of its neighbours and of their links, then halves the
    remaining paths, until every path has one link: logarithmic rounds, whose tables are written to the
    shared folder. Ids are longs. Work of a hot id is pre-aggregated: every exchange feeds a minimum.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    pairs = materialize(both.distinct(), f"{name}-pairs")

    def lowest(table: DataFrame) -> DataFrame:
        """Rows (a, b, m): m is the smallest of a and its links."""
        low = table.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("links"))
        low = low.select("a", F.least("a", "low").alias("m"), "links")
        return attach(table, low, "a", "links", F.xxhash64("b"), table.count()).select("a", "b", "m")

    for turn in itertools.count():
        # large star: larger links of an id go to the smallest one; the id itself does too
        near = lowest(pairs)
        star = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))
        down = materialize(star.where("a <> b").distinct(), f"{name}-large{turn}")
        # small star: smaller links of an id go to the smallest one; all rows have b < a here
        near = lowest(down)
        star = near.select("a", F.col("m").alias("b")).union(near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        links = materialize(star.where("a <> b").distinct(), f"{name}-small{turn}")
        # settled when every id links to one id, which links to none
        several = links.groupBy("a").count().where("count > 1").limit(1).count()
        if not several and not links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count():
            return links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        pairs = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
