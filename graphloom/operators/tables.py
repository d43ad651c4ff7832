"""Keyed tables: multi-get, upsert, delete, set algebra of keys, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefixed_hash, strip


def insert_strings(texts: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, content) of texts(content): stripped, blank ones dropped, equal ones once; the id is the SHA-256 one unless the table knows the older MD5 one."""
    rows = texts.select(strip(F.col("content")).alias("content")).where("content <> ''").distinct()
    sha, md5 = prefixed_hash("doc-", F.col("content")), prefixed_hash("doc-", F.col("content"), "md5")
    if known_ids is None:
        return rows.select(sha.alias("doc_id"), "content")
    rows = rows.withColumn("md5_id", md5).join(known_ids.select(F.col("doc_id").alias("known")).distinct(), F.col("md5_id") == F.col("known"), "left")
    return rows.select(F.coalesce("known", sha).alias("doc_id"), "content")


def multi_get(table: DataFrame, wanted: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """Rows of wanted(pos, key) in order with the table's fields, nulls where it has no such key."""
    chosen = table.select(key, *(fields or [c for c in table.columns if c != key]))
    return wanted.join(chosen, key, "left")


def missing_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return keys.select(key).distinct().join(table.select(key), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str | list[str], merge: bool = False) -> DataFrame:
    """table with rows put in place of those of the same key; merge: values that a row leaves null stay as they were."""
    keys = [key] if isinstance(key, str) else key
    if not merge:
        return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
    old, new = table.alias("o"), rows.alias("n")
    joined = old.join(new, keys, "full_outer")
    values = [c for c in table.columns if c not in keys]
    return joined.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in rows.columns else F.col(f"o.{c}") for c in values])


def delete(table: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    return table.join(keys.select(key).distinct() if isinstance(key, str) else keys.select(*key).distinct(), key, "left_anti")


def changes(incoming: DataFrame, stored: DataFrame, extraction_hash: str, force: bool = False, stripped: bool = True) -> DataFrame:
    """(doc_id, content, content_hash, status) of incoming(doc_id, content) against stored(doc_id, content_hash, extraction_hash): new, changed, reconfigured or unchanged; forced for all if asked.

    Contents are stripped and blank ones go; with stripped false all stay as they are, null ones too. One row
    per row of incoming: an id that is stored several times has several contents, a null id is an id.
    """
    rows = incoming.select("doc_id", "content")
    if stripped:
        rows = rows.withColumn("content", strip(F.col("content"))).where("content <> ''")
    rows = rows.withColumn("content_hash", F.sha2("content", 256))
    if force:
        return rows.withColumn("status", F.lit("forced"))
    old = stored.groupBy(F.col("doc_id").alias("old_id"), F.col("content_hash").alias("old_hash")).agg(F.max(F.col("extraction_hash").eqNullSafe(F.lit(extraction_hash))).alias("same"))
    ids = old.select(F.col("old_id").alias("had_id"), F.lit(True).alias("had")).distinct()
    status = F.when(F.col("had").isNull(), "new").when(F.col("same").isNull(), "changed").when(~F.col("same"), "reconfigured").otherwise("unchanged")
    met = rows.join(old, F.col("doc_id").eqNullSafe(F.col("old_id")) & F.col("content_hash").eqNullSafe(F.col("old_hash")), "left").join(ids, F.col("doc_id").eqNullSafe(F.col("had_id")), "left")
    return met.select("doc_id", "content", "content_hash", status.alias("status"))


def extraction_hash(function: str, model: str, backend: str, quality: str):
    return F.sha2(F.concat_ws("|", F.lit(function), F.lit(model), F.lit(backend), F.lit(quality)), 256)


def touched_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): removed keys of old, and kept or added ones of new."""
    a, b = old.select(key).distinct().withColumn("in_old", F.lit(True)), new.select(key).distinct().withColumn("in_new", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("in_new").isNull(), "removed").when(F.col("in_old").isNull(), "added").otherwise("kept").alias("change"))


def stale_chunks(manifests: DataFrame, changed: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Chunk ids of manifests(doc_id, chunk_ids) of changed documents that the new chunks don't have."""
    old = manifests.join(changed.select("doc_id").distinct(), "doc_id", "left_semi").select(F.explode("chunk_ids").alias("chunk_id")).distinct()
    return old.join(chunk_ids.select("chunk_id"), "chunk_id", "left_anti")
