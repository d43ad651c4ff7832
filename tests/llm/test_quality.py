import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm.quality_fm import FACTORS, N_FEATURES, FactorMachine, features, keep_quality, quality_scores


def test_interactions_by_sums_of_squares():
    rng = np.random.default_rng(1)
    m = FactorMachine(0.3, rng.normal(size=N_FEATURES), rng.normal(size=(N_FEATURES, FACTORS)))
    offsets, index, values = features(pa.array(["a b c a", None, "*** line\n*** line"]), np.array([3.0, np.nan, 7.0]))
    got = m.raw(offsets, index, values)
    for r in range(3):
        i, x = index[offsets[r] : offsets[r + 1]], values[offsets[r] : offsets[r + 1]]
        want = m.bias + (m.linear[i] * x).sum() + sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(got[r], want)


def fixture(n=600):
    rng = random.Random(9)
    good, bad = [f"word{i}" for i in range(200)], ["buy", "***", "###", "click", "$$$"]
    docs, labels = [], []
    for i in range(n):
        q = int(rng.random() < 0.7)
        text = " ".join(rng.choices(good, k=40)) if q else " ".join(w + rng.choice(bad) for w in rng.choices(good[:50], k=30))
        docs.append((i, text, rng.choice("ab"), len(text) if i % 7 else None, 1.0))
        labels.append((i, q if i % 31 else None, 0))
    docs += [(n, None, None, None, None), (n + 1, "", "a", 0, 0.0), (None, "word1", None, 5, None), (n + 2, "z " * 200_000, "a", None, 2.0)]
    return docs, labels


DOCS, LABELS = "doc_id long, text string, source string, n_chars long, score double", "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_columns(spark):
    docs, labels = fixture()
    table, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in quality_scores(table, known).collect()}
    assert len(got) == len(docs)
    truth = {i: q for i, q, _ in labels if q is not None}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and not any(got[i].held_out for i in truth if i not in held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    moved = table.selectExpr("doc_id", "text", "'other' source", "n_chars", "score")
    again = {r.doc_id: r.score for r in quality_scores(moved, known).collect()}
    assert all(again[i] == r.score for i, r in got.items())
    kept = keep_quality(table, known)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_odd_tables(spark):
    docs, labels = fixture(30)
    table, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert quality_scores(table.limit(0), known).count() == 0
    assert {r.score for r in quality_scores(table, known.limit(0)).collect()} == {0.5}
    assert quality_scores(table.drop("n_chars"), known).count() == len(docs)


def test_clashing_names_and_repeated_ids(spark):
    """Columns named like the operator's own, dots and maps, and one doc_id in far more rows than the sample."""
    docs, labels = fixture(60)
    table = spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text", "score `Score`", "n_chars", "1 stated", "'x' `a.b`", "map('k', source) c0")
    known = spark.createDataFrame(labels, LABELS)
    many = table.unionByName(table.where("doc_id = 1").select("*").join(spark.range(500).select(), how="cross"))
    kept = keep_quality(many, known, sample=100)
    assert kept.columns == table.columns and dict(kept.dtypes)["c0"] == "map<string,string>"
    same = {r.doc_id for r in quality_scores(many, known, sample=100).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == same


def test_training_leaves_rows_in_the_task(spark, monkeypatch):
    from graphloom.llm import quality_fm
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good words here").otherwise("BAD 123 !!").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    kept, driver = quality_fm.fit, os.getpid()
    monkeypatch.setattr(quality_fm, "fit", lambda rows, *a, **b: kept(rows, *a, **b) if not rows or os.getpid() != driver else pytest.fail("rows on the driver"))
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("rows on the driver"))
    machine = quality_fm.train(docs, labels)
    assert machine.linear.any() and machine.factors.shape == (N_FEATURES, FACTORS)
    empty = quality_fm.train(docs, labels.where("false"))
    assert empty.bias == 0 and not empty.linear.any()
