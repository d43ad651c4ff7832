"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): all pairwise
interactions through factors of low rank, in time linear in the features of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._dist import columns_of, free_names, small_batches
from ._words import Words, slices, text_bytes
from .kneser_ney import held_out

WORD_BITS, FACTORS = 13, 8
#: Labelled rows that training, which is one task, may hold: those with the smallest hash of their doc_id.
SAMPLE = 8000
#: Statistics of a text, after the hashed words in the numbering of features.
STATISTICS = ("chars", "words", "word_length", "upper", "digits", "marks", "spaces", "lines", "non_ascii", "distinct", "top_word", "repeated_lines", "line_length", "stated_chars", "stated_missing")
N_FEATURES = (1 << WORD_BITS) + len(STATISTICS)


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[at]).astype(float)


def _repeats(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count) of distinct (row, key) in order."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return rows[at], keys[at], np.diff(np.append(at, len(rows)))


def features(texts: pa.Array, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by text, feature numbers, values). stated: the table's count of characters, NaN where it has none."""
    n = len(texts)
    raw, at = text_bytes(texts)
    words = Words(texts, "space", lower=True)
    rows, hashes = words.row_of(), words.hashes()
    bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    row, key, count = _repeats(rows, bucket, n)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = value / norm[row]
    size = np.maximum(np.diff(at), 1).astype(float)
    n_words = words.counts.astype(float)
    some = np.maximum(n_words, 1)
    drow, _, dcount = _repeats(rows, hashes.view(np.int64), n)
    top = np.zeros(n)
    np.maximum.at(top, drow, dcount)
    ends = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([at[:-1], ends + 1]))
    starts = starts[starts < len(raw)]
    # lines as the sums of their bytes' values: equal lines have equal sums
    line_sums = np.add.reduceat(raw.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (np.arange(len(raw), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(raw)))).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F), starts) if len(starts) else np.zeros(0, np.uint64)
    line_row = np.searchsorted(at, starts, "right") - 1
    lrow, _, _ = _repeats(line_row, line_sums.view(np.int64), n)
    lines = np.maximum(np.bincount(line_row, minlength=n), 1).astype(float)
    distinct_lines = np.maximum(np.bincount(lrow, minlength=n), 1)
    upper = _per_row((raw >= 65) & (raw <= 90), at) / size
    digits = _per_row((raw >= 48) & (raw <= 57), at) / size
    space = _per_row((raw == 32) | ((raw >= 9) & (raw <= 13)), at) / size
    high = _per_row(raw >= 128, at) / size
    letters = _per_row(((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128), at) / size
    marks = np.maximum(1 - letters - digits - space - high, 0) * (np.diff(at) > 0)
    columns = [
        np.log1p(np.diff(at)) / 8, np.log1p(n_words) / 6, np.minimum(_per_row(words._inside[:-1], at) / some / 10, 3), upper * 5, digits * 5, marks * 5, space * 3, np.log1p(lines) / 4, high * 2,
        np.bincount(drow, minlength=n) / some, top / some, 1 - distinct_lines / lines, np.log1p(size / lines) / 6, np.nan_to_num(np.log1p(np.maximum(stated, 0)) / 8), np.isnan(stated).astype(float),
    ]
    extra = np.stack(columns, 1)
    per_row = np.bincount(row, minlength=n) + len(STATISTICS)
    offsets = np.concatenate([[0], np.cumsum(per_row)])
    index, values = np.empty(offsets[-1], np.int64), np.empty(offsets[-1])
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] + offsets[row]
    index[place], values[place] = key, value
    tail = (offsets[1:] - len(STATISTICS))[:, None] + np.arange(len(STATISTICS))
    index[tail], values[tail] = (1 << WORD_BITS) + np.arange(len(STATISTICS)), extra
    return offsets, index, values


@dataclass
class FactorMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, offsets: np.ndarray, index: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; every text has features."""
        if len(offsets) < 2:
            return np.zeros(0)
        at = offsets[:-1]
        scaled = self.factors[index] * values[:, None]
        sums, squares = np.add.reduceat(scaled, at), np.add.reduceat(scaled * scaled, at)
        return self.bias + np.add.reduceat(self.linear[index] * values, at) + 0.5 * (sums * sums - squares).sum(1)

    def score(self, *rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*rows), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> FactorMachine:
    """Adagrad on the logistic loss over rows (feature numbers, values). Without rows, or with one label only, the machine is a constant."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    model = FactorMachine(float(np.log(share / (1 - share))), np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, FACTORS)))
    if len(np.unique(labels)) < 2:
        model.factors[:] = 0
        return model
    lin2, fac2, bias2 = np.full(N_FEATURES, 1e-8), np.full((N_FEATURES, FACTORS), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            pick = order[start : start + batch]
            offsets = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
            index, values = (np.concatenate([rows[i][j] for i in pick]) for j in (0, 1))
            at, counts = offsets[:-1], np.diff(offsets)
            scaled = model.factors[index] * values[:, None]
            sums = np.add.reduceat(scaled, at)
            raw = model.raw(offsets, index, values)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
            each = np.repeat(error, counts) * values
            grad = each[:, None] * (np.repeat(sums, counts, 0) - scaled)
            used, where = np.unique(index, return_inverse=True)
            g1 = np.bincount(where, each) + decay * model.linear[used]
            g2 = np.stack([np.bincount(where, grad[:, f]) for f in range(FACTORS)], 1) + decay * model.factors[used]
            lin2[used] += g1 * g1
            fac2[used] += g2 * g2
            model.linear[used] -= rate * g1 / np.sqrt(lin2[used])
            model.factors[used] -= rate * g2 / np.sqrt(fac2[used])
            g0 = error.sum()
            bias2 += g0 * g0
            model.bias -= rate * g0 / np.sqrt(bias2)
    return model


def _stated(part: pa.RecordBatch) -> np.ndarray:
    return part.column("stated").to_numpy(zero_copy_only=False).astype(float)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, place, index, value): features as packed 16-bit numbers and 32-bit values."""
    for batch in batches:
        for part in slices(batch, "text"):
            offsets, index, values = features(part.column("text"), _stated(part))
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary()) for x in (index.astype("<u2"), values.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("place"), *packed], names=["label", "place", "index", "value"])


def _stated_chars(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample: int = SAMPLE) -> FactorMachine:
    """A machine for labels(doc_id, quality) of the rows that aren't held out, at most `sample` of them, however often a doc_id repeats in either table."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds, fold))
    known = known.select(F.col("doc_id"), (F.col("quality") > 0).cast("double").alias("label"), F.xxhash64(F.lit(11), "doc_id").alias("place"))
    known = known.orderBy("place", "doc_id", "label").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), _stated_chars(docs).alias("stated"))
    rows = texts.join(F.broadcast(known), "doc_id").select("label", "place", "text", "stated")
    taken = small_batches(rows).mapInArrow(_featured, "label double, place long, index binary, value binary").orderBy("place", "label", F.length("index"), "index", "value").limit(sample)
    # one task has the sample, in order; the driver gets the machine alone
    found = taken.mapInArrow(_trained, "bias double, linear binary, factors binary").first()
    return fit([], np.zeros(0)) if found is None else FactorMachine(found["bias"], np.frombuffer(found["linear"]), np.frombuffer(found["factors"]).reshape(N_FEATURES, FACTORS))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the machine for rows (label, place, index, value), as packed numbers."""
    labels, pairs = [], []
    for batch in batches:
        labels += batch.column("label").to_pylist()
        pairs += [(np.frombuffer(i.as_py(), "<u2"), np.frombuffer(v.as_py(), "<f4")) for i, v in zip(batch.column("index"), batch.column("value"), strict=True)]
    machine = fit(pairs, np.array(labels, float))
    yield pa.RecordBatch.from_arrays([pa.array([machine.bias]), *[pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (machine.linear, machine.factors)]], names=["bias", "linear", "factors"])


def _scores(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = machine.value.score(*features(part.column("text"), _stated(part)))
                names = [name for name in part.schema.names if name != "stated"]
                yield pa.RecordBatch.from_arrays([*[part.column(name) for name in names], pa.array(score)], names=[*names, "score"])

    return run


def _scored(docs: DataFrame, machine: FactorMachine, columns: list[str], score: str) -> DataFrame:
    """Columns of docs, and the score of its text under the name `score`. Inside, columns go by their place, so their names can't clash."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # N_FEATURES * (FACTORS + 1) numbers, whatever the input
    inner = ["text" if c == "text" else f"c{i}" for i, c in enumerate(columns)]
    table = docs.select(*[(F.col("text").cast("string") if c == "text" else F.col(f"`{c}`")).alias(n) for c, n in zip(columns, inner, strict=True)], _stated_chars(docs).alias("stated"))
    schema = ", ".join(f"{c} {kind}" for c, kind in table.dtypes if c != "stated")
    return small_batches(table).mapInArrow(_scores(shared), f"{schema}, score double").toDF(*columns, score)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs(doc_id, text[, n_chars]): doc_id, held_out, score, predicted.

    score: chance of quality 1; predicted: 1 from 0.5 on. Null and empty texts have statistics of zero
    and a score like any other; a null n_chars is a feature of its own. Rows of labels without doc_id or
    quality don't train; without labelled rows the score is 0.5. Labels, lang, source and doc_id are no
    inputs of a score. Empty tables give no rows; other columns don't matter.
    """
    machine = train(docs, labels, folds, fold, sample)
    tagged = docs.select("doc_id", held_out(folds, fold).alias("held_out"), "text", *(["n_chars"] if "n_chars" in docs.columns else []))
    scored = _scored(tagged, machine, ["doc_id", "held_out", "text"], "score").drop("text")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """docs that the classifier scores `least` or more; the columns of docs stay, whatever their names."""
    machine = train(docs, labels, **options)
    (score,) = free_names(docs.columns, "score")
    return _scored(docs, machine, docs.columns, score).where(F.col(score) >= least).select(*columns_of(docs))
