"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Counting: each task sorts its (context, word) pairs and sends packed arrays of distinct pairs with
counts to shards of the context's hash. Contexts that hold more pairs than some shards together, found
by a pass over all texts, are dealt to shards of their own by word, so no shard grows with one context.
A shard merges its pairs, writes its arrays to the shared folder and sends each word's count and number
of distinct contexts on to word shards, which write theirs. Hash arrays of a shard are sorted, so a
look-up is a binary search in mapped memory; the driver sees sums only, and the frequent contexts.

Files (little endian, counts in the narrowest type of 8 to 64 bits that holds them all), each written
under another name and renamed, so that repeated tasks are harmless:
  pairs-<shard>: the turn of the key's mixing, contexts u64, their totals and numbers of words seen once,
                 twice, more often, then keys u64 (the context's index in as many bits as the shard needs,
                 then bits of the word's hash), counts
  words-<shard>: words u64, counts, distinct contexts
  hot-<part>:    frequent contexts u64, with the same numbers as contexts in pairs
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _dist
from ._words import Words, mix, slices, text_bytes

_U = np.uint64
#: Hashes of the mark before a text and of the end token.
START, END = (int(x) for x in mix(np.array([101, 102], _U)))
#: Text bytes for a shard, and tokens that a task sorts at once.
SHARD_BYTES, FLUSH_TOKENS = 12_000_000, 2_000_000
#: Text bytes whose words are looked up at once.
LOOKUP_BYTES = 2 << 20
#: A context with more tokens than this many shards is dealt by word; the files of such contexts' numbers.
HOT_SHARDS, HOT_FILES = 4, 64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def local_path(uri: str) -> str:
    """The path of the shared folder as workers map it."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped: spark.checkpoint.dir must be mounted as a file system, not {parsed.scheme}")
    return parsed.path


def sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, contexts, offsets by text): word hashes of each text and the end token, each with the hash before it."""
    words = Words(texts)
    n = words.counts
    at = np.concatenate([[0], np.cumsum(n + 1)])
    tokens = np.empty(at[-1], _U)
    ends = at[1:] - 1
    is_word = np.ones(at[-1], bool)
    is_word[ends] = False
    tokens[is_word] = words.hashes()
    tokens[ends] = END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at[:-1]] = START
    return tokens, before, at


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _summed(context: np.ndarray, word: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in order, with counts."""
    order = np.argsort(word, kind="stable")
    order = order[np.argsort(context[order], kind="stable")]
    context, word = context[order], word[order]
    at = _runs(context, word)
    sums = np.diff(np.append(at, len(context))) if counts is None else np.add.reduceat(counts[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return context[at], word[at], sums


def _shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


@dataclass(frozen=True)
class Shards:
    """Where pairs go: 2^bits shards by context, then as many for the frequent contexts, each of which uses `width` of them."""

    bits: int
    hot: np.ndarray
    width: np.ndarray

    def of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = _shard(context, self.bits)
        if len(self.hot):
            at, found = _find(self.hot, context)
            some = np.flatnonzero(found)
            step = (mix(word[some] ^ context[some]) % self.width[at[some]].astype(_U)).astype(np.int64)
            out[some] = (1 << self.bits) + (out[some] + step) % (1 << self.bits)
        return out


_PACKED = pa.schema([("shard", pa.int64()), ("contexts", pa.binary()), ("runs", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
_PACKED_DDL = "shard long, contexts binary, runs binary, words binary, counts binary"


def _count(shards: Shards):
    """Packed distinct pairs of a task by shard."""

    def packed(tokens: list[np.ndarray], before: list[np.ndarray]) -> pa.RecordBatch:
        context, word, counts = _summed(np.concatenate(before), np.concatenate(tokens), None)
        shard = shards.of(context, word)
        if len(shards.hot):
            order = np.argsort(shard, kind="stable")
            context, word, counts, shard = context[order], word[order], counts[order], shard[order]
        starts = _runs(shard)
        rows = []
        for a, b in zip(starts, np.append(starts[1:], len(shard)), strict=True):
            c = context[a:b]
            at = _runs(c)
            runs = np.diff(np.append(at, len(c))).astype("<u4")
            rows.append((int(shard[a]), c[at].tobytes(), runs.tobytes(), word[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, before, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text", LOOKUP_BYTES):
                t, b, _ = sequence(part.column("text"))
                tokens.append(t)
                before.append(b)
                held += len(t)
                if held >= FLUSH_TOKENS:
                    yield packed(tokens, before)
                    tokens, before, held = [], [], 0
        if held:
            yield packed(tokens, before)

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (context, n, bytes) of each slice: contexts with a 256th of its tokens or more, with their counts; and under context 0 all tokens and bytes."""
    for batch in batches:
        for part in slices(batch, "text", LOOKUP_BYTES):
            _, before, _ = sequence(part.column("text"))
            found, n = np.unique(before, return_counts=True)
            some = n * 256 >= len(before)
            size = int(np.diff(text_bytes(part.column("text"))[1]).sum())
            columns = np.append(found[some], _U(0)), np.append(n[some], len(before)), np.append(np.zeros(some.sum(), np.int64), size)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["context", "n", "bytes"])


def plan(text: DataFrame) -> Shards:
    """Shards for the texts of a table: by their bytes, and the contexts that hold more than HOT_SHARDS shards' share of all tokens."""
    seen = text.mapInArrow(_frequent, "context long, n long, bytes long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    seen = _dist.materialize(seen, "contexts")
    row = seen.where("context = 0").first()
    tokens, size = (row["n"], row["bytes"]) if row else (0, 0)
    bits = max(0, int(size // SHARD_BYTES).bit_length())
    many = seen.where((F.col("context") != 0) & (F.col("n") > tokens * HOT_SHARDS / 2**bits)).select("context", "n").collect() if bits > 2 else []
    hot = np.array([r["context"] for r in many], np.int64).view(_U)
    width = np.array([min(1 << bits, -(-2 * r["n"] * (1 << bits) // tokens)) for r in many], np.int64)
    order = np.argsort(hot)
    return Shards(bits, hot[order], width[order])


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * int(t[2])))


def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays after their lengths and sizes of a number, each padded to 8 bytes."""
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        np.array([[len(a), a.itemsize] for a in arrays], "<i8").tofile(f)
        for a in arrays:
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 8))
    os.replace(temporary, f"{folder}/{name}")


#: Kinds of files.
PAIRS, WORDS, HOT = "pairs", "words", "hot"


def _code(kind: str, number: int) -> int:
    return 3 * number + (PAIRS, WORDS, HOT).index(kind)


def _read(model: Model, kind: str, number: int, n: int) -> list[np.ndarray] | None:
    """The n arrays of a file, mapped; None if training wrote no such file. One that it wrote and that isn't there is an error."""
    if not model.wrote(_code(kind, number)):
        return None
    path = f"{model.folder}/{kind}-{number}"
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} is missing: do all workers share that folder?")
    heads, at, out = np.fromfile(path, "<i8", 2 * n).reshape(n, 2), 16 * n, []
    for length, size in heads.tolist():
        out.append(np.memmap(path, f"<u{size}", "r", at, (length,)) if length else np.zeros(0, f"<u{size}"))
        at += length * size + -(length * size) % 8
    return out


def _steps(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, and over 2."""
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)] + [int((counts > 2).sum())]


def _keys(index: np.ndarray, word: np.ndarray, n: int, turn: int) -> np.ndarray:
    """Keys of (context index below n, word): the index in the upper bits, in the others what fits of the word's hash, mixed anew each turn."""
    bits = _U(max(1, int(n - 1).bit_length()))
    return (index.astype(_U) << (_U(64) - bits)) | ((mix(word + _U(turn) * _GOLDEN) if turn else word) >> bits)


def _merge_pairs(folder: str, word_bits: int, hot_from: int):
    """Write a shard of contexts; rows of word shards: packed words with counts and contexts; sums under shard -1; a frequent context's numbers under shards below."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame.shard.iloc[0])
        context = np.concatenate([np.repeat(np.frombuffer(c, _U), np.frombuffer(r, "<u4")) for c, r in zip(frame.contexts, frame.runs, strict=True)])
        word = np.concatenate([np.frombuffer(w, _U) for w in frame.words])
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in frame.counts])
        context, word, counts = _summed(context, word, counts)
        at = _runs(context)
        numbers = [np.add.reduceat(m.astype(np.int64), at) for m in (counts, counts == 1, counts == 2, counts > 2)]
        index, turn = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(context)))), 0
        while True:
            keys = _keys(index, word, len(at), turn)
            order = np.argsort(keys, kind="stable")
            if (np.diff(keys[order]) != 0).all():
                break
            turn += 1  # two words of a context share a key
        _write(folder, f"pairs-{shard}", np.array([turn], "<u8"), context[at], *[_narrow(x) for x in numbers], keys[order], _narrow(counts[order]))
        rows = [(-1, np.array([shard], "<i8").tobytes(), b"", b"", np.array(_steps(counts), "<i8").tobytes())]
        if shard >= hot_from:
            part = (context[at] % _U(HOT_FILES)).astype(np.int64)
            rows += [(-2 - int(p), context[at][part == p].tobytes(), b"", b"", np.stack([x[part == p] for x in numbers]).astype("<i8").tobytes()) for p in np.unique(part)]
        order = np.argsort(word, kind="stable")
        word, counts = word[order], counts[order]
        at = _runs(word)
        uses, contexts = np.add.reduceat(counts, at), np.diff(np.append(at, len(word)))
        word = word[at]
        bounds = np.searchsorted(_shard(word, word_bits), np.arange((1 << word_bits) + 1))
        rows += [(int(s), *(x[bounds[s] : bounds[s + 1]].astype("<u8").tobytes() for x in (word, uses, contexts)), b"") for s in np.flatnonzero(np.diff(bounds))]
        return pd.DataFrame(rows, columns=["shard", "words", "uses", "contexts", "sums"])

    return run


#: Numbers to be summed; beside them the codes of the files written.
_SUMS = ["pair1", "pair2", "pair3", "pair4", "word1", "word2", "word3", "word4", "more", "distinct", "tokens", "contexts"]


def _merge_words(folder: str):
    """Write a shard of words; a row of sums."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame.shard.iloc[0])
        if shard == -1:
            pair = np.sum([np.frombuffer(s, "<i8") for s in frame.sums], axis=0)
            files = [_code(PAIRS, int(i)) for x in frame.words for i in np.frombuffer(x, "<i8")]
            return pd.DataFrame([[*pair[:4].tolist(), *[0] * 8, files]], columns=[*_SUMS, "files"])
        if shard < -1:
            context = np.concatenate([np.frombuffer(x, _U) for x in frame.words])
            numbers = np.concatenate([np.frombuffer(x, "<i8").reshape(4, -1) for x in frame.sums], axis=1)
            order = np.argsort(context, kind="stable")
            at = _runs(context[order])
            _write(folder, f"hot-{-2 - shard}", context[order][at], *[_narrow(np.add.reduceat(x[order], at)) for x in numbers])
            return pd.DataFrame([[*[0] * 12, [_code(HOT, -2 - shard)]]], columns=[*_SUMS, "files"])
        word, uses, contexts = (np.concatenate([np.frombuffer(x, _U) for x in frame[c]]) for c in ("words", "uses", "contexts"))
        order = np.argsort(word, kind="stable")
        word = word[order]
        at = _runs(word)
        uses, contexts = np.add.reduceat(uses[order], at), np.add.reduceat(contexts[order], at)
        _write(folder, f"words-{shard}", word[at], _narrow(uses), _narrow(contexts))
        return pd.DataFrame([[0, 0, 0, 0, *_steps(contexts), len(at), int(uses.sum()), int(contexts.sum()), [_code(WORDS, shard)]]], columns=[*_SUMS, "files"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts of 1, 2 and more; half a count where the counts of counts don't give one inside (0, count)."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [i - (i + 1) * y * b / a if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(d if 0 < d < i else 0.5 for i, d in enumerate(raw, 1))


@dataclass
class Model:
    """What scoring needs besides the arrays in `folder`."""

    folder: str
    shards: Shards
    word_bits: int
    sums: dict[str, int] = field(default_factory=dict)
    files: dict[int, bytes] = field(default_factory=dict)

    def __post_init__(self):
        s = self.sums
        self.tokens, self.distinct, self.contexts = s["tokens"], s["distinct"], s["contexts"]
        self.pair_discounts = discounts(*[s[f"pair{i}"] for i in (1, 2, 3, 4)])
        self.word_discounts = discounts(*[s[f"word{i}"] for i in (1, 2, 3, 4)])
        self.unseen = 1 / (self.distinct + 1)
        self.spare = sum(d * n for d, n in zip(self.word_discounts, (s["word1"], s["word2"], s["more"]), strict=True)) / self.contexts if self.contexts else 1.0


    def wrote(self, code: int) -> bool:
        """Whether training wrote the file of a code: bitmaps of 2^15 codes."""
        bits = self.files.get(code >> 15)
        return bits is not None and bool(bits[(code & 32767) >> 3] >> (code & 7) & 1)


def _find(array: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, found) of sorted queries in a sorted array."""
    at = np.searchsorted(array, wanted)
    inside = np.minimum(at, len(array) - 1)
    return inside, array[inside] == wanted


class Reader:
    """Probabilities from the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.m = model
        self.pairs = lru_cache(4096)(lambda s: _read(model, PAIRS, s, 8))
        self.words = lru_cache(4096)(lambda s: _read(model, WORDS, s, 3))
        self.hot = []
        if len(model.shards.hot):
            files = [f for f in (_read(model, HOT, p, 5) for p in range(HOT_FILES)) if f]
            order = np.argsort(np.concatenate([f[0] for f in files]))
            self.hot = [np.concatenate([f[i].astype(_U) for f in files])[order] for i in range(5)]

    def word(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, lower-order probabilities) of sorted distinct words."""
        m, n = self.m, len(words)
        counts, probs = np.zeros(n), np.full(n, m.spare * m.unseen)
        bounds = np.searchsorted(_shard(words, m.word_bits), np.arange((1 << m.word_bits) + 1))
        for s in np.flatnonzero(np.diff(bounds)):
            arrays = self.words(int(s))
            if arrays is None:
                continue
            mine = slice(bounds[s], bounds[s + 1])
            at, found = _find(arrays[0], words[mine])
            seen = arrays[2][at].astype(float)
            cut = np.array([0.0, *m.word_discounts])[np.minimum(seen, 3).astype(np.int64)]
            counts[mine] = np.where(found, arrays[1][at], 0)
            probs[mine] += np.where(found, (seen - cut) / m.contexts, 0)
        return counts, probs

    def pair(self, contexts: np.ndarray, words: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of words after contexts; rows in order of context."""
        m = self.m
        shard = m.shards.of(contexts, words)
        order = np.argsort(shard, kind="stable")
        cuts = np.array([0.0, *m.pair_discounts])
        out = np.empty(len(words))
        starts = _runs(shard[order])
        for a, b in zip(starts, np.append(starts[1:], len(shard)), strict=True):
            rows = order[a:b]
            arrays, hot = self.pairs(int(shard[rows[0]])), shard[rows[0]] >= 1 << m.shards.bits
            if arrays is None and not hot:
                out[rows] = lower[rows]
                continue
            none = np.zeros(1, _U)  # context and word 0 count nothing
            turn, head, *numbers, keys, counts = arrays or [none] * 8
            context, word = contexts[rows], words[rows]
            begin = _runs(context)
            repeat = np.diff(np.append(begin, len(rows)))
            index, here = _find(head, context[begin])
            known, at = here, index
            if hot:  # a frequent context's numbers are those of all its shards
                numbers = self.hot[1:]
                at, known = _find(self.hot[0], context[begin])
            all_, one, two, more = (x[at].astype(float) for x in numbers)
            spare = (one * cuts[1] + two * cuts[2] + more * cuts[3]) / np.maximum(all_, 1)
            index, here, known, all_, spare = (np.repeat(x, repeat) for x in (index, here, known, all_, spare))
            place, found = _find(keys, _keys(index, word, len(head), int(turn[0])))
            c = counts[place].astype(float)
            direct = np.where(found & here, (c - cuts[np.minimum(c, 3).astype(np.int64)]) / np.maximum(all_, 1), 0)
            out[rows] = np.where(known, direct + spare * lower[rows], lower[rows])
        return out

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        tokens, before, at = sequence(texts)
        words, inverse = np.unique(tokens, return_inverse=True)
        counts, lower = self.word(words)
        counts = counts[inverse]
        order = np.argsort(tokens, kind="stable")
        order = order[np.argsort(before[order], kind="stable")]
        probs = np.empty(len(tokens))
        probs[order] = self.pair(before[order], tokens[order], lower[inverse][order])
        m = self.m
        base = np.log10((counts + 0.1) / (m.tokens + 0.1 * (m.distinct + 1)))
        sums = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0)  # noqa: E731  every text has a token
        return {"n_tokens": np.diff(at).astype(np.int64), "n_known": sums((counts > 0).astype(np.int64)).astype(np.int64), "base_score": sums(base), "score": sums(np.log10(probs))}


def train(docs: DataFrame) -> Model:
    """Count docs(text) whole; null texts are an end token alone."""
    spark = docs.sparkSession
    text = _dist.small_batches(docs.select(F.col("text").cast("string").alias("text")))
    shards = plan(text)
    folder = local_path(_dist.new_path(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    counted = text.mapInArrow(_count(shards), _PACKED_DDL)
    words = counted.groupBy("shard").applyInPandas(_merge_pairs(folder, shards.bits, 1 << shards.bits), "shard long, words binary, uses binary, contexts binary, sums binary")
    sums = words.groupBy("shard").applyInPandas(_merge_words(folder), ", ".join([*(f"{c} long" for c in _SUMS), "files array<long>"]))
    sums = _dist.materialize(sums, "sums")
    row = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS]).first()
    code = sums.select(F.explode("files").alias("code"))
    bits = code.groupBy(F.shiftright("code", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("code").bitwiseAND(32767)).alias("bits"))
    return Model(folder, shards, shards.bits, row.asDict(), {r.part: bytes(r.bits) for r in bits.collect()})  # a bit for each file


def _score(model: Model):
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for part in slices(batch, "text", LOOKUP_BYTES):
                got = reader.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *[pa.array(got[n]) for n in names]], names=["doc_id", "held_out", *names])

    return run


def held_out(folds: int, fold: int = 0):
    """crc32 of the doc_id as text mod folds is fold; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold


def lm_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens: runs of other characters than ASCII white space, A-Z lower-cased, and one end. Trains on the
    rows that aren't held out. base_score: add-0.1 unigrams; score: log10 probability of the text under
    the bigram model, in which a word that training doesn't have shares one unknown's mass. Null and
    empty texts are an end token. A long text is counted and scored whole, in memory of some 100 bytes a
    word. Rows that repeat one another count and score each. Without training
    rows both models are uniform over the unknown word.
    """
    table = docs.select("doc_id", held_out(folds).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = train(table.where("not held_out"))
    scored = table.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double" if dict(table.dtypes)["doc_id"] == "bigint" else f"doc_id {dict(table.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
