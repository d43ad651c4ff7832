"""Token counts without tokens: Viterbi over a unigram vocabulary that carries best score and piece count only.

An Aho-Corasick automaton, its failure links resolved into one table of transitions, reports all
vocabulary pieces that end at a byte, longest first. The dynamic programme runs over all distinct words
of a slice at once, a byte position at a time. Ties and unknown characters follow the unigram model of
public tokenizer libraries: pieces from smaller starts come first and only a greater score replaces;
a character without a piece of its own costs UNKNOWN less than the least score; unknowns that follow
one another count as one piece.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _dist
from ._words import BYTE_VALUES, mix, powers, slices, text_bytes

#: Fixed values of the tokenizer rules: what a space becomes, and the penalty of an unknown character.
SPACE, UNKNOWN = "▁", 10.0
TEXT_BYTES = 8 << 20
#: Bytes of the words that are counted at once, a byte position at a time.
SHORT_WORD = 512
#: Bytes of all pieces that a vocabulary may have; it is sent to all workers.
MOST_VOCABULARY = 64 << 20


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) from a SentencePiece model file of any kind: pieces in the order of their ranks, scores by Zipf's law, as a byte-pair model has ranks only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids = [i for i in ids if SPACE not in model.id_to_piece(i)[1:]]
    total = math.log(sum(1 / (r + 2.7) for r in range(len(ids))))
    return [(model.id_to_piece(i), -math.log(r + 2.7) - total) for r, i in enumerate(ids)]


@dataclass
class Automaton:
    """next: state after a byte; piece: longest piece that ends in a state, -1 if none; link: state of the next shorter one, 0 if none."""

    next: np.ndarray
    piece: np.ndarray
    link: np.ndarray
    lengths: np.ndarray
    scores: np.ndarray
    single: np.ndarray
    unknown: float


def build(vocabulary: list[tuple[str, float]]) -> Automaton:
    texts = [p.encode() for p, _ in vocabulary]
    if sum(map(len, texts)) > MOST_VOCABULARY:
        raise ValueError("the vocabulary is too large to send to every worker")
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for i, text in enumerate(texts):
        state = 0
        for b in text:
            found = children[state].get(b)
            if found is None:
                found = children[state][b] = len(children)
                children.append({})
                ends.append(-1)
            state = found
        if text:
            ends[state] = i
    table = np.zeros((len(children), 256), np.int32)
    link, fail = np.zeros(len(children), np.int32), np.zeros(len(children), np.int32)
    piece = np.array(ends, np.int32)
    level = []
    for b, s in children[0].items():
        table[0, b] = s
        level.append(s)
    while level:
        deeper = []
        for s in level:
            back = fail[s]
            link[s] = back if piece[back] >= 0 else link[back]
            table[s] = table[back]
            for b, child in children[s].items():
                fail[child] = table[back, b]
                table[s, b] = child
                deeper.append(child)
        level = deeper
    scores = np.array([s for _, s in vocabulary], float)
    single = np.array([len(p) == 1 for p, _ in vocabulary], bool)
    return Automaton(table, piece, link, np.array([len(t) for t in texts], np.int64), scores, single, (scores.min() if len(scores) else 0.0) - UNKNOWN)


def viterbi(a: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, unknown pieces, score) of each word data[start:end], valid UTF-8."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    n = len(starts)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    total = int((sizes + 1).sum())
    best, count, unknowns = np.full(total, -np.inf), np.zeros(total, np.int64), np.zeros(total, np.int64)
    after_unknown = np.zeros(total, bool)
    best[base] = 0
    state, char = np.zeros(n, np.int32), np.zeros(n, np.int64)
    ascending = np.sort(sizes)
    for t in range(int(sizes[0]) if n else 0):
        active = n - int(np.searchsorted(ascending, t, "right"))
        byte = data[starts[:active] + t]
        state[:active] = a.next[state[:active], byte]
        lead = (byte & 0xC0) != 0x80
        char[:active][lead] = t
        # a word's character ends here if the next byte begins another one
        last = np.ones(active, bool)
        more = sizes[:active] > t + 1
        last[more] = (data[starts[:active][more] + t + 1] & 0xC0) != 0x80
        who = np.flatnonzero(last)
        here = base[who] + t + 1
        at = state[who]
        at = np.where(a.piece[at] >= 0, at, a.link[at])
        own = np.zeros(len(who), bool)
        walk = np.flatnonzero(at > 0)
        while len(walk):
            p = a.piece[at[walk]]
            target = here[walk]
            source = target - a.lengths[p]
            score = a.scores[p] + best[source]
            better = score > best[target]
            to, of = target[better], source[better]
            best[to], count[to], unknowns[to], after_unknown[to] = score[better], count[of] + 1, unknowns[of], False
            own[walk[a.single[p]]] = True
            at[walk] = a.link[at[walk]]
            walk = walk[at[walk] > 0]
        rest = np.flatnonzero(~own)
        target, source = here[rest], (base[who] + char[who])[rest]
        score = a.unknown + best[source]
        better = score > best[target]
        to, of = target[better], source[better]
        fresh = ~after_unknown[of]
        best[to], count[to], unknowns[to], after_unknown[to] = score[better], count[of] + fresh, unknowns[of] + fresh, True
    end = base + sizes
    out = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n)
    for x, y in zip(out, (count, unknowns, best), strict=True):
        x[order] = y[end]
    return out


def count_one(a: Automaton, data: bytes) -> tuple[int, int, float]:
    """The same for one word: the steps of viterbi() in plain Python, which a byte of one word costs a fraction of."""
    n = len(data)
    best, count, unknowns, after_unknown = [-math.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
    best[0] = 0.0
    state, char = 0, 0
    table, piece, link, lengths, scores, single = a.next, a.piece, a.link, a.lengths, a.scores, a.single
    known: dict[int, list[tuple[int, float, bool]]] = {}
    for t in range(n):
        byte = data[t]
        state = int(table[state, byte])
        if byte & 0xC0 != 0x80:
            char = t
        if t + 1 < n and data[t + 1] & 0xC0 == 0x80:
            continue
        ways = known.get(state)
        if ways is None:
            ways, at = [], state if piece[state] >= 0 else int(link[state])
            while at > 0:
                p = int(piece[at])
                ways.append((int(lengths[p]), float(scores[p]), bool(single[p])))
                at = int(link[at])
            known[state] = ways
        end, own = t + 1, False
        for length, weight, is_char in ways:
            source = end - length
            score = weight + best[source]
            if score > best[end]:
                best[end], count[end], unknowns[end] = score, count[source] + 1, unknowns[source]
            own |= is_char
        if not own:
            score = a.unknown + best[char]
            if score > best[end]:
                fresh = not after_unknown[char]
                best[end], count[end], unknowns[end], after_unknown[end] = score, count[char] + fresh, unknowns[char] + fresh, True
    return count[n], unknowns[n], best[n]


def count_each(a: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """viterbi() over all words: those of up to SHORT_WORD bytes at once, longer ones, which few words would share the steps of, one by one."""
    short = ends - starts <= SHORT_WORD
    out = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64), np.empty(len(starts))
    for x, y in zip(out, viterbi(a, data, starts[short], ends[short]), strict=True):
        x[short] = y
    for i in np.flatnonzero(~short):
        out[0][i], out[1][i], out[2][i] = count_one(a, data[starts[i] : ends[i]].tobytes())
    return out


def _unlike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Words whose bytes aren't those of the words `like`."""
    sizes = ends - starts
    same = sizes == sizes[like]
    some = np.flatnonzero(same)
    lens = sizes[some]
    step = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    equal = data[np.repeat(starts[some], lens) + step] == data[np.repeat(starts[like[some]], lens) + step]
    same[some] = np.logical_and.reduceat(equal, np.cumsum(lens) - lens) if len(some) else True
    return np.flatnonzero(~same)


def _built() -> dict[str, Automaton]:
    """A worker's automaton, kept between tasks: functions are unpickled anew for each, sys isn't."""
    return sys.__dict__.setdefault("_graphloom_automaton", {})


def count_words(a: Automaton, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(words, pieces, unknown pieces, score) of each text."""
    raw, at = text_bytes(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " "))
    mark = np.frombuffer(SPACE.encode(), np.uint8)
    # each text gets a space in front unless it begins with one or is empty; then each space begins a word
    lengths = np.diff(at)
    needs = (lengths > 0) & (raw[np.minimum(at[:-1], max(len(raw) - 1, 0))] != 32) if len(raw) else np.zeros(len(lengths), bool)
    is_space = raw == 32
    width = np.where(is_space, 3, 1)
    new_at = np.concatenate([[0], np.cumsum(width)])[at] + 3 * np.concatenate([[0], np.cumsum(needs)])
    where = np.concatenate([[0], np.cumsum(width)])[:-1] + 3 * np.repeat(np.cumsum(needs), lengths)
    data = np.empty(int(new_at[-1]), np.uint8)
    data[where[~is_space]] = raw[~is_space]
    starts = np.sort(np.concatenate([where[is_space], new_at[:-1][needs]]))
    for j in range(3):
        data[starts + j] = mark[j]
    rows = np.searchsorted(starts, new_at)
    ends = np.append(starts[1:], len(data))
    if not len(starts):
        zero = np.zeros(len(lengths), np.int64)
        return zero, zero, zero, np.zeros(len(lengths))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    hashes = mix(np.add.reduceat(BYTE_VALUES[data] * powers(int(place.max()) + 1)[place], starts) + (ends - starts).astype(np.uint64))
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    # words count as one only if their bytes are equal; those that merely share a hash stand for themselves
    odd = _unlike(data, starts, ends, first[inverse])
    inverse[odd] = len(first) + np.arange(len(odd))
    first = np.concatenate([first, odd])
    found = count_each(a, data, starts[first], ends[first])
    sums = [np.concatenate([[0], np.cumsum(x[inverse])])[rows] for x in found]
    return np.diff(rows), *[np.diff(s) for s in sums]


def _counts(shared):
    names = ["n_words", "n_tokens", "n_unknown", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _built()
        a = kept.get(shared.id)
        if a is None:
            kept.clear()
            a = kept[shared.id] = build(shared.value)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                got = count_words(a, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x) for x in got]], names=["doc_id", *names])

    return run


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_tokens, n_unknown, score.

    Spaces become SPACE, with one put in front of a text that doesn't begin with it, and begin words;
    n_tokens: pieces of the best segmentation of all words, n_unknown of them unknown; score: sum of
    their log probabilities, an unknown's character each costing the penalty. Null and empty texts have
    none. Long texts and long words are counted whole, in time and memory in proportion to their bytes.
    Rows that repeat one another get equal results; empty tables give no rows; other columns
    don't matter.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(vocabulary))
    table = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _dist.small_batches(table).mapInArrow(_counts(shared), f"doc_id {kind}, n_words long, n_tokens long, n_unknown long, score double")


class _Shared:
    """A broadcast vocabulary with an identity that workers keep its automaton under."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value
