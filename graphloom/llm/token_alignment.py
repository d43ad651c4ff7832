"""Alignment of two tokenizations of the same bytes, and how often ids are linked corpus-wide.

A byte range of a text gives a fragment: the tokens that end in it up to its first common end (open
prefix), whole groups between common ends (closed), and the tokens after its last one (open suffix).
Fragments of neighbouring ranges compose, an open suffix and the prefix after it into a group, and
composition is associative: ranges of very long documents are encoded in different tasks and reduced
as a tree. Links lie within one range, so they are counted without that.

Pairs of ids are counted in tasks, then by a shuffle. The most frequent pairs, at most MOST_PAIRS, are
broadcast; links of all others meet their counts in a join, in which none of them is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _dist
from ._pieces import ByteLevel, Pieces, TokenBytes
from ._words import slices

#: Pairs that are broadcast, 24 bytes each.
MOST_PAIRS = 1 << 20
#: Pairs that a task holds before it gives them on, and those in a row of them.
HELD, ROW = 1 << 21, 1 << 15
#: Fragments that are composed at once.
FAN = 16
FRAGMENT = "cut boolean, head_a array<long>, head_b array<long>, mid binary, tail_a array<long>, tail_b array<long>"


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(decimal digits and a place for a separator, which of them count) of each id below size."""
    width = len(str(size))
    digits = np.zeros((size, width + 1), np.uint8)
    rest = np.arange(size)
    for k in range(width - 1, -1, -1):
        digits[:, k] = 48 + rest % 10
        rest = rest // 10
    shown = np.arange(width)[None, :] >= width - np.char.str_len(np.arange(size).astype(str))[:, None]
    return digits, np.concatenate([shown, np.ones((size, 1), bool)], axis=1)


class Aligner:
    """Two tokenizers and tables of their ids' bytes."""

    def __init__(self, byte_tokenizer: str, piece_model: str):
        self.a, self.b = ByteLevel(byte_tokenizer, plain=True), Pieces(piece_model)
        self.bytes_a, self.bytes_b = TokenBytes(self.a.bytes), TokenBytes(self.b.bytes)
        self.digits, self.shown = _digits(max(len(self.bytes_a.lengths), len(self.bytes_b.lengths)))

    def text(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3` of tokens and the numbers, from 0, of their groups; each group has tokens of both kinds."""
        n = len(a) + len(b)
        if not n:
            return b""
        groups = int(group_a[-1]) + 1
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        ids, marks = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        marks[at_a[np.searchsorted(group_a, np.arange(groups), "right") - 1]] = ord("|")
        marks[at_b[np.searchsorted(group_b, np.arange(groups), "right") - 1]] = ord(";")
        digits = self.digits[ids]
        digits[:, -1] = marks
        return digits[self.shown[ids]][:-1].tobytes()

    def fragment(self, window: bytes, a: np.ndarray, b: np.ndarray, lead: int, size: int):
        """(n_a, n_b, pairs, fragment) of the tokens that end in the `size` bytes after the first `lead` ones of a window; None if the tokens' bytes aren't the window's."""
        a = a.astype(np.int64)
        end_a, end_b = np.cumsum(self.bytes_a.lengths[a]), np.cumsum(self.bytes_b.lengths[b])
        want = np.frombuffer(window, np.uint8)
        for table, ids, ends in ((self.bytes_a, a, end_a), (self.bytes_b, b, end_b)):
            if (int(ends[-1]) if len(ends) else 0) != len(want) or not np.array_equal(table.joined(ids, ends), want):
                return None
        if lead or size < len(want):
            some = slice(*np.searchsorted(end_a, [lead, lead + size], "right"))
            a, end_a = a[some], end_a[some]
            some = slice(*np.searchsorted(end_b, [lead, lead + size], "right"))
            b, end_b = b[some], end_b[some]
        at = np.searchsorted(end_b, end_a)
        both = np.flatnonzero(end_b[np.minimum(at, len(end_b) - 1)] == end_a) if len(end_b) else np.empty(0, np.int64)
        ends_a, ends_b = both + 1, at[both] + 1
        pairs = a[both] * self.b.size + b[at[both]]
        if not len(both):
            return len(a), len(b), pairs, (False, a, b, b"", a[:0], b[:0])
        first, last = (ends_a[0], ends_b[0]), (ends_a[-1], ends_b[-1])
        mid_a, mid_b = slice(first[0], last[0]), slice(first[1], last[1])
        groups_a = np.repeat(np.arange(len(both) - 1), np.diff(ends_a))
        groups_b = np.repeat(np.arange(len(both) - 1), np.diff(ends_b))
        mid = self.text(a[mid_a], b[mid_b], groups_a, groups_b)
        return len(a), len(b), pairs, (True, a[: first[0]], b[: first[1]], mid, a[last[0] :], b[last[1] :])


def group(a, b) -> bytes:
    return (",".join(map(str, a)) + "|" + ",".join(map(str, b))).encode()


def compose(left: tuple, right: tuple) -> tuple:
    """The fragment of two neighbouring byte ranges; associative."""
    cut, head_a, head_b, mid, tail_a, tail_b = left
    if not cut:
        return (right[0], [*head_a, *right[1]], [*head_b, *right[2]], *right[3:])
    tail_a, tail_b = [*tail_a, *right[1]], [*tail_b, *right[2]]
    if not right[0]:
        return (True, head_a, head_b, mid, tail_a, tail_b)
    return (True, head_a, head_b, b";".join(x for x in (mid, group(tail_a, tail_b), right[3]) if x), right[4], right[5])


def closed(fragment: tuple) -> bytes:
    """All groups of a whole text's fragment, which ends in a common end."""
    _, head_a, head_b, mid, _, _ = fragment
    return b";".join(x for x in (group(head_a, head_b), mid) if x)


def ranges(words: list[str], chunk_bytes: int) -> Iterator[tuple[bytes, int, int]]:
    """(window, lead, size): byte ranges of a text, each in a window of the whole words that it touches. Ranges end after chunk_bytes, or after the word there if that is long, so that no long word is encoded more than twice."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    start, total = 0, int(ends[-1])
    while start < total:
        end = min(start + chunk_bytes, total)
        last = int(np.searchsorted(ends, end))
        if len(raw[last]) * 4 > chunk_bytes:
            end = int(ends[last])
        first = int(np.searchsorted(ends, start, "right"))
        begin = int(ends[first]) - len(raw[first])
        yield b"".join(raw[first : last + 1]), start - begin, end - start
        start = end


class Tally:
    """Pairs and their numbers of links, given on as rows of bounded size."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, pairs: np.ndarray, uses: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        self.parts.append((pairs, uses))
        self.n += len(pairs)
        if self.n < HELD:
            return []
        merged = self.merged()
        if len(merged[0]) * 2 < HELD:
            self.parts, self.n = [merged], len(merged[0])
            return []
        return self._rows(merged)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs, where = np.unique(np.concatenate([p for p, _ in self.parts]), return_inverse=True)
        return pairs, np.bincount(where, np.concatenate([u for _, u in self.parts]), len(pairs)).astype(np.int64)

    def _rows(self, merged) -> list[tuple[np.ndarray, np.ndarray]]:
        self.parts, self.n = [], 0
        return [(merged[0][i : i + ROW], merged[1][i : i + ROW]) for i in range(0, len(merged[0]), ROW)]

    def rest(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return self._rows(self.merged())


#: A row of the first pass: a document that is done, a byte range to do, or pairs with numbers of links.
FIRST = [("kind", pa.int8()), ("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("pairs", pa.list_(pa.int64())), ("uses", pa.list_(pa.int64())), ("sha256", pa.string()), ("groups", pa.binary()), ("chunk", pa.int32()), ("lead", pa.int64()), ("size", pa.int64()), ("window", pa.binary())]
DOCUMENT, RANGE, PAIRS = 0, 1, 2


def _first(byte_tokenizer: str, piece_model: str, chunk_bytes: int, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, tally, row, kind_of_id = Aligner(byte_tokenizer, piece_model), Tally(), TaskContext.get().partitionId() << 40, None
        split = tools.b.splitter()

        def batch_of(ids, rows: list[dict]) -> pa.RecordBatch:
            columns = [pa.array([r.get(name) for r in rows], kind) for name, kind in FIRST]
            return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *(name for name, _ in FIRST)])

        def counts(found) -> Iterator[pa.RecordBatch]:
            for pairs, uses in found:
                yield batch_of(pa.nulls(1, kind_of_id), [{"kind": PAIRS, "pairs": pairs, "uses": uses}])

        for batch in batches:
            kind_of_id = batch.schema.field("doc_id").type
            for few in slices(batch, "text"):
                texts = [" " + t if t else "" for t in few.column("text").to_pylist()]
                raw = [t.encode() for t in texts]
                short = [i for i, r in enumerate(raw) if 0 < len(r) <= chunk_bytes]
                pieces = dict(zip(short, tools.b.ids(texts[i] for i in short), strict=True))
                at, rows = [], []
                for i, text in enumerate(texts):
                    if len(raw[i]) > chunk_bytes:
                        for chunk, (window, lead, size) in enumerate(ranges(split(text), chunk_bytes)):
                            at.append(i)
                            rows.append({"kind": RANGE, "row": row, "chunk": chunk, "lead": lead, "size": size, "window": window})
                    else:
                        found = tools.fragment(raw[i], tools.a.ids(text), pieces[i], 0, len(raw[i])) if text else None
                        done = {"kind": DOCUMENT, "row": row, "n_a": 0, "n_b": 0, "n_groups": 0, "sha256": ""}
                        if found:
                            n_a, n_b, links, fragment = found
                            groups = closed(fragment)
                            pairs, uses = np.unique(links, return_counts=True)
                            done |= {"n_a": n_a, "n_b": n_b, "n_groups": len(links), "pairs": pairs, "uses": uses, "sha256": hashlib.sha256(groups).hexdigest(), "groups": groups if keep_groups else None}
                            yield from counts(tally.add(pairs, uses))
                        at.append(i)
                        rows.append(done)
                    row += 1
                yield batch_of(few.column("doc_id").take(pa.array(at, pa.int64())), rows)
        if kind_of_id is not None:
            yield from counts(tally.rest())

    return run


def _ranges(byte_tokenizer: str, piece_model: str):
    """Fragments of rows (row, chunk, lead, size, window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Aligner(byte_tokenizer, piece_model)
        for batch in batches:
            for few in slices(batch, "window"):
                out = []
                for r in few.to_pylist():
                    text = r["window"].decode()
                    found = tools.fragment(r["window"], tools.a.ids(text), tools.b.ids([text])[0], r["lead"], r["size"])
                    n_a, n_b, links, (cut, *ids) = found or (0, 0, np.empty(0, np.int64), (False, [], [], b"", [], []))
                    pairs, uses = np.unique(links, return_counts=True)
                    out.append((r["row"], r["chunk"], found is not None, n_a, n_b, len(links), pairs, uses, cut, *ids))
                longs = pa.list_(pa.int64())
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), longs, longs, pa.bool_(), longs, longs, pa.binary(), longs, longs]
                names = ["row", "chunk", "ok", "n_a", "n_b", "n_groups", "pairs", "uses", "cut", "head_a", "head_b", "mid", "tail_a", "tail_b"]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def _composed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One fragment of up to FAN neighbouring ones of a document."""
    whole = None
    for r in rows.sort_values("chunk").itertuples():
        own = (r.cut, list(r.head_a), list(r.head_b), r.mid, list(r.tail_a), list(r.tail_b))
        whole = compose(whole, own) if whole else own
    return pd.DataFrame([[key[0], key[1], *whole]], columns=["row", "chunk", "cut", "head_a", "head_b", "mid", "tail_a", "tail_b"])


def _reduced(fragments: DataFrame) -> DataFrame:
    """(row, groups): fragments(row, chunk, ...) of documents, composed level by level."""
    most = fragments.agg(F.max("chunk")).first()[0] or 0
    level = fragments.select("row", F.col("chunk").cast("int").alias("chunk"), "cut", "head_a", "head_b", "mid", "tail_a", "tail_b")
    while most > 0:
        level = level.withColumn("above", F.floor(F.col("chunk") / FAN).cast("int")).groupBy("row", "above").applyInPandas(_composed, f"row long, chunk int, {FRAGMENT}")
        level, most = _dist.materialize(level, "fragments"), most // FAN
    ids = F.concat(F.array_join(F.col("head_a").cast("array<string>"), ","), F.lit("|"), F.array_join(F.col("head_b").cast("array<string>"), ","))
    return level.select("row", F.concat_ws(";", ids, F.expr("nullif(cast(mid as string), '')")).alias("groups"))


def _looked_up(shared):
    """Rows (row, count_sum, n_best, pairs, uses): links with pairs of the broadcast table, and what isn't in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            pairs, uses = (np.asarray(batch.column(c).flatten()) for c in ("pairs", "uses"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            n = len(sizes)
            total, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, row[found], (uses[found] * counts[at[found]]))
            np.add.at(top, row[found], uses[found] * best[at[found]])
            left = np.bincount(row[~found], minlength=n)
            offsets = pa.array(np.append(0, np.cumsum(left)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[~found], pa.int64())) for x in (pairs, uses)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(total), pa.array(top), *lists], names=["row", "count_sum", "n_best", "pairs", "uses"])

    return run


def _most_frequent(pairs: DataFrame, most: int) -> tuple[int, int]:
    """(count, n): the n <= most pairs of at least that count are all those of the bands of counts, by powers of two, that fit."""
    band = F.floor(F.log2("count")).cast("int")
    bands = {r.band: r.n for r in pairs.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
    n, least = 0, None
    for k in sorted(bands, reverse=True):
        if n + bands[k] > most:
            break
        n, least = n + bands[k], 1 << k
    return (least or (1 << 62)), n


def aligned(docs: DataFrame, byte_tokenizer: str, piece_model: str, chunk_bytes: int = 1 << 16, keep_groups: bool = False, most_pairs: int = MOST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of docs(doc_id, text).

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups with
    keep_groups): tokens of the two vocabularies over a space and the text, the groups that common ends
    cut them into, links (tokens that end together), links whose pair of ids has its B id's highest
    count, sum of the counts of all links, digest of `a1,a2|b1;a3|b2,b3`. pairs: a, b, count, best: how
    many links of the corpus have that pair of ids, and whether no other A id has more for that B id.

    Texts that are null, empty, or whose tokens' bytes differ from the space and the text have no tokens:
    zeros and ''. Texts over chunk_bytes are cut in byte ranges that are encoded apart; their groups are
    composed in tasks of FAN fragments, the last of which hold a document's groups, about as long as its
    text. Repeated rows count as often as they are there; empty tables give none; other columns don't matter.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    table = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind}, kind byte, row long, n_a long, n_b long, n_groups long, pairs array<long>, uses array<long>, sha256 string, groups binary, chunk int, lead long, size long, window binary"
    first = _dist.materialize(_dist.small_batches(table).mapInArrow(_first(byte_tokenizer, piece_model, chunk_bytes, keep_groups), schema), "aligned")
    todo = first.where(F.col("kind") == RANGE).select("row", "chunk", "lead", "size", "window").repartition("row", "chunk")
    made = _dist.materialize(_dist.small_batches(todo).mapInArrow(_ranges(byte_tokenizer, piece_model), f"row long, chunk int, ok boolean, n_a long, n_b long, n_groups long, pairs array<long>, uses array<long>, {FRAGMENT}"), "ranges")
    # a text counts only if the bytes of all its ranges agree
    sums = made.groupBy("row").agg(F.min("ok").alias("ok"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")])
    sums = _dist.materialize(sums, "long")
    right = made.join(sums.where("ok").select("row"), "row", "left_semi")
    linked = first.where(F.col("kind") == PAIRS).select("pairs", "uses").union(right.select("pairs", "uses"))
    counted = linked.select(F.explode(F.arrays_zip("pairs", "uses")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.uses").alias("count"))
    n_b = Pieces(piece_model).size
    counted = _dist.materialize(counted.withColumn("b", F.col("pair") % n_b), "counted")
    pairs = counted.join(counted.groupBy("b").agg(F.max("count").alias("most")), "b").select("pair", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    pairs = _dist.materialize(pairs, "pairs")
    least, n = _most_frequent(pairs, most_pairs)
    top = pairs.where(F.col("count") >= least).select("pair", "count", F.col("best").cast("long").alias("best")).toArrow().sort_by("pair") if n else None
    arrays = tuple(top.column(c).to_numpy() for c in ("pair", "count", "best")) if n else (np.empty(0, np.int64),) * 3
    shared = spark.sparkContext.broadcast(arrays)
    units = first.where(F.col("kind") == DOCUMENT).select("row", "pairs", "uses").union(right.select("row", "pairs", "uses"))
    found = _dist.materialize(_dist.small_batches(units).mapInArrow(_looked_up(shared), "row long, count_sum long, n_best long, pairs array<long>, uses array<long>"), "looked-up")
    rare = found.select("row", F.explode(F.arrays_zip("pairs", "uses")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.uses").alias("uses"))
    # each rare pair has fewer than `least` links
    told = rare.join(pairs.where(F.col("count") < least), "pair").select("row", (F.col("uses") * F.col("count")).alias("count_sum"), (F.col("uses") * F.col("best").cast("long")).alias("n_best"))
    numbers = found.select("row", "count_sum", "n_best").union(told).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    long_ids = first.where((F.col("kind") == RANGE) & (F.col("chunk") == 0)).select("doc_id", "row")
    groups = _reduced(right)
    zero = lambda c: F.when(F.col("ok"), F.col(c)).otherwise(F.lit(0).cast("long")).alias(c)
    long_docs = long_ids.join(sums, "row").join(groups, "row", "left").select("doc_id", "row", zero("n_a"), zero("n_b"), zero("n_groups"), F.coalesce(F.sha2("groups", 256), F.lit("")).alias("sha256"), "groups")
    short_docs = first.where(F.col("kind") == DOCUMENT).select("doc_id", "row", "n_a", "n_b", "n_groups", "sha256", F.col("groups").cast("string").alias("groups"))
    out = short_docs.unionByName(long_docs).join(numbers, "row", "left")
    nought = F.lit(0).cast("long")
    told = out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", nought).alias("n_best"), F.coalesce("count_sum", nought).alias("count_sum"), F.col("sha256").alias("groups_sha256"), *(["groups"] if keep_groups else []))
    return told, pairs.select(F.floor(F.col("pair") / n_b).alias("a"), "b", "count", "best")
