"""Best-fit packing of tokenised documents by linear grouping.

Only a histogram of lengths, a number for each length up to the capacity, goes to the driver. Long
lengths in descending order are cut into groups of equal cardinality and each group is rounded up to its
longest one, which leaves few sizes. Column generation finds fractional numbers of configurations of
these sizes; their whole parts are filled with the groups' actual lengths, longest first. What is left,
and all short lengths, go by best fit into the room that really remains. The plan consists of runs: so
many documents of one length, from a rank on, go to so many consecutive sequences. Its size follows the
numbers of lengths and groups, not of documents. A document finds its run by its length and its rank
among those of its length, which comes from counts by partition.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _dist
from ._pieces import ByteLevel
from ._words import slices

#: What is tried, the plan with the fewest sequences is taken: numbers of groups, the parts of the capacity that long
#: lengths are over, and whether the last slot of a configuration keeps to its group too.
GROUPS, LONG, STRICT = (16, 64), (3, 4, 8), (False, True)


@dataclass
class Plan:
    """Runs (length, first rank, documents, first sequence, documents in a sequence, offset), and the number of sequences."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    ranks: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.ranks[length], n, sequence, each, offset))
        self.ranks[length] += n

    def more(self, n: int) -> int:
        first = self.sequences
        self.sequences += n
        return first


def best_pattern(sizes: list[int], values: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size a sequence holds for the greatest value."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (size, value) in enumerate(zip(sizes, values, strict=True)):
        if value <= 0:
            continue
        for _ in range(capacity // size):
            found = best[:-size] + value
            better = np.flatnonzero(found > best[size:] + 1e-12)
            if not len(better):
                break
            best[size + better], last[size + better] = found[better], i
    out, room = np.zeros(len(sizes)), int(np.argmax(best))
    while room >= 0 and last[room] >= 0:
        out[last[room]] += 1
        room -= sizes[last[room]]
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, whole number of sequences with it): the least fractional number of sequences that hold all counts, rounded down."""
    basis = np.diag([float(capacity // s) for s in sizes])
    amount = np.array(counts, float) / basis.diagonal()
    for _ in range(40 * len(sizes)):
        values = np.linalg.solve(basis.T, np.ones(len(sizes)))
        pattern = best_pattern(sizes, values, capacity)
        if pattern @ values <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern)
        some = np.flatnonzero(step > 1e-9)
        leaves = some[np.argmin(amount[some] / step[some])]
        by = max(amount[leaves] / step[leaves], 0.0)
        amount -= by * step
        amount[leaves] = by
        basis[:, leaves] = pattern
    return [(np.rint(basis[:, i]).astype(int), int(np.floor(amount[i] + 1e-7))) for i in range(len(sizes)) if amount[i] >= 1 - 1e-7]


def grouped(histogram: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """(rounded length, documents) of groups of equal cardinality of the lengths in descending order; groups that are rounded to one length count as one."""
    each = -(-sum(histogram.values()) // groups)
    out: dict[int, int] = {}
    room = top = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room:
                top, room = length, each
            n = min(left, room)
            out[top] = out.get(top, 0) + n
            left, room = left - n, room - n
    return list(out.items())


def _substitute(out: Plan, sizes: list[int], n: int, long: list[int], left: dict[int, int], capacity: int, strict: bool) -> list[tuple[int, int, int]]:
    """Fill n sequences of a configuration of rounded sizes, longest first: each slot takes the longest document left that its size admits, the last of several slots, unless strict, the longest one that really fits. Returns (first sequence, n, room) of what was filled."""
    filled, first = [], out.more(n)
    while n:
        chosen, room = [], capacity
        for i, size in enumerate(sizes):
            most = room if 0 < i == len(sizes) - 1 and not strict else min(size, room)
            at = bisect.bisect_right(long, most) - 1
            while at >= 0 and chosen.count(long[at]) >= left[long[at]]:
                at -= 1
            if at >= 0:
                chosen.append(long[at])
                room -= long[at]
        # sequences that all hold the same lengths
        stretch = min([n, *(left[s] // chosen.count(s) for s in chosen)])
        offset = 0
        for s in chosen:
            out.put(s, stretch, first, 1, offset)
            left[s] -= stretch
            offset += s
        for s in {s for s in chosen if not left[s]}:
            long.remove(s)
        filled.append((first, stretch, room))
        first, n = first + stretch, n - stretch
    return filled


def plan(histogram: dict[int, int], capacity: int, groups: int, part: int, strict: bool) -> Plan:
    out, rooms = Plan(), defaultdict(list)  # room left -> runs [first sequence, n] of sequences
    left = dict(histogram)
    full = left.pop(capacity, 0)
    if full:
        out.put(capacity, full, out.more(full), 1, 0)
    long = sorted(s for s in left if s * part > capacity)
    classes = grouped({s: left[s] for s in long}, groups) if long else []
    found = configurations([s for s, _ in classes], [n for _, n in classes], capacity)
    for pattern, n in sorted(found, key=lambda x: [s for (s, _), k in zip(classes, x[0], strict=True) for _ in range(k)], reverse=True):
        sizes = [s for (s, _), k in zip(classes, pattern, strict=True) for _ in range(k)]
        for first, many, room in _substitute(out, sizes, n, long, left, capacity, strict):
            rooms[room].append([first, many])
    _best_fit(out, {s: n for s, n in left.items() if n}, rooms, capacity)
    return out


def _best_fit(out: Plan, left: dict[int, int], rooms: dict[int, list[list[int]]], capacity: int) -> None:
    """Each length, longest first, to the sequences with the least room for it, else to new ones."""
    for length in sorted(left, reverse=True):
        n = left[length]
        for room in sorted(r for r in rooms if r >= length):
            runs, each = rooms[room], room // length
            while n and runs:
                first, many = runs.pop()
                used = min(many, n // each)
                if used:
                    out.put(length, used * each, first, each, capacity - room)
                    rooms[room - each * length].append([first, used])
                    n -= used * each
                if used < many and 0 < n < each:
                    out.put(length, n, first + used, n, capacity - room)
                    rooms[room - n * length].append([first + used, 1])
                    n, used = 0, used + 1
                if used < many:
                    runs.append([first + used, many - used])
            if not n:
                break
        if n:
            each = capacity // length
            whole, rest = divmod(n, each)
            if whole:
                first = out.more(whole)
                out.put(length, whole * each, first, each, 0)
                rooms[capacity - each * length].append([first, whole])
            if rest:
                first = out.more(1)
                out.put(length, rest, first, rest, 0)
                rooms[capacity - rest * length].append([first, 1])
        for room in [r for r, runs in rooms.items() if not runs or not r]:
            del rooms[room]


def best_plan(histogram: dict[int, int], capacity: int) -> Plan:
    return min((plan(histogram, capacity, *x) for x in itertools.product(GROUPS, LONG, STRICT)), key=lambda p: p.sequences)


def _cut(tokenizer: str, capacity: int, end: int, keep_ids: bool):
    """Rows (doc_id, piece, start, length, ids_crc32, part, place, ids) of documents; place: number of earlier pieces of that length in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteLevel(tokenizer, plain=False)
        part, places, last = TaskContext.get().partitionId(), defaultdict(int), np.array([end], "<u4").tobytes()
        for batch in batches:
            for few in slices(batch, "text"):
                ids, rows = few.column("doc_id"), {k: [] for k in ("at", "piece", "start", "length", "crc", "place", "ids")}
                for i, text in enumerate(few.column("text").to_pylist()):
                    data = model.ids(text or "").astype("<u4").tobytes() + last
                    n = len(data) // 4
                    bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        own = data[4 * a : 4 * b]
                        for name, value in zip(rows, (i, piece, a, b - a, zlib.crc32(own), places[b - a], own if keep_ids else None), strict=True):
                            rows[name].append(value)
                        places[b - a] += 1
                at = pa.array(rows["at"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), pa.array(rows["piece"], pa.int32()), *[pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc")], pa.array([part] * len(at), pa.int32()), pa.array(rows["place"], pa.int64()), pa.array(rows["ids"], pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"],
                )

    return run


def _place(runs: np.ndarray):
    """Rows with their sequence and offset: a row's run is the last one of its length that doesn't begin after its rank."""
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    lengths, first = np.unique(runs[:, 0], return_index=True)
    bounds = np.append(first, len(runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            mine = np.empty(len(length), np.int64)
            for s in np.unique(length):
                k = int(np.searchsorted(lengths, s))
                rows = np.flatnonzero(length == s)
                mine[rows] = bounds[k] + np.searchsorted(runs[bounds[k] : bounds[k + 1], 1], rank[rows], "right") - 1
            _, start, _, sequence, each, offset = runs[mine].T
            within = rank - start
            kept = [c for c in batch.schema.names if c != "rank"]
            made = [pa.array(sequence + within // each), pa.array(offset + within % each * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text) and where they go: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian unsigned 32-bit) with keep_ids.

    A document is its text's ids and the id `end`; null and empty texts are `end` alone. Longer ones than
    `capacity` are cut into pieces of that many ids, the first of which may be shorter, and no others are
    cut. Sequences are numbered from 0 and filled without gaps. Of equal lengths any may stand for another,
    so repeated rows need no care; results follow the table's partitions. A very long text is encoded in
    one task, in memory in proportion to its bytes. Empty tables give no rows; other columns don't matter.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    table = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    made = _dist.small_batches(table).mapInArrow(_cut(tokenizer, capacity, end, keep_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long, ids binary")
    made = _dist.materialize(made if keep_ids else made.drop("ids"), "pieces")
    counts = _dist.materialize(made.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    # a row for each partition and length, at most
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(np.array(best_plan(histogram, capacity).runs or np.empty((0, 6)), np.int64))
    ranked = made.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, {'ids binary, ' if keep_ids else ''}sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(lambda batches: _place(runs.value)(batches), schema)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, none longer than the capacity."""
    found = pack(docs, tokenizer, capacity, end, keep_ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return found.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
