"""Packing against plain Python: every document's ids are found again in its sequences, and few are used."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bestfit_packing as bp

JSON = "/opt/tokenizers/byte_bpe_50k.json"


def filled(plan, histogram, capacity):
    """Documents of a plan by sequence, checked to lie side by side."""
    counts, inside = Counter(), defaultdict(list)
    for length, rank, n, sequence, each, offset in plan.runs:
        assert counts[length] == rank
        counts[length] += n
        for i in range(n):
            inside[sequence + i // each].append((offset + i % each * length, length))
    assert counts == Counter({k: v for k, v in histogram.items() if v})
    assert sorted(inside) == list(range(plan.sequences))
    for places in inside.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


@pytest.mark.parametrize("seed", range(12))
def test_plans_hold_every_document_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 30, 100])
    histogram = Counter()
    for _ in range(rng.randint(0, 200)):
        histogram[rng.randint(1, capacity)] += rng.choice([1, 1, 5, 100])
    plain = bp.Plan()
    bp._best_fit(plain, dict(histogram), defaultdict(list), capacity)
    filled(plain, histogram, capacity)
    best = bp.best_plan(histogram, capacity)
    filled(best, histogram, capacity)
    assert best.sequences <= plain.sequences * 1.02 + 1


def test_configurations_are_optimal_where_it_is_known():
    # 7 + 3 fill 10, as do two of 5
    found = bp.configurations([7, 5, 3], [100, 50, 100], 10)
    assert sum(n for _, n in found) == 125


def packed(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return bp.pack(docs.withColumns({"start": F.lit("x"), "Rank": F.lit(1)}), JSON, keep_ids=True, **options).collect()


def test_pieces_against_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    words = ["alpha", "Βeta", "x1", "...", "don't", "日本", "\n", " ", "<|endoftext|>", "á"]
    texts = [None, "", " ", "\n\n ", *["".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\t", " \n"]) for _ in range(rng.choice([1, 3, 30, 200]))) for _ in range(60)], "word " * 30_000, "same text", "same text"]
    library = Tokenizer.from_file(JSON)
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    capacity, rows = 256, packed(spark, texts, capacity=256)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        pieces[r.doc_id].append((r.piece, r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        assert [x for _, _, p in sorted(pieces[i]) for x in p] == ids
        sizes = [len(p) for _, _, p in sorted(pieces[i])]
        assert sizes == ([len(ids)] if len(ids) <= capacity else [len(ids) % capacity or capacity] + [capacity] * (-(-len(ids) // capacity) - 1))
        assert [s for _, s, _ in sorted(pieces[i])] == [sum(sizes[:k]) for k in range(len(sizes))]
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= math.ceil(sum(map(len, want.values())) / capacity) + 1


def test_sequences_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    rows = bp.sequences(docs, JSON, capacity=8).collect()
    assert sum(r.length for r in rows) == 9 and all(len(r.ids) == 4 * r.length <= 32 for r in rows)
    assert bp.pack(docs.limit(0), JSON).count() == 0


def test_packs_the_sf0001_documents_tightly(spark):
    rows = bp.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), JSON).collect()
    least = math.ceil(sum(r.length for r in rows) / 2048)
    assert len({r.sequence_id for r in rows}) <= least + 1
