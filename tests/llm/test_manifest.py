"""Manifests against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle_manifest as mm


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, at):
    out = []
    for nodes in tree[:-1]:
        run = range(at - at % 3, min(at - at % 3 + 3, len(nodes)))
        out.append(([nodes[i] for i in run if i < at], [nodes[i] for i in run if i > at]))
        at //= 3
    return out


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[s]]) for s in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for i, s in enumerate(order):
        for j, r in enumerate(groups[s]):
            path = way(trees[i], j) + way(top, i)
            text = r[4].replace("\n", "") if r[4] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            node = leaf((*r[:4], text))
            for a, b in path:
                node = digest("".join([*a, node, *b]))
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[i][-1][0], root, digest("".join(x for a, b in path for x in a + b)), node, node == root))
    return Counter(out)


def run(spark, rows, kind="long"):
    docs = spark.createDataFrame(rows, f"doc_id {kind}, source string, lang string, n_chars int, text string").repartition(3)
    docs = docs.withColumns({"place": F.lit("x"), "Leaf": F.lit(1), "n": F.lit(2)})
    found = mm.manifest(docs, mm.without_line_ends())
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect())


def some_rows(seed, n, ids, sources):
    rng = random.Random(seed)
    texts = [None, "", "one\ntwo", "plain", "ünïcode\n\n", "日本"]
    return [(rng.choice(ids), rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice(texts)) for _ in range(n)]


CASES = {
    "one row": [(7, "a", "en", 1, "x\ny")],
    "null group and id": [(None, None, None, None, None), (1, None, None, None, "a\n"), (2, "", "en", 2, "b")],
    "no repeats": [(i, f"s{i % 7}", "en", i, f"t{i}\n") for i in range(500)],
    "sparse ids": [(i * 987654321987 - (1 << 62), f"s{i % 2}", "en", i, f"t{i}\n") for i in range(200)],
    "extremes": [(i, "s", None, None, "\n") for i in (-(1 << 63), (1 << 63) - 1, 0, -1, 63, 64, None)],
    "repeats": some_rows(1, 400, [*range(20), None], ["a", "b", None, "é", "z" * 300]),
    "one hot row": [(5, "a", "en", 1, "same\n")] * 300 + [(i, "a", "en", 1, "other\n") for i in range(10)],
    "one hot id": [(5, "a", "en", i, f"text {i}\n") for i in range(300)] + [(i, "a", "en", 1, "other") for i in range(100)],
    "many sources": [(i, f"s{i}", "en", 1, "t") for i in range(800)],
    "a long text": [(1, "a", "en", 1, "word\n" * 60_000), (2, "a", "en", 1, "")],
}


@pytest.mark.parametrize("name", CASES)
def test_against_plain_python(spark, name):
    assert run(spark, CASES[name]) == expected(CASES[name])


def test_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(mm, "LEVELS", 2)
    monkeypatch.setattr(mm, "SLOTS", 9)
    monkeypatch.setattr(mm, "FAN_BITS", 3)
    monkeypatch.setattr(mm, "REPEATS", 7)
    for name in ("no repeats", "repeats", "one hot row", "many sources", "sparse ids"):
        assert run(spark, CASES[name]) == expected(CASES[name])


def test_empty_tables_and_types(spark):
    assert run(spark, []) == Counter()
    assert run(spark, [(1, "a", None, None, "t")], "int") == expected([(1, "a", None, None, "t")])
    with pytest.raises(TypeError):
        run(spark, [("x", "a", None, None, "t")], "string")
