"""Walks through hubs, modularity kept through changes, names joined by rare pairs of letters."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from graphloom.operators import graph, registry
from pyspark.sql import functions as F


def test_steps_at_a_hub(spark):
    weights = {f"n{k}": (k % 7 + 1) * (500.0 if k == 3 else 1.0) for k in range(6000)}
    edges = spark.createDataFrame([("hub", k, w) for k, w in weights.items()] + [("hub", "zero", 0.0), ("n1", "n2", 2.0), ("s", "s", 1.0)], "src string, dst string, weight double")
    table = graph.steps(edges).cache()
    at_hub = table.where("id = 'hub'")
    assert at_hub.count() <= 2 * len(weights) and at_hub.where("other = 'zero'").count() == 0
    rows = at_hub.select("cell", "low", "high", "other").distinct().collect()
    ranges = sorted({(r.low, r.high, r.other) for r in rows})
    assert ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    units = ranges[-1][1]
    assert units == table.where("other = 'hub'").select("units").first()[0]
    total = sum(weights.values())
    assert all(abs((high - low) / units - weights[k] / total) < 1e-9 for low, high, k in ranges)
    nodes = spark.createDataFrame([("hub",), ("n1",), ("s",), ("lonely",)], "id string")
    paths = graph.walks(nodes, edges, 3000, 3, 5).collect()
    assert len(paths) == len({r.walk for r in paths}) == 12000
    assert {tuple(r.path) for r in paths if r.path[0] in ("s", "lonely")} == {("s", "s", "s"), ("lonely",)}
    first = Counter(r.path[1] for r in paths if r.path[0] == "hub")
    share = weights["n3"] / total
    assert abs(first["n3"] / 3000 - share) < 4 * (share * (1 - share) / 3000) ** 0.5
    back = Counter(r.path[1] for r in paths if r.path[0] == "n1")
    assert set(back) == {"hub", "n2"} and abs(back["hub"] / 3000 - 0.5) < 0.04  # weights 2 and 2
    assert graph.walks(nodes, edges.limit(0), 1, 3).select(F.max(F.size("path"))).first()[0] == 1


def test_modularity_kept_through_changes(spark):
    draw = random.Random(3)
    edges = {tuple(sorted(draw.sample(range(40), 2))): float(draw.randrange(1, 5)) for _ in range(120)}
    clusters = {k: f"c{k % 5}" for k in range(40)}
    table = lambda e, c: (spark.createDataFrame([(a, b, w) for (a, b), w in e.items()], "src long, dst long, weight double"), spark.createDataFrame(list(c.items()), "id long, cluster string"))
    e, c = table(edges, clusters)
    sums = graph.modularity_sums(e, c, True)
    for turn in range(10):
        new, moved = dict(edges), dict(clusters)
        touched = set()
        for pair in draw.sample(sorted(new), 4):
            del new[pair]
            touched.add(pair[turn % 2])
        for _ in range(5):
            pair = tuple(sorted(draw.sample(range(40 + turn), 2)))
            new[pair] = new.get(pair, 0.0) + 1.0
            touched.add(pair[1])
        for k in draw.sample(sorted(moved), 3):
            moved[k] = f"c{draw.randrange(7)}"
        moved |= {k: "fresh" for k in range(40, 40 + turn) if k not in moved}
        e2, c2 = table(new, moved)
        sums = spark.createDataFrame(graph.updated_sums(sums, e, e2, c, c2, spark.createDataFrame([(k,) for k in touched], "id long"), True).collect(), "cluster string, inside double, degree double")
        edges, clusters, e, c = new, moved, e2, c2
    full = graph.modularity(e, c, weighted=True).first()[0]
    assert graph.modularity_of(sums).first()[0] == pytest.approx(full, abs=1e-9)
    assert graph.modularity_of(graph.modularity_sums(e.limit(0), c)).first()[0] is None


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 0.95])
def test_near_names_lose_nothing(spark, threshold):
    draw = random.Random(11)
    words = ["".join(draw.choice("abcé") for _ in range(draw.randrange(1, 18))) for _ in range(120)]
    changed = []
    for w in words:
        k = draw.randrange(len(w))
        changed += [w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w + w[:3]]
    names, asked = sorted(set(words) | {""}), sorted(set(changed) | {"", "a"})
    found = registry.near_names(spark.createDataFrame([(a,) for a in asked], "a string"), spark.createDataFrame([(b,) for b in names], "b string"), threshold).collect()
    met = {(r.a, r.b) for r in found}
    want = {(a, b) for a in asked for b in names if a and b and SequenceMatcher(None, a, b).ratio() >= threshold}
    assert len(met) == len(found) and want and want <= met
