import hashlib
import random
import re

from graphloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from graphloom.llm.jaccard_join import drop_near_duplicates, near_duplicates

SCHEMA = "doc_id long, text string, lang string, kept string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], SCHEMA)


def some_texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "one", "ONE", "two words", "Two  Words", "a\tb\nc", "a b c"]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([5, 30, 80, 150]))
        for _ in range(rng.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    passage = " ".join(rng.choices(words, k=40))
    texts += [passage + " " + " ".join(rng.choices(words, k=60)) for _ in range(20)]
    texts += texts[12:20] + ["long " + "x" * 40_000, "long " + "x" * 40_000, "long " + "x" * 40_001]
    return texts


def test_exact_against_brute_force(spark):
    texts = some_texts()
    for id_bits in (64, 3):
        got = {r.doc_id: r for r in exact_duplicates(table(spark, texts), id_bits).collect()}
        norm = [re.sub(r"[\x20\t-\r]+", " ", t or "") for t in texts]
        groups = {}
        for i, t in enumerate(norm):
            groups.setdefault(t, []).append(i)
        assert len(got) == len(texts)
        for i, t in enumerate(norm):
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (groups[t][0], len(groups[t]), groups[t][0] == i, hashlib.sha256(t.encode()).hexdigest())


def test_exact_drop_and_odd_rows(spark):
    rows = [(3, "a b", "en", None), (3, "a b", "en", None), (None, "a  b", None, "z"), (None, None, None, None), (7, "", "de", None), (8, "c", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(3, "a b"), (7, ""), (8, "c")]
    assert drop_exact_duplicates(docs.limit(0)).count() == 0


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * len(a | sets[j]):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return sets, label


def test_near_against_brute_force(spark):
    for seed, k, num, den in ((1, 3, 9, 10), (2, 5, 4, 5), (3, 1, 4, 5)):
        texts = some_texts(seed)
        sets, label = brute_components(texts, k, num, den)
        got = {r.doc_id: r for r in near_duplicates(table(spark, texts), k, num, den).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), label[i]) for i in range(len(texts))}
        assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_in_several_parts(spark, monkeypatch):
    from graphloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "PART_TOKENS", 400)
    monkeypatch.setattr(jaccard_join, "LIGHT", 1)
    texts = some_texts(4)
    _, label = brute_components(texts, 3, 9, 10)
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, texts), 3, 9, 10).collect()}
    assert got == dict(enumerate(label))


def test_near_drop_and_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(200))
    rows = [(5, long, None, None), (5, long, None, None), (2, long + " end", None, "q"), (None, long, None, None), (9, None, None, None), (10, "", None, None), (11, "", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[-3:]) for r in out.collect()) == [(2, "end"), (9, ""), (10, ""), (11, "")]
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_repeated_ids(spark):
    """Rows with one doc_id and text that differ elsewhere, with maps, string ids and clashing names."""
    rows = [("3", "a b c d e f", "en", {"k": 1}), ("3", "a b c d e f", "de", {"k": 1}), ("3", "a  b c d e f", "en", {}), ("4", "a b c d e f g", "en", None), (None, "other words", "en", None), (None, "other words", "de", None), ("5", "", "en", None), ("5", "", "de", None), ("6", None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __key string, Kept map<string,int>")
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    found = sorted((str(r.doc_id), r.text) for r in left.collect())
    assert [f[0] for f in found] == ["3", "4", "5", "None"]
    near = sorted((str(r.doc_id), r.text) for r in drop_near_duplicates(docs, k=2, num=1, den=2).collect())
    assert [f[0] for f in near] == ["3", "5", "5", "6", "None"]
    whole = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size) for r in exact_duplicates(docs).collect()}
    assert {v for k, v in whole.items() if k[0] == "3"} == {("3", 3)}
    assert drop_exact_duplicates(docs.limit(0)).count() == drop_near_duplicates(docs.limit(0)).count() == 0


def test_long_texts(spark):
    """Texts of over a megabyte: exact and near copies of one, and another one."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    texts = [" ".join(words), "  ".join(words), " ".join([*words[:-1], "end"]), " ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in drop_exact_duplicates(docs).collect()} == {0, 2, 3}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_near_in_a_chained_cluster_of_many_parts(spark, monkeypatch):
    """A cluster of over ten parts: a group of near copies that fills several parts, and texts chained by common passages."""
    from graphloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "PART_TOKENS", 600)
    monkeypatch.setattr(jaccard_join, "LIGHT", 2)
    rng = random.Random(12)
    word = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages, base, texts = [word(60) for _ in range(4)], word(70), []
    for i in range(45):
        t = list(base)
        t[rng.randrange(70)] = f"edit{i % 9}"
        texts.append(" ".join(t))
    for i in range(40):
        t = passages[i % 4] + word(9) + (passages[(i + 1) % 4][:25] if i % 3 else base[:20])
        texts += [" ".join(t), " ".join([*t[:-1], "last"])][: 1 + i % 2]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    seen, real = [], jaccard_join._open_blocks
    monkeypatch.setattr(jaccard_join, "_open_blocks", lambda parts, *more: seen.append(parts.select("part").distinct().count()) or real(parts, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in near_duplicates(docs, k=3, num=4, den=5).orderBy("doc_id").collect()] == root
    assert seen and seen[0] >= 10
