import hashlib
import random
import re

from graphloom.llm.decontaminate import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, n=10):
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for item, it in items:
            iw = split(it)
            m = min(n, len(iw))
            for j in range(len(iw) - m + 1 if m else 0):
                for i in range(len(w) - m + 1):
                    if w[i : i + m] == iw[j : j + m]:
                        hit |= set(range(i, i + m))
                        found.add(str(item))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def fixture():
    rng = random.Random(5)
    vocab = ["the", "Été", "B2", "x", "y", "zürich", "of", "AND", "q"] + [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([11, 14, 25])))) for i in range(12)] + [(100, "ÉTÉ short one"), (101, ""), (102, None), (7, "Short ONE"), (103, "?!")]
    texts = [None, "", "été Short-one short one", "ÉTÉ short one", "!!! ..."]
    for _ in range(40):
        t = rng.choices(vocab, k=rng.randrange(40))
        if rng.random() < 0.6:
            src = rng.choice(items[:12])[1].split(" ")
            a = rng.randrange(len(src))
            t[rng.randrange(len(t) + 1) : 0] = src[a : a + rng.choice([9, 10, 12, 25])]
        texts.append(rng.choice([" ", ", ", "\n"]).join(t).upper() if rng.random() < 0.3 else " ".join(t))
    texts += texts[:8]
    return texts, items


def test_against_brute_force(spark):
    texts, items = fixture()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in contamination(docs, bench).collect()}
    want = brute(texts, items)
    assert got == dict(enumerate(want))
    # hashes in blocks
    assert {r.doc_id: tuple(r)[1:6] for r in contamination(docs, bench, block=40).collect()} == got
    kept = {r.doc_id for r in decontaminate(docs, bench).collect()}
    assert kept == {i for i, w in enumerate(want) if not w[4]}


def test_spans_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "Keep this: a b c d e f g h i j! And more."), (None, None), (None, "a b c d e f g h i j"), (2, "clean  text ")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "A B C D E F G H I J")], "item_id string, text string")
    out = sorted((str(r.doc_id), r.text) for r in decontaminate(docs, bench, remove="spans").collect() if r.text is not None)
    assert out == [("1", "Keep this! And more."), ("2", "clean  text "), ("None", "")]
    assert decontaminate(docs, bench).count() == 2
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0


def test_clashing_names_and_long_texts(spark):
    """Columns named like the operator's own, and texts of over a megabyte with a hit at their end."""
    long_ = "clean words here " * 60_000
    rows = [(1, "x a b c d e f g h i j y", 1, 2, 3, {"k": 1}), (2, long_ + "a b c d e f g h i j", 1, 2, 3, None), (3, long_, 1, 2, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans int, __id int, Row_Key int, m map<string,int>")
    bench = spark.createDataFrame([(7, "A B C D E F G H I J")], "item_id long, text string")
    cut = decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns
    assert {r.doc_id: (len(r.text), r.spans) for r in cut.collect()} == {1: (3, 1), 2: (len(long_) - 1, 1), 3: (len(long_), 1)}
    assert [tuple(r) for r in decontaminate(docs, bench).collect()] == [rows[2]]
    assert {r.doc_id: (r.n_words, r.n_hit) for r in contamination(docs, bench).collect()} == {1: (12, 10), 2: (180_010, 10), 3: (180_000, 0)}


def test_many_spans_of_one_long_text(spark):
    import time

    item = " ".join(f"bench{k}" for k in range(10))
    text = ", ".join(f"{item} own{k}" for k in range(8000))  # 88,000 words, 8,000 spans
    docs = spark.createDataFrame([(1, text), (2, item), (3, "")], "doc_id int, text string")
    bench = spark.createDataFrame([("b", item)], "item_id string, text string")
    begun = time.monotonic()
    found = {r.doc_id: r.text for r in decontaminate(docs, bench, remove="spans").collect()}
    assert found[1].split() == [f"own{k}" for k in range(8000)] and found[2].strip() == "" and found[3] == ""
    print("seconds:", time.monotonic() - begun)
