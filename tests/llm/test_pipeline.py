"""The five stages of the corpus pipeline against plain Python, stage by stage, over a small directory of tables."""

import random
import re

import pytest

from graphloom.llm.quality_fm import quality_scores

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(8)
    good, bad = [f"word{i}" for i in range(3000)], ["buy", "***", "###", "click", "$$$"]
    items = [" ".join(rng.choices(good, k=14)) for _ in range(6)]
    texts = []
    for i in range(150):
        texts.append(" ".join(rng.choices(good, k=rng.randrange(30, 90))))
    texts += [re.sub(" ", "  ", texts[i]) for i in range(0, 30, 3)]  # exact copies but for white space
    texts += [texts[i] + " changed" for i in range(1, 30, 3)]  # near copies
    texts += [texts[40 + i] + " " + items[i % 6][: -len(items[i % 6].split()[-1])] for i in range(12)]  # benchmark passages
    texts += [" ".join(w + rng.choice(bad) for w in rng.choices(good[:40], k=30)) for _ in range(60)]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(7, texts[7], "de", "b", None), (None, "a text without an id", None, None, None), (900, "", "en", "a", 0), (901, None, "en", "a", None)]
    return rows, items, [(i, int(not any(b in t for b in bad)), 0) for i, t in enumerate(texts)]


def near_roots(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_stages_against_plain_python(spark, tmp_path):
    rows, items, labels = fixture()
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "source_mixing" or out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        kept[name] = [r.asDict() for r in docs.collect()]
    names = list(kept)
    plain = lambda found: sorted((str(r["doc_id"]), str(r["text"])) for r in found)
    scored = quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in scored.where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept[names[0]]} == good and len(good) > 150
    # exact: the smallest doc_id of each normalised text, one row of a repeated id
    first = {}
    for r in sorted(kept[names[0]], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        first.setdefault(re.sub(r"[\x20\t-\r]+", " ", r["text"] or ""), r)
    assert plain(kept[names[1]]) == plain(first.values())
    # near: the smallest doc_id of each component
    rest = sorted(kept[names[1]], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    root = near_roots([r["text"] or "" for r in rest])
    assert plain(kept[names[2]]) == plain(r for i, r in enumerate(rest) if root[i] == i)
    # benchmark: no window of ten item words
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[i : i + 10]) for w in (word.findall(t.lower()) for t in items) for i in range(len(w) - 9)}
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [word.findall((t or "").lower())] for i in range(len(w) - 9))
    assert plain(kept[names[3]]) == plain(r for r in kept[names[2]] if not hit(r["text"])) and len(kept[names[3]]) < len(kept[names[2]])
    # mix: each piece's words are its document's, and sources come near their targets
    words, sums, sizes = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in kept[names[3]]}, {}, {}
    for r in kept[names[3]]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words[r["doc_id"]])
    for r in kept[names[4]]:
        assert r["text"] == " ".join(words[r["doc_id"]][r["from_word"] : r["from_word"] + r["words"]])
        sums[r["source"]] = sums.get(r["source"], 0) + r["words"]
    assert sum(sums.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.1) and all(sums[s] <= 2 * sizes[s] for s in sizes)
    # run() is its stages
    assert plain(r.asDict() for r in corpus_pipeline.run(spark, folder).collect()) == plain(kept[names[4]])
