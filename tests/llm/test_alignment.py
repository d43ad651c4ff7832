"""Alignment against the libraries' own whole encodings and plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from graphloom.llm import token_alignment as ta
from graphloom.llm._pieces import ByteLevel, Pieces

JSON, MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def some_texts(seed, n, longest):
    rng = random.Random(seed)
    words = ["alpha", "Βeta", "x1", "...", "don't", "日本語", "ﬁx", "<s>", "<0x0A>", "<|endoftext|>", "á", "naïve", "ő", "1234567", ");", "🙂", "\x00", "\x1c"]
    ends = ["", " ", " ", " ", "  ", "\t", "\n", "\r\n", " \n", "\n\n  ", "　", "\xa0", ";\r", " "]
    return ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def plain(texts):
    """Groups of each text as lists of A and B ids, by whole encodings; None where the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_model.encode_special_tokens = True
    a_bytes, b_bytes = ByteLevel(JSON, True).bytes, Pieces(MODEL).bytes
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
        want = (" " + t).encode()
        if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            out.append(None)
            continue
        ends_a, ends_b = ({e: i + 1 for i, e in enumerate(np.cumsum([len(table[x]) for x in ids]).tolist())} for table, ids in ((a_bytes, a), (b_bytes, b)))
        groups = []
        start_a = start_b = 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            i, j = ends_a[e], ends_b[e]
            groups.append((a[start_a:i], b[start_b:j]))
            start_a, start_b = i, j
        out.append(groups)
    return out


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(texts):
    found = plain(texts)
    counts = Counter((a[-1], b[-1]) for groups in found if groups for a, b in groups)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = []
    for groups in found:
        links = [(a[-1], b[-1]) for a, b in groups or []]
        sha = hashlib.sha256(written(groups).encode()).hexdigest() if groups else ""
        rows.append((sum(len(a) for a, _ in groups or []), sum(len(b) for _, b in groups or []), len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha))
    return rows, counts


def run(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    documents, pairs = ta.aligned(docs.selectExpr("*", "1 AS row", "'x' AS Pairs"), JSON, MODEL, **options)
    return {r.doc_id: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in documents.collect()}, {(r.a, r.b): r["count"] for r in pairs.collect()}


def test_aligned_against_whole_encodings(spark):
    texts = [None, "", " ", "▁", "a▁b", "word", "word", "\n", *some_texts(1, 60, 40), *some_texts(2, 2, 400), "x" * 3000, "日" * 700]
    want, counts = expected(texts)
    for options in ({}, {"chunk_bytes": 200, "most_pairs": 40}, {"chunk_bytes": 37, "most_pairs": 0}):
        rows, pairs = run(spark, texts, **options)
        assert [rows[i] for i in range(len(texts))] == want
        assert pairs == dict(counts)


def test_a_long_text_and_empty_tables(spark):
    text = " ".join(some_texts(3, 900, 40))
    assert len(text.encode()) > 65536
    want, _ = expected([text, "short text"])
    rows, _ = run(spark, [text, "short text"])
    assert [rows[0], rows[1]] == want
    docs = spark.createDataFrame([], "doc_id long, text string")
    documents, pairs = ta.aligned(docs, JSON, MODEL, keep_groups=True)
    assert documents.count() == 0 and pairs.count() == 0 and "groups" in documents.columns


def test_fragments_compose_associatively():
    tools, rng = ta.Aligner(JSON, MODEL), random.Random(5)
    for text in some_texts(6, 20, 30):
        raw = (" " + text).encode()
        a, b = tools.a.ids(" " + text), tools.b.ids([" " + text])[0]
        whole = tools.fragment(raw, a, b, 0, len(raw))
        cuts = sorted({0, len(raw), *(rng.randrange(len(raw)) for _ in range(6))})
        parts = [tools.fragment(raw, a, b, x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]
        assert sum(p[0] for p in parts) == whole[0] and sum(len(p[2]) for p in parts) == len(whole[2])
        frags = [(p[3][0], *(list(x) if i != 2 else x for i, x in enumerate(p[3][1:]))) for p in parts]
        while len(frags) > 1:  # in any order of composition
            i = rng.randrange(len(frags) - 1)
            frags[i : i + 2] = [ta.compose(frags[i], frags[i + 1])]
        assert ta.closed(frags[0]) == ta.closed(whole[3])


def test_ranges_cover_texts_and_encode_no_long_word_often():
    tools = ta.Aligner(JSON, MODEL)
    text = " " + "ab " * 50 + "q" * 5000 + " " + "cd\n" * 50
    words = tools.b.splitter()(text)
    found = list(ta.ranges(words, 64))
    assert sum(size for _, _, size in found) == len(text) and "".join(words) == text
    assert sum(len(w) for w, _, _ in found) < 4 * len(text)
