import json
import random

import pytest

from graphloom.llm.line_chunks import deduplicate_lines, deduplicate_passages
from graphloom.llm.token_count import build, token_counts, viterbi
from graphloom.llm.tool_chat import TURN_TOOLS, Tool, depths, link_calls, turn_calls

TOOLS = (Tool("add", (("a", "integer", True), ("b", "number", False))), Tool("say", (("text", "string", True), ("tags", "array", False), ("opt", "object", False), ("on", "boolean", False))), Tool("nothing", ()))


def fits(tool, text):
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    try:
        got = json.loads(text)
    except (TypeError, ValueError):
        return False
    schema = {t.name: t for t in TOOLS}.get(tool)
    if schema is None or not isinstance(got, dict) or set(got) - {k for k, _, _ in schema.arguments}:
        return False
    for key, kind, required in schema.arguments:
        if key not in got:
            if required:
                return False
        elif not isinstance(got[key], kinds[kind]) or (isinstance(got[key], bool) and kind in ("integer", "number")):
            return False
    return True


def test_links_against_brute_force(spark):
    arguments = ['{"b": 1.5, "a": 2}', '{"a": 2}', '{"b": 2}', '{"a": "2"}', '{"a": 2, "c": 1}', "[1]", "not json", None, "{}", '{"text": "x \\"y\\" é", "tags": [1, {"z": 1, "b": 2}], "opt": {"q": null, "a": []}, "on": true}', '{"text": 3}', '{"text": "t", "on": 1}']
    calls, i = [], 0
    for name in ("add", "say", "nothing", "unknown", None):
        for a in arguments:
            calls.append((1, i, f"id{i}", name, a, [f"id{j}" for j in (i // 2, i - 7) if 0 <= j < i] or None))
            i += 1
    calls += [(2, 0, "x", "nothing", "{}", ["y"]), (2, 1, "y", "nothing", "{}", ["x"]), (2, 2, "z", "nothing", "{}", ["y", "gone"]), (2, 3, None, "nothing", "{}", None), (None, 4, "n", "nothing", "{}", ["n0"]), (3, 9, "d", "add", '{"a": 9}', None), (3, 8, "d", "add", '{"a": 8}', None)]
    results = [(1, 100 + k, f"id{k}", f'answer "{k}" \\ é\n') for k in range(0, i, 2)] + [(3, 10, "d", None), (4, 1, "nobody", "x"), (1, 1, None, "x")]
    table = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>").selectExpr("*", "1 depth", "'s' status")
    got = {(r.conv_id, r.call_id): r for r in link_calls(table, spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), TOOLS).collect()}
    assert len(got) == i + 5
    depth = {}
    for c, _, k, _, _, after in calls[:i]:
        depth[k] = 1 + max((depth[b] for b in after or []), default=-1)
    answer = {(c, k): content for c, _, k, content in results}
    for c, t, k, name, a, _ in calls[:i]:
        r = got[c, k]
        assert (r.turn, r.depth, r.status, r.valid) == (t, depth[k], "linked" if (c, k) in answer else "unanswered", fits(name, a)), (name, a)
        try:
            parsed = json.loads(a)
        except (TypeError, ValueError):
            parsed = None
        assert json.loads(r.line) == {"arguments": parsed, "call_id": k, "content": answer.get((c, k)), "name": name}
        assert list(json.loads(r.line)) == ["arguments", "call_id", "content", "name"]
    assert json.dumps(json.loads(got[1, "id0"].line)["arguments"], sort_keys=True, separators=(",", ":")) in got[1, "id0"].line
    assert [got[2, k].depth for k in "xyz"] == [None] * 3
    assert got[3, "d"].status == "repeated" and got[3, "d"].turn == 8 and got[None, "n"].status == "unanswered"
    assert link_calls(table.limit(0), table.limit(0).selectExpr("conv_id", "turn", "call_id", "name content"), TOOLS).count() == 0


def test_canonical_arguments(spark):
    """Equal arguments have one line; repeated keys keep their text; long contents stay whole."""
    equal = ['{"a": 1, "b": 1.5}', '{"b":15e-1,"a":1.0}', '{"a": 1e0, "b": 0.15E1}', '{"b": 1.50, "a": 10E-1}']
    texts = ['{"text": "1.0 and \\\\\\"2e0\\" stay", "tags": [1.0, -2.50, 1e-7, 0.0000001, 1e20, -0.0]}', '{"text": "t", "tags": [0.12345678901234567890, 1234567890123456789]}', '{"text": "x", "text": "y"}', '[{"k": 1, "k": 2}]']
    big = json.dumps({"text": 'long "quoted" \\ 1.5 ' * 20000})
    rows = [(1, i, f"e{i}", "add", a) for i, a in enumerate(equal)] + [(2, i, f"t{i}", "say", a) for i, a in enumerate(texts)] + [(3, 0, "big", "say", big), (4, 0, "half", "add", '{"a": 1.5}')]
    calls = spark.createDataFrame([(*r, None) for r in rows], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    content = 'answer 1.0 "é" \n' * 30000
    got = {r.call_id: r for r in link_calls(calls, spark.createDataFrame([(3, 1, "big", content)], "conv_id long, turn long, call_id string, content string"), TOOLS).collect()}
    assert {got[f"e{i}"].line.replace(f"e{i}", "id") for i in range(4)} == {'{"arguments":{"a":1,"b":1.5},"call_id":"id","content":null,"name":"add"}'}
    assert all(got[f"e{i}"].valid for i in range(4)) and not got["half"].valid
    told = json.loads(texts[0])
    assert json.loads(got["t0"].line)["arguments"] == told and '"tags":[1,-2.5,1.0E-7,1.0E-7,1.0E20,0]' in got["t0"].line
    assert '[0.1234567890123456789' in got["t1"].line and ',1234567890123456789]' in got["t1"].line
    assert [json.loads(got[k].line)["arguments"] for k in ("t2", "t3")] == texts[2:] and not got["t2"].valid
    assert json.loads(got["big"].line) == {"arguments": json.loads(big), "call_id": "big", "content": content, "name": "say"} and got["big"].valid


def test_long_chains_and_null_conversations(spark):
    """A chain of 500 calls, one whose calls use the last three, a cycle behind 20 calls, and a chain without a conversation; the last three make 70 rounds."""
    calls = [(1, f"a{i}", [f"a{i - 1}"] if i else []) for i in range(500)]
    calls += [(2, f"b{i}", [f"b{j}" for j in (i - 1, i - 2, i - 3) if j >= 0]) for i in range(70)]
    calls += [(3, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(20)] + [(3, "x", ["y", "c19"]), (3, "y", ["x"]), (3, "z", ["x"])]
    calls += [(None, f"n{i}", [f"n{i - 1}", "gone"] if i else None) for i in range(12)]
    table = spark.createDataFrame(calls, "conv_id long, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): r.depth for r in depths(table).collect()}
    assert len(got) == len(calls)
    assert all(depth == (None if k in "xyz" else int(k[1:])) for (_, k), depth in got.items())


def test_turn_calls(spark):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", "x" * t) for t in range(40)] + [(2, 0, "user", None), (None, 0, "user", "q"), (2, 1, None, "z")], "conv_id long, turn long, role string, text string")
    out = link_calls(*turn_calls(turns), TURN_TOOLS).collect()
    assert len(out) == 22 and sum(r.status == "linked" for r in out) == 20
    assert max(r.depth for r in out if r.depth is not None) <= 7 and sum(r.valid for r in out) >= 15


VOCABULARY = [("▁", -2.0), ("▁a", -2.5), ("a", -3.0), ("b", -3.0), ("ab", -6.0), ("abc", -9.0), ("bc", -6.0), ("c", -3.0), ("▁é", -4.0), ("é", -4.5), ("éa", -7.0), ("▁ab", -5.5), ("日本", -5.0), ("日", -6.0)]


def texts():
    rng = random.Random(11)
    out = [None, "", " ", "a", "a ", "  a  b", "abcabc", "é日本語 x", "zzz zz\nz", "▁a▁▁b", "a\tb", "日本日", "q" * 3000, "日本日éabc" * 400, "x" + "ab" * 900 + " " + "é" * 700]
    return out + ["".join(rng.choices("abcé日本 z", k=rng.randrange(30))) for _ in range(300)]


def test_counts_against_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = [("<unk>", -20.0), *VOCABULARY]
    model = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", -30.0), *VOCABULARY], 0, False))
    model.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace("▁", "always", True)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in token_counts(docs, VOCABULARY).collect()}
    for i, t in enumerate(texts()):
        want = model.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].n_unknown) == (len(want), want.count(0)), (t, got[i])
    assert token_counts(docs.limit(0), vocabulary).count() == 0


def test_words_that_share_a_hash():
    import numpy as np

    from graphloom.llm.token_count import _unlike

    data = np.frombuffer("▁ab▁ac▁ab▁abc".encode(), np.uint8)
    starts, ends = np.array([0, 5, 10, 15]), np.array([5, 10, 15, 21])
    assert list(_unlike(data, starts, ends, np.zeros(4, np.int64))) == [1, 3]


def test_score_is_the_best(spark):
    import numpy as np

    a, pieces = build(VOCABULARY), dict(VOCABULARY)
    for word in ("▁abcabc", "▁éab", "ab日本", "▁zz"):
        raw = np.frombuffer(word.encode(), np.uint8)
        best = {0: 0.0}
        for e in range(1, len(word) + 1):
            best[e] = max([best[s] + pieces[word[s:e]] for s in range(e) if word[s:e] in pieces] + ([] if word[e - 1] in pieces else [best[e - 1] + min(pieces.values()) - 10]))
        assert viterbi(a, raw, np.array([0]), np.array([len(raw)]))[2][0] == pytest.approx(best[len(word)])


def test_lines(spark):
    block = ["alpha line", "beta line", "gamma line", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    rng = random.Random(4)
    own = lambda n: [f"own {rng.random()}" for _ in range(n)]
    texts = ["\n".join(own(a) + block + own(b)) for a, b in ((0, 3), (2, 2), (5, 0), (1, 4))] + [None, "", "\n\n\n", "one line", "\n".join(block + block)]
    rows = [(i, t, "m") for i, t in enumerate(texts)] + [(None, "\n".join(block), None), (0, texts[0], "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string")
    full, few = ({(r.doc_id, r.places): r for r in deduplicate_lines(docs, bits).collect()} for bits in (64, 2))
    assert {k: r.text for k, r in full.items()} == {k: r.text for k, r in few.items()}
    seen = set()
    for i, t in enumerate(texts):
        r = full[i, None] if (i, None) in full else next(x for k, x in full.items() if k[0] == i)
        kept = (r.text or "").split("\n") if r.removed_lines < r.n_lines else []
        assert r.n_lines == len((t or "").split("\n")) == len(kept) + r.removed_lines
        assert (r.text is None) == (t is None)
        seen.update(kept)
    assert seen >= {x for t in texts if t for x in t.split("\n")}
    assert full[0, next(k[1] for k in full if k[0] == 0)].removed_chunks == 0
    assert all(next(r for k, r in full.items() if k[0] == i).removed_lines > 0 for i in (1, 2, 3, 8))
    assert deduplicate_lines(docs.limit(0)).count() == 0


def test_passages_against_brute_force(spark):
    """Runs of a few lines between lines of each document's own; of these, chunks of lines leave most."""
    rng = random.Random(5)
    runs = [[f"run {k} line {i}" for i in range(3 + k % 3)] for k in range(12)]
    own = lambda n: [f"own {rng.random()}" for _ in range(n)]
    texts = [None, "", "\n\n\n", "one line", "a\na\na\na"] + ["\n".join(own(rng.randrange(1, 6)) + rng.choice(runs) + own(rng.randrange(1, 6)) + rng.choice(runs)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[7], (None, texts[9])], "doc_id long, text string")
    seen, want = set(), {}
    for i, t in [*rows, (None, texts[9])]:
        w, gone = (t or "").split("\n"), set()
        for at in range(len(w) - 1):
            if (w[at], w[at + 1]) in seen:
                gone |= {at, at + 1}
            seen.add((w[at], w[at + 1]))
        want[i] = (len(w), len(gone), None if t is None else "\n".join(x for at, x in enumerate(w) if at not in gone))
    got = deduplicate_passages(docs).collect()
    assert len(got) == len(rows) + 2
    assert all((r.n_lines, r.removed_lines, r.text) == want[r.doc_id] for r in got)
    chunked = sum(r.removed_lines for r in deduplicate_lines(docs.where("doc_id is not null").distinct()).collect())
    assert chunked < sum(n for k, (_, n, _) in want.items() if k is not None)
    assert deduplicate_passages(docs.limit(0)).count() == 0


def test_chunks_find_every_repeat_of_three_lines(spark):
    """Runs of three to six lines at any place, and lines inserted before them; what a pair of lines alone repeats may stay."""
    rng = random.Random(6)
    runs = [[f"run {k} has line {i} of its own" for i in range(3 + k % 4)] for k in range(40)]
    own = lambda n: [f"own line {rng.random()}" for _ in range(n)]
    rows = [(i, "\n".join(own(rng.randrange(4)) + rng.choice(runs) + own(rng.randrange(1, 4)) + rng.choice(runs) + own(rng.randrange(3)))) for i in range(120)]
    signed = [(200 + i, f"letter {i}\n\nThanks!") for i in range(5)]  # a repeat of few bytes
    long_ = (300, "\n".join(f"row {i % 1500} of a long text" for i in range(4000)))
    seen, want = set(), {}
    for i, t in [*rows, *signed, long_]:
        w, gone = t.split("\n"), set()
        for at in range(len(w) - 2):
            three = tuple(w[at : at + 3])
            if three in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(three)
        want[i] = "\n".join(x for at, x in enumerate(w) if at not in gone)
    got = {r.doc_id: r for r in deduplicate_lines(spark.createDataFrame([*rows, *signed, long_], "doc_id long, text string")).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert got[300].removed_lines == 2500 and all(got[i].removed_lines == 0 for i, _ in signed)
