"""A judge asked in batches: two scores an answer, failures alone."""

from graphloom.plans import experiments


def test_two_judgements_in_batches(spark):
    def judge(prompts):
        if len(prompts) > 5:
            raise ValueError("too many")
        if any("broken" in p for p in prompts):
            raise ValueError("no answer")
        share = lambda p: len(set(p.split("\n")[1].split()) & set(p.split("\n")[2].split())) / 2
        return [float("nan") if "odd" in p else share(p) for p in prompts]

    rows = [(i, f"q{i} who", f"who said c{i}", f"c{i} said so") for i in range(23)] + [(23, "q", "broken", "c"), (24, "q", "odd", "c"), (25, "x y z", "x y z", "x")]
    table = spark.createDataFrame(rows, "id int, question string, prediction string, context string")
    got = {r.id: r for r in experiments.judged_all(table, judge, 5).collect()}
    assert all((got[i].faithfulness, got[i].answer_relevance) == (1.0, 0.5) for i in range(23))
    assert all((got[i].faithfulness, got[i].answer_relevance) == (None, None) for i in (23, 24))
    assert (got[25].faithfulness, got[25].answer_relevance) == (0.5, 1.0)  # scores end at 1
    assert experiments.judged_all(table.limit(0), judge).count() == 0
