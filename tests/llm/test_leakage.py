import random

import pytest

from loomtime.llm import leakage


def brute(text, fields, least):
    words = leakage.words_of(text)
    grams = {tuple(words[i : i + least]) for i in range(len(words) - least + 1)}
    return {f[0] for f in fields if any(tuple(f[2][i : i + least]) in grams for i in range(len(f[2]) - least + 1))}


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_against_brute_force(least):
    r = random.Random(least)
    vocabulary = [f"w{i}" for i in range(12 if least < 5 else 40)]
    fields = [(k, "prompt", [r.choice(vocabulary) for _ in range(r.randint(1, 40))]) for k in range(30)]
    fields = [f for f in fields if len(f[2]) >= least]
    automaton = leakage.build_automaton(fields, least)
    hits = 0
    for _ in range(300):
        words = []
        while len(words) < 60:
            f = r.choice(fields)[2]
            a = r.randrange(len(f))
            words += f[a : a + r.randint(1, 20)] if r.random() < 0.5 else [r.choice(vocabulary)]
        text = r.choice([" ", "\n+  ", ", ", "__"]).join(w.upper() if r.random() < 0.3 else w for w in words)
        got = leakage.matches(text, automaton, fields, least) if fields else []
        assert {m[0] for m in got} == brute(text, fields, least)
        for _, _, a, b, n in got:
            assert len(leakage.words_of(text[a:b])) == n >= least
        hits += len(got)
    assert hits


def test_frame_and_edges(spark):
    prompt = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, prompt, "short answer", "s"), (2, prompt, None, "s"), (3, None, "", "s"), (None, prompt, prompt, "s")], "item_id bigint, prompt string, answer string, start string")
    docs = spark.createDataFrame([(10, "x ONE, two-three\n> four five six seven eight nine ten eleven: TWELVE end", ""), (11, prompt[:40], ""), (12, None, ""), (13, "", ""), (14, "-- ++", ""),
                                  (10, "İ " + prompt, ""), (15, ("filler " * 30_000) + prompt, "")], "doc_id bigint, text string, item_id string")
    out = leakage.find_leaks(docs, items).toPandas()
    assert set(zip(out.doc_id, out.item_id)) == {(10, 1), (10, 2), (15, 1), (15, 2)} and set(out.field) == {"prompt"}
    first = out[(out.doc_id == 10) & (out.n_words == 12)].iloc[0]
    assert first.start == 2 and "x ONE, two-three\n> four five six seven eight nine ten eleven: TWELVE end"[first.start : first.end].endswith("TWELVE")
    report = leakage.leak_report(leakage.find_leaks(docs, items)).toPandas()
    assert report[report.doc_id == 15].longest.tolist() == [13, 13]
    assert leakage.find_leaks(docs.limit(0), items).count() == 0 and leakage.find_leaks(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leakage.find_leaks(docs, items, max_eval_mb=0)
    with pytest.raises(ValueError):
        leakage.find_leaks(docs, items, min_words=1)
