"""Benchmark decontamination against brute force over all item lengths and budgets."""

import random

from skein.llm import decontaminate
from tests.llm.test_training_data import brute_distance


def edited(rng, s, n, letters="abcdxyz"):
    s = list(s)
    for _ in range(n):
        at, how = rng.randrange(len(s)), rng.randrange(3)
        if how == 0:
            s[at] = rng.choice(letters)
        elif how == 1:
            s.insert(at, rng.choice(letters))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


def want(texts, items):
    found = {}
    for i, t in enumerate(texts):
        for key, item in items:
            p = decontaminate.normalise(item)
            if p:
                n = brute_distance(p, decontaminate.normalise(t))
                if n <= len(p) // 10:
                    found[i, key] = n
    return found


def test_every_length_and_budget_matches_brute_force():
    rng = random.Random(11)
    draw = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    items = [(n, draw(n)) for n in [*range(1, 24), 40, 99, 100, 160]]
    texts = [draw(80) for _ in range(10)]
    for n, item in items:
        for rate in (0, 0.05, 0.1, 0.14):
            texts.append(draw(15) + edited(rng, item, int(n * rate)) + draw(15))
    matcher = decontaminate.Matcher(items)
    got = {(i, k): n for i, t in enumerate(texts) for k, n, _ in matcher.find(decontaminate.normalise(t))}
    expected = want(texts, items)
    assert got == expected and {n for _, n in got} >= {k for k, x in items if x.strip()} - {1}


def test_long_item_at_the_full_rate():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    item = " ".join(word() for _ in range(90))
    matcher = decontaminate.Matcher([(1, item)])
    for n in (0, len(item) // 20, len(item) // 11):
        text = word() + " " + edited(rng, item, n) + " " + word()
        ((_, distance, _),) = matcher.find(text)
        assert distance == brute_distance(item, text) <= len(item) // 10


def test_ids_of_any_type_and_null(spark):
    docs = spark.createDataFrame([("a", "what is 17 times 23?"), (None, "so what IS 17\ntimes 23? yes"), ("c", "nothing"), ("c", "x what is 17 times 23?")], "doc_id string, text string")
    for kind, ids in (("int", [None, 2]), ("string", ["p", None])):
        bench = spark.createDataFrame([(ids[0], "What is 17 times 23?"), (ids[1], "times 23?"), (ids[1], "  ")], f"item_id {kind}, text string")
        got = sorted(((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()), key=repr)
        assert got == sorted([(i, k) for i in ("a", None, "c") for k in ids], key=repr)
    # a row goes by its own text, with or without an id
    assert [(r.doc_id, r.text) for r in decontaminate.keep_clean(docs, bench).collect()] == [("c", "nothing")]


def test_clashing_names_long_texts_and_blocks(spark):
    names = "doc_id long, text string, key_0 int, of_0 int, `key` int, distance int, item_id int"
    docs = spark.createDataFrame([(1, "w " * 200_000 + "the planted benchmark sentence" + " w" * 200_000, 1, 1, 1, 1, 1), (2, "clean", 2, 2, 2, 2, 2), (2, "clean", 2, 2, 2, 2, 2)], names)
    bench = spark.createDataFrame([(i, f"the planted benchmark sentenc{x}") for i, x in enumerate("aebcdfg")], "item_id long, text string")
    assert {r.item_id: r.distance for r in decontaminate.matches(docs, bench, block_chars=40).collect()} == {i: int(x != "e") for i, x in enumerate("aebcdfg")}
    kept = decontaminate.keep_clean(docs, bench, block_chars=40)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2, 2]
