import random

from cinderbark.llm import decontaminate as op
from tests.llm.fixtures import docs, no_docs, words

ITEM = "Tom has 3 apples and Anna has 12 pears. How many apples does Tom need to buy for 5 friends of Anna?"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], docs(spark, clash=False).schema)


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def test_reparameterised_questions_and_slots(spark):
    other = "Joe has 7 apples and Mary has 40 pears. How many apples does Joe need to buy for 9 friends of Mary?"
    mixed = "Joe has 7 apples and Mary has 40 pears. How many apples does Bob need to buy for 9 friends of Lucy?"
    texts = [f"{words(40, 1)}. {ITEM} {words(30, 2)}", f"{words(20, 3)}. {other}", ITEM.replace(" ", "\n"), words(100, 4), None, ""]
    out = {r.doc_id: r for r in op.contaminated(frame(spark, texts), bench(spark, [ITEM, words(40, 9)])).collect()}
    assert set(out) == {0, 1, 2} and {r.item_id for r in out.values()} == {0}
    assert out[0].changed_slots == 0 and out[1].changed_slots > 0 and out[1].covered > 0.95
    inconsistent = op.Index([(0, ITEM)])
    (_, _, covered, *_), *_ = inconsistent.judge(*op.Reader().tokens([mixed]), 0.0, 1)
    assert covered < out[1].covered


def test_slot_values_have_to_agree():
    import numpy as np

    a = np.array([1, 1, 2, 2], np.uint64)
    assert op.consistent(a, np.array([7, 7, 8, 8], np.uint64)).all()
    assert op.consistent(a, np.array([7, 9, 8, 8], np.uint64)).tolist().count(True) == 3


def test_plain_passages_match_brute_force(spark):
    r = random.Random(3)
    items = [words(r.randint(5, 60), 100 + i) for i in range(30)] + ["too short", None, "one"]
    texts = []
    for i in range(60):
        body = words(r.randint(10, 200), 500 + i).split()
        if i % 3 == 0:
            at = r.randint(0, len(body))
            body[at:at] = items[r.randrange(30)].split()
        texts.append(" ".join(body))
    want = {(d, b) for d, t in enumerate(texts) for b, it in enumerate(items) if it and len(it.split()) >= op.LEAST and f" {it} " in f" {t} "}
    for chars in (op.PART_CHARS, 300):  # in one pass, and with the benchmark dealt into several
        got = {(r.doc_id, r.item_id) for r in op.contaminated(frame(spark, texts), bench(spark, items), chars=chars).collect()}
        assert got == want
    kept = op.keep_clean(frame(spark, texts), bench(spark, items))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(60)) - {d for d, _ in want})


def test_odd_inputs(spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert op.contaminated(docs(spark), empty).count() == 0
    assert op.keep_clean(docs(spark), empty).count() == docs(spark).count()
    assert op.contaminated(no_docs(spark), bench(spark, [ITEM])).count() == 0
    assert op.keep_clean(docs(spark), bench(spark, [ITEM])).columns == docs(spark).columns
    twice = op.contaminated(frame(spark, [ITEM, ITEM]), bench(spark, [ITEM, ITEM]))
    assert sorted((r.doc_id, r.item_id) for r in twice.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


FARM = "A farmer has 12 cows and buys some more at the market, then sells 5 of them to a neighbour and keeps all the others for milk during the long winter months that follow"


def covered(item, text):
    return [round(r[2], 2) for r in op.Index([(0, item)]).judge(*op.Reader().tokens([text]), op.SHARE, op.RUN)]


def test_longer_values_and_edits_do_not_split_an_item():
    head = words(30, 7) + ". "
    assert covered(FARM, head + FARM.replace("sells 5 of", "sells twenty five of")) == [1.0]
    edited = FARM.replace("then sells", "then she sells").replace("the long winter", "the winter")
    assert covered(FARM, head + edited)[0] >= 0.75
    named = "the teacher asked Anna to write a list of all her 12 friends and then gave Anna a book"
    assert covered(named, head + named.replace("Anna", "Mary Ann")) == [1.0]
    # a passage that stands once counts once, and far passages are not summed
    twice = "we walk along the old river road home " * 2 + words(20, 3)
    assert covered(twice, head + "we walk along the old river road home " + words(20, 5)) == []
    half = len(FARM.split()) // 2
    parts = FARM.split()[:half], FARM.split()[half:]
    assert covered(FARM, " ".join(parts[0]) + " " + words(200, 8) + " " + " ".join(parts[1])) == []


def test_verbatim_copies_of_slot_heavy_items():
    for item in (
        "Compute 12 + 7 * 3 - 45 / 9 + 81 - 6 * 2.",
        "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG AND RUNS ALL THE WAY HOME",
        "Anna Berlin Carla Dublin Edgar",
        "1 2 4 8 16 32",
    ):
        for text in (item, f"Page 4 {item} 13 Others", f"{words(30, 2)}\n{item}\n{words(30, 3)}"):
            assert covered(item, text) == [1.0], (item, text)
    assert covered("Compute 12 + 7 * 3 - 45 / 9 + 81 - 6 * 2.", "Compute 11 + 5 * 2 - 44 / 8 + 80 - 5 * 3.") == []


def test_the_place_of_a_question_does_not_matter():
    item = "What is the capital of France?"
    for head in ("", "Quiz notes\n", "Quiz notes ", "Quiz notes. ", "and then "):
        assert covered(item, head + item + " Nobody knew.") == [1.0], head
        assert covered(item, head + "What is the capital of Spain? Nobody knew.") == [1.0], head
    assert covered("Quiz notes What is the capital of France?", "Quiz notes. What is the capital of Spain?")[0] >= 0.8
    assert covered(item, "We know that Paris is the capital of Spain.") == []  # another first word


def test_slot_heavy_and_short_items():
    """Questions of numbers and names are found verbatim and with others; short items verbatim; bare lists of numbers meet none."""
    items = ["Compute 12 + 35 - 7 * 9 / 3 for Anna and 4 km.", "Who wrote Hamlet?", "5 9 12 40 7 3 8 1 6 2", "Yes"]
    texts = [
        f"{words(9, 1)}. Compute 12 + 35 - 7 * 9 / 3 for Anna and 4 km. {words(9, 2)}",
        f"{words(9, 3)}. Compute 44 + 8 - 21 * 6 / 5 for Boris and 90 km. {words(9, 4)}",
        f"{words(9, 5)}. who wrote hamlet {words(9, 6)}",
        "Totals 1 2 3 4 5 6 7 8 9 10 11 12 13 14 and 15 16 17 18 19 20 21 22",
        "5 9 12 40 7 3 8 1 6 2",
        "Yes",
    ]
    found = {(d, i) for d, i, *_ in op.Index(list(enumerate(items))).judge(*op.Reader().tokens(texts), op.SHARE, op.RUN)}
    assert found == {(0, 0), (1, 0), (2, 1), (4, 2)}


def test_few_meetings_at_once_and_many_parts_change_nothing(spark, monkeypatch):
    same = words(12, 70)
    items = [f"{same} {words(10, 80 + k)}" for k in range(40)] + [ITEM]
    texts = [f"{words(5, k)} {items[k % 41]} {same} {same}" for k in range(60)] + [None, ""]
    index = op.Index(list(enumerate(items)))
    want = sorted(index.judge(*op.Reader().tokens(texts), op.SHARE, op.RUN))
    monkeypatch.setattr(op, "PAIRS", 20)
    assert sorted(index.judge(*op.Reader().tokens(texts), op.SHARE, op.RUN)) == want and len(want) >= 60
    monkeypatch.undo()
    whole = sorted(tuple(r) for r in op.contaminated(frame(spark, texts), bench(spark, items)).collect())
    assert sorted(tuple(r) for r in op.contaminated(frame(spark, texts), bench(spark, items), chars=1500).collect()) == whole
    assert op.keep_clean(frame(spark, texts), bench(spark, items), chars=1500).count() == len(texts) - len({r[0] for r in whole})


def test_templates_match_brute_force():
    """Items whose slots are all changed alike are found, those with clashing slots are not; alignment by plain loops."""
    r = random.Random(8)
    fill = lambda t, v: " ".join(str(v[w]) if w in v else w for w in t)
    for k in range(40):
        template = [r.choice(["A", "B", "C"]) if r.random() < 0.3 else words(1, 1000 + 50 * k + j) for j in range(r.randint(12, 30))]
        first = {"A": 11, "B": 22, "C": 33}
        other = {"A": r.randint(100, 200), "B": r.randint(201, 300), "C": r.randint(301, 400)}
        text = f"{words(6, k)}. {fill(template, other)} {words(6, 500 + k)}"
        windows = [template[j : j + op.WINDOW] for j in range(len(template) - op.WINDOW + 1)]
        covered = {j + x for j, w in enumerate(windows) if sum(y not in first for y in w) >= op.PLAIN for x in range(op.WINDOW)}
        got = list(op.Index([(0, fill(template, first))]).judge(*op.Reader().tokens([text]), op.SHARE, op.RUN))
        assert bool(got) == (len(covered) / len(template) >= op.SHARE) and (not got or got[0][4] >= len(covered))
