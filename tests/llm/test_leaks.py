import random

import pytest

from delvestone.llm import leaks

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(600)]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def test_search_finds_every_occurrence():
    text = (" " + " ".join(words(3000)) + " ").encode()
    tokens = text.split()
    strings = sorted({b" " + b" ".join(tokens[i : i + 3]) + b" " for i in range(0, 2900, 7)}, key=len)
    strings = [s for s in strings if len(s) >= leaks.BLOCK]
    import numpy as np

    data = np.frombuffer(text, np.uint8)
    needles = leaks.Needles(strings)
    places, numbers = needles.find(text, data, leaks.blocks(data))
    want = {(i, k) for k, s in enumerate(strings) for i in range(len(text)) if text.startswith(s, i)}
    assert set(zip(places, numbers)) == want


def test_shifts_pass_positions_over():
    import numpy as np

    own, other = [" ".join(words(5)).encode() for _ in range(200)], " ".join(words(5000)).encode()
    needles = leaks.Needles([b" " + s + b" " for s in own if len(s) > 24])
    data = np.frombuffer(other, np.uint8)
    for least in (0, 1, 7, 8, 30, 511, 512, 513):  # short texts too
        assert len(needles.ends(leaks.blocks(data[:least]))) <= least
    needles.asked = 0
    ends = needles.ends(leaks.blocks(data))
    every = [i for i in range(needles.least - leaks.BLOCK, len(data) - leaks.BLOCK + 1) if needles.shift[leaks._code(leaks.blocks(data)[i : i + 1])][0] == 0]
    assert set(ends.tolist()) <= set(every)
    assert needles.asked < len(data) / 4


def test_edges_are_carried_over_edits():
    ref = [f"w{i}" for i in range(40)]
    doc = ["x", *ref[3:10], "changed", *ref[11:20], *ref[21:30], "added", *ref[30:33], "y"]
    assert leaks._grow((11, 20, 9, 18), doc, ref)[:2] == (3, 33)


@pytest.fixture(scope="module")
def items():
    return [{"item_id": i, "question": " ".join(words(24)), "evidence_text": " ".join(words(60))} for i in range(20)]


def edited(tokens, every=8):
    out = []
    for i, w in enumerate(tokens):
        if i % every == every // 2:
            out += RNG.choice([[], [RNG.choice(VOCABULARY)], [w, RNG.choice(VOCABULARY)]])
        else:
            out.append(w)
    return out


def test_cases_and_none_cases(spark, items):
    e = [x["evidence_text"].split() for x in items]
    docs = [
        (1, " ".join(words(50) + e[0] + words(50))),
        (2, " ".join(words(9)) + " **" + "**,\n ".join(w.upper() for w in e[1][10:45]) + "! " + " ".join(words(9))),
        (3, " ".join(words(30) + e[2][:18] + words(40) + e[2][30:50] + words(3))),
        (4, " ".join(words(30) + edited(e[3]) + words(10))),
        (5, " ".join(words(30) + e[4][:15] + words(100))),  # a quarter only
        (6, " ".join(words(300))),
        (7, None), (8, ""), (9, "... !!"),
        (10, "Q: " + items[5]["question"] + "? yes"),
        (10, "Q: " + items[5]["question"] + "? yes"),
    ]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    table = spark.createDataFrame(items + [dict(items[0], item_id=99)] + [{"item_id": 100, "question": None, "evidence_text": ""}], "item_id bigint, question string, evidence_text string")
    want = {(1, 0), (1, 99), (2, 1), (3, 2), (4, 3), (10, 5)}
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(frame, table).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(frame, table, per_block=6).collect()} == want  # in blocks
    assert leaks.find_leaks(frame.limit(0), table).count() == 0
