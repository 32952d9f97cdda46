import random
import re

from delvestone.llm import split


def brute_end(text, low, high):
    for kind in range(4):
        best = None
        for p in range(low + 1, high + 1):
            if kind == 0:
                ok = text[p - 1] == "\n" and re.match(r"#{1,6} ", text[p : p + 8])
            elif kind == 1:
                ok = text[p - 2 : p] == "\n\n" and text[p] != "\n"
            else:
                q = p
                while q > 0 and text[q - 1] in " \n":
                    q -= 1
                if kind == 2:
                    ok = (q < p and text[p] not in " \n" and q > 0 and text[q - 1] in ".!?") or text[p - 1] in "。！？"
                else:
                    ok = text[p - 1] in " \n" and text[p] not in " \n"
            if ok:
                best = p
        if best:
            return best
    return high


def test_structure_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word", " ", ". ", "\n", "\n\n", "\n# h ", "。", "3.5", "! ", "x" * 30]) for _ in range(rng.randint(50, 900)))
        start, want = 0, []
        while len(text) - start > 400:
            end = brute_end(text, start + 200, start + 400)
            want.append((start, end))
            start = end - 20
        want.append((start, len(text)))
        assert split.pieces(text, 400, 200, 20) == want


def test_pieces_cover_and_overlap():
    text = "One topic here. " * 300 + "Another matter entirely there. " * 300
    for rule in ("structure", "cohesion"):
        own = split.pieces(text, 4000, 2000, 200, rule)
        assert own[0][0] == 0 and own[-1][1] == len(text)
        assert all(b - a <= 4000 for a, b in own)
        assert all(y[0] == x[1] - 200 for x, y in zip(own, own[1:]))


def test_cohesion_finds_the_change_of_topic():
    sea = "The captain steered the vessel across the stormy harbour waters. "
    law = "The tribunal dismissed the plaintiff petition under statute law. "
    text = sea * 45 + law * 60
    end = split.cohesion_end(text, 2000, 4000)
    assert abs(end - len(sea) * 45) <= len(law)


def test_cohesion_finds_planted_changes_of_topic():
    """Topics share their common words; sentences are drawn at random, changes planted anywhere in the window."""
    import random

    rng = random.Random(11)
    word = lambda a, b: "".join(chr(97 + x) for x in (a, b // 10, b % 10))
    common = [word(20, i) for i in range(25)]
    topics = [[word(k, i) for i in range(40)] for k in range(6)]

    def sentence(topic):
        return " ".join(rng.choice(topic if rng.random() < 0.45 else common) for _ in range(rng.randint(6, 14))).capitalize() + ". "

    hits = blind = 0
    for _ in range(60):
        a, b = rng.sample(topics, 2)
        want, text = rng.randint(2150, 3850), ""
        while len(text) < want:
            text += sentence(a)
        cut = len(text)
        while len(text) < cut + 3000:
            text += sentence(b)
        hits += abs(split.cohesion_end(text, 2000, 4000) - cut) <= 80
        blind += abs(split.structural_end(text, 2000, 4000) - cut) <= 80
    assert hits >= 54 and blind < 20


def test_frames(spark):
    nodes = spark.createDataFrame(
        [("f", "root", None, [0, 9000], "k"), ("f", "a", "root", [0, 5000], "k"), ("f", "a", "root", [0, 5000], "k"), ("f", "b", "root", [8000, 7000], "k"), ("f", "c", "root", None, "k"), ("g", "x", None, [0, 99999], "k"), ("h", "y", None, [0, 9999], "k")],
        "file_id string, node_id string, parent_id string, char_range array<bigint>, content string",
    )
    contents = spark.createDataFrame([("f", "word " * 1800), ("f", "word " * 1800), ("g", None), ("h", "short")], "file_id string, content string")
    got = sorted(tuple(r) for r in split.split_items(split.oversized_leaves(nodes.drop("content"), contents, 4000)).collect())
    assert got == [("f", "a", 0, 4000), ("f", "a", 3800, 5000)]
    assert split.split_items(split.oversized_leaves(nodes.drop("content").limit(0), contents, 4000)).count() == 0
