import random

from delvestone.llm import subjects

NOUNS = {"law": ["tribunal", "verdict", "statute", "plaintiff", "counsel"], "sport": ["stadium", "goalkeeper", "tournament", "referee", "medal"], "energy": ["turbine", "reactor", "pipeline", "boiler", "grid"]}
RNG = random.Random(7)


def sentence(subject):
    return f"The {RNG.choice(['late', 'early', 'annual'])} {RNG.choice(NOUNS[subject])} changed the {RNG.choice(NOUNS[subject])} near the office."


def document(parts):
    return " ".join(sentence(s) for s, n in parts for _ in range(n))


def rows(n):
    out = []
    for i in range(n):
        a, b = RNG.sample(list(NOUNS), 2)
        truth = {a} if i % 3 else {a, b}
        out.append((i, document([(a, 8)] if i % 3 else [(a, 5), (b, 5)]), truth))
    return out


def test_held_out_documents_despite_rater_errors(spark):
    train, held = rows(150), rows(60)
    labels = []
    for i, _, truth in train[:80]:
        for rater in range(2):
            s = RNG.choice(sorted(truth)) if RNG.random() > 0.1 else RNG.choice(list(NOUNS))
            labels.append((i, s, f"r{rater}"))
    labels += [(None, "law", "r9"), (5, None, "r9"), (6, "cooking", "r9"), (10**9, "law", "r1"), labels[0]]
    docs = [(i, t, "en", "clash") for i, t, _ in train] + [(1000 + i, t, None, "clash") for i, t, _ in held] + [(5000, None, None, "x"), (5001, "", "en", "x"), (5002, "... 12", "en", "x")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, subject string")
    areas = spark.createDataFrame([(s, "") for s in NOUNS], "subject string, description string")
    model = subjects.fit(frame, spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string"), areas)
    got = {}
    for r in subjects.label_documents(frame, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(1000 + i) == truth for i, _, truth in held)
    assert right >= 57
    assert not {5000, 5001, 5002} & set(got)
    none = spark.createDataFrame([], "doc_id bigint, subject string, annotator string")
    assert subjects.label_documents(frame, subjects.fit(frame, none, areas)).count() == 0
    assert subjects.label_documents(frame.limit(0), model).count() == 0


def test_units():
    own, heads = subjects.units("# A heading\n\nOne sentence. Two!\n| a | b |\n- A bullet of some words here.\nTitle line\n2025-01-01 INFO worker file was loaded again now")
    assert heads == ["# A heading", "Title line"]
    assert len(own) == 4
    assert subjects.units("") == ([], [])
