import numpy as np
import pytest

from delvestone.llm import langid

TEXT = {
    "en": "The report was reviewed by the board. Every member of the team agreed with the summary. This was the last of the meetings for that year.",
    "de": "Der Bericht wurde von dem Gremium geprüft. Jedes Mitglied stimmte der Übersicht zu. Das war die letzte Sitzung in diesem Jahr.",
    "fr": "Le rapport a été examiné par le comité. Chaque membre de l'équipe a approuvé le résumé. C'était la dernière réunion de l'année.",
    "es": "El informe fue revisado por el comité. Cada miembro del equipo aprobó el resumen. Fue la última reunión de este año.",
    "pt": "O relatório foi revisto pelo comité. Cada membro da equipa aprovou o resumo. Foi a última reunião deste ano.",
    "zh": "委员会审查了这份报告。团队的每个成员都同意这个摘要。这是今年的最后一次会议。",
}


@pytest.fixture(scope="module")
def coder():
    texts, labels = [], []
    for k, t in TEXT.items():
        texts += [t] * 6
        labels += [k] * 5 + ["en" if k != "en" else "de"]  # one wrong in six
    return langid.train(texts, labels)


def test_codewords_are_far_apart():
    code = langid.codewords(6, 15)
    gaps = [(code[a] != code[b]).sum() for a in range(6) for b in range(a)]
    assert min(gaps) >= 6


def test_sentences_despite_wrong_labels(coder):
    vocabulary = langid.Vocabulary(coder)
    held = ["The members agreed with every report.", "Die Mitglieder stimmten dem Bericht zu.", "Le comité a approuvé le rapport.", "El equipo aprobó el informe.", "O comité aprovou o relatório da equipa.", "团队同意这份报告。"]
    _, _, own, sure, _ = langid.label(held, vocabulary)
    assert [langid.LANGUAGES[i] for i in own] == ["en", "de", "fr", "es", "pt", "zh"]
    assert (sure > 0.5).all()


def test_paragraph_numbers():
    assert [n for n, _ in langid.spans("\n\na\nb\n  \n# h\n\nc\n")] == [0, 1, 2]
    assert langid.spans("") == []


def test_frames(spark, coder):
    rows = [("a", TEXT["en"] + "\n\n" + TEXT["de"] + "\n\n| x |\n\nshort one."), ("b", None), ("c", ""), ("d", "1234 5678"), ("a", TEXT["en"] + "\n\n" + TEXT["de"] + "\n\n| x |\n\nshort one.")]
    df = spark.createDataFrame(rows, "file_id string, content string")
    got = {(r.file_id, r.para_no, r.lang) for r in langid.label_paragraphs(df, "file_id", "content", coder).collect()}
    assert got == {("a", 0, "en"), ("a", 1, "de")}
    mixed = spark.createDataFrame([("m", TEXT["en"] + " " + TEXT["fr"])], "file_id string, content string")
    segments = sorted((r.seg_no, r.lang) for r in langid.label_paragraphs(mixed, "file_id", "content", coder, segments=True).collect())
    assert segments == [(0, "en"), (1, "fr")]
    assert langid.label_paragraphs(df.limit(0), "file_id", "content", coder).count() == 0


def test_labels_in_all_forms(spark):
    rows = [({"deu": 0.9, "en": 0.1},), ({"EN": 0.5},), ({"fr-CA": 0.7},), ({"und": 0.9, "en": 0.1},), ({},), (None,), ({"nl": 0.4},), ({"pt": None},), ({"es": float("nan"), "zh": 0.2},)]
    df = spark.createDataFrame(rows, "m map<string,double>")
    got = [r[0] for r in df.select(langid.given_label(df["m"])).collect()]
    assert got == ["de", "en", "fr", None, None, None, "nl", None, "zh"]


def test_margins_decode_to_the_codeword(coder):
    least, sure, unclear = coder.decode(coder.code * 5.0)
    assert least.tolist() == list(range(6)) and (sure > 0.9).all() and not unclear.any()
    assert np.isfinite(sure).all()
