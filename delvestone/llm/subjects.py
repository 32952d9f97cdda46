"""Subjects of documents by one-versus-rest linear classifiers of sentences.

A document may be about several subjects, so its sentences are classified:
each subject has a linear classifier over hashed word n-grams (single words
and pairs; of Han text single signs, pairs and triples), and a document is
about the subjects that a share of its sentences are about.  The threshold of
each classifier is calibrated on the training documents.

Labels are weak: those of raters, which hold for a whole document and are
sometimes wrong, and those of section headings, which hold for the sentences
under them (in this data a heading's subject is that of 88 % of its section's
sentences).  A heading's subject isn't given but follows from its words, so
that training alternates: sentences get the subjects that the classifiers,
their document's labels and their section's heading agree on, and the
classifiers are fitted again.  Documents without raters' labels take part by
their headings.  Addresses (names of files) aren't used: in this data a file's
name agrees with its document's subject no more often than chance (13 %).

A sentence is about every subject whose classifier exceeds its threshold, if
by at least 0.8 of what the first one does.

Only training is on samples, of bounded size (``labelled`` documents with and
``plain`` documents without raters' labels, each of ``longest`` characters at
most).  Labelling reads every document once, whole, with no shuffle.

Results of the edge cases: null, empty and wordless texts have no subject;
labels of unknown subjects or documents are left out; repeated labels count
once a rater; without any labels no document gets a subject; only the named
columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, require

BITS = 17
DIMS = 1 << BITS
_WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")
_SKIP = re.compile(r"\s*(?:#|\||```)")
_END = re.compile(r"[.!?。！？]")


def units(text: str) -> tuple[list[str], list[str]]:
    """Sentences (a line without an end counts if it has six words), and headings."""
    return sections(text)[:2]


def sections(text: str) -> tuple[list[str], list[str], list[int]]:
    """Sentences, headings, and for each sentence the number of the heading that it stands under, or -1."""
    own, heads, under = [], [], []
    for line in text.split("\n"):
        if _SKIP.match(line):
            if line.lstrip()[:1] == "#":
                heads.append(line)
            continue
        for part in re.split(r"(?<=[.!?])(?=\s)|(?<=[。！？])", line):
            if part.strip():
                whole = _END.search(part[-3:]) is not None
                if whole or len(_WORD.findall(part)) >= 6:
                    own.append(part)
                    under.append(len(heads) - 1)
                elif len(part) < 80:
                    heads.append(part)
    return own, heads, under


class Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) << 1 | (len(w) == 1 and "㐀" <= w <= "鿿")
        return h


def features(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed n-gram) of all n-grams of each text."""
    found = [_WORD.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    look = words.__getitem__
    h = np.fromiter((x for f in found for x in map(look, f)), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(texts)), sizes)
    m, top = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    one = (h * m) >> top
    if len(h) < 3:
        return row, one.astype(np.int64)
    han = (h & np.uint64(1)).astype(bool)
    two = ((h[:-1] * np.uint64(3) + h[1:]) * m) >> top
    ok2 = row[:-1] == row[1:]
    three = ((h[:-2] * np.uint64(5) + h[1:-1] * np.uint64(3) + h[2:]) * m) >> top
    ok3 = (row[:-2] == row[2:]) & han[:-2] & han[1:-1] & han[2:]
    return np.concatenate([row, row[:-1][ok2], row[:-2][ok3]]), np.concatenate([one, two[ok2], three[ok3]]).astype(np.int64)


def _scores(row: np.ndarray, feature: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    order = np.argsort(row, kind="stable")
    row, feature = row[order], feature[order]
    out = np.zeros((n, weights.shape[1]), np.float32)
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        ends = np.append(first[1:], len(row))
        step = 20_000  # texts at a time, so that the gathered weights stay small
        for a in range(0, len(first), step):
            low, high = first[a], ends[min(a + step, len(first)) - 1]
            own = first[a : a + step]
            out[row[own]] = np.add.reduceat(weights[feature[low:high]], own - low, axis=0)
    return out


@dataclass
class Classifier:
    subjects: list[str]
    weights: np.ndarray  # DIMS x subjects
    threshold: np.ndarray  # of each subject's sentence score

    share: float = 0.8  # a further subject of a sentence exceeds its threshold by at least this share of what the first does

    def sentences(self, texts: list[str], words: Words) -> np.ndarray:
        """Whether each sentence (row) is about each subject (column): none, one or several."""
        s = _scores(*features(texts, words), len(texts), self.weights) - self.threshold
        return (s > 0) & (s >= self.share * s.max(1, keepdims=True))


def train(subjects: list[str], docs: list[tuple[str, dict[str, int], str]], rounds: int = 9, trust: float = 0.9, smooth: float = 1.0, section: float = 0.5) -> Classifier:
    """From (text, votes of raters by subject, language) of each training document.

    A weight is the log odds of a subject where the n-gram occurs against the
    odds expected from the languages it occurs in, so that a language's common
    words say nothing even if the documents in it are unevenly labelled.
    """
    k = len(subjects)
    number = {s: i for i, s in enumerate(subjects)}
    texts, doc, head_of = [], [], []
    prior = np.full((len(docs), k), 1.0 / k)
    for d, (text, votes, _) in enumerate(docs):
        own, heads, under = sections(text)
        head_of += [len(texts) + len(own) + u if u >= 0 else -1 for u in under] + [-1] * len(heads)
        texts += own + heads
        doc += [d] * (len(own) + len(heads))
        known = {number[s]: n for s, n in votes.items() if s in number}
        if known:
            prior[d] = (1 - trust) / k
            for s, n in known.items():
                prior[d, s] += trust * n / sum(known.values())
    doc, head_of = np.array(doc, np.int64), np.array(head_of, np.int64)
    below = np.flatnonzero(head_of >= 0)
    n = len(texts)
    row, feature = features(texts, Words())
    order = np.argsort(row, kind="stable")
    row, feature = row[order], feature[order]
    _, tongue = np.unique([x[2] for x in docs], return_inverse=True)
    tongues = int(tongue.max()) + 1 if len(docs) else 0
    spread = np.stack([np.bincount(feature[sel], minlength=DIMS) for sel in (tongue[doc[row]] == g for g in range(tongues))], axis=1).astype(np.float64)
    spread /= np.maximum(spread.sum(1, keepdims=True), 1)
    rated = np.abs(prior - 1 / k).max(1) > 1e-9
    posterior, mixed = prior[doc] * rated[doc][:, None], prior.copy()
    weights = np.zeros((DIMS, k), np.float32)
    for step in range(rounds):
        counts = np.stack([np.bincount(feature, posterior[row, s], DIMS) for s in range(k)], axis=1)
        base = np.stack([np.bincount(tongue[doc], posterior[:, s], tongues) for s in range(k)], axis=1)
        base = (base + 1e-3 + 0.05 * base.sum(1, keepdims=True)) / (base + 1e-3 + 0.05 * base.sum(1, keepdims=True)).sum(1, keepdims=True)
        expected = np.maximum(spread @ base, 1e-6)
        seen = counts.sum(1, keepdims=True)
        own = (counts + smooth * expected) / (seen + smooth)
        weights = np.clip(np.log(own / np.maximum(1 - own, 1e-6)) - np.log(expected / np.maximum(1 - expected, 1e-6)), -3, 5)
        weights = np.where(seen > 0, weights, 0).astype(np.float32)
        score = np.clip(_scores(row, feature, n, weights), -40, 40)
        likely = np.exp(score - score.max(1, keepdims=True))
        sure = 1 / (1 + np.exp(-(score.max(1) - 1.5)))  # a sentence that no classifier claims belongs to none
        own = mixed[doc]
        if len(below):  # a section's heading, as far as it is claimed, is a label of the sentences under it
            head = likely[head_of[below]] * own[below]
            head /= np.maximum(head.sum(1, keepdims=True), 1e-300)
            weight = section * sure[head_of[below]][:, None]
            own[below] = (1 - weight) * own[below] + weight * head
        p = likely * own
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        posterior = p * sure[:, None]
        if step < 2:
            posterior *= rated[doc][:, None]  # documents without labels join in once there is something to go by
        share = np.stack([np.bincount(doc, (p * sure[:, None])[:, s], len(docs)) for s in range(k)], axis=1)
        share = (share + 0.5 * prior) / (share + 0.5 * prior).sum(1, keepdims=True)
        mixed = 0.6 * share + 0.3 * prior + 0.1 / k
    # of each classifier: the threshold that its own sentences and the others' are best told apart by
    score = _scores(row, feature, n, weights)
    threshold = np.zeros(k, np.float32)
    for s in range(k):
        yes, no = posterior[:, s] > 0.6, posterior[:, s] < 0.2
        if yes.any() and no.any():
            grid = np.quantile(score[yes, s], np.linspace(0.001, 0.3, 40))
            wrong = [(score[yes, s] <= g).mean() + (score[no, s] > g).mean() for g in grid]
            threshold[s] = grid[int(np.argmin(wrong))]
        else:
            threshold[s] = np.inf
    return Classifier(subjects, weights, threshold)


def shares(classifier: Classifier, texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: sentences by subject, and sentences in all."""
    own, doc = [], []
    for d, text in enumerate(texts):
        if text:
            u = units(text)[0]
            own += u
            doc += [d] * len(u)
    doc = np.array(doc, np.int64)
    k = len(classifier.subjects)
    if not len(doc):
        return np.zeros((len(texts), k)), np.zeros(len(texts))
    sentence, subject = np.nonzero(classifier.sentences(own, words))
    by = np.bincount(doc[sentence] * k + subject, minlength=len(texts) * k).reshape(-1, k)
    return by, np.bincount(doc, minlength=len(texts))


def fit(docs: DataFrame, labels: DataFrame, subjects: DataFrame, labelled: int = 3000, plain: int = 2000, longest: int = 65_536) -> Classifier:
    """Train on bounded samples of the documents with and without raters' labels, of ``longest`` characters at most."""
    require(docs, "doc_id", "text", "lang")
    require(labels, "doc_id", "subject", "annotator")
    known = [r[0] for r in bounded(subjects.select("subject").where("subject is not null").distinct().orderBy("subject").limit(1001).collect(), 1000, "subjects")]
    votes = labels.select("doc_id", "subject", "annotator").where(F.col("subject").isin(known)).distinct().groupBy("doc_id", "subject").agg(F.count("*").alias("n"))
    votes = votes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("subject", "n"))).alias("votes"))
    text = docs.select("doc_id", "text", "lang").where(F.length("text").between(1, longest))

    def sample(df: DataFrame, limit: int) -> DataFrame:
        rate = max(1, -(-df.count() // limit))
        return df.where(F.pmod(F.xxhash64("doc_id"), F.lit(rate)) == 0).limit(2 * limit)

    chosen = sample(votes.where("doc_id is not null"), labelled)
    other = sample(text.select("doc_id"), plain).select("doc_id", F.lit(None).cast("map<string,bigint>").alias("votes")).join(chosen, "doc_id", "left_anti")
    wanted = F.broadcast(chosen.union(other))  # two samples of a fixed size
    rows = text.join(wanted, "doc_id").select("doc_id", "text", "votes", "lang").dropDuplicates(["doc_id"]).collect()
    bounded(rows, 2 * (labelled + plain), "training documents")
    rows.sort(key=lambda r: r["doc_id"])
    return train(known, [(r["text"], r["votes"] or {}, r["lang"] or "") for r in rows])


def label_documents(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", share: float = 0.25) -> DataFrame:
    """(id, subject, share) of each subject that at least ``share`` of a document's sentences are about."""
    require(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = Words(), np.array(shared.value.subjects, dtype=object)
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                by, total = shares(shared.value, batch.column(1).to_pylist(), words)
                part = by / np.maximum(total, 1)[:, None]
                row, subject = np.nonzero(part >= share - 1e-9)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(names[subject].tolist(), pa.string()), pa.array(part[row, subject], pa.float64())],
                    names=[id_col, "subject", "share"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, subject string, share double")
