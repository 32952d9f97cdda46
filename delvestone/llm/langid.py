"""Languages of records, paragraphs and sentences by error-correcting output codes.

Each language has a codeword of some bits.  For each bit a linear classifier
over hashed character n-grams (log odds, all languages of a side weighing the
same) tells on which side a sentence is; the language whose codeword loses
least against the bits' margins, each weighted by how well the bit did in
training, is the sentence's.  Where the runner-up is close the sentence is
flagged as ambiguous.  A paragraph's and a record's language is the one that
most of its letters are written in.

The classifiers are trained on the labels that come with the records, many of
which are wrong: sentences are first labelled as their record, then relabelled
by what was learnt, and those that stay unsure are left out.  The training
sample is bounded (``train`` records, whole texts); everything else covers all
rows.  No shuffle is needed to label.

Results of the edge cases: null and empty contents have no paragraphs; a
paragraph without letters has none of the languages and doesn't come out; null
and empty maps, null confidences and ``und`` are no label; repeated rows give
one row; a sentence in none of the known languages gets the nearest one, with
a low confidence; only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, require

LANGUAGES = ("de", "en", "es", "fr", "pt", "zh")
#: Codes of ISO 639-2 of these languages.
LONG_CODES = {"deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "por": "pt", "zho": "zh", "chi": "zh"}
#: A few common function words, so that a language without a labelled record can still be told.
SEEDS = {
    "de": "der die das und in im den von zu mit für auf ist nicht ein eine nach bei",
    "en": "the and of to in a is that for with on as was by this not each every",
    "es": "el la los las y de en un una por con para que no se del al como",
    "fr": "le la les et de des en un une pour par avec que ne pas est du dans",
    "pt": "o a os as e de do da em um uma por com para que não se no na",
    "zh": "的 了 在 是 和 不 有 这 中 为 与 也",
}
DIMS, LONGEST = 1 << 16, 4
#: Words (a Han character is one), and the ends of sentences.
TOKEN = re.compile(r"[㐀-鿿豈-﫿]|[^\W\d_㐀-鿿豈-﫿]+|[.!?](?=\s)|[。！？]")
_ENDS = frozenset(".!?。！？")


def grams(word: str) -> list[int]:
    """Hashed character n-grams of a word with its edges; the whole word as well."""
    w = f"^{word.lower()}$"
    parts = [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if w[i : i + n] not in "^$"]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % DIMS for p in (*parts, w)]


def codewords(k: int, bits: int) -> np.ndarray:
    """A row of +1 and -1 per language: of all ways to split the languages in two,
    those that, added one by one, keep the codewords furthest apart."""
    columns = np.array([[1 if i == 0 or c >> (i - 1) & 1 else -1 for i in range(k)] for c in range(2 ** (k - 1) - 1)])
    pairs = list(combinations(range(k), 2))
    differ = np.array([[c[a] != c[b] for a, b in pairs] for c in columns])
    chosen: list[int] = []
    while len(chosen) < min(bits, len(columns)):
        have = differ[chosen].sum(0) if chosen else np.zeros(len(pairs))
        free = [c for c in range(len(columns)) if c not in chosen]
        chosen.append(max(free, key=lambda c: ((have + differ[c]).min(), (have + differ[c]).sum() - ((have + differ[c]) ** 2).sum() / 1e3, -c)))
    return columns[chosen].T


@dataclass
class Coder:
    """The trained bits: a weight for each n-gram and bit."""

    weights: np.ndarray  # DIMS x bits
    code: np.ndarray  # languages x bits
    trust: np.ndarray  # of each bit

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, confidence and ambiguity from the margins of each bit."""
        z = np.clip(margins, -30, 30)[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, -z) * self.trust).sum(2) / self.trust.sum()
        least = np.argmin(loss, axis=1)
        odds = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
        sure = odds.max(1) / odds.sum(1)
        runner = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else loss[:, 0] + 1
        return least, sure, runner - loss.min(1) < 0.2


class Vocabulary(dict):
    """Words to numbers; of each number the letters and the margins of its n-grams."""

    def __init__(self, coder: Coder | None):
        super().__init__()
        self.coder = coder
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.words: list[str] = [""]
        self.rows: list[np.ndarray] = [] if self.coder is None else [np.zeros(self.coder.weights.shape[1], np.float32)]
        self.update(dict.fromkeys(_ENDS, 0))

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        if self.coder is not None:
            g = grams(word)
            self.rows.append(self.coder.weights[g].sum(0) / len(g) * min(len(word), 8))
        return number


def spans(text: str) -> list[tuple[int, str]]:
    """(number, text) of the paragraphs: the longest runs of lines that aren't blank."""
    out, own = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            own.append(line)
        elif own:
            out.append("\n".join(own))
            own = []
    return list(enumerate(out))


def sentences(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, and of each word its sentence's and its text's number."""
    found = [TOKEN.findall(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    look = vocabulary.__getitem__
    words = np.fromiter((n for f in found for n in map(look, f)), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    new = np.zeros(len(words), bool)
    new[1:] = (text[1:] != text[:-1]) | (words[:-1] == 0)
    sentence = np.cumsum(new)
    real = words != 0
    words, sentence, text = words[real], sentence[real], text[real]
    if len(sentence):
        sentence = np.cumsum(np.concatenate([[0], sentence[1:] != sentence[:-1]]))
    return words, sentence, text


def label(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """Of each sentence: its text's number, letters, language, confidence, ambiguity."""
    words, sentence, text = sentences(texts, vocabulary)
    if not len(words):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0), np.zeros(0, bool)
    letters = np.fromiter(map(len, vocabulary.words), np.int64, len(vocabulary.words))[words]
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    margins = np.add.reduceat(np.stack(vocabulary.rows)[words], first, axis=0)
    own, sure, unclear = vocabulary.coder.decode(margins)
    return text[first], np.add.reduceat(letters, first), own, sure, unclear


def train(texts: list[str], labels: list[str], bits: int = 15, rounds: int = 3) -> Coder:
    """Bits from texts of which some are labelled wrongly or mix languages."""
    code = codewords(len(LANGUAGES), bits)
    plain = Vocabulary(None)
    words, sentence, text = sentences([*texts, *SEEDS.values()], plain)
    given = np.array([*(LANGUAGES.index(x) for x in labels), *(LANGUAGES.index(x) for x in SEEDS)])
    features = [np.array(grams(w) if w else [0], np.int64) for w in plain.words]
    size = np.array([len(f) for f in features])
    flat, start = np.concatenate(features), np.concatenate([[0], np.cumsum(size)[:-1]])
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    own, known = given[text[first]], np.ones(len(first), bool)
    seed = text[first] >= len(texts)
    long = np.minimum([len(w) for w in plain.words], 8) / size
    for step in range(rounds):
        counts = np.zeros((len(LANGUAGES), DIMS))
        for k in range(len(LANGUAGES)):
            times = np.bincount(words[np.isin(sentence, np.flatnonzero(known & (own == k)))], minlength=len(plain.words))
            times = times * 1.0
            which = np.flatnonzero(times)
            if len(which):
                index = np.concatenate([flat[start[w] : start[w] + size[w]] for w in which])
                counts[k] = np.bincount(index, np.repeat(times[which], size[which]), DIMS)
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        weights = np.empty((DIMS, code.shape[1]), np.float32)
        for b in range(code.shape[1]):
            yes, no = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
            weights[:, b] = np.clip(np.log((yes + 1e-6) / (no + 1e-6)), -4, 4)
        per_word = np.stack([weights[f].sum(0) for f in features]) * long[:, None]
        margins = np.add.reduceat(per_word[words], first, axis=0)
        right = np.array([(np.sign(margins[known, b]) == code[own[known], b]).mean() for b in range(code.shape[1])])
        coder = Coder(weights, code, np.log(np.maximum(right, 0.55) / np.maximum(1 - right, 0.01)).astype(np.float32))
        guess, sure, unclear = coder.decode(margins)
        own = np.where(seed, given[text[first]], guess)
        known = seed | ((sure > 0.8) & ~unclear)
    return coder


def primary(code):
    """The language of a code in any of its forms, or null if it names none."""
    base = F.lower(F.regexp_extract(F.trim(code), r"^([A-Za-z]+)", 1))
    known = F.create_map(*[F.lit(x) for pair in LONG_CODES.items() for x in pair])
    return F.when(base.isin("", "und"), None).otherwise(F.coalesce(F.try_element_at(known, base), base))


def given_label(languages):
    """The language of the key with the highest value; of equal values the first key."""
    entries = F.filter(F.map_entries(languages), lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]))
    best = F.sort_array(F.transform(entries, lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("key"))))
    return primary(F.try_element_at(best, F.lit(1))["key"])


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, limit: int = 1500) -> Coder:
    """Train on at most ``limit`` labelled records, chosen by the hash of their id."""
    own = df.select(id_col, F.col(text_col).alias("text"), F.col(label_col).alias("label")).where(F.col("label").isin(*LANGUAGES) & (F.length("text") > 0))
    n = own.count()
    rate = max(1, n // limit)
    rows = own.where(F.pmod(F.xxhash64(id_col), F.lit(rate)) == 0).select("text", "label").limit(2 * limit).collect()
    bounded(rows, 2 * limit, "training records")
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def label_paragraphs(df: DataFrame, id_col: str, text_col: str, coder: Coder, least_letters: int = 40, segments: bool = False) -> DataFrame:
    """(id, para_no, lang, confidence, letters, total) of each paragraph that counts.

    With ``segments`` the runs of sentences of one language in it instead, with
    ``seg_no`` and ``ambiguous``.
    """
    require(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(coder)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        names = np.array(LANGUAGES)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                if len(vocabulary) > 200_000:
                    vocabulary.clear()
                rows, numbers, texts = [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    for number, paragraph in spans(text or ""):
                        if not paragraph.startswith(("#", "|", "```")):
                            rows.append(row), numbers.append(number), texts.append(paragraph)
                text, letters, own, sure, unclear = label(texts, vocabulary)
                rows, numbers = np.array(rows, np.int64), np.array(numbers, np.int64)
                k = len(LANGUAGES)
                by = np.bincount(text * k + own, letters, len(texts) * k).reshape(-1, k)
                total = by.sum(1)
                if segments:
                    keep = total[text] >= least_letters
                    text, letters, own, sure, unclear = (x[keep] for x in (text, letters, own, sure, unclear))
                    new = np.concatenate([[True], (text[1:] != text[:-1]) | (own[1:] != own[:-1])]) if len(text) else np.zeros(0, bool)
                    first = np.flatnonzero(new)
                    start = np.flatnonzero(np.concatenate([[True], text[first][1:] != text[first][:-1]])) if len(first) else first
                    seg = np.arange(len(first)) - np.repeat(start, np.diff(np.append(start, len(first))))
                    size = np.add.reduceat(letters, first) if len(first) else first
                    mean = np.add.reduceat(letters * sure, first) / np.maximum(size, 1) if len(first) else np.zeros(0)
                    some = np.logical_or.reduceat(unclear, first) if len(first) else np.zeros(0, bool)
                    where = text[first]
                    columns = [batch.column(0).take(pa.array(rows[where])), pa.array(numbers[where], pa.int32()), pa.array(seg, pa.int32()), pa.array(names[own[first]], pa.string()), pa.array(mean, pa.float64()), pa.array(size, pa.int64()), pa.array(some)]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, "para_no", "seg_no", "lang", "confidence", "letters", "ambiguous"])
                    continue
                where = np.flatnonzero(total >= least_letters)
                best = by.argmax(1)
                mean = np.bincount(text, letters * sure * (own == best[text]), len(texts)) / np.maximum(total, 1)
                columns = [batch.column(0).take(pa.array(rows[where])), pa.array(numbers[where], pa.int32()), pa.array(names[best[where]], pa.string()), pa.array(mean[where], pa.float64()), pa.array(by[where, best[where]], pa.int64()), pa.array(total[where], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "para_no", "lang", "confidence", "letters", "total"])

    tail = "seg_no int, lang string, confidence double, letters bigint, ambiguous boolean" if segments else "lang string, confidence double, letters bigint, total bigint"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, para_no int, {tail}")
