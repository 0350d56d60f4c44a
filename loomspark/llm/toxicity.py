"""Toxicity by a weighted lexicon under Aho-Corasick.

Text and lexicon are folded to one skeleton: compatibility forms and case are
dropped, look-alike letters of other scripts and digits that stand for letters
become the letters they imitate, anything else becomes a space. Accents stay,
for they tell words of other languages apart; the seed words are looked for
once more without them. Terms are whole words or word beginnings. Each term
has a weight; hits inside an exception phrase don't count. The largest weight,
the sum of weights and the number of hits, both over a power of the document's
length, give the score.

Weights come from labelled documents: the smoothed log-odds of a term's
document frequency. Beside the words themselves, word beginnings are terms, so
that a family of words counts though one of its members was never labelled.
Near copies of one toxic document would lend weight to all its rare words; so
a term's frequency counts the different words that it follows, which copies
share, instead of documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import bounded_batches, entering, fold, free_name, labelled_sample, table, texts, written

#: Bound of the training sample: labelled documents of each class.
PER_CLASS = 3000
#: A term's least number of different words before it in toxic documents, and its least log-odds.
LEAST_SEEN, LEAST_ODDS = 4, 2.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5
#: The length normalisation: the sum of weights is divided by words to this power.
LENGTH_POWER = 0.25

# Letters of other scripts and digits, each followed by the Latin letter it looks like.
LOOKALIKES = {a: b for a, b in (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ӏl вb кk мm нh тt "
    "αa οo εe ρp τt υu νv ιi κk χx γy βb ωw ıi ƒf ɡg "
    "0o 1i 3e 4a 5s 7t 8b"
).split()}
#: Symbols that stand for a letter only beside one.
SYMBOLS = {"@": "a", "$": "s"}
#: Words that stand in the lexicon before anything is learned, and phrases in which such a word is harmless.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
EXCEPTIONS = ("idiot proof", "clown fish", "trash can", "trash bin", "trash bag", "pond scum")
SEED_WEIGHT = 6.0


class Folding(dict):
    """Code point to skeleton, worked out once for each code point."""

    def __init__(self, accents: bool):
        super().__init__()
        self.form = "NFKC" if accents else "NFKD"

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize(self.form, chr(code).casefold()):
            c = LOOKALIKES.get(c, c)
            out += "i" if c == "l" else c if c.isalpha() else "" if unicodedata.combining(c) else " "
        self[code] = out
        return out


FOLDING, BARE = Folding(True), Folding(False)
BETWEEN = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
BESIDE = re.compile(r"(?<=[^\W\d_])[@$]|[@$](?=[^\W\d_])")


def skeleton(text: str, folding: Folding = FOLDING, symbols: re.Pattern = BETWEEN) -> str:
    """Folded words between single spaces, with a space at either end. 'l', '1' and 'i' are one letter.

    ``symbols``: which signs are letters; those between letters, or those that
    have one on either side, where others take them for marks.
    """
    if "@" in text or "$" in text:
        text = symbols.sub(lambda m: SYMBOLS[m[0]], text)
    return " " + " ".join(text.translate(folding).split()) + " "


def automaton(terms: dict[str, float], exceptions: tuple[str, ...]):
    """Of (pattern length, weight) values; the weight of an exception is None. A final '*' marks a word beginning."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in terms.items():
        key = " " + term[:-1] if term.endswith("*") else f" {term} "
        a.add_word(key, (len(key), weight))
    for phrase in exceptions:
        key = skeleton(phrase)
        a.add_word(key, (len(key), None))
    a.make_automaton()
    return a


def folded_seeds() -> dict[str, float]:
    return {skeleton(w).strip(): SEED_WEIGHT for w in SEEDS}


@dataclass
class Lexicon:
    """Folded terms with weights, phrases that excuse, and the coefficients of the score."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    slopes: tuple[float, float, float] = (1.0, 1.0, 0.0)
    _automata: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automata": None}

    def hits(self, text: str) -> tuple[dict[int, float], int]:
        """Weight of each hit by where its word begins, and the number of words; of the terms at a word the heaviest counts."""
        if self._automata is None:
            self._automata = automaton(self.terms, self.exceptions), automaton(folded_seeds(), self.exceptions)
        folded = skeleton(text)
        found: dict[int, float] = {}
        views = [(self._automata[0], folded)]
        if BESIDE.search(text) and (other := skeleton(text, FOLDING, BESIDE)) != folded:
            views.append((self._automata[0], other))
        if not text.isascii():
            views.append((self._automata[1], skeleton(text, BARE)))
        for view, (a, s) in enumerate(views):
            here: dict[int, tuple[int, float]] = {}
            excused: list[tuple[int, int]] = []
            for end, (size, weight) in a.iter(s):
                begin = end - size + 1
                if weight is None:
                    excused.append((begin, end))
                elif begin not in here or here[begin][1] < weight:
                    here[begin] = end, weight
            for begin, (end, weight) in here.items():
                if not any(x <= begin and end <= y for x, y in excused):
                    # Words keep their number, or nearly so, but not their place from view to view.
                    word = s.count(" ", 0, begin + 1) if view or len(views) > 1 else begin
                    found[word] = max(found.get(word, 0.0), weight)
        return found, folded.count(" ") - 1

    def features(self, text: str) -> tuple[float, float, float]:
        found, words = self.hits(text)
        if not found:
            return 0.0, 0.0, 0.0
        length = max(1, words) ** LENGTH_POWER
        return max(found.values()), sum(found.values()) / length, len(found) / length

    def score(self, values: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in values], float).reshape(-1, 3)
        x[:, 2] = np.log1p(x[:, 2])
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ np.array(self.slopes), -40, 40)))


def terms_of(text: str) -> set[tuple[str, str]]:
    """Folded words and word beginnings of a text, each with the word before it."""
    words = skeleton(text).split()
    pairs = set(zip(words, ["", *words]))
    return pairs | {(w[:n] + "*", before) for w, before in pairs for n in PREFIXES if len(w) >= n}


def learn(docs: DataFrame, labels: DataFrame, parts: int, held_out: int, per_class: int = PER_CLASS) -> Lexicon:
    """A lexicon from at most ``per_class`` labelled documents a class; folds equal to ``held_out`` aren't looked at.

    Terms are counted by Spark. The driver gets all that reach LEAST_SEEN and
    LEAST_ODDS, and three numbers for each sampled document: bounded by the
    words of the sample. Without labels of both classes the seeds alone make
    the lexicon.
    """
    picked, counts = labelled_sample(docs, labels, "toxic", parts, held_out, per_class)
    picked = written(picked, "toxic-sample")
    sizes = {r["label"]: r["n"] for r in picked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon(folded_seeds())

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 16):  # a few documents at a time, as each has thousands of terms
                part = b.iloc[a : a + 16]
                rows = {(t, zlib.crc32(before.encode()), y) for text, y in zip(part["text"], part["label"], strict=True) for t, before in terms_of(text)}
                yield pd.DataFrame(list(rows), columns=["term", "before", "label"])

    seen = picked.select("text", "label").mapInPandas(emit, "term string, before long, label int").distinct()
    counted = seen.groupBy("term").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1.0))
    best = counted.where(F.col("bad") >= LEAST_SEEN).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    rows = best.collect()
    lexicon = Lexicon(folded_seeds() | {r["term"]: float(r["odds"]) for r in rows})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([lexicon.features(t) for t in b["text"]], float).reshape(-1, 3)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": np.log1p(x[:, 2]), "label": b["label"].to_numpy()})

    sample = picked.select("text", "label").mapInPandas(measure, "a double, b double, c double, label int").collect()
    x, y = np.array([r[:3] for r in sample], float), np.array([r[3] for r in sample], float)
    lexicon.bias, lexicon.slopes = fit(x, y)
    # Classes weigh alike in the fit; their true shares come back with the bias.
    lexicon.bias += float(np.log(counts[1] / counts[0]))
    return lexicon


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 3000, ridge: float = 1e-2) -> tuple[float, tuple[float, ...]]:
    """Logistic regression with slopes of at least 0, classes weighted alike."""
    scale = np.maximum(x.std(0), 1e-6)
    z = x / scale
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    b, w = 0.0, np.zeros(z.shape[1])
    for _ in range(rounds):
        g = weight * (1 / (1 + np.exp(-np.clip(b + z @ w, -40, 40))) - y)
        b -= 4 * g.sum()
        w = np.maximum(0, w - 4 * (z.T @ g + ridge * w / 100))
    return float(b), tuple(float(v) for v in w / scale)


def scored(docs: DataFrame, lexicon: Lexicon, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``out``: 0 to 1, a null text as an empty one. All columns and rows stay."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        entering("toxicity")
        return pd.Series(lexicon.score(["" if t is None else t for t in text]), dtype=float)

    return docs.withColumn(out, score(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts have no hits and score lowest. Repeated rows are
    scored each and alike; ids that are null or repeated don't matter to a
    score. Very long texts are folded and matched whole. Without documents
    there are no rows, without labels the seed words decide. Columns other than
    the two named are ignored.
    """
    rows = texts(docs, id_col, text_col)
    lexicon = learn(rows, labels, parts, held_out)
    out = scored(rows, lexicon)
    return out.select("doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with the columns they had, whatever their names.

    Null and empty texts have no hits and stay; repeated rows stay or go
    together; very long texts are matched whole; an empty table gives no rows.
    """
    lexicon = learn(docs, labels, 5, 0)
    name = free_name(docs, "toxicity")
    return scored(docs, lexicon, name).where(F.col(name) < THRESHOLD).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

