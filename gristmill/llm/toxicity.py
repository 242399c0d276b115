"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: Unicode compatibility forms, lower case, look-alike
letters of other scripts, digits and signs that stand for letters. Terms are
whole words or word beginnings; each has a weight, the log odds of its
document frequency in toxic against other texts. A term that begins inside an
exception phrase doesn't count. The weights of a text add up and are divided
by its length; a logistic curve over that, and nothing else, is the score.

What is learned. Terms, exception phrases and the curve come from at most
``SAMPLE`` labelled rows (chosen by hash; never held-out ones); two thirds of
them give the terms, the others the curve. So the model is of bounded size and
may be broadcast; ``terms`` limits it further, by default it doesn't. Without
usable labels the fixed base lexicon stands alone. Every whole text is scored
where it is read, without a shuffle, in time that grows with its length alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import labelled_sample, landed, pieces, utf8

#: Most labelled rows a model is fitted on.
SAMPLE = 12_000
#: Least toxic documents with a term, least log odds, lengths of word beginnings.
LEAST_DOCS, LEAST_ODDS, STEMS = 6, 2.5, range(4, 9)
BASE_WEIGHT = 5.0

#: Insults that count before anything is learned, and phrases in which such a word is harmless.
BASE = "idiot idiots idiotic moron morons stupid imbecile dumbass loser losers scum trash worthless pathetic disgusting clown clowns vermin subhuman degenerate retard filthy bastard asshole".split()
HARMLESS = ["clown fish", "class clown", "trash can", "trash bin", "trash bag", "idiot proof", "sore loser", "pond scum", "stupid question"]

#: Letters of other scripts, digits and signs, and the letter each looks like.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнαοερικντυχ0134578@", "aeopcyxijsdhkmtbhaoepikvtuxoieastba")
INSIDE = re.compile(r"(?<=[^\W\d_])[$!|](?=[^\W\d_])|(?<![^\s])[$](?=[^\W\d_])")
SIGN = {"$": "s", "!": "i", "|": "i"}
NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Folded words, each between single spaces."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = INSIDE.sub(lambda m: SIGN[m[0]], text.lower()).translate(LOOKALIKES)
    return f" {NOT_LETTERS.sub(' ', text).strip()} "


@dataclass
class Model:
    """weights: by term, " word " or " beginning"; exceptions: phrases; curve: constant and factor of ``density``."""

    weights: dict[str, float] = field(default_factory=lambda: {f" {w} ": BASE_WEIGHT for w in BASE})
    exceptions: list[str] = field(default_factory=lambda: [f" {p} " for p in HARMLESS])
    curve: list[float] = field(default_factory=lambda: [-4.0, 1.5])


class Matcher:
    def __init__(self, model: Model) -> None:
        self.model, self.auto = model, ahocorasick.Automaton()
        for phrase in model.exceptions:
            self.auto.add_word(phrase, (len(phrase), 0.0))
        for term, weight in model.weights.items():
            self.auto.add_word(term, (len(term), weight))
        self.auto.make_automaton()

    def matches(self, folded: str) -> dict[int, float]:
        """The greatest weight of the terms that begin at each place, without
        those that begin inside an exception phrase: one sweep over both in the
        order of their places."""
        found, void = {}, []
        for end, (size, weight) in self.auto.iter(folded):
            start = end - size + 1
            if weight:
                found[start] = max(weight, found.get(start, 0.0))
            else:
                void.append((start, end))
        if not void:
            return found
        void.sort()
        left, k, reach = {}, 0, -1
        for at in sorted(found):
            while k < len(void) and void[k][0] <= at:
                reach = max(reach, void[k][1])
                k += 1
            if at >= reach:
                left[at] = found[at]
        return left

    def density(self, text: str) -> float:
        """Summed weight in a hundred words (and some more, so that a short text needs more than a hint), on a log scale."""
        folded = fold(text)
        return math.log1p(100 * sum(self.matches(folded).values()) / (folded.count(" ") + 20))

    def score(self, text: str) -> float:
        z = self.model.curve[0] + self.model.curve[1] * self.density(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Constant and factors of a logistic curve, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([0.01, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w.tolist()


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int | None = None) -> Model:
    """A model from at most ``sample`` labelled rows; the base model if they
    lack one of the two classes. ``terms`` limits learned terms and exception
    phrases, each; None takes all that the sample supports, whose number the
    sample bounds (each stands in LEAST_DOCS of its texts or more).

    Null texts count as empty ones; of rows that repeat an id one is used;
    labels that are null, held out or without a document are left out."""
    rows = landed(labelled_sample(docs, labels, "toxic", sample), "toxic")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    size = rows.where(part > 0).agg(F.count_if(F.col("y") > 0).alias("t"), F.count_if(F.col("y") <= 0).alias("c")).first()
    model = Model()
    if not size["t"] or not size["c"]:
        return model

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            toxic, clean = Counter(), Counter()
            for y, raw in zip(b.column(1).to_pylist(), utf8(b.column(0))):
                (toxic if y > 0 else clean).update(_terms(fold(_text(raw))))
            terms = [*toxic.keys() | clean.keys()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (toxic, clean))], names=["term", "t", "c"])

    odds = F.log((F.col("t") + 0.5) / (size["t"] + 1)) - F.log((F.col("c") + 0.5) / (size["c"] + 1))
    counted = rows.where(part > 0).select("text", "y").mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    best = counted.where(f"t >= {LEAST_DOCS}").withColumn("w", odds).where(f"w >= {LEAST_ODDS}").orderBy(F.desc(F.col("t") * F.col("w")), "term")
    model.weights |= {r["term"]: r["w"] for r in _general((best.limit(terms) if terms is not None else best).collect())}
    model.exceptions += exceptions(rows.where(part > 0), model, most=terms)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for b in pieces(batches):
            x = [matcher.density(_text(raw)) for raw in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column(1)], names=["x", "y"])

    rest = rows.where(part == 0).select("text", "y").mapInArrow(measured, "x double, y int").toArrow()
    if len(rest["y"].unique()) == 2:
        model.curve = logistic(rest["x"].to_numpy()[:, None], (rest["y"].to_numpy() > 0).astype(float))
    return model


def _general(found: list) -> list:
    """Without the word beginnings that stand for little more than one longer
    term: they would catch harmless words, too."""
    longer: dict[str, int] = {}
    for r in found:
        for k in range(min(STEMS) + 1, len(r["term"])):
            longer[r["term"][:k]] = max(r["t"], longer.get(r["term"][:k], 0))
    return [r for r in found if r["term"].endswith(" ") or r["t"] >= 1.3 * longer.get(r["term"], 0)]


def exceptions(rows: DataFrame, model: Model, least: int = 5, most: int | None = None) -> list[str]:
    """Pairs of a term's word and a neighbour that stand in ``least`` or more
    texts that aren't toxic and in none that is."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for b in pieces(batches):
            toxic, clean = Counter(), Counter()
            for y, raw in zip(b.column(1).to_pylist(), utf8(b.column(0))):
                folded = fold(_text(raw))
                found = set()
                for at in matcher.matches(folded):
                    end = folded.index(" ", at + 1)
                    word, before = folded[at + 1 : end], folded[folded.rfind(" ", 0, at) + 1 : at]
                    after = folded[end + 1 : folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
                    found |= {f" {before} {word} "} if before else set()
                    found |= {f" {word} {after} "} if after else set()
                (toxic if y > 0 else clean).update(found)
            names = [*toxic.keys() | clean.keys()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in (toxic, clean))], names=["pair", "t", "c"])

    counted = rows.select("text", "y").mapInArrow(pairs, "pair string, t long, c long").groupBy("pair").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    best = counted.where(f"t = 0 AND c >= {least}").orderBy(F.desc("c"), "pair")
    return [r["pair"] for r in (best.limit(most) if most is not None else best).collect()]


def score(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``score`` (0 to 1) of every row. Null and empty texts score
    as a text without terms; very long ones are scored whole; repeated rows
    stay; an empty table gives an empty one; other columns are ignored."""
    slim = docs.select(*keys, F.col(text).cast("string").alias("__gm_text"))
    schema = slim.drop("__gm_text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for b in pieces(batches):
            found = [matcher.score(_text(raw)) for raw in utf8(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return slim.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for b in pieces(batches):
            yield b.filter(pa.array([matcher.score(_text(raw)) < limit for raw in utf8(b.column(text))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
