"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its own features (make-up of its characters,
repeated words and lines, function words) and those of the lines before and
after it give an emission score; neighbouring labels give a transition score.
Forward-backward yields each line's probability of being good; their mean,
weighted by line length, goes through a logistic curve to the document's
score.

Labels are those of documents; those of lines are latent. A good document has
good lines only, a bad one has a bad line somewhere, and the likelihood sums
over all labellings that its label allows: it is the probability of the path of
good labels, or one less that, so a bad document's sound lines needn't be called bad.
That alone learns little from documents that are bad throughout; so, with
weight ``HOLD``, the path of bad labels counts as well (0: not at all, 1: as
much as in plain training on the document's label).

Fitted to at most ``SAMPLE`` labelled documents (chosen by hash, never
held-out ones): two thirds, and of these as many as have ``LINES`` lines
together, give the field's weights, the others the curve. The model is of fixed
size. Every whole text is scored where it is read, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import labelled_sample, landed, pieces, utf8
from gristmill.llm.quality_rules import BARE, COMMON
from gristmill.llm.toxicity import logistic

#: On labelled documents that are bad throughout, held-out errors at 0, 0.1, 0.3 and 1 were 34, 17, 11 and 7 of 825.
HOLD = 0.3
#: Most lines of a document that is fitted on.
MOST_LINES = 1000
SAMPLE, LINES, ROUNDS, RATE, SHRINK, PIECE, BATCH = 6_000, 200_000, 160, 0.1, 1e-3, 100, 256

FUNCTION_WORDS = frozenset(w.encode() for words in COMMON.values() for w in words)
KINDS = ["upper", "digit", "sign", "stress", "stop", "other", "wide"]
OWN = [*KINDS, "long", "word length", "repeats", "function", "again", "no function", "shout"]
WIDTH = 1 + 3 * len(OWN)


def _kind_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for c in range(256):
        ch = chr(c)
        table[c] = 1 if "A" <= ch <= "Z" else 2 if "0" <= ch <= "9" else 3 if ch in "#*$%&|<>" else 4 if ch in "!?" else 5 if ch in ".,;:" else 7 if c >= 0xC0 else 6 if 32 < c < 128 and not ch.isalnum() else 0
    return table


KIND_OF = _kind_table()


def lines_of(text: bytes | None) -> list[bytes]:
    return [line for line in (text or b"").split(b"\n") if line.strip()]


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row for each line: 1, its own features, those of the line before and of the line after."""
    own = np.zeros((len(lines), len(OWN)))
    seen: set[bytes] = set()
    joined = np.frombuffer(b"".join(lines), np.uint8)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(np.r_[0, size[:-1]])
    kind = KIND_OF[joined]
    for k in range(len(KINDS)):
        own[:, k] = np.add.reduceat(kind == k + 1, starts)
    own[:, : len(KINDS)] /= size[:, None]
    own[:, 0] = np.minimum(1, 2 * own[:, 0])
    own[:, 2:4] = np.minimum(1, 5 * own[:, 2:4])
    for k, line in enumerate(lines):
        words = line.translate(BARE).split()
        n = len(words) or 1
        common = sum(map(FUNCTION_WORDS.__contains__, words)) / n
        own[k, 7:] = math.log1p(size[k]) / 10, min(1.0, size[k] / n / 20), 1 - len(set(words)) / n, common, line in seen, n > 7 and common < 0.1, line.isupper()
        seen.add(line)
    none = np.zeros((1, len(OWN)))
    return np.hstack([np.ones((len(lines), 1)), own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])])


@dataclass
class Model:
    """emission: factors of a line's features for good; move: [from, to] log scores; curve: constant and factors of ``summary``."""

    emission: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: list[float] = field(default_factory=lambda: [0.0, 1.0, 0.0])

    def marginals(self, x: np.ndarray) -> list[float]:
        """Each line's probability of being good, by forward-backward."""
        good = np.exp(np.clip(x @ self.emission, -30, 30)).tolist()
        (a, b), (c, d) = np.exp(self.move).tolist()
        ahead, p = [], None
        for g in good:
            f0, f1 = (1.0, g) if p is None else (p[0] * a + p[1] * c, (p[0] * b + p[1] * d) * g)
            p = (f0 / (f0 + f1), f1 / (f0 + f1))
            ahead.append(p)
        b0, b1, out = 1.0, 1.0, [0.0] * len(good)
        for k in range(len(good) - 1, -1, -1):
            x0, x1 = ahead[k][0] * b0, ahead[k][1] * b1
            out[k] = x1 / (x0 + x1)
            b0, b1 = a * b0 + b * good[k] * b1, c * b0 + d * good[k] * b1
            total = b0 + b1
            b0, b1 = b0 / total, b1 / total
        return out

    def summary(self, text: bytes | None) -> list[float]:
        """Log odds of the length-weighted mean marginal, and the text's length on a log scale."""
        lines = lines_of(text)
        if not lines:
            return [-4.0, 0.0]
        weight = np.fromiter(map(len, lines), float, len(lines))
        mean = float(np.average(self.marginals(line_features(lines)), weights=weight))
        mean = min(max(mean, 0.002), 0.998)
        return [math.log(mean / (1 - mean)), math.log1p(weight.sum()) / 10]

    def score(self, text: bytes | None) -> float:
        z = self.curve[0] + sum(a * x for a, x in zip(self.curve[1:], self.summary(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def gradient(model: Model, x: np.ndarray, y: np.ndarray, live: np.ndarray, hold: float = HOLD) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of a batch: x [doc, line, feature], documents' labels
    y [doc], live [doc, line]. With P the probability of all lines being good and
    f that path's features less the expected ones, it is f for a good document.
    For a bad one it is -P / (1 - P) f, and ``hold`` times the gradient of all lines being bad."""
    emit = np.stack([np.zeros(x.shape[:2]), np.clip(x @ model.emission, -30, 30)], axis=2)
    n, length = live.shape
    ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    ahead[:, 0] = emit[:, 0]
    for t in range(1, length):
        ahead[:, t] = np.logaddexp(ahead[:, t - 1, :1] + model.move[0], ahead[:, t - 1, 1:] + model.move[1]) + emit[:, t]
    for t in range(length - 2, -1, -1):
        step = emit[:, t + 1] + behind[:, t + 1]
        back = np.logaddexp(model.move[:, 0] + step[:, :1], model.move[:, 1] + step[:, 1:])
        behind[:, t] = np.where(live[:, t + 1, None], back, 0.0)
    both = ahead + behind
    good = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -50, 50)))
    held = live[:, 1:].sum(axis=1)
    clean = (emit[:, :, 1] * live).sum(axis=1) + held * model.move[1, 1] - np.logaddexp(both[:, 0, 0], both[:, 0, 1])
    clean = np.minimum(clean, -1e-9)
    weight = np.where(y == 1, 1.0, np.exp(clean) / np.expm1(clean))
    whole = np.where(y == 1, 0.0, hold)
    off = ((1 - good) * weight[:, None] - good * whole[:, None]) * live
    move = np.zeros((2, 2))
    if length > 1:
        pair = ahead[:, :-1, :, None] + model.move + (emit + behind)[:, 1:, None, :]
        p = np.exp(pair - np.logaddexp.reduce(pair.reshape(n, length - 1, 4), axis=2)[:, :, None, None]) * live[:, 1:, None, None]
        move = -(p * (weight + whole)[:, None, None, None]).sum(axis=(0, 1))
        move += np.diag([(held * whole).sum(), (held * weight).sum()])
    return np.einsum("nt,ntf->f", off, x), move


def train(features: list[np.ndarray], labels: list[int], hold: float = HOLD) -> Model:
    """Weights by Adam steps over batches of pieces of at most PIECE lines, each with its document's label."""
    pieces = sorted(((x[k : k + PIECE], y) for x, y in zip(features, labels) for k in range(0, len(x), PIECE)), key=lambda p: len(p[0]))
    batches = []
    for k in range(0, len(pieces), BATCH):
        some = pieces[k : k + BATCH]
        x, live = np.zeros((len(some), len(some[-1][0]), WIDTH)), np.zeros((len(some), len(some[-1][0])), bool)
        for row, (f, _) in enumerate(some):
            x[row, : len(f)], live[row, : len(f)] = f, True
        batches.append((x, np.array([y for _, y in some]), live))
    model, total = Model(), sum(b[2].sum() for b in batches)
    first, second = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, ROUNDS + 1):
        g = sum(np.r_[e, m.ravel()] for e, m in (gradient(model, *b, hold) for b in batches)) / total
        w = np.r_[model.emission, model.move.ravel()]
        g -= SHRINK * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        model.emission, model.move = w[:WIDTH], w[WIDTH:].reshape(2, 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, hold: float = HOLD) -> Model:
    """A model from at most ``sample`` labelled documents; a blank one, which
    scores by the curve's default, if they lack one of the two classes. At most
    LINES rows of features reach the driver: documents of over MOST_LINES lines
    (blank ones don't count) aren't fitted on, and of the others as many, in the order of
    their ids' hashes, as have LINES together, so at least LINES / MOST_LINES if there are so many."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(" \t\r\x0b\x0c")) != "")).alias("lines")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)).alias("part")
    rows = landed(labelled_sample(docs, labels, "quality", sample).select("*", part, lines), "quality")
    # A window over at most ``sample`` rows of two numbers.
    so_far = F.sum("lines").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = rows.where((F.col("part") > 0) & (F.col("lines") <= MOST_LINES)).select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= LINES).select("doc_id")

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = [line_features(lines).astype(np.float32).tobytes() if (lines := lines_of(t)) else b"" for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], names=["x", "y"])

    found = rows.join(F.broadcast(picked), "doc_id").select("text", "y").mapInArrow(measured, "x binary, y int").toArrow()
    y = (found["y"].to_numpy() > 0).astype(int)
    if len(np.unique(y)) < 2:
        return Model()
    model = train([np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(float) for x in found["x"].to_pylist()], y.tolist(), hold)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = [model.summary(t) for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rest = rows.where("part = 0").select("text", "y").mapInArrow(summed, "x array<double>, y int").toArrow()
    if len(rest["y"].unique()) == 2:
        model.curve = logistic(np.array(rest["x"].to_pylist()), (rest["y"].to_numpy() > 0).astype(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``score`` (0 to 1, higher is better) of every row. Texts
    without a line (null, empty, blank) get the score of the worst mean; very
    long ones are scored whole; repeated rows stay; an empty table gives an
    empty one; other columns are ignored."""
    slim = docs.select(*keys, F.col(text).cast("string").alias("__gm_text"))
    schema = slim.drop("__gm_text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [model.score(raw) for raw in utf8(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return slim.mapInArrow(run, schema)
