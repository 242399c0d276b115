"""Quality rules by distribution divergence.

Each text gives two histograms: of its characters over classes (lower and
upper case, digits, spaces, line ends, six kinds of signs, other scripts) and
of its words over the commonest words of the known languages. Their sums over
all texts of a language are that language's reference. A text is rejected when
it is far, by Jensen-Shannon distance, from every reference: its characters
beyond ``CHAR_LIMIT`` or its words beyond ``WORD_LIMIT``; each test is made
only from a minimum length on. Repetition and length rules come first.

A text for which there is no reference (its letters are mostly of another
script, or its language is named but not among the known ones) isn't judged by
distance.

One pass reads the texts and leaves short rows of counts in the shared
folder; the references are sums of these (at most ``len(COMMON) + 1`` rows of
fixed width, so they may go to the driver); a second pass over the counts
alone gives the verdicts. No text is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import FOLD_CASE, landed, pieces, utf8

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
#: Least words for the character test and for the word test.
CHAR_GUARD, WORD_GUARD = 50, 100
#: Jensen-Shannon distances (base 2, 0 to 1) beyond which a text is rejected.
CHAR_LIMIT, WORD_LIMIT = 0.30, 0.37

#: The commonest function words of each known language.
COMMON = {
    "en": "the of and to a in is it for that with on as was be by are this from at or an have not which but had his they you were their one all we can her has there been if more when will would who so no".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se avec son il sont ce aux ou mais comme nous sa cette ses elle été ont être fait leur tout on deux même très".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno".split(),
}
#: Signs counted apart; all others in ASCII form one more class.
SIGNS = [b".,", b";:?!", b"'\"-", b"#*$%&|<>", b"()[]{}", b"=/\\_+@^~`"]
CLASSES = 7 + len(SIGNS)


def _class_table() -> bytes:
    out = bytearray([0] * 256)
    for c in range(256):
        kind = 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b" \t" else 4 if c in b"\r\n" else 5 if c >= 0xC0 else 6
        kind = next((7 + k for k, signs in enumerate(SIGNS) if c in signs), kind)
        out[c] = 255 if 0x80 <= c < 0xC0 else kind
    return bytes(out)


CLASS_OF = np.frombuffer(_class_table(), np.uint8)
#: Lower-cases A-Z and turns ASCII signs into spaces.
BARE = bytes(32 if c < 128 and not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) else c for c in range(256)).translate(FOLD_CASE)
VOCABULARY = sorted({w for words in COMMON.values() for w in words})
PLACE = [w.encode() for w in VOCABULARY]


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """How many words stand in a window of so many words that is found twice
    or more; ranks of 1, 2, 4 and 8 words make the comparison exact."""
    n = len(words)
    if n <= window:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mixed = hashed.copy()
    for step in (1, 2, 4):
        mixed = mixed[:-step] * np.uint64(0x9E3779B97F4A7C15) + (mixed[step:] ^ (mixed[step:] >> np.uint64(29)))
    if len(np.unique(mixed)) == len(mixed):
        return 0
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    for step in (1, 2, 4):
        rank = np.unique(rank[:-step] * np.int64(n + 1) + rank[step:], return_inverse=True)[1]
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[:-window] += twice
    edge[window:] -= twice
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: bytes | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms of a text."""
    text = text or b""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    chars = np.zeros(256, np.int64)
    for at in range(0, len(raw), 1 << 20):
        chars += np.bincount(raw[at : at + (1 << 20)], minlength=256)
    points = int(chars.sum() - chars[0x80:0xC0].sum())
    lines = [line for line in text.split(b"\n") if line.strip()] if b"\n" in text else []
    classes = np.bincount(CLASS_OF, weights=chars, minlength=256)[:CLASSES].astype(np.int32)
    counted = Counter(text.translate(BARE).split())
    common = [counted.get(w, 0) for w in PLACE]
    return (
        len(words), points - int(chars[[9, 10, 11, 12, 13, 32]].sum()), int(chars[list(b"#*$%&|<>")].sum()), len(lines) - len(set(lines)), repeated_words(words),
        classes.tolist(), [*common, counted.total() - sum(common)],
    )


#: What ``counts`` adds; the prefix keeps the columns apart from those of any table.
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OWN = "__gm_"


def counts(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), lang: str = "lang") -> DataFrame:
    """``keys`` of every row, and as columns that begin with OWN its language and what ``measure`` gives."""
    kept = [F.col(k) for k in keys]
    slim = docs.select(*kept, F.col(lang).cast("string").alias(f"{OWN}lang"), F.col(text).cast("string").alias(f"{OWN}text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1]), *(f"{OWN}{f} long" for f in FIELDS), f"{OWN}chars array<int>, {OWN}words array<int>"])
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * 2
    names = [OWN + f for f in (*FIELDS, "chars", "words")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            columns = zip(*map(measure, utf8(b.column(b.num_columns - 1))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*b.schema.names[:-1], *names])

    return slim.mapInArrow(run, schema)


def references(counted: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The summed histograms of each known language, and of all texts under ''.
    At most len(COMMON) + 1 rows reach the driver."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in pieces(batches):
            lang = b.column(0).to_pylist()
            both = np.hstack([np.asarray(b.column(k).flatten(), np.int64).reshape(b.num_rows, -1) for k in (1, 2)]) if b.num_rows else np.zeros((0, CLASSES + len(PLACE) + 1), np.int64)
            for name in {*lang}:
                total[name] = total.get(name, 0) + both[[x == name for x in lang]].sum(axis=0)
        if total:
            cells = [(name, k, int(v)) for name, row in total.items() for k, v in enumerate(row)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], names=["lang", "cell", "n"])

    lang = F.col(f"{OWN}lang")
    known = F.when(lang.isin(*COMMON), lang).otherwise("")
    found = counted.select(known.alias("lang"), f"{OWN}chars", f"{OWN}words").mapInArrow(sums, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    out = {lang: np.zeros(CLASSES + len(PLACE) + 1) for lang in {r["lang"] for r in found}}
    for r in found:
        out[r["lang"]][r["cell"]] = r["n"]
    if out:
        out[""] = sum(out.values())
    return {k: (v[:CLASSES], v[CLASSES:]) for k, v in out.items()}


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of p from q; 0 for rows without counts."""
    p = np.asarray(p, float)
    total = p.sum(axis=1, keepdims=True)
    p, q = p / np.maximum(total, 1), q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(d, 0)), 0.0)


def distances(b: pa.RecordBatch, refs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each row, the distance of its characters and of its words from the
    nearest reference; NaN where there is none for them: for characters and
    words of a text whose letters are mostly not Latin, and for words of a
    language that is named but not known."""
    chars, words = (np.asarray(b.column(OWN + k).flatten(), np.int64).reshape(b.num_rows, -1) for k in ("chars", "words"))
    char, word = (np.min([js_distance(x, r[k]) for r in refs], axis=0) for k, x in enumerate((chars, words)))
    foreign = 2 * chars[:, 5] > chars[:, [0, 1, 5]].sum(axis=1)
    unknown = np.array([x is not None and x not in COMMON for x in b.column(f"{OWN}lang").to_pylist()], bool)
    return [np.where(foreign, np.nan, char), np.where(foreign | unknown, np.nan, word)]


def _judged(counted: DataFrame) -> DataFrame:
    """``counted`` with both distances (null where nothing is known to compare with), ``base_failed`` and ``kept``."""
    refs = list(references(counted).values())
    fields = [f for f in counted.columns if f not in (f"{OWN}chars", f"{OWN}words")]
    schema = ", ".join([*(f"`{f}` {counted.schema[f].dataType.simpleString()}" for f in fields), f"{OWN}char_distance double, {OWN}word_distance double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            if b.num_rows:
                far = [pa.array(x, pa.float64(), from_pandas=True) for x in distances(b, refs)]
                yield pa.RecordBatch.from_arrays([*(b.column(f) for f in fields), *far], names=[*fields, f"{OWN}char_distance", f"{OWN}word_distance"])

    n, char, word = (F.col(OWN + c) for c in ("n_words", "char_distance", "word_distance"))
    failed = (n < MIN_WORDS) | (100 * F.col(f"{OWN}n_repeat_words") > REPEAT_PERCENT * n)
    far = ((n >= CHAR_GUARD) & F.coalesce(char > CHAR_LIMIT, F.lit(False))) | ((n >= WORD_GUARD) & F.coalesce(word > WORD_LIMIT, F.lit(False)))
    return counted.mapInArrow(run, schema).withColumn(f"{OWN}base_failed", failed).withColumn(f"{OWN}kept", ~failed & ~far)


def judge(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``keys``, the five counts, ``char_distance``
    and ``word_distance`` (to the nearest reference), ``base_failed`` and ``kept``.

    Null texts have no words and fail the base rules, as empty ones do. A null
    language counts towards the reference of all texts only; rows are compared
    with every reference, so a wrong one among the known languages does no harm.
    A text in another script, or the words of a language named but not known,
    have nothing to be compared with: the distance is null and rejects nothing.
    Very long texts are counted whole. Repeated rows stay; an empty input gives
    an empty result; other columns are ignored."""
    found = _judged(landed(counts(docs, text, keys, lang), "counts"))
    return found.select(*keys, *(F.col(OWN + c).alias(c) for c in (*FIELDS, "char_distance", "word_distance", "base_failed", "kept")))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns: these
    are written beside the counts, so each text is measured once and nothing is joined."""
    found = _judged(landed(counts(docs, text, tuple(docs.columns), lang), "counted", compression="zstd"))
    return found.where(f"{OWN}kept").select(*docs.columns)
