"""Byte-level BPE encoding and decoding over a public vocabulary.

Each pre-token is merged over a contiguous rank array: the boundaries of its
parts stand in one list beside the rank of each adjacent pair; the least rank
is found by a scan, its boundary is deleted, and the ranks of the two
neighbours are refreshed. That is quadratic in the length of a word, which
suits short words; words over ``LONG`` bytes keep their pairs in a heap with
the same order of merges (least rank, then leftmost).

Rows are encoded where they are read; there is no shuffle. Finished words are
kept in a cache of bounded size per task. The vocabulary file is read on the
driver and sent out once; its size is a property of the public file.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import pieces, utf8

LONG, CACHE = 64, 250_000
NONE = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level
    vocabulary: itself where Latin-1 prints it, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level vocabulary: ids of byte strings, ranks of merges, special
    strings, and the pre-token pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.pattern = pattern
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): k for t, k in spec["model"]["vocab"].items() if t not in self.special}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            a, b = raw(a), raw(b)
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.bytes = {k: t for t, k in self.ids.items()} | {k: t.encode() for t, k in self.special.items()}
        self.single = [self.ids.get(bytes([b])) for b in range(256)]

    def merge(self, word: bytes) -> list[int]:
        parts = [self.single[b] for b in word]
        if len(parts) > LONG:
            return self._merge_long(parts)
        get = self.ranks.get
        found = [get(pair) for pair in zip(parts, parts[1:])]
        rank = [f[0] if f else NONE for f in found]
        into = [f[1] if f else 0 for f in found]
        while rank and (least := min(rank)) < NONE:
            k = rank.index(least)
            parts[k] = into[k]
            del parts[k + 1], rank[k], into[k]
            if k < len(rank):
                rank[k], into[k] = get((parts[k], parts[k + 1])) or (NONE, 0)
            if k:
                rank[k - 1], into[k - 1] = get((parts[k - 1], parts[k])) or (NONE, 0)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for a long word, with a heap of pairs and links between parts."""
        n, get = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(f[0], k, parts[k], parts[k + 1], f[1]) for k in range(n - 1) if (f := get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, left, right, new = heapq.heappop(heap)
            if parts[k] != left or (m := after[k]) < 0 or parts[m] != right:
                continue
            parts[k], parts[m], after[k] = new, -1, after[m]
            if after[k] >= 0:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] >= 0 and (f := get((parts[x], parts[after[x]]))):
                    heapq.heappush(heap, (f[0], x, parts[x], parts[after[x]], f[1]))
        return [p for p in parts if p >= 0]


#: What \s stands for: Unicode's white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts below this code point are split by a pattern of plain character classes, which the standard library matches faster.
PLAIN = 0x250


class Words(dict):
    """Token ids of words met so far, as bytes; emptied at CACHE words."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = np.array(self.bpe.merge(word.encode()), "<u4").tobytes()
        return out


class Encoder:
    """Encodes and decodes texts within one task."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe, self.cache = bpe, Words(bpe)
        kinds = {k: "".join(chr(c) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        wide = bpe.pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        plain = wide.replace("[^" + SPACE + r"\p{L}\p{N}]", f"[^{SPACE}{kinds['L']}{kinds['N']}]").replace(r"\p{L}", f"[{kinds['L']}]").replace(r"\p{N}", f"[{kinds['N']}]")
        self.beyond = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]").search
        self.wide, self.plain = regex.compile(wide).findall, re.compile(plain).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True))) + ")").split if bpe.special else None
        size = max(bpe.bytes) + 1
        self.table = np.array([bpe.bytes.get(k, b"") for k in range(size)], dtype=object)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        special, word, parts = self.bpe.special, self.cache.__getitem__, []
        findall = self.plain if text.isascii() or not self.beyond(text) else self.wide
        for piece in self.split(text) if self.split and any(s in text for s in special) else (text,):
            parts.append(np.array([special[piece]], "<u4").tobytes() if piece in special else b"".join(map(word, findall(piece))))
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.table[ids].tolist()).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    """The encoder of a broadcast vocabulary; a Python worker keeps it, with its words, for its later tasks."""
    if id(sent.value) not in _encoders:
        _encoders.clear()
        _encoders[id(sent.value)] = Encoder(sent.value)
    return _encoders[id(sent.value)]


def _each(docs: DataFrame, column: str, keys: tuple[str, ...], bpe: ByteBPE, fields: dict[str, tuple[str, pa.DataType]], work) -> DataFrame:
    """``keys`` and ``fields`` of every row; ``work`` makes a field's values of a column."""
    sent = docs.sparkSession.sparkContext.broadcast(bpe)
    slim = docs.select(*keys, F.col(column).alias("__gm_in"))
    schema = ", ".join([*(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys), *(f"`{n}` {kind}" for n, (kind, _) in fields.items())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent)
        for b in pieces(batches):
            made = work(encoder, b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v, t) for v, (_, t) in zip(made, fields.values()))], names=[*keys, *fields])

    return slim.mapInArrow(run, schema)


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, bpe: ByteBPE, text: str = "text", keys: tuple[str, ...] = ("doc_id",), to: str = "ids") -> DataFrame:
    """``keys`` and ``to``: the token ids of each row's whole text, as binary
    (little-endian unsigned 32-bit). Null and empty texts have none; strings of
    special tokens in a text become these tokens. Rows stay as they are,
    repeated ones too; other columns are ignored."""
    work = lambda encoder, column: [[encoder.encode(_text(t)) for t in utf8(column)]]
    return _each(docs.withColumn(text, F.col(text).cast("string")), text, keys, bpe, {to: ("binary", pa.binary())}, work)


def decode(tokens: DataFrame, bpe: ByteBPE, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",), to: str = "text") -> DataFrame:
    """``keys`` and ``to``: the text of each row's token ids, special tokens
    included; bytes that aren't UTF-8 become U+FFFD. Null ids give an empty text."""
    work = lambda encoder, column: [[encoder.decode(np.frombuffer(x or b"", "<u4")) for x in column.to_pylist()]]
    return _each(tokens, ids, keys, bpe, {to: ("string", pa.string())}, work)


def round_trip(docs: DataFrame, bpe: ByteBPE, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ``ids`` and ``decoded``: ``encode`` and ``decode`` in one pass of a task."""

    def work(encoder: Encoder, column: pa.Array) -> list[list]:
        ids = [encoder.encode(_text(t)) for t in utf8(column)]
        return [ids, [encoder.decode(np.frombuffer(x, "<u4")) for x in ids]]

    return _each(docs.withColumn(text, F.col(text).cast("string")), text, keys, bpe, {"ids": ("binary", pa.binary()), "decoded": ("string", pa.string())}, work)


def load(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """The vocabulary at ``path`` (by default the public 50k byte-level file)."""
    import public_tokenizers

    return ByteBPE(path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN)


def digests(docs: DataFrame, bpe: ByteBPE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: n_tokens, and SHA-256 of the ids and of the decoded text."""
    both = round_trip(docs, bpe, text, (id_col,))
    return both.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
