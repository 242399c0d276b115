"""Alignment of two tokenizers' tokens over the same bytes.

A text is encoded by a byte-level vocabulary A (as space + text) and a piece
vocabulary B (which adds the space). Both cut the same bytes, so their tokens
are two sorted lists of byte offsets, and aligning them is a merge.

Lockstep merging. All documents of a batch are merged at once: one NumPy state
vector holds each one's pointers into A and B. A step emits for every document
the link of the two tokens under its pointers (they overlap), notes a cut where
both end, and advances whichever ends first, or both. Documents that are done are
compacted out of the vector. A long document enters as several lanes, divided
at places where both tokens end, so that a batch takes as many steps as a lane
has tokens, not as many as its longest text.

Corpus-wide counts. ``statistics`` writes each document's different linked id
pairs once, as sorted integers; their document counts are added in the tasks
first, then by a shuffle of (pair, count). Pairs that are counted often, at most
HEAD, are broadcast as two arrays with each A id's highest count (bounded by the
vocabulary). What the other pairs add goes through a shuffle by pair, in which a
key has at most as many rows as the bound that made it rare. Which pairs are broadcast
changes costs, not results.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, landed, pieces, utf8

#: Tokens of A in a lane; places tried for a division; bytes of text that are merged together.
LANE, TRIED, BATCH = 512, 64, 1 << 21
#: Most pairs that are broadcast (12 bytes each), and pairs that a task holds before it passes their counts on.
HEAD, HELD = 1 << 21, 1 << 22

SPACE_MARK = "▁"
#: Most segments of text whose tokens a task keeps, and characters of new ones that are encoded together.
KEPT, JOINED = 250_000, 1 << 14


@dataclass(frozen=True)
class Vocabularies:
    """Both public vocabularies as they are sent to the tasks: A's file without
    special tokens, as their strings in a text are plain text; B's file as bytes."""

    a: str
    b: bytes


def load(a: str | None = None, b: str | None = None) -> Vocabularies:
    """The files at ``a`` (byte-level BPE, JSON) and ``b`` (pieces); by default the public ones."""
    import public_tokenizers

    with open(a or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f) | {"added_tokens": [], "truncation": None, "padding": None, "post_processor": None}
    with open(b or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return Vocabularies(json.dumps(spec), f.read())


class ByteLevel:
    """A's encoder, and how many bytes each token has: one for each letter of its entry."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        vocabulary = self.model.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")


class Pieces:
    """B's encoder, and the bytes of its pieces. Where no piece holds a space behind
    another character, no merge crosses a word's first space; where a vocabulary has such pieces, ``whole`` is true."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        shown = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.whole = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in shown)
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(k) else p.replace(SPACE_MARK, " ").encode() for k, p in enumerate(shown)]
        self.size = np.array(list(map(len, self.bytes)), np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids of space + text; none if their bytes are others, so that the length tells."""
        # The model adds the first space itself, but to an empty text.
        ids = self.model.encode(text) if text else [self.model.piece_to_id(SPACE_MARK)]
        return np.array(ids if b"".join([self.bytes[k] for k in ids]) == b" " + text.encode() else [], "<u4")


class Segments(dict):
    """A's and B's ids, as bytes, of segments of text met so far, each without its
    first space. Segments begin at a space behind another character than white space, where
    neither tokenizer has a token across: A's words hold a space only at their beginning
    or within white space, for B see ``Pieces``. So new segments are encoded joined, and
    the ids divided where the segments end."""

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b = a, b
        self.mixed, self.split = re.compile(r"\s |\s$").search, re.compile(r"(?<=\S)(?= )").split

    def parts(self, text: str) -> list[str]:
        if self.b.whole:
            return [text]
        return [x[1:] for x in self.split(" " + text)] if self.mixed(" " + text) else text.split(" ")

    def learn(self, texts: list[list[str]]) -> None:
        """Encodes what is new in ``texts``, lists of segments; forgets all others first if there are too many."""
        new = {s for some in texts for s in some if s not in self}
        if len(self) + len(new) > KEPT:
            self.clear()
            new = {s for some in texts for s in some}
        held, size = [], 0
        for s in new:
            if self.b.whole or not s or s[-1].isspace():  # the next segment's space would stand behind white space
                self._add([s])
                continue
            held.append(s)
            size += len(s) + 1
            if size >= JOINED:
                self._add(held)
                held, size = [], 0
        if held:
            self._add(held)

    def _add(self, some: list[str]) -> None:
        text = " " + " ".join(some)
        a, b = self.a.encode(text), self.b.encode(text[1:])
        if len(some) == 1:
            self[some[0]] = a.tobytes(), b.tobytes()
            return
        ends = np.cumsum(np.fromiter(map(len, some if text.isascii() else [s.encode() for s in some]), np.int64, len(some)) + 1)
        at = []
        for ids, size in ((a, self.a.size), (b, self.b.size)):
            upto = np.cumsum(size[ids])
            place = np.searchsorted(upto, ends)
            if not len(ids) or upto[-1] != ends[-1] or (upto[place] != ends).any():
                # One of them holds what B changes: halves find it.
                self._add(some[: len(some) // 2])
                self._add(some[len(some) // 2 :])
                return
            at.append([0, *((place + 1) * 4).tolist()])
        (p, q), a, b = at, a.tobytes(), b.tobytes()
        self.update((s, (a[i:j], b[k:m])) for s, i, j, k, m in zip(some, p, p[1:], q, q[1:]))


class Tokens:
    """Both encoders, and the bytes of every token, within one task."""

    def __init__(self, vocabularies: Vocabularies) -> None:
        self.a, self.b = ByteLevel(vocabularies.a), Pieces(vocabularies.b)
        self.segments = Segments(self.a, self.b)
        self.size_a, self.size_b = self.a.size, self.b.size
        both = max(len(self.size_a), len(self.size_b))
        #: Ids as text after each separator of the digest.
        self.shown = np.array([[f"{s}{k}".encode() for k in range(both)] for s in ",|;"], object)

    def encode(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and by B of every text; none of a text that is null or empty or whose
        tokens' bytes aren't space + text. Segments are parts of the text in order, and
        their tokens have their bytes, so tokens of the text's length are the whole text."""
        none, out = np.empty(0, np.uint32), []
        shown = [(raw or b"").decode("utf-8", "replace") for raw in texts]
        parts = [self.segments.parts(t) if t else [] for t in shown]
        self.segments.learn(parts)
        for raw, text, some in zip(texts, shown, parts):
            n, found = len(raw or b"") + 1, list(map(self.segments.__getitem__, some))
            a, b = (np.frombuffer(b"".join([f[k] for f in found]), "<u4") for k in (0, 1))
            same = raw and self.size_a[a].sum() == n and self.size_b[b].sum() == n and ("\ufffd" not in text or text.encode() == raw)
            out.append((a, b) if same else (none, none))
        return out


def _offsets(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Where one document's lanes begin, as indices of its A and B tokens: about
    every ``lane`` tokens of A, at the next of TRIED places where a token of B ends, too."""
    starts = [(0, 0)] if len(ends_a) else []
    for k in range(lane, len(ends_a) - 1, lane):
        near = ends_a[k : min(k + TRIED, len(ends_a) - 1)]
        at = np.searchsorted(ends_b, near)
        hit = np.flatnonzero(ends_b[at] == near)
        if len(hit) and k + hit[0] + 1 > starts[-1][0]:
            starts.append((k + hit[0] + 1, at[hit[0]] + 1))
    return np.array([s[0] for s in starts], np.int64), np.array([s[1] for s in starts], np.int64)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges all lanes at once. ``ends_*`` are the tokens' end offsets, lane
    after lane; ``from_*`` is where each lane begins, with the total at the end.
    Gives (A token, B token, is a cut) of every link, in order of lanes and offsets."""
    room = from_a + from_b
    link_a, link_b, cuts = np.empty(room[-1], np.int64), np.empty(room[-1], np.int64), np.zeros(room[-1], bool)
    used = np.zeros(room[-1], bool)
    i, j, out, stop = from_a[:-1].copy(), from_b[:-1].copy(), room[:-1].copy(), from_a[1:]
    live = i < stop
    i, j, out, stop = i[live], j[live], out[live], stop[live]
    while len(i):
        x, y = ends_a[i], ends_b[j]
        link_a[out], link_b[out], cuts[out], used[out] = i, j, x == y, True
        i = i + (x <= y)
        j = j + (y <= x)
        out = out + 1
        live = i < stop
        if not live.all():
            i, j, out, stop = i[live], j[live], out[live], stop[live]
    return link_a[used], link_b[used], cuts[used]


@dataclass
class Merged:
    """The links of a batch. Tokens are numbered through the batch; document d
    owns tokens ``at_a[d]:at_a[d + 1]``, ``at_b`` likewise, and links ``at[d]:at[d + 1]``."""

    a: np.ndarray
    b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    at: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cuts: np.ndarray
    ends: np.ndarray


def merge(tokens: Tokens, coded: list[tuple[np.ndarray, np.ndarray]]) -> Merged:
    """Links and cuts of all documents of a batch."""
    at_a, at_b = _offsets([len(a) for a, _ in coded]), _offsets([len(b) for _, b in coded])
    a, b = (np.concatenate([c[k] for c in coded]).astype(np.int64) for k in (0, 1))
    ends = []
    for ids, size, at in ((a, tokens.size_a, at_a), (b, tokens.size_b, at_b)):
        total = np.concatenate([[0], np.cumsum(size[ids])])
        ends.append(total[1:] - np.repeat(total[at[:-1]], np.diff(at)))
    from_a, from_b = [], []
    for d in range(len(coded)):
        x, y = lanes(ends[0][at_a[d] : at_a[d + 1]], ends[1][at_b[d] : at_b[d + 1]])
        from_a.append(x + at_a[d])
        from_b.append(y + at_b[d])
    from_a, from_b = (np.concatenate([*f, [n]]).astype(np.int64) for f, n in ((from_a, len(a)), (from_b, len(b))))
    link_a, link_b, cuts = lockstep(*ends, from_a, from_b)
    return Merged(a, b, at_a, at_b, np.searchsorted(link_a, at_a), link_a, link_b, cuts, ends[0])


def _digests(tokens: Tokens, m: Merged) -> list[str]:
    """Of each document, the SHA-256 of ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
    end_a, end_b = np.zeros(len(m.a), np.int64), np.zeros(len(m.b), np.int64)
    end_a[m.link_a[m.cuts]], end_b[m.link_b[m.cuts]] = 1, 1
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    upto_a, upto_b = m.link_a[m.cuts] + 1, np.append(0, m.link_b[m.cuts] + 1)
    first_a, first_b = (np.concatenate([[1], e[:-1]]).astype(np.int64)[: len(e)] for e in (end_a, end_b))
    # A token stands behind the B tokens of earlier groups, a B token behind the A tokens of its own, too.
    place_a = np.arange(len(m.a)) + upto_b[group_a]
    place_b = np.arange(len(m.b)) + upto_a[group_b]
    line = np.empty(len(m.a) + len(m.b), object)
    line[place_a], line[place_b] = tokens.shown[2 * first_a, m.a], tokens.shown[first_b, m.b]
    parts, at = line.tolist(), (m.at_a + m.at_b).tolist()
    return [hashlib.sha256(b"".join(parts[s:e])[1:]).hexdigest() if e > s else "" for s, e in zip(at, at[1:])]


_tokens: dict[str, Tokens] = {}


def _run(docs: DataFrame, text: str, keys: tuple[str, ...], vocabularies: Vocabularies, fields: dict[str, tuple[str, pa.DataType]], work) -> DataFrame:
    """``keys`` and ``fields`` of every row; ``work`` makes the fields' values of a merged batch."""
    sent, name = docs.sparkSession.sparkContext.broadcast(vocabularies), uuid.uuid4().hex
    slim = docs.select(*keys, F.col(text).cast("string").alias("__gm_in"))
    schema = ", ".join([*(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys), *(f"`{n}` {kind}" for n, (kind, _) in fields.items())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tokens:  # a Python worker keeps them for its later tasks
            _tokens.clear()
            _tokens[name] = Tokens(sent.value)
        for b in pieces(batches, BATCH):
            if not b.num_rows:
                continue
            made = work(_tokens[name], merge(_tokens[name], _tokens[name].encode(utf8(b.column(b.num_columns - 1)))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(v if isinstance(v, pa.Array) else pa.array(v, t) for v, (_, t) in zip(made, fields.values()))], names=[*keys, *fields])

    return slim.mapInArrow(run, schema)


def _lists(values: np.ndarray, at: np.ndarray, kind) -> pa.Array:
    """One list a document."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, vocabularies: Vocabularies, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``keys``; ``a`` and ``b``, its token ids; ``link_a`` and
    ``link_b``, the positions (from 0) of every overlapping pair of tokens in
    order; and ``cuts``, the byte offsets within space + text where both end.

    Null and empty texts, and texts that B's normalisation changes, have empty
    lists. Texts of any length are aligned whole; repeated rows stay rows; other columns are ignored."""
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def work(tokens: Tokens, m: Merged) -> list[pa.Array]:
        n = np.diff(m.at)
        cut_at = np.concatenate([[0], np.cumsum(m.cuts)])[m.at]
        return [
            _lists(m.a, m.at_a, pa.int32()), _lists(m.b, m.at_b, pa.int32()),
            _lists(m.link_a - np.repeat(m.at_a[:-1], n), m.at, pa.int32()), _lists(m.link_b - np.repeat(m.at_b[:-1], n), m.at, pa.int32()),
            _lists(m.ends[m.link_a[m.cuts]], cut_at, pa.int64()),
        ]

    fields = {"a": ("array<int>", ints), "b": ("array<int>", ints), "link_a": ("array<int>", ints), "link_b": ("array<int>", ints), "cuts": ("array<bigint>", longs)}
    return _run(docs, text, keys, vocabularies, fields, work)


def _pairs(docs: DataFrame, vocabularies: Vocabularies, text: str, keys: tuple[str, ...], wide: int) -> DataFrame:
    """Per row: its sizes, digest, and different linked id pairs (A id * ``wide``
    + B id, sorted) with how often each is linked."""

    def work(tokens: Tokens, m: Merged) -> list:
        n = np.diff(m.at)
        pair = np.sort((np.repeat(np.arange(len(n)), n) << 32) + m.a[m.link_a] * wide + m.b[m.link_b])
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        at = np.searchsorted(first, m.at)
        groups = np.diff(np.concatenate([[0], np.cumsum(m.cuts)])[m.at])
        return [np.diff(m.at_a), np.diff(m.at_b), groups, n, _digests(tokens, m), _lists(pair[first] & 0xFFFFFFFF, at, pa.int64()), _lists(np.diff(np.append(first, len(pair))), at, pa.int32())]

    long = ("bigint", pa.int64())
    fields = {"n_a": long, "n_b": long, "n_groups": long, "n_links": long, "groups_sha256": ("string", pa.string()), "pairs": ("array<bigint>", pa.list_(pa.int64())), "times": ("array<int>", pa.list_(pa.int32()))}
    return _run(docs, text, keys, vocabularies, fields, work)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) added up within a task, passed on where it holds very many."""
    pair, n = np.empty(0, np.int64), np.empty(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    for b in pieces(batches, 1 << 25):
        more, times = np.unique(np.asarray(b.column(0).flatten()), return_counts=True)
        both = np.concatenate([pair, more])
        pair, back = np.unique(both, return_inverse=True)
        n = np.bincount(back, np.concatenate([n, times]), len(pair)).astype(np.int64)
        if len(pair) > HELD:
            yield out()
            pair, n = pair[:0], n[:0]
    yield out()


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n): in how many rows of ``pairs`` each pair stands."""
    return linked.select("pairs").mapInArrow(_counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _columns(df: DataFrame) -> list[np.ndarray]:
    """A bounded number of rows of longs, sorted by the first column."""
    got = df.toArrow()
    found = [np.asarray(c.combine_chunks()) for c in got.columns]
    order = np.argsort(found[0], kind="stable")
    return [c[order] for c in found]


def _least_shared(counts: DataFrame, head: int) -> int:
    """The least count, a power of two, that at most ``head`` pairs reach."""
    rows = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()  # at most 63
    left, least = head, 64
    for k, many in sorted(((r["k"], r["count"]) for r in rows), reverse=True):
        if many > left:
            break
        left, least = left - many, k
    return 1 << least if least < 63 else (1 << 63) - 1


def statistics(docs: DataFrame, vocabularies: Vocabularies, text: str = "text", keys: tuple[str, ...] = ("doc_id",), head: int = HEAD) -> DataFrame:
    """Per row: ``keys``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best`` (links whose pair is in as many rows as any pair of their A id),
    ``count_sum`` (these numbers of rows over all links) and ``groups_sha256``.
    See ``align`` for odd texts: their numbers are 0 and their digest ''. Repeated
    rows count as rows; an empty table gives an empty one."""
    spark: SparkSession = docs.sparkSession
    wide = len(Pieces(vocabularies.b).bytes)
    linked = landed(_pairs(docs, vocabularies, text, keys, wide), "aligned", compression="zstd")
    counts = landed(pair_counts(linked), "pairs")
    least = _least_shared(counts, head)
    top = spark.sparkContext.broadcast((_columns(counts.where(F.col("n") >= least)), _columns(counts.groupBy(F.floor(F.col("pair") / wide).alias("a")).agg(F.max("n").alias("n")))))
    names = [*keys, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    found = {"n_best": pa.int64(), "count_sum": pa.int64(), "rare": pa.list_(pa.int64()), "rare_times": pa.list_(pa.int32())}

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, count), (of, best) = top.value
        highest = np.zeros(int(of[-1]) + 1 if len(of) else 1, np.int64)
        highest[of] = best
        known, count = np.append(known, -1), np.append(count, 0)
        for b in pieces(batches, 1 << 24):
            lists = b.column("pairs")
            pair, times = np.asarray(lists.flatten()), np.asarray(b.column("times").flatten()).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets)))]).astype(np.int64)
            place = np.searchsorted(known[:-1], pair)
            hit = known[place] == pair
            n = np.where(hit, count[place], 0)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[at]) for x in (np.where(hit & (n == highest[pair // wide]), times, 0), n * times)]
            rare_at = np.concatenate([[0], np.cumsum(~hit)])[at]
            made = [*map(pa.array, sums), _lists(pair[~hit], rare_at, pa.int64()), _lists(times[~hit], rare_at, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), *made], names=[*names, *found])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in linked.select(*names).schema), "n_best bigint, count_sum bigint, rare array<bigint>, rare_times array<int>"])
    scored, order = linked.mapInArrow(look_up, schema), [*keys, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least <= 1:
        return scored.select(*order)
    # Pairs that too few rows have to be broadcast: their counts are looked up by a join, then added to the rows'.
    scored = cut(scored.withColumn("__gm_row", F.monotonically_increasing_id()))
    highest = counts.groupBy(F.floor(F.col("pair") / wide).alias("__gm_a")).agg(F.max("n").alias("__gm_top"))
    messages = scored.select("__gm_row", F.explode(F.arrays_zip("rare", "rare_times")).alias("m")).select("__gm_row", F.col("m.rare").alias("pair"), F.col("m.rare_times").alias("times"))
    counted = counts.where(F.col("n") < least).withColumn("__gm_a", F.floor(F.col("pair") / wide)).join(F.broadcast(highest), "__gm_a")
    added = messages.join(counted, "pair").groupBy("__gm_row").agg(F.sum(F.when(F.col("n") == F.col("__gm_top"), F.col("times")).otherwise(0)).alias("__gm_best"), F.sum(F.col("n") * F.col("times")).alias("__gm_sum"))
    both = scored.join(added, "__gm_row", "left")
    total = [(F.col(c) + F.coalesce(more, F.lit(0))).alias(c) for c, more in (("n_best", F.col("__gm_best")), ("count_sum", F.col("__gm_sum")))]
    return both.select(*keys, "n_a", "n_b", "n_groups", "n_links", *total, "groups_sha256")
