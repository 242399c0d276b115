"""Benchmark decontamination with an FM-index over each shard of the corpus.

Words are the runs of ``[0-9a-z]`` and non-ASCII characters of the lower-cased
text. A test phrase is a window of ``WINDOW`` consecutive item words, or the
whole item if it has fewer. Each task turns its documents into word numbers,
builds an FM-index of them (Burrows-Wheeler transform, wavelet matrix for
ranks, suffix positions at every ``SAMPLE``-th place), searches all phrases
backwards at once and locates each occurrence by steps to a sampled position.
Overlapping occurrences merge into removal spans.

Words that no benchmark item has can't lie in an occurrence, so they end a
piece of the indexed sequence, and pieces shorter than the shortest phrase
aren't indexed: that keeps every occurrence and leaves a small index. A shard
is closed at ``SHARD_WORDS`` indexed words or ``SHARD_BYTES`` of text, which
bounds a task's memory.

The documents aren't shuffled. The benchmark is taken in blocks of about
``BLOCK_WORDS`` words, each sent to the tasks on its own. With several blocks the
rows pass through them in turn and carry what was found so far, so a row is
final in its tasks and nothing is grouped by a key, whatever the sizes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ALNUM, pieces, utf8

WINDOW, SAMPLE = 13, 8
SHARD_WORDS, SHARD_BYTES, BLOCK_WORDS = 1 << 20, 1 << 24, 1 << 20


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


class WaveletMatrix:
    """Ranks of a sequence of small integers, for arrays of queries."""

    def __init__(self, seq: np.ndarray, top: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(max(1, int(top).bit_length()))):
            ones = (seq >> bit) & 1
            before = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(seq) - int(before[-1])))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``end`` of the sequence."""
        begin = np.zeros_like(end)
        for bit, before, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            ones_b, ones_e = before[begin], before[end]
            begin = np.where(one, zeros + ones_b, begin - ones_b)
            end = np.where(one, zeros + ones_e, end - ones_e)
        return end - begin


class FMIndex:
    """Of a sequence of word numbers from 2 on, in which 1 ends a piece."""

    def __init__(self, seq: np.ndarray) -> None:
        seq = np.concatenate([seq, [0]])
        n, rank = len(seq), np.unique(seq, return_inverse=True)[1]
        order, step = np.argsort(rank, kind="stable"), 1
        while rank.max() < n - 1:
            behind = np.full(n, -1, np.int64)
            behind[:-step] = rank[step:]
            key = rank * np.int64(n + 1) + behind + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
            rank, step = new, 2 * step
        top = int(seq.max())
        self.last = seq[order - 1]
        self.tree = WaveletMatrix(self.last, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))]).astype(np.int64)
        self.marked = order % SAMPLE == 0
        self.place = np.cumsum(self.marked) - 1
        self.sampled = order[self.marked]
        self.top, self.n = top, n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of ``phrases``, word by word from the end."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        hi[(phrases > self.top).any(axis=1)] = 0
        for word in phrases.T[::-1]:
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            w = word[live]
            lo[live], hi[live] = self.before[w] + self.tree.rank(w, lo[live]), self.before[w] + self.tree.rank(w, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of suffixes: back to the nearest sampled one."""
        at, steps, out = row.copy(), np.zeros(len(row), np.int64), np.empty(len(row), np.int64)
        todo = np.arange(len(row))
        while len(todo):
            done = self.marked[at[todo]]
            out[todo[done]] = self.sampled[self.place[at[todo[done]]]] + steps[todo[done]]
            todo = todo[~done]
            word = self.last[at[todo]]
            at[todo] = self.before[word] + self.tree.rank(word, at[todo])
            steps[todo] += 1
        return out


class Phrases:
    """The different phrases of a block of items, by length, and whose they are."""

    def __init__(self, items: Iterable[tuple[int, bytes | None]]) -> None:
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 2) for w in words(text)]
            for k in range(max(1, len(ids) - WINDOW + 1)) if ids else ():
                owners[tuple(ids[k : k + WINDOW])].add(item)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for phrase in owners:
            by_length[len(phrase)].append(phrase)
        #: Of each length: the phrases, and their owners one after the other with where each phrase's begin.
        self.groups = []
        for _, p in sorted(by_length.items()):
            every = [sorted(owners[x]) for x in p]
            self.groups.append((np.array(p, np.int32), np.cumsum([0, *map(len, every)]), np.array([x for own in every for x in own], np.int64)))
        self.shortest = min(by_length, default=WINDOW)


class Shard:
    """Rows of one task until their indexed words reach SHARD_WORDS."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.rows, self.size, self.bytes = phrases, [], 0, 0
        self.pieces: list[np.ndarray] = []
        self.origin: list[tuple[int, int]] = []

    def add(self, key: tuple, text: bytes | None) -> None:
        found = words(text)
        ids = np.fromiter(map(self.phrases.number.get, found, repeat(1)), np.int64, len(found))
        edge = np.flatnonzero(np.diff(np.r_[False, ids > 1, False]))
        for start, end in edge.reshape(-1, 2):
            if end - start >= self.phrases.shortest:
                self.origin.append((len(self.rows), int(start)))
                self.pieces.append(np.append(ids[start:end], 1))
                self.size += int(end - start) + 1
        self.rows.append((key, len(found)))
        self.bytes += len(text or b"")

    def results(self) -> Iterator[tuple]:
        """key, n_words, spans and items of every row."""
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[int]] = defaultdict(set)
        if self.pieces:
            index = FMIndex(np.concatenate(self.pieces))
            starts = np.cumsum([0, *map(len, self.pieces)])[:-1]
            for phrase, first, owners in self.phrases.groups:
                lo, hi = index.search(phrase)
                which = np.repeat(np.arange(len(lo)), hi - lo)
                if not len(which):
                    continue
                at = index.locate(np.concatenate([np.arange(a, b) for a, b in zip(lo, hi) if b > a]))
                piece = np.searchsorted(starts, at, side="right") - 1
                for w, p, k in zip(which.tolist(), piece.tolist(), (at - starts[piece]).tolist()):
                    row, offset = self.origin[p]
                    spans[row].append((offset + k, offset + k + phrase.shape[1]))
                    items[row].update(owners[first[w] : first[w + 1]].tolist())
        for row, (key, n) in enumerate(self.rows):
            yield (*key, n, merged(spans.get(row, [])), sorted(items.get(row, ())))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[Phrases]:
    size = F.sum(F.octet_length(F.coalesce(F.col(text), F.lit("")))).alias("n")
    n = -(-(benchmark.agg(size).first()["n"] or 0) // (6 * block_words)) or 1
    slim = benchmark.select(F.col(item).alias("item"), F.col(text).cast("binary").alias("text")).where("item IS NOT NULL")
    for k in range(n):
        yield Phrases((r["item"], r["text"]) for r in slim.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).toLocalIterator())


def occurrences(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``keys``, ``n_words``, ``spans`` (merged half-open word ranges that
    occurrences cover) and ``items`` (sorted ids of items with an occurrence).

    One row per row of ``docs``, also where rows repeat all keys. Null texts have no words; items without
    words or id are ignored; an empty benchmark hits nothing; other columns
    are ignored. Item ids must be integers."""
    row = "n_words long, spans array<struct<start: long, end: long>>, items array<long>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    slim = docs.select(*keys, F.col(text).cast("string").alias("__gm_text"))
    schema = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    blocks = [docs.sparkSession.sparkContext.broadcast(phrases) for phrases in _blocks(benchmark, item, item_text, block_words)]
    n_keys = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def close(shards: list[tuple[tuple, bytes | None]], first: Shard) -> pa.RecordBatch:
            """What all blocks of phrases hit in the rows of a shard: one block is in memory at a time."""
            keyed, n_words, spans, items = [], [], [], []
            for k, sent in enumerate(blocks):
                shard = first
                if k:
                    shard = Shard(sent.value)
                    for key, body in shards:
                        shard.add(key, body)
                columns = list(zip(*shard.results()))
                if k:
                    spans = [merged([*s, *old]) for s, old in zip(columns[-2], spans)]
                    items = [sorted({*i, *old}) for i, old in zip(columns[-1], items)]
                else:
                    keyed, n_words, spans, items = columns[:n_keys], columns[-3], columns[-2], columns[-1]
                if len(blocks) > 1:
                    vars(sent).pop("_value", None)  # read from the executor's copy again when its turn comes
            nested = [[{"start": a, "end": b} for a, b in s] for s in spans]
            arrays = [*(pa.array(c, t) for c, t in zip(keyed, kinds)), pa.array(n_words, pa.int64()), pa.array(nested, span), pa.array(items, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "n_words", "spans", "items"])

        held, shard = [], None
        for b in pieces(batches):
            kinds[:] = [f.type for f in b.schema]
            for *key, body in zip(*(c.to_pylist() for c in b.columns[:n_keys]), utf8(b.column(n_keys))):
                shard = shard or Shard(blocks[0].value)
                shard.add(tuple(key), body)
                if len(blocks) > 1:
                    held.append((tuple(key), body))
                if shard.size >= SHARD_WORDS or shard.bytes >= SHARD_BYTES or len(shard.rows) >= 20_000:
                    yield close(held, shard)
                    held, shard = [], None
        if shard:
            yield close(held, shard)

    return slim.mapInArrow(run, f"{schema}, {row}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """``occurrences`` with ``n_hit`` (words inside a span), ``n_items`` and
    ``contaminated``: a twentieth or more of the words are hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = occurrences(docs, benchmark, **names).withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns:
    these pass through the search as its keys, so nothing is joined, and under
    names of their own, so none clashes. Null, empty and very long texts,
    repeated rows and empty tables: see ``occurrences``."""
    names = {c: f"__gm_{k}" for k, c in enumerate(docs.columns)}
    found = decontaminate(docs.withColumnsRenamed(names), benchmark, text=names[text], keys=tuple(names.values()))
    return found.where("NOT contaminated").select(*(F.col(n).alias(c) for c, n in names.items()))
