"""SimHash near-duplicates, searched by anchor-point covering.

A fingerprint has 64 bits: bit b is set where over half of the text's word
shingles have bit b set in their XXH64. Fingerprints at Hamming distance
``THRESHOLD`` (3) or less are linked, and links are closed into components.

Search. 62 of the 64 bits are taken as two halves of 31 bits. Of a linked pair,
one half differs in at most one bit (3 = 1 + 2). The anchors of a half are the
2^26 words of the Hamming code of length 31, a perfect code: its covering
radius is 1. A half lies within 1 of an anchor, so its partner's half, one bit
away, lies within 1 + 1 = 2 of the same anchor: replicated to every anchor
within covering radius plus threshold, both meet there. That is 16 anchors a
half (1 if the half is itself an anchor), 32 rows a fingerprint, whatever the
data; all 64 bits are then compared per anchor, so no link is lost and none
is made up.

Scale. Exact copies collapse to one fingerprint before the search, so a text
that a third of the rows share is one row here. An anchor with many different
fingerprints is divided again by four pieces of the bits the anchor leaves
open: a linked pair agrees on one of them. Inside an anchor a spanning forest
stands for all pairs. Components come from alternating minimum stars.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import FOLD_CASE, cut, pieces, release, utf8

SEED, SHINGLE, THRESHOLD = 42, 3, 3
HALF = (1 << 31) - 1
#: Anchors are counted in so many cells at least and at most (one for 256 fingerprints between); cells above HOT rows are divided again.
CELLS, MOST_CELLS, HOT = 1 << 14, 1 << 20, 20_000
#: Nodes with over HUB edges (more where there are over HUB * HUBS edges) are broadcast: twice HUBS at most.
HUB, HUBS = 100, 100_000
#: Groups up to this size compare by shifted arrays, larger ones by a search that leaves a spanning forest.
SMALL = 8


def simhash(text: bytes | None) -> int:
    """The fingerprint of a text as an unsigned integer. Without a word (also
    for a null text) it is 0."""
    words = (text or b"").translate(FOLD_CASE).split()
    return majority(_chunks(words, SHINGLE)) if words else 0


def _hashes(words: list[bytes], size: int, seed: int = SEED) -> Iterator[int]:
    """XXH64 of the shingles of ``size`` words; of fewer words, of all together."""
    grams = zip(*(words[i:] for i in range(size))) if len(words) > size else iter([words])
    return map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(seed))


def _chunks(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    hashes = _hashes(words, size)
    while len(h := np.fromiter(islice(hashes, 1 << 14), np.uint64)):
        yield h


def majority(chunks: Iterable[np.ndarray]) -> int:
    """64 bits, each set where over half of the 64-bit hashes have it set."""
    n, counts = 0, np.zeros(64, np.int64)
    for h in chunks:
        n += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``fp``, the fingerprint as a signed 64-bit integer, of every
    row; one pass without a shuffle."""
    slim = docs.select(*keys, F.col(text).cast("string").alias("__gm_text"))
    schema = slim.drop("__gm_text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp = np.fromiter(map(simhash, utf8(b.column(b.num_columns - 1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    return slim.mapInArrow(run, schema)


def _syndromes() -> np.ndarray:
    """[k, byte]: xor of the places (1 to 31) of the bits that are set in byte k of a half."""
    place = np.arange(1, 33, dtype=np.uint32)
    place[31] = 0
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
    return np.stack([np.bitwise_xor.reduce(np.where(bits, place[8 * k : 8 * k + 8], 0), axis=1) for k in range(4)])


#: The bit of each place from 1 on; place 0 stands for no bit.
_BIT = np.concatenate([[0], 1 << np.arange(31)]).astype(np.uint32)


def _syndrome(half: np.ndarray) -> np.ndarray:
    table, s = _syndromes(), np.zeros(len(half), np.uint32)
    for k in range(4):
        s ^= table[k][(half >> np.uint32(8 * k)) & np.uint32(255)].astype(np.uint32)
    return s


def nearest_anchor(half: np.ndarray) -> np.ndarray:
    """Of each 31-bit half, the one word of the Hamming code within distance 1."""
    return half ^ _BIT[_syndrome(half)]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each 31-bit half, every word of the Hamming code within distance 2:
    (row of the half, anchor). With syndrome s, flipping places i and i^s gives
    a code word (place 0 stands for no flip)."""
    s, i = _syndrome(half), np.arange(32, dtype=np.uint32)[None, :]
    j = i ^ s[:, None]
    row, col = np.nonzero((i < j) | ((s[:, None] == 0) & (i == 0)))
    return row, half[row] ^ _BIT[col] ^ _BIT[j[row, col]]


def _replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        all_fp = np.asarray(b.column(0)).view(np.uint64)
        for at in range(0, len(all_fp), 8192):
            fp = all_fp[at : at + 8192]
            for side in range(2):
                row, anchor = anchors(((fp >> np.uint64(31 * side)) & np.uint64(HALF)).astype(np.uint32))
                key = (anchor.astype(np.int64) << 1) | side
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], names=["anchor", "fp"])


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among different fingerprints; the first one of a cluster is its hub."""
    a, b, left = [], [], fp
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(left ^ x) <= THRESHOLD
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                stack.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal keys in (key, fp); rows come sorted by key.
    A run that reaches over batches is carried on as numbers, 16 bytes a row."""

    def out(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (zip(*pairs) if pairs else ([], [])))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, k].copy()) for k in (0, 1)], names=["a", "b"])

    def compare(key: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        pairs, small = [], np.repeat(size <= SMALL, size)
        for step in range(1, SMALL):
            same = (key[step:] == key[:-step]) & small[step:]
            one, other = fp[:-step][same], fp[step:][same]
            near = (np.bitwise_count(one ^ other) <= THRESHOLD) & (one != other)
            pairs.append((one[near], other[near]))
        for s, n in zip(start[size > SMALL], size[size > SMALL]):
            pairs.append(forest(np.unique(fp[s : s + n])))
        return pairs

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        columns = tuple(np.asarray(c) for c in b.columns)
        if not len(columns[0]):
            continue
        if held and columns[0][-1] == held[0][0][0]:
            held.append(columns)
            continue
        key, fp = (np.concatenate(x) for x in zip(*held, columns))
        last = np.searchsorted(key, key[-1])
        held = [(key[last:].copy(), fp[last:].copy())]
        if last:
            yield out(compare(key[:last], fp[:last].view(np.uint64)))
    if held:
        key, fp = (np.concatenate(x) for x in zip(*held))
        yield out(compare(key, fp.view(np.uint64)))


def _hot(spread: DataFrame, rows: int) -> DataFrame:
    """``spread`` with ``is_hot``, true where an anchor's cell has over HOT rows; there are at most MOST_CELLS cells, whatever the input."""
    cells = min(max(CELLS, rows // 256), MOST_CELLS)
    cell = F.pmod(F.xxhash64("anchor"), F.lit(cells))
    hot = spread.groupBy(cell.alias("cell")).count().where(F.col("count") > HOT).select("cell", F.lit(True).alias("is_hot"))
    return spread.withColumn("cell", cell).join(F.broadcast(hot), "cell", "left").drop("cell")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect the ``fp`` of ``distinct`` as all links would."""
    marked = _hot(distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long"), distinct.count())
    other = F.when(F.col("anchor") % 2 == 0, F.shiftrightunsigned("fp", 31)).otherwise(F.col("fp").bitwiseAND(F.lit(HALF)))
    piece = F.explode(F.array(*(F.xxhash64("anchor", F.lit(k), F.shiftrightunsigned("other", 8 * k).bitwiseAND(F.lit(255 if k < 3 else 511))) for k in range(4))))
    keyed = marked.where(F.col("is_hot").isNull()).select(F.xxhash64("anchor").alias("key"), "fp").unionAll(
        marked.where("is_hot").withColumn("other", other).select(piece.alias("key"), "fp")
    )
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def _stars(now: DataFrame, many: int) -> DataFrame:
    """The edges (u, v) after a large and a small star; nodes with over ``many`` edges are broadcast."""
    both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = low.where(F.col("n") > many).select("u", F.col("m").alias("h"))
    up = both.where("v > u").join(F.broadcast(hubs), "u", "left")
    met = up.where("h IS NULL").join(low.where(F.col("n") <= many), "u").select("v", "m").unionAll(up.where("h IS NOT NULL").select("v", "h"))
    large = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return cut(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the least
    node that it reaches. Alternates large and small stars until the edges no
    longer change; the work of a round is a shuffle of the edges, and the
    number of rounds grows with the logarithm of a component's diameter. A round's
    shuffle files go once its edges are written: small as the edges may be, they are some for each pair of
    partitions. Nodes with very many edges, at most 2 * HUBS, are broadcast, so that no task holds a hub's edges."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark, many = None, max(HUB, now.count() // HUBS)
    while True:
        now = _stars(now, many)
        release(now.sparkSession)
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, many = seen, max(HUB, seen[0] // HUBS)


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col`` (and ``keys``), ``fp`` (signed 64-bit
    fingerprint), ``component_id`` (least id reachable over links, the row's
    own included) and ``group_rows`` (rows in the component).

    Null and word-free texts have fingerprint 0 and are linked like any other.
    Rows without an id take part; they name a component only (as null) if all
    its rows lack an id. Repeated rows each keep their row. An empty input
    gives an empty result; other columns of ``docs`` are ignored."""
    prints = cut(fingerprints(docs, text, (id_col, *[k for k in keys if k != id_col])))
    distinct = cut(prints.groupBy("fp").agg(F.min(id_col).alias("_least"), F.count("*").alias("_rows")))
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("_root"), "_least", "_rows")
    # Computed once and apart: a join whose sides both come straight from a shuffle can be split where a component is large.
    named = cut(rooted.groupBy("_root").agg(F.min("_least").alias("component_id"), F.sum("_rows").alias("group_rows")))
    classes = rooted.select("fp", "_root").join(named, "_root").drop("_root")
    # A fingerprint that very many rows share makes this join skewed; adaptive execution splits its partition.
    return prints.join(classes, "fp").select(id_col, *[k for k in keys if k != id_col], "fp", "component_id", "group_rows")
