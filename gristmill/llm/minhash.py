"""Near-duplicates by circulant MinHash.

A text's set holds its different shingles of ``WORDS`` words, as XXH64. Texts are
linked where their sets' Jaccard similarity is ``LEAST`` hundredths or more, and
links are closed into components.

Circulant MinHash. One permutation of the 64-bit numbers, s, is applied first and
breaks up what structure the hashes have; coordinate k is the least p(s(x) + k)
over the set, where p is a second permutation, circularly shifted by k. So two
permutations make all BANDS * ROWS coordinates. ROWS of them are a
band; texts that agree in a band meet. At similarity 0.8 a pair meets in none
of 32 bands of 4 with a chance of 5 in 10^8.

Verification is exact. What meets is first compared by parity sketches: every
shingle flips one bit, so two sketches differ in at most as many bits as the sets
in shingles, and a pair that differs in more than a link can is out for certain.
What is left is verified on the whole sets.

Large buckets. Equal sets are one node before the search. Up to SMALL nodes all pairs of
a bucket are verified. In a larger one a spanning forest of the pairs that
sketches let through is; a link that it holds may fail, so afterwards
every node outside the bucket's largest verified component is compared with all nodes of
other components, nearest first, in blocks of PART by PART nodes, until nothing
is left that could connect. So no link is lost, a bucket of copies costs a pass over
it, and no task holds more than some blocks of numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import FOLD_CASE, cut, discard, landed, pieces, release, utf8
from gristmill.llm.simhash import components

SEED, WORDS, LEAST = 42, 4, 80
BANDS, ROWS = 32, 4
#: Largest bucket whose pairs are all verified, nodes of a block, and partners of a node that are verified in a first round.
SMALL, PART, PARTNERS = 8, 4096, 64
#: A sketch has 512 bits up to this size of a set, and twice as many each time the size doubles.
SHORT = 256
#: Nodes that are sent to all tasks rather than shuffled with the texts.
FETCHED = 200_000


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD_CASE).split()


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """The sorted different XXH64 of a text's shingles; of fewer words, of all together; empty without words."""
    words = _words(text)
    if not words:
        return np.empty(0, np.uint64)
    grams = zip(*(words[i:] for i in range(size))) if len(words) > size else iter([words])
    hashes, found = map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), [np.empty(0, np.uint64)]
    while len(h := np.fromiter(islice(hashes, 1 << 16), np.uint64)):
        found.append(np.unique(h))
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[1]


def _permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 64-bit numbers: odd factors and shifted xors can be undone."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(a)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(b)
    return x ^ (x >> np.uint64(32))


_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint64)


def signature(members: np.ndarray, shifts: np.ndarray = _SHIFTS) -> np.ndarray:
    """The coordinates of a set, one for each shift: BANDS * ROWS unless told otherwise."""
    first, least = _permuted(members, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93), np.full(len(shifts), (1 << 64) - 1, np.uint64)
    for at in range(0, len(first), 1024):
        least = np.minimum(least, _permuted(first[at : at + 1024, None] + shifts, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53).min(axis=0))
    return least


def _bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band of each signature."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = _permuted(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k], 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
    return key.view(np.int64)


def _level(size: int) -> int:
    return ((size - 1) // SHORT).bit_length()


def sketch(members: np.ndarray) -> bytes:
    """Parities: bit h mod the number of bits flips for every member h."""
    bits = 2 * SHORT << _level(len(members))
    return np.packbits(np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, of; the set's digest (null without a word), size, sketch and band keys."""
    for b in pieces(batches):
        sets = [shingles(t) for t in utf8(b.column(2))]
        some = [s for s in sets if len(s)]
        bands = iter(_bands(np.stack([signature(s) for s in some])).tolist() if some else [])
        made = [(xxhash.xxh3_128_digest(s.tobytes()), len(s), sketch(s), next(bands)) if len(s) else (None, 0, None, None) for s in sets]
        digest, size, bits, keys = zip(*made) if made else ([],) * 4
        arrays = [pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *arrays], names=["id", "of", "digest", "size", "sketch", "keys"])


def _folded(bits: int, level: int) -> int:
    """A sketch as it would be with half its bits."""
    half = SHORT << level
    return bits >> half ^ bits & ((1 << half) - 1)


def _may_link(n: int, x: int, m: int, y: int) -> bool:
    """False only for sets of n and m members, with sketches x and y, that can't be
    linked: a link differs in at most (100 - LEAST) / (100 + LEAST) of n + m members."""
    if 100 * min(n, m) < LEAST * max(n, m):
        return False
    i, j = _level(n), _level(m)
    x, y = _folded(x, i) if i > j else x, _folded(y, j) if j > i else y
    return (x ^ y).bit_count() * (100 + LEAST) <= (n + m) * (100 - LEAST)


class Nodes:
    """Sets of a bucket by size level, with their sketches as rows of words."""

    def __init__(self, size: np.ndarray, sketches: list[bytes]) -> None:
        level = np.array([_level(int(n)) for n in size])
        self.size, self.level, self.levels = size, level, {}
        for k in sorted({*level.tolist()}):
            at = np.flatnonzero(level == k)
            words = np.frombuffer(b"".join(sketches[i] for i in at), "<u8").reshape(len(at), -1)
            self.levels[k] = (at, size[at], words)

    @staticmethod
    def _half(words: np.ndarray) -> np.ndarray:
        k = words.shape[-1] // 2
        return words[..., :k] ^ words[..., k:]

    def near(self, n: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that may be linked to a set of ``n`` members with these sketch words, and in how many bits they differ."""
        own, found, apart = _level(n), [], []
        for k in (own - 1, own, own + 1):
            if k in self.levels:
                at, size, words = self.levels[k]
                fits = (100 * np.minimum(size, n) >= LEAST * np.maximum(size, n)).nonzero()[0]
                if len(fits):
                    there, here = words[fits], self._half(bits) if k < own else bits
                    differ = np.bitwise_count((self._half(there) if k > own else there) ^ here).sum(axis=1, dtype=np.int64)
                    may = differ * (100 + LEAST) <= (size[fits] + n) * (100 - LEAST)
                    found.append(at[fits[may]])
                    apart.append(differ[may])
        return (np.concatenate(found), np.concatenate(apart)) if found else (np.empty(0, np.int64),) * 2

    def bits(self, i: int) -> np.ndarray:
        at, _, words = self.levels[self.level[i]]
        return words[np.searchsorted(at, i)]

    def without(self, gone: np.ndarray) -> None:
        for k in {*self.level[gone].tolist()}:
            at, size, words = self.levels[k]
            keep = ~np.isin(at, gone)
            self.levels[k] = (at[keep], size[keep], words[keep])


def forest(size: np.ndarray, sketches: list[bytes]) -> list[tuple[int, int]]:
    """Places of pairs that connect the nodes as all pairs that may be linked would; a hub's come first."""
    left, every, out = Nodes(size, sketches), Nodes(size, sketches), []
    seen = np.zeros(len(size), bool)
    for start in range(len(size)):
        if seen[start]:
            continue
        seen[start] = True
        left.without(np.array([start]))
        stack = [start]
        while stack and not seen.all():
            i = stack.pop()
            met, _ = left.near(int(size[i]), every.bits(i))
            if len(met):
                seen[met] = True
                left.without(met)
                out.extend((i, int(m)) for m in met)
                stack.extend(met.tolist())
    return out


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal first column, which come together, as one table each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.asarray(b.column(0))
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        if held and key[0] != held[0].column(0)[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        for s, e in zip(edges, edges[1:]):
            if s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _pair_batch(pairs: Iterable[tuple[int, int]], **more: list) -> pa.RecordBatch:
    both = np.array(sorted({(min(p), max(p)) for p in pairs}), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def _first_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of (run, node, size, sketch) that may be linked: all of a small run, a forest of a larger one."""
    pairs: set[tuple[int, int]] = set()
    for run in _runs(batches):
        node, size, bits = run.column(1).to_pylist(), run.column(2).to_pylist(), run.column(3).to_pylist()
        if len(node) <= SMALL:
            numbers = [int.from_bytes(x, "little") for x in bits]
            pairs.update((node[i], node[j]) for i, j in combinations(range(len(node)), 2) if node[i] != node[j] and _may_link(size[i], numbers[i], size[j], numbers[j]))
        else:
            order = sorted(range(len(node)), key=node.__getitem__)
            order = [i for k, i in enumerate(order) if not k or node[i] != node[order[k - 1]]]
            found = forest(np.array([size[i] for i in order]), [bits[i] for i in order])
            pairs.update((node[order[i]], node[order[j]]) for i, j in found)
        if len(pairs) >= 1 << 16:
            yield _pair_batch(pairs)
            pairs = set()
    yield _pair_batch(pairs)


def _more_pairs(first: int, last: int):
    """Pairs across components in blocks of (run, asks, node, size, sketch, root): of
    every asking node its partners by nearness from place ``first`` up to ``last``, and
    whether there are others."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            asks, node, size, root = (np.asarray(run.column(k).combine_chunks()) for k in (1, 2, 3, 5))
            bits = run.column(4).to_pylist()
            here, there = np.flatnonzero(asks), np.flatnonzero(~asks.astype(bool))
            those, askers = Nodes(size[there], [bits[i] for i in there]), []
            for i in here:
                met, apart = those.near(int(size[i]), np.frombuffer(bits[i], "<u8"))
                met = there[met[np.lexsort((node[there[met]], apart))]]
                other = root[met] != root[i]
                pairs = [(int(node[i]), int(node[m])) for m in met[first:last][other[first:last]]]
                askers.extend((*p, bool(other[last:].any())) for p in pairs)
                if not pairs and other[last:].any():
                    askers.append((None, None, True))
            if askers:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*askers), (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "more"])

    return work


def _sets(words: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingles(t, words).view(np.int64) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "members"])

    return work


def _verified(pairs: DataFrame, distinct: DataFrame, keyed: DataFrame, words: int) -> DataFrame:
    """The (a, b) whose whole sets are alike enough. Only texts of nodes that met are read into sets."""
    met = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct.select("node", F.col("rep.id").alias("_id"), F.col("rep.of").alias("_of")), "node"))
    texts = keyed.join(F.broadcast(met) if met.count() <= FETCHED else met, F.expr("of = _of AND id <=> _id")).select("node", "text")
    sets = landed(texts.mapInArrow(_sets(words), "node long, members array<long>").dropDuplicates(["node"]), "sets")
    release(pairs.sparkSession)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = cut(both.where(100 * shared >= LEAST * (F.size("x") + F.size("y") - shared)).select("a", "b"))
    # Whole sets are about as large as their texts, so they don't stay until the application ends.
    discard(sets)
    release(pairs.sparkSession)
    return links


def _dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with their run as first column, a run being together in a task."""
    rows = rows.withColumn("run", F.xxhash64(*key)).drop(*key)
    return rows.select("run", *[c for c in rows.columns if c != "run"]).repartition("run").sortWithinPartitions("run")


def linked_roots(distinct: DataFrame, keyed: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, root): the class of every node of ``distinct`` that has a link, the root itself apart.
    ``distinct`` has a row a set: its ``node``, ``size``, ``sketch``, the ``keys`` of its buckets and
    the (id, of) of a text in ``rep``, whose shingles of ``words`` words it holds; ``keyed`` has the texts.
    Every link of two sets that share a key is found."""
    spark = distinct.sparkSession
    banded = distinct.select(F.explode("keys").alias("key"), "node")
    # Buckets of the same nodes, as their hashes' two sums tell, bring the same pairs: one stands for all.
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"same{k}") for k in range(2)]
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"), *same).where("n > 1")
    shared = landed(buckets.groupBy("n", "hub", "same0", "same1").agg(F.min("key").alias("key")).select("key", "n", "hub"), "buckets")
    members = landed(banded.join(shared, "key"), "members")
    sketches = distinct.select("node", "size", "sketch")
    release(spark)
    # A bucket of over PART nodes is dealt to several tasks; its least node stands in each and connects them.
    parts = F.ceil(F.col("n") / PART).cast("int")
    split = members.withColumn("part", F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))))
    runs = _dealt(split.select("key", F.explode("part").alias("part"), "node").join(sketches, "node"), ["key", "part"])
    pairs = cut(runs.mapInArrow(_first_pairs, "a long, b long").distinct())
    roots = cut(components(_verified(pairs, distinct, keyed, words)).select("node", "root"))
    discard(shared)
    release(spark)
    # A node's large buckets, at most as many as it has keys, stand in one row: each round joins nodes, not memberships.
    packed = lambda rows: landed(rows.groupBy("node").agg(F.collect_list(F.struct("key", "n")).alias("within")), "large")
    large = packed(members.where(F.col("n") > SMALL))
    discard(members)
    first, last = 0, PARTNERS
    while True:
        rooted = large.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(F.inline("within"), "node", F.coalesce("root", "node").alias("root"))
        rooted = cut(rooted)
        by_root = rooted.groupBy("key", "root").agg(F.count("*").alias("many"))
        open_keys = cut(by_root.groupBy("key").agg(F.max(F.struct("many", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main"))
        if open_keys.isEmpty():
            break
        open_rows = cut(rooted.join(open_keys, "key").join(sketches, "node"))
        blocks = F.ceil(F.col("n") / PART).cast("int")
        ask_blocks = F.ceil((F.col("n") - F.col("main.many")) / PART).cast("int")
        own = lambda b: F.pmod(F.xxhash64("node"), b).cast("int")
        asking = open_rows.where("root <> main.root").select("key", F.lit(True).alias("asks"), "node", "size", "sketch", "root", own(ask_blocks).alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
        asked = open_rows.select("key", F.lit(False).alias("asks"), "node", "size", "sketch", "root", own(blocks).alias("j"), F.explode(F.sequence(F.lit(0), ask_blocks - 1)).alias("i"))
        found = cut(_dealt(asking.unionByName(asked), ["key", "i", "j"]).mapInArrow(_more_pairs(first, last), "a long, b long, more boolean"))
        more = not found.where("more").isEmpty()
        fresh = cut(found.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if not fresh.isEmpty():
            roots = _joined(roots, _verified(fresh, distinct, keyed, words))
        if not more:
            break
        first, last = last, last * 64
        # A bucket within one class stays so, and isn't looked at again.
        done, large = large, packed(open_rows)
        discard(done)
        release(spark)
    discard(large)
    return roots


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more links: these connect classes, so only their roots are gone through again."""
    own = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    for end in ("a", "b"):
        links = links.join(own, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_r", end)).drop("_n", "_r")
    links = cut(links.where("a <> b").distinct())
    if links.isEmpty():
        return roots
    moved = cut(components(links).select(F.col("node").alias("_n"), F.col("root").alias("_r")))
    old = roots.join(moved, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return cut(old.unionAll(moved))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles`` (size of its set) and
    ``component_id`` (least id reachable over links, the row's own included).

    Null, empty and word-free texts have no set and are linked with nothing. Rows without an
    id take part; they name a component (as null) only if all its rows lack one.
    Repeated rows each keep their row. Texts are read whole at any length. An empty table gives
    an empty one; other columns are ignored."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("of"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    prints = cut(keyed.mapInArrow(_prints, f"id {kind}, of long, digest binary, size long, sketch binary, keys array<long>"))
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "of")).alias("rep")
    distinct = prints.where("digest IS NOT NULL").groupBy("digest").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), rep)
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    roots = linked_roots(distinct, keyed).withColumnRenamed("node", "_node")
    rooted = distinct.join(roots, F.col("node") == F.col("_node"), "left").select("digest", F.col("rep.id").alias("id"), F.coalesce("root", "node").alias("root"))
    least = cut(rooted.groupBy("root").agg(F.min("id").alias("component_id")))
    named = cut(rooted.join(least, "root").select(F.col("digest").alias("_digest"), "component_id"))
    release(docs.sparkSession)
    both = prints.select("id", "digest", "size").join(named, F.col("digest") == F.col("_digest"), "left")
    return both.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
