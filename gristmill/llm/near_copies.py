"""Near copies by SimHash and anchor-point covering, for cleaning a corpus.

Texts whose sets of different five-word shingles have a Jaccard similarity of
0.8 or more are linked, and links are closed into classes.

Three of 64 bits, which is what ``simhash.near_duplicates`` allows, would miss most of
these: at 0.8 a bit of a SimHash over all shingles differs with a chance of 0.14, so 31
of them differ in at most one with a chance of 0.05, however the texts came to
differ. A SimHash over few shingles that both texts share is equal, though. So a text has

* two blocks of 31 bits over all its shingles, each replicated to the anchors within
  covering radius 1 plus threshold 1, as in ``simhash``; an anchor is divided by
  the least shingle under one order, which near copies mostly share, so that an anchor
  stays small in corpora of any size;
* ``BLOCKS`` fingerprints of two blocks of 31 bits over ``DRAWN`` shingles each, with
  threshold 0, so each has one anchor. The shingles are drawn min-wise: the least under
  DRAWN orders. Two texts draw the same with a chance of their similarity to the power
  of DRAWN, whatever and wherever they differ, edits as well as passages.

At similarity 0.8 a pair meets at none of 24 anchors of 3 drawn shingles with a chance of
(1 - 0.8^3)^24, 3 in 10^8.

What meets is compared by ``minhash.linked_roots``: parity sketches that never part a
link, whole sets, and rounds within large anchors until nothing is left that could
connect. So no link of texts that meet is lost, and none is made up.

``one_of_each`` can close the classes over SimHash's own links as well: ``op1``'s fingerprints,
three-word shingles with repeats, its search by anchors of the whole halves, and all 64 bits
compared, linked at ``simhash.THRESHOLD`` or less. Texts whose weight lies in the
same passages meet there, though their sets differ by more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import cut, pieces, release, utf8
from gristmill.llm.minhash import linked_roots, shingles, signature, sketch
from gristmill.llm.simhash import HALF, anchors, components, links, majority, nearest_anchor, simhash

#: Words of a shingle, fingerprints over drawn shingles, and shingles of each.
WORDS, BLOCKS, DRAWN = 5, 24, 3
_ORDERS = np.arange(BLOCKS * DRAWN, dtype=np.uint64)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit number of several."""
    x = np.uint64(0)
    for p in parts:
        x = (x ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(32))
    return x


def _halves(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(31 * side)) & np.uint64(HALF)).astype(np.uint32) for side in range(2)]


def anchor_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The keys of the anchors of each set (none of them empty): 2 to 32 of all shingles, BLOCKS of drawn ones."""
    least = np.stack([signature(s, _ORDERS) for s in sets])
    a, b, c = (least.reshape(len(sets), BLOCKS, DRAWN)[:, :, k] for k in range(DRAWN))
    drawn = _halves((a & b) | (b & c) | (a & c))
    near = [nearest_anchor(h.ravel()).reshape(h.shape) for h in drawn]
    number = np.broadcast_to(np.arange(2, BLOCKS + 2), drawn[0].shape)
    row, key = [np.repeat(np.arange(len(sets)), BLOCKS)], [_mixed(number, *near).ravel()]
    for side, half in enumerate(_halves(np.array([majority(s[at : at + (1 << 14)] for at in range(0, len(s), 1 << 14)) for s in sets], np.uint64))):
        of, anchor = anchors(half)
        row.append(of)
        key.append(_mixed(np.full(len(of), side), anchor, least[of, side]))
    row, key = np.concatenate(row), np.concatenate(key).view(np.int64)
    order = np.argsort(row, kind="stable")
    return np.split(key[order], np.cumsum(np.bincount(row, minlength=len(sets)))[:-1])


def _prints(batches: Iterable[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """id, of; the set's name, size, sketch and keys (none without a word); with ``whole``, the text's fingerprint."""
    for b in pieces(batches):
        texts = utf8(b.column(2))
        sets = [shingles(t, WORDS) for t in texts]
        some = [s for s in sets if len(s)]
        keys = iter(anchor_keys(some) if some else [])
        made = [(xxhash.xxh3_128_digest(s.tobytes()), len(s), *((sketch(s), next(keys)) if len(s) else (None, None))) for s in sets]
        name, size, bits, key = zip(*made) if made else ([],) * 4
        arrays = [pa.array(name, pa.binary()), pa.array(size, pa.int64()), pa.array(bits, pa.binary()), pa.array(key, pa.list_(pa.int64()))]
        fp = pa.array(np.fromiter(map(simhash, texts), np.uint64, len(texts)).view(np.int64)) if whole else pa.nulls(len(texts), pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *arrays, fp], names=["id", "of", "name", "size", "sketch", "keys", "fp"])


def _joined_by_fingerprints(prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """``rooted`` (name, rep, root) with one root for all classes that links of fingerprints connect."""
    # A set has a fingerprint for each order and number of its shingles.
    held = cut(prints.select("name", "fp").distinct())
    every = cut(held.select("fp").distinct())
    found = components(links(every))
    classes = held.join(found, held["fp"] == found["node"], "left").select("name", F.coalesce("root", "fp").alias("print"))
    met = cut(classes.join(rooted.select("name", "root"), "name").select("print", "root").distinct())
    # The classes that one class of fingerprints meets are joined to the least of them.
    least = cut(met.groupBy("print").agg(F.min("root").alias("hub"), F.count("*").alias("n")).where("n > 1").select("print", "hub"))
    joined = components(met.join(least, "print").select(F.col("root").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("root", "_root")
    release(prints.sparkSession)
    return rooted.join(joined, F.col("root") == F.col("node"), "left").select("name", "rep", F.coalesce("_root", "root").alias("root"))


def _classes(docs: DataFrame, text: str, id_col: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, of, name) of every row: its id, its text's XXH64 and its set's name; and
    (name, rep, root) of every different set: its first row (none, id, of), and the least node of its class."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("of"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    prints = cut(keyed.mapInArrow(partial(_prints, whole=whole), f"id {kind}, of long, name binary, size long, sketch binary, keys array<long>, fp long"))
    # Equal sets are one node. Its number is written, so it stays the same.
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "of")).alias("rep")
    distinct = prints.groupBy("name").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), rep)
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    roots = linked_roots(distinct, keyed, WORDS).withColumnRenamed("node", "_node")
    release(docs.sparkSession)
    rooted = distinct.join(roots, F.col("node") == F.col("_node"), "left").select("name", "rep", F.coalesce("root", "node").alias("root"))
    if whole:
        rooted = _joined_by_fingerprints(prints, cut(rooted))
    return prints.select("id", "of", "name"), rooted


def near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``class_id`` of every row: the least id in its class of near
    copies, the row's own included; see ``one_of_each`` for what is linked. A
    class in which no row has an id has none."""
    prints, names = _classes(docs, text, id_col)
    least = cut(names.groupBy("root").agg(F.min("rep").alias("rep")).select("root", F.col("rep.id").alias("class_id")))
    named = cut(names.select("name", "root").join(least, "root").select("name", "class_id"))
    return prints.join(named, "name").select(F.col("id").alias(id_col), "class_id")


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", fingerprints: bool = False) -> DataFrame:
    """``docs`` with one row left of each class of near copies: that with the
    least id (a row without an id only if none of them has one; of rows that
    repeat the id, one). Links hold between texts whose sets of lower-cased
    shingles are alike to 0.8, with ``fingerprints`` also between those at
    ``simhash.THRESHOLD`` bits or less; a text of fewer words than a shingle is one shingle. Null and word-free texts are copies of each other. Very long texts
    are compared whole; an empty table gives an empty one; other columns stay
    as they are."""
    best = _classes(docs, text, id_col, fingerprints)[1].groupBy("root").agg(F.min("rep").alias("b")).select(F.col("b.id").alias("__gm_id"), F.col("b.of").alias("__gm_of"))
    keyed = docs.withColumn("__gm_k", F.xxhash64(F.col(text).cast("string")))
    kept = keyed.join(best, (F.col("__gm_k") == F.col("__gm_of")) & F.col(id_col).eqNullSafe(F.col("__gm_id")))
    first = F.row_number().over(Window.partitionBy("__gm_k", "__gm_id").orderBy("__gm_k"))
    return kept.withColumn("__gm_n", first).where("__gm_n = 1").select(*docs.columns)
