"""Language-model scoring by cross-entropy difference.

Two bigram models share one vocabulary, one set of bigrams and one smoothing:
the target model has the counts of target documents, the background model
those of all documents. A document's score is its mean loss per token under
the target model less that under the background model: the lower, the more it
reads like the target.

Nothing is cut: all words and pairs of all documents count. Words and pairs
that are frequent in a sample of the rows are numbered, counted exactly over
all rows and broadcast, which keeps hot keys out of the shuffle; which ones
they are changes costs, not results. Every other (document, pair) is one
message of 20 bytes. Messages are shuffled once, packed as arrays in buckets of
about ``BUCKET`` messages, by their rare word or else by the pair, and meet
there all other messages of that word and pair, so exact counts are known. A
pair of numbered words that occurs once needs no answer: its document has
already taken that count. Of two rare words in a row, the first one's bucket
knows the pair and the context, and a join brings in the second one's count.

The number of buckets grows with the input, so memory in a task doesn't.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ALNUM, held_out, landed, pieces, utf8

#: Most words that are numbered, most pairs of them that are counted apart; these bound what is broadcast, not what counts.
VOCABULARY, BIGRAMS = 1 << 17, 1 << 18
#: Target ids are broadcast up to so many; tokens a task takes together, messages of a bucket, and every how manieth row is in the sample.
MARKS, CHUNK, BUCKET, SAMPLE = 1 << 20, 1 << 18, 1 << 19, 16
#: Weight of the pair's own estimate against the word's; what is added to each word's count.
PAIR_WEIGHT, ADDED = 0.6, 0.5
UNKNOWN, START = 0, 1

#: Kinds of packed rows: a document's own sums; messages of a pair of numbered words, of a rare word before another, of a rare word itself.
OWN, PAIR, BEFORE, WORD = range(4)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


def targets(labels: DataFrame) -> DataFrame:
    """(doc_id) of all labelled documents of good quality that aren't toxic and
    aren't held out."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & ~held_out() & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct()


def commonest(counted: DataFrame, most: int) -> DataFrame:
    """The rows of ``counted`` with the greatest ``n``, at most ``most``; ties at
    the limit stay out together. The limit comes from the counts of counts,
    summed up to ``most`` on the driver."""
    total, limit = 0, None
    for r in counted.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        total += r["count"]
        if total > most:
            break
        limit = r["n"]
    return counted.where(F.col("n") >= limit) if limit is not None else counted.limit(0)


def numbered(text: bytes | None, number: dict[bytes, int]) -> np.ndarray:
    """A start mark and the text's words: their numbers, or of rare words VOCABULARY and 62 bits of their XXH64."""
    found = words(text)
    ids = np.empty(len(found) + 1, np.int64)
    ids[0] = START
    ids[1:] = np.fromiter(map(number.get, found, repeat(UNKNOWN)), np.int64, len(found))
    if len(rare := np.flatnonzero(ids == UNKNOWN)):
        ids[rare] = [VOCABULARY + (xxhash.xxh64_intdigest(found[k - 1]) >> 2) for k in rare.tolist()]
    return ids


@dataclass
class Chunk:
    """Some rows together: of each row its id, number, target mark and tokens;
    of each token its row's place, the word before it and the word."""

    doc: list
    row: np.ndarray
    target: np.ndarray
    tokens: np.ndarray
    owner: np.ndarray
    before: np.ndarray
    now: np.ndarray


def _chunks(batches: Iterable[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[Chunk]:
    """Rows of (doc_id, t, row, text), about CHUNK tokens at a time."""
    held: list[tuple] = []
    size = 0

    def chunk() -> Chunk:
        doc, t, row, ids = zip(*held)
        n = np.array([len(x) - 1 for x in ids], np.int64)
        before, now = np.concatenate([x[:-1] for x in ids]), np.concatenate([x[1:] for x in ids])
        return Chunk(list(doc), np.array(row, np.int64), np.array(t, np.int64), n, np.repeat(np.arange(len(n)), n), before, now)

    for b in pieces(batches):
        for doc, t, row, raw in zip(*(b.column(k).to_pylist() for k in range(3)), utf8(b.column(3))):
            held.append((doc, t, row, numbered(raw, number)))
            size += len(held[-1][3])
            if size >= CHUNK:
                yield chunk()
                held, size = [], 0
    if held:
        yield chunk()


def _places(known: np.ndarray, before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Place of each pair in ``known`` (sorted keys), or -1."""
    out = np.full(len(now), -1)
    if len(known):
        at = np.flatnonzero((before < VOCABULARY) & (now < VOCABULARY))
        want = before[at] * VOCABULARY + now[at]
        place = np.minimum(np.searchsorted(known, want), len(known) - 1)
        hit = known[place] == want
        out[at[hit]] = place[hit]
    return out


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


@dataclass
class Counts:
    """What is broadcast: exact counts [target, all] of numbered words (each as
    itself and before another) and of known pairs, and the words' share."""

    alone: np.ndarray
    context: np.ndarray
    known: np.ndarray
    pair: np.ndarray
    whole: np.ndarray

    def loss(self, m: int, pair: np.ndarray, context: np.ndarray, alone: np.ndarray) -> np.ndarray:
        mixed = PAIR_WEIGHT * pair / np.maximum(context, 1) + (1 - PAIR_WEIGHT) * alone
        return -np.log(np.where(context > 0, mixed, alone))


def _marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, t, row, text): ``t`` is 1 for a target, ``row`` a number of its own."""
    marks = landed(target_ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "targets").withColumn("t", F.lit(1).cast("long"))
    small = marks.count() <= MARKS
    both = docs.select("doc_id", F.col("text").cast("string").alias("__gm_text")).join(F.broadcast(marks) if small else marks, "doc_id", "left")
    rows = both.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("t", F.lit(0).cast("long")).alias("t"), F.monotonically_increasing_id().alias("row"), "__gm_text")
    # Shuffled rows may come in another order when a task runs again, so they are written first.
    return rows if small else landed(rows, "marked")


def _frequent(rows: DataFrame, vocabulary: int, bigrams: int, sample: int) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers (from 2 on) of words and sorted keys of pairs that are frequent in every ``sample``-th row."""
    some = landed(rows.where(F.pmod(F.xxhash64("row"), F.lit(sample)) == 0).select("__gm_text"), "sample")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            held = Counter(w for raw in utf8(b.column(0)) for w in words(raw))
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["key", "n"])

    counted = landed(some.mapInArrow(count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    found = commonest(counted, min(vocabulary, VOCABULARY) - 2).toArrow().sort_by([("n", "descending"), ("key", "ascending")])
    number = {w: k + 2 for k, w in enumerate(found["key"].to_pylist())}

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            every = [numbered(raw, number) for raw in utf8(b.column(0))]
            before, now = np.concatenate([x[:-1] for x in every]), np.concatenate([x[1:] for x in every])
            near = (before < VOCABULARY) & (now < VOCABULARY)
            key, n = np.unique(before[near] * VOCABULARY + now[near], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    counted = landed(some.mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "pairs")
    return number, np.sort(commonest(counted, bigrams).toArrow()["key"].to_numpy())


def _count(rows: DataFrame, number: dict[bytes, int], known: np.ndarray) -> Counts:
    """Exact counts of numbered words and known pairs over all rows; of rare words, how many there are."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((number, known))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = sent.value
        held = np.zeros((4, VOCABULARY), np.int64)
        pair = np.zeros((2, len(known)), np.int64)

        def out(kind: int, at: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), *map(pa.array, columns)], names=["kind", "id", "wt", "wn", "ct", "cn"])

        for c in _chunks(batches, number):
            mark = c.target[c.owner] == 1
            for k, ids in ((0, c.now), (2, c.before)):
                near = ids < VOCABULARY
                held[k] += np.bincount(ids[near & mark], minlength=VOCABULARY)
                held[k + 1] += np.bincount(ids[near], minlength=VOCABULARY)
            rare, n = np.unique(c.now[c.now >= VOCABULARY], return_inverse=True)
            place = _places(known, c.before, c.now)
            pair[0] += np.bincount(place[(place >= 0) & mark], minlength=len(known))
            pair[1] += np.bincount(place[place >= 0], minlength=len(known))
            none = np.zeros(len(rare), np.int64)
            far = c.now >= VOCABULARY
            yield out(2, rare, np.bincount(n, mark[far], len(rare)).astype(np.int64), np.bincount(n, minlength=len(rare)), none, none)
        at = np.flatnonzero(held.any(axis=0))
        yield out(0, at, *held[:, at])
        at = np.flatnonzero(pair[1])
        yield out(1, at, *pair[:, at], *np.zeros((2, len(at)), np.int64))

    sums = [F.sum(c).alias(c) for c in ("wt", "wn", "ct", "cn")]
    counted = landed(rows.mapInArrow(run, "kind long, id long, wt long, wn long, ct long, cn long").groupBy("kind", "id").agg(*sums), "counts", compression="zstd")
    whole = {r["kind"]: r for r in counted.groupBy("kind").agg(F.count("*").alias("n"), *sums[:2]).collect()}
    near = counted.where("kind < 2").toArrow()
    kind, at = near["kind"].to_numpy(), near["id"].to_numpy()
    columns = np.array([near[c].to_numpy() for c in ("wt", "wn", "ct", "cn")]).reshape(4, -1)
    word, pair = np.zeros((4, VOCABULARY), np.int64), np.zeros((2, len(known)), np.int64)
    word[:, at[kind == 0]] = columns[:, kind == 0]
    pair[:, at[kind == 1]] = columns[:2, kind == 1]
    # The vocabulary is every different word, the start mark and one unknown word.
    size = int((word[1] > 0).sum()) + (whole[2]["n"] if 2 in whole else 0) + 2
    total = np.array([sum(whole[k][c] for k in (0, 2) if k in whole) for c in ("wt", "wn")], float) + ADDED * size
    return Counts((word[:2] + ADDED) / total[:, None], word[2:], known, pair, total)


def _pack(kind: int, buckets: int, key: np.ndarray, other: np.ndarray, row: np.ndarray) -> pa.RecordBatch | None:
    """Messages (key, other, row) of a chunk as arrays by bucket, equal ones together with how often they occur."""
    if not len(key):
        return None
    order = np.lexsort((row, other, key))
    key, other, row = key[order], other[order], row[order]
    start = _starts(key, other, row)
    m, key, other, row = np.diff(start, append=len(key)), key[start], other[start], row[start]
    mixed = (key.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    start = _starts(bucket)
    ends = pa.array(np.append(start, len(bucket)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (key, other, row, m)]
    return _packed(kind, bucket[start], lists=lists)


def _packed(kind: int, bucket: np.ndarray, own: list | None = None, lists: list | None = None) -> pa.RecordBatch:
    n = len(bucket)
    own = own or [pa.nulls(n, pa.int64()), pa.nulls(n, DOC), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())]
    lists = lists or [pa.nulls(n, pa.list_(pa.int64()))] * 4
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind)), pa.array(bucket), *own, *lists], names=["kind", "bucket", "row", "doc_id", "n_tokens", "lt", "ln", "k", "o", "r", "m"])


DOC = pa.string()


def _messages(rows: DataFrame, number: dict[bytes, int], counts: Counts, buckets: int) -> DataFrame:
    """Each row's own sums (over known pairs, and over other pairs of numbered
    words as if they occurred only here), and its messages in buckets. A
    message's last number is the row, and the target mark in its last bit."""
    sent = rows.sparkSession.sparkContext.broadcast((number, counts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts = sent.value
        for c in _chunks(batches, number):
            place, sums = _places(counts.known, c.before, c.now), []
            near = (c.before < VOCABULARY) & (c.now < VOCABULARY)
            owner, before, now, at = c.owner[near], c.before[near], c.now[near], place[near]
            for m, once in ((0, c.target[owner]), (1, np.ones(len(owner), np.int64))):
                n = np.where(at >= 0, counts.pair[m][at], once) if len(counts.known) else once
                loss = counts.loss(m, n, counts.context[m][before], counts.alone[m][now])
                sums.append(np.bincount(owner, loss, len(c.doc)).astype(np.float64))
            own = [pa.array(c.row), pa.array(c.doc, pa.string()), pa.array(c.tokens), *map(pa.array, sums)]
            yield _packed(OWN, c.row % buckets, own=own)
            cold = place < 0
            owner, before, now = c.owner[cold], c.before[cold], c.now[cold]
            rt = (c.row << 1 | c.target)[owner]
            far_b, far_w = before >= VOCABULARY, now >= VOCABULARY
            near, two, late = ~far_b & ~far_w, far_b & far_w, far_w & ~far_b
            none = np.full(two.sum(), -1)
            made = (
                _pack(PAIR, buckets, before[near] * VOCABULARY + now[near], np.zeros(near.sum(), np.int64), rt[near]),
                _pack(BEFORE, buckets, before[far_b], now[far_b], rt[far_b]),
                # Of two rare words, the second is only counted in its own bucket.
                _pack(WORD, buckets, np.concatenate([now[late], now[two]]), np.concatenate([before[late], none]), np.concatenate([rt[late], rt[two] & 1])),
            )
            yield from (b for b in made if b is not None)

    return rows.mapInArrow(run, "kind long, bucket long, row long, doc_id string, n_tokens long, lt double, ln double, k array<long>, o array<long>, r array<long>, m array<long>")


ANSWER = "row long, doc_id string, n_tokens long, lt double, ln double, word long, m long, p0 long, p1 long, c0 long, c1 long"


def _answer(batches: Iterable[pa.RecordBatch], counts: Counts) -> Iterator[pa.RecordBatch]:
    """Of a bucket: its documents' own sums as they are; what the exact counts
    change of each row's sums; and for two rare words in a row (word, m, counts
    of pair and context), to be joined with rows that hold only a word's counts."""
    names = [f.split()[0] for f in ANSWER.split(", ")]
    held: dict[int, list[list[np.ndarray]]] = {PAIR: [], BEFORE: [], WORD: []}

    def out(n: int, **columns: np.ndarray) -> pa.RecordBatch:
        kinds = {"doc_id": pa.string(), "lt": pa.float64(), "ln": pa.float64()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)

    def changes(row: np.ndarray, m: np.ndarray, change: list[np.ndarray]) -> pa.RecordBatch:
        every, at = np.unique(row >> 1, return_inverse=True)
        return out(len(every), row=every, lt=np.bincount(at, m * change[0], len(every)), ln=np.bincount(at, m * change[1], len(every)))

    for b in batches:
        kind = b.column(0).to_numpy()
        own = b.filter(pa.array(kind == OWN))
        if own.num_rows:
            none = [pa.nulls(own.num_rows, pa.int64())] * (len(names) - 5)
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names[:5]), *none], names=names)
        for k in held:
            some = b.filter(pa.array(kind == k))
            if some.num_rows:
                held[k].append([some.column(c).flatten().to_numpy() for c in ("k", "o", "r", "m")])

    def taken(kind: int) -> tuple[np.ndarray, ...]:
        """The bucket's messages of a kind, sorted by key and other."""
        k, o, r, m = (np.concatenate(x) for x in zip(*held[kind]))
        held[kind].clear()
        order = np.lexsort((o, k))
        return k[order], o[order], r[order], m[order]

    def summed(start: np.ndarray, r: np.ndarray, m: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """[target, all] sums of runs, and the run of each message."""
        return [np.add.reduceat(x, start) for x in (m * (r & 1), m)], np.repeat(np.arange(len(start)), np.diff(start, append=len(m)))

    if held[PAIR]:
        k, _, r, m = taken(PAIR)
        n, at = summed(_starts(k), r, m)
        again = n[1][at] > 1
        k, r, m, at = k[again], r[again], m[again], at[again]
        before, now = k // VOCABULARY, k % VOCABULARY
        change = [counts.loss(x, n[x][at], counts.context[x][before], counts.alone[x][now]) - counts.loss(x, once, counts.context[x][before], counts.alone[x][now]) for x, once in ((0, r & 1), (1, np.ones(len(r), np.int64)))]
        yield changes(r, m, change)
    if held[BEFORE]:
        k, o, r, m = taken(BEFORE)
        (context, of), (n, at) = summed(_starts(k), r, m), summed(_starts(k, o), r, m)
        near = o < VOCABULARY
        loss = [counts.loss(x, n[x][at[near]], context[x][of[near]], counts.alone[x][o[near]]) for x in (0, 1)]
        yield changes(r[near], m[near], loss)
        far = ~near
        yield out(int(far.sum()), row=r[far] >> 1, word=o[far], m=m[far], p0=n[0][at[far]], p1=n[1][at[far]], c0=context[0][of[far]], c1=context[1][of[far]])
    if held[WORD]:
        k, o, r, m = taken(WORD)
        start = _starts(k)
        (word, of), (n, at) = summed(start, r, m), summed(_starts(k, o), r, m)
        near = o >= 0
        loss = [counts.loss(x, n[x][at[near]], counts.context[x][o[near]], (word[x][of[near]] + ADDED) / counts.whole[x]) for x in (0, 1)]
        yield changes(r[near], m[near], loss)
        asked = o[start] < 0
        yield out(int(asked.sum()), word=k[start][asked], c0=word[0][asked], c1=word[1][asked])


def score_all(docs: DataFrame, target_ids: DataFrame, vocabulary: int = VOCABULARY, bigrams: int = BIGRAMS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, ``n_tokens``, ``target_loss`` and ``background_loss`` (means over
    tokens) and ``score``, their difference, of every row of ``docs``, under
    models that count all its words and pairs. ``vocabulary`` and ``bigrams``
    bound what is broadcast, ``sample`` says of how many rows one is looked at
    to choose it; none of them changes results.

    Texts without a word (null, empty) have null losses and score. Repeated
    rows and rows without an id stay rows of their own; a target id that
    repeats counts once, and all rows with that id are targets. An empty table
    gives an empty one; other columns are ignored. ``docs`` should be a table:
    rows are numbered as they are read."""
    context = docs.sparkSession.sparkContext
    rows = _marked(docs, target_ids)
    number, known = _frequent(rows, vocabulary, bigrams, sample)
    counts = _count(rows, number, known)
    cold = int(counts.whole[1]) - int(counts.pair[1].sum())
    buckets = max(1, -(-cold // BUCKET))
    sent = context.broadcast(counts)
    dealt = _messages(rows, number, counts, buckets).repartitionById(buckets, F.col("bucket").cast("int"))
    answers = landed(dealt.mapInArrow(lambda batches: _answer(batches, sent.value), ANSWER), "answers", compression="zstd")

    asked = answers.where("m IS NOT NULL").select("row", "word", "m", "p0", "p1", "c0", "c1")
    found = answers.where("word IS NOT NULL AND m IS NULL").select("word", F.col("c0").alias("w0"), F.col("c1").alias("w1"))

    def loss(x: int) -> Column:
        alone = (F.col(f"w{x}") + F.lit(ADDED)) / F.lit(float(counts.whole[x]))
        seen = F.col(f"c{x}")
        return F.col("m") * -F.log(F.when(seen > 0, F.lit(PAIR_WEIGHT) * F.col(f"p{x}") / F.when(seen > 0, seen) + F.lit(1 - PAIR_WEIGHT) * alone).otherwise(alone))

    late = asked.join(found, "word").select("row", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), loss(0).alias("lt"), loss(1).alias("ln"))
    both = answers.where("word IS NULL").select("row", "doc_id", "n_tokens", "lt", "ln").unionAll(late)
    summed = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("lt").alias("lt"), F.sum("ln").alias("ln"))
    mean = [F.when(F.col("n_tokens") > 0, F.col(x) / F.when(F.col("n_tokens") > 0, F.col("n_tokens"))).alias(name) for x, name in (("lt", "target_loss"), ("ln", "background_loss"))]
    kind = docs.schema["doc_id"].dataType
    return summed.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", *mean).withColumn("score", F.col("target_loss") - F.col("background_loss"))
