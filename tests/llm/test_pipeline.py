"""The pipeline's stages take effect, each on what its predecessor kept."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import simhash
from gristmill.llm.queries import ORACLE, QUERIES

WORDS = "the of and to in is that for river mill wall pump field night morning council water bridge stone road".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_pipeline_on_planted_documents(spark, tmp_path):
    rnd = random.Random(3)
    docs, labels = [], []
    for k in range(200):
        docs.append((k, prose(rnd, 120), "en", "s", 0))
    for k in range(200, 260):
        words = prose(rnd, 80).split()
        for at in (5, 40, 70):
            words[at] = "gronk"
        docs.append((k, " ".join(words), "en", "s", 0))
    phrase = prose(rnd, 30)
    # Near copies: a tenth of the shingles of documents 1 to 9 changed, once by an edit inside and once by a new end.
    for k in range(1, 10):
        words = docs[k][1].split()
        words[50], words[90] = "edited", "again"
        docs += [(400 + k, " ".join(words), "en", "s", 0), (500 + k, docs[k][1] + " with a few more words", "en", "s", 0)]
    # Half of the words are others: not a copy.
    docs += [(600, " ".join(docs[20][1].split()[:60]) + " " + prose(rnd, 60), "en", "s", 0)]
    docs += [(300, docs[0][1], "en", "s", 0), (301, docs[0][1].upper(), "en", "s", 0), (302, "too short", "en", "s", 0), (303, f"{prose(rnd, 60)} {phrase} {prose(rnd, 60)}", "en", "s", 0), (304, None, "en", "s", 0)]
    for k in range(260):
        labels.append((k, 1, int(k >= 200)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == [*range(200), 600]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, now, str(tmp_path)).columns == now.columns
        assert stage(spark, now.limit(0), str(tmp_path)).count() == 0


def test_every_stage_on_odd_rows(spark, tmp_path):
    """Null, empty and very long texts, repeated rows, rows without an id, columns with the operators' own names."""
    rnd = random.Random(4)
    good, long = prose(rnd, 120), prose(rnd, 40_000)
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good), (4, long), (5, prose(rnd, 100)), (6, "gronk " * 30), (None, None)]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'en' AS lang", "'s' AS source", "0L AS n_chars", *(f"'x' AS {c}" for c in ("n_words", "words", "score", "fp", "name", "node", "root", "id", "of", "spans", "items", "kept", "key", "y")))
    some = [(100 + k, prose(rnd, 60) + (" gronk" * 4 if k % 2 else "")) for k in range(120)]
    docs = docs.unionByName(spark.createDataFrame(some, schema).withColumn("lang", F.lit("en")), allowMissingColumns=True)
    spark.createDataFrame([(i, 1, i % 2) for i, _ in some], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(rows[6][1].split()[10:40])), (2, None), (None, "the the the")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert found.columns == docs.columns
        left[name] = sorted((r["doc_id"] or 0 for r in found.collect() if (r["doc_id"] or 0) < 100))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert left["quality_rules"] == [0, 3, 3, 4, 5]
    assert left["toxicity"] == [0, 0, 1, 2, 3, 3, 4, 5]
    assert left["simhash_near_dedup"] == [1, 3, 4, 5, 6]
    assert left["decontamination"] == [0, 0, 1, 2, 3, 3, 4, 6]
    assert left["bpe"] == [0, 0, 1, 2, 3, 3, 4, 5, 6]


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


def test_near_dedup_links_fingerprints_too(spark, tmp_path):
    """A class joins what three bits of SimHash link and what similarity 0.8 of the sets links, and steps of both kinds."""
    rnd = random.Random(5)
    row, ends = prose(rnd, 11) + "\n", [prose(rnd, 25) for _ in range(3)]
    heavy = [(1, row * 60 + ends[0]), (2, row * 60 + ends[1])]
    base = prose(rnd, 200)
    other = (6, prose(rnd, 200))
    # 3 is a near copy of 2 by its set alone: the row fewer times, far from 2 by its bits.
    few = (3, row * 2 + ends[1])
    docs = [*heavy, few, (4, base), (5, base + " and more"), other]
    prints = {k: simhash.simhash(t.encode()) for k, t in docs}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in docs}
    bits = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert bits(1, 2) <= 3 and alike(1, 2) < 0.8 and bits(2, 3) > 3 and alike(2, 3) >= 0.8 and bits(1, 3) > 3 and alike(1, 3) < 0.8
    found = corpus_pipeline.distinct(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 4, 6]
