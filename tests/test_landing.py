"""Landed pages, exports that are whole or not there, merges in order, places, dates and medians."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gristmill.functions.dates import fuzzy_date
from gristmill.operators import dedup, evaluate, geo
from gristmill.plans.merging import TERMS
from gristmill.sources import landing, sinks


def put(folder, source, day, term, page, body):
    at = folder / f"source={source}" / f"day={day}" / f"term={term}" / f"page={page}"
    at.mkdir(parents=True)
    (at / "part-0.json").write_text(body, encoding="utf-8")


def test_landed_pages(spark, tmp_path):
    two = json.dumps([{"id": 1}, {"id": "é"}], ensure_ascii=False)
    put(tmp_path, "a", "2024-01-01", "data%20x", 0, two)
    put(tmp_path, "a", "2024-01-01", "data%20x", 1, '[{"id": 3}]')
    put(tmp_path, "a", "2024-01-01", "data%20x", 2, two)  # behind a short page
    put(tmp_path, "a", "2024-01-02", "cyber", 0, '{"member": [{"id": 4}, {"id": 5}]}')
    put(tmp_path, "b", "2024-01-02", "cyber", 0, "not json")
    put(tmp_path, "b", "2024-01-03", "cyber", 0, '{"id": 6}')
    found = landing.read_pages(spark, str(tmp_path), 2)
    told = sorted((r["source"], str(r["day"]), r["term"], r["page"], r["place"], r["json"]) for r in found.collect())
    assert told == [
        ("a", "2024-01-01", "data x", 0, 0, '{"id": 1}'), ("a", "2024-01-01", "data x", 0, 1, '{"id": "é"}'), ("a", "2024-01-01", "data x", 1, 0, '{"id": 3}'),
        ("a", "2024-01-02", "cyber", 0, 0, '{"id": 4}'), ("a", "2024-01-02", "cyber", 0, 1, '{"id": 5}'), ("b", "2024-01-02", "cyber", 0, 0, "not json"), ("b", "2024-01-03", "cyber", 0, 0, '{"id": 6}'),
    ]
    some = found.where((F.col("source") == "b") & (F.col("day") > F.lit("2024-01-02").cast("date")))
    assert some.rdd.getNumPartitions() == 1 and [r["json"] for r in some.collect()] == ['{"id": 6}']
    assert found.rdd.getNumPartitions() == 4
    assert "Filter" not in some._jdf.queryExecution().optimizedPlan().toString()


def test_packed_pages(spark, tmp_path):
    """A page a line, over several files of a source, day and term: pages behind the first short one, of none too, don't count."""
    two = json.dumps([{"id": 1}, {"id": "é"}], ensure_ascii=False)

    def pack(source, day, term, name, **pages):
        at = tmp_path / f"source={source}" / f"day={day}" / f"term={term}"
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_text("".join(json.dumps({"page": int(n[1:]), "body": body}) + "\n" for n, body in pages.items()), encoding="utf-8")

    pack("a", "2024-01-01", "data%20x", "part-0.txt", p3=two, p1='{"jobs": [{"id": 3}, {"id": 4}]}')
    pack("a", "2024-01-01", "data%20x", "part-1.txt", p4=two, p2='[{"id": 5}]', p0=two)
    pack("a", "2024-01-02", "cyber", "part-0.txt", p0=two, p1="[]")
    pack("a", "2024-01-02", "cyber", "part-1.txt", p2=two)
    pack("b", "2024-01-02", "cyber", "part-0.txt", p0=two, p1=two)
    put(tmp_path, "c", "2024-01-02", "cyber", 0, two)  # of the other layout
    found = landing.read_pages(spark, str(tmp_path), 2, packed=True)
    told = sorted((r["source"], str(r["day"]), r["term"], r["page"], r["place"], r["json"]) for r in found.collect())
    both = lambda *key: [(*key, 0, '{"id": 1}'), (*key, 1, '{"id": "é"}')]
    x = ("a", "2024-01-01", "data x")
    assert told == [*both(*x, 0), (*x, 1, 0, '{"id": 3}'), (*x, 1, 1, '{"id": 4}'), (*x, 2, 0, '{"id": 5}'), *both("a", "2024-01-02", "cyber", 0), *both("b", "2024-01-02", "cyber", 0), *both("b", "2024-01-02", "cyber", 1)]
    some = found.where(F.col("source") == "b")
    assert some.rdd.getNumPartitions() == 1 and some.count() == 4
    assert landing.read_pages(spark, str(tmp_path), 2).count() == 2


def test_landed_pages_lie_together(spark, tmp_path):
    """Pages of a source and term fill files: few files, however many pages."""
    from gristmill.plans.landing import SIZE, landed_pages

    keys = spark.range(20_000).selectExpr("id AS o_orderkey", "CASE WHEN id % 7 = 0 THEN 'P' WHEN id % 2 = 0 THEN 'O' ELSE 'F' END AS o_orderstatus", "id * 1.5D AS o_totalprice", "'1-URGENT' AS o_orderpriority")
    keys.write.parquet(str(tmp_path / "orders.parquet"))
    landed_pages(spark, str(tmp_path), str(tmp_path / "pages"))
    files = list((tmp_path / "pages").rglob("part-*"))
    assert len(files) == len({f.parent for f in files}) == 18
    pages = landing.read_pages(spark, str(tmp_path / "pages"), SIZE, packed=True).groupBy("source", "term", "page").count()
    full = [r["count"] for r in pages.collect()]
    assert len(full) > 300 and full.count(SIZE) > len(full) - 40


def test_a_failing_export_leaves_the_old_one(spark, tmp_path):
    path = tmp_path / "out"
    sinks.write_stable_json(spark.createDataFrame([(2, "é"), (1, None)], "key int, b string"), str(path), "key")
    line = lambda: "".join(sorted(p.read_text(encoding="utf-8") for p in path.glob("part-*")))
    assert line() == '{"b": "é", "key": 2}\n{"b": null, "key": 1}\n' or line() == '{"b": null, "key": 1}\n{"b": "é", "key": 2}\n'
    before = line()
    bad = spark.range(20).select(F.when(F.col("id") < 15, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("int").alias("key"), F.lit("x").alias("b"))
    with pytest.raises(PySparkException):
        landing.export(bad, str(path), "json")
    assert line() == before and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_csv_export_begins_with_the_mark(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 'a "b"\nc'), (2, 0.7, None)], "ord int, score double, title string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    files = sorted((tmp_path / "csv").glob("part-*"))
    assert files and all(f.read_bytes().startswith(b"\xef\xbb\xbfrang,score,") for f in files)
    text = "".join(f.read_text(encoding="utf-8-sig") for f in files)
    assert '"a ""b""\nc"' in text and text.index("0.7") < text.index("0.5")


def absorbed(rows):
    """The ordered pass, offer by offer."""
    kept = {}
    for key, order, rich, title, families, links in sorted(rows, key=lambda r: r[1]):
        new = {"ord": order, "rich": rich, "title": title, "families": list(dict.fromkeys(families)), "links": list({(x["source"], x["key"]): x for x in reversed(links)}.values())[::-1]}
        old = kept.get(key)
        if old is None:
            kept[key] = new
            continue
        winner, other = (new, old) if rich > old["rich"] else (old, new)
        winner["families"] += [f for f in other["families"] if f not in winner["families"]]
        have = {(x["source"], x["key"]) for x in winner["links"]}
        winner["links"] += [x for x in other["links"] if (x["source"], x["key"]) not in have]
        kept[key] = winner
    return kept


def test_absorbing_in_order(spark):
    import random

    rnd, rows = random.Random(1), []
    for n in range(200):
        links = [{"source": rnd.choice("xyz"), "key": str(k), "url": f"u{n}"} for k in rnd.sample(range(6), rnd.randint(0, 2))]
        rows.append((rnd.randrange(12), n, rnd.randrange(15), rnd.choice(["view", "click now", "nothing"]), rnd.sample(list(TERMS), rnd.randint(0, 3)), links))
    df = spark.createDataFrame(rows, "key int, ord int, richness int, title string, families array<string>, links array<struct<source:string,key:string,url:string>>")
    want = absorbed(rows)
    found = dedup.absorb(df, TERMS).collect()
    assert {r["key"]: (r["ord"], r["families"], [x.asDict() for x in r["links"]]) for r in found} == {k: (w["ord"], w["families"], w["links"]) for k, w in want.items()}
    for r in found:
        assert r["title_families"] == [f for f in r["families"] if any(f" {t} " in f" {r['title']} " for t in TERMS[f])]


def test_places_inside_locations(spark):
    communes = spark.createDataFrame([("Des Roches", "1", "77"), ("Paris", "75056", "75"), ("Roissy", "9", "95")], "name string, code string, department string")
    named = spark.createDataFrame([("Charles de Gaulle", "95527"), ("Gaulle", "0"), ("Roissy-CDG", "95528")], "name string, code string")
    said = {"Aéroport Paris Charles-de-Gaulle, FR": "95527", "roissy cdg / x": "95528", "Roches": "1", "Paris, TX": None, "Paris 11": "75111", "gaulle": "0", "": None, None: None, "Charles, de Gaulle": "95527", "Roissy": "9", "Paris Charles-de-Gaulle, TX": None}
    rows = spark.createDataFrame(list(enumerate(said)), "ord int, location string")
    found = {r["ord"]: r["code"] for r in geo.resolve_commune(rows, communes, named=named, barrier=True).collect()}
    assert [found[k] for k in range(len(said))] == list(said.values())


def test_dates_with_missing_parts(spark):
    day = lambda *p: date(*p)
    said = {
        "2024-03-05": day(2024, 3, 5), "Posted March 5, 2023 at 10:30": day(2023, 3, 5), "5th of Sept": day(2024, 9, 5), "Feb 2023": day(2023, 2, 28), "in 2022": day(2022, 1, 31), "on the 7th": day(2024, 1, 7),
        "december": day(2024, 12, 31), "Thursday": day(2024, 2, 1), "Wed": day(2024, 1, 31), "10:30": day(2024, 1, 31), "at 10:30 sharp": day(2024, 1, 31), "": None, None: None, "soon": None, "30 February 2023": day(2023, 2, 28), "Mon, 05 Aug 2024 10:00:00 GMT": day(2024, 8, 5),
    }
    rows = spark.createDataFrame([(t,) for t in said], "x string")
    found = {r["x"]: r["d"] for r in rows.select("x", fuzzy_date("x", F.lit("2024-01-31").cast("date")).alias("d")).collect()}
    assert found == said


def test_medians_by_counting(spark):
    rows = [("a", "x" * n, k % 2) for k, n in enumerate([1, 5, 5, 700, 9])] + [("b", None, 1), ("b", "x" * 4, 0), ("b", "x" * 7, None), (None, "y", 1)]
    corpus = spark.createDataFrame(rows, "source string, text string, relevant int")
    found = {(r["source"], r["bucket"], r["yes"], r["no"]): r["median_length"] for r in evaluate.breakdown(corpus).collect()}
    assert found == {("a", None, 2, 3): 5, ("b", None, 1, 1): 5, (None, None, 1, 0): 1, (None, "short", 3, 4): 5, (None, "long", 1, 0): 700, (None, None, 4, 4): 5}
    assert "percentile" not in evaluate.breakdown(corpus)._jdf.queryExecution().toString().lower()


def test_similar_pairs_of_one_large_identity(spark):
    """As all pairs give, though few are compared."""
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 1500)] + 0.06 * np.sqrt(32) * rng.normal(size=(1500, 32)) * rng.uniform(0.2, 1.6, (1500, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, "g" if k % 50 else f"s{k}", v.tolist()) for k, v in enumerate(x)], "ord long, guard string, embedding array<double>")
    near = x @ x.T
    want = {(a, b) for a in range(1500) for b in range(a + 1, 1500) if a % 50 and b % 50 and near[a, b] >= 0.9}
    found = [(r["a"], r["b"]) for r in dedup.similar_pairs(df, 0.9, block=100).collect()]
    assert len(want) > 1000 and sorted(found) == sorted(want)
    placed = dedup.cells(df, 0.9, block=100).where("guard = 'g'").groupBy("cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v")).collect()
    compared = sum(r["h"] * (r["h"] - 1) // 2 + r["h"] * r["v"] for r in placed)
    assert sum(r["h"] for r in placed) == 1470 and compared < 0.3 * 1470 * 1469 / 2


def ordered_pass(n, rich, near):
    """The merge row by row: representative of each."""
    kept, slot = [], {}
    for i in range(n):
        at = next((p for p, j in enumerate(kept) if (j, i) in near), None)
        if at is None:
            at = len(kept)
            kept.append(i)
        elif rich[i] > rich[kept[at]]:
            kept[at] = i
        slot[i] = at
    return {i: kept[p] for i, p in slot.items()}


def test_rounds_of_the_ordered_merge(spark):
    import random

    rnd, nodes, edges, want, base = random.Random(3), [], [], {}, 0
    for n, share in [(14, 0.15), (14, 0.3), (14, 0.5), (20, 1.0), (12, 0.8), (9, 0.2), (16, 0.25), (25, 0.12), (10, 0.4)]:
        near = {(i, j) for j in range(n) for i in range(j) if rnd.random() < share}
        rich = [rnd.randrange(6) for _ in range(n)]
        nodes += [(base + i, r) for i, r in enumerate(rich)]
        edges += [(base + i, base + j) for i, j in near]
        want |= {base + i: base + r for i, r in ordered_pass(n, rich, near).items()}
        base += n
    got = dedup.ordered_merge(spark.createDataFrame(nodes, "node long, rich int"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["representative"] for r in got.collect()} == want


def test_survivors_are_the_same_with_groups_and_rounds(spark):
    import random

    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = []
    for k in range(18):
        v = [c + rnd.gauss(0, 0.55) for c in rnd.choice(centres)]
        norm = sum(x * x for x in v) ** 0.5
        rows.append((k, rnd.choice("gh") if k % 9 else None, rnd.randrange(30), [x / norm for x in v]))
    df = spark.createDataFrame(rows, "ord long, guard string, richness int, embedding array<double>")
    one, two = (sorted(map(tuple, dedup.fuzzy_survivors(df, 0.8, largest=n).collect())) for n in (1000, 3))
    assert one == two and any(a != b for a, b in one)


def test_small_rows_are_dealt_to_all_cores(spark, tmp_path):
    from gristmill.plans.offers import duration_and_start

    spark.range(70).selectExpr("id AS p_partkey", "CAST(id AS INT) AS p_size", "'x' AS p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = duration_and_start(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 70
