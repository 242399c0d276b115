"""The engine's operators on small fixtures: rules for ties, nulls and unknowns."""

from __future__ import annotations

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill import plans
from gristmill.functions import geo as gf
from gristmill.functions import text as tx
from gristmill.functions.columns import json_inside, json_or_null, share
from gristmill.functions.url import normal_url
from gristmill.functions.vector import dot, unit
from gristmill.operators import dedup, evaluate, filters, geo, market, observe, queue, rank, store
from gristmill.sources import normalize, sinks


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, want",
    [("Développeur (H/F) à Lyon", "developpeur a lyon"), ("Data Engineer - m/w/d", "data engineer"), ("F/H Chef", "chef"), ("Chef RH F/H", "chef rh"), ("Freshfields", "freshfields"), ("", ""), ("Ingénieur  Réseau", "ingenieur reseau")],
)
def test_normal_title(spark, raw, want):
    assert one(spark, tx.normal_title("x"), raw) == want


def test_every_gender_marker_goes(spark):
    marks = "(H/F) (h/f) H/F H-F H - F [H/F] (F/H) (M/F) F/M (W/M) M/W (H/F/D) H/F/N (M/W/D) (f/m/d) (x/f/m) (X/F/M)".split(" ")
    rows = spark.createDataFrame([(f"Ingénieur données {m}",) for m in ["", *" ".join(marks).replace("H - F", "H-F").split(" ")] if m != "-" and m not in "HF"], "x string")
    assert {r[0] for r in rows.select(tx.normal_title("x")).collect()} == {"ingenieur donnees"}
    assert one(spark, tx.normal_title("x"), "Analyste M&A - H / F (stage)") == "analyste m a stage"


@pytest.mark.parametrize(
    "f, raw, want",
    [
        (tx.clean, None, ""), (tx.clean, "  au00e9b  ", "aéb"), (tx.repair_escapes, "Hu002FF", "H/F"), (tx.city_key, "Paris 12e, France", "paris"), (tx.city_key, "Évry, 91", "evry"),
        (tx.slug, "Élève & Co", "eleve_co"), (tx.word_form, "L'Été", " l ete "), (tx.presentable_title, "Stage data (H/F) - 6 mois", "Stage data"), (tx.presentable_title, "(H/F)", "(H/F)"),
        (tx.comment, "  ", None), (tx.level, "Bac+5", "inconnu"), (tx.level, None, "inconnu"), (tx.level, "Confirmé", "senior"), (tx.level, "jeune diplômé", "junior"), (tx.level, "Stagiaire", "stage"), (tx.level, " Senior ", "senior"), (tx.level, "student", "stage"),
        (tx.city_key, "Parisot", "parisot"), (tx.city_key, "Saint-Denis, 93", "saint denis"), (tx.city_key, "Grand Paris Sud", "grand paris"), (tx.city_key, None, ""), (tx.mask_secrets, "GET /x?api_key=abc&q=1", "GET /x?api_key=***&q=1"), (tx.escape_html, '<a b="c">&', "&lt;a b=&quot;c&quot;&gt;&amp;"),
        (tx.strip_html, "<p>a&amp;b</p><script>x<y</script>c<br/>d", "a&b xc d"), (tx.strip_html, "a\n <li>b</li>\u00a0 c", "a\n b c"), (tx.strip_html, None, ""),
        (tx.duration_months, "4 à 6 mois, 24 mois, 36 mois", 24), (tx.duration_months, "stage de 26 semaines", 6), (tx.duration_months, "rien", None), (tx.duration_months, "6-month internship", 6), (tx.duration_months, "4 à 6 mois", 6), (tx.duration_months, "30 mois", None), (tx.duration_months, None, None),
        (tx.start_month, "dès février 2027 puis 03/2026", "2027-02"), (tx.start_month, "on 3/2026", "2026-03"), (tx.start_month, "soon", None), (tx.start_month, "01-2027", "2027-01"), (tx.start_month, "2027/1 ou 2026-05", "2027-01"), (tx.start_month, "2026-09 then 03/2027", "2026-09"), (tx.start_month, "12/2026, janvier 2027", "2027-01"),
    ],
)
def test_text(spark, f, raw, want):
    assert one(spark, f("x"), raw) == want


def test_plain_letters_cost_little(spark):
    """Seven million characters, few of them accented: a look-up a character took some 4 microseconds each."""
    text = "Été au café, ﬁn 1½ e\u0301 " + "plain words of a long text " * 250_000
    one(spark, F.length(tx.word_form("x")), "warm é")
    began = time.monotonic()
    assert one(spark, F.substr(tx.word_form("x"), F.lit(1), F.lit(27)), text) == " ete au cafe fin 1 e plain "
    assert time.monotonic() - began < 4


def test_urls(spark):
    assert one(spark, normal_url("x"), "HTTPS://Ex.Com/A/?b=2&utm_source=z&a=&ref=q#top") == "https://ex.com/A?a=&b=2"
    assert one(spark, normal_url("x"), "https://e.com/?q=a+b&z=%C3%A9&y&q=~*") == "https://e.com?q=a+b&q=~%2A&y=&z=%C3%A9"
    assert one(spark, normal_url("x"), "http://e.com/") == "http://e.com"


def test_columns(spark):
    assert one(spark, share("x", F.lit(3)), 1, "int") == 33.3
    assert one(spark, share("x", F.lit(0)), 1, "int") is None
    assert one(spark, json_or_null("x", "k int"), "{broken")["k"] is None
    assert one(spark, json_inside("x", "k int"), 'said {"k": 4} so')["k"] == 4
    assert one(spark, dot("x", "x"), [3.0, 4.0], "array<float>") == 25.0
    assert one(spark, unit("x"), [0.0, 0.0], "array<float>") == [0.0, 0.0]
    assert one(spark, tx.refusal(F.lit("INFO"), "x"), "status code 429")["blocking"]
    assert one(spark, tx.refusal(F.lit("INFO"), "x"), "fine") is None


def test_geo_functions(spark):
    assert one(spark, gf.segments("x"), "St-Denis 93200, Île-de-France / Paris CEDEX 12") == ["st denis", "ile de france", "paris cedex 12"]
    assert one(spark, gf.segments("x"), "Orly, Val-de-Marne - Paris | 75 - Paris 8e Arrondissement") == ["orly", "val de marne paris", "val de marne", "paris", "75"]
    assert one(spark, gf.segments("x"), None) == []
    assert one(spark, gf.variants(F.col("x")), "st maur cedex 2") == ["st maur cedex 2", "saint maur cedex 2", "saint maur"]
    assert one(spark, gf.cited_departments("x", {"yonne": "89"}), "92 - SURESNES, 977 – Gustavia / l'Yonne") == ["92", "97", "89"]
    assert one(spark, gf.paris_district("x"), "Paris 12e") == 12 and one(spark, gf.paris_district("x"), "3ème arrondissement") == 3 and one(spark, gf.paris_district("x"), "Paris 25") is None
    inside = {"": True, None: True, "Paris, TX": False, "75 - Paris": True, "X, A8, FR": True, "Lucé, CVL, FR": False, "Ile-de-France": True, "Rennes, Bretagne": False, "Orly, Val-de-Marne": True, "La Défense": True, "Lyon": False, "33 - X": False}
    for place, want in inside.items():
        assert one(spark, gf.in_region("x"), place) is want, place
    assert one(spark, gf.in_region("x", F.lit(True)), "Massy") and not one(spark, gf.in_region("x", F.lit(True)), "Massy, CA")
    lists = [(["Rome", " Paris "], "Paris"), (["", "Rome"], "Rome"), ([" "], ""), (None, "")]
    assert [r[0] for r in spark.createDataFrame([(x,) for x, _ in lists], "x array<string>").select(gf.preferred_location("x")).collect()] == [w for _, w in lists]


def test_region_by_communes(spark):
    rows = spark.createDataFrame([(1, "Les Lilas 93260", "t"), (2, "lilas", "t"), (3, "Lilas, TX", "t"), (4, "Lilas", "Poste au Canada"), (5, "Berlin", "t"), (6, None, None)], "ord int, location string, title string")
    communes = spark.createDataFrame([("93045", "Les Lilas", "93")], "code string, name string, department string")
    found = {r["ord"]: r["inside"] for r in geo.region_decision(rows, communes, title="title", foreign_titles=["canada"], foreign=["berlin"]).collect()}
    assert found == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_homonyms_take_the_cited_department_then_the_nearest(spark):
    communes = spark.createDataFrame([("77433", "Saint-Mard", "77", 2.7, 49.0), ("02682", "Saint-Mard", "02", 3.6, 49.4), ("75056", "Paris", "75", 2.35, 48.85)], "code string, name string, department string, lon double, lat double")
    rows = spark.createDataFrame([(1, "02 - ST MARD"), (2, "Saint-Mard"), (3, "PARIS 11"), (4, "Nowhere"), (5, None)], "ord int, location string")
    for centre, near in (((2.3, 48.8), "77433"), ((3.6, 49.4), "02682")):
        assert {r["ord"]: r["code"] for r in geo.resolve_commune(rows, communes, centre=centre).collect()} == {1: "02682", 2: near, 3: "75111", 4: None, 5: None}


def test_filters_give_the_first_reason_and_unknown_dates_fail(spark):
    rows = spark.createDataFrame([("stage data", "x", "fr", None), ("stage senior", "x", "fr", "2024-01-02"), ("job", "x", "xx", "2024-01-01"), ("stage", "x", "fr", "2024-01-01"), ("stage", "y", "fr", None)], "title string, company string, location string, d string").withColumn("posted_at", F.col("d").cast("date"))
    found = [r["reason"] for r in filters.reject_reasons(rows, ["stage"], ["senior"], ["fr"], "2024-01-03", 7, ["y"]).collect()]
    assert found == ["too_old", "excluded", "off_topic", None, None]
    with pytest.raises(ValueError, match="x, x"):
        filters.require(rows, F.col("company") == "y", "company", "bad").count()
    with pytest.raises(ValueError):
        filters.by_prefix(rows, "title", "stage")
    assert filters.by_prefix(rows, "title", "jo").count() == 1
    travel = spark.createDataFrame([({"a": 50.0, "b": 40.0},), ({"a": 50.0},), ({},)], "t map<string,double>")
    assert [r[0] for r in travel.select(filters.near_enough("t", 45.0)).collect()] == [True, False, True]


def test_exact_duplicates_keep_the_richest_then_the_earliest(spark):
    rows = spark.createDataFrame([("k", 2, 5, "b", ["s2"]), ("k", 1, 5, "a", ["s1"]), ("k", 3, 4, "c", ["s1", "s3"]), ("j", 4, 0, "d", [])], "key string, ord int, richness int, title string, sources array<string>")
    found = {r["key"]: r for r in dedup.keep_richest(rows, gather=("sources",)).collect()}
    assert (found["k"]["ord"], found["k"]["title"], found["k"]["copies"], found["k"]["sources"]) == (1, "a", 3, ["s1", "s2", "s3"])
    assert found["j"]["copies"] == 1


def greedy(rows, least):
    """The ordered pass over all rows at once."""
    kept, slot = [], {}
    for r in rows:
        at = next((i for i, k in enumerate(kept) if k[1] is not None and k[1] == r[1] and float(np.dot(k[3], r[3])) >= least), None)
        if at is None:
            kept.append(r)
            at = len(kept) - 1
        elif r[2] > kept[at][2]:
            kept[at] = r
        slot[r[0]] = at
    return {k: kept[i][0] for k, i in slot.items()}


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_duplicates_match_the_ordered_pass(spark, seed):
    rnd = np.random.default_rng(seed)
    rows = []
    for k in range(60):
        v = rnd.normal(size=3)
        rows.append((k, [None, "a", "b"][int(rnd.integers(0, 3))], int(rnd.integers(0, 5)), (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame(rows, "ord long, guard string, richness int, embedding array<double>")
    found = {r["ord"]: r["representative"] for r in dedup.fuzzy_survivors(df, 0.7).collect()}
    assert found == greedy(rows, 0.7)
    assert dedup.similar_pairs(df.where("guard is not null"), 0.7, block=4).count() == dedup.similar_pairs(df.where("guard is not null"), 0.7).count()


@pytest.mark.parametrize("largest", [1000, 2])
def test_copies_of_a_vector_make_no_pairs(spark, monkeypatch, largest):
    """Rows of a few vectors, in guards of many and few: pairs are of different vectors at most."""
    rnd, seen, whole = np.random.default_rng(5), [], dedup.similar_pairs
    some = [(v / np.linalg.norm(v)).tolist() for v in rnd.normal(size=(7, 3))]
    rows = [(k, "ab"[k % 10 == 0], int(rnd.integers(0, 50)), some[int(rnd.integers(0, 7))]) for k in range(400)]
    df = spark.createDataFrame(rows, "ord long, guard string, richness int, embedding array<double>")
    monkeypatch.setattr(dedup, "similar_pairs", lambda found, *more: seen.append(found.count()) or whole(found, *more))
    assert {r["ord"]: r["representative"] for r in dedup.fuzzy_survivors(df, 0.6, largest=largest).collect()} == greedy(rows, 0.6)
    assert sum(seen) <= 14


def test_pairs_leave_a_task_in_pieces():
    import pandas as pd

    group = pd.DataFrame({"_i": 0, "_j": 0, "_k": 0, "ord": range(500), "guard": "g", "home": True, "embedding": [np.ones(2)] * 500})
    found = list(dedup.strips(group, 0.5, "ord", "guard", "embedding"))
    assert sum(map(len, found)) == 500 * 499 // 2 and max(map(len, found)) <= 64 * 500


def counted(spark, f):
    """``f`` as a function of one column, and how many rows it has been asked for."""
    asked = spark.sparkContext.accumulator(0)

    def work(x):
        asked.add(1)
        return f(x)

    return work, asked


def test_places_are_looked_up_once(spark, monkeypatch):
    """Six hundred offers of three locations; fifty communes of one name, one of them of no known department."""
    cut, asked = counted(spark, lambda x: [x.split(" - ")[-1].lower()] if x else [])
    once = F.udf(cut, "array<string>")
    away, met = counted(spark, float)
    far = F.udf(away, "double")
    monkeypatch.setattr(geo, "segments", lambda c: once(c))
    monkeypatch.setattr(geo, "haversine", lambda lon, *more: far(lon))
    rows = spark.createDataFrame([(k, ["01 - Town", "99 - Town", None][k % 3]) for k in range(600)], "ord long, location string")
    places = [("Town", f"C{k:02d}", "01" if k in (30, 31) else None if k == 9 else "02", float(k), 0.0) for k in range(50)]
    communes = spark.createDataFrame(places, "name string, code string, department string, lon double, lat double")
    found = {r["ord"]: r["code"] for r in geo.resolve_commune(rows, communes, centre=(0.0, 0.0)).collect()}
    assert found == {k: ["C30", "C00", None][k % 3] for k in range(600)}
    assert 0 < asked.value < 100 and 0 < met.value <= 200
    before = asked.value
    inside = {r["ord"]: r["inside"] for r in geo.region_decision(rows, communes).collect()}
    assert inside == {k: True for k in range(600)} and asked.value - before < 100


def test_hours_and_identity(spark):
    assert one(spark, dedup.hours_in_title("x"), "Serveur 35h ou 20 h, 99h, 12hp") == [20, 35]
    rows = spark.createDataFrame([("t", None, "paris"), ("t", "Acme", "")], "title string, company string, location string")
    assert [r[0] for r in rows.select(dedup.mergeable_identity()).collect()] == [None, None]
    for title, want in {"8h30": [], "7,5h": [], "CDI 10H": [10], "24H / SEMAINE": [24], "19h": [19], None: [], "41h": []}.items():
        assert one(spark, dedup.hours_in_title("x"), title) == want, title
    told = spark.createDataFrame([("t 10h", "L'Oréal SA", "92 - Clichy", "92024"), ("t", "x", "Clichy, 92", None)], "title string, company string, location string, code string")
    assert [tuple(r[0]) for r in told.select(dedup.mergeable_identity(commune="code")).collect()] == [("l oreal sa", "92024", [10]), ("x", "clichy", [])]


def test_native_merge_and_migration(spark):
    rows = spark.createDataFrame([("s", "1", 2, "b", ["y"]), ("s", "1", 1, "a", ["x"]), ("s", "", 3, "c", ["z"]), ("s", None, 4, "d", ["z"])], "source string, id string, ord int, title string, fam array<string>")
    found = sorted((r["title"], tuple(r["fam"])) for r in dedup.merge_by_native_id(rows, "source", "id", "ord", "fam").collect())
    assert found == [("a", ("x", "y")), ("c", ("z",)), ("d", ("z",))]


def test_ranking(spark):
    rows = spark.createDataFrame([(k, float(k % 3)) for k in range(100)], "ord int, v double")
    got = {r["ord"]: r["rank"] for r in rank.ranked(rows, F.desc("v"), F.asc("ord")).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(range(100), key=lambda k: (-(k % 3), k)))}
    assert rank.normalised(rows.where("ord = 5"), "v").first()["norm"] == 0.0
    assert [r["ord"] for r in rank.spread_sample(rows, 3, F.asc("ord")).orderBy("ord").collect()] == [0, 50, 99]
    assert rank.spread_sample(rows.limit(2), 5, F.asc("ord")).count() == 2
    assert rank.spread_sample(rows.limit(0), 5, F.asc("ord")).count() == 0
    blended = rank.blend(spark.createDataFrame([(0.4, 0.8), (0.4, None)], "score double, verdict_score double")).collect()
    assert [round(r["final"], 3) for r in blended] == [0.6, 0.4]


def test_nearest_matches_brute_force_in_blocks(spark):
    rnd = np.random.default_rng(1)
    vectors = rnd.normal(size=(80, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 10 = 0")
    found = {(r["query"], r["rank"]): r["vec_id"] for r in rank.nearest(rows, queries, 5, most=3).collect()}
    for q in range(0, 80, 10):
        best = sorted(range(80), key=lambda k: (-round(float(vectors[q] @ vectors[k]), 9), k))[:5]
        assert [found[q, r + 1] for r in range(5)] == best


def test_metrics(spark):
    rows = lambda rel: spark.createDataFrame(list(enumerate(rel, 1)), "rank int, relevant int")
    m = evaluate.metrics(rows([1, 0, 1, 0]), 3).first()
    assert (round(m["precision_at_k"], 4), m["median_rank"], m["negatives_in_top"]) == (0.6667, 2.0, 1)
    assert round(m["ndcg_at_k"], 4) == round((1 + 0.5) / (1 + 1 / np.log2(3)), 4)
    none = evaluate.metrics(rows([0, 0]), 10).first()
    assert (none["precision_at_k"], none["ndcg_at_k"], none["median_rank"]) == (0.0, 0.0, None)
    assert evaluate.metrics(rows([1]).limit(0), 10).first()["precision_at_k"] == 0.0
    assert evaluate.metrics(rows([1, 1]), 10).first()["precision_at_k"] == 1.0


def test_upsert_is_idempotent_within_a_day(spark):
    new = lambda *keys: spark.createDataFrame([(k, "t") for k in keys], "key string, title string")
    old = new().select("key", "title", *(F.lit(None).cast(t).alias(n) for n, t in (("first_seen", "date"), ("last_seen", "date"), ("days_seen", "int"), ("first_run", "int"), ("last_run", "int"))))
    a = store.upsert_seen(old, new("a", "b"), "2024-01-01", 1, fields=("title",))
    b = store.upsert_seen(a, new("a"), "2024-01-01", 2, fields=("title",))
    c = store.upsert_seen(b, new("a", "c"), "2024-01-03", 3, fields=("title",))
    found = {r["key"]: (str(r["first_seen"]), str(r["last_seen"]), r["days_seen"], r["first_run"], r["last_run"]) for r in c.collect()}
    assert found == {"a": ("2024-01-01", "2024-01-03", 2, 1, 3), "b": ("2024-01-01", "2024-01-01", 1, 1, 1), "c": ("2024-01-03", "2024-01-03", 1, 3, 3)}


def test_store_helpers(spark):
    t = lambda rows: spark.createDataFrame(rows, "key int, text string, at int")
    assert {r["key"]: r["text"] for r in store.keep_filled(t([(1, "a", 1), (2, "b", 1)]), t([(1, " ", 2), (2, "c", 2)]), "key", "text", "at").collect()} == {1: "a", 2: "c"}
    assert sorted(r["text"] for r in store.last_write(t([(1, "a", 1), (2, "b", 1)]), t([(2, "c", 2)]), "key").collect()) == ["a", "c"]
    assert sorted(r["text"] for r in store.append_missing(t([(1, "a", 1)]), t([(1, "z", 2), (3, "d", 2)]), "key").collect()) == ["a", "d"]
    one_way, other = t([(1, None, 1), (2, "", 1)]), t([(2, "", 1), (1, None, 1)])
    assert store.fingerprint(one_way).first() == store.fingerprint(other).first()
    assert store.fingerprint(one_way).first() != store.fingerprint(t([(1, "", 1), (2, None, 1)])).first()


def test_fingerprints_tell_tables_apart(spark, monkeypatch):
    t = lambda rows: spark.createDataFrame(rows, "a string, b string")
    for group in (4096, 2):
        monkeypatch.setattr(store, "GROUP", group)
        tables = [[], [(None, "x")], [("\\N", "x")], [("-", "x")], [("x|b=y", "z")], [("x", "y|b=z")], [("x", "y"), ("x", "y")], [("x", "y")], [("1:x", "y")], *([(str(k), str(k % 7)) for k in range(n)] for n in (30, 31))]
        marks = [store.fingerprint(t(rows)).first()[0] for rows in tables]
        assert len(set(marks)) == len(marks) and all(len(m) == 64 for m in marks)
        assert store.fingerprint(t(tables[-1][::-1]).repartition(3)).first()[0] == marks[-1]


def test_queue_rules(spark):
    jobs = spark.createDataFrame([(1, "o", "h1", "failed", 1, 0), (2, "o", "h2", "running", 2, 3), (3, "p", "h3", "running", 3, 1), (4, "p", "h4", "pending", 4, 0)], "id int, offer_id string, offer_hash string, status string, created_at int, attempts int")
    assert {r["id"]: (r["status"], r["attempts"]) for r in queue.recover(jobs).collect()} == {1: ("failed", 0), 2: ("failed", 3), 3: ("pending", 2), 4: ("pending", 0)}
    requests = spark.createDataFrame([("o", "h1"), ("o", "h2"), ("q", "h9"), ("q", "h9")], "offer_id string, offer_hash string")
    assert sorted(r["offer_hash"] for r in queue.enqueue(jobs, requests).collect()) == ["h1", "h9"]
    events = spark.createDataFrame([(1, 1, "pending"), (1, 2, "running"), (1, 3, "done"), (1, 4, "running"), (2, 1, "done")], "id int, at int, status string")
    assert sorted((r["id"], r["at"]) for r in queue.illegal_moves(events).collect()) == [(1, 4), (2, 1)]
    assert queue.head(jobs).first()["id"] == 4


def test_running_state_over_stretches(spark):
    rnd = random.Random(0)
    rows = [(k, rnd.choice("ab"), rnd.choice(["good", "bad", None])) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, offer_id string, told string")
    want, last, n = {}, {}, {}
    for k, offer, told in rows:
        last[offer] = told
        n[offer] = n.get(offer, 0) + 1
        want[k] = (last[offer], n[offer])
    for stretch in (1, 7, 1 << 16):
        assert {r["id"]: (r["state"], r["n_so_far"]) for r in queue.running_state(df, "told", stretch=stretch).collect()} == want
    final = {r["offer_id"]: r["told"] for r in queue.replay(df).collect()}
    assert final == {offer: told for _, offer, told in rows}


def test_moves_of_the_queue(spark):
    jobs = spark.createDataFrame([(1, "pending"), (2, "running"), (3, "done")], "id int, status string")
    moves = lambda *m: spark.createDataFrame(list(m), "id int, to string")
    assert {r["id"]: r["status"] for r in queue.moved(jobs, moves((1, "running"), (2, "done"))).collect()} == {1: "running", 2: "done", 3: "done"}
    with pytest.raises(ValueError, match="3"):
        queue.moved(jobs, moves((3, "running")))
    requests = spark.createDataFrame([(k,) for k in (1, 2, 3)], "offer_id int")
    known, texts = requests.where("offer_id < 3"), requests.where("offer_id = 1")
    assert {r["offer_id"]: r["outcome"] for r in queue.validate(requests, known, texts, False).collect()} == {1: "MASTER_INVALID", 2: "TEXT_MISSING", 3: "OFFER_NOT_FOUND"}
    assert queue.validate(requests, known, texts).where("outcome = 'ACCEPTED'").count() == 1


def test_displayable_offers_of_a_run(spark):
    rows = spark.createDataFrame([("a", 5, "2024-01-02"), ("b", 4, "2024-01-02"), ("c", 5, "2024-01-01")], "key string, last_run int, seen string").withColumn("last_seen", F.to_date("seen"))
    links = spark.createDataFrame([("a", "s", "l", 1), ("b", "s", "m", 1)], "key string, source string, link string, first_seen int")
    get = lambda run: sorted(r["key"] for r in store.displayable(rows, links, run, "2024-01-02").collect())
    assert get(5) == ["a"] and get(4) == ["b"] and get(9) == ["a", "b"]
    runs = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-03"), ("a", "2024-01-03"), ("b", "2024-01-02")], "key string, d string").withColumn("day", F.to_date("d"))
    assert sorted((r["key"], str(r["first_seen"]), str(r["last_seen"]), r["days_seen"]) for r in store.seen_from_runs(runs).collect()) == [("a", "2024-01-01", "2024-01-03", 2), ("b", "2024-01-02", "2024-01-02", 1)]


def test_support_occupations_are_off_the_domain(spark):
    rows = spark.createDataFrame([(1, True, ["x"], True), (2, False, ["x"], True), (3, None, None, True), (4, True, ["x"], False)], "ord int, domain_match boolean, flags array<string>, support boolean")
    found = {r["ord"]: (r["domain_match"], len(r["flags"] or [])) for r in rank.support_rule(rows, F.col("support")).collect()}
    assert found == {1: (False, 2), 2: (False, 1), 3: (False, 1), 4: (True, 1)}
    assert [one(spark, rank.capped("x", F.lit(a), F.lit(b)), 0.9, "double") for a, b in ((True, True), (False, True), (False, False))] == [0.2, 0.3, 0.9]
    assert one(spark, rank.capped("x", F.lit(True), F.lit(True)), None, "double") is None


def test_tension_is_read_at_the_latest_period(spark):
    rows = spark.createDataFrame([("c", "2023", "M", 1.0), ("c", "2024", "M", 2.0), ("c", "2024", "x", None), ("c", "2024", "y", 0.5), ("c", "2024", "z", 0.7), ("d", "2022", "y", 1.0)], "code string, period string, kind string, v double")
    found = {r["code"]: (r["period"], r["main"], [d["kind"] for d in r["details"]]) for r in market.latest_tension(rows, "code", "period", "kind", "v", "M").collect()}
    assert found == {"c": ("2024", 2.0, ["z", "y", "x"]), "d": ("2022", None, ["y"])}
    named = market.territory_codes(spark.createDataFrame([("Île-de-France",), ("x",)], "label string"), spark.createDataFrame([("11", "ILE-DE-FRANCE")], "code string, label string"))
    assert {r["label"]: r["code"] for r in named.collect()} == {"Île-de-France": "11", "x": None}


def test_tags_labels_and_settings(spark):
    from gristmill.functions.dates import allowed_window
    from gristmill.sources.adapters import label_rows, overlaid

    tags = spark.createDataFrame([([" b ", "a", None, "", "b"],), (None,)], "x array<string>")
    assert [r[0] for r in tags.select(tx.ordered_tags("x")).collect()] == [["b", "a"], []]
    assert [one(spark, tx.families_or("x", {"d": ["data"], "c": ["cyber"]}), t) for t in ("Data, cyber", "rien", None)] == [["d", "c"], ["terme_non_retrouve"], ["terme_non_retrouve"]]
    assert [one(spark, allowed_window("x"), n, "int") for n in (0, 7, 10, 21, 99)] == [1, 7, 14, 31, 31]
    label = label_rows(spark.createDataFrame([('{"cle": "k", "pertinent": 1}',), ('{"cle": "l", "pertinent": 0, "provenance": "p"}',)], "json string")).collect()
    assert [(r["key"], r["relevant"], r["provenance"], r["title"]) for r in label] == [("k", 1, "corpus_aveugle", ""), ("l", 0, "p", "")]
    assert overlaid({"a": {"x": 1, "y": 2}, "b": [1], "c": 1}, {"a": {"y": 3}, "b": [2], "d": {"z": 0}}) == {"a": {"x": 1, "y": 3}, "b": [2], "c": 1, "d": {"z": 0}}


def test_rows_without_a_vector_come_last(spark):
    rows = spark.createDataFrame([(1, None, 0.2, False), (2, 0.5, 0.0, False), (3, 0.95, 0.2, True)], "ord int, sims double, boost double, combo boolean")
    assert [(r["ord"], r["score"]) for r in rank.top(rank.compose(rows, "additive"), 5).orderBy("rank").collect()] == [(3, 1.0), (2, 0.5), (1, None)]


def test_run_report(spark):
    tagged = spark.createDataFrame([("a", True, None, False), ("a", True, "too_old", False), ("b", False, None, False)], "source string, normalised boolean, reason string, merged boolean")
    families = spark.createDataFrame([("f", 3, 1)], "family string, raw int, survivors int")
    incidents = spark.createDataFrame([("b", "http", "HTTP 500")], "source string, category string, detail string")
    told = json.loads(observe.run_report(observe.funnel(tagged), families, incidents, "p").first()["json"])
    assert told["perimetre"] == "p" and [s["nom"] for s in told["sources"]] == ["a", "b"] and told["sources"][0]["rejets"] == {"too_old": 1}
    assert told["sources"][1]["incidents"] == [{"categorie": "http", "detail": "HTTP 500"}] and told["familles"] == [{"nom": "f", "brut": 3, "survivantes": 1}]


def test_dates(spark):
    from gristmill.functions.dates import parse_date

    raw = ["2024-03-05T10:00:00.000Z", "Tue, 05 Mar 2024 10:00:00 +0000", "Tue, 05 Mar 2024 10:00:00 GMT", "3/5/2024", "March 5, 2024", "5 Mar 2024", "posted 5 March 2024 by us", "le 2024-03-05 (maj)", "soon", None]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(parse_date("x").cast("string")).collect()]
    assert found == ["2024-03-05"] * 8 + [None, None]
    assert str(one(spark, parse_date("x"), "13/3/2024")) == "2024-03-13"


def test_models_are_asked_once_for_each_content(spark):
    from gristmill.operators import models

    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "ord int, t string")
    cache = models.encode_missing(rows.where("ord = 1"), spark.createDataFrame([], "hash string, model string, embedding array<float>"), "t")
    assert models.encode_missing(rows, cache, "t").count() == 2
    with pytest.raises(ValueError):
        models.one_model(cache.unionByName(cache.withColumn("model", F.lit("other"))))
    said = spark.createDataFrame([('ok {"score": 1.7, "level": " x "}',), ("none",)], "a string").select(models.coerce("a").alias("v")).collect()
    assert said[0]["v"]["score"] == 1.0 and said[0]["v"]["level"] == "inconnu" and said[1]["v"] is None


def test_report_views(spark):
    from gristmill.operators import report

    rows = spark.createDataFrame([(1, 0.12345, None, ["a"], ["a", "b"])], "ord int, score double, title string, title_families array<string>, families array<string>")
    assert report.snapshot(rows, "ord", "score", "title").first()["json"] == '{"ord":1,"score":0.123,"title":null}'
    assert rows.select(report.in_family("b"), report.in_family("b", wide=True)).first()[:] == (False, True)
    assert report.config_fingerprint({"a": 1, "b": 2}) == report.config_fingerprint({"b": 2, "a": 1})
    assert one(spark, sinks.short_value("x"), "y" * 60) == "y" * 55 + "…"
    shown = [(1, 0.5, ["A", "B"], True, "t", 6, "2027-01", "c", "", None, (0.9, True, "senior", list("abcd"), "r" * 150)), (12, 0.25, None, None, "u", None, "", "", "l", "s", None), (13, 0.0, [], False, "w", 0, None, "c", "l", "s", (0.1, False, "stage", [], " x\ny "))]
    rows = spark.createDataFrame(shown, "rank int, score double, tags array<string>, new boolean, title string, months int, start string, company string, location string, source string, verdict struct<score: double, apprenticeship: boolean, level: string, flags: array<string>, reason: string>")
    found = report.listing(rows).orderBy("rank").collect()
    assert [r["head"] for r in found] == ["#1   [0.500]  A B  🆕 t  (6 mois, début 2027-01)", "#12  [0.250]  u", "#13  [0.000]  w"]
    assert [r["place"] for r in found] == ["c  |  —  |  —", "—  |  l  |  s", "c  |  l  |  s"]
    assert [r["verdict"] for r in found] == ["LLM 0.90  ⚠ alternance  niveau=senior  🚩 a ; b ; c", None, "LLM 0.10"]
    assert [r["reason"] for r in found] == ["« " + "r" * 137 + "… »", None, "« x y »"]
    assert [r[0] for r in spark.createDataFrame([(6, "2027-01"), (3, "2027-05"), (None, None)], "m int, s string").select(rank.soft_signals("m", "s", "2027-01")).collect()] == pytest.approx([0.05, -0.02, 0.0])


def test_merges_and_outcomes(spark):
    before = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "ord int, source string")
    assert [tuple(r) for r in dedup.merged_away(before, before.where("ord <> 2"), "ord", "source").collect()] == [("a", 1)]
    terms = spark.createDataFrame([("Data", "x", 1), ("data", "y", 2)], "term string, family string, ord int")
    assert dedup.distinct_terms(terms, "term", "family", "ord").first()[1:] == ("Data", ["x", "y"])
    offers = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    texts = spark.createDataFrame([("a", "t")], "key string, text string")
    fetched = spark.createDataFrame([("b", "t"), ("c", " ")], "key string, text string")
    assert {r["outcome"]: r["n"] for r in store.backfill(offers, texts, fetched).collect()} == {"present": 1, "filled": 1, "empty": 1, "failed": 1}


def test_health_ladder(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("b", 0, 0), ("c", 10, 0), ("d", 9, 0), ("e", 5, 2)], "source string, raw int, survivors int")
    incidents = spark.createDataFrame([("b", "blocked"), ("e", "timeout"), ("e", "blocked")], "source string, category string")
    found = {r["source"]: r["health"] for r in observe.health(rows, incidents).collect()}
    assert found == {"a": "silent", "b": "silent_with_incident", "c": "sterile", "d": "healthy", "e": "degraded"}


def test_market_unknowns(spark):
    rows = spark.createDataFrame([(0, 0), (7, 31), (None, 5), (20, 31)], "short int, long int")
    assert [r[0] for r in rows.select(market.pace("short", "long")).collect()] == [None, 1.0, None, 2.86]
    assert [r[0] for r in rows.select(market.season(market.pace("short", "long"))).collect()] == ["unknown", "stable", "unknown", "accelerating"]


def test_travel_prefers_a_valid_measure(spark):
    places = spark.createDataFrame([(1, 2.0, 48.0), (2, 2.1, 48.1)], "place int, lon double, lat double")
    origins = spark.createDataFrame([("o", 2.0, 48.0)], "origin string, lon double, lat double")
    measured = spark.createDataFrame([(1, "o", 10.0, 2.0, 48.0), (2, "o", 10.0, 9.9, 48.1)], "place int, origin string, minutes double, lon double, lat double")
    found = {r["place"]: r["best"] for r in geo.travel(places, origins, measured).collect()}
    assert found[1] == 13.0 and found[2] != 13.0


RAW = {
    "adzuna": {"title": "A", "company": {"display_name": "C"}, "location": {"display_name": "L"}, "redirect_url": "u", "salary_min": 0, "salary_max": 900.7},
    "careerjet": {"title": "<b>A</b> &amp; B", "company": "", "locations": "L", "description": "d", "url": "u", "salary": "s"},
    "france_travail": {"id": "1", "intitule": "A &amp; <b>", "entreprise": {}, "lieuTravail": {"libelle": "75 - Paris"}, "origineOffre": {"urlOrigine": "u"}},
    "free_work": {"id": 3, "slug": "sl", "applicationUrl": " ", "title": "A", "job": {"nameForContributionSlug": "dev"}, "location": {"label": "", "adminLevel1": "IDF"}, "createdAt": "2024"},
    "jobspy": {"title": "A", "job_url": "u", "site": "", "min_amount": 5, "max_amount": 7, "currency": "USD"},
    "jooble": {"title": "A", "snippet": "<p>x</p>y", "link": "u", "salary": ""},
    "greenhouse": {"id": 4, "title": "A", "content": "&lt;p&gt;x&lt;/p&gt;", "absolute_url": "u", "location": {"name": "L"}},
    "lever": {"id": "5", "text": "A", "hostedUrl": "u", "createdAt": 1700000000000, "categories": {"location": "L"}},
    "ashby": {"id": "6", "title": "A", "jobUrl": "u", "isListed": True, "location": "L"},
}


def test_every_source_normalises_and_bad_rows_are_kept_aside(spark):
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in RAW.items()], "source string, json string")
    found = {r["source"]: r for r in normalize.normalise_all(rows)[0].collect()}
    assert len(found) == 9 and found["adzuna"]["salary"] == "jusqu'à 900 €" and found["careerjet"]["title"] == "A & B" and found["france_travail"]["title"] == "A & <b>"
    assert found["free_work"]["url"] == "https://www.free-work.com/fr/tech-it/dev/job-mission/sl" and found["free_work"]["location"] == "IDF" and found["jobspy:inconnu"]["salary"] == "5 - 7 USD"
    assert found["greenhouse"]["description"] == "x" and found["lever"]["posted_at"] == "2023-11-14T22:13:20+00:00" and found["lever"]["native_key"] == "id:5" and found["jooble"]["native_key"] == "url:u" and found["careerjet"]["native_key"].startswith("contenu:")
    bad = spark.createDataFrame([('{"title": "x"}',), ("{oops",), ('{"link": "u"}',)], "json string")
    offers, rejects = normalize.normalise(bad, "jooble")
    assert offers.count() == 0 and sorted(r["reason"] for r in rejects.collect()) == ["no title", "no url", "unparsable"]
    mixed = spark.createDataFrame([("nobody", "{}", "f"), ("ashby", json.dumps(RAW["ashby"] | {"isListed": False}), "f"), ("ashby", json.dumps(RAW["ashby"]), "g"), (None, None, None)], "source string, json string, family string")
    offers, rejects = normalize.normalise_all(mixed)
    assert [r["family"] for r in offers.collect()] == ["g"] and sorted(r["reason"] for r in rejects.collect()) == ["not listed", "unknown source", "unknown source"]
    boards = {
        "greenhouse": RAW["greenhouse"] | {"location": {"name": "Berlin; Rome"}, "offices": [{"name": "Paris", "location": None}]},
        "lever": RAW["lever"] | {"categories": {"location": "Rome", "allLocations": ["Rome", "Île-de-France"]}},
        "ashby": RAW["ashby"] | {"location": "Remote", "address": {"postalAddress": {"addressLocality": "Lille", "addressCountry": "France"}}},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in boards.items()], "source string, json string")
    assert {r["source"]: r["location"] for r in normalize.normalise_all(rows)[0].collect()} == {"greenhouse": "Paris", "lever": "Île-de-France", "ashby": "Lille, France"}
    wrapped = spark.createDataFrame([(json.dumps({"hydra:member": [RAW["free_work"]] * 2}),), (json.dumps([RAW["free_work"]]),), (json.dumps(RAW["free_work"]),)], "json string")
    assert normalize.normalise(normalize.unwrapped(wrapped), "free_work")[0].count() == 4


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.123456, "t", ["a", "b"]), (2, 0.5, None, [])], "ord int, score double, title string, tags array<string>")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("rang").collect()
    assert len(back[0]) == 20 and back[0]["score"] == "0.5" and back[1]["score"] == "0.1235" and back[1]["match"] == "a b"
    sinks.freeze(rows, str(tmp_path / "frozen"))
    assert spark.read.json(str(tmp_path / "frozen/manifest")).first()["rows"] == 2


def test_match_labels_reads_the_documents_once(spark, tmp_path):
    """Both sides of the match take keys that are computed once; labels find the offer by the key, markers and first lines aside."""
    texts = {1: "Chef (H/F)\nlong text", 2: "chef\nother", 7: "Ingénieur\n", 11: "Chef F/H", 12: "M/W Ingénieur\nb", 13: None, 14: "-"}
    spark.createDataFrame([(k, t, "site", "fr") for k, t in texts.items()], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k,) for k in [*texts, 99]], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    found = plans.QUERIES["match_labels"](spark, str(tmp_path))
    assert {r["doc_id"]: r["status"] for r in found.collect()} == {1: "ok", 2: "ok", 7: "incoherent", 11: "missing", 12: "incoherent", 13: "ok", 14: "ok"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("text#") == 0
