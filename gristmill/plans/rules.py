"""Queries over single rules: filters, text rules, labels, merges and caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import geo as gf
from gristmill.functions import text as tx
from gristmill.functions.columns import json_or_null
from gristmill.operators import dedup, filters, geo, market, models, observe, queue, rank, report, store
from gristmill.plans.offers import FAMILIES, OFFERS, pick, pick_sql, any_word
from gristmill.plans.registry import query
from gristmill.session import shared_dir
from gristmill.sources import sinks
from gristmill.sources.adapters import jobs, offers, places, ranking_rows, table

TODAY = "2024-03-10"
KEPT, FRESH = ["src1", "src2"], f"DATE '{TODAY}' - posted_at BETWEEN -1 AND 20"


@query(f"WITH {OFFERS} SELECT ord, {FRESH} OR company IN ('src1', 'src2') AS kept FROM offers")
def freshness_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh offers, and those of companies whose age doesn't matter."""
    rows = offers(spark, sf_dir).select("ord", F.lit("x").alias("title"), "company", "location", "posted_at")
    found = filters.reject_reasons(rows, ["x"], ["y"], ["en", "fr", "de", "es"], TODAY, 20, KEPT)
    return found.select("ord", F.col("reason").isNull().alias("kept"))


@query(f"""WITH {OFFERS} SELECT ord, concat_ws(',', 'old', CASE WHEN length(description) < 600 THEN 'short' END, CASE WHEN location = 'en' THEN 'english' END) AS flags
        FROM offers""")
def student_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft signals flag an offer and never reject it; a flag that is there isn't added again."""
    rows = offers(spark, sf_dir).withColumn("flags", F.array(F.lit("old")))
    rows = filters.soft_flag(filters.soft_flag(rows, "short", F.length("description") < 600), "english", F.col("location") == "en")
    return filters.soft_flag(rows, "old", F.lit(True)).select("ord", F.array_join("flags", ",").alias("flags"))


@query("SELECT doc_id FROM (SELECT doc_id, (doc_id % 100) / 100 AS score FROM documents) WHERE score >= 0.6 OR doc_id % 7 = 0")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers over a score, and those with the tag that overrides it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") % 100) / 100).alias("score"), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("A+B"))).otherwise(F.array(F.lit("A"))).alias("tags"))
    return filters.over_threshold(rows, 0.6, "A+B").select("doc_id")


@query("SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def only_new_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    new = rows.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")), "key", "left_anti")
    return filters.only_new(rows, new.unionAll(new))


SUPPORT, CORE = ["marketing", "legal", "rh"], ["data", "cyber"]
TITLES = ["Legal intern", "Data marketing", "RH & cyber", "Ingénieur", "Chargé RH", "Marketing-manager", "Illegal"]


@query(f"""SELECT p_partkey, {any_word('t', SUPPORT)} AND NOT {any_word('t', CORE)} AS support
        FROM (SELECT p_partkey, {pick_sql(TITLES, 'p_partkey', 'p_name')} AS t FROM part)""")
def support_occupations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", filters.support_only(pick(TITLES, "p_partkey", F.col("p_name")), SUPPORT, CORE).alias("support"))


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search(table(spark, sf_dir, "part"), "Brand#1", "p_name", "p_brand", "p_type").select("p_partkey")


@query(f"""WITH {OFFERS} SELECT ord, {any_word('title', FAMILIES['english'])} AS narrow, {any_word('title', FAMILIES['english'])} OR {any_word('description', FAMILIES['english'])} AS wide
        FROM offers""")
def family_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an offer is of a family by its title, and in the wide sense."""
    rows = offers(spark, sf_dir).select("ord", tx.families("title", FAMILIES).alias("title_families"), tx.families("description", FAMILIES).alias("families"))
    return rows.select("ord", report.in_family("english").alias("narrow"), report.in_family("english", wide=True).alias("wide"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(sha256(CAST(p_partkey AS VARCHAR)), (SELECT min(sha256(CAST(p_partkey AS VARCHAR)))[:24] FROM part))")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row whose key starts with a prefix, here that of the least key."""
    rows = table(spark, sf_dir, "part").withColumn("key", F.sha2(F.col("p_partkey").cast("string"), 256))
    prefix = rows.agg(F.min("key")).first()[0][:24]
    return filters.by_prefix(rows, "key", prefix).select("p_partkey", "p_name")


@query("SELECT doc_id, quality FROM labels")
def provenance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels, if none comes from elsewhere than the blind corpus; an error else."""
    rows = table(spark, sf_dir, "labels").withColumn("provenance", F.lit("corpus_aveugle"))
    return filters.require(rows, F.col("provenance") == "corpus_aveugle", "doc_id", "labels of another provenance").select("doc_id", "quality")


BROKEN = ["Hu002FF u00e9t", "u00", "no code", "cafu00e9 u00E9", "u00zz u0041", "a<b>&\"c\"'d'"]


@query(f"""SELECT p_partkey, replace(replace(replace(replace(replace(t, 'u002F', '/'), 'u00e9', 'é'), 'u00E9', 'é'), 'u0041', 'A'), 'u0009', chr(9)) AS text
        FROM (SELECT p_partkey, {pick_sql(BROKEN, 'p_partkey', 'p_name')} AS t FROM part)""")
def repaired_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.repair_escapes(pick(BROKEN, "p_partkey", F.col("p_name"))).alias("text"))


@query(f"""SELECT p_partkey, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS html
        FROM (SELECT p_partkey, {pick_sql(BROKEN, 'p_partkey', 'p_name')} AS t FROM part)""")
def escaped_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.escape_html(pick(BROKEN, "p_partkey", F.col("p_name"))).alias("html"))


SECRETS = ["GET /x?api_key=abc&q=1", "client_secret=s3 app_id=77", "Authorization: Bearer ab.c-d", "token=", "nothing", "monkey=1"]


@query(rf"""SELECT p_partkey, regexp_replace(regexp_replace(t, '(?i)\b((?:(?:api|app|client)?[_-]?)(?:key|secret|token|id)=)[^&\s]+', '\1***', 'g'), '(?i)(bearer\s+)\S+', '\1***', 'g') AS line
        FROM (SELECT p_partkey, {pick_sql(SECRETS, 'p_partkey', 'p_name')} AS t FROM part)""")
def masked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.mask_secrets(pick(SECRETS, "p_partkey", F.col("p_name"))).alias("line"))


@query("""SELECT event_id, CASE WHEN e THEN CASE WHEN b THEN 'blocked' WHEN contains(m, 'timed out') THEN 'timeout' ELSE 'refused' END END AS category, CASE WHEN e THEN b END AS blocking
    FROM (SELECT event_id, m, event_id % 5 = 0 OR contains(m, 'status code') AS e, contains(m, '429') OR contains(m, 'blocked') AS b
       
        FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'status code 429' WHEN 1 THEN 'read timed out' WHEN 2 THEN 'site blocked us' ELSE event_type END AS m
        FROM events))""")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines as refusals by kind; most are none."""
    k = F.col("event_id")
    said = F.when(k % 4 == 0, "status code 429").when(k % 4 == 1, "Read timed out").when(k % 4 == 2, "Site BLOCKED us").otherwise(F.col("event_type"))
    found = tx.refusal(F.when(k % 5 == 0, "error").otherwise("info"), said)
    return table(spark, sf_dir, "events").select("event_id", found["category"].alias("category"), found["blocking"].alias("blocking"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN event_type ELSE props END AS note FROM events")
def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    said = F.when(k % 3 == 0, F.lit(" \t  ")).when(k % 3 == 1, F.concat(F.lit("  "), "event_type", F.lit("\n"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", tx.comment(said).alias("note"))


SHOWN = ["Stage data (H/F) - 6 mois", "(H/F)", "Ingénieur - M/W/D", "Stage 12 mois, réseau"]


@query(f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Stage data' WHEN 1 THEN '(H/F)' WHEN 2 THEN 'Ingénieur' WHEN 3 THEN 'Stage , réseau' ELSE p_name END AS title
        FROM part""")
def presentable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.presentable_title(pick(SHOWN, "p_partkey", F.col("p_name"))).alias("title"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 6 THEN 0.03 WHEN p_size < 4 THEN -0.03 ELSE 0 END + CASE p_partkey % 4 WHEN 0 THEN 0.02 WHEN 1 THEN 0.01 ELSE 0 END AS signal
        FROM part""")
def soft_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("p_partkey") % 4 == 0, "2027-01").when(F.col("p_partkey") % 4 == 1, "2027-05").when(F.col("p_partkey") % 4 == 2, "2026-01")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(rank.soft_signals("p_size", start, "2027-01"), 6).alias("signal"))


@query("""WITH l AS (SELECT doc_id, quality = 1 AS domain, toxic = 1 AS apprentice, doc_id % 3 = 0 AS support, (doc_id % 101) / 100 AS score FROM labels)
    SELECT doc_id, CASE WHEN apprentice THEN CASE WHEN score > 0.2 THEN 0.2 ELSE score END WHEN (NOT domain OR support) AND score > 0.3 THEN 0.3 ELSE score END AS score, domain AND NOT support AS domain, domain AND support AS flagged
        FROM l""")
def capped_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard caps: apprenticeships, offers off the domain, and support occupations, which count as such and are flagged."""
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("domain_match"), (F.col("toxic") == 1).alias("apprentice"), ((F.col("doc_id") % 101) / 100).alias("score"), F.array().cast("array<string>").alias("flags"))
    ruled = rank.support_rule(rows, F.col("doc_id") % 3 == 0)
    return ruled.select("doc_id", rank.capped("score", F.col("apprentice"), ~F.col("domain_match")).alias("score"), F.col("domain_match").alias("domain"), (F.size("flags") > 0).alias("flagged"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text, ' \n\t'), '[ \n\t]+'), lambda w: w <> '')) > 200 AS cut FROM documents WHERE length(trim(text, ' \n\t')) > 0")
def encoder_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length(F.regexp_replace("text", r"\s+", "")) > 0)
    return docs.select("doc_id", models.truncated(F.regexp_replace("text", r"^\s+|\s+$", ""), 200).alias("cut"))


WHERE = ["92 - ST-CLOUD 92210", "Orly, Val-de-Marne - Paris", "Paris 8e / La Défense", "", "STE GENEVIEVE CEDEX 3"]


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'st cloud|92' WHEN 1 THEN 'orly|val de marne paris|val de marne|paris' WHEN 2 THEN 'paris|la defense' WHEN 3 THEN '' WHEN 4 THEN 'ste genevieve cedex 3' ELSE trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) END AS parts,
    CASE c_custkey % 6 WHEN 0 THEN 'saint cloud' WHEN 4 THEN 'ste genevieve cedex 3|sainte genevieve cedex 3|sainte genevieve' END AS forms
        FROM (SELECT c_custkey, regexp_replace(c_name, '[0-9]{5}', '', 'g') AS c_name FROM customer)""")
def location_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace("c_name", "[0-9]{5}", "")
    parts = gf.segments(pick(WHERE, "c_custkey", name))
    forms = F.when(F.col("c_custkey") % 6 == 4, F.array_join(gf.variants(F.get(parts, F.lit(0))), "|")).when(F.col("c_custkey") % 6 == 0, F.get(gf.variants(F.lit("st cloud")), F.lit(1)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(parts, "|").alias("parts"), forms.alias("forms"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'C' || c_nationkey ELSE lower(c_mktsegment) END AS city FROM customer")
def canonical_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commune's code where it is known, else the first part of the location."""
    people = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(", France")).alias("location"), "c_nationkey")
    codes = people.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("code"))
    return geo.canonical_city(people, codes, "c_custkey").select("c_custkey", "city")


@query("SELECT c_custkey AS place, CASE WHEN c_custkey % 4 = 0 THEN 13.0 END AS measured FROM customer")
def measured_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measured time counts while its coordinates are right; a quarter have one, and as many have one from elsewhere."""
    rows = places(spark, sf_dir)
    origins = spark.createDataFrame([("centre", 2.35, 48.85)], "origin string, lon double, lat double")
    known = rows.where("place % 4 < 2").select("place", F.lit("centre").alias("origin"), F.lit(10.0).alias("minutes"), F.when(F.col("place") % 4 == 0, F.col("lon")).otherwise(F.col("lon") + 1).alias("lon"), "lat")
    found = geo.travel(rows, origins, known)
    return found.select("place", F.when(F.col("place") % 4 == 0, F.col("best")).alias("measured"))


@query("""WITH t AS (SELECT p_partkey, p_type AS title, 'R' || (p_size % 5) AS code, round((p_partkey % 50) / 50.0, 3) AS score
        FROM part), b AS (SELECT title, code, max(score) AS score FROM t GROUP BY title, code)
    SELECT title, string_agg(code, ',' ORDER BY score DESC, code) AS codes, max(score) AS best FROM b GROUP BY title""")
def occupation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what a classifier says of a title, each occupation once with its best score, best first."""
    said = table(spark, sf_dir, "part").select(F.col("p_type").alias("title"), F.concat(F.lit("R"), (F.col("p_size") % 5).cast("string")).alias("code"), F.round((F.col("p_partkey") % 50) / 50, 3).alias("score"))
    found = market.best_occupations(said)
    return found.select("title", F.array_join(F.transform("occupations", lambda o: o["code"]), ",").alias("codes"), F.get("occupations", F.lit(0))["score"].alias("best"))


@query("""WITH c AS (SELECT DISTINCT 'src' || i AS source
        FROM range(30) x(i)), d AS (SELECT source, count(*) AS raw, count(*) FILTER (doc_id % 2 = 0 AND source <> 'src3') AS ok FROM documents
        GROUP BY source),
        k AS (SELECT source, 'blocked,timeout' AS kinds FROM c
        WHERE source IN ('src2', 'src28')), j AS (SELECT c.source, coalesce(raw, 0) AS raw, coalesce(ok, 0) AS ok, coalesce(kinds, '') AS kinds FROM c
        LEFT JOIN d USING (source) LEFT JOIN k USING (source))
    SELECT source, kinds, CASE WHEN raw = 0 AND kinds <> '' THEN 'silent_with_incident' WHEN raw = 0 THEN 'silent' WHEN raw >= 10 AND ok = 0 THEN 'sterile' WHEN kinds <> '' THEN 'degraded' ELSE 'healthy' END AS health
        FROM j""")
def source_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = table(spark, sf_dir, "documents").select("source", F.lit(True).alias("normalised"), F.when((F.col("doc_id") % 2 != 0) | (F.col("source") == "src3"), "x").alias("reason"), F.lit(False).alias("merged"))
    expected = spark.range(30).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    incidents = spark.createDataFrame([(s, c) for s in ("src2", "src28") for c in ("timeout", "blocked", "timeout")], "source string, category string")
    found = observe.health(observe.funnel(tagged, expected), incidents).join(expected, "source", "left_semi")
    return found.select("source", F.array_join("incidents", ",").alias("kinds"), "health")


@query("""WITH k AS (SELECT source, lang, max(length(text) * 1000000 - doc_id) AS best FROM documents
        GROUP BY source, lang), s AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
    SELECT s.source, n - count(*) AS merged FROM s JOIN k USING (source) GROUP BY s.source, n HAVING n > count(*)""")
def merge_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each source a merge has taken, here to one for each language."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "source", F.concat_ws("|", "source", "lang").alias("key"), F.length("text").alias("richness"))
    return dedup.merged_away(rows, dedup.keep_richest(rows), "ord", "source")


@query("""SELECT lower(p_type) AS folded, arg_min(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE upper(p_type) END, p_partkey) AS term, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS families
        FROM part GROUP BY lower(p_type)""")
def terms_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.upper("p_type")).alias("term"), F.col("p_brand").alias("family"), F.col("p_partkey").alias("ord"))
    return dedup.distinct_terms(rows, "term", "family", "ord").select("folded", "term", F.array_join("families", ",").alias("families"))


@query("""WITH k AS (SELECT user_id % 50 AS key, event_id AS ord, CAST(floor(value) AS INTEGER) AS rich, event_type AS fam
        FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rich DESC, ord) AS n FROM k)
    SELECT key, max(CASE WHEN n = 1 THEN ord END) AS ord, count(*) AS copies, array_to_string(list_sort(list_distinct(list(fam))), ',') AS families
        FROM r GROUP BY key""")
def absorbed_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest row of each key, with the families of all rows that it stands for."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("key"), F.col("event_id").alias("ord"), F.floor("value").cast("int").alias("richness"), F.array("event_type").alias("families"))
    return dedup.keep_richest(rows, gather=("families",)).select("key", "ord", "copies", F.array_join("families", ",").alias("families"))


@query("""SELECT k, v FROM (SELECT c_custkey AS k, 'old' AS v FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0
        UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0)""")
def memo_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return store.last_write(rows.where("k % 2 = 0").withColumn("v", F.lit("old")), rows.where("k % 3 = 0").withColumn("v", F.lit("new")), "k")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS v FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def cache_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    new = rows.where("k % 3 = 0").withColumn("v", F.lit("new"))
    return store.append_missing(rows.where("k % 2 = 0").withColumn("v", F.lit("old")), new.unionAll(new), "k")


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'done' ELSE 'done' END AS status FROM orders")
def queue_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending jobs start and running ones end; a move that isn't allowed would be an error."""
    rows = jobs(spark, sf_dir)
    moves = rows.where("status <> 'done'").select("id", F.when(F.col("status") == "pending", "running").otherwise("done").alias("to"))
    return queue.moved(rows, moves).select("id", "status")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS key FROM orders")
def repointed_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    moves = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"))
    return queue.repoint(children, moves, "key")


@query("""SELECT CASE WHEN c_custkey % 4 = 0 THEN 'present' WHEN c_custkey % 4 = 1 THEN 'filled' WHEN c_custkey % 4 = 2 THEN 'empty' ELSE 'failed' END AS outcome, count(*) AS n
        FROM customer GROUP BY 1""")
def backfill_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    fetched = rows.where("key % 4 IN (1, 2)").withColumn("text", F.when(F.col("key") % 4 == 1, "text").otherwise(" "))
    return store.backfill(rows, rows.where("key % 4 = 0"), fetched)


@query("SELECT event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"note\":null}' AS json FROM events")
def json_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON with their nulls; read again to show that each parses."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("note"))
    told = report.snapshot(rows, "id", "kind", "note")
    return told.select(json_or_null("json", "id bigint")["id"].alias("event_id"), "json")


@query("SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, sum(o_custkey) AS total FROM orders")
def frozen_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot with its manifest, as written and read back from the shared folder."""
    path = f"{shared_dir(spark)}/gristmill-frozen-{uuid.uuid4().hex}"
    manifest = sinks.freeze(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path)
    back = spark.read.parquet(f"{path}/data").agg(F.count_distinct("o_orderkey").alias("keys"), F.sum("o_custkey").alias("total"))
    return manifest.select("rows").join(F.broadcast(back))


@query("""SELECT doc_id AS key, doc_id % 90 + 1 AS ia_rank, 'doc ' || doc_id AS title, source AS company, '' AS salary, coalesce(CASE WHEN doc_id % 2 = 0 THEN 0.5 END, 0.0) AS score
        FROM documents""")
def ranking_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached ranking as landed JSON."""
    k = F.col("doc_id")
    said = F.to_json(F.struct(F.concat(F.lit("doc "), k.cast("string")).alias("title"), F.col("source").alias("company"), (k % 90 + 1).alias("ia_rang"), F.when(k % 2 == 0, 0.5).alias("cos_score")))
    return ranking_rows(table(spark, sf_dir, "documents").select(k.alias("key"), said.alias("json"))).select("key", "ia_rank", "title", "company", "salary", "score")
