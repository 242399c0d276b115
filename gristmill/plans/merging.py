"""Queries over merged offers, places inside locations, free dates and medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.dates import fuzzy_date
from gristmill.operators import dedup, geo, observe
from gristmill.plans.registry import query
from gristmill.sources.adapters import offers, table

TERMS = {"buy": ["purchase", "click"], "look": ["view", "click"], "wrong": ["error"], "new": ["signup", "view"]}
_TERMS_SQL = ", ".join(f"('{name}', '{word}')" for name, words in TERMS.items() for word in words)


@query(f"""WITH terms(family, word) AS (VALUES {_TERMS_SQL}), e AS (
        SELECT user_id % 40 AS key, event_id AS ord, CAST(floor(value) AS INTEGER) AS rich, event_type AS title, event_type || '-' || event_id AS url, event_type AS source, event_id % 25 AS link,
               [CASE event_id % 4 WHEN 0 THEN 'buy' WHEN 1 THEN 'look' WHEN 2 THEN 'wrong' ELSE 'new' END, CASE event_id % 3 WHEN 0 THEN 'look' WHEN 1 THEN 'new' ELSE 'buy' END] AS families FROM events
    ), r AS (
        SELECT *, coalesce(rich > max(rich) OVER (PARTITION BY key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM e
    ), p AS (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY best DESC, CASE WHEN best THEN -ord ELSE ord END) AS place FROM r
    ), f AS (
        SELECT key, family, min(place * 10 + i) AS pos FROM (SELECT key, place, unnest(families) AS family, generate_subscripts(families, 1) AS i FROM p) GROUP BY key, family
    ), l AS (
        SELECT key, source, link, min(place) AS pos, arg_min(url, place) AS url FROM p GROUP BY key, source, link
    ), told AS (SELECT key, string_agg(family, ',' ORDER BY pos) AS families FROM f GROUP BY key),
    linked AS (SELECT key, sha256(string_agg(source || ':' || link || ':' || url, ',' ORDER BY pos)) AS links, count(*) AS n_links FROM l GROUP BY key),
    named AS (SELECT key, coalesce(string_agg(DISTINCT f.family, ',' ORDER BY f.family) FILTER (title IN (SELECT word FROM terms t WHERE t.family = f.family)), '') AS title_families FROM f JOIN p USING (key) WHERE place = 1 GROUP BY key)
    SELECT key, ord, title, told.families, title_families, n_links, linked.links FROM p JOIN told USING (key) JOIN linked USING (key) JOIN named USING (key) WHERE place = 1""")
def absorbed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest row of each key with the links and families of all that it absorbs,
    in the order in which they were absorbed, and the families of its own title."""
    k = F.col("event_id")
    first = F.when(k % 4 == 0, "buy").when(k % 4 == 1, "look").when(k % 4 == 2, "wrong").otherwise("new")
    second = F.when(k % 3 == 0, "look").when(k % 3 == 1, "new").otherwise("buy")
    link = F.struct(F.col("event_type").alias("source"), (k % 25).cast("string").alias("key"), F.concat_ws("-", "event_type", k.cast("string")).alias("url"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("key"), k.alias("ord"), F.floor("value").cast("int").alias("richness"), F.col("event_type").alias("title"), F.array(first, second).alias("families"), F.array(link).alias("links"))
    found = dedup.absorb(rows, TERMS)
    told = F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["source"], x["key"], x["url"])), ",")
    return found.select("key", "ord", "title", F.array_join("families", ",").alias("families"), F.array_join(F.array_sort("title_families"), ",").alias("title_families"), F.size("links").cast("long").alias("n_links"), F.sha2(told, 256).alias("links"))


def greedy_sql(rows: str, dot: str, least: float) -> str:
    """The ordered pass by recursion over ``rows`` (ord, g, rich, embedding): the
    occupants of the slots and each row's slot, a row of an identity a step."""
    return f"""WITH RECURSIVE rows AS ({rows}), g AS (
        SELECT *, row_number() OVER (PARTITION BY g ORDER BY ord) AS n FROM rows WHERE g IS NOT NULL AND embedding IS NOT NULL
    ), near AS (
        SELECT e.g, e.n, list(a.ord) AS near FROM g e JOIN g a ON a.g = e.g AND a.ord <> e.ord AND {dot} >= {least} GROUP BY e.g, e.n
    ), s AS (
        SELECT g.g, g.n, ord, rich, coalesce(near, []) AS near FROM g LEFT JOIN near ON near.g = g.g AND near.n = g.n
    ), pass AS (
        SELECT g, n, [ord] AS kept, [rich] AS wealth, [ord] AS done, [1::BIGINT] AS slots FROM s WHERE n = 1
        UNION ALL
        SELECT g, n, CASE WHEN pos IS NULL THEN list_append(kept, ord) WHEN rich > wealth[pos] THEN kept[:pos - 1] || [ord] || kept[pos + 1:] ELSE kept END,
               CASE WHEN pos IS NULL THEN list_append(wealth, rich) WHEN rich > wealth[pos] THEN wealth[:pos - 1] || [rich] || wealth[pos + 1:] ELSE wealth END,
               list_append(done, ord), list_append(slots, coalesce(pos, len(kept) + 1)) FROM (
            SELECT s.g, s.n, s.ord, s.rich, kept, wealth, done, slots, list_position(kept, list_filter(kept, lambda x: list_contains(s.near, x))[1]) AS pos
            FROM pass JOIN s ON s.g = pass.g AND s.n = pass.n + 1)
    ), ended AS (
        SELECT arg_max(kept, n) AS kept, unnest(arg_max(done, n)) AS ord, unnest(arg_max(slots, n)) AS slot FROM pass GROUP BY g
    )
    SELECT rows.ord, coalesce(kept[slot], rows.ord) AS representative FROM rows LEFT JOIN ended USING (ord)"""


SAME = "list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))"


@query(greedy_sql("SELECT doc_id AS ord, source || '|' || lang AS g, length(text) + 30 AS rich, embedding FROM documents JOIN embeddings ON vec_id = doc_id % 60 WHERE source <> ''", SAME, 0.9))
def fuzzy_dedup_communes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered merge at 0.90 under company and commune code; vectors are shared by rows of equal remainder."""
    rows = offers(spark, sf_dir).select("ord", F.lit("").alias("title"), "company", F.concat(F.lit("12345 "), F.upper("location")).alias("location"), (F.length("description") + 30).alias("richness"))
    communes = table(spark, sf_dir, "documents").select(F.col("lang").alias("name"), F.concat(F.lit("C-"), "lang").alias("code"), F.lit("00").alias("department")).distinct()
    coded = rows.join(geo.resolve_commune(rows, communes), "ord")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    guarded = coded.select("ord", F.to_json(dedup.mergeable_identity(commune="code")).alias("guard"), "richness").join(vectors, F.col("ord") % 60 == F.col("_v"))
    return dedup.fuzzy_survivors(guarded.drop("_v"), 0.9)


@query("""WITH communes AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'des ' || lower(n_name) ELSE lower(n_name) END AS name, lower(n_name) AS bare, 'C' || n_nationkey AS code FROM nation),
    places AS (SELECT lower(r_name) || ' airport' AS phrase, 'R' || r_regionkey AS code FROM region UNION ALL SELECT 'airport', 'A'),
    l AS (SELECT c_custkey, n_name, r_name, 'C' || n_nationkey AS nation, 'R' || r_regionkey AS region, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN nation WHEN 1 THEN NULL WHEN 2 THEN region WHEN 3 THEN nation WHEN 4 THEN nation WHEN 5 THEN 'A' END AS code FROM l""")
def place_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of places in seven wordings: communes with and without an article, a
    sign from elsewhere that bars all, and named places inside a location, the longest name first."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    article = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Des "), "n_name")).otherwise(F.col("n_name"))
    communes = nations.select(article.alias("name"), F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("code"), F.lit("00").alias("department"))
    names = regions.select(F.concat("r_name", F.lit("-Airport")).alias("name"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code")).unionByName(spark.range(1).select(F.lit("Airport").alias("name"), F.lit("A").alias("code")))
    people = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey") % 7
    said = {0: ("", "n_name", ", FR"), 1: ("", "n_name", ", TX"), 2: ("Near ", "r_name", " Airport, gate 7"), 3: ("12 - ", "n_name", " 12345"), 4: ("Zone A / ", "n_name", " 3e arrondissement"), 5: ("The airport of ", "c_mktsegment", ""), 6: ("Nowhere ", "c_mktsegment", "")}
    where = F.coalesce(*(F.when(k == n, F.concat(F.lit(a), c, F.lit(b))) for n, (a, c, b) in said.items()))
    rows = people.select("c_custkey", where.alias("location"))
    return geo.resolve_commune(rows, communes, "c_custkey", named=names, barrier=True).select("c_custkey", "code")


#: A day in free wordings, by the order's key, and what a reference date of 2024-03-31 makes of each.
WORDINGS = [
    ("'Posted on ' || strftime(d, '%B %-d, %Y') || ' at 10:30'", "d"), ("strftime(d, '%-d %b %Y') || ' (updated 09:15:00)'", "d"), ("'the ' || strftime(d, '%-d') || 'th of ' || strftime(d, '%B')", "make_date(2024, month(d), day(d))"),
    ("'since ' || strftime(d, '%B %Y')", "make_date(year(d), month(d), least(31, day(last_day(make_date(year(d), month(d), 1)))))"), ("'in ' || strftime(d, '%Y')", "make_date(year(d), 3, 31)"), ("strftime(d, '%B')", "make_date(2024, month(d), day(last_day(make_date(2024, month(d), 1))))"),
    ("strftime(d, '%Y-%m-%d') || 'T08:00:00Z'", "d"), ("'no date here'", "NULL"), ("strftime(d, '%A')", "DATE '2024-03-31' + CAST((isodow(d) + 7 - isodow(DATE '2024-03-31')) % 7 AS INTEGER)"),
]
_SAYS = " ".join(f"WHEN {k} THEN {sql}" for k, (_, sql) in enumerate(WORDINGS))


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(WORDINGS)} {_SAYS} END AS day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE day(o_orderdate) <= 28)")
def free_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days told in nine wordings, with missing parts taken from a reference date."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).where(F.dayofmonth("d") <= 28)
    say = lambda *parts: F.concat(*(F.date_format("d", p[1:]) if p.startswith("%") else F.lit(p) for p in parts))
    said = [
        say("Posted on ", "%MMMM d, yyyy", " at 10:30"), say("%d MMM yyyy", " (updated 09:15:00)"), say("the ", "%d", "th of ", "%MMMM"), say("since ", "%MMMM yyyy"), say("in ", "%yyyy"), say("%MMMM"), say("%yyyy-MM-dd", "T08:00:00Z"), F.lit("no date here"), say("%EEEE"),
    ]
    text = F.coalesce(*(F.when(F.col("o_orderkey") % len(said) == k, t) for k, t in enumerate(said)))
    return rows.select("o_orderkey", fuzzy_date(text, F.lit("2024-03-31").cast("date")).alias("day"))


@query("""WITH d AS (SELECT 'src' || i AS source FROM range(2, 40) x(i)), o AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
    SELECT coalesce(d.source, o.source) AS source, coalesce(n, 0) AS n, d.source IS NOT NULL AS expected FROM d FULL OUTER JOIN o ON o.source = d.source""")
def observed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of expected sources, 0 where one is silent, and of those that nobody expected."""
    expected = spark.range(2, 40).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    return observe.all_counts(table(spark, sf_dir, "documents").select("source"), expected, "source")
