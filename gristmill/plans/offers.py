"""Queries over documents as offers: duplicates, filters, text, ranking, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions.dates import allowed_window, parse_date
from gristmill.functions.geo import preferred_location
from gristmill.functions.url import normal_url
from gristmill.functions.vector import dot, unit
from gristmill.operators import dedup, evaluate, filters, geo, models, observe, rank, report, store
from gristmill.plans.merging import greedy_sql
from gristmill.plans.registry import query
from gristmill.session import cut
from gristmill.sources import sinks
from gristmill.sources.adapters import keyed_offers, offers, table, with_vectors
from gristmill.sources.normalize import normalised

TODAY = "2024-03-10"
WANTED, UNWANTED, REGIONS = ["the", "der", "la", "de"], ["idiot", "clown"], ["en", "fr", "de"]
FIRST, SECOND = ["the", "des"], ["of", "los", "und"]
FAMILIES = {"english": ["the", "and"], "french": ["les", "des"], "german": ["der", "und"], "spanish": ["los", "del"]}
WEIGHTS = {0: 1.0, 1: 0.7, 2: 1.2}
SIMILAR = 0.35

OFFERS = """offers AS (
    SELECT doc_id AS ord, split_part(text, chr(10), 1) AS title, source AS company, lang AS location, text AS description,
           DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS posted_at
    FROM documents)"""
FORM = "' ' || trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g')) || ' '"
#: The rules for titles and cities as SQL.
_RUNS = f"regexp_extract_all(lower(strip_accents({{0}})), '{tx.LETTERS}')"
_UNMARKED = f"list_reduce({_RUNS}, lambda t, r: CASE WHEN list_contains({tx.MARKERS}, regexp_replace(r, '[^a-z]', '', 'g')) THEN replace(t, r, ' ') ELSE t END, lower(strip_accents({{0}})))"
TITLE = f"trim(regexp_replace({_UNMARKED}, '[^a-z0-9]+', ' ', 'g'))"
CITY = r"trim(regexp_replace(regexp_replace(lower(strip_accents(split_part({0}, ',', 1))), '[^a-z0-9]+', ' ', 'g'), '\bparis\b.*', 'paris'))"
KEYED = OFFERS + r""", keyed AS (
    SELECT *, sha1(concat_ws('|',
        TITLE_KEY(title), lower(company), CITY_KEY(location))) AS key, length(description) + 30 AS richness
    FROM offers)""".replace("TITLE_KEY(title)", TITLE.replace("{0}", "title")).replace("CITY_KEY(location)", CITY.replace("{0}", "location"))


def any_word(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({FORM.format(column)}, ' {w} ')" for w in words) + ")"


BOOSTED = f"""boosted AS (
    SELECT *, {any_word('title', FIRST)} AS t1, {any_word('title', SECOND)} AS t2, {any_word('description', FIRST)} AS d1, {any_word('description', SECOND)} AS d2
        FROM offers
), scored AS (
    SELECT *, (t1 OR d1) AND (t2 OR d2) AND (t1 OR t2) AS combo,
           (CASE WHEN t1 THEN 0.05 WHEN d1 THEN 0.02 ELSE 0 END) + (CASE WHEN t2 THEN 0.05 WHEN d2 THEN 0.02 ELSE 0 END)
           + (CASE WHEN (t1 OR d1) AND (t2 OR d2) AND (t1 OR t2) THEN 0.15 ELSE 0 END) AS boost FROM boosted)"""
#: Similarity of every document; null without a vector.
SIMS = """sims AS (
    SELECT doc_id AS ord, sims FROM documents LEFT JOIN (
        SELECT e.vec_id, {0} AS sims
        FROM embeddings e, (VALUES (0, 1.0), (1, 0.7), (2, 1.2)) p(profile, weight), embeddings a
        WHERE a.vec_id = p.profile GROUP BY e.vec_id) ON vec_id = doc_id)"""
DOT = "list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))"
MAX_SIM, MEAN_SIM = f"max({DOT} * CAST(weight AS DOUBLE))", f"sum({DOT} * CAST(weight AS DOUBLE)) / sum(CAST(weight AS DOUBLE))"


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*WEIGHTS)).select(F.col("vec_id").alias("profile"), F.col("embedding").alias("vector"), F.try_element_at(weight, F.col("vec_id").cast("int")).alias("weight"))


def _similar(spark: SparkSession, sf_dir: str, how: str = "max") -> DataFrame:
    return rank.profile_similarity(offers(spark, sf_dir, vectors=True), _profiles(spark, sf_dir), how)


def _boosted(spark: SparkSession, sf_dir: str, how: str = "max", keep: tuple[str, ...] = ("title",)) -> DataFrame:
    """Boosts and similarity of every offer. Boosts come first, where the texts are read; only ``keep`` goes on into the join."""
    rows = rank.boosts(offers(spark, sf_dir), FIRST, SECOND).select("ord", *keep, "boost", "tags", "combo")
    return rank.profile_similarity(with_vectors(rows, spark, sf_dir), _profiles(spark, sf_dir), how)


def _mode_sql(score: str, tier: str = "0", norm: str = "0") -> str:
    return f"""WITH {OFFERS}, {BOOSTED}, {SIMS.format(MAX_SIM)}, joined AS (
        SELECT s.ord, b.boost, b.combo, s.sims, {norm} AS norm FROM sims s JOIN scored b USING (ord)
    ), final AS (SELECT ord, {tier} AS tier, {score} AS score FROM joined)
    SELECT ord, tier, round(score, 6) AS score, row_number() OVER (ORDER BY tier DESC, score DESC NULLS LAST, ord) AS rank FROM final QUALIFY rank <= 50"""


def _mode(rows: DataFrame, mode: str) -> DataFrame:
    return rank.top(rank.compose(rows, mode), 50).select("ord", "tier", F.round("score", 6).alias("score"), "rank")


MINMAX = "(s.sims - min(s.sims) OVER ()) / (max(s.sims) OVER () - min(s.sims) OVER ())"
ZSCORE = "(s.sims - avg(s.sims) OVER ()) / stddev_pop(s.sims) OVER ()"


@query(f"""WITH {KEYED}, best AS (SELECT ord FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY richness DESC, ord) = 1),
    {BOOSTED}, {SIMS.format(MAX_SIM)}, joined AS (
        SELECT s.ord, b.title, b.boost, s.sims, {MINMAX} AS norm FROM sims s JOIN scored b USING (ord) WHERE s.ord IN (SELECT ord FROM best)
    ), final AS (SELECT ord, title, norm + boost AS score FROM joined)
    SELECT ord, title, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC NULLS LAST, ord) AS rank FROM final QUALIFY rank <= 20""")
def rank_offers_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: exact duplicates resolved, similarity to weighted profiles, normalised over the run, boosted, best 20.

    What is computed of an offer is written once, as numbers and its title, before the run's range is taken."""
    survivors = dedup.keep_richest(keyed_offers(spark, sf_dir).select("key", "ord", "richness")).select("ord")
    scored = cut(_boosted(spark, sf_dir).select("ord", "title", "sims", "boost", "combo").join(survivors, "ord", "left_semi"))
    return rank.top(rank.compose(rank.normalised(scored), "additive_norm"), 20).select("ord", "title", F.round("score", 6).alias("score"), "rank")


@query(_mode_sql("CASE WHEN sims + boost > 1 THEN 1 ELSE sims + boost END"))
def rank_mode_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(_boosted(spark, sf_dir), "additive")


@query(_mode_sql("sims * (1 + boost)"))
def rank_mode_multiplicative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(_boosted(spark, sf_dir), "multiplicative")


@query(_mode_sql("sims", "CASE WHEN combo THEN 2 WHEN boost > 0 THEN 1 ELSE 0 END"))
def rank_mode_lexicographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(_boosted(spark, sf_dir), "lexicographic")


@query(_mode_sql("norm + boost", norm=ZSCORE))
def rank_mode_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cut(_boosted(spark, sf_dir).select("ord", "sims", "boost", "combo"))
    return _mode(rank.normalised(scored, how="zscore"), "additive_norm")


@query(f"WITH {SIMS.format(MEAN_SIM)} SELECT ord, round(sims, 6) AS sims FROM sims")
def rank_profiles_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, "mean").select("ord", F.round("sims", 6).alias("sims"))


@query(f"""WITH {OFFERS}, {BOOSTED} SELECT ord, round(boost, 4) AS boost, concat_ws('|', CASE WHEN t1 OR d1 THEN 'A' END, CASE WHEN t2 OR d2 THEN 'B' END, CASE WHEN combo THEN 'A+B' END) AS tags
        FROM scored""")
def keyword_boost_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.boosts(offers(spark, sf_dir), FIRST, SECOND).select("ord", F.round("boost", 4).alias("boost"), F.array_join("tags", "|").alias("tags"))


@query(f"""WITH {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY richness DESC, ord) AS n, count(*) OVER (PARTITION BY key) AS copies FROM keyed)
    SELECT key, ord, richness, copies FROM r WHERE n = 1""")
def exact_dedup_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_richest(keyed_offers(spark, sf_dir).select("key", "ord", "richness")).select("key", "ord", "richness", "copies")


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_offers(spark, sf_dir, vectors=True).select("ord", F.to_json(dedup.mergeable_identity()).alias("guard"), "richness", "embedding")


@query(f"""WITH {OFFERS}, g AS (SELECT ord, embedding, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS c, location AS l,
        list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(title, '(^|[^0-9,.])([0-9]{{1,2}}) ?[hH]([^a-zA-Z0-9_]|$)', 2), lambda x: CAST(x AS INTEGER)), lambda h: h BETWEEN 1 AND 40))) AS hours
        FROM offers JOIN embeddings ON vec_id = ord)
    SELECT e.ord AS a, a.ord AS b, round({DOT}, 6) AS similarity FROM g e JOIN g a ON e.c = a.c AND e.l = a.l AND e.hours = a.hours AND e.ord < a.ord
    WHERE e.c <> '' AND e.l <> '' AND {DOT} >= {SIMILAR}""")
def fuzzy_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs under the mergeable identity: same company, city and hours."""
    return dedup.similar_pairs(_guarded(spark, sf_dir).where("guard IS NOT NULL AND embedding IS NOT NULL"), SIMILAR).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(greedy_sql(
    rf"""SELECT doc_id AS ord, CASE WHEN c <> '' AND lang <> '' THEN c || '|' || lang || '|' || CAST(hours AS VARCHAR) END AS g, length(text) + 30 AS rich, embedding FROM (
        SELECT *, trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS c, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(split_part(text, chr(10), 1), '(^|[^0-9,.])([0-9]{{1,2}}) ?[hH]([^a-zA-Z0-9_]|$)', 2), lambda x: CAST(x AS INTEGER)), lambda h: h BETWEEN 1 AND 40))) AS hours
        FROM documents) LEFT JOIN embeddings ON vec_id = doc_id""", DOT, SIMILAR))
def fuzzy_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.fuzzy_survivors(_guarded(spark, sf_dir), SIMILAR)


@query("""WITH e AS (SELECT event_type AS source, user_id AS native, event_id AS ord, CAST(floor(value / 50) AS BIGINT) AS fam FROM events)
    SELECT source, native, min(ord) AS ord, array_to_string(list_sort(list_distinct(list(CAST(fam AS VARCHAR)))), ',') AS families FROM e GROUP BY source, native""")
def intra_source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("native"), F.col("event_id").alias("ord"), F.array(F.floor(F.col("value") / 50).cast("string")).alias("families"))
    return dedup.merge_by_native_id(rows, "source", "native", "ord", "families").withColumn("families", F.array_join("families", ","))


@query("""WITH s AS (SELECT event_id AS key, user_id AS new_key, CAST(ts AS DATE) AS seen, event_id % 7 AS views FROM events)
    SELECT new_key, arg_max(key, (seen, key)) AS survivor, min(seen) AS first_seen, max(seen) AS last_seen, max(views) AS views, count(*) AS merged, max(CASE WHEN key <> new_key THEN 1 ELSE 0 END) AS moved
        FROM s GROUP BY new_key""")
def key_migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("user_id").alias("new_key"), F.to_date("ts").alias("seen"), F.pmod("event_id", F.lit(7)).alias("views"))
    return dedup.migrate_keys(rows, "key", "new_key", "seen", "seen", "views")


REASON = f"""CASE WHEN NOT {any_word('title', WANTED)} THEN 'off_topic' WHEN {any_word('title', UNWANTED)} THEN 'excluded'
    WHEN location NOT IN ('en', 'fr', 'de') THEN 'off_region' WHEN NOT (DATE '{TODAY}' - posted_at BETWEEN -1 AND 50) THEN 'too_old' END"""


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.reject_reasons(offers(spark, sf_dir), WANTED, UNWANTED, REGIONS, TODAY, 50)


@query(f"WITH {OFFERS} SELECT ord, {REASON} AS reason FROM offers")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir).select("ord", "reason")


@query(f"""WITH {OFFERS}, t AS (SELECT company AS source, length(title) > 3 AS ok, {REASON} AS reason, ord % 9 = 0 AS merged FROM offers)
    SELECT source, count(*) AS raw, count(*) FILTER (ok) AS normalised, count(*) FILTER (ok AND reason IS NULL) AS survivors,
           count(*) FILTER (ok AND reason IS NULL AND merged) AS merged, count(*) FILTER (NOT ok) AS lost, count(*) FILTER (ok AND reason IS NULL AND NOT merged) AS retained,
           count(*) FILTER (ok AND reason IS NOT NULL) AS rejected FROM t GROUP BY source""")
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _filtered(spark, sf_dir).select(F.col("company").alias("source"), (F.length("title") > 3).alias("normalised"), "reason", (F.pmod("ord", F.lit(9)) == 0).alias("merged"))
    return observe.funnel(tagged).withColumn("rejects", F.aggregate("rejects", F.lit(0).cast("long"), lambda s, r: s + r["n"])).withColumnRenamed("rejects", "rejected")


@query(f"""WITH {OFFERS}, t AS (SELECT company AS source, {REASON} AS reason
        FROM offers), c AS (SELECT source, count(*) AS raw, count(*) FILTER (reason IS NULL) AS survivors FROM t GROUP BY source),
    s AS (SELECT 'src' || i AS source FROM range(25) x(i))
    SELECT source, coalesce(raw, 0) AS raw, coalesce(survivors, 0) AS survivors, CASE WHEN raw IS NULL THEN 'silent' WHEN raw >= 10 AND survivors = 0 THEN 'sterile' ELSE 'healthy' END AS health
        FROM s LEFT JOIN c USING (source)""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _filtered(spark, sf_dir).select(F.col("company").alias("source"), F.lit(True).alias("normalised"), "reason", F.lit(False).alias("merged"))
    expected = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    return observe.health(observe.funnel(tagged, expected)).select("source", "raw", "survivors", "health")


@query(f"""WITH {OFFERS} SELECT ord, sha256(lower(trim(title)) || '|' || lower(trim(company)) || '|' || lower(trim(location)) || '|' || lower(trim(description))) AS hash
        FROM offers""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("ord", tx.content_hash("title", "company", "location", "description").alias("hash"))


#: Locations as sources write them, by the customer's key; the last keeps its name.
WRITTEN = ["Grand Paris Sud, France", "Parisot, 82", "Évry-Courcouronnes, 91", "PARIS 12e Arrondissement", "Saint Denis", "Saint-Denis, IDF", " L'Haÿ-les-Roses ", "Le Petit-Paris / Nord, x"]


def pick(texts: list[str], key: str, otherwise: Column) -> Column:
    """One of the texts by the key, or for the keys in between the other column."""
    at = F.pmod(key, F.lit(len(texts) + 1)).cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, texts)), at), otherwise)


def pick_sql(texts: list[str], key: str, otherwise: str) -> str:
    cases = " ".join("WHEN {} THEN '{}'".format(k, t.replace("'", "''")) for k, t in enumerate(texts))
    return f"CASE {key} % {len(texts) + 1} {cases} ELSE {otherwise} END"


@query(f"SELECT c_custkey, {CITY.replace('{0}', pick_sql(WRITTEN, 'c_custkey', 'c_name'))} AS city FROM customer")
def city_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tx.city_key(pick(WRITTEN, "c_custkey", F.col("c_name"))).alias("city"))


MARKED = [" (H/F)", " H-F", " m/w/d", " (x/f/m)", " - F / H", " RH F/H", " Freshfields", " [M / W]", " (h - f) à Évry", " f/h/f"]


@query(f"SELECT p_partkey, {TITLE.replace('{0}', 'p_name || ' + pick_sql(MARKED, 'p_partkey', repr('')))} AS title FROM part")
def normal_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.normal_title(F.concat("p_name", pick(MARKED, "p_partkey", F.lit("")))).alias("title"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN CAST(p_size AS VARCHAR)
        WHEN 4 THEN CASE WHEN p_size = 20 THEN '20' ELSE least(p_size, 20) || ',' || greatest(p_size, 20) END WHEN 5 THEN '' ELSE '' END AS hours
    FROM (SELECT p_partkey, p_size % 40 + 1 AS p_size FROM part)""")
def hours_in_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_size") % 40 + 1).cast("string")
    kinds = [F.concat(F.lit("CDI "), n, F.lit("H")), F.concat(n, F.lit("h30 le matin")), F.concat(F.lit("7,"), n, F.lit("h")), F.concat(n, F.lit(" h/semaine")), F.concat(n, F.lit("h ou 20h")), F.concat(n, F.lit("hp")), F.lit("99h, 0 h")]
    title = F.coalesce(*(F.when(F.col("p_partkey") % 7 == k, t) for k, t in enumerate(kinds)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(dedup.hours_in_title(title), lambda h: h.cast("string")), ",").alias("hours"))


STUDIED = ["Sénior", "profil confirmé", "Expert(e)", "JUNIOR", "Jeune diplômé", "Stagiaire", "PhD student", "junior expert", "Bac+5", "stage", "intern"]


@query(f"""SELECT p_partkey, CASE WHEN t IN ('senior', 'junior', 'stage', 'inconnu') THEN t WHEN t SIMILAR TO '.*(senior|confirme|expert).*' THEN 'senior' WHEN t SIMILAR TO '.*(junior|debutant|jeune diplome).*' THEN 'junior'
        WHEN t SIMILAR TO '.*(stag|etudiant|intern|student).*' THEN 'stage' ELSE 'inconnu' END AS level
    FROM (SELECT p_partkey, trim(lower(strip_accents({pick_sql(STUDIED, 'p_partkey', 'p_type')}))) AS t FROM part)""")
def level_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.level(pick(STUDIED, "p_partkey", F.col("p_type"))).alias("level"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(lower(strip_accents(p_name)), '[a-z0-9]+'), '_') AS slug FROM part")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.slug("p_name").alias("slug"))


@query(f"WITH {OFFERS} SELECT ord, {FORM.format('title')} AS form FROM offers")
def word_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("ord", tx.word_form("title").alias("form"))


@query(f"""WITH {OFFERS} SELECT ord, concat_ws(',', {', '.join(f'CASE WHEN {any_word("description", w)} THEN {n!r} END' for n, w in FAMILIES.items())}) AS families
        FROM offers""")
def term_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("ord", F.array_join(tx.families("description", FAMILIES), ",").alias("families"))


@query(f"""WITH {OFFERS}, e AS (SELECT company, unnest(list_filter([{', '.join(f'CASE WHEN {any_word("description", w)} THEN {n!r} END' for n, w in FAMILIES.items())}], lambda x: x IS NOT NULL)) AS family, {REASON} IS NULL AS survivor
        FROM offers)
    SELECT family, count(*) AS raw, count(*) FILTER (survivor) AS survivors FROM e GROUP BY family""")
def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _filtered(spark, sf_dir).select(tx.families("description", FAMILIES).alias("families"), F.col("reason").isNull().alias("survivor"))
    return observe.family_counts(rows, "families", "survivor")


@query("""WITH t AS (SELECT p_partkey AS k, p_size % 30 AS n, p_partkey % 12 + 1 AS m FROM part)
    SELECT k AS p_partkey, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN n BETWEEN 1 AND 24 THEN n END WHEN 2 THEN CASE WHEN n > 0 THEN greatest(1, CAST(round_even(n / 4.33, 0) AS INTEGER)) END
            WHEN 3 THEN CASE WHEN n BETWEEN 1 AND 24 THEN greatest(n, 4) ELSE 4 END WHEN 4 THEN CASE WHEN n BETWEEN 1 AND 24 THEN n END WHEN 5 THEN 6 ELSE 12 END AS months,
        CASE k % 7 WHEN 1 THEN printf('2027-%02d', CAST(m AS INTEGER)) WHEN 2 THEN '2026-09' WHEN 3 THEN printf('2027-%02d', CAST(m AS INTEGER)) WHEN 4 THEN printf('2028-%02d', CAST(m AS INTEGER)) WHEN 5 THEN '2026-09' WHEN 6 THEN '2027-02' END AS start
        FROM t""")
def duration_and_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations and starts in seven wordings."""
    n, month = (F.col("p_size") % 30).cast("string"), (F.pmod("p_partkey", F.lit(12)) + 1).cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kinds = [
        F.col("p_name"), text("For ", n, " months from ", F.lpad(month, 2, "0"), "/2027."), text("Durée : ", n, " semaines, dès septembre 2026"), text("De 4 à ", n, " mois, ", F.lpad(month, 2, "0"), "-2027"),
        text(n, "-month internship, 2028/", month), text("6 months, 2026-09 then 03/2027"), text("12 mois, FÉVRIER 2027 puis mars 2026"),
    ]
    said = F.coalesce(*(F.when(F.col("p_partkey") % len(kinds) == k, t) for k, t in enumerate(kinds)))
    # Parts are few bytes each: a file of very many is one task's by its size, though each takes its time.
    dealt = table(spark, sf_dir, "part").select("p_partkey", said.alias("said")).repartition(2 * spark.sparkContext.defaultParallelism)
    return dealt.select("p_partkey", tx.duration_months("said").alias("months"), tx.start_month("said").alias("start"))


#: Openings by the part's key, each after some other text.
OPENED = ["Nous. Vos principales missions sont", "Acme! MISSION : coder", "About us. What you'll do here", "Votre rôle", "Le poste est rattaché à", "The rope. Responsibilities include", "rien de tel"]


@query(f"""SELECT p_partkey, substr(t, coalesce(list_min(list_filter(list_transform({tx.OPENINGS!r}, lambda p: strpos(lower(strip_accents(t)), p)), lambda k: k > 0)), 1), 40) AS excerpt FROM (
        SELECT p_partkey, p_name || '. ' || {pick_sql(OPENED, 'p_partkey', 'p_type')} || p_type AS t FROM part)""".replace('"what you\'ll do"', "'what you''ll do'").replace('"au sein de l\'equipe"', "'au sein de l''equipe'"))
def text_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts from where an advert says what the work is."""
    text = F.concat("p_name", F.lit(". "), pick(OPENED, "p_partkey", F.col("p_type")), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", tx.mission_excerpt(text, 40).alias("excerpt"))


DECODED = r"regexp_replace(regexp_replace(coalesce(html, ''), '(?i)<\s*(br|/p|/div|/li)\s*/?\s*>', ' ', 'g'), '<[^>]+>', '', 'g')"
for _name, _sign in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("nbsp", "chr(160)"), ("copy", "chr(169)"), ("middot", "chr(183)"), ("amp", "'&'")):
    DECODED = f"replace(replace({DECODED}, '&{_name};', {_sign}), '&{_name}', {_sign})"


@query(rf"SELECT page_id, regexp_replace(regexp_replace({DECODED}, '[ \t\x{{A0}}]+', ' ', 'g'), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g') AS text FROM pages")
def strip_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL decodes the references that the given pages have."""
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html("html").alias("text"))


TRACKERS = "('se', 'v', 'fbclid', 'gclid', 'ref', 'refid', 'src', 'trk', 'trackingid', 'tracking_id')"
#: What sources append to an address, by the page's key.
APPENDED = ["?b=2&a=1", "?utm_source=x&q=a+b%20c", "?V=1&Se=2", "?a=&b", "/#top", "?x=1&x=0&ref=me", "?k=%C3%A9~*", ""]


@query(rf"""WITH p AS (SELECT page_id, regexp_replace(trim(url || {{APPENDED}}), '#.*$', '') AS u FROM pages),
    q AS (SELECT page_id, split_part(u, '?', 1) AS base, CASE WHEN contains(u, '?') THEN regexp_extract(u, '\?(.*)$', 1) ELSE '' END AS qs FROM p),
    n AS (SELECT page_id, base, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1) AS host, list_filter(string_split(qs, '&'), lambda x: x <> '') AS parts
        FROM q),
    k AS (SELECT page_id, base, host, list_sort(list_filter(list_transform(parts, lambda x: {{{{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '=(.*)$', 1), '+', ' '))}}}}),
        lambda x: NOT starts_with(lower(x.k), 'utm_') AND lower(x.k) NOT IN {TRACKERS})) AS kept FROM n)
    SELECT page_id, lower(host) || regexp_replace(substr(base, length(host) + 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(kept, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') ELSE '' END AS url
        FROM k""".replace("{APPENDED}", pick_sql(APPENDED, "page_id", "''")).replace("{{", "{").replace("}}", "}"))
def normalise_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", normal_url(F.concat("url", pick(APPENDED, "page_id", F.lit("")))).alias("url"))


@query("""SELECT vec_id, round(list_inner_product(v, v), 6) AS norm, round(v[1], 6) AS first
        FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v
        FROM embeddings)""")
def vec_l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", unit("embedding").alias("v"))
    return v.select("vec_id", F.round(dot("v", "v"), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query(f"""WITH n AS (SELECT a.vec_id AS query, e.vec_id, round({DOT}, 9) AS similarity FROM embeddings a, embeddings e
        WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM n)
    SELECT query, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rank.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), 10).withColumn("similarity", F.round("similarity", 6))


JUDGED = f"""{SIMS.format(MAX_SIM)}, judged AS (SELECT s.ord, s.sims AS score, l.quality AS relevant, row_number() OVER (ORDER BY s.sims DESC NULLS LAST, s.ord) AS rank
        FROM sims s JOIN labels l ON l.doc_id = s.ord)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.profile_similarity(offers(spark, sf_dir, vectors=True, labels=True), _profiles(spark, sf_dir))
    return rank.ranked(rows.select("ord", F.col("sims").alias("score"), F.col("quality").alias("relevant"), "toxic", "company"), F.desc("score"), F.asc("ord"))


@query(f"""WITH {JUDGED}, m AS (SELECT count(*) AS n, sum(relevant) AS pos, sum(CASE WHEN rank <= 10 THEN relevant ELSE 0 END) AS hits, sum(CASE WHEN rank <= 10 AND relevant > 0 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg,
        quantile_cont(CASE WHEN relevant > 0 THEN rank END, 0.5) AS median_rank, count(*) FILTER (rank <= 10 AND relevant = 0) AS negatives_in_top FROM judged),
    i AS (SELECT sum(1 / log2(k + 1)) AS ideal FROM range(1, 11) x(k), m WHERE k <= pos)
    SELECT round(hits / least(10, n), 6) AS precision_at_k, round(dcg, 6) AS dcg, round(dcg / ideal, 6) AS ndcg_at_k, median_rank, negatives_in_top FROM m, i""")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.metrics(_judged(spark, sf_dir), 10)
    return found.select(*(F.round(c, 6).alias(c) for c in ("precision_at_k", "dcg", "ndcg_at_k")), "median_rank", "negatives_in_top")


@query("""WITH c AS (SELECT d.source, CASE WHEN length(d.text) > 600 THEN 'long' ELSE 'short' END AS bucket, length(d.text) AS n, l.quality AS relevant
        FROM documents d JOIN labels l USING (doc_id))
    SELECT source, bucket, count(*) FILTER (relevant = 1) AS yes, count(*) FILTER (relevant = 0) AS no, CAST(floor(quantile_cont(n, 0.5)) AS INTEGER) AS median_length
        FROM c GROUP BY GROUPING SETS ((source), (bucket), ())""")
def corpus_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir, labels=True).select(F.col("company").alias("source"), F.col("description").alias("text"), F.col("quality").alias("relevant"))
    return evaluate.breakdown(rows)


@query("""SELECT count(*) AS n, least(sum(quality), count(*) - sum(quality)) AS minority, count(*) >= 30 AND least(sum(quality), count(*) - sum(quality)) >= 8 AS usable
        FROM labels JOIN documents USING (doc_id)""")
def corpus_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.usable(offers(spark, sf_dir, labels=True).select(F.col("quality").alias("relevant")))


BLEND = f"""{JUDGED}, b AS (SELECT j.ord, j.score, l.toxic, j.rank AS rank_first, 0.5 * j.score + 0.5 * (1 - l.toxic) AS final FROM judged j
        JOIN labels l ON l.doc_id = j.ord)"""


@query(f"""WITH {BLEND} SELECT ord, round(CASE WHEN toxic = 1 AND final > 0.2 THEN 0.2 ELSE final END, 6) AS final, CASE WHEN final >= 0.7 THEN 'high' WHEN final >= 0.4 THEN 'middle' ELSE 'low' END AS level
        FROM b""")
def verdict_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.blend(_judged(spark, sf_dir).withColumn("verdict_score", (1 - F.col("toxic")).cast("double")))
    return rows.select("ord", F.round(rank.capped("final", F.col("toxic") == 1, F.lit(False)), 6).alias("final"), rank.score_level("final").alias("level"))


@query(f"""WITH {BLEND}, r AS (SELECT *, row_number() OVER (ORDER BY final DESC NULLS LAST, ord) AS rank_second FROM b)
    SELECT ord, rank_first, rank_second, rank_first - rank_second AS delta, CASE WHEN rank_first > rank_second THEN 'up' WHEN rank_first < rank_second THEN 'down' ELSE 'equal' END AS move
        FROM r""")
def rank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.blend(_judged(spark, sf_dir).drop("rank").withColumn("verdict_score", (1 - F.col("toxic")).cast("double")))
    return evaluate.rank_delta(rows, "score", "final").select("ord", "rank_first", "rank_second", "delta", "move")


@query("""WITH o AS (SELECT doc_id AS ord, row_number() OVER (ORDER BY length(text), doc_id) AS r, count(*) OVER () AS n FROM documents)
    SELECT ord FROM o WHERE r IN (SELECT CAST(round_even(i * ((SELECT count(*) FROM documents) - 1) / 19.0, 0) AS BIGINT) + 1 FROM range(20) x(i))""")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir).select("ord", F.length("description").alias("n"))
    return rank.spread_sample(rows, 20, F.asc("n"), F.asc("ord")).select("ord")


@query("""WITH o AS (SELECT doc_id AS ord, length(text) > 600 AS long FROM documents), s AS (SELECT ord, long, row_number() OVER (PARTITION BY long
        ORDER BY ord) AS r, count(*) OVER (PARTITION BY long) AS n FROM o)
    SELECT ord FROM s WHERE r IN (SELECT CAST(round_even(i * (n - 1) / 9.0, 0) AS BIGINT) + 1 FROM range(10) x(i)) UNION SELECT doc_id FROM labels
        JOIN documents USING (doc_id)
    UNION SELECT doc_id FROM documents WHERE doc_id % 60 = (SELECT max(doc_id % 60) FROM documents)""")
def label_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir).select("ord", (F.length("description") > 600).alias("long"))
    picks = [rank.spread_sample(rows.where(F.col("long") == long), 10, F.asc("ord")).select("ord") for long in (True, False)]
    # Those of the last run: posted on the last day.
    posted = offers(spark, sf_dir).select("ord", "posted_at")
    last = posted.join(F.broadcast(posted.agg(F.max("posted_at").alias("_d"))), F.col("posted_at") == F.col("_d")).select("ord")
    return picks[0].union(picks[1]).union(offers(spark, sf_dir, labels=True).select("ord")).union(last).distinct()


@query("SELECT doc_id AS ord, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR) || ':7'), doc_id) AS place FROM documents")
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.seeded_order(offers(spark, sf_dir).select("ord"), "ord", 7)
    return rank.ranked(rows, F.asc("shuffle_key"), F.asc("ord"), to="place").select("ord", "place")


@query(f"""WITH {OFFERS}, {BOOSTED}, {SIMS.format(MAX_SIM)}, r AS (
        SELECT row_number() OVER (ORDER BY sims DESC NULLS LAST, o.ord) AS rang, coalesce(CAST(round(sims, 4) AS VARCHAR), '') AS score, concat_ws(' ', CASE WHEN o.t1 OR o.d1 THEN 'A' END, CASE WHEN o.t2 OR o.d2 THEN 'B' END, CASE WHEN o.combo THEN 'A+B' END) AS match,
            CASE WHEN o.ord % 4 = 0 THEN 'oui' ELSE '' END AS nouvelle, title, company, location, '' AS source, CAST(posted_at AS VARCHAR) AS posted_at, '' AS duree_mois, '' AS date_debut, '' AS salary,
            CASE WHEN quality IS NULL THEN '' WHEN quality = 1 THEN 'oui' ELSE 'non' END AS pertinent, CASE WHEN quality IS NULL THEN '' WHEN toxic = 1 THEN 'senior' ELSE 'stage' END AS niveau,
            CASE WHEN quality IS NULL THEN '' WHEN toxic = 1 THEN 'oui' ELSE 'non' END AS est_alternance, CASE WHEN quality IS NULL THEN '' WHEN toxic = 1 THEN 'a | b' ELSE '' END AS drapeaux_rouges, '' AS justification, '' AS url, description
        FROM scored o JOIN sims USING (ord) LEFT JOIN labels ON doc_id = ord)
    SELECT * EXCLUDE (score) FROM r""")
def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the export but the scores, whose text differs between engines."""
    labels = table(spark, sf_dir, "labels")
    verdict = F.struct(F.col("quality").cast("double").alias("score"), (F.col("quality") == 1).alias("relevant"), F.when(F.col("toxic") == 1, "senior").otherwise("stage").alias("level"), (F.col("toxic") == 1).alias("apprenticeship"),
                       F.when(F.col("toxic") == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.lit(None).cast("string").alias("reason"))
    told = labels.select(F.col("doc_id").alias("ord"), verdict.alias("verdict"))
    rows = _boosted(spark, sf_dir, keep=("title", "company", "location", "salary", "posted_at", "description")).withColumn("score", F.col("sims")).withColumn("new", F.col("ord") % 4 == 0).join(told, "ord", "left")
    return sinks.csv_rows(rows).drop("score", "score_llm")


#: Locations with a sign of each kind: (text, inside). Those with T name a commune of the table, or none, by the key.
SIGNS = [("", True), ("  ", True), ("Paris, TX", False), ("Beauvais, Hauts-de-France, France", False), ("Lyon", False), ("Neuilly, A8, FR", True), ("Massy, Île-de-France", True), ("IDF", True), ("94 - BONNEUIL SUR MARNE", True), ("33 - BORDEAUX", False),
         ("Orly, Val-de-Marne - Paris", True), ("La Défense", True), ("Quelque part, CVL, FR", False), ("Canada", False)]


@query(f"""WITH c AS (SELECT c_custkey, c_custkey % {len(SIGNS) + 2} AS k, 'le town' || (c_custkey % 25) AS name
        FROM customer), t AS (SELECT DISTINCT 'le town' || (s_suppkey % 20) AS name FROM supplier)
    SELECT c_custkey, CASE {' '.join(f'WHEN k = {k} THEN {str(v).lower()}' for k, (_, v) in enumerate(SIGNS))} ELSE name IN (SELECT name
        FROM t) AND k = {len(SIGNS)} END AS inside FROM c""")
def region_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals of the region; in the last kind the title names another country."""
    town = lambda key, n: F.concat(F.lit("town"), F.pmod(key, F.lit(n)).cast("string"))
    communes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.concat(F.lit("Le "), town("s_suppkey", 20)).alias("name"))
    kind = F.pmod("c_custkey", F.lit(len(SIGNS) + 2)).cast("int")
    location = F.coalesce(F.get(F.array(*(F.lit(t) for t, _ in SIGNS)), kind), F.concat(F.initcap(town("c_custkey", 25)), F.lit(" 75000")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", location.alias("location"), F.when(kind == len(SIGNS) + 1, "Data engineer - Canada").otherwise("Data engineer").alias("title"))
    return geo.region_decision(rows, communes, "c_custkey", title="title", foreign_titles=["canada"], foreign=["canada"]).select("c_custkey", "inside")


@query("""WITH c AS (SELECT c_custkey, c_custkey % 5 AS kind, c_custkey % 27 AS n FROM customer)
    SELECT c_custkey, CASE WHEN kind < 3 AND n BETWEEN 1 AND 20 THEN printf('751%02d', CAST(n AS INTEGER)) WHEN kind = 4 THEN '99000' ELSE '75056' END AS code FROM c""")
def paris_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communes of locations in Paris, to the district where it is named."""
    n = F.pmod("c_custkey", F.lit(27)).cast("string")
    kinds = [F.concat(F.lit("Paris "), n, F.lit("e")), F.concat(n, F.lit("ème Arrondissement, Paris")), F.concat(F.lit("75 - Paris "), n, F.lit("e Arrondissement")), F.lit("Paris, France"), F.lit("St-Maur CEDEX 2")]
    location = F.coalesce(*(F.when(F.col("c_custkey") % 5 == k, t) for k, t in enumerate(kinds)))
    communes = spark.createDataFrame([("75056", "Paris", "75"), ("99000", "Saint-Maur", "99")], "code string, name string, department string")
    return geo.resolve_commune(table(spark, sf_dir, "customer").select("c_custkey", location.alias("location")), communes, "c_custkey").select("c_custkey", "code")


@query(r"""WITH c AS (SELECT c_custkey, [c_mktsegment, '  ', CASE c_custkey % 4 WHEN 0 THEN ' Lyon, France ' WHEN 1 THEN 'Idf' WHEN 2 THEN 'Berlin' END, 'Paris'] AS l
        FROM customer),
    k AS (SELECT c_custkey, list_filter(list_transform(list_filter(CASE WHEN c_custkey % 9 = 0 THEN [] WHEN c_custkey % 9 = 1 THEN l[:1] ELSE l END, lambda x: x IS NOT NULL), lambda x: trim(x)), lambda x: x <> '') AS l
        FROM c)
    SELECT c_custkey, coalesce(list_filter(l, lambda x: regexp_matches(x, '(?i)paris|france|île-de-france|ile-de-france|\bidf\b'))[1], l[1], '') AS location FROM k""")
def preferred_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    every = F.array("c_mktsegment", F.lit("  "), F.when(k % 4 == 0, " Lyon, France ").when(k % 4 == 1, "Idf").when(k % 4 == 2, "Berlin"), F.lit("Paris"))
    listed = F.when(k % 9 == 0, F.array().cast("array<string>")).when(k % 9 == 1, F.slice(every, 1, 1)).otherwise(every)
    return table(spark, sf_dir, "customer").select("c_custkey", preferred_location(listed).alias("location"))


@query("SELECT p_partkey, CASE WHEN p_size <= 1 THEN 1 WHEN p_size <= 3 THEN 3 WHEN p_size <= 7 THEN 7 WHEN p_size <= 14 THEN 14 ELSE 31 END AS days FROM part")
def window_snapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", allowed_window("p_size").alias("days"))


@query("""WITH t AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || '  ' || p_name, ' ') AS l
        FROM part), k AS (SELECT p_partkey, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '') AS l FROM t)
    SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS tags FROM k""")
def tags_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.split(F.concat_ws(" ", "p_name", "p_type", F.lit(""), "p_name"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.ordered_tags(given), "|").alias("tags"))


@query(f"""WITH {OFFERS}, f AS (SELECT ord, concat_ws(',', {', '.join(f'CASE WHEN {any_word("title", w)} THEN {n!r} END' for n, w in FAMILIES.items())}) AS f
        FROM offers) SELECT ord, CASE WHEN f = '' THEN 'terme_non_retrouve' ELSE f END AS families FROM f""")
def tagged_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("ord", F.array_join(tx.families_or("title", FAMILIES), ",").alias("families"))


#: Of each source: its JSON, from an order, and as SQL what becomes of it: title, company, location, url, salary, native key.
_N, _P = "CAST(o_orderkey AS VARCHAR)", "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)"
SOURCES_SQL = {
    "adzuna": ("'Order ' || {n}", "o_orderpriority", "'Paris'", "'https://x.example/' || {n}", "{p} || ' - ' || {p} || ' €'", "'id:' || {n}"),
    "careerjet": ("'A & B ' || {n}", "o_orderpriority", "'Orly'", "'https://x.example/' || {n}", "'20k'", "'contenu:' || sha1('a b ' || {n} || '|' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) || '|orly|cj')"),
    "france_travail": ("'A <b> ' || {n}", "o_orderpriority", "'92 - SURESNES'", "'https://x.example/' || {n}", "''", "'id:' || {n}"),
    "free_work": ("'Order ' || {n}", "o_orderpriority", "'IDF'", "'https://www.free-work.com/fr/tech-it/informatique/job-mission/s' || {n}", "'à partir de ' || {p} || ' €'", "'id:' || {n}"),
    "jobspy": ("'Order ' || {n}", "o_orderpriority", "'Paris, A8, FR'", "'https://x.example/' || {n} || '?utm_x=1'", "'jusqu''à ' || {p} || ' USD'", "'url:https://x.example/' || {n}"),
    "jooble": ("'Order ' || {n}", "o_orderpriority", "'Paris'", "'https://x.example/' || {n}", "'10 €'", "'id:' || {n}"),
    "greenhouse": ("'Order ' || {n}", "o_orderpriority", "'Paris office'", "'https://x.example/' || {n}", "''", "'id:' || {n}"),
    "lever": ("'Order ' || {n}", "o_orderpriority", "'Paris'", "'https://x.example/' || {n}", "''", "'id:' || {n}"),
    "ashby": ("'Order ' || {n}", "o_orderpriority", "'Lille, France'", "'https://x.example/' || {n}", "''", "'id:' || {n}"),
}


def landed_sources(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = (), orders: DataFrame | None = None) -> DataFrame:
    """(source, json): orders as records of the nine sources, and of one that isn't known; ``orders`` may be given with more columns to ``keep``."""
    n, price = F.col("o_orderkey").cast("string"), F.floor("o_totalprice").cast("double")
    title, url, who = F.concat(F.lit("Order "), n), F.concat(F.lit("https://x.example/"), n), F.col("o_orderpriority")
    record = lambda **fields: F.to_json(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items())))
    one = lambda k, v: F.struct((v if isinstance(v, Column) else F.lit(v)).alias(k))
    made = {
        "adzuna": record(id=n, title=title, company=one("display_name", who), location=one("display_name", "Paris"), redirect_url=url, salary_min=price, salary_max=price),
        "careerjet": record(title=F.concat(F.lit("A &amp; <b>B</b> "), n), company=who, locations="Orly", url=url, salary="20k", site="CJ"),
        "france_travail": record(id=n, intitule=F.concat(F.lit("A &lt;b&gt; "), n), entreprise=one("nom", who), lieuTravail=one("libelle", "92 - SURESNES"), origineOffre=one("urlOrigine", url)),
        "free_work": record(id=n, slug=F.concat(F.lit("s"), n), title=title, company=one("name", who), location=one("adminLevel1", "IDF"), minAnnualSalary=price),
        "jobspy": record(title=title, company=who, location="Paris, A8, FR", job_url=F.concat(url, F.lit("?utm_x=1")), max_amount=price, currency="USD"),
        "jooble": record(id=n, title=title, company=who, location="Paris", snippet="<p>x</p>", link=url, salary="10 €"),
        "greenhouse": record(id=n, title=title, company=who, content="&lt;p&gt;x", absolute_url=url, location=one("name", "Berlin; Rome"), offices=F.array(F.struct(F.lit("Paris office").alias("name")))),
        "lever": record(id=n, text=title, company=who, hostedUrl=url, createdAt=1_700_000_000_000, categories=F.struct(F.lit("London").alias("location"), F.array(F.lit("Rome"), F.lit("Paris")).alias("allLocations"))),
        "ashby": record(id=n, title=title, company=who, jobUrl=url, location="Remote", address=one("postalAddress", F.struct(F.lit("Lille").alias("addressLocality"), F.lit("France").alias("addressCountry"))), isListed=F.col("o_orderkey") % 20 != 8),
    }
    at = F.pmod("o_orderkey", F.lit(10)).cast("int")
    return (orders or table(spark, sf_dir, "orders")).select(*keep, F.coalesce(F.get(F.array(*map(F.lit, made)), at), F.lit("other")).alias("source"), F.coalesce(*(F.when(at == k, v) for k, v in enumerate(made.values())), F.lit("{}")).alias("json"))


def _sources_sql() -> str:
    names = ["title", "company", "location", "url", "salary", "native_key"]
    cases = [f"CASE o_orderkey % 10 {' '.join(f'WHEN {k} THEN {v[c]}' for k, v in enumerate(SOURCES_SQL.values()))} END AS {name}" for c, name in enumerate(names)]
    source = f"CASE o_orderkey % 10 {' '.join(f'WHEN {k} THEN {chr(39)}{n + (':inconnu' if n == 'jobspy' else '')}{chr(39)}' for k, n in enumerate(SOURCES_SQL))} ELSE 'other' END AS source"
    reason = "CASE WHEN o_orderkey % 10 = 9 THEN 'unknown source' WHEN o_orderkey % 20 = 8 THEN 'not listed' END AS reason"
    cells = ", ".join(cases).replace("{n}", _N).replace("{p}", _P)
    return f"SELECT * FROM (SELECT o_orderkey, {source}, {cells}, {reason} FROM orders)"


@query(f"SELECT source, title, company, location, url, salary, native_key, reason FROM ({_sources_sql()}) WHERE reason IS NULL")
def normalise_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of all nine sources, in one pass."""
    return normalised(landed_sources(spark, sf_dir)).where("reason IS NULL").select("source", "title", "company", "location", "url", "salary", "native_key", "reason")


@query(f"SELECT source, reason, count(*) AS n FROM ({_sources_sql()}) WHERE reason IS NOT NULL GROUP BY ALL")
def source_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(landed_sources(spark, sf_dir)).where("reason IS NOT NULL").groupBy("source", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {OFFERS}, old AS (SELECT ord, title FROM offers
        WHERE ord % 3 <> 0), new AS (SELECT ord, CASE WHEN ord % 5 = 0 THEN title || '!' ELSE title END AS title FROM offers WHERE ord % 4 <> 0)
    SELECT ord, change
        FROM (SELECT coalesce(o.ord, n.ord) AS ord, CASE WHEN o.ord IS NULL THEN 'added' WHEN n.ord IS NULL THEN 'removed' WHEN o.title IS DISTINCT
        FROM n.title THEN 'changed' END AS change FROM old o FULL JOIN new n ON o.ord = n.ord) WHERE change IS NOT NULL""")
def label_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir).select("ord", "title")
    new = rows.where(F.col("ord") % 4 != 0).withColumn("title", F.when(F.col("ord") % 5 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return store.table_diff(rows.where(F.col("ord") % 3 != 0), new, "ord", "title")


@query(f"""WITH {KEYED}, l AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'gone' || doc_id ELSE key END AS key FROM labels
        JOIN keyed ON ord = doc_id), o AS (SELECT key, CASE WHEN min(ord) % 7 = 0 THEN 'x' ELSE key END AS derived FROM keyed GROUP BY key)
    SELECT doc_id, CASE WHEN derived IS NULL THEN 'missing' WHEN derived <> key THEN 'incoherent' ELSE 'ok' END AS status FROM l LEFT JOIN o USING (key)""")
def match_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels found by the keys of their offers; the keys are computed and written once, for both sides of the match."""
    keyed = cut(keyed_offers(spark, sf_dir).select("ord", "key"))
    labels = table(spark, sf_dir, "labels").join(keyed.select(F.col("ord").alias("doc_id"), "key"), "doc_id").withColumn("key", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("gone"), F.col("doc_id").cast("string"))).otherwise(F.col("key")))
    stored = keyed.groupBy("key").agg(F.min("ord").alias("_o")).select("key", F.when(F.col("_o") % 7 == 0, "x").otherwise(F.col("key")).alias("derived"))
    return evaluate.match_labels(labels, stored).select("doc_id", "status")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "EEE, d MMM yyyy HH:mm:ss '+0000'", "M/d/yyyy", "d MMMM yyyy", "MMM d, yyyy", "'Posted on' d MMM yyyy 'at noon'", "'Since' yyyy-MM-dd', 3 replies'"]
    at = F.col("o_orderdate").cast("timestamp")
    text = F.coalesce(*(F.when(F.col("o_orderkey") % len(kinds) == k, F.date_format(at, f)) for k, f in enumerate(kinds)))
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_date(text).alias("day"))


@query(f"WITH {OFFERS} SELECT DISTINCT sha256(title || '. ' || description) AS hash, 'hashing-64' AS model, 64 AS size FROM offers")
def encode_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all texts: those of the even documents are cached, the others are made."""
    rows = offers(spark, sf_dir).withColumn("t", models.to_encode("title", "description"))
    cache = models.encode_missing(rows.where("ord % 2 = 0"), spark.createDataFrame([], "hash string, model string, embedding array<float>"), "t")
    return models.encode_missing(rows, cache, "t").select("hash", "model", F.size("embedding").alias("size"))


def _rule_judge(prompts: list[str]) -> list[str]:
    """Answers as a model would word them, from rules over the text of the prompt."""
    return [f'Well: {{"score": {len(p) / 2000}, "domain_match": {str(len(p) % 2 == 0).lower()}, "level": " {"Sénior" if "!" in p else "stage de master"} "}} done' for p in prompts]


@query(f"""WITH {OFFERS} SELECT ord, round(CASE WHEN ord % 3 = 0 THEN 0.25 WHEN length(description) > 2000 THEN 1 ELSE length(description) / 2000 END, 4) AS score, ord % 3 <> 0 AND length(description) % 2 = 0 AS domain_match,
    CASE WHEN ord % 3 = 0 THEN 'inconnu' WHEN contains(description, '!') THEN 'senior' ELSE 'stage' END AS level FROM offers""")
def verdict_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all offers: those of every third are in the memo, the others come from the judge."""
    third = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("memo"), F.col("ord").cast("string"))).otherwise(tx.content_hash("title", "company", "location", "description"))
    rows = offers(spark, sf_dir).select("ord", third.alias("hash"), models.memo_key("m", 1, F.lit("profile")).alias("memo_key"), F.col("description").alias("prompt"))
    memo = rows.where("ord % 3 = 0").select("hash", "memo_key", F.lit('{"score": 0.25, "domain_match": false, "level": "?"}').alias("answer"))
    return models.judge_missing(rows, memo, _rule_judge).select("ord", "verdict.score", "verdict.domain_match", "verdict.level").withColumn("score", F.round("score", 4))


@query(f"""WITH {JUDGED}, f AS (SELECT j.ord, j.rank, CASE WHEN j.rank <= 30 THEN 0.5 * j.score + 0.5 * (1 - l.toxic) ELSE j.score END AS final
        FROM judged j JOIN labels l ON l.doc_id = j.ord)
    SELECT ord, rank, round(final, 6) AS final, row_number() OVER (ORDER BY final DESC NULLS LAST, ord) AS new_rank FROM f""")
def verify_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).withColumn("verdict_score", (1 - F.col("toxic")).cast("double"))
    return report.verify_shortlist(rows, 30).select("ord", "rank", F.round("final", 6).alias("final"), "new_rank")


@query(f"""WITH {OFFERS}, {BOOSTED}, {SIMS.format(MAX_SIM)} SELECT count(*) AS total, count(*) FILTER (sims >= 0.2) AS verified, count(*) FILTER (ord % 4 = 0) AS new, count(*) FILTER (combo) AS combo
        FROM sims JOIN scored USING (ord)""")
def list_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counters(_boosted(spark, sf_dir), F.col("sims") >= 0.2, F.col("ord") % 4 == 0, F.col("combo"))


@query(f"""WITH {OFFERS}, {BOOSTED}, {JUDGED} SELECT j.rank, printf('#%-3d [%.3f]', CAST(j.rank AS INTEGER), j.score) || CASE WHEN tags <> '' THEN '  ' || tags ELSE '' END || '  ' || CASE WHEN j.ord % 2 = 0 THEN '🆕 ' ELSE '' END || 'offer ' || j.ord || CASE j.ord % 3 WHEN 0 THEN '  (6 mois, début 2027-01)' WHEN 1 THEN '  (6 mois)' ELSE '' END AS head,
        company || '  |  ' || location || '  |  —' AS place,
        CASE WHEN j.ord % 5 <> 0 THEN printf('LLM %.2f', j.relevant * 0.5) || CASE WHEN toxic = 1 THEN '  ⚠ alternance  niveau=senior' ELSE '' END || '  🚩 a ; b ; c' END AS verdict,
        CASE WHEN j.ord % 5 <> 0 THEN '« ' || CASE WHEN length(d) > 140 THEN substr(d, 1, 137) || '…' ELSE d END || ' »' END AS reason
    FROM judged j JOIN (SELECT *, concat_ws(' ', CASE WHEN t1 OR d1 THEN 'A' END, CASE WHEN t2 OR d2 THEN 'B' END, CASE WHEN combo THEN 'A+B' END) AS tags, replace(trim(description, ' ' || chr(10) || chr(9)), chr(10), ' ') AS d FROM scored) s ON s.ord = j.ord JOIN labels l ON l.doc_id = j.ord
    WHERE j.rank <= 40 AND j.score IS NOT NULL""")
def cli_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 of the judged offers as lines for a terminal."""
    first = _judged(spark, sf_dir).where("rank <= 40 AND score IS NOT NULL").select("ord", "rank", "score", "relevant", "toxic")
    k = F.col("ord")
    texts = rank.boosts(offers(spark, sf_dir).join(F.broadcast(first), "ord"), FIRST, SECOND)
    flags = F.array(*map(F.lit, "abcd"))
    verdict = F.struct((F.col("relevant") * 0.5).alias("score"), (F.col("toxic") == 1).alias("apprenticeship"), F.when(F.col("toxic") == 1, "senior").otherwise("stage").alias("level"), flags.alias("flags"), F.col("description").alias("reason"))
    made = {"new": k % 2 == 0, "title": F.concat(F.lit("offer "), k.cast("string")), "months": F.when(k % 3 < 2, 6), "start": F.when(k % 3 == 0, "2027-01").otherwise(""), "source": F.lit(""), "verdict": F.when(k % 5 != 0, verdict)}
    return report.listing(texts.withColumns(made)).select("rank", "head", "place", "verdict", "reason")
