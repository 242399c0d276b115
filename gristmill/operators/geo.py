"""Joins with places: communes, origins, travel times. The table of communes is always a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.geo import ILE_DE_FRANCE, Region, cited_departments, haversine, in_region, in_traffic, out_of_zone, plain, refined_code, segments, travel_minutes, variants, without_article
from gristmill.functions.columns import col
from gristmill.functions.text import has_word
from gristmill.session import cut

ORIGINS = 1000


def named_communes(communes: DataFrame, *more: str) -> DataFrame:
    """(name, code, more) of every commune under its comparable name, and under that without its article."""
    name = plain("name")
    return communes.select(F.explode(F.array_distinct(F.array(name, without_article(name)))).alias("name"), "code", *more)


def resolve_commune(offers: DataFrame, communes: DataFrame, key: str = "ord", location: str = "location", centre: tuple[float, float] | None = None, departments: dict[str, str] | None = None, named: DataFrame | None = None, barrier: bool = False) -> DataFrame:
    """(key, code) of each offer. With ``barrier``, a location with a sign from
    elsewhere has none. A place of ``named`` (name, code) that stands anywhere in the location comes
    first, the longest name before shorter ones. Else it is the first segment of its location, in its truest
    form, that names a commune. Of communes with one name, those in a cited
    department come first, then the nearest to the centre, then the least code;
    Paris gives its district where that is named; null if none matches."""
    text = F.col("_location")
    # A code follows from the location alone, so each different one is looked up once.
    rows = offers.select(key, F.col(location).alias("_location"))
    places = cut(rows.select("_location").where("_location IS NOT NULL").distinct())
    inside = places.where(~out_of_zone(text)) if barrier else places
    forms = F.flatten(F.transform(segments(text), variants))
    parts = inside.select("_location", cited_departments(text, departments).alias("_cited"), F.posexplode(forms).alias("_pos", "name"))
    away = haversine("lon", "lat", F.lit(centre[0]), F.lit(centre[1])) if centre else F.lit(0.0)
    first = F.min(F.struct(away.alias("_far"), F.col("code").alias("code"))).alias("_c")
    # Of the communes of a name only the best of all and the best of each department can be chosen.
    communed = cut(named_communes(communes, "department", *(["lon", "lat"] if centre else [])).groupBy("name", "department").agg(first))
    any_of = communed.groupBy("name").agg(F.min("_c").alias("_any"))
    cited = parts.select("_location", "_pos", "name", F.explode(F.array_distinct("_cited")).alias("department")).join(communed, ["name", "department"])
    own = cited.groupBy("_location", "_pos").agg(F.min("_c").alias("_own"))
    found = parts.join(any_of, "name").select("_location", "_pos", "_any").join(own, ["_location", "_pos"], "left")
    best = F.min(F.struct("_pos", F.coalesce("_own", "_any").alias("c"))).alias("_b")
    codes = found.groupBy("_location").agg(best).select("_location", F.col("_b.c.code").alias("code"))
    if named is not None:
        codes = codes.join(named_places(inside, named, "_location", "_location").withColumnRenamed("code", "_named"), "_location", "full_outer")
    own = refined_code(F.col("code").cast("string"), text) if communes.schema["code"].dataType.simpleString() == "string" else F.col("code")
    codes = codes.select("_location", (F.coalesce("_named", own) if named is not None else own).alias("code"))
    return rows.join(codes, "_location", "left").select(key, "code")


def named_places(offers: DataFrame, names: DataFrame, key: str = "ord", location: str = "location") -> DataFrame:
    """(key, code): of the places of ``names`` (name, code) whose words stand
    together in a location, the one with the most words, then the first to
    stand there, then the least code. Runs of words meet the names in a join;
    a run has no more words than the longest name."""
    phrases = names.select(plain("name").alias("_phrase"), "code").where("_phrase <> ''").distinct()
    longest = phrases.agg(F.coalesce(F.max(F.size(F.split("_phrase", " "))), F.lit(0))).first()[0]
    words = offers.select(key, F.split(plain(location), " ").alias("_w"))
    starts = words.select(key, "_w", F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("_at"))
    runs = starts.select(key, "_at", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.when(F.col("_at") + n - 1 <= F.size("_w"), F.array_join(F.slice("_w", F.col("_at"), F.lit(n)), " ")).alias("s")) for n in range(1, longest + 1)))).alias("_run")) if longest else None
    if runs is None:
        return offers.select(key, F.lit(None).cast(names.schema["code"].dataType).alias("code")).limit(0)
    met = runs.select(key, "_at", F.col("_run.n").alias("_n"), F.col("_run.s").alias("_phrase")).join(phrases, "_phrase")
    return met.groupBy(key).agg(F.min(F.struct(-F.col("_n"), "_at", "code")).alias("_b")).select(key, F.col("_b.code").alias("code"))


def canonical_city(offers: DataFrame, codes: DataFrame, key: str = "ord", location: str = "location") -> DataFrame:
    """``offers`` with ``city``: the commune's code, else the first segment."""
    return offers.join(codes, key, "left").withColumn("city", F.coalesce(F.col("code").cast("string"), F.get(segments(location), F.lit(0)), F.lit(""))).drop("code")


def region_decision(offers: DataFrame, communes: DataFrame, key: str = "ord", location: str = "location", title: str | None = None, foreign_titles: list[str] = (), foreign: list[str] = (), region: Region = ILE_DE_FRANCE) -> DataFrame:
    """``offers`` with ``inside``. A foreign word in the title or a foreign
    substring in the location decides first; then ``in_region``, for which the
    parts of all locations meet the communes' names in one semi join."""
    # What a location tells follows from it alone, so each different one is looked at once.
    places = cut(offers.select(F.col(location).alias("_location")).distinct())
    named = named_communes(communes).select("name").distinct()
    parts = places.select("_location", F.explode(segments("_location")).alias("name"))
    known = parts.join(named, "name", "left_semi").select(F.col("_location").alias("_known")).distinct().withColumn("_commune", F.lit(True))
    low = F.lower(F.coalesce("_location", F.lit("")))
    outside = F.lit(False)
    for word in foreign:
        outside = outside | low.contains(word)
    inside = F.when(outside, False).otherwise(in_region("_location", F.col("_commune"), region))
    told = places.join(known, F.col("_location") == F.col("_known"), "left").select("_location", inside.alias("_inside"))
    # No null meets itself in an equality, so a flag stands for it: rows are joined by hash.
    at = lambda c: [F.coalesce(c, F.lit("")), c.isNull()]
    keyed = told.select(F.struct(*at(F.col("_location"))).alias("_at"), "_inside")
    both = offers.withColumn("_at", F.struct(*at(col(location)))).join(keyed, "_at", "left").drop("_at")
    elsewhere = has_word(title, list(foreign_titles)) if title and foreign_titles else F.lit(False)
    return both.withColumn("inside", F.when(elsewhere, False).otherwise(F.col("_inside"))).drop("_inside")


def travel(places: DataFrame, origins: DataFrame, measured: DataFrame | None = None, key: str = "place") -> DataFrame:
    """(key, travel): minutes in traffic from each origin, as a map, and
    ``best``, the least. A measured time counts while its coordinates are
    still right; otherwise the estimate. Origins are few (at most ORIGINS, else
    an error), so they are paired with every place by broadcast."""
    if len(origins.take(ORIGINS + 1)) > ORIGINS:
        raise ValueError(f"more than {ORIGINS} origins")
    both = places.join(F.broadcast(origins.select("origin", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))))
    raw = travel_minutes(haversine("_lon", "_lat", "lon", "lat"))
    if measured is not None:
        known = measured.select(key, "origin", F.col("minutes").alias("_known"), F.col("lon").alias("_mlon"), F.col("lat").alias("_mlat"))
        both = both.join(known, [key, "origin"], "left")
        raw = F.coalesce(F.when((F.col("_mlon") == F.col("lon")) & (F.col("_mlat") == F.col("lat")), F.col("_known")), raw)
    timed = both.select(key, "origin", F.round(in_traffic(raw), 1).alias("minutes"))
    return timed.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("origin", "minutes")))).alias("travel"), F.min("minutes").alias("best"), F.min_by("origin", F.struct("minutes", "origin")).alias("nearest"))
