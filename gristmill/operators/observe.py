"""What each source returned and lost, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STERILE_FROM = 10


def funnel(tagged: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """From rows of (source, normalised, reason, merged): raw, normalised, lost,
    survivors, merged, retained and a map of rejects by reason, per source.
    Expected sources without a row appear with zeros."""
    ok = F.col("normalised")
    by = tagged.groupBy("source").agg(
        F.count("*").alias("raw"), F.count_if(ok).alias("normalised"), F.count_if(ok & F.col("reason").isNull()).alias("survivors"),
        F.count_if(ok & F.col("reason").isNull() & F.col("merged")).alias("merged"),
    )
    reasons = tagged.where(ok & F.col("reason").isNotNull()).groupBy("source", "reason").agg(F.count("*").alias("n"))
    maps = reasons.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("rejects"))
    found = by.join(maps, "source", "left")
    if sources is not None:
        found = sources.select("source").distinct().join(found, "source", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.select(
        "source", *(n(c).alias(c) for c in ("raw", "normalised", "survivors", "merged")),
        F.greatest(F.lit(0), n("raw") - n("normalised")).alias("lost"), F.greatest(F.lit(0), n("survivors") - n("merged")).alias("retained"),
        F.coalesce("rejects", F.array().cast("array<struct<reason:string,n:bigint>>")).alias("rejects"),
    )


def health(funnel_rows: DataFrame, incidents: DataFrame | None = None, least: int = STERILE_FROM) -> DataFrame:
    """Each source as silent, silent with incidents, sterile, degraded or healthy, with its incident kinds."""
    kinds = incidents.groupBy("source").agg(F.array_sort(F.collect_set("category")).alias("incidents")) if incidents is not None else None
    rows = funnel_rows.join(kinds, "source", "left") if kinds is not None else funnel_rows.withColumn("incidents", F.lit(None).cast("array<string>"))
    rows = rows.withColumn("incidents", F.coalesce("incidents", F.array().cast("array<string>")))
    trouble = F.size("incidents") > 0
    state = F.when((F.col("raw") == 0) & trouble, "silent_with_incident").when(F.col("raw") == 0, "silent").when((F.col("raw") >= least) & (F.col("survivors") == 0), "sterile").when(trouble, "degraded").otherwise("healthy")
    return rows.withColumn("health", state)


def seeded_counts(rows: DataFrame, dimension: DataFrame, name: str) -> DataFrame:
    """Count by ``name``, 0 for members of the dimension without a row."""
    return dimension.select(name).distinct().join(rows.groupBy(name).agg(F.count("*").alias("n")), name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def all_counts(rows: DataFrame, dimension: DataFrame, name: str) -> DataFrame:
    """(name, n, expected): as ``seeded_counts``, and also members that were observed but aren't in the dimension."""
    counted = rows.groupBy(name).agg(F.count("*").alias("n"))
    both = dimension.select(name, F.lit(True).alias("expected")).distinct().join(counted, name, "full_outer")
    return both.select(name, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(False)).alias("expected"))


def family_counts(rows: DataFrame, families: str, survivor: str) -> DataFrame:
    """Raw and surviving rows of each family; a row counts once in each of its families."""
    return rows.select(F.explode(F.array_distinct(families)).alias("family"), survivor).groupBy("family").agg(F.count("*").alias("raw"), F.count_if(survivor).alias("survivors"))


def source_counts(rows: DataFrame, links: str) -> DataFrame:
    """Rows by source over the different sources of each row's links, most first."""
    return rows.select(F.explode(F.array_distinct(F.transform(links, lambda x: x["source"]))).alias("source")).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def run_report(sources: DataFrame, families: DataFrame, incidents: DataFrame, perimeter: str) -> DataFrame:
    """(json): one text for a run: every source's funnel with its rejects and
    incidents, and the families, in the order of their names."""
    told = incidents.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col("category").alias("categorie"), "detail"))).alias("incidents"))
    none = F.array().cast("array<struct<categorie:string,detail:string>>")
    line = F.struct(
        F.col("source").alias("nom"), F.col("raw").alias("brut"), F.col("normalised").alias("normalisees"), F.col("survivors").alias("survivantes"), F.col("merged").alias("fusions"), F.col("retained").alias("retenues"),
        F.map_from_entries("rejects").alias("rejets"), F.coalesce("incidents", none).alias("incidents"),
    )
    # A map has no order, so lists are sorted by their names alone.
    lines = sources.join(told, "source", "left").groupBy().agg(F.collect_list(F.struct("source", line.alias("line"))).alias("_l"))
    first = lines.select(F.transform(by_name_of("_l", "source"), lambda x: x["line"]).alias("sources"))
    family = F.struct(F.col("family").alias("nom"), F.col("raw").alias("brut"), F.col("survivors").alias("survivantes"))
    second = families.groupBy().agg(F.array_sort(F.collect_list(family)).alias("familles"))
    return first.join(F.broadcast(second)).select(F.to_json(F.struct(F.lit(perimeter).alias("perimetre"), "sources", "familles")).alias("json"))


def by_name_of(column: str, name: str) -> Column:
    """An array of structs in the order of one of their fields."""
    order = lambda x, y: F.when(x[name] < y[name], -1).when(x[name] > y[name], 1).otherwise(0)
    return F.array_sort(column, order)
