"""Raw source rows to offers: landed JSON, one projection for each source.

All sources go through one pass: a row is parsed by its own source's schema,
and what follows is the same for all. A row that can't be parsed, or lacks a
title or a URL, isn't fatal: it stays, with its ``reason``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.geo import preferred_location
from gristmill.functions.text import bare_html, clean, squeeze, unaccent, unescape
from gristmill.functions.url import normal_url
from gristmill.sources.schema import OFFER_FIELDS

#: The shape of each source's records.
SCHEMAS = {
    "adzuna": "id string, title string, company struct<display_name:string>, location struct<display_name:string>, description string, redirect_url string, created string, salary_min double, salary_max double",
    "careerjet": "title string, company string, locations string, description string, url string, date string, salary string, site string",
    "france_travail": "id string, intitule string, entreprise struct<nom:string>, lieuTravail struct<libelle:string>, description string, origineOffre struct<urlOrigine:string>, dateCreation string, salaire struct<libelle:string>",
    "free_work": "id string, slug string, title string, description string, applicationUrl string, publishedAt string, createdAt string, job struct<nameForContributionSlug:string>, company struct<name:string>, location struct<label:string,adminLevel1:string>, minAnnualSalary double, maxAnnualSalary double",
    "jobspy": "id string, title string, company string, location string, description string, job_url string, site string, date_posted string, min_amount double, max_amount double, currency string",
    "jooble": "id string, title string, company string, location string, snippet string, link string, updated string, salary string",
    "greenhouse": "id string, title string, content string, absolute_url string, first_published string, updated_at string, location struct<name:string>, offices array<struct<name:string,location:string>>, company_name string, company string",
    "lever": "id string, text string, descriptionPlain string, hostedUrl string, createdAt bigint, categories struct<location:string,allLocations:array<string>>, company string",
    "ashby": "id string, title string, descriptionPlain string, jobUrl string, publishedAt string, location string, address struct<postalAddress:struct<addressLocality:string,addressCountry:string>>, secondaryLocations array<struct<location:string>>, isListed boolean, company string",
}
#: Sources whose titles or descriptions are HTML, or text with character references; whose HTML is itself escaped.
HTML = {"title": ["careerjet"], "description": ["careerjet", "free_work", "jooble", "greenhouse"]}
REFERENCES = {"title": ["france_travail"], "description": ["france_travail"]}
ESCAPED = {"title": [], "description": ["greenhouse"]}
#: Wording of a salary with one bound, of an unknown board, and a source's public address.
FROM, UP_TO, NO_BOARD = "à partir de ", "jusqu'à ", "inconnu"
FREE_WORK = "https://www.free-work.com/fr/tech-it/%s/job-mission/%s"


def salary(low: Column, high: Column, unit: Column | str = "€") -> Column:
    """Bounds as text, cut to whole numbers; 0 and NaN count as absent."""
    mark = F.lit(unit) if isinstance(unit, str) else unit
    bound = lambda c: F.when((c != 0) & ~F.isnan(c), c.cast("long").cast("string"))
    a, b = bound(low), bound(high)
    return F.coalesce(F.concat(a, F.lit(" - "), b, F.lit(" "), mark), F.concat(F.lit(FROM), a, F.lit(" "), mark), F.concat(F.lit(UP_TO), b, F.lit(" "), mark), F.lit(""))


def _filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def _millis(value: Column) -> Column:
    return F.when(value > 0, F.date_format(F.timestamp_millis(value), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def _list(*parts: Column) -> Column:
    return F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))


Record = Callable[[str], Column]

#: Of each source: title, company, location, description, url, posted_at, salary and native id; ``g`` gives a field of its record.
PROJECTIONS: dict[str, Callable[[Record], list[Column]]] = {
    "adzuna": lambda g: [g("title"), g("company.display_name"), g("location.display_name"), g("description"), g("redirect_url"), g("created"), salary(g("salary_min"), g("salary_max")), g("id")],
    "careerjet": lambda g: [g("title"), g("company"), g("locations"), g("description"), g("url"), g("date"), g("salary"), F.lit(None)],
    "france_travail": lambda g: [g("intitule"), g("entreprise.nom"), g("lieuTravail.libelle"), g("description"), g("origineOffre.urlOrigine"), g("dateCreation"), g("salaire.libelle"), g("id")],
    "free_work": lambda g: [
        g("title"), g("company.name"), _filled(g("location.label"), g("location.adminLevel1")), g("description"),
        F.coalesce(_filled(g("applicationUrl")), F.when(_filled(g("slug")).isNotNull(), F.format_string(FREE_WORK, F.coalesce(_filled(g("job.nameForContributionSlug")), F.lit("informatique")), F.trim(g("slug"))))),
        _filled(g("publishedAt"), g("createdAt")), salary(g("minAnnualSalary"), g("maxAnnualSalary")), g("id"),
    ],
    "jobspy": lambda g: [g("title"), g("company"), g("location"), g("description"), g("job_url"), g("date_posted"), salary(g("min_amount"), g("max_amount"), F.coalesce(_filled(g("currency")), F.lit("€"))), g("id")],
    "jooble": lambda g: [g("title"), g("company"), g("location"), g("snippet"), g("link"), g("updated"), g("salary"), g("id")],
    "greenhouse": lambda g: [
        g("title"), _filled(g("company"), g("company_name")), preferred_location(_list(F.split(g("location.name"), ";"), F.transform(g("offices"), lambda o: F.coalesce(_filled(o["location"]), _filled(o["name"]), F.lit(""))))),
        g("content"), g("absolute_url"), _filled(g("first_published"), g("updated_at")), F.lit(""), g("id"),
    ],
    "lever": lambda g: [g("text"), g("company"), preferred_location(_list(F.array(F.coalesce(g("categories.location"), F.lit(""))), g("categories.allLocations"))), g("descriptionPlain"), g("hostedUrl"), _millis(g("createdAt")), F.lit(""), g("id")],
    "ashby": lambda g: [
        g("title"), g("company"),
        preferred_location(_list(F.array(F.coalesce(g("location"), F.lit("")), F.concat_ws(", ", _filled(g("address.postalAddress.addressLocality")), _filled(g("address.postalAddress.addressCountry")))), F.transform(g("secondaryLocations"), lambda s: F.coalesce(s["location"], F.lit(""))))),
        g("descriptionPlain"), g("jobUrl"), g("publishedAt"), F.lit(""), g("id"),
    ],
}


def comparable(text: Column) -> Column:
    """Lower case without accents, HTML or signs, single spaces; references must be decoded before."""
    return F.trim(F.regexp_replace(F.lower(unaccent(text)), r"[^\p{L}\p{N}]+", " "))


def unwrapped(raw: DataFrame, source: str = "source", json: str = "json") -> DataFrame:
    """One row a record, for rows that hold a list of records, bare or as
    ``hydra:member``, ``member`` or ``jobs`` of an envelope; other rows stay as they are."""
    each = F.from_json(F.col(json), "array<string>", {"mode": "PERMISSIVE"})
    names = ["hydra:member", "member", "jobs"]
    inside = F.from_json(F.col(json), ", ".join(f"`{n}` array<string>" for n in names), {"mode": "PERMISSIVE"})
    listed = F.when(F.trim(json).startswith("["), each).otherwise(F.coalesce(*(inside[n] for n in names)))
    return raw.withColumn(json, F.explode(F.coalesce(listed, F.array(F.col(json)))))


def normalised(raw: DataFrame, source: str = "source", json: str = "json") -> DataFrame:
    """The offer's fields, its ``native_key``, the ``json`` it came from and
    ``reason``, of every row of (source, json): null for an offer, else why it is
    none (unknown source, unparsable, no title, no url, not listed). Columns of
    ``raw`` besides these stay, such as the families of the terms that found it."""
    more = [c for c in raw.columns if c not in (source, json, *OFFER_FIELDS)]
    of = F.col("_of")
    rows = raw.select(*more, F.col(source).alias("_of"), F.col(json).alias("_json"))
    names = ["title", "company", "location", "description", "url", "posted_at", "salary", "_native"]

    def made(n: str) -> Column:
        """What a source's record gives, parsed once: a lambda's element isn't computed again for each field."""
        parsed = F.from_json("_json", f"{SCHEMAS[n]}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})

        def fields(record: Column) -> Column:
            get = lambda path: reduce(lambda c, part: c[part], path.split("."), record)
            told = {f"_{name}": clean(c.cast("string")) for name, c in zip(names, PROJECTIONS[n](get))}
            origin = F.concat(F.lit("jobspy:"), F.coalesce(_filled(get("site")), F.lit(NO_BOARD))) if n == "jobspy" else F.lit(n)
            told |= {"_corrupt": get("_corrupt"), "source": origin, "_site": get("site") if n == "careerjet" else F.lit(None).cast("string"), "_hidden": ~F.coalesce(get("isListed"), F.lit(True)) if n == "ashby" else F.lit(False)}
            return F.struct(*(c.alias(name) for name, c in told.items()))

        return F.transform(F.array(parsed), fields)[0]

    case = F.lit(None)
    for n in reversed(SCHEMAS):
        case = F.when(of == n, made(n)).otherwise(case)
    fields = [*(f"_{n}" for n in names), "_corrupt", "_site", "_hidden"]
    # All fields leave the record's struct at one place.
    rows = rows.select(*more, "_of", "_json", F.inline_outer(F.array(case))).withColumn("source", F.coalesce("source", "_of"))
    rows = rows.withColumns({f"_{n}": F.coalesce(f"_{n}", F.lit("")) for n in names}).select(*more, "_of", "_json", "source", *fields)
    # Python decodes references, one call for each column, of the sources that have them.
    rows = rows.withColumns({f"_{c}": F.coalesce(unescape(F.when(of.isin(*ESCAPED[c]), F.col(f"_{c}"))), F.col(f"_{c}")) for c in ESCAPED if ESCAPED[c]})
    rows = rows.withColumns({f"_{c}": F.when(of.isin(*HTML[c]), bare_html(f"_{c}")).otherwise(F.col(f"_{c}")) for c in HTML})
    content = F.when(of == "careerjet", F.concat_ws("\u0001", "_title", bare_html("_company"), bare_html("_location"), bare_html(F.coalesce("_site", F.lit("")))))
    rows = rows.withColumns({f"_d_{c}": unescape(F.when(of.isin(*HTML[c], *REFERENCES[c]), F.col(f"_{c}"))) for c in HTML} | {"_content": unescape(content)})
    text = {c: F.coalesce(F.when(of.isin(*HTML[c]), squeeze(f"_d_{c}")).otherwise(F.col(f"_d_{c}")), F.col(f"_{c}")) for c in HTML}
    digest = F.array_join(F.transform(F.split("_content", "\u0001"), comparable), "|")
    native = F.coalesce(F.concat(F.lit("id:"), F.nullif(F.col("__native"), F.lit(""))), F.when(F.length(F.replace(digest, F.lit("|"), F.lit(""))) > 0, F.concat(F.lit("contenu:"), F.sha1(digest))))
    rows = rows.select(*more, "_of", "_json", "_corrupt", "_hidden", "source", *(text.get(n, F.col(f"_{n}")).alias(n) for n in names[:-1]), native.alias("_native"))
    key = link_key("url", F.col("_native"))
    reason = F.when(F.coalesce(~of.isin(*SCHEMAS), F.lit(True)), "unknown source").when(F.col("_corrupt").isNotNull() | F.col("_json").isNull(), "unparsable").when(F.col("title") == "", "no title").when(F.col("url") == "", "no url").when(F.col("_hidden"), "not listed")
    return rows.select(*OFFER_FIELDS[:-1], F.when(F.col("url") != "", key).alias("native_key"), *more, F.col("_json").alias("json"), reason.alias("reason"))


def normalise(raw: DataFrame, source: str, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(offers, rejects) of one source's JSON in column ``json``. Rejects are (source, json, reason)."""
    return normalise_all(raw.withColumn("source", F.lit(source)), "source", json)


def normalise_all(raw: DataFrame, source: str = "source", json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(offers, rejects) of rows (source, json) of all sources; every row is in one of the two."""
    rows = normalised(raw, source, json)
    return rows.where("reason IS NULL").drop("reason", "json"), rows.where("reason IS NOT NULL").select("source", "json", "reason")


def read_landed(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Offers and rejects of a folder of a source's landed JSON: a record or a list of records a line."""
    return normalise(unwrapped(spark.read.text(path).withColumnRenamed("value", "json")), source)


def link_key(url: Column | str, native: Column) -> Column:
    """Identity of a link: the native key, else the normalised URL."""
    return F.coalesce(F.nullif(native, F.lit("")), F.concat(F.lit("url:"), normal_url(url)))


def links(offers: DataFrame) -> DataFrame:
    """(source, key, url): the link of every offer."""
    return offers.select("source", F.col("native_key").alias("key"), "url")
