"""Sinks: CSV, JSON and versioned snapshots, written by the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.rank import ranked
from gristmill.operators.store import fingerprint
from gristmill.sources.landing import export

#: The export's columns in order, and those that come from a verdict.
CSV_COLUMNS = ["rang", "score", "match", "nouvelle", "title", "company", "location", "source", "posted_at", "duree_mois", "date_debut", "salary", "score_llm", "pertinent", "niveau", "est_alternance", "drapeaux_rouges", "justification", "url", "description"]
VERDICT_COLUMNS = CSV_COLUMNS[12:18]


def csv_rows(offers: DataFrame, order: str = "ord") -> DataFrame:
    """The export's columns: rank from 1, scores to four decimals, tags between
    spaces and flags between bars, oui and non for what is true and false, blanks
    for what is missing. ``tags``, ``new``, ``months``, ``start`` and a struct
    ``verdict`` (score, relevant, level, apprenticeship, flags, reason) are optional."""
    placed = ranked(offers, F.desc("score"), F.asc(order))
    have = set(placed.columns)
    get = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    yes = lambda c, no: F.when(c, "oui").when(~c, no).otherwise("")
    told = {
        "rang": F.col("rank"), "score": F.round("score", 4).cast("string"), "match": F.concat_ws(" ", "tags") if "tags" in have else F.lit(""), "nouvelle": yes(F.col("new"), "") if "new" in have else F.lit(""),
        "duree_mois": get("months"), "date_debut": get("start"),
    }
    if "verdict" in have:
        v = F.col("verdict")
        cells = [F.round(v["score"], 4).cast("string"), yes(v["relevant"], "non"), v["level"], yes(v["apprenticeship"], "non"), F.concat_ws(" | ", v["flags"]), v["reason"]]
        told |= {c: F.when(v.isNotNull(), F.coalesce(x, F.lit(""))).otherwise("") for c, x in zip(VERDICT_COLUMNS, cells)}
    return placed.select(*(told.get(c, get(c)).alias(c) for c in CSV_COLUMNS))


def write_csv(offers: DataFrame, path: str, order: str = "ord") -> None:
    """The export in order of rank over the files, each with the UTF-8 mark and a header; there whole or not at all."""
    export(csv_rows(offers, order).orderBy("rang"), path, bom=True)


def write_stable_json(rows: DataFrame, path: str, key: str) -> None:
    """JSON lines ordered by key over the files, fields in name order; there whole or not at all."""
    export(rows.orderBy(key), path, "json")


def freeze(rows: DataFrame, path: str) -> DataFrame:
    """A versioned snapshot beside a manifest row (rows, fingerprint)."""
    rows.write.mode("errorifexists").parquet(f"{path}/data")
    manifest = rows.agg(F.count("*").alias("rows")).join(F.broadcast(fingerprint(rows)))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


#: Longest text that is shown whole, and how much is shown of a longer one.
WHOLE, CUT = 58, 55


def short_value(value: str, kind: str = "string") -> Column:
    """A value for reading side by side: a long text cut, an array or map (of
    ``kind``) as its size and the beginning of the SHA-256 of its JSON, keys sorted."""
    v = F.col(value)
    json = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    if kind == "array":
        text = F.concat(F.lit("["), F.array_join(F.transform(v, json), ", "), F.lit("]"))
    elif kind == "map":
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(v)), lambda k: F.concat(json(k), F.lit(": "), json(F.element_at(v, k)))), ", "), F.lit("}"))
    else:
        v = v.cast("string")
        return F.when(F.length(v) > WHOLE, F.concat(F.substr(v, F.lit(1), F.lit(CUT)), F.lit("…"))).otherwise(v)
    return F.concat(F.size(v).cast("string"), F.lit(" élément(s)  ["), F.substr(F.sha2(text, 256), F.lit(1), F.lit(8)), F.lit("]"))
