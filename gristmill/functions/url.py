"""URL normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.columns import col

#: Parameters that only track where a visitor came from.
TRACKING = ["se", "v", "fbclid", "gclid", "ref", "refid", "src", "trk", "trackingid", "tracking_id"]


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _coded(text: Column) -> Column:
    """As forms code a name or value: letters, digits and _.-~ stand for themselves."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normal_url(url: Column | str) -> Column:
    """Lower-case scheme and host, no fragment, no final slash, no tracking
    parameters; the others decoded, sorted by name and value and coded again,
    blank values kept."""
    whole = F.regexp_replace(F.trim(col(url)), r"#.*$", "")
    base, query = F.split_part(whole, F.lit("?"), F.lit(1)), F.regexp_extract(whole, r"\?(.*)$", 1)
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.regexp_replace(F.substr(base, F.length(host) + 1), "/+$", "")
    part = lambda p, pattern: F.regexp_extract(p, pattern, 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(_decoded(part(p, "^([^=]*)")).alias("k"), _decoded(part(p, "=(.*)$")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*TRACKING)))
    shown = F.array_join(F.transform(kept, lambda p: F.concat(_coded(p["k"]), F.lit("="), _coded(p["v"]))), "&")
    return F.concat(F.lower(host), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), shown)).otherwise(""))
