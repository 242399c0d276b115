"""License scans: MinHash bands over overlapping windows find templates, exact
shingle containment verifies them. DataFrame functions only.

Words are runs of letters and digits of the lower-cased text, shingles are
``SHINGLE`` words, and a match is a template of whose different shingles
``CONTAINMENT`` or more stand in the document.

Retrieval. Windows of ``WINDOW`` shingles start at every ``STRIDE``-th shingle
of a document, and at every shingle of a template. A window has ``BANDS`` bands
of one MinHash each: under each of BANDS / 2 orders (the shingle's hash, hashed
again with the order's number), the least and the greatest. Either is shared by
two windows of similarity s with probability s, so they meet in a band with
probability 1 - (1 - s)^BANDS or so: 0.98 at 0.4, 0.996 at 0.5; a test measures
it. A copy of a template with at least ``WINDOW + STRIDE - 1`` shingles holds a
whole window, which meets its twin in every band. Templates with fewer have
windows of ``SMALL`` shingles, in documents one after the other, whose least and
greatest under one order are both of its shingles: they are never missed.

Verification. Only retrieved (document, template) pairs go on: the shingles of
these documents are counted in the template, exactly.

Cost. Each document is one row; its band keys are exploded and looked up in the
templates' keys, a table of fixed size that is broadcast while it has at most
``BROADCAST_ROWS`` rows and joined by a shuffle beyond. Only keys that hit leave
the scan; no text is shuffled unless very many pairs are retrieved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import landed

SHINGLE, CONTAINMENT = 5, 0.8
WINDOW, STRIDE, BANDS = 8, 4, 8
SHORT, SMALL = WINDOW + STRIDE - 1, 2
BROADCAST_ROWS = 200_000

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"

#: Short notices and the distinctive passages of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Released under the MIT License.",
    "mit-text": f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: {_AS_IS}",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3-clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """(license, text) of the given texts."""
    rows = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in sorted(texts.items())))
    return spark.range(1).select(F.inline(rows))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: named inside a lambda as an
    expression, it would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: str) -> Column:
    """Hashes of a text's shingles in order; none for a null text or one of fewer words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def hashed(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
        return F.when(F.size(words) >= SHINGLE, each).otherwise(F.array().cast("array<long>"))

    return let(words, hashed)


def band_keys(h: Column, stride: int, window: int = WINDOW, orders: range = range(1, BANDS // 2 + 1)) -> Column:
    """MinHashes of every window: two runs of one key a window for each order. Order 0 is that of the hashes themselves."""

    def bands(hashes: Column, order: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - window, F.lit(0)), F.lit(stride))
        windows = lambda m: F.transform(starts, lambda i: F.slice(m, i + 1, window))
        both = lambda w: F.concat(F.transform(w, F.array_min), F.transform(w, F.array_max))
        mixed = F.transform(hashes, lambda x: F.xxhash64(x, F.lit(order))) if order else hashes
        return let(mixed, lambda m: let(windows(m), both))

    return let(h, lambda hashes: F.concat(*(bands(hashes, order) for order in orders)))


def small_keys(h: Column, stride: int) -> Column:
    """``band_keys`` of small windows under one order; the last one reaches back, so that no shingle is left out."""
    whole = band_keys(h, stride, SMALL, range(1))
    return F.when(F.size(h) % SMALL == 1, F.concat(whole, F.slice(h, -1, 1))).otherwise(whole) if stride > 1 else whole


def template_shingles(given: DataFrame) -> DataFrame:
    """(license, h, size): shingles of every template that has one. size: its different shingles."""
    return given.select("license", shingles("text").alias("h")).where(F.size("h") > 0).withColumn("size", F.size(F.array_distinct("h")))


def template_keys(hashed: DataFrame) -> DataFrame:
    """(key, license): band keys of the templates' windows."""
    key = F.when(F.col("size") < SHORT, small_keys(F.col("h"), 1)).otherwise(band_keys(F.col("h"), 1))
    return hashed.select(F.explode(F.array_distinct(key)).alias("key"), "license")


def retrieve(docs: DataFrame, keys: DataFrame, text: str, id_col: str) -> DataFrame:
    """(_id, license): pairs of which a band's key is shared, once each."""
    small = keys.count() <= BROADCAST_ROWS
    h = shingles(text)
    both = let(h, lambda x: F.concat(band_keys(x, STRIDE), small_keys(x, SMALL)))
    # The keys are a column before they are exploded, so that the explosion and the lookup compile into one loop. An
    # outer explosion, since an inner one infers a filter on the array's size, which computes all hashes once more.
    spread = docs.select(F.col(id_col).alias("_id"), both.alias("_keys")).select("_id", F.explode_outer("_keys").alias("key"))
    return spread.join(F.broadcast(keys) if small else keys, "key").select("_id", "license").distinct()


def scan(docs: DataFrame, given: DataFrame | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, license, matched, template_shingles, containment, first_word): one
    row for each document and template that it contains to CONTAINMENT or more.

    Null, empty and very short texts match nothing; very long ones are scanned
    whole. Rows that repeat an id, or have none, count as one document. An empty
    table of documents or templates gives no row; other columns are ignored."""
    hashed = template_shingles(given if given is not None else templates(docs.sparkSession))
    found = landed(retrieve(docs, template_keys(hashed), text, id_col), "retrieved")
    small = found.count() <= BROADCAST_ROWS
    own = hashed.select(F.col("license").alias("_of"), "size", F.explode(F.array_distinct("h")).alias("key"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text"))
    pairs = texts.join(F.broadcast(found) if small else found, F.expr("_doc <=> _id")).select("_id", "license", F.posexplode(shingles("_text")).alias("_place", "key"))
    matched = pairs.join(own, (pairs["key"] == own["key"]) & (F.col("license") == F.col("_of"))).groupBy("_id", "license", "size").agg(F.count_distinct(pairs["key"]).alias("matched"), F.min("_place").cast("long").alias("first_word"))
    return matched.where(F.col("matched") >= CONTAINMENT * F.col("size")).select(
        F.col("_id").alias(id_col), "license", "matched", F.col("size").cast("long").alias("template_shingles"), (F.col("matched") / F.col("size")).alias("containment"), "first_word"
    )
