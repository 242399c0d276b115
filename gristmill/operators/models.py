"""Injected models: an encoder of texts and a judge of offers, each behind a
memo, so that a text is encoded once and an offer judged once.

Both are plain functions from a list to a list that run inside tasks; a model
that is expensive to load should load itself on first use there."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.columns import col, json_inside
from gristmill.functions.text import level

VERDICT = "score double, domain_match boolean, level string, months int, reason string, flags array<string>"


def hashing_encoder(texts: list[str], size: int = 64) -> list[list[float]]:
    """Unit vectors of signed word hashes: deterministic, needs no model."""
    out = []
    for text in texts:
        v = np.zeros(size)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1 if h >> 63 else -1
        norm = float(np.linalg.norm(v))
        out.append((v / norm if norm else v).tolist())
    return out


def encode(rows: DataFrame, key: str, text: str, encoder: Callable[[list[str]], list] = hashing_encoder, model: str = "hashing-64", batch: int = 256) -> DataFrame:
    """(key, model, embedding) of every row; batches of ``batch`` texts."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "model": model, "embedding": encoder(part["_t"].tolist())})

    return rows.select(key, F.coalesce(col(text), F.lit("")).alias("_t")).mapInPandas(run, f"{key} {kind}, model string, embedding array<float>")


def to_encode(title: Column | str, description: Column | str, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(col(title), F.lit("")), F.lit(". "), F.coalesce(col(description), F.lit("")))


def encode_missing(rows: DataFrame, cache: DataFrame, text: str, encoder: Callable[[list[str]], list] = hashing_encoder, model: str = "hashing-64", size: int = 64) -> DataFrame:
    """``cache`` (hash, model, embedding) with the vectors of texts that it
    lacks. Different texts are encoded once; vectors of another size or model don't count."""
    usable = cache.where((F.col("model") == model) & (F.size("embedding") == size))
    wanted = rows.select(F.sha2(F.coalesce(col(text), F.lit("")), 256).alias("hash"), F.coalesce(col(text), F.lit("")).alias("_text")).dropDuplicates(["hash"])
    missing = wanted.join(usable.select("hash"), "hash", "left_anti")
    return usable.select("hash", "model", "embedding").unionByName(encode(missing, "hash", "_text", encoder, model))


def truncated(text: Column | str, most: int) -> Column:
    """Whether an encoder that reads ``most`` words would cut the text."""
    return F.size(F.split(F.trim(col(text)), r"\s+")) > most


def one_model(rows: DataFrame) -> DataFrame:
    """``rows`` if their vectors come from one model; an error otherwise."""
    if len(rows.select("model").distinct().take(2)) > 1:
        raise ValueError("vectors of more than one model")
    return rows


def memo_key(model: str, rules: int, profile: Column | str) -> Column:
    """Key of a verdict: model, version of the rules, start of the profile's hash."""
    return F.concat(F.lit(f"{model}@v{rules}#p"), F.substr(F.sha2(col(profile), 256), F.lit(1), F.lit(12)))


def judge_missing(shortlist: DataFrame, memo: DataFrame, judge: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """``shortlist`` (hash, memo_key and a prompt) with ``verdict``: from the
    memo, else from the judge's answer, a text with a JSON object in it. Equal
    contents are judged once."""
    keys = ["hash", "memo_key"]
    known = shortlist.join(memo.select(*keys, "answer"), keys, "left")
    misses = known.where("answer IS NULL").dropDuplicates(keys).select(*keys, prompt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keys].assign(answer=judge(b[prompt].tolist()))

    fresh = misses.mapInPandas(run, "hash string, memo_key string, answer string")
    both = known.join(fresh.withColumnRenamed("answer", "_fresh"), keys, "left").withColumn("answer", F.coalesce("answer", "_fresh")).drop("_fresh")
    return both.withColumn("verdict", coerce("answer"))


def coerce(answer: Column | str) -> Column:
    """A verdict from a model's answer: score within 0 and 1, the level as one of the ladder, blanks as empty text; null if there is no JSON object."""
    v = json_inside(answer, VERDICT)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v["score"]))
    made = F.struct(score.alias("score"), v["domain_match"].alias("domain_match"), level(v["level"]).alias("level"), v["months"].alias("months"), F.coalesce(F.trim(v["reason"]), F.lit("")).alias("reason"), F.coalesce(v["flags"], F.array().cast("array<string>")).alias("flags"))
    return F.when(v["score"].isNotNull(), made)
