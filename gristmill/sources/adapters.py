"""The given tables as the engine's domain relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.dedup import identity_key, richness


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str, vectors: bool = False, labels: bool = False) -> DataFrame:
    """documents as offers: the first line is the title, the source the company,
    the language the location. With ``vectors``, an offer without one stays, with nulls."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("company"), F.col("lang").alias("location"), F.col("text").alias("description"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(60)).cast("int")).alias("posted_at"), F.lit("").alias("salary"),
    )
    if vectors:
        rows = with_vectors(rows, spark, sf_dir)
    if labels:
        rows = rows.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), "quality", "toxic"), "ord")
    return rows


def with_vectors(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` with the vector of their ``ord``, or null; what goes through this join should be slim."""
    return rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", F.col("label").alias("topic")), "ord", "left")


def keyed_offers(spark: SparkSession, sf_dir: str, **parts: bool) -> DataFrame:
    return offers(spark, sf_dir, **parts).withColumn("key", identity_key()).withColumn("richness", richness())


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a work queue."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("offer_id"), F.sha2(F.concat_ws("|", "o_custkey", "o_orderpriority"), 256).alias("offer_hash"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"), F.pmod("o_orderkey", F.lit(5)).cast("int").alias("attempts"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as feedback on offers."""
    verdict = F.when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "error", "bad").otherwise("none")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("offer_id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"), verdict.alias("verdict"), "value", "props")


def run_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as links seen in daily runs: source, link and the offer's key."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("source"), F.concat(F.lit("l"), F.pmod("event_id", F.lit(700)).cast("string")).alias("link"), F.col("user_id").alias("key"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers with coordinates made from their keys."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("place"), F.col("c_nationkey").alias("nation"), (F.lit(2.0) + F.pmod("c_custkey", F.lit(97)) / 100.0).alias("lon"), (F.lit(48.4) + F.pmod("c_custkey", F.lit(89)) / 100.0).alias("lat")
    )


#: Fixed value: where labels come from that don't say so.
DEFAULT_PROVENANCE = "corpus_aveugle"
LABEL = "cle string, pertinent int, etiquete_le string, title string, company string, url string, provenance string"


def label_rows(rows: DataFrame, json: str = "json") -> DataFrame:
    """Labels from landed JSON, a label a row: (key, relevant, labelled, title, company, url, provenance), blanks for what is missing."""
    r = F.from_json(F.col(json), LABEL)
    text = lambda c: F.coalesce(F.col(f"_r.{c}"), F.lit(""))
    return rows.select(r.alias("_r")).select(F.col("_r.cle").alias("key"), F.col("_r.pertinent").alias("relevant"), text("etiquete_le").alias("labelled"), text("title").alias("title"), text("company").alias("company"), text("url").alias("url"), F.coalesce("_r.provenance", F.lit(DEFAULT_PROVENANCE)).alias("provenance"))


#: An offer of a cached ranking.
RANKED = "title string, company string, location string, description string, url string, source string, posted_at string, salary string, tags array<string>, familles array<string>, duree_mois int, date_debut string, nouvelle boolean, cos_score double, ia_rang int, ia_score double"


def ranking_rows(rows: DataFrame, json: str = "json") -> DataFrame:
    """Offers of a cached ranking from landed JSON, an offer a row, beside the
    other columns: texts are blank and the score is 0 where they are missing, ranks and scores of a verdict null."""
    more = [c for c in rows.columns if c != json]
    r = rows.select(*more, F.from_json(F.col(json), RANKED).alias("_r"))
    text = [F.coalesce(F.col(f"_r.{c}"), F.lit("")).alias(c) for c in ("title", "company", "location", "description", "url", "source", "posted_at", "salary")]
    lists = [F.coalesce(F.col(f"_r.{c}"), F.array().cast("array<string>")).alias(n) for c, n in (("tags", "tags"), ("familles", "families"))]
    return r.select(*more, *text, *lists, F.col("_r.duree_mois").alias("months"), F.coalesce("_r.date_debut", F.lit("")).alias("start"), F.col("_r.nouvelle").alias("new"), F.coalesce("_r.cos_score", F.lit(0.0)).alias("score"), F.col("_r.ia_rang").alias("ia_rank"), F.col("_r.ia_score").alias("ia_score"))


def overlaid(base: dict, local: dict) -> dict:
    """A configuration with a local one laid over it: blocks key by key one level deep, all else as a whole."""
    return base | {k: base[k] | v if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in local.items()}
