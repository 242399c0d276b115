"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import alignment, bpe, conversations, decontaminate, html_text, license_scan, lm_score, minhash, quality_crf, quality_rules, simhash, toxicity, warc
from gristmill.llm.common import held_out, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_rows")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score_all(docs, lm_score.targets(table(spark, sf_dir, "labels")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.load())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.audit(conversations.damage(rows)).withColumnRenamed("conv_id", "_conv")
    names, texts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    both = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return both.select("conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names), *(F.coalesce(n, F.lit(v)).alias(n) for n, v in texts.items()))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.statistics(table(spark, sf_dir, "documents"), alignment.load())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_warc, op3_quality_rules, op4_toxicity, op5_html_text, op6_quality_crf, op7_license_scan, op8_lm_score, op9_decontaminate, op10_bpe, op11_conversation_repair, op12_minhash, op13_alignment)
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(license_scan.TEMPLATES.items()))
_SHINGLES = "SELECT {0}, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT {0}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {1}), unnest(range(0, greatest(0, len(w) - 4))) r(i)"

#: Where SQL can express a query on whole tables.
ORACLE: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
        ), k AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM k
    """,
    "op7_license_scan": f"""
        WITH templates(license, text) AS (VALUES {_TEMPLATES}), t AS (
            SELECT DISTINCT license, s FROM ({_SHINGLES.format("license", "templates")})
        ), n AS (
            SELECT license, count(*) AS template_shingles FROM t GROUP BY license
        ), d AS (
            {_SHINGLES.format("doc_id", "documents")}
        ), m AS (
            SELECT doc_id, license, count(DISTINCT s) AS matched, min(i) AS first_word FROM d JOIN t USING (s) GROUP BY doc_id, license
        )
        SELECT doc_id, license, matched, template_shingles, matched / template_shingles AS containment, first_word
        FROM m JOIN n USING (license) WHERE matched >= 0.8 * template_shingles
    """,
    "op9_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        phrases AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) r(i) WHERE len(w) > 0
        ), places AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM phrases) k, unnest(range(1, greatest(1, len(w) - n + 2))) r(i)
        ), found AS (
            SELECT doc_id, i, p.n, item_id FROM places p JOIN phrases q ON p.s = q.s AND p.n = q.n
        ), hit AS (
            SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found), range(0, 13) x(j) WHERE j < n GROUP BY doc_id
        ), own AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM found GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
    """,
    "op11_conversation_repair": r"""
        WITH RECURSIVE fates AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda s: [ord(s), -1, -1, -1, -1, -1, -1, -1, -1]) AS bits
            FROM conversations
        ), crc AS (
            SELECT * EXCLUDE (bits), xor(4294967295, list_reduce(flatten(bits), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295::BIGINT)) % 20 AS fate FROM fates
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
            FROM crc, range(0, 2) r(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM damaged
        ), m AS (
            SELECT conv_id, turn, role, text, i, left(role, 1) AS c, CASE WHEN bare = '' THEN 1 WHEN again > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed
        ), inserts(q, p, edits, lines) AS (
            VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', chr(10) || 'user:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 2, 'I', chr(10) || 'user:'),
                   (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 3, 'I', chr(10) || 'assistant:'), (3, 2, 'I', chr(10) || 'user:')
        ), moves(edit, p, q, initial, made) AS (
            VALUES ('D', 0, 0, NULL, NULL), ('D', 1, 1, NULL, NULL), ('D', 2, 2, NULL, NULL), ('D', 3, 3, NULL, NULL), ('K', 0, 1, 's', NULL), ('K', 0, 2, 'u', NULL), ('K', 1, 2, 'u', NULL), ('K', 3, 2, 'u', NULL),
                   ('K', 2, 3, 'a', NULL), ('R', 0, 2, NULL, 'user'), ('R', 1, 2, NULL, 'user'), ('R', 2, 3, NULL, 'assistant'), ('R', 3, 2, NULL, 'user')
        ), best AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS b FROM conversations
            UNION ALL
            SELECT conv_id, i, q, min(b) FROM (
                SELECT m.conv_id, m.i, v.q, {
                    'cost': b.cost + 2 * length(edits) + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 3 THEN 1 ELSE 0 END,
                    'audit': b.audit || edits || edit,
                    'lines': b.lines || x.lines || CASE WHEN edit = 'D' THEN '' ELSE chr(10) || coalesce(made, role) || ':' || text END} AS b
                FROM best JOIN inserts x ON x.q = best.q JOIN m ON m.conv_id IS NOT DISTINCT FROM best.conv_id AND m.i = best.i + 1
                JOIN moves v ON v.p = x.p AND (initial IS NULL OR initial = c) AND (edit = 'D' OR fault IN (0, 3))
            ) GROUP BY conv_id, i, q
        ), sizes AS (
            SELECT c.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated
            FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
        ), neighbours AS (
            SELECT conv_id, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, c, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM m) GROUP BY conv_id
        ), ended AS (
            SELECT s.conv_id, min({'cost': b.cost + 2 * length(edits), 'audit': b.audit || edits, 'lines': b.lines || x.lines}) AS b
            FROM sizes s JOIN best ON best.conv_id IS NOT DISTINCT FROM s.conv_id AND best.i = s.n JOIN inserts x ON x.q = best.q AND x.p IN (0, 3) GROUP BY s.conv_id
        )
        SELECT s.conv_id, gaps, blank, duplicate, truncated, coalesce(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit, sha256(substr(b.lines, 2)) AS repaired_sha256
        FROM sizes s JOIN ended e ON e.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN neighbours k ON k.conv_id IS NOT DISTINCT FROM s.conv_id
    """,
    "op12_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM w, unnest(range(1, greatest(1, len(w) - 3) + 1)) r(i) WHERE len(w) > 0
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), links AS (
            SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) p
            JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
        ), c AS (
            SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
        )
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
}
