"""The queries of the training-data operators, by name: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crownlake.llm import decontam, extract, langid, media, packing, records, simhash, substring, toxicity, urlrank
from crownlake.llm.common import table


#: Words, windows of 35 that stand more than once, and what is left, in DuckDB's SQL.
_OP5 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS i)),
r AS (SELECT k FROM v GROUP BY k HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, i + o AS p FROM v JOIN r USING (k), (SELECT unnest(range(35)) AS o)),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT u.doc_id, count(h.p) AS n_removed, string_agg(w, ' ' ORDER BY u.p) FILTER (h.p IS NULL) AS kept FROM u LEFT JOIN h ON h.doc_id = u.doc_id AND h.p = u.p GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Windows of up to 13 words of the items among the documents' words.
_OP6 = f"""WITH d AS (SELECT doc_id, {_W} AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_W} AS ws FROM benchmark),
w AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i:i + 12], ' ') AS k FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i) WHERE len(ws) > 0),
s AS (SELECT DISTINCT n FROM w),
o AS (SELECT doc_id, s.n, i, array_to_string(ws[i:i + s.n - 1], ' ') AS k FROM d, s, LATERAL (SELECT unnest(range(1, len(ws) - s.n + 2)) AS i)),
m AS (SELECT doc_id, o.n, i, item FROM o JOIN w ON w.n = o.n AND w.k = o.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


def op1_url_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrank.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = records.token_records(table(spark, sf_dir, "documents"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    identifier = langid.fit(docs.where(langid.remainder("doc_id", 4) != 2))
    found = langid.identify(docs, identifier, keep=["doc_id"])
    return found.select("doc_id", (langid.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = toxicity.fit(docs, labels.where(langid.remainder("doc_id", 5) != 0))
    found = toxicity.judge(docs, judged, keep=["doc_id"])
    return found.select("doc_id", (langid.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op10_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_rank, op2_token_records, op3_language_id, op4_toxicity, op5_substring_dedup)
    found += (op6_decontamination, op7_html_extraction, op8_packing, op9_simhash_bktree, op10_media_sniffing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others need hashes, tokenizers, trained models or a transitive closure."""
    return {"op5_substring_dedup": _OP5, "op6_decontamination": _OP6}
