"""The registered runs: each applies one operator with production parameters to its whole table.

The archives, the ranking and the filter audit can be said in SQL; tokenizers, parsers, learnt models, XXH64 bit majorities and peeling can't.
tests/llm holds the other queries against brute force, exact round trips or held-out labels instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import audit, decontamination, extraction, fingerprints, online, packing, quality, secrets, simhash, tokencounts, toxicity, wand, warc
from chronopanel.llm.common import read


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(spark, sf_dir, "pages"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(read(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels.where(toxicity.remainder() != 2))
    return toxicity.score(docs, lexicon).withColumn("held_out", toxicity.remainder() == 2)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencounts.edited(docs.withColumn("edits", tokencounts.sample_edits()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.linked(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online.pack_online(read(spark, sf_dir, "documents"))


RUNS = (op1_template_decontamination, op2_best_fit_packing, op3_html_extraction, op4_fingerprints, op5_warc_revisits, op6_secret_scan, op7_quality, op8_toxicity, op9_token_counts, op10_simhash, op11_block_max_wand, op12_filter_audit, op13_online_packing)
QUERIES = {f.__name__: f for f in RUNS}
ORACLES: dict[str, str] = {
    "op5_warc_revisits": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op11_block_max_wand": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
m AS (SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM d, s),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s),
r AS (SELECT item_id, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, bit_count(mask) AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS v),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS v FROM b a, b, b c, b d, b e
  WHERE a.v + b.v + c.v + d.v + e.v = 31 AND len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT filter_order, step, v[step] AS own, CASE WHEN step = 1 THEN 0 ELSE list_sum(v[1:step - 1])::INT END AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(fails, 1))) FILTER (WHERE mask & own <> 0), 0)::BIGINT AS shapley FROM c, s GROUP BY part, filter_order, step""",
}
