"""The queries of the corpus operators over whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import clustering, lang_id, periodic_runs, toxicity, url_filter
from tidemark.llm.decontam import find_leaks
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.license_scan import scan_licenses
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import similar_components
from tidemark.llm.pitman_yor import score_texts
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_output import read_tokens, write_tokens


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op3_url_filter(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.learn_toxicity(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    return toxicity.score_toxicity(docs, model).withColumn("held_out", lang_id.held_out(F.col("doc_id"), 0, 5))


def op5_token_output(spark, sf_dir):
    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op6_ngram_join(spark, sf_dir):
    return similar_components(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_lang_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    profiles = lang_id.learn_profiles(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    return lang_id.identify(docs, profiles).withColumn("held_out", lang_id.held_out(F.col("doc_id")))


def op9_mix_sources(spark, sf_dir):
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_license_scan(spark, sf_dir):
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


def op12_lm_scores(spark, sf_dir):
    trains = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return score_texts(_table(spark, sf_dir, "documents"), trains).withColumn("held_out", lang_id.held_out(F.col("doc_id"), 2, 7))


def op13_cluster_vectors(spark, sf_dir):
    return clustering.cluster_vectors(_table(spark, sf_dir, "embeddings")).drop("computed")


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_suffix_dedup, op3_url_filter, op4_toxicity, op5_token_output, op6_ngram_join, op7_decontaminate, op8_lang_id, op9_mix_sources, op10_license_scan, op11_periodic_runs,
        op12_lm_scores, op13_cluster_vectors,
    )
}

ORACLES = {
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, n.h AS text_sha256 FROM n JOIN g USING (h)""",
    "op2_suffix_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
-- Every string of 400 bytes, as hexadecimal digits.
c AS (SELECT doc_id, j, least(j + 63, length(x) // 2 - 400) AS last, substr(x, 2 * j + 1, 926) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399, 64)) AS j FROM d WHERE length(x) >= 800)),
w AS (SELECT doc_id, i, md5(substr(y, 2 * (i - j) + 1, 800)) AS h FROM (SELECT doc_id, j, y, unnest(range(j, last + 1)) AS i FROM c)),
r AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
s AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS cut FROM r),
g AS (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM s),
p AS (SELECT doc_id, span, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, span),
q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS was FROM p),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(x, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id),
-- Every string of 50 words.
v AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
n AS (SELECT doc_id, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM v WHERE len(words) >= 50)),
m AS (SELECT DISTINCT doc_id FROM n WHERE h IN (SELECT h FROM n GROUP BY h HAVING count(DISTINCT doc_id) > 1))
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256, (m.doc_id IS NOT NULL)::INT AS shares_passage
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op3_url_filter": url_filter.oracle(),
    "op6_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 90 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, c.reached FROM c JOIN e ON e.a = c.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(reached) AS component_id FROM c GROUP BY doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_mix_sources": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS sz, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
-- Shares are dealt by weight; sources over their cap are cut to it and what they leave is dealt to the others again.
r(round, rate) AS (
  SELECT 0, (SELECT sum(sz)::DOUBLE / sum(w) FROM s)
  UNION ALL
  SELECT round + 1, (SELECT (sum(sz) - coalesce(sum(3 * sz) FILTER (w * rate > 3 * sz), 0))::DOUBLE / nullif(sum(w) FILTER (w * rate <= 3 * sz), 0) FROM s)
  FROM r WHERE round < 50),
t AS (SELECT source, sz, least(3.0 * sz, w * (SELECT max(rate) FROM r)) AS target FROM s),
u AS (SELECT source, sz, target, CASE WHEN sz > 0 THEN round(target / sz * 16777216)::BIGINT ELSE 0 END AS units,
  ('0x' || substr(md5('42:' || coalesce(source, '')), 1, 6))::BIGINT AS o FROM t),
c AS (SELECT doc_id, size, sz, target, units, o + units * row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS FIRST) AS p
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, sz AS source_size, target, (((p >> 24) - ((p - units) >> 24)) * size)::BIGINT AS taken FROM c""",
    "op11_periodic_runs": periodic_runs.ORACLE,
    "op13_cluster_vectors": clustering.oracle(),
}
