"""Queries over the training-data tables, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, media, packing, passages, phrases, pii, quality, secrets, sharding, simhash, spelling, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path and word pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *vocabulary()).withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), *vocabulary()).withColumnRenamed("id", "doc_id")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so each vector of ``embeddings`` is drawn as one."""
    vectors = table(spark, sf_dir, "embeddings")
    return media.image_copies(vectors, "vec_id", F.col("embedding"), draw=True).withColumnRenamed("id", "vec_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.sanitised(pii.detect(table(spark, sf_dir, "documents")))).withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.without_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), every=31)


QUERIES = {
    f.__name__: f
    for f in (op1_shards, op2_urls, op3_simhash, op4_packing, op5_toxicity, op6_bpe, op7_media, op8_secrets, op9_pii, op10_quality, op11_phrases, op12_passages, op13_spelling)
}

#: Everything of ``op10_quality``, its threshold table included.
QUALITY_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
windows AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
named AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS k FROM windows),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM named) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, range(0, 5) r(d) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(hit.n, 0) AS n_repeat_words, len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x IN ({", ".join(f"'{x}'" for x in quality.STOP_WORDS)}))) AS n_stop_words
  FROM w LEFT JOIN hit USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(quality.rule_sql(r) for r in quality.RULES)} AS kept FROM f"""

PHRASES_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang),
w AS (SELECT lang, p, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM split WHERE len(words) > 0),
ahead AS (SELECT lang, w1, lead(w1, 1) OVER q AS w2, lead(w1, 2) OVER q AS w3, lead(w1, 3) OVER q AS w4 FROM w WINDOW q AS (PARTITION BY p ORDER BY i)),
runs AS (SELECT lang, 1 AS k, w1 AS phrase FROM ahead UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM ahead WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM ahead WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM ahead WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM runs GROUP BY lang, phrase HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
inner_ AS MATERIALIZED (SELECT DISTINCT lang, a AS longer, array_to_string(list_slice(words, s, s + m - 1), ' ') AS phrase FROM c, range(2, 4) r(m), range(1, 4) q(s) WHERE m < k AND s + m - 1 <= k),
gone AS MATERIALIZED (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_ USING (lang, phrase) WHERE 100 * longer >= 80 * c.a),
cut AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(list_slice(words, 1, j), ' ') AS head, array_to_string(list_slice(words, j + 1, k), ' ') AS rest FROM c, range(1, 4) t(j) WHERE j < k),
cuts AS (SELECT cut.lang, cut.phrase, cut.a, j, x.a AS l, y.a AS r, ((2000000::HUGEINT * cut.a) // (x.a + y.a))::BIGINT AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = cut.head JOIN f y ON y.lang = cut.lang AND y.phrase = cut.rest),
best AS (SELECT * FROM cuts ANTI JOIN gone USING (lang, phrase) QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

PASSAGES_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS k FROM (SELECT *, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1),
hit AS (SELECT DISTINCT doc_id, i + d AS i FROM twice, range(0, 35) r(d)),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM each ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op10_quality": QUALITY_SQL, "op11_phrases": PHRASES_SQL, "op12_passages": PASSAGES_SQL}
