"""The registered queries of the corpus operators (production parameters, whole tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpulse.llm import (collocation, decontaminate, divergence, lattice_dedup, ngram_join, packing, pii, ppm, quality, secrets, substrings,
                          token_files, toxicity)
from netpulse.llm.common import fold, read
from netpulse.llm.spans import joined

TOKENIZER = "word_bpe_49k.json"


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end_id=0)


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_folder(spark, "token-ids")
    token_files.write_token_ids(read(spark, sf_dir, "documents"), path, TOKENIZER, end_id=1)
    return token_files.stored_digest(spark, path)


def _count(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op8_candidate_boosting_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read(spark, sf_dir, "documents"))
    found = found.withColumn("base", F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *[_count("base", k) for k in pii.KINDS],
                        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count("base", k) for k in secrets.STRONG],
                        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _scored(scores: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scores.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return _scored(toxicity.toxicity_scores(docs, labels, "toxic", folds=4, held_out=2), 4, 2)


def op1_e8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question", "answer")])


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_links(read(spark, sf_dir, "documents"), k=5, percent=75)
    return found.select("doc_id", "n_shingles", "component_id", "class", "n_links")


def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return _scored(quality.quality_scores(docs, labels, "quality", folds=5, held_out=0), 5, 0)


def op6_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.text_scores(read(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op11_quicksort_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


def op13_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_e8_lattice_dedup": op1_e8_lattice_dedup,
    "op2_compression_toxicity": op2_compression_toxicity,
    "op3_bm25_decontamination": op3_bm25_decontamination,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_ftrl_quality": op5_ftrl_quality,
    "op6_ppm_scores": op6_ppm_scores,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_candidate_boosting_pii": op8_candidate_boosting_pii,
    "op9_multipart_secrets": op9_multipart_secrets,
    "op10_token_orc": op10_token_orc,
    "op11_quicksort_collocations": op11_quicksort_collocations,
    "op12_source_divergence": op12_source_divergence,
    "op13_de_bruijn_dedup": op13_de_bruijn_dedup,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what the three operators that SQL can express must return
ORACLE: dict[str, str] = {
    "op11_quicksort_collocations": rf"""
WITH piece AS (
  SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]') AS pieces
    FROM documents)),
word AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
gram AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM word, range(1, 6) AS s(m) WHERE i + m - 1 <= len(w)),
total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS c FROM gram GROUP BY lang, m, phrase HAVING count(*) >= 100),
cut AS (
  SELECT lang, m, phrase, c AS a, k, string_split(phrase, ' ') AS w FROM f, range(1, 5) AS s(k) WHERE m > k),
scored AS (
  SELECT cut.lang, cut.m, cut.phrase, a, k, x.c AS l, y.c AS r, n, (1000::HUGEINT * a * n) // (x.c::HUGEINT * y.c) AS score
  FROM cut JOIN total USING (lang)
  JOIN f AS x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1 : k], ' ')
  JOIN f AS y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1 :], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest AS p WHERE NOT EXISTS (
    SELECT 1 FROM f AS q WHERE q.lang = p.lang AND q.m > p.m AND q.c >= p.a AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op12_source_divergence": rf"""
WITH doc AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_LOWER}') AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS total FROM word GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
counted AS (SELECT lang, source, term, count(*) AS c FROM word SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
lang AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
grp AS (
  SELECT g.lang, g.source, coalesce(lang.v, 0) AS v, coalesce(lang.n, 0) AS lang_n, coalesce(own.n, 0) AS own_n
  FROM (SELECT DISTINCT lang, source FROM doc) AS g LEFT JOIN lang USING (lang)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counted GROUP BY lang, source) AS own ON own.lang = g.lang AND own.source = g.source),
p AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (own_n + 5 * v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (total + 5)) // (lang_n + 5 * v)::HUGEINT AS q
  FROM grp JOIN kept ON kept.lang = grp.lang
  LEFT JOIN counted ON counted.lang = grp.lang AND counted.source = grp.source AND counted.term = kept.term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(max(d.value), 0) AS value
  FROM grp AS a JOIN grp AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term
             GROUP BY ALL) AS d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  GROUP BY ALL),
every AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op13_de_bruijn_dedup": r"""
WITH doc AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT id, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 33)) AS i FROM doc)),
again AS (SELECT id, i FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
covered AS (SELECT DISTINCT id, unnest(range(i, i + 35)) AS j FROM again),
word AS (SELECT id, j, w[j] AS word FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS j FROM doc)),
kept AS (
  SELECT id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM word ANTI JOIN covered ON word.id = covered.id AND word.j = covered.j GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (id)""",
}
