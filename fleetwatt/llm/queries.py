"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatt.llm import bpe, embeddings, language, licenses, minhash, mixing, mixture_lm, negatives, pii, quality, repeats, search, secrets
from fleetwatt.llm.text import small_batches
from fleetwatt.session import use_utc

#: Production parameters of the registered mixture.
TARGET_ENTROPY = 0.98
MAX_REPEATS = 2.0

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            small_batches(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The cosine from which op1 links vectors.
COSINE = 0.9


@query("op1_embedding_grid")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors."""
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), COSINE)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The similarity, in percent, from which op2 links documents.
SIMILAR = 85


@query("op2_minhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = minhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), SIMILAR)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


@query("op3_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", secrets.secret_column(spark, secrets.learn(docs), "text").alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.sha2(secrets.joined(F.col("s"), base_only=True).cast("binary"), 256)
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), base.alias("base_sha256"), secrets.joined(F.col("s")).alias("spans"))


@query("op4_repeats")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without byte strings that stand twice or more."""
    return repeats.removed(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of all documents."""
    automaton = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.round_trip_column(spark, automaton, "text").alias("x")).select("doc_id", "x.*")


def bucket(col: str, n: int):
    """crc32 of a column as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


@query("op6_mixture_lm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by models of those whose bucket is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixture_lm.scored(docs, bucket("doc_id", 10) == 0).withColumnRenamed("id", "doc_id")


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, from profiles of those whose bucket is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(bucket("doc_id", 4) == 2, F.lit(False))
    known = language.profiles(docs.filter(F.col("doc_id").isNotNull() & ~held))
    x = language.language_column(spark, known, "text")
    return docs.select("doc_id", held.alias("held_out"), x.alias("x")).select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), "x.score")


# shares, then the exponent by the same bisection, then running totals in the same order of documents
OP8_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, md5('mix:' || doc_id) AS h FROM documents
), p AS (
  SELECT *, md5('mix:' || coalesce(source, '') || ':' || substr(h, 1, 3)) AS turn FROM d
), s AS (
  SELECT source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE / (SELECT sum(n_tokens) FROM d)::DOUBLE AS q FROM d GROUP BY source HAVING sum(n_tokens) > 0
), r(k, elo, ehi, rlo, rhi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1,
    CASE WHEN (SELECT ln(sum(pow(q, (elo + ehi) / 2))) - (elo + ehi) / 2 * sum(pow(q, (elo + ehi) / 2) * ln(q)) / sum(pow(q, (elo + ehi) / 2)) >= {TARGET_ENTROPY} * ln(count(*)) FROM s) THEN (elo + ehi) / 2 ELSE elo END,
    CASE WHEN (SELECT ln(sum(pow(q, (elo + ehi) / 2))) - (elo + ehi) / 2 * sum(pow(q, (elo + ehi) / 2) * ln(q)) / sum(pow(q, (elo + ehi) / 2)) >= {TARGET_ENTROPY} * ln(count(*)) FROM s) THEN ehi ELSE (elo + ehi) / 2 END,
    CASE WHEN (SELECT pow(min(q), (rlo + rhi) / 2 - 1) / sum(pow(q, (rlo + rhi) / 2)) > {MAX_REPEATS} FROM s) THEN (rlo + rhi) / 2 ELSE rlo END,
    CASE WHEN (SELECT pow(min(q), (rlo + rhi) / 2 - 1) / sum(pow(q, (rlo + rhi) / 2)) > {MAX_REPEATS} FROM s) THEN rhi ELSE (rlo + rhi) / 2 END
  FROM r WHERE k < 30
), e AS (SELECT CASE WHEN (SELECT count(*) FROM s) < 2 THEN 1.0 ELSE round(greatest(elo, rhi), 6) END AS t FROM r WHERE k = 30
), w AS (
  SELECT source, tokens, round(pow(q, t) / (SELECT sum(pow(q, t)) FROM s), 12) AS weight, floor(round(pow(q, t) / (SELECT sum(pow(q, t)) FROM s), 12) * (SELECT sum(n_tokens)::DOUBLE FROM d)) AS budget FROM s, e
), run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY turn, substr(h, 1, 3), h, doc_id RANGE UNBOUNDED PRECEDING) AS upto FROM p
)
SELECT run.doc_id, run.source, n_tokens, coalesce(weight, 0.0) AS weight,
  CAST(CASE WHEN weight IS NULL THEN 0 ELSE floor(budget / tokens) + CASE WHEN upto <= budget - floor(budget / tokens) * tokens THEN 1 ELSE 0 END END AS BIGINT) AS copies
FROM run LEFT JOIN w ON run.source IS NOT DISTINCT FROM w.source
"""


@query("op8_mixing", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken by the mixture."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs, target_entropy=TARGET_ENTROPY, max_repeats=MAX_REPEATS).withColumnRenamed("id", "doc_id")


def _distance(k: str) -> str:
    """Jensen-Shannon distance of the counts n and the reference counts r of the bins of kind k."""
    term = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
    return f"""SELECT doc_id, round(sqrt(greatest(0.0, sum(({term.format('p', 'q')} + {term.format('q', 'p')}) / 2))), 9) AS dist FROM (
      SELECT doc_id, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS p, r::DOUBLE / sum(r) OVER (PARTITION BY doc_id) AS q
      FROM (SELECT doc_id, bin, n, sum(n) OVER (PARTITION BY lang, bin) AS r FROM {k})) WHERE p IS NOT NULL AND NOT isnan(p) GROUP BY doc_id"""


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT *, len(ws) AS n_words, array_to_string(ws, '') AS body FROM d
), c AS (
  SELECT *, length(body) AS word_chars, length(regexp_replace(body, '\p{{L}}', '', 'g')) AS others, length(body) - length(regexp_replace(body, '\p{{Lu}}', '', 'g')) AS upper,
    length(body) - length(regexp_replace(body, '[0-9]', '', 'g')) AS digits, length(body) - length(regexp_replace(body, '[.,;:!?''"()-]', '', 'g')) AS marks,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM b
), g AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, n_words - 3)) AS i FROM b WHERE n_words >= 5)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g), (SELECT unnest(range(5)) AS k) WHERE n >= 2 GROUP BY doc_id
), u AS (
  SELECT doc_id, lang, lower(w) AS w, length(w) AS size FROM (SELECT doc_id, lang, unnest(ws) AS w FROM b)
), top AS (
  SELECT lang, w FROM (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS k FROM u WHERE size <= 5 AND regexp_full_match(w, '\p{{L}}+') GROUP BY lang, w) WHERE k <= 20
), hit AS (
  SELECT c.doc_id, c.lang, t.w AS bin, count(u.w) AS n FROM c JOIN top t ON t.lang IS NOT DISTINCT FROM c.lang LEFT JOIN u ON u.doc_id = c.doc_id AND u.w = t.w AND u.size <= 5 GROUP BY ALL
), mark AS (
  SELECT c.doc_id, c.lang, '!' AS bin, len(list_filter(ws, lambda w: length(w) <= 5 AND regexp_full_match(w, '[^\p{{L}}\p{{N}}]+'))) AS n FROM c
), commons AS (
  SELECT * FROM hit UNION ALL SELECT * FROM mark UNION ALL SELECT c.doc_id, c.lang, '', c.n_words - mark.n - coalesce((SELECT sum(n) FROM hit WHERE hit.doc_id = c.doc_id), 0) FROM c JOIN mark USING (doc_id)
), classes AS (
  SELECT doc_id, lang, unnest(['small', 'upper', 'digits', 'marks', 'other']) AS bin, unnest([word_chars - others - upper, upper, digits, marks, others - digits - marks]) AS n FROM c
), cd AS ({_distance("classes")}), wd AS ({_distance("commons")}), l AS (SELECT lang, sum(n_words) AS ref_words FROM c GROUP BY lang), f AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(cd.dist, 0.0) AS class_distance, coalesce(wd.dist, 0.0) AS word_distance, ref_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed
  FROM c LEFT JOIN r USING (doc_id) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id) JOIN l ON l.lang IS NOT DISTINCT FROM c.lang
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  class_distance, word_distance, base_failed, NOT base_failed AND (n_words < 50 OR ref_words < 1000 OR NOT (class_distance > 0.32 OR word_distance > 0.42)) AS kept
FROM f
"""


@query("op9_quality", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances and verdict of every document."""
    return quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).withColumnRenamed("id", "doc_id")


@query("op10_licenses")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in each document, the best match, and all spans as license:begin:end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = F.col("m")
    best = F.array_max(F.transform(m, lambda x: F.struct(x["dice"].alias("dice"), x["license"].alias("license"))))
    return docs.select("doc_id", licenses.license_column(spark, "text").alias("m")).select(
        "doc_id",
        F.size(m).cast("bigint").alias("n_matches"),
        best["license"].alias("best_license"),
        best["dice"].alias("best_dice"),
        F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["license"], x["begin"], x["end"])), ",").alias("spans"),
    )


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, r.uid, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.uid <> r.uid AND len(a.q) = len(r.q) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.id) <= 5
"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first negatives in the window of each positive of every anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return negatives.mined(rows, F.col("vec_id") % 100 == 0, label=label)


@query("op12_pii")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.private_column(spark, pii.learn(pii.own_table(spark)), "text").alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.sha2(pii.joined(F.col("s"), base_only=True).cast("binary"), 256)
    return found.select("doc_id", *map(count, pii.BASE), base.alias("base_sha256"), pii.joined(F.col("s")).alias("spans"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), c AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0
), p AS (
  SELECT uid, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT uid, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) GROUP BY ALL
), w AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY t, n_docs
), i AS (
  SELECT item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
), s AS (
  SELECT item, item_id, uid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM i JOIN p USING (t) JOIN w USING (t), c GROUP BY item, item_id, uid, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) <= 10
"""


@query("op13_lexical_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.ranked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
