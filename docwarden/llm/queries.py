"""Named queries of the operators, over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; splits documents into folds."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def learned_from() -> Column:
    """Rows that classifiers may learn from: all but a third, by the id."""
    return F.coalesce(_remainder(3), F.lit(0)) != 1


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_language, language_profiles

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_remainder(3) == 1).alias("held_out"))
    profiles = language_profiles(docs.where(~F.coalesce("held_out", F.lit(False))))
    out = identify_language(docs.select("doc_id", "text", "held_out"), profiles)
    return out.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    out = find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", F.col("l.item").alias("item_id"), "l.similarity", "l.start", "l.words")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import COUNTS, fit_quality, quality_rules

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit_quality(docs.where(learned_from()), _table(spark, sf_dir, "labels"))
    return quality_rules(docs, trees).select("doc_id", *COUNTS, "base_failed", "kept", "quality_score")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeated_passages

    out = remove_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_words").cast("long"), F.col("n_removed").cast("long"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import TEMPLATES, scan_licenses

    templates = spark.createDataFrame(TEMPLATES, "template string, text string")
    out = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"), templates)
    return out.select("doc_id", F.explode("licenses").alias("l")).select("doc_id", "l.template", "l.containment", "l.start", "l.words")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"))
    labels = _table(spark, sf_dir, "labels").where(learned_from())
    model = fit_toxicity(docs.where("NOT held_out"), labels)
    out = score_toxicity(docs, model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups

    return jaccard_groups(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_encode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_encode(docs, vocabulary_path())
    joined = F.array_join(F.col("bpe_ids").cast("array<string>"), " ")
    return out.select(
        "doc_id",
        F.size("bpe_ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe_text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = katz_scores(docs, F.coalesce(_remainder(10), F.lit(1)) != 0)
    return out.select(F.col("key").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import shuffle_into_shards

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shuffle_into_shards(docs, 40, seed=10)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clusters import ADDED, cluster_vectors

    return cluster_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).where("cluster IS NOT NULL").select("vec_id", *ADDED)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import phrase_collocations

    return phrase_collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import ADDED, near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", *ADDED)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_substring": op4_substring,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard": op7_jaccard,
    "op8_bpe": op8_bpe,
    "op9_katz": op9_katz,
    "op10_sharding": op10_sharding,
    "op11_centroids": op11_centroids,
    "op12_phrases": op12_phrases,
    "op13_near_vectors": op13_near_vectors,
}
_WORDS = r"[x for x in regexp_split_to_array({text}, '[\x20\x09-\x0D]+') if x <> '']"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _centroids_sql(rounds: int = 3, k: int = 16, dim: int = 64) -> str:
    """Assignments and means of all rounds, one after the other, over every vector and centroid."""
    usable = f"len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {usable})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), q) <= {k})",
    ]
    for i in range(rounds + 1):
        away = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v.q) AS q, min(struct_pack(d := CAST({away} AS BIGINT), c := c.c)) AS b FROM v, c{i} c GROUP BY r)")
        if i < rounds:
            parts = f"SELECT b.c AS c, j, sum(q[j]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {dim + 1})) AS j) js GROUP BY ALL"
            mean = f"SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM ({parts}) x GROUP BY c"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN ({mean}) m ON m.c = c.c)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON c{rounds}.c = b.c"""


# The other queries hold a fitted model, a tokenizer or random numbers; tests/llm compares them with brute force.
ORACLES: dict[str, str] = {
    "op11_centroids": _centroids_sql(),
    "op12_phrases": rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] AS ws FROM p),
g AS (SELECT lang, d, array_to_string(ws[i:i + d - 1], ' ') AS s FROM (SELECT lang, ws, d, unnest(range(1, len(ws) - d + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS d) ds) x),
f AS MATERIALIZED (SELECT lang, d, s, count(*) AS a, string_split(s, ' ') AS ws FROM g GROUP BY lang, d, s HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM g WHERE d = 1 GROUP BY lang),
whole AS (SELECT c.* FROM f c WHERE d >= 2 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = c.lang AND g.d > c.d AND g.a = c.a AND contains(' ' || g.s || ' ', ' ' || c.s || ' '))),
cuts AS (SELECT lang, s, d, a, unnest(range(1, d)) AS k, ws FROM whole),
scored AS (SELECT c.lang, c.s, c.a, k, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.s = array_to_string(c.ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.s = array_to_string(c.ws[k + 1:], ' ') JOIN n ON n.lang = c.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM least
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) <= 2000""",
    "op13_near_vectors": """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.93),
reach(r, c) AS (SELECT r, r FROM v UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.r),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.c GROUP BY reach.r)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.x = v.r) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least USING (r)""",
    "op4_substring": f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20) x),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM runs) x WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ways.y, reach.c FROM reach JOIN ways ON ways.x = reach.doc_id)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id FROM reach r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id""",
}
