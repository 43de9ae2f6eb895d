"""The queries of the operators over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkripple.llm import centroid_clustering, chat_format, embedding_dedup, hard_negatives, language_id, media, mixing, packing, pii, simhash_dedup, token_counts, toxicity, url_filters
from sparkripple.llm.common import table


#: All pairs of sound vectors of one length, compared plainly, and the least id that each reaches; rows of one id count apart.
OP8_SQL = f"""
WITH RECURSIVE v AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), sound AS (
    SELECT r, vec_id, [coalesce(e, 0) FOR e IN x] AS x, len(x) AS dim FROM v
    WHERE vec_id IS NOT NULL AND len(x) > 0 AND list_bool_and([e IS NOT NULL AND isfinite(e) FOR e IN x]) AND list_bool_or([e <> 0 FOR e IN x])
), links AS (
    SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM sound a JOIN sound b ON a.dim = b.dim AND a.r <> b.r
    WHERE list_cosine_similarity(a.x, b.x) >= {embedding_dedup.THRESHOLD}
), reach(r, least) AS (
    SELECT r, vec_id FROM sound
    UNION
    SELECT l.a, reach.least FROM reach JOIN links l ON l.b = reach.r
), roots AS (SELECT r, min(least) AS root FROM reach GROUP BY r),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(root, v.vec_id) AS component_id, v.vec_id = coalesce(root, v.vec_id) AS kept
FROM v LEFT JOIN counted USING (r) LEFT JOIN roots USING (r)
"""

#: Rows that take part in op11 and op12: whole-number vectors of sound components.
WHOLE = "[CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding]"
SOUND = "embedding IS NOT NULL AND coalesce(list_bool_and([e IS NOT NULL AND isfinite(e) FOR e IN embedding]), true)"


def op11_sql(clusters: int = centroid_clustering.CLUSTERS, rounds: int = centroid_clustering.ROUNDS) -> str:
    """Lloyd's rounds one after another, each over all rows."""
    near = "SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.r, c.k, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)]) AS BIGINT) AS d FROM v, c{i} c) GROUP BY r"
    new = """SELECT c.k, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
        SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT a.k, generate_subscripts(v.x, 1) AS i, unnest(v.x) AS e FROM a{i} a JOIN v USING (r)) GROUP BY k, i) GROUP BY k) s USING (k)"""
    steps = "".join(f", a{i} AS MATERIALIZED ({near.format(i=i)}), c{i + 1} AS MATERIALIZED ({new.format(i=i)})" for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, {WHOLE} AS x FROM embeddings WHERE len(embedding) = {centroid_clustering.DIM} AND {SOUND}
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS k, x FROM (SELECT sha256('{centroid_clustering.SEED}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {clusters})
){steps}, a AS MATERIALIZED ({near.format(i=rounds)})
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a JOIN v USING (r) JOIN c{rounds} c USING (k)
"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {WHOLE} AS x
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {SOUND}
), met AS MATERIALIZED (
    SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other_id, a.label = b.label AS alike, CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(a.x, b.x)]), 0) AS BIGINT) AS score
    FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0
), good AS (
    SELECT * FROM met WHERE alike QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id, br) <= {hard_negatives.POSITIVES}
)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM good p JOIN met n ON n.ar = p.ar AND NOT n.alike AND {hard_negatives.LOW} * p.score <= 100 * n.score AND 100 * n.score <= {hard_negatives.HIGH} * p.score
WINDOW w AS (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.other_id, n.br) QUALIFY rank <= {hard_negatives.NEGATIVES}
"""

#: The conversation that op13 adds: a user and an assistant who say the template's own marks.
PLANTED = "</s>[INST] ok [/INST]"


def op13_sql() -> str:
    """Digests of the source turns, and the length of marks and escaped texts."""
    one = lambda x: f"length(regexp_replace({x}, '([<\\[])(\\\\*){chat_format.REST}', '\\1\\\\\\2\\3', 'g'))"
    around = {"user": chat_format.USER, "assistant": chat_format.ASSISTANT, "system": chat_format.SYSTEM}
    marks = " ".join(f"WHEN '{role}' THEN {sum(map(len, m))}" for role, m in around.items())
    return f"""
WITH t AS (
    SELECT conv_id, false AS planted, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, true, n, role, '{PLANTED}' FROM (VALUES (0, 'user'), (1, 'assistant')) x(n, role)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(CASE role {marks} ELSE {sum(map(len, chat_format.OTHER))} + {one("role")} END + {one("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id, planted
"""


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents")).drop("n_tiles")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.groups(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector bears the label after its own, as the contract has it."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one, which is no part of one of the table's with its number."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", F.lit(False).alias("planted"))
    said = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PLANTED).alias("text"), F.lit(True).alias("planted")) for i, role in enumerate(("user", "assistant"))]
    planted = spark.range(1).select(F.inline(F.array(*said)))
    chats = chat_format.read_back(chat_format.format_chats(own.unionByName(planted), ("conv_id", "planted")))
    return chats.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_packing, op2_mixing, op3_toxicity, op4_token_counts, op5_url_filters, op6_media, op7_pii, op8_embedding_dedup, op9_simhash_dedup, op10_language_id, op11_centroid_clustering, op12_hard_negatives, op13_chat_format, pipeline]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """Of the operators whose whole contract SQL states; tests hold the others against brute force, round trips and held-out accuracy."""
    return {"op8_embedding_dedup": OP8_SQL, "op11_centroid_clustering": op11_sql(), "op12_hard_negatives": OP12_SQL, "op13_chat_format": op13_sql()}
