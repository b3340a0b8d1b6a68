"""The thin queries opN_<name> of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import decontamination, html_text, importance, language_id, mixing, near_dedup, quality_model, quality_rules, secrets, sharding, token_counts, token_ids, vectors
from pagequarry.llm.common import read_table


def remainder(key: str, by: int) -> Column:
    """crc32 of a key as text, modulo by: the folds of the contracts. 0 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % by, F.lit(0))


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op3_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    weights = quality_model.fit(docs, labels.where(remainder("doc_id", 4) != 2))
    scored = quality_model.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find(read_table(spark, sf_dir, "documents"), shingle=4)


def op5_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents")))


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op7_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op8_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(read_table(spark, sf_dir, "documents"))


def op9_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    dictionaries = language_id.learn(docs.where(remainder("doc_id", 5) != 0))
    found = language_id.predict(docs, dictionaries)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_crc_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read_table(spark, sf_dir, "documents"))


def op13_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.digest(*vectors.cluster(read_table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ring_shards, op2_divergence_rules, op3_ftrl_quality, op4_hyperminhash, op5_randomness_secrets, op6_entropy_mixing, op7_html_layout, op8_huffman_ids, op9_zstd_language, op10_template_decontamination, op11_crc_importance, op12_transducer_counts, op13_hamerly_clusters)}


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: All pairs that share a shingle, counted; reachability by recursion.
NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
r AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT r.id, links.y FROM r JOIN links ON r.m = links.x)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.m) AS component_id, d.doc_id = min(r.m) AS kept FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


def clusters_sql(k: int = vectors.CLUSTERS, rounds: int = vectors.ROUNDS, seed: int = vectors.SEED, dimensions: int = vectors.DIMENSIONS) -> str:
    """Every round as two tables: each vector's nearest centroid by all distances, then the centroids' means rounded down."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({vectors.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions} AND len(embedding) = {dimensions})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT v.i, c{r}.c, CAST(list_sum(list_transform(list_zip(v.q, c{r}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{r})")
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1)")
        if r < rounds:
            steps.append(f"x{r} AS (SELECT a.c, p.p, CAST(floor(sum(v.q[p.p]) / count(*)) AS BIGINT) AS m FROM a{r} a JOIN v ON v.i = a.i, (SELECT unnest(range(1, {dimensions + 1})) AS p) p GROUP BY a.c, p.p)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{r} o LEFT JOIN (SELECT c, list(m ORDER BY p) AS q FROM x{r} GROUP BY c) n ON n.c = o.c)")
    last = f"SELECT v.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v ON v.i = a.i JOIN c{rounds} k ON k.c = a.c"
    return "WITH " + ",\n".join(steps) + "\n" + last


def oracle_sql() -> dict[str, str]:
    return {"op4_hyperminhash": NEAR_DUPLICATES, "op13_hamerly_clusters": clusters_sql()}
