"""Queries that apply the operators to their whole tables, with the columns that are asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, exact_dedup, fingerprints, html_text, language_id, language_model, minhash, near_dedup, packing, quality, ranked_search, sharding


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf_dir, "documents"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.stratified_shards(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(_table(spark, sf_dir, "documents"), radius=2, shingle=3)
    return groups.select("doc_id", fingerprints.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    encoded = bpe.encode_texts(_table(spark, sf_dir, "documents"), path, round_trip=True)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return encoded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents"), path, end_id=2, capacity=1024), capacity=1024)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_within, for the ids divisible by 100: the rows whose fingerprint is at most 3 bits away, themselves included."""
    edited = fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))
    held = edited.groupBy("fp").agg(F.count("*").alias("copies"))
    asked = edited.where("doc_id % 100 = 0").select(F.col("fp").alias("query"))
    found = fingerprints.within_radius(asked, held, radius=3).join(held, "fp").groupBy("query").agg(F.sum("copies").alias("n_within"))
    found = found.withColumnRenamed("query", "_query")
    counted = edited.join(found, (edited["fp"] == found["_query"]) & (edited["doc_id"] % 100 == 0), "left")
    hexes = (fingerprints.as_hex(F.col(c)).alias(name) for c, name in (("fp", "fingerprint"), ("edited_fp", "edited_fingerprint")))
    return counted.select("doc_id", "n_chars", "edited_sha256", *hexes, "near_edited", "near_next", "n_within")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_groups(_table(spark, sf_dir, "documents"), least=0.85, words=3)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {f.__name__: f for f in (op1_language_model, op2_shards, op3_near_dedup, op4_bpe, op5_packing, op6_fingerprints, op7_html_text, op8_quality, op9_language_id, op10_exact_dedup, op11_centroids, op12_minhash, op13_ranked_search)}



def _rounds_sql(rounds: int) -> str:
    """One table of centroids for each round, a row for each component."""
    step = """
        d{0} AS MATERIALIZED (SELECT r, cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM parts v JOIN c{0} c ON v.i = c.i GROUP BY r, cluster),
        a{0} AS MATERIALIZED (SELECT r, arg_min(cluster, d * 8 + cluster) AS cluster, min(d) AS distance FROM d{0} GROUP BY r),"""
    means = """
        m{0} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM parts JOIN a{0} USING (r) GROUP BY cluster, i),
        c{1} AS MATERIALIZED (SELECT cluster, i, CASE WHEN s IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{0} LEFT JOIN m{0} USING (cluster, i)),"""
    return "".join(step.format(i) + (means.format(i, i + 1) if i < rounds else "") for i in range(rounds + 1))


ORACLE_SQL = {
    "op11_centroids": f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        parts AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
        named AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster FROM kept),
        c0 AS MATERIALIZED (SELECT cluster, i, x FROM parts JOIN named USING (r) WHERE cluster < 8),{_rounds_sql(10)}
        digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY cluster)
        SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM kept JOIN a10 USING (r) JOIN digests USING (cluster)""",
    "op12_minhash": r"""
        WITH RECURSIVE words AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS MATERIALIZED (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        links AS MATERIALIZED (
            SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)""",
    "op13_ranked_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        counted AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
        totals AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
        weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, totals GROUP BY term, all_docs),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        times AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
        scores AS (
            SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms)))) AS BIGINT) AS score
            FROM times JOIN weights USING (term) JOIN counted USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 20""",
    "op10_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM normal WINDOW g AS (PARTITION BY t)""",
}
