"""The registered queries of this subpackage and the SQL that they must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import alignment, bitslices, bytespans, centroids, decontaminate, jaccard, langid, licenses, mixing, packing, shards, warc, wordspans
from weft.llm.base import load, materialize

N_SHARDS = 40


def op1_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive(warc.to_arc(load(spark, sf_dir, "pages")))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslices.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op5_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.kd_shards(load(spark, sf_dir, "documents"), N_SHARDS)
    return rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_bwt_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bytespans.dedup(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents")).drop("templates", "matches")


def op8_rlz_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wordspans.dedup(load(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(load(spark, sf_dir, "documents"))


def op10_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(load(spark, sf_dir, "documents"), share=1.5, weights=(5.0, 2.0, 1.0))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken")


def op11_dangling_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    found = materialize(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links").withColumn("rid", F.monotonically_increasing_id()), "aligned")
    return alignment.score(found, alignment.pair_counts(found)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_interval_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.cluster(load(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_compression_langid, op2_arc_to_warc, op3_benchmark_leaks, op4_bit_sliced_topk, op5_kd_tree_shards, op6_bwt_substrings, op7_license_scan, op8_rlz_windows, op9_bayes_jaccard, op10_multinomial_mix, op11_dangling_alignment, op12_interval_centroids, op13_pattern_packing)}
_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def _shingles(key: str, table: str) -> str:
    return f"""(SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM (SELECT {key}, {_WORDS} AS w FROM {table}) WHERE len(w) >= 5)"""


def _centroids(k: int, rounds: int, dims: int) -> str:
    """Rounds as steps of one WITH; a vector's nearest centroid is the least (distance, number)."""
    nearest = "SELECT vec_id, q, min(struct_pack(d := list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, n := n)) AS m FROM v, c{} GROUP BY ALL"
    floors = ", ".join(f"sum(q[{i}])::HUGEINT" for i in range(1, dims + 1))
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS n, q AS c FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {k}))"]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT n, coalesce(moved, c) AS c FROM c{i} LEFT JOIN
            (SELECT m.n AS n, list_transform([{floors}], lambda s: ((s - ((s % count(*)) + count(*)) % count(*)) // count(*))::BIGINT) AS moved FROM a{i} GROUP BY m.n) USING (n))""")
    return f"""WITH {", ".join(steps)}, a AS MATERIALIZED ({nearest.format(rounds)})
        SELECT vec_id, m.n::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.n))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN c{rounds} ON m.n = c{rounds}.n"""


#: SQL for DuckDB that returns the same rows.
ORACLE: dict[str, str] = {
    "op2_arc_to_warc": """
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
            CASE WHEN repeated THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN repeated THEN first END AS refers_to
        FROM (SELECT *, octet_length(encode(coalesce(html, ''))) >= 100 AND first < page_id AS repeated
            FROM (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM pages))""",
    "op3_benchmark_leaks": f"""
        WITH d AS {_shingles("doc_id", "documents")}, b AS {_shingles("item_id", "benchmark")},
            n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
        SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
        FROM (SELECT d.doc_id, b.item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL) JOIN n USING (item_id)
        WHERE n_shared >= ceil(0.8 * n_shingles - 1e-9)""",
    "op4_bit_sliced_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        SELECT query_id, rank::INT AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op12_interval_centroids": _centroids(40, 5, 64),
}
