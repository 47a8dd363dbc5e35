"""The registered queries of this package."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import (
    byte_bpe,
    embedding_dedup,
    host_trust,
    interpolated_lm,
    merkle,
    mixing,
    packing,
    quality_rules,
    simhash,
    spotsigs,
    substring_dedup,
    toxicity,
    vector_codes,
)
from bitloom.plans.storage import materialize

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SHARDS = 24
WEIGHTS = [3, 1, 2]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_trust(spark: SparkSession, folder: str) -> DataFrame:
    return host_trust.judge_urls(table(spark, folder, "pages"), RULES)


def op2_bin_packing(spark: SparkSession, folder: str) -> DataFrame:
    shards = packing.shard_documents(table(spark, folder, "documents"), SHARDS)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, folder, "embeddings"), 0.98)


def remainder(of: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op4_deobfuscated_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, held_out = table(spark, folder, "documents"), remainder(4) == 2
    model = toxicity.train(documents, table(spark, folder, "labels"), ~held_out)
    rows = toxicity.score(documents.select("doc_id", "text"), model)
    return rows.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, budget=2)
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op6_interpolated_lm(spark: SparkSession, folder: str) -> DataFrame:
    return interpolated_lm.score_texts(table(spark, folder, "documents"), remainder(5) == 1)


def op7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), WEIGHTS, share=1.5, most=2.0).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op8_run_index(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, folder, "documents"), 50)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("span_start").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = spotsigs.edited_pairs(table(spark, folder, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.fingerprint("own").alias("fingerprint"),
        spotsigs.fingerprint("own_edited").alias("edited_fingerprint"),
        spotsigs.pruned_jaccard(F.col("own"), F.col("own_edited")).alias("near_edited"),
        spotsigs.pruned_jaccard(F.col("own"), F.col("next")).alias("near_next"),
    )


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    bpe = byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = table(spark, folder, "documents").select("doc_id", bpe.round_trip("text").alias("both")).select("doc_id", "both.*")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = merkle.manifest(
        table(spark, folder, "documents"),
        fields=["doc_id", "source", "lang", "n_chars", "text"],
        id_col="doc_id",
        by="source",
        tampered={"text": F.translate("text", upper, upper.lower())},
        where=remainder(5) == 0,
    )
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified"
    )


def op12_certified_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept", "rejected_by")


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes = vector_codes.compress(table(spark, folder, "embeddings"), parts=16, entries=64, rounds=2)
    text = F.concat(*[F.lpad(F.lower(F.hex(F.col("codes")[k])), 2, "0") for k in range(16)])
    digest = F.lit(None).cast("string")
    for dim, book in codes.codebooks.items():
        digest = F.when(F.col("dim") == dim, hashlib.sha256(vector_codes.digest_text(book).encode()).hexdigest()).otherwise(digest)
    # written: the codes are needed for the sums over labels and for the rows
    rows = vector_codes.with_label_error(materialize(codes.rows, "vector-codes"))
    return rows.select(F.col("id").alias("vec_id"), text.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


ALL = [op1_url_trust, op2_bin_packing, op3_embedding_dedup, op4_deobfuscated_toxicity, op5_simhash, op6_interpolated_lm, op7_mix, op8_run_index, op9_spotsigs, op10_byte_bpe, op11_merkle_manifest, op12_certified_rules, op13_vector_codes]
QUERIES = {query.__name__: query for query in ALL}
ORACLES = {
    "op3_embedding_dedup": """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION
    SELECT links.u, reach.other FROM reach JOIN links ON reach.node = links.v
), component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node
), degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c ON c.node = e.vec_id LEFT JOIN degree d ON d.u = e.vec_id
""",
    "op7_mix": r"""
WITH d AS (
    SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), weighted AS (
    SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s
), sorted AS (
    SELECT *, 2.0::DOUBLE * source_size AS cap,
        coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS capped,
        sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_weight, sum(source_size) OVER () AS total
    FROM weighted
    WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
    SELECT max((1.5::DOUBLE * total - capped) / open_weight) AS level FROM sorted
    WHERE (1.5::DOUBLE * total - capped) / open_weight < cap / w
), goal AS (
    SELECT source, source_size, least(cap, w * level)::DOUBLE AS target FROM sorted, water
), line AS (
    SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM d
), placed AS (
    SELECT line.doc_id, line.size, line.pos, goal.source_size, goal.target, floor(goal.target)::BIGINT AS words
    FROM line JOIN goal ON line.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target,
    CASE WHEN source_size = 0 THEN 0 ELSE
        (words // source_size) * size + greatest(0, least(size, words % source_size - pos)) END::BIGINT AS taken
FROM placed
""",
    "op11_merkle_manifest": """
WITH RECURSIVE d AS (
    SELECT *, row_number() OVER () AS r,
        (SELECT list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: if(x & 1 = 1, xor(x >> 1, 3988292384), x >> 1)))) AS crc
    FROM documents
), written AS (
    SELECT r, doc_id, source, coalesce(xor(crc, 4294967295) % 5 = 0, false) AS touched,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS body,
        coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
    FROM d
), leaves AS (
    SELECT r, doc_id, source, touched, sha256(head || body) AS leaf,
        CASE WHEN touched THEN sha256(head || lowered) ELSE sha256(head || body) END AS start
    FROM written
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
    FROM leaves
), nodes AS (
    SELECT 0 AS level, source, pos, n, leaf AS hash FROM ranked
    UNION ALL
    SELECT any_value(level) + 1, source, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos))
    FROM nodes WHERE n > 1 GROUP BY source, pos // 16
), subroots AS (
    SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees
    FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS level, tree AS pos, trees AS n, subroot AS hash FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos))
    FROM tops WHERE n > 1 GROUP BY pos // 16
), every_node AS (
    SELECT s.tree, level, pos, n, hash FROM nodes JOIN subroots s ON nodes.source IS NOT DISTINCT FROM s.source
    UNION ALL
    SELECT -1, level, pos, n, hash FROM tops
), near AS (
    SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
        coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM every_node a JOIN every_node b ON a.tree = b.tree AND a.level = b.level AND a.pos // 16 = b.pos // 16
    WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos
), fold AS (
    SELECT r, s.tree, s.tree AS own, 0 AS level, pos, n, start AS hash, '' AS proof
    FROM ranked JOIN subroots s ON ranked.source IS NOT DISTINCT FROM s.source
    UNION ALL
    SELECT r, CASE WHEN f.n = 1 THEN -1 ELSE f.tree END, own, CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END,
        CASE WHEN f.n = 1 THEN own ELSE f.pos // 16 END,
        CASE WHEN f.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (f.n + 15) // 16 END,
        CASE WHEN f.n = 1 THEN f.hash ELSE sha256(near.before || f.hash || near.after) END,
        CASE WHEN f.n = 1 THEN f.proof ELSE f.proof || near.before || near.after END
    FROM fold f LEFT JOIN near ON near.tree = f.tree AND near.level = f.level AND near.pos = f.pos
    WHERE NOT (f.tree = -1 AND f.n = 1)
), root AS (SELECT hash AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold.hash AS folded_root, fold.hash = root AS verified
FROM ranked JOIN fold ON fold.r = ranked.r AND fold.tree = -1 AND fold.n = 1
JOIN subroots s ON ranked.source IS NOT DISTINCT FROM s.source, root
""",
    "op13_vector_codes": """
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v,
        len(embedding) // 16 AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT r, vec_id, label, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, (SELECT unnest(range(16)) AS p)
), book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 64
), near0 AS MATERIALIZED (
    SELECT r, any_value(parts.p) AS p, any_value(x) AS x, min({'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}) AS best
    FROM parts JOIN book0 ON parts.p = book0.p GROUP BY r, parts.p
), sums0 AS (
    SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c
    FROM (SELECT p, best.e AS e, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM near0, (SELECT unnest(range(1, 1 + (SELECT max(w) FROM kept))) AS i) GROUP BY p, best.e, i)
    GROUP BY p, e
), book1 AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book0 b LEFT JOIN sums0 s ON b.p = s.p AND b.e = s.e
), near1 AS MATERIALIZED (
    SELECT r, any_value(parts.p) AS p, any_value(x) AS x, min({'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}) AS best
    FROM parts JOIN book1 ON parts.p = book1.p GROUP BY r, parts.p
), sums1 AS (
    SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c
    FROM (SELECT p, best.e AS e, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM near1, (SELECT unnest(range(1, 1 + (SELECT max(w) FROM kept))) AS i) GROUP BY p, best.e, i)
    GROUP BY p, e
), book2 AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book1 b LEFT JOIN sums1 s ON b.p = s.p AND b.e = s.e
), near2 AS MATERIALIZED (
    SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(parts.p) AS p, min({'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}) AS best
    FROM parts JOIN book2 ON parts.p = book2.p GROUP BY r, parts.p
), coded AS (
    SELECT any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
    FROM near2 GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded
""",
}
