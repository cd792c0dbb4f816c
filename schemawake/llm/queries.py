"""The operators' registered queries: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, hard_negatives, kneser_ney, lexical, mixing, neardup, packing, pii, rendezvous, secrets, simhash, token_counts, token_files
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers as P

    return P.path(name)


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(table(spark, sf_dir, "documents"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_files.read_token_files(files, with_ids=False)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.search_counts(simhash.edited_fingerprints(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op9_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendezvous.assign_shards(table(spark, sf_dir, "documents"), [1.0] * 24, [1.0] * 25)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding", (F.col("vec_id") % 50 == 0).alias("anchor")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nn_descent": op1_nn_descent,
    "op2_surrogates": op2_surrogates,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_neardup": op4_neardup,
    "op5_token_files": op5_token_files,
    "op6_secret_scan": op6_secret_scan,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_rendezvous": op9_rendezvous,
    "op10_packing": op10_packing,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_counts": op12_token_counts,
    "op13_hard_negatives": op13_hard_negatives,
}
#: CRC-32 for an engine without it: the table of 256 remainders by rule, then a fold over the bytes.
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], [0,0,0,0,0,0,0,0]::UBIGINT[]), lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS t)"
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(0, octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), (2 * i + 1)::INT, 2))::UBIGINT)), lambda a, b: xor(a >> 8, crc_table.t[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT"
ORACLES: dict[str, str] = {
    "op9_rendezvous": f"""WITH {_CRC_TABLE}, docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
      k AS (SELECT doc_id, key, octet_length(encode(docs.t)) + 8 AS size, {_CRC.replace("encode(t)", "encode(docs.t)")} AS text_crc32 FROM docs, crc_table),
      scored AS (SELECT key, shard, -1.0 / ln((('0x' || substr(md5(key || ':' || shard), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score FROM (SELECT DISTINCT key FROM docs) x, range(25) AS r(shard)),
      best AS (SELECT key, arg_max(shard, score) FILTER (shard < 24) AS shard, arg_max(shard, score) AS grown_shard FROM scored GROUP BY key)
      SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key || ':' || text_crc32), 1, 3), doc_id, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard FROM k JOIN best USING (key)""",
    "op11_ranked_search": r"""WITH cut AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
      docs AS (SELECT row_number() OVER () AS d, doc_id, len(terms) AS n, terms FROM cut WHERE len(terms) > 0), total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM docs),
      items AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
      asked AS (SELECT i, item_id, term, count(*) AS q FROM items GROUP BY ALL), posts AS (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
      weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posts, total GROUP BY term, nd),
      scored AS (SELECT i, item_id, d, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))))::BIGINT AS score FROM asked JOIN posts USING (term) JOIN weights USING (term), total GROUP BY i, item_id, d, doc_id)
      SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20""",
    "op13_hard_negatives": """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.r AS a, a.vec_id AS anchor_id, v.r, v.vec_id, v.label = a.label AS same, list_dot_product(a.v, v.v)::BIGINT AS score FROM v a JOIN v ON a.r <> v.r WHERE a.vec_id % 50 = 0),
      p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) AS n FROM s WHERE same) WHERE n <= 5),
      n AS (SELECT s.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
      SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
