"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexstrata.llm import oracles, sharding
from lexstrata.llm.balltree import integer_vectors, top_k_inner_product
from lexstrata.llm.byte_bpe import round_trip
from lexstrata.llm.common import shared_dir
from lexstrata.llm.exact_dedup import exact_duplicates
from lexstrata.llm.gear_chunks import substring_dedup
from lexstrata.llm.infill import fill_in_middle
from lexstrata.llm.jaccard_join import near_duplicates
from lexstrata.llm.language import predict_languages
from lexstrata.llm.packing import pack, with_checksums
from lexstrata.llm.quotes import reply_threads
from lexstrata.llm.repair import damage_and_repair
from lexstrata.llm.sharding import read_shards, text_digests, write_shards
from lexstrata.llm.suffix_dedup import remove_repeats
from lexstrata.llm.token_counts import token_counts


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ball_tree_top5(spark, sf_dir):
    points = integer_vectors(_table(spark, sf_dir, "embeddings"))
    return top_k_inner_product(points, points.filter("vec_id % 50 = 0"), 5)


def _digests(cut):
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op2_suffix_dedup(spark, sf_dir):
    return _digests(remove_repeats(_table(spark, sf_dir, "documents"), words=51))


def op3_ngram_jaccard(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, share=(90, 100))


def op4_mixture_packing(spark, sf_dir):
    return with_checksums(pack(_table(spark, sf_dir, "documents"), power=0.7))


def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark, sf_dir):
    return round_trip(_table(spark, sf_dir, "documents"))


def op7_quotation_threads(spark, sf_dir):
    return reply_threads(_table(spark, sf_dir, "conversations"))


def op8_language_id(spark, sf_dir):
    return predict_languages(_table(spark, sf_dir, "documents"))


def op9_gear_chunks(spark, sf_dir):
    return _digests(substring_dedup(_table(spark, sf_dir, "documents")))


def op10_token_counts(spark, sf_dir):
    return token_counts(_table(spark, sf_dir, "documents"))


def op11_shuffled_shards(spark, sf_dir):
    # Whole records are laid into shards; the digests are those of the texts that the shards hold.
    docs = _table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, 24)
    out = text_digests(read_shards(docs, path), others=("shard", "slot"))
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op12_conversation_repair(spark, sf_dir):
    return damage_and_repair(_table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark, sf_dir):
    return fill_in_middle(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ball_tree_top5": op1_ball_tree_top5,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quotation_threads": op7_quotation_threads,
    "op8_language_id": op8_language_id,
    "op9_gear_chunks": op9_gear_chunks,
    "op10_token_counts": op10_token_counts,
    "op11_shuffled_shards": op11_shuffled_shards,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op1_ball_tree_top5": """
        WITH v AS (
            SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        s AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
        p AS (SELECT doc_id, unnest(range(0, n - 399)) AS pos FROM s WHERE n >= 400),
        w AS (SELECT p.doc_id, pos, substr(x, 2 * pos + 1, 800) AS w FROM p JOIN s USING (doc_id)),
        h AS (SELECT doc_id, pos, hash(w) AS a FROM w),
        r AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY a) AS c FROM h) WHERE c > 1),
        e AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 400, true) AS head FROM r),
        g AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM e),
        v AS (SELECT doc_id, k, min(pos) AS a, max(pos) + 400 AS b FROM g GROUP BY doc_id, k),
        f AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM v),
        c AS (
            SELECT f.doc_id, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept,
                   max(b) AS tail, sum(b - a) AS removed, count(*) AS spans
            FROM f JOIN s USING (doc_id) GROUP BY f.doc_id),
        ww AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        wh AS (
            SELECT doc_id, unnest(range(1, len(w) - 49)) AS pos,
                   unnest(list_transform(range(1, len(w) - 49), lambda i: hash(array_to_string(w[i:i + 50], ' ')))) AS a
            FROM ww WHERE len(w) > 50),
        wr AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY a) AS c FROM wh) WHERE c > 1),
        we AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 51, true) AS head FROM wr),
        wg AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM we),
        wv AS (SELECT doc_id, max(pos) + 51 - min(pos) AS m FROM wg GROUP BY doc_id, k),
        wc AS (SELECT doc_id, sum(m) AS passage FROM wv GROUP BY doc_id)
        SELECT s.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept || substr(x, 2 * tail + 1), x))) AS kept_sha256,
               CAST(coalesce(passage, 0) AS BIGINT) AS n_passage_words
        FROM s LEFT JOIN c USING (doc_id) LEFT JOIN wc USING (doc_id)""",
    "op3_ngram_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), g AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
            FROM w
        ), s AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM g),
        u AS (SELECT doc_id, unnest(g) AS x FROM g),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM i JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
        SELECT s.doc_id, any_value(n) AS n_shingles, min(reached) AS component_id
        FROM s JOIN r USING (doc_id) GROUP BY s.doc_id""",
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d""",
    "op11_shuffled_shards": oracles.shuffled_shards(24, sharding.BUCKET_ROWS, sharding.BUCKET_BYTES),
    "op12_conversation_repair": oracles.conversation_repair(),
    "op13_fill_in_middle": oracles.fill_in_middle(),
}
