"""The contract queries of the operators: thin digests over whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm.common import read_table
from frameflow.llm.decontam import contamination
from frameflow.llm.langid import language
from frameflow.llm.line_dedup import dedup_lines
from frameflow.llm.lm import score as lm_score
from frameflow.llm.packing import pack
from frameflow.llm.pit import features_at
from frameflow.llm.quality import quality
from frameflow.llm.sharding import shard_by_bytes
from frameflow.llm.simhash import near_duplicates
from frameflow.llm.token_counts import token_counts
from frameflow.llm.token_output import token_round_trip
from frameflow.llm.topk import top_k
from frameflow.llm.trie import conversation_trie

N_SHARDS = 16


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    done = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files that it wrote."""
    done = token_round_trip(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return done.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    done = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1, min_docs=10)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: each fiftieth vector's five best others."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5).select("query_id", "rank", "vec_id", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "quality", folds=5, threshold=0.3)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return lm_score(read_table(spark, sf_dir, "documents"), folds=10)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    done = pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law)."""
    done = shard_by_bytes(read_table(spark, sf_dir, "documents"), N_SHARDS)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return language(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), folds=5)


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    done = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t, version_id, age, status, n_chars, lang for each label."""
    return features_at(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fresh=60)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node."""
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_codes": op2_token_codes,
    "op3_line_dedup": op3_line_dedup,
    "op4_topk": op4_topk,
    "op5_quality": op5_quality,
    "op6_lm": op6_lm,
    "op7_packing": op7_packing,
    "op8_sharding": op8_sharding,
    "op9_langid": op9_langid,
    "op10_decontam": op10_decontam,
    "op11_pit": op11_pit,
    "op12_trie": op12_trie,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL = {
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), often AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN o.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
        FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY doc_id""",
    "op4_topk": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""",
    "op10_decontam": r"""
        WITH it AS (
            SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
        ), win AS (
            SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS t
            FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM it WHERE len(w) > 0)
        ), dw AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
        ), pos AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
        ), hit AS (
            SELECT doc_id, i, p.n, item FROM pos p JOIN win ON p.t = win.t AND p.n = win.n
        ), word AS (
            SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
        ), item AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op11_pit": r"""
        WITH d AS (
            SELECT doc_id, source, n_chars, lang, event, event - 60 + CAST('0x' || substr(h, 9, 8) AS BIGINT) % 300 AS arrival, event + CAST('0x' || substr(h, 17, 8) AS BIGINT) % 900 AS expiry
            FROM (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 20000 AS event FROM (SELECT *, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents))
        ), ask AS (
            SELECT row_number() OVER () AS n, l.doc_id, CAST('0x' || substr(sha256(CAST(l.doc_id AS VARCHAR)), 25, 8) AS BIGINT) % 20000 AS t, s.source
            FROM labels l LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) s ON l.doc_id = s.doc_id
        ), won AS (
            SELECT ask.n, ask.doc_id, t, d.doc_id AS version_id, t - event AS age, n_chars, lang
            FROM ask LEFT JOIN d ON ask.source = d.source AND event <= t AND arrival <= t AND t < expiry
            QUALIFY row_number() OVER (PARTITION BY ask.n ORDER BY event DESC NULLS LAST, arrival, d.doc_id DESC) = 1
        )
        SELECT doc_id, t, version_id, age, CASE WHEN age IS NULL THEN 'none' WHEN age > 60 THEN 'stale' ELSE 'fresh' END AS status,
               CASE WHEN age <= 60 THEN n_chars END AS n_chars, CASE WHEN age <= 60 THEN lang END AS lang
        FROM won""",
    "op12_trie": r"""
        WITH own AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), conv AS (
            SELECT c, c - c % 20 AS base, CAST(xor(4294967295, list_reduce(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT)),
                lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1))), CAST(4294967295 AS BIGINT))) AS BIGINT) % 4 AS h
            FROM (SELECT DISTINCT c FROM own)
        ), heads AS (
            SELECT conv.c, pos, role, text FROM conv JOIN own ON own.c = base AND pos <= h
        ), taken AS (
            SELECT conv.c, h, count(heads.c) AS n FROM conv LEFT JOIN heads ON conv.c = heads.c GROUP BY ALL
        ), turns AS (
            SELECT * FROM heads UNION ALL SELECT own.c, pos - h + n, role, text FROM own JOIN taken ON own.c = taken.c WHERE pos > h
        ), marked AS (
            SELECT c, pos, text, md5(length(role) || ':' || role || text) AS d FROM turns
        ), path AS (
            SELECT c, pos AS depth, text, md5(string_agg(d, '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS node FROM marked
            UNION ALL SELECT c, 0, '', '' FROM conv
        ), ended AS (
            SELECT c, arg_max(node, depth) AS node FROM path GROUP BY c
        ), ends AS (
            SELECT node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS told FROM ended GROUP BY node
        ), up AS (
            SELECT c, depth, text, node, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent FROM path
        ), node AS (
            SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(c) AS c, count(*) AS n,
                   (count(*) - 1) * len(list_filter(regexp_split_to_array(any_value(text), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS own
            FROM up GROUP BY node
        ), kids AS (
            SELECT parent, count(*) AS kids FROM node WHERE parent IS NOT NULL GROUP BY parent
        ), below AS (
            SELECT path.node, sum(CASE WHEN kids.kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum(node.own) AS saved
            FROM node JOIN path ON path.c = node.c AND path.depth <= node.depth LEFT JOIN kids ON kids.parent = node.node GROUP BY path.node
        )
        SELECT node.c AS conv_id, node.depth AS depth, above.c AS parent_conv_id, node.n AS n_convs, coalesce(kids, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, coalesce(told, sha256('')) AS ends_sha256
        FROM node LEFT JOIN node above ON above.node = node.parent LEFT JOIN kids ON kids.parent = node.node JOIN below ON below.node = node.node LEFT JOIN ends ON ends.node = node.node""",
}
