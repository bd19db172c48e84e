"""Registered queries of the numbered operators: each runs its operator over the whole intended table."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import bpe, html_extract, jaccard_join, line_dedup, packing, permutation_index, prefix_trie, quality, sharding, spelling, token_matrix, toxicity, web_archive

SHARDS = 16


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    settings = toxicity.Settings()
    model = toxicity.fit(docs, _table(spark, folder, "labels"), settings)
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id"), settings.held_out_of).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket",
    )


def op3_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    return permutation_index.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return quality.measure(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept", "ratio", "bad_chunk_share")


def op6_token_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = token_matrix.pack_rows(_table(spark, folder, "documents"))
    return rows.select("sequence_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "doc_ids", "starts", "cumulative")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = sharding.sized(_table(spark, folder, "documents"))
    placed = sharding.assign(docs, "doc_id", [1.0] * SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    texts = html_extract.extract(_table(spark, folder, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similarity_components(_table(spark, folder, "documents").select("doc_id", "text"))


def op11_web_archive(spark: SparkSession, folder: str) -> DataFrame:
    records = web_archive.archived(_table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, folder, "conversations"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_permutation_index": op3_permutation_index,
    "op4_byte_level_bpe": op4_byte_level_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_matrix": op6_token_matrix,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_web_archive": op11_web_archive,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

#: Checksum of the UTF-8 bytes of a text, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length(encode({0})) + 1),
        lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::UBIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]),
            lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""

ORACLES: dict[str, str] = {
    "op11_web_archive": """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
    SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
        first_value(page_id) OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS first_id FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
""",
    "op12_prefix_trie": f"""
WITH own AS (
    SELECT conv_id, list(md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST) AS a,
        list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS s
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), lent AS (
    SELECT o.*, ({_CRC32.format('o.conv_id::VARCHAR')} % 6)::INT AS h, coalesce(d.a, []) AS da, coalesce(d.s, []) AS ds
    FROM own o LEFT JOIN own d ON d.conv_id = o.conv_id - o.conv_id % 100
), seq AS (
    SELECT conv_id, list_concat(da[1:h], a[h + 1:]) AS p, list_concat(ds[1:h], s[h + 1:]) AS s FROM lent
), member AS (
    SELECT conv_id, k::BIGINT AS depth, p[1:k] AS node, len(p) = k AS is_end, CASE WHEN k = 0 THEN 0 ELSE s[k] END AS size
    FROM seq, unnest(generate_series(0, len(p))) AS t(k)
), node AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
    FROM member GROUP BY node, depth
), child AS (
    SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), below AS (
    SELECT v.node[1:k] AS node, sum(v.saved)::BIGINT AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
    FROM node v LEFT JOIN child c ON c.node = v.node, unnest(generate_series(0, v.depth)) AS t(k) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM node n JOIN below b ON b.node = n.node LEFT JOIN child c ON c.node = n.node
LEFT JOIN node p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE run AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS r
    FROM documents
), counted AS (
    SELECT doc_id, r, count(*) AS n FROM run WHERE length(r) >= 7 GROUP BY ALL
), tab AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
            lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS c
        FROM range(256) AS g(i))
), summed AS (
    SELECT r, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''),
            lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] ELSE [195::UBIGINT, (unicode(x) - 64)::UBIGINT] END))),
        lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h
    FROM counted, tab
), word AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN r[1:(h % length(r))::BIGINT] || r[(h % length(r))::BIGINT + 2:] ELSE r END AS word, n FROM summed
    ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
    SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM word, unnest(generate_series(1, length(word))) AS g(i)
), near AS (
    SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT l.word, w.word FROM less l JOIN word w ON w.word = l.rest
    UNION SELECT w.word, l.word FROM less l JOIN word w ON w.word = l.rest
), best AS (
    SELECT a.word, count(*) AS n_near, max(b.n) AS top, arg_min(b.word, struct_pack(x := -b.n, y := b.word)) AS other
    FROM near a JOIN word b ON b.word = a.other GROUP BY a.word
), formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 10 * w.n THEN b.other END AS form, CASE WHEN b.top >= 10 * w.n THEN b.top END AS form_n
    FROM word w LEFT JOIN best b USING (word)
), up(word, top) AS (
    SELECT word, word FROM formed UNION ALL SELECT u.word, f.form FROM up u JOIN formed f ON f.word = u.top WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, u.top AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN up u ON u.word = f.word JOIN formed g ON g.word = u.top AND g.form IS NULL
""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS shingle
    FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
    WHERE 100 * p.both >= 80 * (x.n + y.n - p.both)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, node) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
""",
}
