"""The queries of this subpackage: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=35)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which every machine has."""
    from public_tokenizers import path

    return path(name)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def host_list(pages: DataFrame) -> DataFrame:
    """Two lists dated over 2024, made from the hosts of the pages: a hash of the host says if and when it is listed."""
    from tallyline.llm.url_filter import host_of

    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    byte = lambda i: F.conv(F.substring(F.md5("host"), i, 2), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    first = hosts.where(byte(1) % 3 == 0).withColumns({"list": F.when(byte(3) % 2 == 0, "adult").otherwise("malware"), "start": byte(5)})
    added = first.select("list", "host", F.lit("add").alias("action"), day(F.col("start")).alias("dated"))
    gone = first.where(byte(7) % 2 == 0).select("list", "host", F.lit("remove").alias("action"), day(F.col("start") + 1 + byte(9) % 90).alias("dated"))
    return added.union(gone)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch time: page_id spreads them over 2024."""
    from tallyline.llm.url_filter import url_filter

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    out = url_filter(captures, host_list(pages))
    return out.select("page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "host", "blocked", "lists")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.lsh_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("text", "lang"), vocabulary("piece_bpe_32k.model"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.bpe import bpe

    out = bpe(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyline.llm.conversation_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_license_scan, op3_url_filter, op4_exact_topk, op5_mixing, op6_jaccard_join, op7_lsh_forest, op8_language_id, op9_suffix_dedup, op10_bpe, op11_ranked_search, op12_exact_dedup, op13_conversation_trie)
}

def _license_sql() -> str:
    from tallyline.llm.license_scan import TEMPLATES

    values = ", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)
    words = r"string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    at = "unnest(list_transform(range(1, len(w) - 3), lambda i: {'at': i, 's': array_to_string(w[i:i+4], ' ')}), recursive := true)"
    return f"""
WITH t AS (SELECT license, {words.format("notice")} AS w FROM (VALUES {values}) x(license, notice)),
ts AS (SELECT license, len(w) - 4 AS span, {at} FROM t WHERE len(w) >= 5),
tn AS (SELECT license, any_value(span) AS span, count(DISTINCT s) AS n_template FROM ts GROUP BY 1),
ds AS (SELECT doc_id, {at} FROM (SELECT doc_id, {words.format("text")} AS w FROM documents) WHERE len(w) >= 5),
m AS (SELECT DISTINCT d.doc_id, d.at, d.s, x.license FROM ds d JOIN (SELECT DISTINCT license, s FROM ts) x ON d.s = x.s),
c AS (SELECT a.doc_id, a.license, a.at, count(DISTINCT b.s) AS n FROM m a JOIN tn USING (license) JOIN m b ON a.doc_id = b.doc_id AND a.license = b.license AND b.at BETWEEN a.at AND a.at + tn.span - 1 GROUP BY 1, 2, 3)
SELECT doc_id, license, any_value(n_template) AS n_template, max(n) AS n_found FROM c JOIN tn USING (license) GROUP BY 1, 2 HAVING any_value(n_template) * 75 <= 100 * max(n)
"""


ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": _license_sql(),
    "op3_url_filter": r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_at,
    coalesce(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '') AS host
  FROM pages
), b AS (
  SELECT host, CAST('0x' || substr(m, 1, 2) AS INTEGER) AS b1, CAST('0x' || substr(m, 3, 2) AS INTEGER) AS b2, CAST('0x' || substr(m, 5, 2) AS INTEGER) AS b3,
    CAST('0x' || substr(m, 7, 2) AS INTEGER) AS b4, CAST('0x' || substr(m, 9, 2) AS INTEGER) AS b5
  FROM (SELECT host, md5(host) AS m FROM (SELECT DISTINCT host FROM p WHERE host <> ''))
), i AS (
  SELECT CASE WHEN b2 % 2 = 0 THEN 'adult' ELSE 'malware' END AS list, host, DATE '2024-01-01' + b3 AS since,
    CASE WHEN b4 % 2 = 0 THEN DATE '2024-01-01' + b3 + 1 + b5 % 90 END AS until FROM b WHERE b1 % 3 = 0
), v AS (
  SELECT a.host AS host, a.fetched_at AS fetched_at, string_agg(DISTINCT i.list, ',' ORDER BY i.list) AS lists
  FROM (SELECT DISTINCT host, fetched_at FROM p WHERE host <> '') a
  JOIN i ON (a.host = i.host OR ends_with(a.host, '.' || i.host)) AND a.fetched_at >= i.since AND (i.until IS NULL OR a.fetched_at < i.until)
  GROUP BY 1, 2
)
SELECT page_id, url, CAST(p.fetched_at AS VARCHAR) AS fetched_at, p.host AS host, v.lists IS NOT NULL AS blocked, coalesce(v.lists, '') AS lists
FROM p LEFT JOIN v ON p.host = v.host AND p.fetched_at = v.fetched_at
""",
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), g AS (SELECT doc_id AS gid, max(quality) AS grade FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM d GROUP BY source
), w AS (
  SELECT *, CASE (number - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), f AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS below,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w
), l AS (
  SELECT *, max(CASE WHEN (total - below) / open <= cap / weight THEN (total - below) / open END) OVER () AS level FROM f
), t AS (SELECT *, least(cap, coalesce(level, 0.0::DOUBLE) * weight) AS target FROM l
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.number,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), d.text, '') || ':mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / CASE g.grade WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON d.doc_id = g.gid
), a AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY number ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM k
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - ahead)) AS BIGINT) AS taken FROM a
""",
    "op4_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), k AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0
), c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM k
), p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM k) GROUP BY 1, 2
), i AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM i) GROUP BY 1), c
), x AS (
  SELECT p.r, k.doc_id, p.term, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * k.n * docs) // terms))) AS points
  FROM p JOIN w USING (term) JOIN k USING (r), c
), s AS (SELECT item_id, r, doc_id, CAST(sum(points) AS BIGINT) AS score FROM x JOIN i USING (term) GROUP BY 1, 2, 3 HAVING sum(points) > 0
), o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
""",
    "op12_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
""",
    "op13_conversation_trie": r"""
WITH o AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), g AS (
  SELECT c, turn, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS digest, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM o
), t AS (SELECT c, digest, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS i FROM g
), v AS (
  SELECT c, c - c % 20 AS b, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, y: list_reduce(list_concat([xor(s, y)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda z, e: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END))) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT v.c, t.i, t.digest, t.words FROM v JOIN t ON t.c = v.b AND t.i <= v.h
  UNION ALL SELECT v.c, t.i, t.digest, t.words FROM v JOIN t ON t.c = v.c AND t.i > v.h
), q AS (SELECT c, digest, words, row_number() OVER (PARTITION BY c ORDER BY i) AS depth FROM r
), p AS (
  SELECT c, depth, words, string_agg(digest, ',') OVER (PARTITION BY c ORDER BY depth) AS node FROM q
  UNION ALL SELECT c, 0, 0, '' FROM v
), n AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY 1, 2
), u AS (SELECT n.*, p.node AS parent FROM n LEFT JOIN p ON p.c = n.conv_id AND p.depth = n.depth - 1
), k AS (SELECT parent AS node, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY 1
), a AS (
  SELECT p.node, count(*) FILTER (k.node IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved_tokens
  FROM n LEFT JOIN k USING (node) JOIN p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY 1
), e AS (
  SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM p JOIN (SELECT c, max(depth) AS depth FROM p GROUP BY 1) USING (c, depth) GROUP BY 1
)
SELECT u.conv_id, u.depth, m.conv_id AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children, a.n_leaves, a.saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM u LEFT JOIN n m ON m.node = u.parent LEFT JOIN k ON k.node = u.node JOIN a ON a.node = u.node LEFT JOIN e ON e.node = u.node
""",
}
