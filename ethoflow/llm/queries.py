"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import byte_dedup

    return byte_dedup(table(spark, sf_dir, "documents"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import word_dedup

    return word_dedup(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, toxicity

    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), locate=False)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated, contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))


ORACLES["op4_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS win FROM starts),
lens AS (SELECT DISTINCT n FROM wins),
occ AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
hit AS (SELECT o.doc_id, o.p, o.n, x.item_id FROM (SELECT doc_id, p, n, w[p:p + n - 1] AS win FROM occ) o JOIN wins x ON o.n = x.n AND o.win = x.win),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, formatted, text_parts

    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = own.union(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], own.schema))
    return digests(formatted(own.withColumn("parts", text_parts(F.col("text")))))


# formatted_chars: 9 for each turn's marks, its role twice, its text with one more for each of ~ < [ ]
ORACLES["op9_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + 2 * length(role) + length(text) + length(regexp_replace(text, '[^~<\[\]]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, listed, personal_data

    told = personal_data(table(spark, sf_dir, "documents"))
    return told.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLES["op6_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


#: The pages have no fetch times and there are no lists; both follow from the pages by fixed rules.
_DAY = "timestamp_ntz'2024-01-01 00:00:00'"


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of pages: fetched day page_id mod 365. Lists: a host whose crc32 mod 7 is below 3 is added on
    day crc32 mod 200 and removed 60 days later; paths /en/ of hosts of mod 7 = 3 are added on day 100; example.net is
    allowed from day 0 to 180, then blocked."""
    from .url_filter import filtered, host_of

    pages = table(spark, sf_dir, "pages")
    day = lambda d: F.expr(f"{_DAY} + make_dt_interval({d})")
    captures = pages.select("page_id", "url", day("cast(pmod(page_id, 365) as int)").alias("fetched_at"))
    hosts = pages.select(host_of(F.col("url")).alias("domain")).distinct().withColumn("c", F.crc32("domain"))
    row = lambda df, name, path, verdict, action, d: df.select(F.lit(name).alias("list"), "domain", F.lit(path).alias("path"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), day(d).alias("at"))
    some, other = hosts.where("c % 7 < 3"), hosts.where("c % 7 = 3")
    fixed = spark.createDataFrame([("example.net",)], "domain string")
    entries = row(some, "hosts", "/", "block", "add", "cast(c % 200 as int)").union(row(some, "hosts", "/", "block", "remove", "cast(c % 200 as int) + 60"))
    entries = entries.union(row(other, "paths", "/en/", "block", "add", "100")).union(row(fixed, "zones", "/", "allow", "add", "0")).union(row(fixed, "zones", "/", "block", "add", "180"))
    return filtered(captures, entries)


# crc32 by its bits, over the bytes of the host; the fixed rules of the query give the intervals outright
ORACLES["op7_url_filters"] = r"""
WITH p AS (SELECT row_number() OVER () AS n, page_id, url, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (page_id % 365) AS t,
  rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host, regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS raw FROM pages),
h AS (SELECT host AS domain, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(0, strlen(host)), lambda i: [CAST('0x' || substr(hex(host), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384))) AS c FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
r AS (SELECT 'hosts' AS list, domain, '/' AS path, 'block' AS verdict, c % 200 AS a, c % 200 + 60 AS b FROM h WHERE c % 7 < 3 UNION ALL SELECT 'paths', domain, '/en/', 'block', 100, 100000 FROM h WHERE c % 7 = 3
  UNION ALL SELECT 'zones', 'example.net', '/', 'allow', 0, 180 UNION ALL SELECT 'zones', 'example.net', '/', 'block', 180, 100000),
v AS (SELECT * REPLACE (TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * a AS a, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * b AS b) FROM r),
m AS (SELECT n, list, domain, path, verdict, row_number() OVER (PARTITION BY n ORDER BY length(domain) DESC, length(path) DESC, a DESC, list DESC, verdict DESC) AS k, count(*) OVER (PARTITION BY n) AS n_active
  FROM p JOIN v ON t >= a AND t < b AND (host = domain OR ends_with(host, '.' || domain)) AND starts_with(CASE WHEN raw = '' THEN '/' ELSE raw END, path) WHERE url IS NOT NULL)
SELECT page_id, host, coalesce(verdict, 'pass') AS verdict, list || ' ' || domain || path AS rule, coalesce(n_active, 0) AS n_active FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)
"""


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import tokens

    told = tokens(table(spark, sf_dir, "documents"))
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_fallback", F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    told = line_dedup(table(spark, sf_dir, "documents"), least_docs=10)
    return told.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op11_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
rep AS (SELECT key, true AS gone FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN rep USING (key) GROUP BY doc_id
"""


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op12_ranked_search"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, CAST(n AS BIGINT) AS n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN b USING (term) GROUP BY doc_id, n, term),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, corpus GROUP BY term, n_docs),
impacts AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS impact FROM tf JOIN df USING (term), corpus),
scored AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM b JOIN impacts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import branched, placed, prefix_trie
    from .shared import written

    rows = written(placed(table(spark, sf_dir, "conversations")), "placed")
    return prefix_trie(branched(rows), rows.select("conv_id")).drop("k1", "k2")


# the list of crc steps holds each digit's code and seven zeros, one for each bit
ORACLES["op13_conversation_trie"] = r"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS source, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384))) % 9 AS h FROM (SELECT DISTINCT conv_id FROM c)),
turns AS (SELECT i.conv_id, pos, r, t FROM ids i JOIN c ON c.conv_id = source WHERE pos < h UNION ALL SELECT conv_id, pos, r, t FROM c JOIN ids USING (conv_id) WHERE pos >= h),
built AS (SELECT conv_id, coalesce(l, []) AS l FROM ids LEFT JOIN (SELECT conv_id, list({'r': r, 't': t} ORDER BY pos) AS l FROM turns GROUP BY conv_id) USING (conv_id)),
pre AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM built),
node AS (SELECT l[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len(l)), '') AS done FROM pre GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
told AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (k)),
anc AS (SELECT *, unnest(range(0, d + 1)) AS a FROM told),
roll AS (SELECT k[1:a] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(k[d].t) END) AS saved FROM anc GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.done) AS ends_sha256
FROM told n JOIN roll USING (k) LEFT JOIN node p ON n.d > 0 AND p.k = n.k[1:n.d - 1]
"""
