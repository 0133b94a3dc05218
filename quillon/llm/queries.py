"""The queries of this subpackage and their DuckDB SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import audit_queries, chosen_path, decontam, exact_stream, html_paths, langid, line_join, token_scan, unigram, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]
#: Hosts that are blocked, with their subdomains, where no rule fits.
LISTED_HOSTS = [
    "cheap-pills.example.net",
    "cheap-pills.example.org",
    "spam-farm.example.net",
    "spam-farm.example.org",
]

OP2_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rule, verdict, rhost, rpath) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
f AS (SELECT p.*, list(struct_pack(n := length(rule), rule := rule, verdict := rules.verdict) ORDER BY length(rule) DESC)
        FILTER (WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS fit
      FROM p, rules GROUP BY page_id, host, path)
SELECT page_id, host, path, fit[1].rule AS rule,
       coalesce(fit[1].verdict, CASE WHEN regexp_matches(host, '(^|\.)(cheap-pills|spam-farm)\.example\.(net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""

OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM r WHERE a = doc_id), doc_id)) AS class_id, 1 + (SELECT count(*) FROM l WHERE a = doc_id AND same) AS copies, (SELECT count(*) FROM l WHERE a = doc_id) AS n_links FROM d
"""

#: For pages as the test tables have them: article, h1, p, b, br, the references &amp; and &quot;, and cut-off ends.
OP6_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\z)', 1), '<[a-zA-Z/][^<>]*\z', '') AS t FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(?:p|h1)>'),
        lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS l FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""

OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT page_id, payload, strlen(payload) AS n, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record of a seekable bundle and read back."""
    made = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return made.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text by tag-path ratios."""
    return html_paths.extract_pages(_table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns)),
m AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside windows of benchmark items."""
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("item_ids")


def op8_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language by text, declaration and source."""
    return langid.identify_documents(_table(spark, sf_dir, "documents"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its language by text, markup, address suffix and host."""
    labelled = _table(spark, sf_dir, "documents").select("text", F.col("lang").alias("language"))
    return langid.identify_pages(_table(spark, sf_dir, "pages"), labelled)


def op9_unigram_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by unigram pieces and decoded again."""
    return unigram.round_trip(_table(spark, sf_dir, "documents"))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, found in flat token files by the separators."""
    return token_scan.count_tokens(_table(spark, sf_dir, "documents"))


def op10_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the numbers of its lines that repeat an earlier line: exactly at any length, from 20 bytes up to two edits."""
    return line_join.line_dedup_report(_table(spark, sf_dir, "documents"), least=1)


def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by the listed hosts."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, RULES, LISTED_HOSTS).select("page_id", "host", "path", "rule", "verdict")


def op5_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its text that stays."""
    return exact_stream.exact_duplicates(spark, f"{sf_dir}/documents.parquet")


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links (five words, similarity 0.8)."""
    return chosen_path.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_warc_bundles, op2_url_cascade, op3_chosen_path_join, op4_separator_scan, op5_streaming_exact_dedup, op6_tag_path_text, op7_positional_index, op8_language_evidence, language_of_pages, op9_unigram_round_trip, op10_line_edit_join)} | audit_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_bundles": OP1_SQL, "op2_url_cascade": OP2_SQL, "op3_chosen_path_join": OP3_SQL, "op5_streaming_exact_dedup": OP5_SQL, "op6_tag_path_text": OP6_SQL, "op7_positional_index": OP7_SQL} | audit_queries.oracle_sql()
