"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import edit_counts, exact_dedup, interaction, language, media, packing, passages, pieces, secrets, simhash, toxicity, trie, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document; counts before and after, and how many pre-tokens the edits re-encoded."""
    docs = _table(spark, sf_dir, "documents")
    edited = docs.select("doc_id", "text", edit_counts.sample_edits(F.col("text")).alias("edits"))
    return edit_counts.count_tokens(edited).select("doc_id", "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


#: The block list as select expressions over ``pages``: URLs of the spam hosts, and every seventh page as reported, in several spellings of the same canonical URL.
LIST_RULE = "page_id % 7 = 3"
LIST_URL = "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_source=feed') ELSE replace(replace(url, '://www.', '://WWW.'), 'http://', 'https://') END"


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds a block list, so one is made of ``pages``: see LIST_RULE.  Other pages are hit where they have a listed page's canonical URL."""
    pages = _table(spark, sf_dir, "pages")
    spam = url_filter.host(F.col("url")).rlike(ALL_SPAM_HOSTS)
    listed = pages.where(F.expr(LIST_RULE) | spam).selectExpr(f"{LIST_URL} AS url")
    return url_filter.filter_urls(pages, listed)


def op7_url_filter_all_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed URLs are those of all six spam hosts that ``pages`` has."""
    pages = _table(spark, sf_dir, "pages")
    listed = pages.where(url_filter.host(F.col("url")).rlike(ALL_SPAM_HOSTS)).select("url")
    return url_filter.filter_urls(pages, listed)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.coded(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


ALL_SPAM_HOSTS = r"(^|\.)(spam-farm|cheap-pills|casino-win|free-bets|adult-x|ads-track)\."

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_edit_counts, op3_toxicity, op4_secret_scan, op5_language_id, op6_exact_dedup, op7_url_filter, op7_url_filter_all_hosts, op8_media, op9_sentencepiece, op10_simhash, op11_conversation_trie, op12_filter_audit, op13_suffix_dedup)
}

_SPAN = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_SEPARATOR = r"""["'']? *[:=] *["'']?"""
#: kind: (pattern, condition on the match m)
_KINDS = {
    "assign": (f"{_SPAN}{_SEPARATOR}[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '^{_SPAN}{_SEPARATOR}(.*)$', 1)) >= 12"),
    "access": ("AKIA[A-Z0-9]+", "length(m) >= 18"),
    "hex": ("[0-9a-f]+", "length(m) >= 16"),
    "github": ("gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    "slack": ("xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 20"),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(m) >= 40"),
    "pem": ("-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", "true"),
}


def _secret_sql() -> str:
    """Matches are marked by U+0001, and a match's place follows from the lengths of what lies before it."""
    each = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, b + CAST(coalesce(list_sum(list_transform(p[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(p[i]) AS n
        FROM (SELECT doc_id, 0 AS b, string_split(regexp_replace(coalesce(text, ''), '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
        LATERAL (SELECT unnest(range(2, len(p) + 1, 2)) AS i), LATERAL (SELECT p[i] AS m) WHERE {condition}"""
        for k, (kind, (pattern, condition)) in enumerate(_KINDS.items())
    )
    return f"""WITH hits AS ({each}),
    listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
        string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans FROM hits GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN listed USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op4_secret_scan": _secret_sql(),
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT norm, count(*) AS group_size FROM d GROUP BY norm),
        r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r JOIN g USING (norm)""",
}


def _url_sql(listed: str) -> str:
    parts = r"""lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                array_to_string(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
                    lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[^=]*|ref)(?:=|$)'))), '&') AS query"""
    canon = "host || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canon"
    return rf"""
        WITH p AS (SELECT page_id, {parts} FROM pages), c AS (SELECT *, {canon} FROM p),
        l AS (SELECT {parts} FROM ({listed})), listed AS (SELECT DISTINCT canon FROM (SELECT {canon} FROM l) WHERE canon <> ''),
        r AS (SELECT *, canon IN (SELECT canon FROM listed) AS found, CASE
            WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM c)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN found THEN 'block' ELSE 'allow' END AS verdict, rule IS NULL AND found AS listed FROM r"""


_SPAM_SQL = rf"regexp_matches(lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)), '{ALL_SPAM_HOSTS}')"
ORACLE_SQL["op7_url_filter"] = _url_sql(f"SELECT {LIST_URL} AS url FROM pages WHERE {LIST_RULE} OR {_SPAM_SQL}")
ORACLE_SQL["op7_url_filter_all_hosts"] = _url_sql(f"SELECT url FROM pages WHERE {_SPAM_SQL}")

#: Each order is walked step by step over the sets of failed filters; nothing of the polynomial is used.
ORACLE_SQL["op12_filter_audit"] = r"""
    WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
            min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
    marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
            || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN least < w.doc_id THEN 'E' ELSE '' END AS fails
        FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
    m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
    l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
        WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
    s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS own, substr(filter_order, 1, CAST(step AS INTEGER) - 1) AS before FROM o, (VALUES (1), (2), (3), (4), (5)) AS k(step)),
    p AS (SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS here, regexp_matches(fails, '[0' || before || ']') AS gone FROM m, s),
    r AS (SELECT part, filter_order, step, own,
            CAST(coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here AND NOT gone), 0) AS BIGINT) AS removed,
            CAST(coalesce(sum(n) FILTER (here AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(sum(good) FILTER (here AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS BIGINT) AS toxic_lost
        FROM p GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""

#: crc32 by its table, character after character; then every prefix of every rebuilt conversation, and sums over all prefixes below each.
ORACLE_SQL["op11_conversation_trie"] = r"""
    WITH RECURSIVE tab(i, k, v) AS (SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM tab WHERE k < 8),
    crc(conv_id, s, c) AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM conversations WHERE conv_id IS NOT NULL
        UNION ALL SELECT conv_id, substr(s, 2), CAST(xor(v, c // 256) AS BIGINT) FROM crc, tab WHERE k = 8 AND i = xor(c % 256, ascii(s)) AND s <> ''),
    h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE s = ''),
    own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    whole AS (SELECT h.conv_id, k, 0 AS later, role, text FROM h JOIN own ON own.conv_id = h.conv_id - h.conv_id % 5 AND k <= h
        UNION ALL SELECT h.conv_id, k, 1, role, text FROM h JOIN own ON own.conv_id = h.conv_id AND k > h),
    steps AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY later, k) AS depth, octet_length(encode(text)) AS size, sha256(length(role) || ':' || role || text) AS one FROM whole),
    prefixes AS (SELECT conv_id, depth, size, string_agg(one, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM steps
        UNION ALL SELECT conv_id, 0, 0, '' FROM h),
    longest AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
    nodes AS (SELECT path, depth, min(size) AS size, count(*) AS n_convs, min(p.conv_id) AS conv_id,
            coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (most = p.depth), '') AS ended
        FROM (SELECT p.*, l.depth AS most FROM prefixes p JOIN longest l ON p.conv_id = l.conv_id) AS p GROUP BY path, p.depth),
    kids AS (SELECT substr(path, 1, 64 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids ON n.path = kids.path),
    below AS (SELECT substr(path, 1, 64 * CAST(d AS INTEGER)) AS path, sum((n_convs - 1) * size) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM known) GROUP BY 1)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
        CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ended) AS ends_sha256
    FROM known n JOIN below ON n.path = below.path LEFT JOIN nodes up ON n.depth > 0 AND up.path = substr(n.path, 1, 64 * (n.depth - 1))"""
