"""SQL over the driver tables that must give the same rows as the registered queries."""

from __future__ import annotations

from postwatch.functions.indicators import FILE_SUFFIXES
from postwatch.functions.scoring import THREAT_TERMS
from postwatch.functions.text import REFANG, split_terms
from postwatch.plans.fixture import (
    AS_OF,
    CYCLE_MINUTES,
    EVENTS_AS_OF,
    SENTENCES,
    SETTINGS,
    START,
)
from postwatch.plans.registry import (
    ADMISSION_LIMIT,
    ADMISSION_SECONDS,
    ANY_TOPIC,
    IDLE_SECONDS,
    LOW_THRESHOLDS,
    PAGE_KEY,
    SEEN_AS_OF,
)
from postwatch.schema import INDICATOR_FIELDS, Thresholds
from postwatch.sources.synthetic import TEMPLATES

ORACLES: dict[str, str] = {}


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def stamp(moment) -> str:
    return f"TIMESTAMP '{moment.isoformat(sep=' ')}'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(value) for value in values) + "]"


def joined(column: str) -> str:
    return f"coalesce(array_to_string({column}, '|'), '')"


def clock(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


DAY = "CAST(day AS VARCHAR) AS day"


def tidy(values: str) -> str:
    return f"list_sort(list_distinct({values}))"


# --- posts ---------------------------------------------------------------------------------------

RAW = f"""
raw AS (
  SELECT CASE WHEN lang = 'en' THEN 'x_home' ELSE 'synthetic' END AS source_type,
    CAST(doc_id AS VARCHAR) AS post_id, source AS author_id,
    prefix || text || ' ' || ({listed(SENTENCES)})[CAST(doc_id % 6 AS INT) + 1] AS text, lang,
    {stamp(START)} + to_minutes(CAST((doc_id * 37) % {CYCLE_MINUTES} + shift * 1440 AS BIGINT))
      AS created_at,
    'user_' || source AS username, upper(source) AS display_name,
    CAST(n_chars % 500 + v - 1 AS BIGINT) AS like_count, n_chars AS impression_count,
    CAST(v AS BIGINT) AS content_version
  FROM documents
  JOIN (VALUES (1, '', 0), (2, 'Edited: ', 0), (3, 'Moved: ', 1)) AS t(v, prefix, shift)
    ON v = 1 OR (v = 2 AND lang IN ('fr', 'de')) OR (v = 3 AND lang = 'es')
),
ver AS (
  SELECT *, CAST(created_at AS DATE) AS day,
    created_at + to_minutes(content_version) AS ingested_at
  FROM raw
),
cur AS (
  SELECT * FROM ver
  QUALIFY row_number() OVER (PARTITION BY day, post_id ORDER BY content_version DESC) = 1
)"""


def refanged(text: str) -> str:
    for written, meant in REFANG:
        text = f"replace({text}, {quoted(written)}, {quoted(meant)})"
    return text


def normalized(text: str) -> str:
    return rf"trim(regexp_replace(replace(lower({text}), 'ß', 'ss'), '\s+', ' ', 'g'))"


def found(pattern: str, group: int = 0, text: str = "prepared") -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)}, {group})"


OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
WORD = r"\w\x{00C0}-\x{024F}"  # word characters of the driver's languages


def ipv6_sql(run: str) -> str:
    """Canonical form of one candidate, or NULL."""
    low = f"lower({run})"
    tail = f"regexp_extract({low}, '(?:^|:)({IPV4})$', 1)"
    octet = [f"TRY_CAST(split_part({tail}, '.', {n}) AS INT)" for n in range(1, 5)]
    pair = [f"lower(to_hex({octet[n]} * 256 + {octet[n + 1]}))" for n in (0, 2)]
    text = (
        f"CASE WHEN {tail} <> '' THEN left({low}, length({low}) - length({tail})) || {pair[0]}"
        f" || ':' || {pair[1]} ELSE {low} END"
    )
    group = "[0-9a-f]{1,4}"
    some = f"{group}(?::{group})*"

    def parts(side: str) -> str:
        return f"CASE WHEN {side} = '' THEN [] ELSE string_split({side}, ':') END"

    left = parts(f"regexp_extract({text}, '^(.*?)::', 1)")
    right = parts(f"regexp_extract({text}, '::(.*)$', 1)")
    missing = f"8 - len({left}) - len({right})"
    spelled = (
        f"CASE WHEN regexp_full_match({text}, '{group}(?::{group}){{7}}')"
        f" THEN string_split({text}, ':')"
        f" WHEN regexp_full_match({text}, '(?:{some})?::(?:{some})?') AND {missing} >= 1"
        f" THEN list_concat({left}, list_concat(list_resize(CAST([] AS VARCHAR[]), {missing}, '0'),"
        f" {right})) END"
    )
    return spelled


def zero_runs(text: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({text}, '(?:^|:)0(?::0){{{n - 1}}}(?:$|:)') THEN regexp_replace("
        rf"{text}, '^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?:$|:)(.*)$', '\1::\2')"
        for n in range(8, 1, -1)
    )
    return f"CASE {whens} ELSE {text} END"


def candidate_lists() -> str:
    doubled = r"regexp_replace(prepared, '([^\w:.\x{00C0}-\x{024F}])', '\1\1', 'g')"
    pattern = rf"(?:^|[^{WORD}:])([A-Fa-f0-9:.]{{3,45}})(?:$|[^{WORD}:])"
    return f"list_transform({found(pattern, 1, doubled)}, lambda c: trim(c, '.'))"


def extraction(source: str) -> str:
    """CTEs from rows with ``text`` to rows with the fourteen lists."""
    groups = (
        f"list_transform(list_filter(candidates, lambda c: contains(c, ':')),"
        f" lambda c: {ipv6_sql('c')})"
    )
    plain_groups = (
        "list_transform(list_filter(v6_groups, lambda g: g IS NOT NULL), lambda g:"
        " array_to_string(list_transform(g, lambda h: regexp_replace(h, '^0+(.)', '\\1')), ':'))"
    )
    # --- fixed values: the patterns of the extraction, as the other engine spells them
    host_pattern = r"(?i)^https?://(?:[^/?#]*@)?([^/?#:@\[\]]+)(?::[^/?#\[\]]*)?(?:[/?#]|$)"
    hosts = (
        f"list_filter(list_transform(ioc_urls, lambda u: lower(regexp_extract(u,"
        f" {quoted(host_pattern)}, 1))), lambda h: h <> '' AND NOT regexp_full_match(h, '{IPV4}'))"
    )
    domain = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\b"
    named = f"list_distinct({found(domain)})"
    not_mail = (
        f"list_filter({named}, lambda d: NOT list_contains(list_transform(ioc_emails,"
        " lambda m: split_part(m, '@', 2)), d))"
    )
    digests = ", ".join(
        f"{tidy(found(rf'\b[a-fA-F0-9]{{{size}}}\b'))} AS ioc_{name}"
        for name, size in (("md5", 32), ("sha1", 40), ("sha256", 64), ("sha512", 128))
    )
    url = r"""(?i)\bhttps?://[^\s<>"']+"""
    urls = f"list_transform({found(url)}, lambda u: rtrim(u, '.,);]'))"

    def upper(pattern: str) -> str:
        return tidy(f"list_transform({found(pattern)}, lambda x: upper(x))")

    hashtag = rf"(?:^|[^{WORD}])#([{WORD}-]{{2,64}})"
    return f"""
prep AS (SELECT *, {refanged('text')} AS prepared, {normalized('text')} AS norm FROM {source}),
ext1 AS (
  SELECT *, {tidy(urls)} AS ioc_urls,
    {tidy(found(r'(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}\b'))} AS ioc_emails,
    {candidate_lists()} AS candidates
  FROM prep
),
ext2 AS (SELECT *, {groups} AS v6_groups FROM ext1),
ext3 AS (SELECT *, {plain_groups} AS v6_plain FROM ext2),
ext AS (
  SELECT *,
    {tidy(f"list_filter(candidates, lambda c: regexp_full_match(c, '{IPV4}'))")} AS ioc_ipv4,
    {tidy(f"list_transform(v6_plain, lambda p: {zero_runs('p')})")} AS ioc_ipv6,
    list_sort(list_transform(list_distinct(list_concat({not_mail}, {hosts})), lambda d: lower(d)))
      AS ioc_domains,
    {digests},
    {upper(r'(?i)\bCVE-[0-9]{4}-[0-9]{4,7}\b')} AS ioc_cves,
    {upper(r'(?i)\bT[0-9]{4}(?:\.[0-9]{3})?\b')} AS ioc_attack_techniques,
    {tidy(found(rf'(?i)\b[{WORD}.-]+\.(?:{FILE_SUFFIXES})\b'))} AS ioc_filenames,
    {tidy(f"list_transform({found(hashtag, 1)}, lambda x: lower(x))")} AS ioc_hashtags,
    {upper(r'(?i)\b(?:APT[0-9]{1,3}|UNC[0-9]{2,6}|FIN[0-9]{1,3}|TA[0-9]{3,6})\b')}
      AS ioc_threat_actors
  FROM ext3
)"""


def lengths(*names: str) -> str:
    return "(" + " + ".join(f"len(ioc_{name})" for name in names) + ")"


HASHES = lengths("md5", "sha1", "sha256", "sha512")
NETWORK = lengths("ipv4", "ipv6", "domains", "urls")
SUPPORTING = lengths("emails", "filenames", "threat_actors")


def level(score: str, limits: Thresholds) -> str:
    return (
        f"CASE WHEN {score} >= {limits.critical} THEN 'critical' WHEN {score} >= {limits.high}"
        f" THEN 'high' WHEN {score} >= {limits.medium} THEN 'medium' ELSE 'low' END"
    )


def scoring(semantic: str = "") -> str:
    """CTEs from ``ext`` to ``posts``; ``semantic`` joins a score and categories per post."""
    flags = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains(norm, {quoted(term)})" for term in terms)
        + f" THEN {quoted(category)} END"
        for category, terms in THREAT_TERMS.items()
    )
    trusted = ", ".join(quoted(handle) for handle in SETTINGS.trusted_handles)
    no_model = "CAST(NULL AS DOUBLE) AS sem, CAST([] AS VARCHAR[]) AS sem_categories"
    source = (
        f"SELECT ext.*, s.sem, coalesce(s.sem_categories, []) AS sem_categories FROM ext"
        f" LEFT JOIN {semantic} s ON s.post_id = ext.post_id"
        if semantic else f"SELECT *, {no_model} FROM ext"
    )
    names = {
        "ioc_evidence": "p_ioc", "cve_attack_reference": "p_ref", "threat_context": "p_context",
        "trusted_source": "p_trust", "engagement_signal": "p_engaged",
    }
    parts = ", ".join(
        f"CASE WHEN {column} > 0 THEN '{name}:' || {column} END" for name, column in names.items()
    )
    return f"""
sem_ext AS ({source}),
part1 AS (
  SELECT *, list_filter([{flags}], lambda x: x IS NOT NULL) AS contexts,
    least(45, 15 * {HASHES} + 5 * {NETWORK} + 3 * {SUPPORTING}) AS p_ioc,
    least(20, 8 * len(ioc_cves) + 6 * len(ioc_attack_techniques)) AS p_ref,
    CASE WHEN username IN ({trusted}) THEN 10 ELSE 0 END AS p_trust,
    least(5, CAST(floor(log10(like_count + impression_count + 1)) AS BIGINT)) AS p_engaged
  FROM sem_ext
),
part2 AS (SELECT *, least(20, 6 * len(contexts)) AS p_context FROM part1),
part3 AS (
  SELECT *, CAST(least(100, p_ioc + p_ref + p_context + p_trust + p_engaged) AS BIGINT) AS rule
  FROM part2
),
part4 AS (
  SELECT *, coalesce(CAST(round_even(0.65::DOUBLE * rule + 0.35::DOUBLE * sem, 0) AS BIGINT), rule)
    AS final
  FROM part3
),
posts AS (
  SELECT *, greatest(0, least(100, final)) AS cti_score, rule AS cti_rule_score,
    {level('final', SETTINGS.thresholds)} AS cti_level,
    CASE WHEN sem IS NULL THEN 'rules_only' ELSE 'hybrid' END AS cti_scoring_mode,
    list_sort(list_distinct(list_concat(list_concat(
      list_filter([CASE WHEN p_ioc > 0 THEN 'ioc_sharing' END,
        CASE WHEN p_ref > 0 THEN 'vulnerability' END], lambda x: x IS NOT NULL),
      contexts), sem_categories))) AS cti_categories,
    list_filter([{parts}, CASE WHEN sem IS NULL THEN 'semantic_model:unavailable'
      ELSE 'semantic_relevance:' || printf('%.1f', sem) END], lambda x: x IS NOT NULL)
      AS cti_reasons
  FROM part4
)"""


POSTS = f"WITH {RAW},{extraction('cur')},{scoring()}\n"
CURRENT = f"WITH {RAW}\n"
EXTRACTED = f"WITH {RAW},{extraction('cur')}\n"
VERSIONS = f"WITH {RAW},{extraction('ver')},{scoring()}\n"

VECTORS = """
proto AS (
  SELECT 'label_' || label AS category, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS vector
  FROM embeddings GROUP BY label
),
sims AS (
  SELECT vec_id, category,
    list_cosine_similarity(CAST(embedding AS DOUBLE[]), vector) AS similarity
  FROM embeddings, proto
),
sem_rows AS (
  SELECT vec_id, CAST(vec_id AS VARCHAR) AS post_id,
    round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE,
      (max(similarity) - 0.25::DOUBLE) / 0.55::DOUBLE * 100)), 2) AS sem,
    coalesce(list_sort(list(category) FILTER (similarity >= 0.55)), []) AS sem_categories
  FROM sims GROUP BY vec_id
)"""
HYBRID = f"WITH {RAW},{extraction('cur')},{VECTORS},{scoring('sem_rows')}\n"


def lists(*names: str) -> str:
    return ", ".join(f"{joined(name)} AS {name}" for name in names)


IOC = [f"ioc_{name}" for name in INDICATOR_FIELDS]


# --- scans, sources, sinks -----------------------------------------------------------------------

ORACLES["scan_current"] = CURRENT + f"""
SELECT post_id, {DAY}, lang, username, content_version, like_count FROM cur"""
ORACLES["dedupe_versions"] = CURRENT + f"""
SELECT post_id, {DAY}, content_version, like_count, text FROM cur"""
ORACLES["late_version"] = CURRENT + """
SELECT content_version, count(*) AS posts, CAST(sum(like_count) AS BIGINT) AS likes
FROM cur GROUP BY content_version"""
ORACLES["insert_roundtrip"] = POSTS + f"""
SELECT post_id, {DAY}, content_version, cti_score, cti_level, {lists('cti_categories',
'ioc_domains')}, CAST(-1 AS DOUBLE) AS cti_semantic_score, {clock('created_at')} AS created_at
FROM posts"""
ORACLES["compacted_store"] = POSTS + f"SELECT post_id, {DAY}, content_version, cti_score FROM posts"
ORACLES["apply_deletes"] = CURRENT + f"""
SELECT post_id, {DAY}, content_version FROM ver
WHERE post_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"""
ORACLES["stream_deletes"] = CURRENT + f"""
SELECT post_id, {DAY}, content_version FROM ver
WHERE post_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1 AND doc_id % 2 = 1)
  AND NOT (content_version = 1
    AND post_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1 AND doc_id % 2 = 0))"""
ORACLES["purged_store"] = ORACLES["apply_deletes"]
ORACLES["synthetic_posts"] = f"""
WITH numbers AS (SELECT l_orderkey * 8 + l_linenumber AS number FROM lineitem),
rows AS (
  SELECT *, ({listed(TEMPLATES)})[CAST(number % 6 AS INT) + 1] AS body,
    {stamp(AS_OF)} - to_seconds(number % 31536000) AS created_at, number % 101 AS score,
    number % 6 AS kind
  FROM numbers
)
SELECT '9' || lpad(CAST(number AS VARCHAR), 19, '0') AS post_id,
  CAST(CAST(created_at AS DATE) AS VARCHAR) AS day,
  CAST(number % 100000 AS VARCHAR) AS author_id, lower(body) AS normalized_text,
  CASE WHEN number % 2 = 0 THEN 'en' ELSE 'tr' END AS lang, {clock('created_at')} AS created_at,
  'synthetic_' || (number % 100000) AS username, number % 500 AS like_count,
  number % 10000 AS impression_count, score AS cti_score,
  {level('score', Thresholds())} AS cti_level, CAST(score AS DOUBLE) AS cti_semantic_score,
  CASE WHEN number % 3 = 0 THEN 'vulnerability|ioc_sharing' ELSE '' END AS cti_categories,
  CASE WHEN kind = 0 THEN '203.0.113.42' ELSE '' END AS ioc_ipv4,
  CASE WHEN kind IN (0, 1) THEN 'malware.example' ELSE '' END AS ioc_domains,
  CASE WHEN kind = 1 THEN 'https://malware.example' ELSE '' END AS ioc_urls,
  CASE WHEN kind = 0 THEN 'CVE-2026-4242' ELSE '' END AS ioc_cves,
  CASE WHEN kind = 2 THEN 'T1059.001' ELSE '' END AS ioc_attack_techniques,
  CASE WHEN kind = 2 THEN 'APT42' ELSE '' END AS ioc_threat_actors
FROM rows"""
ORACLES["page_ingest"] = """
SELECT t.conv_id || '-' || t.turn AS post_id, t.role AS author_id,
  CAST(t.conv_id AS VARCHAR) AS conversation_id,
  CASE WHEN length(b.text) > length(t.text) THEN b.text ELSE t.text END AS text, 'und' AS lang,
  '@' || t.role AS username, upper(left(t.role, 1)) || substr(t.role, 2) AS display_name,
  CASE WHEN b.text IS NULL THEN '' ELSE t.conv_id || '-' || (t.turn - 1) END
    AS referenced_post_ids,
  CAST(1 AS BIGINT) AS content_version
FROM conversations t
LEFT JOIN conversations b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1"""
ORACLES["page_meta"] = """
SELECT t.conv_id, t.turn, t.conv_id || '-' || t.turn AS newest_id,
  CASE WHEN b.text IS NOT NULL THEN 'before-' || t.conv_id || '-' || (t.turn - 1) END AS next_token
FROM conversations t
LEFT JOIN conversations b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1"""
ORACLES["scraped_to_post"] = r"""
SELECT CAST(doc_id AS VARCHAR) AS post_id,
  CASE WHEN lang = 'de' AND length(trim(' quote of ' || doc_id)) > length(t)
    THEN trim(' quote of ' || doc_id) ELSE t END AS text,
  CASE WHEN lang = 'es' THEN 'und' ELSE lang END AS lang,
  '2026-01-15 10:00:00' AS created_at, source AS username, upper(source) AS display_name,
  lang = 'en' AS author_verified, n_chars AS reply_count,
  CAST(trunc(CAST(CAST(n_chars / 1000.0 AS DECIMAL(10,1)) AS DOUBLE) * 1000) AS BIGINT)
    AS repost_count,
  CAST(0 AS BIGINT) AS quote_count, n_chars * 1000 AS like_count,
  doc_id * 1000000 AS impression_count, 'https://t.example/' || doc_id AS urls,
  lang AS hashtags, source AS mentions,
  CASE WHEN lang = 'de' THEN '9' || doc_id ELSE '' END AS referenced_post_ids
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)"""
# Article text of a page: markup off, character references resolved, all links inside it.
ORACLES["html_to_raw"] = r"""
WITH parts AS (
  SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body, html
  FROM pages
)
SELECT page_id, lang, trim(html_text) AS text, links
FROM (
  SELECT *, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(body,
    '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS html_text,
    coalesce(array_to_string(list_concat(
      regexp_extract_all(body, '<a [^>]*href="([^"]*)"', 1),
      list_filter(regexp_extract_all(html, '<a [^>]*href="(http[^"]*)"', 1),
        lambda h: NOT contains(h, 'x.com') AND NOT contains(h, 'twitter.com'))[1:1]), '|'), '')
      AS links
  FROM parts
)"""
ORACLES["html_timeline"] = """
SELECT doc_id, CAST(doc_id AS VARCHAR) AS post_id, '/' || source || '/status/' || doc_id || '?s=1' AS permalink,
  '2026-01-15T10:00:00.000Z' AS created_at, text || ' @' || source || ' #' || upper(lang) || ' link' AS text,
  lang, source AS username, upper(source) AS display_name, lang = 'en' AS verified,
  n_chars || ' Replies' AS reply_label, n_chars || ' Reposts' AS retweet_label, '' AS like_label,
  doc_id || 'M Views' AS impression_label,
  '/' || source || '|/hashtag/' || upper(lang) || '|https://t.example/' || doc_id
    || '|https://t.example/' || doc_id AS urls,
  upper(lang) AS hashtags, source AS mentions,
  CASE WHEN lang = 'de' THEN '9' || doc_id ELSE '' END AS quoted_post_id,
  CASE WHEN lang = 'de' THEN 'q body' ELSE '' END AS quoted_text
FROM documents"""
ORACLES["delete_events"] = """
SELECT DISTINCT CAST(doc_id AS VARCHAR) AS post_id FROM labels WHERE toxic = 1"""
ORACLES["id_export"] = CURRENT + """
SELECT DISTINCT post_id FROM cur WHERE source_type = 'x_home'"""
ORACLES["queue_batch"] = f"""
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS source_id, props AS payload,
  {clock('ts')} AS available_at
FROM events WHERE ts <= {stamp(EVENTS_AS_OF)} ORDER BY event_id LIMIT 100"""
ORACLES["queue_stats"] = """
SELECT count(*) AS depth, CAST(coalesce(sum(strlen(props)), 0) AS BIGINT) AS bytes FROM events"""
ORACLES["queue_retry"] = f"""
SELECT event_id AS id, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS attempts,
  CASE WHEN event_type = 'error' THEN {clock(f"{stamp(EVENTS_AS_OF)} + INTERVAL 30 SECOND")}
    ELSE {clock('ts')} END AS available_at
FROM events WHERE event_type <> 'click'"""
ORACLES["enqueue_unique"] = """
SELECT CAST(user_id AS VARCHAR) AS source_id, min(event_id) AS id FROM events
WHERE ts >= TIMESTAMP '2024-01-02' AND user_id NOT IN
  (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02')
GROUP BY user_id"""
ORACLES["audit_append"] = """
SELECT 'collector_' || event_type AS event_type,
  '{"fetched":' || count(*) || ',"enqueued":' || count(DISTINCT user_id) || '}' AS detail,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS created_at
FROM events GROUP BY event_type, CAST(ts AS DATE)"""
ORACLES["kv_latest"] = """
SELECT user_id AS key, props AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""

# --- projections ---------------------------------------------------------------------------------

SOURCE_URL = """CASE WHEN source_type = 'x_home'
  THEN 'https://x.com/i/web/status/' || post_id END AS source_url"""
ORACLES["recent_posts"] = POSTS + f"""
SELECT post_id, text, username, display_name, lang, {clock('created_at')} AS created_at,
  {clock('ingested_at')} AS ingested_at, cti_score, cti_level, {lists('cti_categories')},
  {SOURCE_URL}
FROM posts ORDER BY posts.ingested_at DESC, post_id DESC LIMIT 50"""
ORACLES["result_shape"] = POSTS + f"""
SELECT post_id, {clock('created_at')} AS created_at, cti_score, cti_scoring_mode AS scoring_mode,
  '' AS model_revision, {SOURCE_URL}, {joined('ioc_domains')} AS domains,
  {joined('ioc_cves')} AS cves, like_count AS likes, impression_count AS impressions,
  CAST(0 AS BIGINT) AS highlight_count
FROM posts"""
ORACLES["flatten_record"] = POSTS + f"""
SELECT post_id, {DAY}, cti_score, cti_level, cti_rule_score,
  CAST(-1 AS DOUBLE) AS cti_semantic_score, cti_scoring_mode, '' AS model_revision,
  {lists('cti_reasons', 'ioc_md5', 'ioc_filenames')}
FROM posts"""
ALL_LISTS = "flatten([" + ", ".join(IOC) + "])"
ORACLES["indicator_preview"] = EXTRACTED + f"""
SELECT post_id, {DAY}, {joined(f'({ALL_LISTS})[1:10]')} AS preview,
  {joined(f'({ALL_LISTS})[1:4]')} AS compact
FROM ext"""
ORACLES["indicator_total"] = EXTRACTED + f"""
SELECT post_id, {DAY}, CAST(len({ALL_LISTS}) AS BIGINT) AS total FROM ext"""

# --- search --------------------------------------------------------------------------------------

TOKENS = r"list_filter(regexp_split_to_array(norm, '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')," \
    " lambda t: t <> '')"
RESULT = f"post_id, {clock('created_at')} AS created_at, cti_score, username, lang"


def any_of(*tokens: str) -> str:
    return f"list_has_any({TOKENS}, {listed(tokens)})"


def matching(condition: str, tail: str = "") -> str:
    return POSTS + f"SELECT {RESULT} FROM posts WHERE {condition} {tail}"


TOPIC = any_of(*split_terms(ANY_TOPIC))
ORACLES["search_all"] = matching(
    f"list_has_all({TOKENS}, ['cve', '2031', '10001', 'exploit'])"
)
ORACLES["search_any"] = matching(any_of("meetup", "phishing"))
ORACLES["search_current"] = ORACLES["search_any"]
ORACLES["search_phrase"] = matching(
    f"contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' sunny day at ')"
)
for _mode in ("all", "any", "phrase"):
    ORACLES[f"indexed_{_mode}"] = ORACLES[f"search_{_mode}"]
ORACLES["filter_dates"] = matching(
    f"{TOPIC} AND created_at >= TIMESTAMP '2026-01-05 06:00:00'"
    " AND created_at <= TIMESTAMP '2026-01-12 23:59:59'"
)
ORACLES["filter_lang"] = matching(f"{TOPIC} AND lang = 'de'")
ORACLES["filter_min_score"] = matching(f"{TOPIC} AND cti_score >= 30")
ORACLES["filter_level"] = matching(f"{TOPIC} AND cti_level = 'medium'")
ORACLES["filter_category"] = matching(f"{TOPIC} AND list_contains(cti_categories, 'phishing')")
ORACLES["filter_author"] = matching(f"{TOPIC} AND username = 'user_src3'")
for _kind, _names in {
    "ip": ("ipv4", "ipv6"), "domain": ("domains",), "url": ("urls",),
    "hash": ("md5", "sha1", "sha256", "sha512"), "cve": ("cves",),
    "attack": ("attack_techniques",),
}.items():
    ORACLES[f"filter_ioc_{_kind}"] = matching(f"{TOPIC} AND {lengths(*_names)} > 0")
NEWEST = "posts.created_at DESC, post_id DESC"
BEST = f"cti_score DESC, {NEWEST}"
KEY = f"{stamp(PAGE_KEY.created_at)}, '{PAGE_KEY.post_id}'"
ORACLES["search_newest"] = matching(TOPIC, f"ORDER BY {NEWEST} LIMIT 51")
ORACLES["search_relevance"] = matching(TOPIC, f"ORDER BY {BEST} LIMIT 51")
ORACLES["search_page1"] = matching(TOPIC, f"ORDER BY {BEST} LIMIT 101")
ORACLES["search_walk"] = f"""
SELECT (place - 1) // 7 AS page, (place - 1) % 7 AS place, post_id, cti_score, true AS marked
FROM (
  SELECT *, row_number() OVER (ORDER BY cti_score DESC, created_at DESC, post_id DESC) AS place
  FROM ({matching(any_of("meetup", "phishing"), f"ORDER BY {BEST} LIMIT 21")})
)"""
ORACLES["search_page2_score"] = matching(
    f"{TOPIC} AND (cti_score, posts.created_at, post_id) < ({PAGE_KEY.score}, {KEY})",
    f"ORDER BY {BEST} LIMIT 51",
)
ORACLES["search_page2_newest"] = matching(
    f"{TOPIC} AND (posts.created_at, post_id) < ({KEY})", f"ORDER BY {NEWEST} LIMIT 51"
)
ORACLES["get_post"] = POSTS + f"""
SELECT post_id, {clock('created_at')} AS created_at, cti_score, text FROM posts
WHERE post_id = (SELECT post_id FROM posts ORDER BY {NEWEST} LIMIT 1)
ORDER BY content_version DESC, day DESC LIMIT 1"""
ORACLES["top_scored"] = matching(
    f"cti_score >= {LOW_THRESHOLDS.high}", f"ORDER BY {BEST} LIMIT 20"
)

# --- rejects and lookups -------------------------------------------------------------------------

PAYLOADS = f"""
labelled AS (
  SELECT d.*, coalesce(toxic, 0) = 1 AS is_toxic, coalesce(quality, 1) = 0 AS is_poor
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
reasons AS (
  SELECT *, CASE WHEN is_poor AND NOT is_toxic THEN 'missing_id'
    WHEN is_toxic THEN 'protected_author' END AS reason
  FROM labelled
),
cur AS (
  SELECT 'x_home' AS source_type, CAST(doc_id AS VARCHAR) AS post_id, source AS author_id,
    text || ' ' || ({listed(SENTENCES)})[CAST(doc_id % 6 AS INT) + 1] AS text, lang,
    {stamp(START)} + to_minutes((doc_id * 37) % {CYCLE_MINUTES}) AS created_at,
    {stamp(AS_OF)} AS ingested_at, 'user_' || source AS username,
    upper(source) AS display_name, n_chars % 500 AS like_count, n_chars AS impression_count,
    CASE WHEN lang = 'en' THEN 'https://long.example/' ELSE 'https://t.example/' END || doc_id
      AS urls,
    lang AS hashtags, source AS mentions, 'q' || doc_id AS referenced_post_ids,
    CAST(1 AS BIGINT) AS content_version
  FROM reasons WHERE reason IS NULL
)"""
ORACLES["reject_protected"] = f"""WITH {PAYLOADS}
SELECT CAST(doc_id AS VARCHAR) AS conversation_id, reason FROM reasons
WHERE reason = 'protected_author'"""
ORACLES["reject_incomplete"] = f"""WITH {PAYLOADS}
SELECT CAST(doc_id AS VARCHAR) AS conversation_id, reason FROM reasons
WHERE reason = 'missing_id'"""
ORACLES["quarantine"] = f"""WITH {PAYLOADS}
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS payloads FROM reasons GROUP BY 1"""
ORACLES["flatten_entities"] = f"""WITH {PAYLOADS}
SELECT post_id, urls, hashtags, mentions, referenced_post_ids, like_count,
  CAST(0 AS BIGINT) AS reply_count, impression_count FROM cur"""
PREPARED = f"""
SELECT source_type, post_id, author_id, text, lang, {clock('created_at')} AS created_at,
  {clock('ingested_at')} AS ingested_at, username, display_name, like_count, urls, hashtags,
  mentions, referenced_post_ids, content_version, cti_score, cti_level,
  {lists('cti_categories', 'ioc_domains', 'ioc_ipv4')}, '' AS model_revision,
  CAST(CAST(posts.created_at AS DATE) AS VARCHAR) AS day
FROM posts"""
ORACLES["prepare_posts"] = f"WITH {PAYLOADS},{extraction('cur')},{scoring()}" + PREPARED
ORACLES["stream_enrich"] = ORACLES["prepare_posts"]
ORACLES["author_latest"] = """
SELECT CAST(s_nationkey AS VARCHAR) AS id, s_name AS username, round(s_acctbal, 2) AS balance
FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) = 1"""
ORACLES["page_authors"] = """
SELECT role AS id, '@' || role AS username,
  CASE WHEN role = 'user' THEN 'page ' || max(conv_id * 100000 + turn)
    ELSE upper(left(role, 1)) || substr(role, 2) END AS name
FROM conversations GROUP BY role"""
ORACLES["author_join"] = f"""
WITH latest AS ({ORACLES['author_latest']})
SELECT CAST(c_custkey AS VARCHAR) AS post_id, CAST(c_nationkey AS VARCHAR) AS author_id,
  CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE latest.username END AS username,
  CASE WHEN s_suppkey IS NOT NULL THEN round(s_acctbal, 2) ELSE latest.balance END AS balance
FROM customer
LEFT JOIN latest ON latest.id = CAST(c_nationkey AS VARCHAR)
LEFT JOIN supplier ON s_suppkey = c_custkey"""
ORACLES["stream_authors"] = ORACLES["author_join"]
ORACLES["expand_referenced"] = """
SELECT t.conv_id || '-' || t.turn AS post_id,
  CASE WHEN length(coalesce(q.text, '')) >= length(coalesce(r.text, ''))
        AND length(q.text) > length(t.text) THEN q.text
    WHEN length(r.text) > length(t.text) AND length(r.text) > length(coalesce(q.text, ''))
      THEN r.text
    ELSE t.text END AS text
FROM conversations t
LEFT JOIN conversations q ON q.conv_id = t.conv_id AND q.turn = t.turn - 1
LEFT JOIN conversations r ON r.conv_id = t.conv_id AND r.turn = t.turn - 2"""
ORACLES["unseen_anti_join"] = """
SELECT CAST(doc_id AS VARCHAR) AS post_id, lang FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
ORACLES["trusted_flag"] = """
SELECT doc_id, '@@User_' || source AS username, source IN ('src1', 'src2') AS trusted
FROM documents"""

# --- statistics ----------------------------------------------------------------------------------

ORACLES["stats_overview"] = POSTS + f"""
SELECT count(*) AS total, count(*) FILTER (cti_score >= {LOW_THRESHOLDS.high}) AS high,
  count(*) FILTER (cti_score >= {LOW_THRESHOLDS.critical}) AS critical,
  {clock('max(ingested_at)')} AS latest
FROM posts"""
LAST_DAYS = f"created_at >= {stamp(AS_OF)} - INTERVAL 30 DAY"
TIMELINE = f"""
SELECT {DAY}, count(*) AS posts FROM cur WHERE {LAST_DAYS} GROUP BY cur.day"""
ORACLES["stats_timeline"] = CURRENT + TIMELINE
ORACLES["chart_share"] = CURRENT + f"""
SELECT day, posts, round(greatest(4.0::DOUBLE, posts / greatest(1, max(posts) OVER ())::DOUBLE
  * 100), 6) AS share
FROM ({TIMELINE})"""
ORACLES["stats_categories"] = POSTS + f"""
SELECT category, count(*) AS posts
FROM (SELECT unnest(cti_categories) AS category FROM posts WHERE {LAST_DAYS})
GROUP BY category ORDER BY posts DESC, category LIMIT 8"""
ORACLES["stats_iocs"] = POSTS + f"""
SELECT CAST(coalesce(sum({NETWORK}), 0) AS BIGINT) AS network,
  CAST(coalesce(sum({HASHES}), 0) AS BIGINT) AS hashes,
  CAST(coalesce(sum({lengths('cves', 'attack_techniques')}), 0) AS BIGINT) AS cve_attack
FROM posts"""
ORACLES["overview"] = POSTS + f"""
SELECT count(*) AS total, count(*) FILTER (cti_score >= {LOW_THRESHOLDS.high}) AS high,
  count(*) FILTER (cti_score >= {LOW_THRESHOLDS.critical}) AS critical,
  {clock('max(ingested_at)')} AS latest,
  CAST(coalesce(sum({NETWORK}), 0) AS BIGINT) AS network,
  CAST(coalesce(sum({HASHES}), 0) AS BIGINT) AS hashes,
  CAST(coalesce(sum({lengths('cves', 'attack_techniques')}), 0) AS BIGINT) AS cve_attack
FROM posts"""
ORACLES["overview_settled"] = f"SELECT *, true AS settled FROM ({ORACLES['overview']})"
LEVELS = f"SELECT {DAY}, cti_level, count(*) AS posts FROM posts GROUP BY posts.day, cti_level"
ORACLES["daily_levels_raw"] = VERSIONS + LEVELS
ORACLES["daily_levels_current"] = POSTS + LEVELS
ORACLES["stream_daily_levels"] = ORACLES["daily_levels_raw"]
ORACLES["stream_daily_current"] = ORACLES["daily_levels_current"]
ORACLES["overview_incremental"] = ORACLES["overview"] + """
WHERE post_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"""
ORACLES["distinct_ids"] = ORACLES["id_export"]
ORACLES["daily_usage"] = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS post_reads FROM events GROUP BY 1"""
ORACLES["usage_today"] = """
SELECT count(*) AS post_reads FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'"""
ORACLES["cycle_metrics"] = """
WITH reads AS (
  SELECT *, CAST(ts AS DATE) AS day, CAST(hour(ts) AS BIGINT) AS hour,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS is_first
  FROM events
),
runs AS (
  SELECT day, hour, count(*) AS fetched, count(*) FILTER (is_first) AS enqueued
  FROM reads GROUP BY day, hour
)
SELECT CAST(day AS VARCHAR) AS day, hour, fetched, enqueued,
  CAST(sum(fetched) OVER (PARTITION BY runs.day ORDER BY hour) AS BIGINT) AS daily_reads
FROM runs"""
ORACLES["ingest_status"] = f"""
WITH latest AS (SELECT event_type, max(ts) AS moment FROM events GROUP BY event_type),
s AS (
  SELECT (SELECT count(*) FROM events) AS queue_depth,
    (SELECT CAST(sum(strlen(props)) AS BIGINT) FROM events) AS queue_bytes,
    (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = DATE '{EVENTS_AS_OF:%Y-%m-%d}')
      AS daily_post_reads,
    (SELECT moment FROM latest WHERE event_type = 'click') AS success,
    (SELECT moment FROM latest WHERE event_type = 'view') AS compliance
)
SELECT queue_depth, queue_bytes, daily_post_reads, {clock('success')} AS last_success,
  {clock('compliance')} AS last_compliance_success, CAST(NULL AS VARCHAR) AS last_error,
  'hybrid' AS scoring_mode,
  date_trunc('second', compliance) < {stamp(EVENTS_AS_OF)} - INTERVAL 24 HOUR AS compliance_stale,
  date_trunc('second', compliance) < {stamp(EVENTS_AS_OF)} - INTERVAL 23 HOUR AS compliance_due,
  queue_depth < 1000 AS queue_ok, daily_post_reads < 10000 AS budget_ok,
  queue_bytes >= 536870912 AS queue_full,
  date_trunc('second', compliance) >= {stamp(EVENTS_AS_OF)} - INTERVAL 24 HOUR AS ready
FROM s"""
ORACLES["budget_cap"] = """
SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events
QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 100"""
ORACLES["budget_cap_default"] = """
SELECT count(*) AS kept, max(event_id) AS last, CAST(sum(event_id) AS BIGINT) AS ids
FROM (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 10000)"""
ORACLES["keep_last_per_id"] = """
WITH firsts AS (SELECT user_id, min(event_id) AS first_position FROM events GROUP BY user_id),
kept AS (SELECT * FROM firsts ORDER BY first_position LIMIT 100),
stop AS (SELECT CASE WHEN count(*) = 100 THEN max(first_position) END AS place FROM kept)
SELECT kept.user_id, first_position, e.event_id, e.event_type, e.props
FROM kept JOIN events e ON e.user_id = kept.user_id
WHERE e.event_id <= coalesce((SELECT place FROM stop), e.event_id)
QUALIFY row_number() OVER (PARTITION BY kept.user_id ORDER BY e.event_id DESC) = 1"""

# --- text ----------------------------------------------------------------------------------------

ORACLES["normalize"] = f"SELECT doc_id, {normalized('text')} AS normalized FROM documents"
ORACLES["refang"] = CURRENT + f"SELECT post_id, {DAY}, {refanged('text')} AS prepared FROM cur"
ORACLES["query_terms"] = f"""
SELECT conv_id, turn, {joined(f"list_filter(string_split({normalized('text')}, ' '),"
" lambda t: t <> '')")} AS terms
FROM conversations"""
ORACLES["tokenize"] = f"""
SELECT token, count(*) AS uses, min(doc_id) AS first_doc
FROM (SELECT doc_id, unnest({TOKENS}) AS token
  FROM (SELECT doc_id, {normalized('text')} AS norm FROM documents))
GROUP BY token"""


def term_hits(term: str) -> str:
    """Start positions (from 0) of non-overlapping hits of a term in the folded text."""
    pieces = f"string_split(folded, '{term}')"
    return (
        f"list_transform(range(1, len({pieces})), lambda i: CAST(list_sum(list_transform("
        f"({pieces})[1:i], lambda p: length(p))) AS BIGINT) + (i - 1) * {len(term)})"
    )


def span(at: str, size: int) -> str:
    """Range in the source: a sharp s became two letters, the second one marked by chr(1)."""

    def source(position: str) -> str:
        upto = f"left(marked, CAST({position} + 1 AS BIGINT))"
        return f"({position} - (length({upto}) - length(replace({upto}, chr(1), ''))))"

    return f"{{'s': {source(at)}, 'e': {source(f'({at} + {size - 1})')} + 1}}"


def highlight_hits(first: str, second: str) -> str:
    """CTEs with at most twenty ranges per document, the first term's before the second's."""
    return f"""folds AS (
  SELECT doc_id, replace(lower(text), 'ß', 'ss') AS folded,
    replace(lower(text), 'ß', 's' || chr(1)) AS marked
  FROM documents
),
hits AS (
  SELECT doc_id, list_concat(
    list_transform({term_hits(first)}, lambda pos: {span('pos', len(first))}),
    list_transform({term_hits(second)}, lambda pos: {span('pos', len(second))}))[1:20] AS spans
  FROM folds
)"""


ORACLES["highlights"] = f"""
WITH {highlight_hits('the', 'rt')}
SELECT doc_id, {joined("list_transform(list_sort(spans), lambda x: x.s || '-' || x.e)")} AS spans
FROM hits"""
ORACLES["merge_highlights"] = f"""
WITH {highlight_hits('the', 'he')},
spans AS (SELECT doc_id, unnest(spans, recursive := true) FROM hits),
edges AS (
  SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM spans
),
islands AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
  FROM edges
),
merged AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, island)
SELECT d.doc_id, coalesce(string_agg(s || '-' || e, '|' ORDER BY s), '') AS merged
FROM documents d LEFT JOIN merged m ON m.doc_id = d.doc_id GROUP BY d.doc_id"""

# --- indicators and scores -----------------------------------------------------------------------


def extracted(*names: str) -> str:
    return EXTRACTED + f"SELECT post_id, {DAY}, {lists(*names)} FROM ext"


for _name, _columns in {
    "ioc_urls": ["ioc_urls"], "ioc_emails": ["ioc_emails"], "ioc_ipv4": ["ioc_ipv4"],
    "ioc_ipv6": ["ioc_ipv6"], "ioc_domains": ["ioc_domains"],
    "ioc_hashes": ["ioc_md5", "ioc_sha1", "ioc_sha256", "ioc_sha512"], "ioc_cves": ["ioc_cves"],
    "ioc_attack": ["ioc_attack_techniques"], "ioc_filenames": ["ioc_filenames"],
    "ioc_hashtags": ["ioc_hashtags"], "ioc_actors": ["ioc_threat_actors"],
    "extract_indicators": IOC,
}.items():
    ORACLES[_name] = extracted(*_columns)

for _name, _column, _out in (
    ("score_indicators", "p_ioc", "indicator_score"), ("score_cve", "p_ref", "reference_score"),
    ("score_context", "p_context", "context_score"), ("score_trust", "p_trust", "trust_score"),
    ("score_engagement", "p_engaged", "engagement_score"), ("score_rules", "rule", "rule_score"),
):
    ORACLES[_name] = POSTS + f"SELECT post_id, {DAY}, CAST({_column} AS BIGINT) AS {_out} FROM posts"

ORACLES["score_hybrid"] = HYBRID + f"""
SELECT post_id, {DAY}, cti_rule_score, cti_score, cti_scoring_mode,
  CASE WHEN sem IS NOT NULL THEN 'vectors-1' END AS model_revision, sem AS semantic
FROM posts"""
ORACLES["score_level"] = HYBRID + f"SELECT post_id, {DAY}, cti_score, cti_level FROM posts"
ORACLES["score_reasons"] = HYBRID + f"SELECT post_id, {DAY}, {lists('cti_reasons')} FROM posts"
ORACLES["score_categories"] = HYBRID + f"""
SELECT post_id, {DAY}, {lists('cti_categories')} FROM posts"""
ORACLES["assess_posts"] = HYBRID + f"""
SELECT post_id, {DAY}, cti_score, cti_level, cti_rule_score, cti_scoring_mode,
  {lists('cti_categories', 'cti_reasons')}, 'rules-1.0.0' AS scorer_version, {lists(*IOC)}
FROM posts"""

# --- raw records ---------------------------------------------------------------------------------

ORACLES["parse_metric"] = r"""
WITH labelled AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
    CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2
      WHEN l_linestatus = 'O' THEN 3 ELSE 4 END AS kind
  FROM lineitem
)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CASE kind WHEN 1 THEN q || ',250 Replies' WHEN 2 THEN price || 'K Reposts'
    WHEN 3 THEN q || ' Bookmarks' ELSE q || ' m views' END AS label,
  CAST(CASE kind WHEN 1 THEN q * 1000 + 250 WHEN 2 THEN trunc(CAST(price AS DOUBLE) * 1000)
    WHEN 3 THEN q ELSE q * 1000000 END AS BIGINT) AS value
FROM labelled"""
ORACLES["extract_post_id"] = """
SELECT doc_id, CASE lang WHEN 'en' THEN CAST(doc_id AS VARCHAR) WHEN 'es' THEN NULL
  ELSE '7' || doc_id END AS post_id
FROM documents"""
ORACLES["parse_ts"] = f"""
SELECT event_id, {clock('''CASE event_type WHEN 'error' THEN NULL
  WHEN 'view' THEN date_trunc('second', ts) - INTERVAL 2 HOUR
  ELSE date_trunc('second', ts) END''')} AS at
FROM events"""
ORACLES["staleness"] = f"""
SELECT event_id,
  event_type = 'error' OR date_trunc('second', ts) < {stamp(EVENTS_AS_OF)} - INTERVAL 24 HOUR
    AS stale,
  event_type = 'error' OR date_trunc('second', ts) < {stamp(EVENTS_AS_OF)} - INTERVAL 23 HOUR
    AS due
FROM events"""

# --- vectors -------------------------------------------------------------------------------------

ORACLES["cosine"] = f"""WITH {VECTORS}
SELECT e.vec_id, round(similarity, 6) AS cosine
FROM embeddings e JOIN sims s ON s.vec_id = e.vec_id AND s.category = 'label_' || e.label"""
ORACLES["semantic_score"] = f"WITH {VECTORS} SELECT vec_id, sem AS semantic_score FROM sem_rows"
ORACLES["semantic_match"] = f"""WITH {VECTORS}
SELECT vec_id, {joined('sem_categories')} AS categories FROM sem_rows"""
ORACLES["mean_pool"] = """
WITH parts AS (
  SELECT label, unnest(range(64)) AS dim,
    unnest(CAST(embedding AS DOUBLE[])) * CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS value,
    CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS mask
  FROM embeddings
),
means AS (
  SELECT label, dim, sum(value) / greatest(sum(mask), 1e-9) AS mean FROM parts GROUP BY label, dim
)
SELECT CAST(label AS BIGINT) AS label, CAST(dim AS BIGINT) AS dim,
  round(mean / greatest(sqrt(sum(mean * mean) OVER (PARTITION BY means.label)), 1e-9), 6) AS value
FROM means"""

# --- incremental and streaming -------------------------------------------------------------------

ORACLES["seen_retention"] = f"""
SELECT user_id AS post_id, {clock('min(ts)')} AS seen_at FROM events GROUP BY user_id
HAVING min(ts) >= {stamp(SEEN_AS_OF)} - INTERVAL 30 DAY"""
ORACLES["since_id"] = f"""
WITH marks AS (
  SELECT event_type, max(event_id) AS mark FROM events WHERE ts < {stamp(EVENTS_AS_OF)}
  GROUP BY event_type
)
SELECT m.event_type, greatest(any_value(m.mark), max(e.event_id)) AS mark, count(*) AS fetched
FROM marks m JOIN events e ON e.event_type = m.event_type AND e.event_id > m.mark
GROUP BY m.event_type"""
ORACLES["admission"] = f"""
WITH RECURSIVE ordered AS (
  SELECT user_id, event_id, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events
),
walk AS (
  SELECT user_id, event_id, n, true AS admitted, [us] AS times FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.n,
    len(list_filter(w.times, lambda t: t >= o.us - {ADMISSION_SECONDS * 1_000_000}))
      < {ADMISSION_LIMIT} AS admitted,
    CASE WHEN len(list_filter(w.times, lambda t: t >= o.us - {ADMISSION_SECONDS * 1_000_000}))
        < {ADMISSION_LIMIT}
      THEN list_append(
        list_filter(w.times, lambda t: t >= o.us - {ADMISSION_SECONDS * 1_000_000}), o.us)
      ELSE list_filter(w.times, lambda t: t >= o.us - {ADMISSION_SECONDS * 1_000_000})
    END AS times
  FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.n = w.n + 1
)
SELECT user_id, event_id, admitted FROM walk"""
ORACLES["stream_admission"] = ORACLES["admission"]
# A silence longer than the limit empties the list of accepted times.
IDLE = "CASE WHEN o.us - w.us > " + str(IDLE_SECONDS * 1_000_000) + " THEN [] ELSE w.times END"
ORACLES["stream_admission_idle"] = (
    ORACLES["admission"].replace("list_filter(w.times", f"list_filter({IDLE}")
    .replace("[us] AS times FROM ordered", "[us] AS times, us FROM ordered")
    .replace("END AS times\n  FROM walk", "END AS times, o.us\n  FROM walk")
    .replace("\n    END AS times\n", "\n    END AS times, o.us\n"))
# Four batches of events, the last days of the month first.
BATCHES = """
WITH event AS (
  SELECT *, CAST(coalesce(floor((31 - day(ts)) / 8), 3) AS INT) AS batch FROM events
)"""
ORACLES["stream_dedupe"] = BATCHES + """
SELECT CAST(user_id AS VARCHAR) AS source_id, min(event_id) AS id FROM event
GROUP BY user_id, batch QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY batch) = 1"""
ORACLES["stream_seen"] = BATCHES + f"""
SELECT user_id AS post_id, {clock('min(ts)')} AS seen_at FROM event
GROUP BY user_id, batch QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY batch) = 1"""
ORACLES["cycle_observed"] = BATCHES + """, first AS (
  SELECT user_id, min(batch) AS batch FROM event GROUP BY user_id
)
SELECT 'collector_cycle' AS event_type,
  '{"fetched":' || count(*) || ',"enqueued":' || (SELECT count(*) FROM first WHERE first.batch = event.batch)
    || '}' AS detail, CAST(batch AS VARCHAR) AS created_at
FROM event GROUP BY batch
UNION ALL
SELECT 'collector_total', '{"reads":' || count(*) || ',"days":' || count(DISTINCT CAST(ts AS DATE)) || '}', '4'
FROM event"""
RETRY_DELAY = SETTINGS.retry_delay_seconds
ORACLES["stream_retry"] = f"""
WITH clock AS (
  SELECT greatest(max(ts), max(ts) FILTER (event_type = 'error') + INTERVAL 1 MINUTE) AS newest FROM events
)
SELECT CAST(event_id AS VARCHAR) AS source_id, event_id AS id, CAST(0 AS BIGINT) AS attempts,
  {clock('ts')} AS available_at FROM events
UNION ALL
SELECT CAST(event_id AS VARCHAR), event_id, 1,
  strftime(ts + INTERVAL {60 + RETRY_DELAY} SECOND, '%Y-%m-%d %H:%M:%S') FROM events, clock
WHERE event_type = 'error' AND ts + INTERVAL {60 + RETRY_DELAY} SECOND <= newest"""
# Per user the first arrival of each batch; it is queued if nothing is open or that was a purchase.
ORACLES["stream_requeue"] = BATCHES + """, arrival AS (
  SELECT user_id, batch, min(event_id) AS id, min_by(event_type, event_id) AS kind
  FROM event GROUP BY user_id, batch
), wide AS (
  SELECT user_id, """ + ", ".join(
    f"max(id) FILTER (batch = {n}) AS id{n}, coalesce(max(kind) FILTER (batch = {n}), '') AS kind{n}"
    for n in range(4)) + """
  FROM arrival GROUP BY user_id
), state0 AS (SELECT *, id0 AS open0, kind0 AS open_kind0 FROM wide)""" + "".join(f""",
state{n} AS (
  SELECT *, open{n - 1} IS NULL OR open_kind{n - 1} = 'purchase' AS free{n},
    CASE WHEN open{n - 1} IS NULL OR open_kind{n - 1} = 'purchase' THEN id{n} ELSE open{n - 1} END
      AS open{n},
    CASE WHEN open{n - 1} IS NULL OR open_kind{n - 1} = 'purchase' THEN kind{n}
      ELSE open_kind{n - 1} END AS open_kind{n}
  FROM state{n - 1}
)""" for n in range(1, 4)) + """
SELECT CAST(user_id AS VARCHAR) AS source_id, id FROM (
  SELECT user_id, id0 AS id FROM state3""" + "".join(f"""
  UNION ALL SELECT user_id, id{n} FROM state3 WHERE free{n}""" for n in range(1, 4)) + """
) WHERE id IS NOT NULL"""
