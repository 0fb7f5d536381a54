"""SQL counterparts of the registered queries, written for DuckDB over the same tables.

Where SQL allows, the SQL takes another road than the Spark code: list functions for sums, string positions for
the gazetteer, plain row numbers for bounded ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from siren import lexicons as L
from siren.plans.relations import PLACES, TEMPLATES
from siren.schemas import ENRICHED_COLUMNS, RAW_COLUMNS
from siren.sources.synthetic import TEMPLATES as SYNTHETIC

ORACLES: dict[str, str] = {}

SP = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
WD = r"\p{L}\p{N}_"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: Sequence[Sequence[object]]) -> str:
    return ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def word_list(words: Sequence[str]) -> str:
    return "[" + ", ".join(lit(word) for word in words) + "]"


def hits(text: str, words: Sequence[str]) -> str:
    return f"len(list_filter({word_list(words)}, lambda w: strpos({text}, w) > 0))"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{SP}]+', ' ', 'g'))"


def strip_space(text: str) -> str:
    return f"regexp_replace({text}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def clean(text: str) -> str:
    sql = f"lower(coalesce({text}, ''))"
    sql = f"regexp_replace({sql}, 'http[^{SP}]+|www[^{SP}]+|https[^{SP}]+', '', 'g')"
    sql = f"regexp_replace({sql}, '@[{WD}]+', '', 'g')"
    sql = f"replace({squeeze(sql)}, '#', '')"
    sql = rf"regexp_replace({sql}, '[^\x00-\x7F]+', ' ', 'g')"
    sql = f"regexp_replace({sql}, '!!+', '!', 'g')"
    sql = rf"regexp_replace({sql}, '\?\?+', '?', 'g')"
    return f"trim({sql})"


def strip_tags(text: str) -> str:
    return squeeze(f"regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g')")


def tags(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '#([{WD}]+)', 1)"


def keyword_score(text: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    return f"CAST(least(8 * {hits(low, L.URGENT_WORDS)} + 3 * {hits(low, L.MEDIUM_WORDS)}, 100) AS DOUBLE)"


def keyword_part(text: str) -> str:
    return f"CAST(least(8 * {hits(text, L.BLEND_WORDS)}, 100) AS DOUBLE)"


def short_id(text: str) -> str:
    return f"substr(md5({text}), 1, 16)"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S+00:00')"


def city_state(text: str) -> str:
    pattern = f"(?:^|[^{WD}])([A-Z][a-zA-Z{SP}]{{2,20}}),[{SP}]*([A-Z]{{2}}|[A-Z][a-z]+)(?:$|[^{WD}])"
    first, second = (f"regexp_extract({text}, '{pattern}', {group})" for group in (1, 2))
    return f"CASE WHEN {first} <> '' THEN {first} || ', ' || {second} END"


def normal(place: str) -> str:
    stripped = strip_space(place)
    ascii_only = strip_space(rf"regexp_replace({stripped}, '[^\x00-\x7F]+', '', 'g')")
    return (
        f"CASE WHEN lower({stripped}) NOT IN ({', '.join(map(lit, L.LOCATION_NOISE))}) "
        f"AND length({ascii_only}) >= 2 THEN {ascii_only} END"
    )


SUFFIXES = "|".join(L.HAZARD_SUFFIXES)


def tag_place(tag_list: str) -> str:
    per_tag = (
        f"coalesce(nullif(regexp_extract(t, '^([A-Z][a-z]+(?:[A-Z][a-z]+)?)(?:{SUFFIXES})$', 1), ''), "
        "CASE WHEN regexp_matches(t, '^[A-Z][a-z]{2,14}$') THEN t END)"
    )
    return f"list_filter(list_transform({tag_list}, lambda t: {per_tag}), lambda p: p IS NOT NULL)[1]"


def words_of(text: str) -> str:
    """A text as its words between single spaces."""
    return f"' ' || array_to_string(regexp_extract_all(lower(coalesce({text}, '')), '[{WD}]+'), ' ') || ' '"


def listed_place(text: str) -> str:
    """Earliest listed place of a text, longest first among those that start together."""
    return (
        f"(SELECT arg_min(p.display, [strpos({words_of(text)}, ' ' || p.place || ' '), -length(p.place)]) "
        f"FROM places p WHERE strpos({words_of(text)}, ' ' || p.place || ' ') > 0)"
    )


def confidence(source: str) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in L.LOCATION_CONFIDENCE.items())
    return f"CASE {source} {cases} END"


def priority(urgency: str, source: str) -> str:
    return (
        f"CASE WHEN {urgency} > 70 AND {source} = 'tweet' THEN 'HIGHEST' "
        f"WHEN {urgency} > 70 AND {source} IN ('hashtag', 'profile_location') THEN 'HIGH' "
        f"WHEN {urgency} > 70 AND {source} = 'bio' THEN 'MEDIUM' "
        f"WHEN {urgency} > 70 AND {source} = 'none' THEN 'CRITICAL_REVIEW' "
        f"WHEN {urgency} > 40 THEN 'MEDIUM' ELSE 'LOW' END"
    )


# -- relations ------------------------------------------------------------------------------------------

REPORTS = f"""
templates(tpl_id, content, user_bio, user_location) AS (
  VALUES {values([(i, *row) for i, row in enumerate(TEMPLATES)])}
),
places(place, display, lat, lon) AS (VALUES {values(PLACES)}),
reports AS (
  SELECT {short_id('CAST(event_id AS VARCHAR)')} AS tweet_id, ts AS event_ts, {iso('ts')} AS date,
         content, 'user_' || user_id AS username, user_bio, user_location,
         CAST(floor(value) AS BIGINT) AS like_count, user_id AS retweet_count, event_type AS query_used,
         CAST(event_id % 4 AS INTEGER) AS source_rank
  FROM events JOIN templates ON event_id % {len(TEMPLATES)} = tpl_id
)"""

# The word rules depend on the text alone, so each distinct text is judged once.
JUDGED = f"""
cleaned AS (SELECT DISTINCT text, {clean('text')} AS clean_text FROM judged_texts),
counted AS (
  SELECT text, clean_text, {hits('clean_text', L.HELP_WORDS)} AS u, {hits('clean_text', L.DAMAGE_WORDS)} AS d,
         {hits('clean_text', L.INFORMATION_WORDS)} AS i, {keyword_part('clean_text')} AS k
  FROM cleaned
),
labelled AS (
  SELECT *, CASE WHEN u > 0 AND u >= d AND u >= i THEN 'Help Request'
                 WHEN d > 0 AND d > i THEN 'Damage Report' ELSE 'Information' END AS category
  FROM counted
),
judged AS (
  SELECT *, round(0.8 * 100 * CAST(p AS DOUBLE) + 0.2 * k, 2) AS urgency_score FROM (
    SELECT *, CASE category WHEN 'Help Request' THEN least(0.3 + 0.12 * u, 0.95)
                            WHEN 'Damage Report' THEN 0.1 ELSE 0.05 END AS p
    FROM labelled)
)"""


def cascade(gazetteer: bool) -> str:
    in_text = f"coalesce({normal('text_place')}, {normal('text_pattern')})" if gazetteer else normal("text_pattern")
    in_bio = normal("coalesce(bio_place, bio_pattern)") if gazetteer else normal("bio_pattern")
    text_place = listed_place("t.content") if gazetteer else "NULL"
    bio_place = listed_place("t.user_bio") if gazetteer else "NULL"
    return f"""
candidates AS (
  SELECT content, user_bio, user_location, {in_text} AS c1, {normal('tag')} AS c2, {normal('user_location')} AS c3, {in_bio} AS c4
  FROM (SELECT t.*, {text_place} AS text_place, {bio_place} AS bio_place,
               {city_state('t.content')} AS text_pattern, {city_state('t.user_bio')} AS bio_pattern,
               {tag_place(tags('t.content'))} AS tag
        FROM (SELECT DISTINCT content, user_bio, user_location FROM templates) t)
),
located AS (
  SELECT content, user_bio, user_location, coalesce(c1, c2, c3, c4, 'unknown') AS location,
         CASE WHEN c1 IS NOT NULL THEN 'tweet' WHEN c2 IS NOT NULL THEN 'hashtag'
              WHEN c3 IS NOT NULL THEN 'profile_location' WHEN c4 IS NOT NULL THEN 'bio' ELSE 'none' END AS location_source
  FROM candidates
)"""


PAIR = rf"^(-?\d+\.?\d*),[{SP}]*(-?\d+\.?\d*)$"


def pair(text: str, group: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract({strip_space(text)}, '{PAIR}', {group}), '') AS DOUBLE)"


ENRICHED = f"""{REPORTS},
judged_texts AS (SELECT content AS text FROM reports),{JUDGED},{cascade(True)},
enriched AS (
  SELECT r.*, j.clean_text, j.category, j.urgency_score, j.p, l.location, l.location_source,
         {confidence('l.location_source')} AS location_confidence,
         {priority('j.urgency_score', 'l.location_source')} AS priority,
         coalesce({pair('l.location', 1)}, g.lat) AS lat, coalesce({pair('l.location', 2)}, g.lon) AS lon
  FROM reports r JOIN judged j ON r.content = j.text
  JOIN located l ON r.content = l.content AND r.user_bio = l.user_bio AND r.user_location = l.user_location
  LEFT JOIN places g ON lower(l.location) = g.place
)"""

TEXTS = f"""{REPORTS},
texts AS (
  SELECT 'd-' || doc_id AS text_key, text FROM documents
  UNION ALL SELECT 'p-' || page_id, html FROM pages
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 'b-' || item_id, text FROM benchmark
  UNION ALL SELECT 'r-' || tweet_id, content FROM reports
)"""

DOC_REPORTS = f"""
doc_reports AS (
  SELECT {short_id('lang || text')} AS tweet_id, text AS content, source AS username, '' AS user_bio,
         lang AS user_location, n_chars AS like_count, source AS query_used,
         CAST(substr(source, 4) AS INTEGER) AS source_rank, doc_id AS ordinal
  FROM documents
)"""


def over_texts(name: str, columns: str) -> None:
    ORACLES[name] = f"WITH {TEXTS} SELECT text_key, {columns} FROM texts"


def over_reports(name: str, sql: str) -> None:
    ORACLES[name] = f"WITH {REPORTS} {sql}"


def over_enriched(name: str, sql: str) -> None:
    ORACLES[name] = f"WITH {ENRICHED} {sql}"


def over_judged(name: str, columns: str) -> None:
    ORACLES[name] = (
        f"WITH {TEXTS}, judged_texts AS (SELECT text FROM texts),{JUDGED} "
        f"SELECT text_key, {columns} FROM texts JOIN judged USING (text)"
    )


# -- sources and sinks ----------------------------------------------------------------------------------

FEED_TIME = "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({0} AS BIGINT)))"
RAW_NUMBERS = "CAST(0 AS BIGINT) AS like_count, CAST(0 AS BIGINT) AS retweet_count"


def xml_text(column: str) -> str:
    return rf"regexp_replace({column}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g')"


FEED = f"""
feed AS (
  SELECT {short_id("'https://feeds.example/' || page_id || substr(body, 1, 30)")} AS tweet_id,
         {iso(FEED_TIME.format('page_id'))} AS date, body AS content,
         'desk_' || page_id AS username, '' AS user_bio, '' AS user_location, {RAW_NUMBERS},
         'site ' || split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1), '.', -1) AS query_used,
         CASE WHEN url LIKE 'https%' THEN 1 ELSE 2 END AS mirror_rank
  FROM (SELECT *, {strip_tags(xml_text('html'))} AS body FROM pages) WHERE length(body) >= 10
)"""
ORACLES["read_rss_reports"] = f"WITH {FEED} SELECT * FROM feed"
ORACLES["read_rss_documents"] = ORACLES["read_rss_reports"]
ORACLES["source_failover"] = f"""WITH {FEED} SELECT tweet_id, query_used, mirror_rank FROM feed f
WHERE mirror_rank = (SELECT min(mirror_rank) FROM feed g WHERE g.query_used = f.query_used)"""
for _name, _cap in (("cap_per_query", 20), ("cap_per_query_many", 1500)):
    over_reports(
        _name,
        "SELECT tweet_id, query_used, date FROM reports "
        f"QUALIFY row_number() OVER (PARTITION BY query_used ORDER BY event_ts DESC, tweet_id) <= {_cap}",
    )
ORACLES["read_alert_feed"] = f"""
SELECT {short_id("'https://alerts.example/' || doc_id")} AS tweet_id, {iso(FEED_TIME.format('doc_id'))} AS date,
       {strip_tags("'Alert ' || source || '. ' || " + xml_text('text'))} AS content,
       'GDACS_Alert' AS username, 'Global Disaster Alert and Coordination System (UN)' AS user_bio,
       CASE WHEN lang <> 'en' THEN '1' || substr(source, 4) || '.5,-2' || substr(source, 4) || '.25' ELSE '' END AS user_location,
       {RAW_NUMBERS}, 'gdacs_feed' AS query_used
FROM documents"""
ORACLES["read_situation_reports"] = f"""
SELECT {short_id("'Report  ' || doc_id || " + iso(FEED_TIME.format('doc_id')))} AS tweet_id, {iso(FEED_TIME.format('doc_id'))} AS date,
       {squeeze("'Report  ' || doc_id || '. ' || text")} AS content,
       CASE WHEN lang = 'fr' THEN 'ReliefWeb'
            ELSE substr('Office_of_' || source || '_and_the_coordination_unit', 1, 30) END AS username,
       'UN ReliefWeb disaster report' AS user_bio, CASE WHEN lang = 'es' THEN '' ELSE upper(lang) END AS user_location,
       {RAW_NUMBERS}, 'reliefweb_api' AS query_used
FROM documents WHERE lang <> 'de'"""
over_reports(
    "read_social_posts",
    """SELECT tweet_id, date, CASE WHEN source_rank <> 3 THEN content ELSE lower(content) END AS content,
       CASE WHEN source_rank <> 2 THEN username ELSE '' END AS username,
       CASE WHEN source_rank <> 2 THEN user_bio ELSE '' END AS user_bio,
       CASE WHEN source_rank <> 2 THEN user_location ELSE '' END AS user_location,
       CASE WHEN like_count > 2 THEN like_count ELSE 0 END AS like_count, retweet_count, query_used
FROM reports WHERE query_used <> 'error' AND event_ts >= TIMESTAMP '2024-01-17 00:00:00'""",
)
over_reports("read_raw_csv", f"SELECT {', '.join(RAW_COLUMNS)} FROM reports")
over_enriched("read_enriched_csv", f"SELECT {', '.join(ENRICHED_COLUMNS)} FROM enriched")
ORACLES["read_csv_line_breaks"] = "SELECT coalesce(text, '') AS content, doc_id AS like_count FROM documents"
ORACLES["read_legacy_csv"] = (
    "SELECT '2024-01-01' AS date, text AS content, source AS username, source AS user_bio, lang AS user_location FROM documents"
)
ORACLES["ensure_columns"] = "SELECT doc_id, text AS content, '' AS user_bio, '' AS user_location FROM documents"


def draw(purpose: str, low: int, high: int) -> str:
    digest = f"md5(event_id || '|42|{purpose}')"
    return f"(CAST('0x' || substr({digest}, 1, 8) AS BIGINT) % {high - low + 1} + {low})"


SYNTHETIC_ROWS = f"""
drafts(tpl, content, user_bio, user_location, query_used) AS (VALUES {values([(i, *row) for i, row in enumerate(SYNTHETIC)])}),
synthetic AS (
  SELECT 'synth_1717200000_' || event_id AS tweet_id, content, 'user_' || {draw('user', 100, 999)} AS username,
         user_bio, user_location, {draw('likes', 5, 5000)} AS like_count, {draw('retweets', 2, 2000)} AS retweet_count,
         query_used, {iso("TIMESTAMP '2024-06-01 00:00:00' - to_minutes(CAST(event_id * " + draw('step', 3, 15) + " AS BIGINT))")} AS date
  FROM events JOIN drafts ON tpl = {draw('template', 0, len(SYNTHETIC) - 1)}
)"""
ORACLES["synthetic_reports"] = f"WITH {SYNTHETIC_ROWS} SELECT * FROM synthetic"
ORACLES["source_fallback"] = f"""WITH {REPORTS}, {SYNTHETIC_ROWS}
SELECT 'full' AS feed, tweet_id, content FROM reports UNION ALL SELECT 'empty', tweet_id, content FROM synthetic"""
ORACLES["source_freshness"] = """
SELECT seen, age, fresh, (SELECT count(*) FROM events)::BIGINT AS n_rows
FROM (VALUES ('soon', '30m ago', true), ('today', '5h ago', false), ('next day', '30h ago', false)) v(seen, age, fresh)"""
ORACLES["write_raw"] = f"""WITH {DOC_REPORTS}
SELECT '' AS date, tweet_id, content, username, user_bio, user_location,
       CAST(like_count AS VARCHAR) AS like_count, '' AS retweet_count, query_used FROM doc_reports"""
over_enriched(
    "write_enriched",
    f"SELECT tweet_id, {', '.join(ENRICHED_COLUMNS)}, clean_text, {keyword_score('content')} AS keyword_score, "
    f"array_to_string({tags('content')}, ' ') AS hashtags_str, like_count, 'rule-based' AS model_mode FROM enriched",
)
over_enriched("write_enriched_again", "SELECT tweet_id, urgency_score, location, lat FROM enriched")
over_enriched(
    "write_enriched_by_day",
    "SELECT tweet_id, strftime(event_ts, '%Y-%m-%d') AS event_date, urgency_score FROM enriched",
)
over_enriched(
    "to_json_records",
    "SELECT CAST(to_json({'tweet_id': tweet_id, 'content': content, 'urgency_score': urgency_score, "
    "'location': location, 'lat': lat}) AS VARCHAR) AS record FROM enriched",
)

# -- union, dedup, relevance ------------------------------------------------------------------------------

ORACLES["union_sources"] = f"""WITH {REPORTS}, {DOC_REPORTS}
SELECT tweet_id, content, query_used, CAST(0 AS INTEGER) AS source_rank FROM reports WHERE query_used IN ('view', 'click')
UNION ALL SELECT tweet_id, content, query_used, 1 FROM doc_reports
UNION ALL SELECT tweet_id, content, query_used, 2 FROM reports"""
ORACLES["dedup_first_seen"] = f"""WITH {DOC_REPORTS}
SELECT tweet_id, arg_min(username, [source_rank, ordinal]) AS username, min(source_rank) AS source_rank,
       arg_min(ordinal, [source_rank, ordinal]) AS ordinal, arg_min(like_count, [source_rank, ordinal]) AS like_count
FROM doc_reports WHERE tweet_id <> '' GROUP BY tweet_id"""


def relevant(words: Sequence[str]) -> str:
    return f"{hits('lower(content || user_bio)', words)} > 0"


ORACLES["relevance_filter"] = f"""WITH {REPORTS}, {DOC_REPORTS}
SELECT tweet_id, md5(content) AS content_md5 FROM (
  SELECT tweet_id, content, user_bio FROM doc_reports UNION ALL SELECT tweet_id, content, user_bio FROM reports)
WHERE {relevant(L.RELEVANCE_WORDS)}"""
ORACLES["relevance_fallback"] = f"""WITH {REPORTS}, {DOC_REPORTS}
SELECT tweet_id, md5(content) AS content_md5 FROM doc_reports
WHERE {relevant(['tsunami warning center'])}
   OR (SELECT count(*) FROM doc_reports WHERE {relevant(['tsunami warning center'])}) < 5
UNION ALL
SELECT tweet_id, md5(content) FROM reports
WHERE {relevant(L.RELEVANCE_WORDS)} OR (SELECT count(*) FROM reports WHERE {relevant(L.RELEVANCE_WORDS)}) < 5"""
ORACLES["collect_reports"] = f"""WITH {REPORTS}, {DOC_REPORTS},
fed AS (
  SELECT tweet_id, 0 AS source_rank, content, user_bio FROM reports WHERE tweet_id < '8'
  UNION ALL SELECT tweet_id, 1, content, user_bio FROM doc_reports
  UNION ALL SELECT tweet_id, 2, content, user_bio FROM reports
),
once AS (SELECT tweet_id, min(source_rank) AS source_rank, arg_min(content, source_rank) AS content,
                arg_min(user_bio, source_rank) AS user_bio FROM fed WHERE tweet_id <> '' GROUP BY tweet_id)
SELECT tweet_id, CAST(source_rank AS INTEGER) AS source_rank, md5(content) AS content_md5 FROM once
WHERE {relevant(L.RELEVANCE_WORDS)}"""
ORACLES["collect_nothing"] = f"""WITH {SYNTHETIC_ROWS}
SELECT tweet_id, md5(content) AS content_md5 FROM synthetic WHERE {relevant(L.RELEVANCE_WORDS)}"""
over_enriched(
    "distinct_ordered",
    "SELECT location, min(epoch_us(event_ts)) AS first_position FROM enriched "
    "WHERE location NOT IN ('', 'unknown') GROUP BY location",
)

# -- text and scalar functions ---------------------------------------------------------------------------

over_texts("clean_text", f"{clean('text')} AS clean_text")
over_texts(
    "extract_hashtags",
    f"CAST(len({tags('text')}) AS BIGINT) AS n_hashtags, array_to_string({tags('text')}, '|') AS hashtags",
)
over_texts("hashtags_str", f"array_to_string({tags('text')}, ' ') AS hashtags_str")
over_texts("keyword_score", f"{keyword_score('text')} AS keyword_score")
over_texts("coords_in_text", rf"nullif(regexp_extract(text, '-?\d{{1,3}}\.\d+,[{SP}]*-?\d{{1,3}}\.\d+'), '') AS coords")
over_texts(
    "loose_hashtag_pattern",
    rf"""nullif(regexp_extract(text, '(?:^|#)([A-Z][a-z]+(?:[A-Z][a-z]+)?(?:flood|quake|fire|storm|hurricane|cyclone|typhoon)?)(?:$|[^{WD}])', 1), '') AS place""",
)
over_texts("city_state", f"coalesce({city_state('text')}, '') AS city_state")
over_texts("report_id", f"{short_id('text_key || substr(text, 1, 30)')} AS report_id")
ORACLES["strip_tags"] = (
    f"SELECT page_id, {strip_tags('html')} AS plain_text, substr({strip_tags('html')}, 1, 500) AS content FROM pages"
)
ORACLES["parse_pub_date"] = f"""
SELECT event_id, CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN {iso('ts')}
       ELSE {iso("ts - INTERVAL 2 HOURS - INTERVAL 30 MINUTES")} END AS date FROM events"""
over_reports(
    "preprocess",
    f"SELECT tweet_id, {clean('content')} AS clean_text, {keyword_score('content')} AS keyword_score, "
    f"array_to_string({tags('content')}, ' ') AS hashtags_str FROM reports",
)
ORACLES["author_norm"] = """
SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type || '@' || user_id ELSE 'unknown' END AS handle,
       CASE WHEN event_type <> 'error'
            THEN substr('Office_of_' || event_type || '_coordination_and_aid_no_' || user_id, 1, 30) ELSE 'ReliefWeb' END AS office
FROM events"""
over_enriched(
    "display_columns",
    """SELECT tweet_id, substr(content, 1, 80) AS headline, substr(content, 1, 100) AS text_preview,
       substr(content, 1, 420) AS card_text, strftime(event_ts, '%Y-%m-%d %H:%M') AS date_minutes,
       printf('%.0f', urgency_score) AS score, printf('%.1f', urgency_score) AS score_1dp,
       printf('%.1f%%', 100 * CAST(CASE category WHEN 'Help Request' THEN p ELSE 0.1 END AS DOUBLE)) AS help_probability,
       CASE WHEN lat IS NOT NULL THEN printf('%.4f, %.4f', lat, lon) END AS coordinates,
       replace(priority, '_', ' ') AS priority_label, replace(location_source, '_', ' ') AS source_label
FROM enriched""",
)
ORACLES["coerce_numeric"] = r"""
SELECT event_id, CASE WHEN event_type <> 'view' THEN CAST(regexp_extract(props, '\d+') AS DOUBLE) END AS number,
       CASE WHEN event_type <> 'view' THEN CAST(regexp_extract(props, '\d+') AS DOUBLE) ELSE 0 END AS number_or_zero
FROM events"""
over_enriched("clip_lower", "SELECT tweet_id, CASE WHEN urgency_score < 5 THEN 5.0 ELSE urgency_score END AS size FROM enriched")

# -- classification and scoring --------------------------------------------------------------------------

over_judged("urgency_keyword_score", "k AS keyword_part")
over_judged("rule_classify", "category, urgency_score")
over_judged(
    "rule_probs",
    """CAST(CASE category WHEN 'Help Request' THEN greatest(0, round(1 - CAST(p AS DOUBLE) - 0.1, 4))
            WHEN 'Damage Report' THEN 0.15 ELSE 0.75 END AS DOUBLE) AS p_information,
       CAST(CASE category WHEN 'Help Request' THEN round(p, 4) ELSE 0.1 END AS DOUBLE) AS p_help_request,
       CAST(CASE category WHEN 'Help Request' THEN 0.1 WHEN 'Damage Report' THEN 0.75 ELSE 0.15 END AS DOUBLE) AS p_damage_report""",
)
ORACLES["urgency_blend"] = f"""WITH {REPORTS}, judged_texts AS (SELECT content AS text FROM reports),{JUDGED}
SELECT tweet_id, round(CAST(like_count % 101 AS DOUBLE) * 0.8 + 0.2 * k, 2) AS urgency
FROM reports JOIN judged ON text = content"""
over_enriched("classify", "SELECT tweet_id, category, urgency_score, 'rule-based' AS model_mode FROM enriched")
ORACLES["score_fn_classify"] = f"""WITH {REPORTS}, judged_texts AS (SELECT content AS text FROM reports),{JUDGED}
SELECT tweet_id, CASE WHEN length(clean_text) > 50 THEN 'Help Request' ELSE 'Information' END AS category,
       round(CASE WHEN length(clean_text) > 50 THEN 40 ELSE 16 END + 0.2 * k, 2) AS urgency_score, 'model' AS model_mode
FROM reports JOIN judged ON content = text"""
over_enriched(
    "enrich_batch",
    """SELECT tweet_id, category, urgency_score, location, count(*) OVER () AS total,
       count(*) FILTER (urgency_score > 70) OVER () AS high_urgency_count,
       count(*) FILTER (location = 'unknown') OVER () AS unknown_location_count FROM enriched""",
)
BATCH = """SELECT count(*) AS total, count(*) FILTER (urgency_score > 70) AS high_urgency_count,
count(*) FILTER (location = 'unknown') AS unknown_location_count FROM enriched"""
over_enriched(
    "enrich",
    "SELECT tweet_id, date, category, urgency_score, location, location_source, location_confidence, priority, lat, lon FROM enriched",
)

# -- locations -------------------------------------------------------------------------------------------

over_reports(
    "gazetteer_match",
    f""", found AS (SELECT t.tpl_id, {listed_place('t.content')} AS text_place, {listed_place('t.user_bio')} AS bio_place FROM templates t)
SELECT {short_id('CAST(event_id AS VARCHAR)')} AS tweet_id, text_place, bio_place
FROM events JOIN found ON event_id % {len(TEMPLATES)} = tpl_id""",
)
ORACLES["gazetteer_match_join"] = f"""
WITH turns AS (SELECT regexp_extract_all(lower(text), '[{WD}]+') AS w FROM conversations),
places AS (SELECT DISTINCT array_to_string(w[1:2], ' ') AS place FROM turns WHERE len(w) > 0),
tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[{WD}]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM tokens),
grams AS (SELECT doc_id, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS place
          FROM starts, (VALUES (1), (2)) AS lengths(n) WHERE pos + n - 1 <= len(w)),
found AS (SELECT doc_id, arg_min('<' || place || '>', [pos, -n]) AS place FROM grams JOIN places USING (place) GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 5 > 1 THEN doc_id % 3 END AS tweet_id, place FROM documents LEFT JOIN found USING (doc_id)"""
ORACLES["gazetteer_match_shuffled"] = ORACLES["gazetteer_match_join"].replace("CASE WHEN doc_id % 5 > 1 THEN doc_id % 3 END AS tweet_id, ", "")
over_reports("hashtag_place", f"SELECT tweet_id, coalesce({tag_place(tags('content'))}, '') AS place FROM reports")
ORACLES["normalize_location"] = f"""WITH {TEXTS}
SELECT text_key, {normal('raw')} AS location FROM (
  SELECT 'r-' || tweet_id AS text_key, user_location AS raw FROM reports
  UNION ALL SELECT text_key, '  ' || text || ' ' FROM texts)"""
over_enriched("extract_location", "SELECT tweet_id, location, location_source, location_confidence FROM enriched")
ORACLES["extract_location_patterns"] = f"""WITH {REPORTS},{cascade(False)}
SELECT tweet_id, location, location_source, {confidence('location_source')} AS location_confidence
FROM reports JOIN located USING (content, user_bio, user_location)"""
over_enriched("location_confidence", "SELECT tweet_id, location_confidence FROM enriched")
over_reports(
    "hashtag_first_location",
    f""", found AS (
  SELECT t.tpl_id, coalesce({tags('t.content')}[1], {listed_place("t.content || ' ' || t.user_bio")}, 'Unknown') AS location FROM templates t)
SELECT {short_id('CAST(event_id AS VARCHAR)')} AS tweet_id, location
FROM events JOIN found ON event_id % {len(TEMPLATES)} = tpl_id""",
)

# Documents, turns and addresses as reports, and a gazetteer of single words of their own.
TEXT_REPORTS = f"""
text_reports AS (
  SELECT 'd-' || doc_id AS tweet_id, text AS content, '' AS user_bio,
         CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Worldwide' ELSE source || ' harbour' END AS user_location FROM documents
  UNION ALL SELECT 'c-' || conv_id || '-' || turn,
         CASE WHEN turn % 4 = 2 THEN role WHEN turn % 2 = 1 THEN text || ' #' || regexp_extract(text, '^([A-Z][a-z]+)', 1)
              ELSE text END,
         CASE WHEN turn % 4 = 2 THEN role || ' ' || text ELSE '' END, '' FROM conversations
  UNION ALL SELECT 'p-' || page_id, url, '', split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1) FROM pages
),
word_places AS (
  SELECT DISTINCT lower(regexp_extract(text, '^([A-Z][a-z]{{6,}})', 1)) AS place FROM conversations
  WHERE regexp_matches(text, '^[A-Z][a-z]{{6,}}')
),
word_answers AS (
  SELECT text, upper(place[1]) || place[2:] AS place FROM (
    SELECT text, arg_min(place, pos) AS place FROM (
      SELECT text, unnest(w) AS place, unnest(range(1, len(w) + 1)) AS pos FROM (
        SELECT text, regexp_extract_all(lower(text), '[{WD}]+') AS w FROM (
          SELECT content AS text FROM text_reports UNION SELECT user_bio FROM text_reports))) JOIN word_places USING (place)
    GROUP BY text)
)"""


def text_cascade(text_place: str, bio_place: str, joins: str) -> str:
    in_text = f"coalesce({normal(text_place)}, {normal('text_pattern')})"
    return f"""
text_candidates AS (
  SELECT tweet_id, {in_text} AS c1, {normal('tag')} AS c2, {normal('user_location')} AS c3,
         {normal(f"coalesce(nullif({bio_place}, ''), bio_pattern)")} AS c4
  FROM (SELECT t.*, {city_state('content')} AS text_pattern, {city_state('user_bio')} AS bio_pattern,
               {tag_place(tags('content'))} AS tag FROM text_reports t) t {joins}
),
text_located AS (
  SELECT tweet_id, coalesce(c1, c2, c3, c4, 'unknown') AS location,
         CASE WHEN c1 IS NOT NULL THEN 'tweet' WHEN c2 IS NOT NULL THEN 'hashtag'
              WHEN c3 IS NOT NULL THEN 'profile_location' WHEN c4 IS NOT NULL THEN 'bio' ELSE 'none' END AS location_source
  FROM text_candidates
)"""


WORD_CASCADE = text_cascade(
    "a.place", "b.place", "LEFT JOIN word_answers a ON a.text = t.content LEFT JOIN word_answers b ON b.text = t.user_bio"
)
_NINE = r"regexp_extract({0}, '(?:^|[^\p{{L}}\p{{N}}_])([A-Za-z]{{9,}})(?:$|[^\p{{L}}\p{{N}}_])', 1)"
ORACLES["hashtag_place_texts"] = (
    f"WITH {TEXT_REPORTS} SELECT tweet_id, coalesce({tag_place(tags('content'))}, '') AS place FROM text_reports"
)
ORACLES["extract_location_texts"] = f"""WITH {TEXT_REPORTS},{WORD_CASCADE}
SELECT tweet_id, location, location_source, {confidence('location_source')} AS location_confidence FROM text_located"""
ORACLES["entity_fn_location"] = f"""WITH {TEXT_REPORTS},{text_cascade(_NINE.format('content'), _NINE.format('user_bio'), '')}
SELECT tweet_id, location, location_source FROM text_located"""
TEXT_JUDGED = f"judged_texts AS (SELECT content AS text FROM text_reports),{JUDGED}"
ORACLES["classify_texts"] = f"""WITH {TEXT_REPORTS}, {TEXT_JUDGED}
SELECT tweet_id, category, urgency_score, {keyword_score('content')} AS keyword_score, 'rule-based' AS model_mode
FROM text_reports JOIN judged ON text = content"""
ORACLES["enrich_texts"] = f"""WITH {TEXT_REPORTS}, {TEXT_JUDGED},{WORD_CASCADE}
SELECT tweet_id, category, urgency_score, location, location_source, {priority('urgency_score', 'location_source')} AS priority,
       coalesce({pair('location', 1)}, CAST(length(p.place) AS DOUBLE)) AS lat,
       coalesce({pair('location', 2)}, -CAST(length(p.place) AS DOUBLE)) AS lon
FROM text_reports JOIN judged ON text = content JOIN text_located USING (tweet_id)
LEFT JOIN word_places p ON p.place = lower(location)"""

# -- priority and geocoding ------------------------------------------------------------------------------

ORACLES["priority_label"] = f"""
WITH sources(source) AS (VALUES {values([(name,) for name in (*L.LOCATION_CONFIDENCE, 'elsewhere')])}),
cases AS (SELECT event_id, source, {priority('value', 'source')} AS priority FROM events, sources)
SELECT *, CAST(list_position(['HIGHEST', 'HIGH', 'CRITICAL_REVIEW', 'MEDIUM', 'LOW'], priority) AS BIGINT) AS priority_rank FROM cases"""
over_enriched(
    "urgency_band",
    """SELECT tweet_id, CASE WHEN urgency_score > 70 THEN 'high' WHEN urgency_score >= 40 THEN 'medium' ELSE 'low' END AS band,
       urgency_score > 70 AND location = 'unknown' AS critical FROM enriched""",
)
ORACLES["parse_coordinates"] = """
SELECT event_id, CASE WHEN event_type <> 'view' THEN -(user_id + 0.25::DOUBLE) END AS lat,
       CASE WHEN event_type <> 'view' THEN CAST(event_id AS DOUBLE) END AS lon FROM events"""
over_enriched("geocode_lookup", "SELECT DISTINCT location, lat, lon FROM enriched WHERE location <> 'unknown'")
over_enriched("attach_coordinates", "SELECT tweet_id, location, lat, lon FROM enriched")
over_enriched("attach_coordinates_shuffled", "SELECT tweet_id, location, lat, lon FROM enriched")
over_enriched(
    "geocode_report",
    "SELECT count(*) AS total, count(lat) AS found FROM (SELECT DISTINCT location, lat FROM enriched WHERE location <> 'unknown')",
)

ORACLES["geocode_remembered"] = """
WITH turns AS (SELECT conv_id, regexp_extract(text, '^([A-Z][a-z]{4,})', 1) AS location FROM conversations),
places AS (SELECT DISTINCT lower(regexp_extract(text, '^([A-Z][a-z]{6,})', 1)) AS place FROM conversations),
asked AS (SELECT location, min(conv_id % 2) AS run FROM turns
    WHERE location <> '' AND lower(location) NOT IN ('unknown', 'none') GROUP BY location)
SELECT location, CASE WHEN run = 0 AND place IS NOT NULL THEN CAST(length(place) AS DOUBLE) END AS lat,
    CASE WHEN run = 0 AND place IS NOT NULL THEN -CAST(length(place) AS DOUBLE) END AS lon,
    run = 0 AND place IS NOT NULL AS found, CAST(run + 1 AS DOUBLE) AS looked_up
FROM asked LEFT JOIN places ON place = lower(location) AND place <> ''"""
ORACLES["first_seen_across_runs"] = """
SELECT md5(text) AS tweet_id, CAST(min(conv_id % 3) AS INT) AS run FROM conversations WHERE text IS NOT NULL GROUP BY 1"""
over_reports("collect_reused", "SELECT tweet_id, like_count, true AS reused FROM reports WHERE like_count % 2 = 0")
over_reports("collect_anew", "SELECT tweet_id, like_count, false AS reused FROM reports WHERE like_count % 2 = 1")

# -- filters, sorts, top lists ---------------------------------------------------------------------------

FOUND = "tweet_id, category, urgency_score, location, location_source, priority"


def found(name: str, condition: str, columns: str = FOUND) -> None:
    over_enriched(name, f"SELECT {columns} FROM enriched WHERE {condition}")


found("filter_min_urgency", "urgency_score >= 40")
found("filter_urgency_range", "urgency_score BETWEEN 5 AND 48")
found("filter_category", "category = 'Damage Report'")
found("filter_category_in", "category IN ('Help Request', 'Damage Report')")
found("filter_source_in", "location_source IN ('bio', 'hashtag')")
ORACLES["search_by_trigrams"] = r"""
SELECT doc_id, CAST(length(text) AS INT) AS n_chars FROM documents
WHERE regexp_matches(lower(text), 'licen[cs]e[sd]? under|@mail[0-9]+\.example')"""
found("filter_content_contains", "lower(content) LIKE '%rescue%' OR lower(content) LIKE '%café%'")
found("filter_location_contains", "location ILIKE '%ho_st%' OR location ILIKE '%river%'")
found("filter_has_coords", "lat IS NOT NULL AND lon IS NOT NULL")
found("filter_critical_review", "urgency_score > 70 AND location = 'unknown'")
found("filter_known_location", "location NOT IN ('unknown', '')")
over_enriched(
    "filter_not_geocoded",
    "SELECT DISTINCT location FROM enriched WHERE location NOT IN ('unknown', '') AND lat IS NULL",
)
found("sort_by", "true")
over_enriched("top_urgent", f"SELECT {FOUND} FROM enriched ORDER BY urgency_score DESC, tweet_id LIMIT 100")
over_enriched(
    "top_high_urgency",
    f"SELECT {FOUND} FROM enriched WHERE urgency_score > 70 ORDER BY urgency_score DESC, tweet_id LIMIT 5",
)
over_enriched(
    "search_reports",
    f"""SELECT {FOUND} FROM enriched
WHERE urgency_score >= 20 AND category = 'Help Request' AND location_source IN ('tweet', 'hashtag', 'profile_location')
  AND (content ILIKE '%rescue%' OR content ILIKE '%help%') AND location ILIKE '%o%'
ORDER BY urgency_score DESC, tweet_id LIMIT 500""",
)
found(
    "map_points", "lat IS NOT NULL AND lon IS NOT NULL",
    "tweet_id, lat, lon, location, category, priority, urgency_score, greatest(urgency_score, 5.0) AS size, "
    "substr(content, 1, 100) AS text_preview",
)
over_enriched(
    "top_20_urgent",
    f"SELECT date, content, {FOUND}, location_confidence, lat, lon FROM enriched ORDER BY urgency_score DESC, tweet_id LIMIT 20",
)

# -- aggregations ----------------------------------------------------------------------------------------

over_enriched(
    "summary_stats",
    """SELECT count(*) AS total_tweets, count(*) FILTER (urgency_score > 70) AS high_urgency,
       count(*) FILTER (urgency_score >= 40 AND urgency_score <= 70) AS medium_urgency,
       count(*) FILTER (urgency_score < 40) AS low_urgency, count(*) FILTER (location = 'unknown') AS unknown_locations,
       count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS geocoded_tweets,
       round(avg(urgency_score), 2) AS avg_urgency FROM enriched""",
)
over_enriched(
    "headline_counters",
    """SELECT count(*) AS total, count(*) FILTER (urgency_score > 70) AS high_urgency,
       count(*) FILTER (location = 'unknown') AS unknown_location,
       count(*) FILTER (urgency_score > 70 AND location = 'unknown') AS critical_review FROM enriched""",
)
over_enriched(
    "value_counts",
    """SELECT 'category' AS dimension, category AS value, count(*) AS n FROM enriched GROUP BY category
UNION ALL SELECT 'location_source', location_source, count(*) FROM enriched GROUP BY location_source
UNION ALL SELECT 'priority', priority, count(*) FROM enriched GROUP BY priority""",
)
over_enriched(
    "describe_urgency",
    """SELECT count(*) AS count, round(avg(urgency_score), 6) AS mean, round(stddev_samp(urgency_score), 6) AS std,
       round(min(urgency_score), 6) AS min, round(max(urgency_score), 6) AS max,
       round(quantile_cont(urgency_score, 0.25), 6) AS p25, round(quantile_cont(urgency_score, 0.5), 6) AS p50,
       round(quantile_cont(urgency_score, 0.75), 6) AS p75 FROM enriched""",
)
over_enriched(
    "urgency_histogram",
    """SELECT CAST(b AS INTEGER) AS bin, CAST((b - 1) * 5 AS DOUBLE) AS bin_start, CAST(b * 5 AS DOUBLE) AS bin_end,
       (SELECT count(*) FROM enriched WHERE least(floor(urgency_score / 5) + 1, 20) = b) AS n
FROM range(1, 21) bins(b)""",
)
over_enriched(
    "map_counters",
    """SELECT count(*) AS total, count(*) FILTER (location <> 'unknown') AS known_location, count(lat) AS geocoded,
       count(*) FILTER (location = 'unknown') AS unknown_location FROM enriched""",
)
over_enriched("batch_counts", BATCH)
RUN_SUMMARY = (
    """SELECT 'counter' AS section, 'total' AS name, CAST(count(*) AS VARCHAR) AS value FROM enriched
UNION ALL SELECT 'counter', 'high_urgency', CAST(count(*) AS VARCHAR) FROM enriched WHERE urgency_score > 70
UNION ALL SELECT 'counter', 'unknown_location', CAST(count(*) AS VARCHAR) FROM enriched WHERE location = 'unknown'
UNION ALL SELECT 'category', category, CAST(count(*) AS VARCHAR) FROM enriched GROUP BY category
UNION ALL SELECT 'priority', priority, CAST(count(*) AS VARCHAR) FROM enriched GROUP BY priority
UNION ALL SELECT * FROM (
  SELECT 'top', tweet_id, printf('[%.1f]', urgency_score) || ' | ' || substr(content, 1, 80) || ' | ' || location
         || ' | ' || location_source || ' | ' || priority
  FROM enriched WHERE urgency_score > 70 ORDER BY urgency_score DESC, tweet_id LIMIT 5)"""
)
over_enriched("run_summary", RUN_SUMMARY)
ORACLES["run_batch"] = f"""WITH {ENRICHED.replace('enriched AS (', 'every AS (')},
enriched AS (SELECT * FROM every WHERE {relevant(L.RELEVANCE_WORDS)})
{RUN_SUMMARY}
UNION ALL SELECT 'observed', 'processed', CAST(count(*) AS VARCHAR) FROM enriched
UNION ALL SELECT 'observed', 'high_urgency', CAST(count(*) AS VARCHAR) FROM enriched WHERE urgency_score > 70
UNION ALL SELECT 'observed', 'unknown_location', CAST(count(*) AS VARCHAR) FROM enriched WHERE location = 'unknown'"""
ORACLES["label_distribution"] = "SELECT quality, count(*) AS n FROM labels GROUP BY quality"

# -- learning --------------------------------------------------------------------------------------------

ORACLES["labelled_set"] = """
SELECT CAST(0 AS INTEGER) AS label, md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT 1, md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 2, md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)"""
over_judged(
    "weak_labels",
    "CAST(CASE category WHEN 'Information' THEN 0 WHEN 'Help Request' THEN 1 ELSE 2 END AS INTEGER) AS label",
)
ORACLES["stratified_split"] = """
SELECT doc_id, quality AS label,
       CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id)
                 <= round(0.2 * count(*) OVER (PARTITION BY quality)) THEN 'test' ELSE 'train' END AS split
FROM labels"""
TOKENS = f"regexp_extract_all(lower(text), '[{WD}]+')"
over_texts(
    "tokenize",
    f"CAST(len({TOKENS}) AS BIGINT) AS n_tokens, array_to_string({TOKENS}, ' ') AS model_input",
)
ORACLES["train_classifier"] = """
SELECT CAST(sum(n) AS BIGINT) AS n, true AS good_f1, true AS good_accuracy
FROM (SELECT round(0.2 * count(*)) AS n FROM documents GROUP BY lang)"""
over_enriched("model_classify", "SELECT tweet_id, category, 'model' AS model_mode FROM enriched")
ORACLES["save_load_model"] = "SELECT true AS same, count(*) AS n FROM labels JOIN documents USING (doc_id)"
METRICS = """
pairs AS (SELECT quality AS label, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id)),
classes AS (
  SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS predicted,
         count(*) FILTER (label = c AND prediction = c) AS hits
  FROM pairs, (SELECT label AS c FROM pairs UNION SELECT prediction FROM pairs) GROUP BY c
),
ratios AS (
  SELECT *, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END AS p,
         CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0 END AS r FROM classes
),
metrics AS (
  SELECT CAST(sum(support) AS BIGINT) AS n, sum(hits) / sum(support)::DOUBLE AS accuracy,
         sum(support * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(support) AS f1,
         sum(support * p) / sum(support) AS precision, sum(support * r) / sum(support) AS recall FROM ratios
)"""
ORACLES["eval_metrics"] = f"""WITH {METRICS}
SELECT n, round(accuracy, 8) AS accuracy, round(f1, 8) AS f1, round("precision", 8) AS "precision", round(recall, 8) AS recall FROM metrics"""
ORACLES["run_log"] = f"""WITH {METRICS}
SELECT run_id, '3' AS epochs, round(accuracy, 8) AS eval_accuracy, round(f1, 8) AS eval_f1
FROM metrics, (VALUES ('first'), ('second')) AS runs(run_id)"""

# -- streaming -------------------------------------------------------------------------------------------

over_enriched("stream_enrich", f"SELECT {FOUND}, lat, lon FROM enriched")
over_reports(
    "stream_dedup",
    f"SELECT DISTINCT {short_id('username || content')} AS tweet_id, username, content FROM reports",
)
over_enriched(
    "stream_counters",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
       count(*) AS total, count(*) FILTER (urgency_score > 70) AS high_urgency,
       count(*) FILTER (location = 'unknown') AS unknown_location,
       count(*) FILTER (urgency_score > 70 AND location = 'unknown') AS critical_review
FROM (SELECT *, date_trunc('hour', event_ts) AS w FROM enriched) GROUP BY w""",
)
found("stream_alerts", "priority = 'CRITICAL_REVIEW'")

# -- validation ------------------------------------------------------------------------------------------

ORACLES["validate_reports"] = f"""WITH {REPORTS}, {DOC_REPORTS},
inputs AS (
  SELECT 'd-' || ordinal AS text_key, content, content AS user_bio, user_location FROM doc_reports
  UNION ALL SELECT 'r-' || tweet_id, content, user_bio, user_location FROM reports
),
checked AS (
  SELECT text_key, CASE WHEN length(content) < 1 THEN 'text is empty' WHEN length(content) > 1000 THEN 'text over 1000 characters'
                        WHEN length(user_bio) > 500 THEN 'bio over 500 characters'
                        WHEN length(user_location) > 200 THEN 'profile over 200 characters' END AS reason
  FROM inputs
)
SELECT text_key, reason IS NULL AS valid, reason FROM checked"""
