"""The SQL that DuckDB runs on the same tables, written without regard to scale."""

from __future__ import annotations

from watchloom.functions.constants import (
    CALL_TO_ACTION_PATTERN,
    CATEGORIES,
    CLOCK_PATTERN,
    HASHTAG_PATTERN,
    LANGUAGE_CODES,
    SCRIPT_PATTERNS,
    SOCIAL_PATTERN,
    STOP_WORDS,
    URL_PATTERN,
)

SQL: dict[str, str] = {}


def all_sql() -> dict[str, str]:
    return dict(SQL)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _local(ts: str) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Copenhagen')"


def _with(*ctes: str) -> str:
    """WITH clause of the named fixtures and those they need, in order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for c in ctes:
        add(c)
    return "WITH " + ",\n".join(f"{c} AS ({_CTES[c]})" for c in wanted) + "\n"


_ids = ", ".join(str(c) for c, _ in CATEGORIES)
_rows = ", ".join(f"({c}, {_q(n)})" for c, n in CATEGORIES)

_CTES = {
    "cats": f"SELECT * FROM (VALUES {_rows}) t(category_id, category_name)",
    "ek": "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events",
    "ev": """SELECT event_id, 'v' || k AS video_id,
        CASE WHEN event_type <> 'error' THEN user_id END AS channel_id, ts AS watched_at FROM ek""",
    "vw": """SELECT event_id, user_id AS viewer, 'v' || k AS video_id, k % 20 AS channel_id,
        ts AS watched_at FROM ek""",
    "ov": """SELECT o_orderkey AS event_id, 'o' || (o_orderkey % 3000) AS video_id,
        o_custkey AS channel_id, o_orderdate AS watched_at FROM orders""",
    "ch": """SELECT DISTINCT channel_id, 'ch' || channel_id AS channel_name,
        'u/' || channel_id AS channel_url FROM ev WHERE channel_id IS NOT NULL""",
    "och": """SELECT DISTINCT channel_id, 'ch' || channel_id AS channel_name,
        'u/' || channel_id AS channel_url FROM ov WHERE channel_id IS NOT NULL""",
    "vids": f"""SELECT 'v' || k AS video_id, 'Video ' || k AS title,
        'https://video.example/watch?v=v' || k AS title_url, k % 150 AS channel_id,
        CASE k % 10 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'private' ELSE 'active' END AS status,
        CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS tags,
        [{_ids}][k % 29 + 1] AS category_id,
        CASE WHEN k % 7 <> 0 THEN k * 37 % 3000 END AS duration_seconds,
        CAST(NULL AS BIGINT) AS view_count, CAST(NULL AS BIGINT) AS like_count,
        CASE WHEN k % 4 = 0 THEN TIMESTAMP '2024-01-01' END AS enriched_at,
        TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at
        FROM (SELECT DISTINCT k FROM ek)""",
    "meta": """SELECT 'v' || k AS video_id, 'about ' || k AS description,
        CASE WHEN k % 2 = 0 THEN 'a|b' ELSE '' END AS tags,
        CASE WHEN k % 5 <> 0 THEN 10 END AS category_id, k * 3 AS duration_seconds,
        count(*) AS view_count, CASE WHEN k % 4 <> 1 THEN max(user_id) END AS like_count
        FROM ek GROUP BY k
        HAVING count(*) FILTER (event_type = 'purchase') >= count(*) FILTER (event_type = 'view')""",
    "enriched": """SELECT v.video_id, v.title, v.channel_id, v.status,
        CASE WHEN m.video_id IS NULL THEN v.description ELSE m.description END AS description,
        CASE WHEN m.video_id IS NULL THEN v.tags ELSE m.tags END AS tags,
        CAST(CASE WHEN m.video_id IS NULL THEN v.category_id ELSE m.category_id END AS INTEGER)
            AS category_id,
        CASE WHEN m.video_id IS NULL THEN v.duration_seconds ELSE m.duration_seconds END
            AS duration_seconds,
        m.view_count, m.like_count,
        CASE WHEN m.video_id IS NULL THEN v.enriched_at ELSE TIMESTAMP '2024-06-01' END AS enriched_at,
        v.created_at,
        CASE WHEN m.video_id IS NULL THEN v.updated_at ELSE TIMESTAMP '2024-06-01' END AS updated_at
        FROM vids v LEFT JOIN meta m USING (video_id)""",
    "raw": """SELECT event_id AS pos, ts, user_id,
        event_type = 'error' AS ad,
        CASE WHEN event_type = 'view' AND k % 10 = 0
            THEN 'Watched https://video.example/watch?list=a%20b&v=v' || k || '&t=5#top'
            ELSE 'Watched Video ' || k END AS title,
        CASE WHEN event_type <> 'signup'
            THEN 'https://video.example/watch?list=a%20b&v=v' || k || '&t=5#top' END AS url,
        CASE WHEN NOT (event_type = 'view' AND k % 10 = 0) THEN 'ch' || user_id END AS ch,
        CASE WHEN NOT (event_type = 'view' AND k % 10 = 0) THEN 'u/' || user_id END AS chu
        FROM ek""",
    "cls": """SELECT *, CASE WHEN ad THEN 'ad' WHEN url IS NULL THEN 'removed'
        WHEN regexp_matches(title, '^Watched https?://') THEN 'ghost' ELSE 'clean' END AS record_class
        FROM raw""",
    "parsed": """SELECT CAST(record_class = 'ghost' AS INTEGER) AS class_rank, 'events' AS file_name, pos,
        regexp_extract(url, '[?&]v=([^&#]+)', 1) AS video_id,
        CASE WHEN record_class = 'clean' THEN substr(title, 9) END AS title,
        url AS title_url, ts AS watched_at, ch AS channel_name, chu AS channel_url
        FROM cls WHERE record_class IN ('clean', 'ghost')""",
    "firsts": """SELECT video_id, title, title_url, channel_name, channel_url FROM parsed
        QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY class_rank, pos) = 1""",
    "newch": """SELECT channel_name, channel_url,
        min(class_rank * 1000000000000 + pos) FILTER (watched_at < TIMESTAMP '2024-01-16') AS early,
        min(class_rank * 1000000000000 + pos) AS late
        FROM parsed WHERE channel_name IS NOT NULL GROUP BY ALL""",
    "chids": """SELECT channel_name, channel_url,
        row_number() OVER (ORDER BY early IS NULL, CASE WHEN early IS NULL THEN late ELSE early END)
            AS channel_id FROM newch""",
    "evfirst": """SELECT *, watched_at < TIMESTAMP '2024-01-16' AS early FROM parsed
        QUALIFY row_number() OVER (PARTITION BY video_id, watched_at ORDER BY class_rank, pos) = 1""",
    "runlog": """SELECT 'export-' || strftime(ts, '%Y-%m-%d') AS file_name,
        date_trunc('day', ts) + INTERVAL 12 HOUR AS run_at, count(*) AS total_raw_records,
        count(*) FILTER (record_class = 'ad') AS ads_filtered,
        count(*) FILTER (record_class = 'removed') AS removed_dropped,
        count(*) FILTER (record_class IN ('clean', 'ghost')) AS new_events
        FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS d FROM cls) GROUP BY 1, 2""",
    "docs": """SELECT *, 'd' || doc_id AS video_id,
        CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS channel_id,
        TIMESTAMP '2024-03-01' + to_seconds(doc_id) AS watched_at FROM documents""",
    "noisy": """SELECT *, CASE WHEN doc_id % 2 = 1
        THEN 'https://a.b/c 12:34 #tag Subscribe twitter: @me ' || text ELSE text END AS description
        FROM docs""",
}

_NEEDS = {
    "ev": ["ek"], "vw": ["ek"], "ch": ["ev"], "och": ["ov"], "vids": ["ek"], "meta": ["ek"],
    "enriched": ["vids", "meta"], "raw": ["ek"], "cls": ["raw"], "parsed": ["cls"],
    "firsts": ["parsed"], "newch": ["parsed"], "chids": ["newch"], "evfirst": ["parsed"],
    "runlog": ["cls"], "noisy": ["docs"], "cleaned": ["noisy"],
}


def _calendar(source: str, name: str = "dd") -> None:
    """Calendar CTE over the years of a fixture."""
    w = _local("watched_at")
    _CTES[name] = f"""SELECT CAST(d AS DATE) AS date_key,
        CAST(extract(year FROM d) AS INTEGER) AS year,
        CAST(extract(quarter FROM d) AS INTEGER) AS quarter,
        CAST(extract(month FROM d) AS INTEGER) AS month, strftime(d, '%B') AS month_name,
        CAST(extract(week FROM d) AS INTEGER) AS week_of_year,
        CAST(extract(day FROM d) AS INTEGER) AS day_of_month,
        CAST(extract(dow FROM d) AS INTEGER) AS day_of_week_num, strftime(d, '%A') AS day_of_week,
        extract(dow FROM d) IN (0, 6) AS is_weekend,
        CASE WHEN extract(month FROM d) IN (12, 1, 2) THEN 'Winter'
             WHEN extract(month FROM d) IN (3, 4, 5) THEN 'Spring'
             WHEN extract(month FROM d) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season,
        strftime(d, '%m-%d') IN ('01-01', '06-05', '12-24', '12-25', '12-26', '12-31')
            AS is_danish_holiday
        FROM (SELECT unnest(generate_series(
            date_trunc('year', min({w})), date_trunc('year', max({w})) + INTERVAL 1 YEAR - INTERVAL 1 DAY,
            INTERVAL 1 DAY)) AS d FROM {source})"""
    _NEEDS[name] = [source]


_calendar("ev", "dd")
_calendar("ov", "odd")


def _asof(source: str) -> str:
    return f"(SELECT CAST(max({_local('watched_at')}) AS DATE) + 14 FROM {source})"


# -- dimensions and views ------------------------------------------------------------------

SQL["dim_date"] = _with("odd") + "SELECT * FROM odd"

SQL["watch_history"] = _with("ev", "vids", "ch", "cats", "dd") + f"""
SELECT e.event_id, {_local('e.watched_at')} AS watched_at_dk, v.video_id, v.title, v.title_url,
    v.status, c.channel_name, c.channel_url, g.category_name, d.year, d.quarter, d.month,
    d.month_name, d.week_of_year, d.day_of_week, d.day_of_week_num, d.is_weekend, d.season,
    d.is_danish_holiday, CAST(extract(hour FROM {_local('e.watched_at')}) AS INTEGER) AS hour
FROM ev e JOIN vids v ON e.video_id = v.video_id
LEFT JOIN ch c ON e.channel_id = c.channel_id
LEFT JOIN cats g ON v.category_id = g.category_id
LEFT JOIN dd d ON d.date_key = CAST({_local('e.watched_at')} AS DATE)"""

SQL["channel_loyalty"] = _with("ev", "vids", "ch") + f"""
SELECT c.channel_name, c.channel_url, count(*) AS total_views,
    count(DISTINCT v.video_id) AS unique_videos,
    count(DISTINCT CAST({_local('e.watched_at')} AS DATE)) AS active_days,
    min({_local('e.watched_at')}) AS first_watched_dk, max({_local('e.watched_at')}) AS last_watched_dk
FROM ev e JOIN ch c ON e.channel_id = c.channel_id JOIN vids v ON e.video_id = v.video_id
GROUP BY c.channel_id, c.channel_name, c.channel_url"""

SQL["discovery_events"] = _with("ev", "ch") + """
, ranked AS (SELECT e.event_id, e.video_id, e.channel_id, e.watched_at, c.channel_name,
    row_number() OVER (PARTITION BY e.channel_id ORDER BY e.watched_at, e.event_id) AS channel_watch_rank,
    row_number() OVER (PARTITION BY e.video_id ORDER BY e.watched_at, e.event_id) AS video_watch_rank
    FROM ev e LEFT JOIN ch c ON e.channel_id = c.channel_id)
SELECT *, channel_watch_rank = 1 AS is_channel_discovery, video_watch_rank = 1 AS is_first_watch
FROM ranked"""


def _daily(events: str, days: str) -> str:
    return f"""SELECT d.date_key, d.year, d.quarter, d.month, d.month_name, d.day_of_week,
    d.day_of_week_num, d.is_weekend, d.season, d.is_danish_holiday,
    count(e.event_id) AS videos_watched, count(DISTINCT e.video_id) AS unique_videos,
    count(DISTINCT e.channel_id) AS unique_channels,
    min({_local('e.watched_at')}) AS first_watch, max({_local('e.watched_at')}) AS last_watch
FROM {days} d LEFT JOIN {events} e ON d.date_key = CAST({_local('e.watched_at')} AS DATE)
WHERE d.date_key <= {_asof(events)}
GROUP BY ALL"""


def _monthly(events: str, days: str, since: str) -> str:
    return f"""SELECT d.year, d.month, d.month_name, d.season, count(e.event_id) AS total_views,
    count(DISTINCT e.video_id) AS unique_videos, count(DISTINCT e.channel_id) AS unique_channels,
    count(DISTINCT d.date_key) FILTER (e.event_id IS NOT NULL) AS active_days,
    CAST(round(CAST(count(e.event_id) AS DECIMAL(18, 4)) /
        nullif(count(DISTINCT d.date_key) FILTER (e.event_id IS NOT NULL), 0), 1) AS DOUBLE)
        AS avg_videos_per_active_day
FROM {days} d LEFT JOIN {events} e ON d.date_key = CAST({_local('e.watched_at')} AS DATE)
WHERE d.date_key <= {_asof(events)} AND d.date_key >= DATE '{since}'
GROUP BY ALL"""


SQL["daily_summary"] = _with("ev", "dd") + _daily("ev", "dd")
SQL["monthly_summary"] = _with("ov", "odd") + _monthly("ov", "odd", "1995-01-01")

_CHANNEL_MONTH = """SELECT c.channel_id, c.channel_name, d.year, d.month, d.month_name,
    count(*) AS views, count(DISTINCT e.video_id) AS unique_videos
FROM {ev} e JOIN {ch} c ON e.channel_id = c.channel_id
JOIN {dd} d ON d.date_key = CAST({local} AS DATE) GROUP BY ALL"""

SQL["channel_monthly"] = _with("ev", "ch", "dd") + _CHANNEL_MONTH.format(
    ev="ev", ch="ch", dd="dd", local=_local("e.watched_at")
)

SQL["hourly_distribution"] = _with("ev", "dd") + f"""
SELECT d.year, d.day_of_week_num, d.day_of_week, d.is_weekend,
    CAST(extract(hour FROM {_local('e.watched_at')}) AS INTEGER) AS hour, count(*) AS views
FROM ev e JOIN dd d ON d.date_key = CAST({_local('e.watched_at')} AS DATE) GROUP BY ALL"""

SQL["channel_funnel"] = _with("ov", "och") + f"""
, stats AS (SELECT c.channel_id, c.channel_name, count(*) AS total_views,
    count(DISTINCT e.video_id) AS unique_videos,
    count(DISTINCT CAST({_local('e.watched_at')} AS DATE)) AS active_days,
    min(e.watched_at) AS first_watch, max(e.watched_at) AS last_watch,
    round(date_diff('microsecond', min(e.watched_at), max(e.watched_at)) / 86400000000.0, 6) AS span_days
    FROM ov e JOIN och c ON e.channel_id = c.channel_id GROUP BY c.channel_id, c.channel_name)
SELECT *, CASE WHEN total_views = 1 THEN 'Discovery'
    WHEN total_views BETWEEN 2 AND 5 THEN 'Casual'
    WHEN total_views BETWEEN 6 AND 20 AND active_days >= 3 THEN 'Regular'
    WHEN total_views > 20 AND active_days >= 7 AND span_days >= 30 THEN 'Loyal'
    ELSE 'Casual' END AS funnel_stage FROM stats"""

SQL["latest_events"] = _with("ev", "vids", "ch") + """
SELECT e.event_id, e.watched_at, v.title, c.channel_name
FROM (SELECT * FROM ev ORDER BY watched_at DESC, event_id DESC LIMIT 5) e
JOIN vids v USING (video_id) LEFT JOIN ch c ON e.channel_id = c.channel_id"""

# -- sessions ------------------------------------------------------------------------------


def _sessions(events: str, gap: float, key: str = "") -> str:
    part = f"PARTITION BY {key}" if key else ""
    by = f"{key}, session_id" if key else "session_id"
    return f"""gaps AS (SELECT *, date_diff('microsecond',
        lag(watched_at) OVER ({part} ORDER BY watched_at, event_id), watched_at) / 60000000.0 AS gap_minutes
        FROM {events}),
    ids AS (SELECT *, CAST(sum(CASE WHEN gap_minutes IS NULL OR gap_minutes > {gap} THEN 1 ELSE 0 END)
        OVER ({part} ORDER BY watched_at, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
        FROM gaps),
    sess AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS session_video_count,
        min(watched_at) OVER (PARTITION BY {by}) AS session_start,
        max(watched_at) OVER (PARTITION BY {by}) AS session_end FROM ids)"""


_SESSION_ROWS = f"""
SELECT session_id, event_id, video_id, channel_id, watched_at, {_local('watched_at')} AS watched_at_dk,
    gap_minutes, session_video_count, session_start, session_end FROM sess"""
_SESSION_TOTALS = f"""
SELECT {{key}} session_id, count(*) AS video_count, min({_local('watched_at')}) AS session_start,
    max({_local('watched_at')}) AS session_end,
    date_diff('microsecond', min(watched_at), max(watched_at)) / 60000000.0 AS duration_minutes
FROM sess GROUP BY ALL"""

SQL["session_events"] = _with("ov") + "," + _sessions("ov", 45) + _SESSION_ROWS
SQL["session_events_short_gap"] = _with("ev") + "," + _sessions("ev", 5) + _SESSION_ROWS
SQL["session_overview"] = _with("ov") + "," + _sessions("ov", 45) + _SESSION_TOTALS.format(key="")
SQL["session_overview_short_gap"] = (
    _with("ev") + "," + _sessions("ev", 5) + _SESSION_TOTALS.format(key="")
)
SQL["viewer_sessions"] = (
    _with("vw") + "," + _sessions("vw", 45, "viewer") + _SESSION_TOTALS.format(key="viewer,")
)
SQL["stream_sessions"] = _with("vw") + "," + _sessions("vw", 45, "viewer") + """
SELECT viewer, count(*) AS video_count, min(watched_at) AS session_start,
    max(watched_at) AS session_end FROM sess GROUP BY viewer, session_id"""

_STEPS = """
, steps AS (SELECT {key} lag(channel_id) OVER (PARTITION BY {key} session_id
    ORDER BY watched_at, event_id) AS from_channel, channel_id AS to_channel FROM sess)
SELECT {key} from_channel, to_channel, count(*) AS moves FROM steps
WHERE from_channel IS NOT NULL AND to_channel IS NOT NULL GROUP BY ALL"""
SQL["channel_transitions"] = (
    _with("vw") + "," + _sessions("vw", 45, "viewer") + _STEPS.format(key="viewer,")
)
SQL["channel_transitions_global"] = (
    _with("ev") + "," + _sessions("ev", 5) + _STEPS.format(key="")
)
SQL["cooccurrence"] = _with("vw") + "," + _sessions("vw", 45, "viewer") + """
, seen AS (SELECT DISTINCT viewer, session_id, channel_id FROM sess),
focus AS (SELECT channel_id FROM vw GROUP BY 1 ORDER BY count(*) DESC, channel_id LIMIT 5)
SELECT a.channel_id AS focus_channel, b.channel_id, count(*) AS shared_sessions
FROM seen a JOIN focus USING (channel_id)
JOIN seen b ON a.viewer = b.viewer AND a.session_id = b.session_id AND a.channel_id <> b.channel_id
GROUP BY ALL"""

SQL["cooccurrence_all"] = _with("vw") + "," + _sessions("vw", 45, "viewer") + """
, seen AS (SELECT DISTINCT viewer, session_id, channel_id FROM sess)
SELECT a.channel_id, b.channel_id AS other_channel, count(*) AS shared_sessions
FROM seen a JOIN seen b ON a.viewer = b.viewer AND a.session_id = b.session_id AND a.channel_id < b.channel_id
GROUP BY ALL"""
SQL["cooccurrence_global"] = _with("ev") + "," + _sessions("ev", 5) + """
, seen AS (SELECT DISTINCT session_id, channel_id FROM sess WHERE channel_id IS NOT NULL)
SELECT a.channel_id, b.channel_id AS other_channel, count(*) AS shared_sessions
FROM seen a JOIN seen b ON a.session_id = b.session_id AND a.channel_id < b.channel_id
GROUP BY ALL"""

# -- ingest --------------------------------------------------------------------------------

SQL["record_classes"] = _with("cls") + "SELECT pos, record_class FROM cls"
SQL["class_counts"] = _with("cls") + """
SELECT count(*) AS total_raw_records, count(*) FILTER (record_class = 'ad') AS ads_filtered,
    count(*) FILTER (record_class = 'removed') AS removed_dropped,
    count(*) FILTER (record_class = 'ghost') AS ghost_videos_kept,
    count(*) FILTER (record_class = 'clean') AS clean_records FROM cls"""
SQL["parsed_records"] = _with("parsed") + "SELECT * FROM parsed"
SQL["distinct_channels"] = _with("parsed") + """
SELECT channel_name, channel_url, class_rank, file_name, pos FROM parsed
WHERE channel_name <> '' AND channel_url <> ''
QUALIFY row_number() OVER (PARTITION BY channel_name, channel_url ORDER BY class_rank, pos) = 1"""
SQL["first_per_video"] = _with("firsts") + "SELECT * FROM firsts"
SQL["ingest_channels"] = _with("chids") + "SELECT channel_id, channel_name, channel_url FROM chids"
SQL["ingest_videos"] = _with("parsed", "chids") + """
, best AS (SELECT *, watched_at < TIMESTAMP '2024-01-16' AS early FROM parsed
    QUALIFY row_number() OVER (PARTITION BY video_id
        ORDER BY watched_at >= TIMESTAMP '2024-01-16', class_rank, pos) = 1),
late AS (SELECT * FROM parsed
    QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY class_rank, pos) = 1),
chosen AS (SELECT * EXCLUDE (early) FROM best WHERE early
    UNION ALL SELECT l.* FROM late l JOIN best b USING (video_id) WHERE NOT b.early)
SELECT video_id, title, title_url, channel_id,
    CASE WHEN title IS NOT NULL THEN 'active' ELSE 'unavailable' END AS status,
    false AS has_transcript
FROM chosen LEFT JOIN chids USING (channel_name, channel_url)"""
SQL["ingest_events"] = _with("evfirst", "chids") + f"""
SELECT row_number() OVER (ORDER BY NOT early, class_rank, pos) AS event_id, video_id, channel_id,
    watched_at, CAST({_local('watched_at')} AS DATE) AS local_date
FROM evfirst LEFT JOIN chids USING (channel_name, channel_url)"""
SQL["ingest_counts"] = _with("parsed") + """
SELECT count(*) AS submitted,
    count(DISTINCT (video_id, watched_at)) FILTER (watched_at >= TIMESTAMP '2024-01-16') AS new_events,
    count(*) - count(DISTINCT (video_id, watched_at)) FILTER (watched_at >= TIMESTAMP '2024-01-16')
        AS duplicate_events FROM parsed"""
SQL["stream_ingest"] = _with("evfirst") + f"""
SELECT video_id, watched_at, channel_name, CAST({_local('watched_at')} AS DATE) AS local_date
FROM evfirst"""
SQL["etl_history"] = _with("runlog") + f"""
SELECT file_name, {_local('run_at')} AS run_at_dk, total_raw_records, ads_filtered,
    removed_dropped, new_events, CAST(0 AS BIGINT) AS duplicate_events,
    CAST(1.0 AS DOUBLE) AS duration_seconds FROM runlog"""
SQL["total_ever_watched"] = _with("ev", "cls") + """
SELECT watch_events, removed_all_time, watch_events + removed_all_time AS total_ever_watched
FROM (SELECT (SELECT count(*) FROM ev) AS watch_events,
    (SELECT count(*) FROM cls WHERE record_class = 'removed') AS removed_all_time)"""

_EXTRA = "coalesce(sum(n - 1) FILTER (n > 1), 0)"


def _unique(table: str, source: str, columns: str) -> str:
    keyed = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(","))
    return f"""SELECT '{table}' AS table_name, 'unique({columns})' AS rule,
    CAST({_EXTRA} AS BIGINT) AS violations
    FROM (SELECT count(*) AS n FROM {source} WHERE {keyed} GROUP BY {columns})"""


def _foreign(table: str, source: str, column: str, parent: str) -> str:
    return f"""SELECT '{table}', 'foreign_key({column})', count(*) FROM {source} s
    WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{column} = s.{column})"""


def _rule(table: str, source: str, rule: str, broken: str) -> str:
    return f"SELECT '{table}', {_q(rule)}, count(*) FROM {source} WHERE {broken}"


SQL["quality_violations"] = _with("ev", "vids", "cats") + """
, qe AS (SELECT * FROM ev UNION ALL
    SELECT event_id, 'v' || k, user_id, ts FROM ek WHERE event_type = 'click'),
qc AS (SELECT s_suppkey AS channel_id, s_name AS channel_name, CAST(s_nationkey AS VARCHAR) AS channel_url
    FROM supplier),
qv AS (SELECT * REPLACE (CASE WHEN status = 'private' THEN 'hidden' ELSE status END AS status) FROM vids),
qt AS (SELECT 'v' || vec_id AS video_id, CAST(label AS BIGINT) AS topic_id,
    CAST(embedding[1] AS DOUBLE) + 0.5 AS score FROM embeddings),
qn AS (SELECT 'v' || vec_id AS video_id, embedding FROM embeddings)
""" + "\nUNION ALL\n".join([
    _unique("dim_channels", "qc", "channel_id"),
    _unique("dim_channels", "qc", "channel_name,channel_url"),
    _rule("dim_channels", "qc", "not_null(channel_id)", "channel_id IS NULL"),
    _unique("dim_videos", "qv", "video_id"),
    _foreign("dim_videos", "qv", "channel_id", "qc"),
    _foreign("dim_videos", "qv", "category_id", "cats"),
    _rule("dim_videos", "qv", "not_null(video_id)", "video_id IS NULL"),
    _rule("dim_videos", "qv", "length(video_id)", "length(video_id) > 20"),
    _rule("dim_videos", "qv", "status", "status NOT IN ('active', 'unavailable', 'private')"),
    _unique("fact_watch_events", "qe", "event_id"),
    _unique("fact_watch_events", "qe", "video_id,watched_at"),
    _foreign("fact_watch_events", "qe", "video_id", "qv"),
    _foreign("fact_watch_events", "qe", "channel_id", "qc"),
    *[
        _rule("fact_watch_events", "qe", f"not_null({c})", f"{c} IS NULL")
        for c in ("event_id", "video_id", "watched_at")
    ],
    _unique("nlp_video_topics", "qt", "video_id,topic_id"),
    _foreign("nlp_video_topics", "qt", "video_id", "qv"),
    _rule("nlp_video_topics", "qt", "not_null(video_id)", "video_id IS NULL"),
    _rule("nlp_video_topics", "qt", "not_null(topic_id)", "topic_id IS NULL"),
    _rule("nlp_video_topics", "qt", "score", "score < 0 OR score > 1"),
    _unique("nlp_embeddings", "qn", "video_id"),
    _foreign("nlp_embeddings", "qn", "video_id", "qv"),
    _rule("nlp_embeddings", "qn", "not_null(video_id)", "video_id IS NULL"),
    _rule("nlp_embeddings", "qn", "size(embedding)", "len(embedding) <> 64"),
    _rule("nlp_embeddings", "qn", "embedding_or_failure", "embedding IS NULL"),
])

SQL["cascade_delete"] = """
SELECT vec_id, label FROM embeddings
WHERE vec_id IN (SELECT doc_id FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""

# -- metadata ------------------------------------------------------------------------------

SQL["iso_durations"] = """
SELECT o_orderkey,
    CASE o_orderstatus
        WHEN 'O' THEN 'PT' || (o_orderkey % 24) || 'H' || (o_custkey % 60) || 'M'
        WHEN 'F' THEN 'P' || (o_custkey % 3) || 'DT' || (o_orderkey % 60) || 'S'
        ELSE 'PT' || o_orderpriority END AS duration,
    CASE o_orderstatus
        WHEN 'O' THEN (o_orderkey % 24) * 3600 + (o_custkey % 60) * 60
        WHEN 'F' THEN (o_custkey % 3) * 86400 + o_orderkey % 60 END AS seconds
FROM orders"""

SQL["metadata_items"] = """
SELECT 'd' || doc_id AS video_id,
    CASE WHEN lang <> 'fr' AND text <> '' THEN md5(text) END AS description,
    CASE WHEN lang = 'en' THEN array_to_string(string_split(source, 'c'), '|') ELSE '' END AS tags,
    CAST(n_chars % 44 AS INTEGER) AS category_id, n_chars AS duration_seconds,
    CASE WHEN lang <> 'es' THEN n_chars END AS view_count,
    CASE WHEN lang <> 'de' THEN CAST(0 AS BIGINT) END AS like_count
FROM documents"""

SQL["apply_metadata"] = _with("enriched") + "SELECT * FROM enriched"

SQL["flip_missing"] = _with("vids", "meta") + """
SELECT video_id,
    CASE WHEN gone THEN 'unavailable' ELSE status END AS status, enriched_at,
    CASE WHEN gone THEN TIMESTAMP '2024-06-01' ELSE updated_at END AS updated_at
FROM (SELECT *, status = 'active' AND enriched_at IS NULL
    AND video_id NOT IN (SELECT video_id FROM meta) AS gone FROM vids)"""

# Own literals: a seventh of the lines is cut, a third of the batches fails.
SQL["quarantined_records"] = _with("cls") + """
SELECT CASE WHEN pos % 7 = 0 THEN 'broken' ELSE record_class END AS kind, count(*) AS n FROM cls GROUP BY 1
UNION ALL SELECT 'not JSON', count(*) FROM cls WHERE pos % 7 = 0 HAVING count(*) > 0"""

SQL["enrich_job"] = _with("vids", "meta") + """
SELECT v.video_id,
    CASE WHEN asked AND m.video_id IS NULL THEN 'unavailable' ELSE status END AS status,
    CASE WHEN asked AND m.video_id IS NOT NULL THEN TIMESTAMP '2024-06-01' ELSE enriched_at END AS enriched_at
FROM (SELECT *, status = 'active' AND enriched_at IS NULL
    AND CAST(video_id[2:] AS BIGINT) % 3 <> 1 AS asked FROM vids) v LEFT JOIN meta m USING (video_id)"""

SQL["embed_job"] = """
SELECT 'd' || doc_id AS video_id, 384 AS size, 1.0 AS norm, false AS failed FROM documents"""

SQL["enrichment_batches"] = _with("docs") + """
SELECT video_id, n AS position, CAST((n - 1) // 50 AS BIGINT) AS batch
FROM (SELECT video_id, row_number() OVER (ORDER BY video_id) AS n FROM docs WHERE lang <> 'fr')
WHERE n <= 500000"""

_FIELDS = {
    "description": "description IS NOT NULL", "tags": "tags <> ''",
    "category_id": "category_id IS NOT NULL", "duration_seconds": "duration_seconds IS NOT NULL",
    "view_count": "view_count IS NOT NULL", "like_count": "like_count IS NOT NULL",
}
SQL["field_coverage"] = _with("enriched") + "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS field, count(*) FILTER ({filled}) AS populated,
    CAST(round(CAST(count(*) FILTER ({filled}) AS DECIMAL(18, 4)) * 100 / count(*), 1) AS DOUBLE)
        AS coverage FROM enriched WHERE status = 'active'"""
    for name, filled in _FIELDS.items()
)

# -- text and vectors ----------------------------------------------------------------------


def _cleaned(column: str) -> str:
    text = f"coalesce({column}, '')"
    for pattern in (URL_PATTERN, CLOCK_PATTERN, HASHTAG_PATTERN):
        text = f"regexp_replace({text}, {_q(pattern)}, ' ', 'g')"
    for pattern in (CALL_TO_ACTION_PATTERN, SOCIAL_PATTERN):
        text = f"regexp_replace({text}, {_q(pattern)}, ' ', 'gi')"
    text = rf"regexp_replace({text}, '\s{{2,}}', ' ', 'g')"
    return rf"substr(regexp_replace({text}, '^\s+|\s+$', '', 'g'), 1, 512)"


_CTES["cleaned"] = f"SELECT *, {_cleaned('description')} AS cleaned FROM noisy"
SQL["description_texts"] = _with("cleaned") + "SELECT doc_id, cleaned FROM cleaned"
SQL["input_texts"] = _with("cleaned") + """
SELECT doc_id, concat_ws('. ', CASE WHEN lang <> 'es' THEN 'Doc ' || doc_id END,
    CASE WHEN lang <> 'de' THEN source || ', ' || lang END, nullif(cleaned, '')) AS text FROM cleaned"""
SQL["embed_candidates"] = _with("docs") + """
SELECT video_id, channel_id FROM docs
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"""
SQL["upsert_vectors"] = """
WITH v AS (SELECT 'd' || vec_id AS video_id, embedding, label FROM embeddings),
l AS (SELECT 'd' || doc_id AS video_id, quality FROM labels)
SELECT coalesce(v.video_id, l.video_id) AS video_id,
    CASE WHEN v.video_id IS NULL OR l.quality = 1 THEN 'm2' ELSE 'm1' END AS model_name,
    CASE WHEN v.video_id IS NULL OR l.quality = 1 THEN 'v2' ELSE 'v1' END AS model_version,
    CASE WHEN v.video_id IS NULL OR l.quality = 1 THEN TIMESTAMP '2024-06-01'
        ELSE TIMESTAMP '2024-01-01' END AS created_at,
    CASE WHEN l.quality = 1 THEN NULL WHEN l.quality = 0 THEN TIMESTAMP '2024-06-01'
        WHEN v.label = 3 THEN TIMESTAMP '2024-01-02' END AS embed_failed_at,
    round(CAST(CASE WHEN l.quality = 1 THEN -v.embedding[1] ELSE v.embedding[1] END AS DOUBLE), 6)
        AS first_value
FROM v FULL JOIN l ON v.video_id = l.video_id
WHERE v.video_id IS NOT NULL OR l.quality = 0"""
SQL["cosine_topk"] = """
WITH scored AS (SELECT a.vec_id AS query, b.vec_id AS neighbour,
    round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS rank
    FROM scored)
SELECT query, neighbour, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 5"""

# Edges in order, each taken if it joins two parts; the parts are kept as one list.
SQL["density_forest"] = """
WITH RECURSIVE scored AS (SELECT a.vec_id AS query, b.vec_id AS neighbour,
    round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (SELECT query, neighbour, round(1 - cosine, 9) AS d,
    row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS rank FROM scored),
core AS (SELECT query AS id, max(d) AS core FROM near WHERE rank <= 3 GROUP BY query),
pairs AS (SELECT least(query, neighbour) AS a, greatest(query, neighbour) AS b, min(d) AS d FROM near WHERE rank <= 6 GROUP BY 1, 2),
edges AS (SELECT a, b, greatest(d, x.core, y.core) AS w, row_number() OVER (ORDER BY greatest(d, x.core, y.core), a, b) AS i
    FROM pairs JOIN core x ON x.id = a JOIN core y ON y.id = b),
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings),
steps AS (SELECT i, p.k AS ka, q.k AS kb FROM edges JOIN ids p ON p.vec_id = a JOIN ids q ON q.vec_id = b),
walk AS (
    SELECT 0::BIGINT AS i, (SELECT list(k ORDER BY k) FROM ids) AS part, false AS taken
    UNION ALL
    SELECT s.i, CASE WHEN part[ka] <> part[kb] THEN list_transform(part, lambda x: CASE WHEN x = part[kb] THEN part[ka] ELSE x END)
        ELSE part END, part[ka] <> part[kb]
    FROM walk JOIN steps s ON s.i = walk.i + 1)
SELECT a, b, round(w, 6) AS w FROM edges JOIN walk USING (i) WHERE taken"""

# -- language ------------------------------------------------------------------------------


def _script(column: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({column}, {_q(p)}) THEN '{code}'" for code, p in SCRIPT_PATTERNS
    )
    return f"CASE {whens} END"


_TITLES = """tt AS (SELECT channel_id, source, text AS title, CAST(row_number() OVER (
    PARTITION BY channel_id ORDER BY watched_at DESC, doc_id DESC) AS INTEGER) AS pos
    FROM docs WHERE text <> ''),
titles AS (SELECT * FROM tt WHERE pos <= 20)"""
_CODES = ", ".join(_q(c) for c in LANGUAGE_CODES)

SQL["script_languages"] = f"SELECT doc_id, {_script('text')} AS lang FROM documents"
SQL["recent_titles"] = _with("docs") + f", {_TITLES} SELECT channel_id, md5(title) AS title, pos FROM titles"
SQL["channel_language_review"] = _with("docs") + f"""
, {_TITLES},
votes AS (SELECT channel_id, {_script('title')} AS lang, count(*) AS n, min(pos) AS p
    FROM titles GROUP BY 1, 2 HAVING lang IS NOT NULL),
win AS (SELECT channel_id, lang FROM votes
    QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY n DESC, p) = 1),
chan AS (SELECT channel_id, source AS channel_name, count(*) AS total_views,
    channel_id % 5 = 0 AS human FROM docs GROUP BY channel_id, source HAVING count(*) >= 10),
base AS (SELECT c.*, coalesce({_script('channel_name')}, w.lang) AS script,
    CASE WHEN channel_id % 3 = 0 THEN 'fr' END AS guess FROM chan c LEFT JOIN win w USING (channel_id)),
det AS (SELECT *, CASE WHEN human THEN 'en' ELSE script END AS u,
    CASE WHEN human THEN 'en' WHEN script IS NULL THEN guess END AS m FROM base)
SELECT channel_id, channel_name, total_views, CASE WHEN human THEN 'en' ELSE '' END AS existing_language,
    CASE WHEN human THEN 'human' ELSE '' END AS existing_source, coalesce(u, '') AS unicode_detected,
    coalesce(m, '') AS mistral_guess,
    CASE WHEN human THEN 'already_human' WHEN script IS NOT NULL THEN 'unicode'
        WHEN guess IS NOT NULL THEN 'mistral' ELSE 'none' END AS detection_method,
    coalesce(u, m, '') AS primary_language, '' AS notes FROM det"""

_REVIEW = f"""rev AS (SELECT doc_id AS channel_id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'zz'
        WHEN 2 THEN 'da' ELSE lang END AS lang,
    coalesce({_script('text')}, '') AS u, CASE WHEN n_chars % 2 = 0 THEN lang ELSE '' END AS m,
    doc_id % 11 = 0 AS done FROM documents),
src AS (SELECT channel_id, lang, CASE WHEN lang NOT IN ({_CODES}) OR done THEN NULL
    WHEN lang <> (CASE WHEN u <> '' THEN u ELSE m END) THEN 'human'
    WHEN lang = u THEN 'unicode' ELSE 'mistral' END AS source FROM rev)"""
SQL["language_import"] = f"""WITH {_REVIEW}
SELECT channel_id, lang AS primary_language, source AS language_source FROM src"""
SQL["language_apply"] = f"""WITH {_REVIEW}
SELECT d.doc_id AS channel_id,
    CASE WHEN s.source IS NOT NULL THEN s.lang WHEN d.lang = 'en' THEN 'no' END AS primary_language,
    CASE WHEN s.source IS NOT NULL THEN s.source WHEN d.lang = 'en' THEN 'human' END AS language_source
FROM documents d JOIN src s ON d.doc_id = s.channel_id"""

# -- topics --------------------------------------------------------------------------------

_stop = ", ".join(_q(w) for w in STOP_WORDS)
_KEYWORDS = rf"""tdocs AS (SELECT CAST(doc_id % 10 AS INTEGER) AS topic, doc_id AS vec_id, text, source
    FROM documents),
words AS (SELECT topic, vec_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}_]{{2,}}'),
    lambda x: x NOT IN ({_stop})) AS w FROM tdocs),
occ AS (SELECT topic, vec_id, unnest(w) AS term FROM words
    UNION ALL SELECT topic, vec_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
    FROM words WHERE len(w) > 1),
overall AS (SELECT term, count(*) AS f FROM occ GROUP BY term HAVING count(DISTINCT vec_id) >= 2),
freq AS (SELECT topic, term, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM overall) GROUP BY ALL),
mean AS (SELECT avg(s) AS a FROM (SELECT sum(tf) AS s FROM freq GROUP BY topic)),
kw AS (SELECT topic, term, round(tf * ln(1 + (SELECT a FROM mean) / f), 6) AS weight
    FROM freq JOIN overall USING (term)),
top AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM kw
    QUALIFY rank <= 15)"""
_MEMBERS = """members AS (SELECT label AS topic, 'd' || vec_id AS video_id, vec_id,
    CASE WHEN vec_id % 3 <> 0 THEN CAST(vec_id % 7 * 5 AS INTEGER) END AS category_id FROM embeddings),
winner AS (SELECT topic, category_id FROM members WHERE category_id IS NOT NULL GROUP BY topic, category_id
    QUALIFY row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, min(video_id)) = 1)"""
_LABELS = r"""given AS (SELECT topic, min(source) AS s FROM tdocs GROUP BY topic),
labels_ AS (SELECT topic, CASE WHEN topic % 3 = 0 THEN 'Label ' || any_value(s)
    ELSE array_to_string(list(array_to_string(list_transform(
        regexp_extract_all(term, '\p{L}+|[^\p{L}]+'), lambda y: upper(y[1]) || y[2:]), '')
        ORDER BY rank) FILTER (rank <= 4), ' / ') END AS topic_label,
    array_to_string(list(term ORDER BY rank) FILTER (rank <= 10), ', ') AS keywords
    FROM top JOIN given USING (topic) GROUP BY topic)"""

SQL["topic_keywords"] = f"WITH {_KEYWORDS} SELECT topic, term, weight, CAST(rank AS INTEGER) AS rank FROM top"
SQL["topic_category"] = _with("cats") + f""", {_MEMBERS}
SELECT topic, w.category_id, coalesce(category_name, 'Unknown') AS category_name
FROM (SELECT DISTINCT topic FROM members) LEFT JOIN winner w USING (topic) LEFT JOIN cats USING (category_id)"""
SQL["topic_language"] = _with("docs") + f""", {_MEMBERS},
lang AS (SELECT m.topic, m.video_id, CASE WHEN d.channel_id % 5 = 0 THEN 'en'
    WHEN d.channel_id % 2 = 0 THEN 'de' END AS language FROM members m JOIN docs d USING (video_id))
SELECT topic, language FROM lang WHERE language IS NOT NULL GROUP BY topic, language
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, min(video_id)) = 1"""
SQL["topic_labels"] = f"WITH {_KEYWORDS}, {_LABELS} SELECT topic, topic_label FROM labels_"
SQL["topic_reports"] = _with("cats") + f""", {_KEYWORDS}, {_LABELS}, {_MEMBERS}
SELECT topic AS topic_id, topic_label, coalesce(category_name, 'Unassigned') AS category,
    video_count, keywords
FROM labels_ JOIN (SELECT topic, count(*) AS video_count FROM members GROUP BY 1) USING (topic)
LEFT JOIN winner USING (topic) LEFT JOIN cats USING (category_id)"""
SQL["assign_topics"] = """
WITH means AS (SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS m
    FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL),
centre AS (SELECT CAST(label AS BIGINT) AS topic_id, list(m ORDER BY i) AS c FROM means GROUP BY label),
scored AS (SELECT 'd' || vec_id AS video_id, topic_id,
    round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 9) AS cosine
    FROM embeddings CROSS JOIN centre)
SELECT video_id, CASE WHEN cosine >= 0.2 THEN topic_id END AS topic_id, round(cosine, 6) AS cosine
FROM scored QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY cosine DESC, topic_id) = 1"""
SQL["new_assignments"] = """
SELECT 'd' || vec_id AS video_id, CAST(label AS BIGINT) AS topic_id, CAST(1.0 AS DOUBLE) AS score
FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)"""

# -- further questions ---------------------------------------------------------------------

SQL["streaks"] = _with("ov") + f"""
, days AS (SELECT DISTINCT CAST({_local('watched_at')} AS DATE) AS day FROM ov),
isl AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM days)
SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM isl GROUP BY island"""
SQL["rolling_avg"] = _with("ov", "odd") + f"""
, daily AS ({_daily('ov', 'odd')})
SELECT date_key, videos_watched, round(avg(videos_watched) OVER (
    ORDER BY date_key ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling_avg FROM daily"""
SQL["yoy"] = _with("ov", "odd") + f"""
, mon AS ({_monthly('ov', 'odd', '1995-01-01')})
SELECT a.year, a.month, a.total_views, b.total_views AS views_before,
    a.total_views - b.total_views AS change,
    CAST(round((a.total_views - b.total_views) * 100.0 / nullif(b.total_views, 0), 2) AS DOUBLE)
        AS change_pct
FROM mon a LEFT JOIN mon b ON a.year = b.year + 1 AND a.month = b.month"""
SQL["rewatches"] = _with("ov") + """
SELECT video_id, count(*) AS views, min(watched_at) AS first_watch, max(watched_at) AS last_watch,
    round(date_diff('microsecond', min(watched_at), max(watched_at)) / 86400000000.0, 6) AS span_days
FROM ov GROUP BY video_id HAVING count(*) > 1"""


def _shares(group: str, value_group: str) -> str:
    return f"""SELECT *, round(views / sum(views) OVER (PARTITION BY {group}), 6) AS share FROM (
    SELECT {value_group}, CAST(regexp_extract(video_id, '([0-9]+)', 1) AS BIGINT) % 6 AS topic_id,
    count(*) AS views FROM ev WHERE {group} IS NOT NULL GROUP BY ALL)"""


SQL["channel_topics"] = _with("ev") + _shares("channel_id", "channel_id")
SQL["topic_share"] = _with("ev") + _shares(
    "period", f"strftime({_local('watched_at')}, '%Y-%m') AS period"
).replace("WHERE period IS NOT NULL ", "")
SQL["length_mix"] = _with("ev", "vids") + f"""
SELECT strftime({_local('e.watched_at')}, '%Y-%m') AS period,
    CASE WHEN duration_seconds IS NULL THEN 'unknown' WHEN duration_seconds <= 60 THEN 'short'
        WHEN duration_seconds <= 1200 THEN 'medium' ELSE 'long' END AS length_class,
    count(*) AS views, round(CAST(sum(duration_seconds) AS DOUBLE) / count(*), 4) AS mean_seconds
FROM ev e JOIN vids v USING (video_id) GROUP BY 1, 2"""
SQL["category_gaps"] = _with("ev", "vids", "cats") + """
SELECT category_id, category_name FROM cats WHERE category_id NOT IN (
    SELECT v.category_id FROM ev e JOIN vids v USING (video_id))"""
SQL["category_views"] = _with("ev", "vids", "cats") + """
SELECT c.category_id, c.category_name, count(e.event_id) AS views
FROM cats c LEFT JOIN (SELECT e.event_id, v.category_id FROM ev e JOIN vids v USING (video_id)) e
    ON c.category_id = e.category_id GROUP BY ALL"""
SQL["daytype"] = _with("ov", "odd") + f"""
, daily AS ({_daily('ov', 'odd')})
SELECT is_weekend, season, is_danish_holiday, count(*) AS days,
    CAST(sum(videos_watched) AS BIGINT) AS views, round(avg(videos_watched), 4) AS views_per_day
FROM daily GROUP BY ALL"""
SQL["top_channels"] = _with("ov", "och", "odd") + f"""
, cm AS ({_CHANNEL_MONTH.format(ev='ov', ch='och', dd='odd', local=_local('e.watched_at'))})
SELECT year, month, channel_id, views, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY views DESC, channel_id) AS rank FROM cm)
WHERE rank <= 5"""
SQL["row_counts"] = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}"
    for n in (
        "region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations"
    ).split()
)
