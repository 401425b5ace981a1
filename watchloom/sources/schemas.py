"""Table layouts. Times are UTC without zone; lengths and sizes are checked in ``quality``."""

from __future__ import annotations

# Export record; ``details`` and ``subtitles`` vary in shape, so they are read as VARIANT.
EXPORT_RECORD = "title string, titleUrl string, time string, details variant, subtitles variant"
# Where the readers put text that is no JSON.
BROKEN = "_corrupt_record"

# One landed metadata response.
METADATA_RESPONSE = """
items array<struct<
    id: string,
    snippet: struct<description: string, tags: array<string>, categoryId: string>,
    contentDetails: struct<duration: string>,
    statistics: struct<viewCount: string, likeCount: string>>>
"""

TABLES = {
    "dim_channels": """
        channel_id bigint, channel_name string, channel_url string, created_at timestamp_ntz,
        primary_language string, language_source string""",
    "dim_categories": "category_id int, category_name string",
    "dim_date": """
        date_key date, year int, quarter int, month int, month_name string, week_of_year int,
        day_of_month int, day_of_week_num int, day_of_week string, is_weekend boolean,
        season string, is_danish_holiday boolean""",
    "dim_videos": """
        video_id string, title string, title_url string, channel_id bigint, status string,
        description string, tags array<string>, category_id int, duration_seconds bigint,
        view_count bigint, like_count bigint, has_transcript boolean,
        enriched_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz""",
    "fact_watch_events": """
        event_id bigint, video_id string, channel_id bigint, watched_at timestamp_ntz,
        local_date date, local_month date""",
    "quarantine_events": """
        video_id string, channel_name string, channel_url string, file_name string,
        pos bigint, reason string""",
    "nlp_topics": """
        topic_id bigint, topic_label string, keywords array<string>, model_name string,
        model_version string, created_at timestamp_ntz, category_id int, video_count bigint""",
    "nlp_video_topics": "video_id string, topic_id bigint, score double",
    "nlp_embeddings": """
        video_id string, embedding array<float>, model_name string, model_version string,
        created_at timestamp_ntz, embed_failed_at timestamp_ntz""",
    "topic_map": """
        model_topic int, topic_id bigint, centroid array<double>, radius double""",
    "topic_map_info": "name string, value string",
    "etl_log": """
        file_name string, run_at timestamp_ntz, total_raw_records bigint, ads_filtered bigint,
        removed_dropped bigint, ghost_videos_kept bigint, clean_records bigint,
        new_channels bigint, new_videos bigint, new_events bigint, duplicate_events bigint,
        broken_records bigint, duration_seconds double""",
    "enrichment_log": """
        run_at timestamp_ntz, videos_targeted bigint, videos_enriched bigint,
        videos_flipped bigint, api_units_used bigint, duration_seconds double""",
    "embed_log": """
        run_at timestamp_ntz, model_name string, model_version string, videos_targeted bigint,
        videos_embedded bigint, videos_failed bigint, videos_skipped bigint,
        duration_seconds double""",
    "topic_log": """
        run_at timestamp_ntz, run_mode string, model_name string, model_version string,
        videos_processed bigint, videos_assigned bigint, videos_outlier bigint,
        topics_created bigint, topics_total bigint, duration_seconds double""",
}

# Column by which a table's files are laid out in folders. Months, since the days of one
# person's history would be thousands of tiny files.
PARTITION_COLUMN = {"fact_watch_events": "local_month"}
# Column by which files are sorted, so that their statistics narrow a scan down to days.
SORT_COLUMN = {"fact_watch_events": "local_date"}
