"""One function per query; each takes the fixtures and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import Tables

from watchloom.functions.metadata import iso_seconds
from watchloom.functions.text import clean_description, input_text, script_language
from watchloom.operators import quality
from watchloom.operators.encoders import HashedTermsEncoder
from watchloom.operators.neighbours import similar
from watchloom.operators.sessions import (
    session_channels,
    session_summary,
    sessions,
    transitions,
)
from watchloom.operators import density
from watchloom.operators.graph import spanning_forest
from watchloom.operators.vector_index import VectorIndex
from watchloom.operators.upserts import append_assignments, cascade, flag_failed, upsert_embeddings
from watchloom.plans import embedding, enrichment, ingest, insights, language, topics, views
from watchloom.session import materialize, scratch_path
from watchloom.sources.dims import dim_categories
from watchloom.sources.export import normalize_metadata, read_export
from watchloom.sources.review import topic_report
from watchloom.sources.store import Store
from watchloom.streaming.ingest import stream_exports
from watchloom.streaming.sessions import viewer_sessions as stream_viewer_sessions
from watchloom.streaming.sessions import write_sessions

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def bound() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        return lambda spark, sf_dir: f(Tables(spark, sf_dir))

    return {name: bind(f) for name, f in QUERIES.items()}


def _now():
    return F.lit("2024-06-01").cast("timestamp_ntz")


# -- dimensions and views ------------------------------------------------------------------


@query
def dim_date(t: Tables) -> DataFrame:
    return t.dates_of(t.order_events())


@query
def watch_history(t: Tables) -> DataFrame:
    e = t.events()
    return views.watch_history(
        e, t.videos(), t.channels_of(e), dim_categories(t.spark), t.dates_of(e)
    )


@query
def channel_loyalty(t: Tables) -> DataFrame:
    e = t.events()
    return views.channel_loyalty(e, t.channels_of(e), t.videos())


@query
def discovery_events(t: Tables) -> DataFrame:
    e = t.events()
    return views.discovery_events(e, t.channels_of(e))


@query
def daily_summary(t: Tables) -> DataFrame:
    e = t.events()
    return views.daily_summary(e, t.dates_of(e), t.as_of(e))


@query
def monthly_summary(t: Tables) -> DataFrame:
    e = t.order_events()
    out = views.monthly_summary(e, t.dates_of(e), t.as_of(e), since="1995-01-01")
    average = F.col("avg_videos_per_active_day").cast("double")
    return out.withColumn("avg_videos_per_active_day", average)


@query
def channel_monthly(t: Tables) -> DataFrame:
    e = t.events()
    return views.channel_monthly(e, t.channels_of(e), t.dates_of(e))


@query
def hourly_distribution(t: Tables) -> DataFrame:
    e = t.events()
    return views.hourly_distribution(e, t.dates_of(e))


@query
def channel_funnel(t: Tables) -> DataFrame:
    e = t.order_events()
    return views.channel_funnel(e, t.channels_of(e)).withColumn(
        "span_days", F.round("span_days", 6)
    )


@query
def latest_events(t: Tables) -> DataFrame:
    e = t.events()
    return insights.latest_events(e, t.videos(), t.channels_of(e))


# -- sessions ------------------------------------------------------------------------------


@query
def session_events(t: Tables) -> DataFrame:
    return sessions(t.order_events())


@query
def session_events_short_gap(t: Tables) -> DataFrame:
    return sessions(t.events(), gap_minutes=5)


@query
def session_overview(t: Tables) -> DataFrame:
    return session_summary(t.order_events())


@query
def session_overview_short_gap(t: Tables) -> DataFrame:
    return session_summary(t.events(), gap_minutes=5)


@query
def viewer_sessions(t: Tables) -> DataFrame:
    return session_summary(t.viewer_events(), keys=["viewer"])


@query
def stream_sessions(t: Tables) -> DataFrame:
    schema = t.read("events").schema
    stream = (
        t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    )
    events = stream.select(F.col("user_id").alias("viewer"), F.col("ts").alias("watched_at"))
    out = scratch_path(t.spark, "stream-sessions")
    q = write_sessions(
        stream_viewer_sessions(events), f"{out}/sessions", f"{out}/checkpoint", mode="complete"
    )
    q.awaitTermination()
    return t.spark.read.parquet(f"{out}/sessions")


@query
def channel_transitions(t: Tables) -> DataFrame:
    return transitions(t.viewer_events(), keys=["viewer"])


@query
def channel_transitions_global(t: Tables) -> DataFrame:
    return transitions(t.events(), gap_minutes=5)


@query
def cooccurrence(t: Tables) -> DataFrame:
    e = t.viewer_events()
    shared = session_channels(e, keys=["viewer"])
    return insights.cooccurrence(shared, insights.top_channels_overall(e, 5), keys=["viewer"])


@query
def cooccurrence_all(t: Tables) -> DataFrame:
    shared = session_channels(t.viewer_events(), keys=["viewer"])
    return insights.all_cooccurrence(shared, keys=["viewer"])


@query
def cooccurrence_global(t: Tables) -> DataFrame:
    """One viewer: sessions are those of all events."""
    return insights.all_cooccurrence(session_channels(t.events(), gap_minutes=5))


# -- ingest --------------------------------------------------------------------------------


@query
def record_classes(t: Tables) -> DataFrame:
    return ingest.classify(t.records()).select("pos", "record_class")


@query
def class_counts(t: Tables) -> DataFrame:
    return ingest.class_counts(ingest.classify(t.records()))


@query
def parsed_records(t: Tables) -> DataFrame:
    return ingest.parse(t.records())


@query
def distinct_channels(t: Tables) -> DataFrame:
    return ingest.distinct_channels(ingest.parse(t.records()))


@query
def first_per_video(t: Tables) -> DataFrame:
    return ingest.first_per_video(ingest.parse(t.records()))


def _two_loads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parsed records of a first export and of the one after it, which repeats the first."""
    return ingest.kept(ingest.land(t.first_export())), ingest.kept(ingest.land(t.records()))


def _channels_after_two(t: Tables, one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Channels after the first export, and after both."""
    empty = t.spark.createDataFrame(
        [], "channel_id bigint, channel_name string, channel_url string"
    )
    columns = ["channel_id", "channel_name", "channel_url"]
    first = ingest.new_channels(empty, one, 0, _now()).select(*columns)
    last = first.agg(F.max("channel_id")).scalar()
    more = ingest.new_channels(first, two, last, _now()).select(*columns)
    return first, first.unionByName(more)


@query
def ingest_channels(t: Tables) -> DataFrame:
    return _channels_after_two(t, *_two_loads(t))[1]


@query
def ingest_videos(t: Tables) -> DataFrame:
    one, two = _two_loads(t)
    first_channels, channels = _channels_after_two(t, one, two)
    empty = t.spark.createDataFrame([], "video_id string")
    stored = ingest.new_videos(empty, one, first_channels, _now())
    more = ingest.new_videos(stored, two, channels, _now())
    return stored.unionByName(more).select(
        "video_id", "title", "title_url", "channel_id", "status", "has_transcript"
    )


@query
def ingest_events(t: Tables) -> DataFrame:
    one, two = _two_loads(t)
    first_channels, channels = _channels_after_two(t, one, two)
    empty = t.spark.createDataFrame([], "video_id string, watched_at timestamp_ntz")
    stored = ingest.new_events(empty, one, first_channels, 0)
    last = stored.agg(F.max("event_id")).scalar()
    more = ingest.new_events(stored, two, channels, last)
    return stored.unionByName(more).drop("local_month")


@query
def ingest_counts(t: Tables) -> DataFrame:
    one, two = _two_loads(t)
    return ingest.event_counts(one.select("video_id", "watched_at").distinct(), two)


@query
def stream_ingest(t: Tables) -> DataFrame:
    """Daily exports, landed as files and loaded as a stream."""
    landing = scratch_path(t.spark, "exports")
    t.records().select("title", "titleUrl", "time", "details", "subtitles").write.json(landing)
    store = Store(t.spark, scratch_path(t.spark, "store"))
    stream_exports(
        store, landing, scratch_path(t.spark, "stream-ingest"), lines=True
    ).awaitTermination()
    events = store.read("fact_watch_events")
    channels = store.read("dim_channels").select("channel_id", "channel_name")
    return events.join(channels, "channel_id", "left").select(
        "video_id", "watched_at", "channel_name", "local_date"
    )


def _daily_log(t: Tables) -> DataFrame:
    """A run log with one export per day."""
    kind = F.col("record_class")
    day = F.to_date("ts")
    return ingest.classify(t.records()).groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("total_raw_records"),
        F.count_if(kind == "ad").alias("ads_filtered"),
        F.count_if(kind == "removed").alias("removed_dropped"),
        F.count_if(kind.isin("clean", "ghost")).alias("new_events"),
    ).select(
        F.concat(F.lit("export-"), F.col("day").cast("string")).alias("file_name"),
        (F.col("day").cast("timestamp_ntz") + F.expr("interval 12 hours")).alias("run_at"),
        "total_raw_records", "ads_filtered", "removed_dropped", "new_events",
        F.lit(0).cast("bigint").alias("duplicate_events"),
        F.lit(1.0).alias("duration_seconds"),
    )


@query
def etl_history(t: Tables) -> DataFrame:
    return views.etl_history(_daily_log(t))


@query
def total_ever_watched(t: Tables) -> DataFrame:
    return ingest.total_ever_watched(t.events(), _daily_log(t))


@query
def quality_violations(t: Tables) -> DataFrame:
    """The events with their clicks loaded twice, against customers' and parts' keys."""
    e = t.events()
    clicks = t.keyed_events().where("event_type = 'click'").select(
        "event_id",
        F.concat(F.lit("v"), "k").alias("video_id"),
        F.col("user_id").alias("channel_id"),
        F.col("ts").alias("watched_at"),
    )
    channels = t.read("supplier").select(
        F.col("s_suppkey").alias("channel_id"),
        F.col("s_name").alias("channel_name"),
        F.col("s_nationkey").cast("string").alias("channel_url"),
    )
    videos = t.videos().withColumn(
        "status", F.when(F.col("status") == "private", "hidden").otherwise(F.col("status"))
    )
    assignments = t.vectors().select(
        F.regexp_replace("video_id", "^d", "v").alias("video_id"),
        F.col("label").cast("bigint").alias("topic_id"),
        (F.element_at("embedding", 1).cast("double") + 0.5).alias("score"),
    )
    stored = t.vectors().select(
        F.regexp_replace("video_id", "^d", "v").alias("video_id"), "embedding",
        F.lit(None).cast("timestamp_ntz").alias("embed_failed_at"),
    )
    return quality.check_schema(
        e.unionByName(clicks), videos, channels, dim_categories(t.spark),
        None, assignments, stored, dim=64,
    )


@query
def cascade_delete(t: Tables) -> DataFrame:
    """Embeddings left after the videos of toxic documents are gone."""
    toxic = t.read("labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    left = t.documents().select(F.col("doc_id").alias("vec_id")).join(toxic, "vec_id", "left_anti")
    return cascade(t.vectors().select("vec_id", "label"), left, "vec_id")


# -- metadata ------------------------------------------------------------------------------


@query
def iso_durations(t: Tables) -> DataFrame:
    o = t.read("orders")
    text = (
        F.when(
            F.col("o_orderstatus") == "O",
            F.concat(F.lit("PT"), F.col("o_orderkey") % 24, F.lit("H"), F.col("o_custkey") % 60, F.lit("M")),
        )
        .when(
            F.col("o_orderstatus") == "F",
            F.concat(F.lit("P"), F.col("o_custkey") % 3, F.lit("DT"), F.col("o_orderkey") % 60, F.lit("S")),
        )
        .otherwise(F.concat(F.lit("PT"), "o_orderpriority"))
    )
    return o.select("o_orderkey", text.alias("duration")).withColumn(
        "seconds", iso_seconds(F.col("duration"))
    )


@query
def metadata_items(t: Tables) -> DataFrame:
    d = t.read("documents")
    item = F.struct(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.struct(
            F.when(F.col("lang") != "fr", F.col("text")).otherwise("").alias("description"),
            F.when(F.col("lang") == "en", F.split("source", "c")).alias("tags"),
            (F.col("n_chars") % 44).cast("string").alias("categoryId"),
        ).alias("snippet"),
        F.struct(F.concat(F.lit("PT"), "n_chars", F.lit("S")).alias("duration")).alias("contentDetails"),
        F.struct(
            F.when(F.col("lang") != "es", F.col("n_chars").cast("string")).alias("viewCount"),
            F.when(F.col("lang") != "de", F.lit("0")).alias("likeCount"),
        ).alias("statistics"),
    )
    out = normalize_metadata(d.select(item.alias("item")))
    return out.withColumns({
        "description": F.md5("description"), "tags": F.array_join("tags", "|"),
    })


def _enriched(t: Tables) -> DataFrame:
    return enrichment.apply_metadata(t.videos(), t.metadata(), _now())


@query
def apply_metadata(t: Tables) -> DataFrame:
    return _enriched(t).withColumn("tags", F.array_join("tags", "|")).drop(
        "title_url", "has_transcript"
    )


@query
def flip_missing(t: Tables) -> DataFrame:
    v = t.videos()
    attempted = enrichment.candidates(v).select("video_id")
    return enrichment.flip_missing(v, attempted, t.metadata(), _now()).select(
        "video_id", "status", "enriched_at", "updated_at"
    )


@query
def enrichment_batches(t: Tables) -> DataFrame:
    v = t.documents().select(
        "video_id",
        F.when(F.col("lang") != "fr", "active").otherwise("private").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("enriched_at"),
    )
    return enrichment.request_batches(v)


@query
def field_coverage(t: Tables) -> DataFrame:
    return enrichment.field_coverage(_enriched(t)).withColumn(
        "coverage", F.col("coverage").cast("double")
    )


# -- text and vectors ----------------------------------------------------------------------


@query
def description_texts(t: Tables) -> DataFrame:
    return t.noisy_documents().select(
        "doc_id", clean_description(F.col("description")).alias("cleaned")
    )


@query
def input_texts(t: Tables) -> DataFrame:
    tags = F.array(F.col("source"), F.lit("  "), F.concat(F.lit(" "), F.col("lang"), F.lit(" ")))
    title = F.when(F.col("lang") != "es", F.concat(F.lit(" Doc "), "doc_id"))
    return t.noisy_documents().select(
        "doc_id",
        input_text(title, F.when(F.col("lang") != "de", tags), F.col("description")).alias("text"),
    )


@query
def embed_candidates(t: Tables) -> DataFrame:
    return embedding.candidates(t.doc_videos(), t.vectors()).select("video_id", "channel_id")


@query
def upsert_vectors(t: Tables) -> DataFrame:
    """Stored vectors, a re-embedding of some documents, failures of others."""
    v = t.vectors()
    old = v.select(
        "video_id", "embedding", F.lit("m1").alias("model_name"), F.lit("v1").alias("model_version"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("label") == 3, F.lit("2024-01-02").cast("timestamp_ntz")).alias("embed_failed_at"),
    )
    labelled = t.read("labels").select(
        F.concat(F.lit("d"), "doc_id").alias("video_id"), "quality"
    )
    fresh = labelled.where("quality = 1").join(
        v.select("video_id", F.transform("embedding", lambda x: -x).alias("embedding")), "video_id"
    ).select(
        "video_id", "embedding", F.lit("m2").alias("model_name"), F.lit("v2").alias("model_version"),
        _now().alias("created_at"),
    )
    failed = labelled.where("quality = 0").select("video_id")
    out = flag_failed(upsert_embeddings(old, fresh), failed, "m2", "v2", _now())
    return out.select(
        "video_id", "model_name", "model_version", "created_at", "embed_failed_at",
        F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_value"),
    )


@query
def cosine_topk(t: Tables) -> DataFrame:
    v = t.vectors().select("vec_id", "embedding")
    return similar(v, v, 5, key="vec_id").withColumn("cosine", F.round("cosine", 6))


@query
def indexed_topk(t: Tables) -> DataFrame:
    """Through the inverted file; these vectors have little structure, so most cells are probed."""
    v = t.vectors().select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex.build(v, scratch_path(t.spark, "vector-index"), cells=16)
    return index.search(v, 5, probes=13).withColumn("cosine", F.round("cosine", 6))


@query
def density_forest(t: Tables) -> DataFrame:
    """The minimum spanning forest of mutual reachability, which density topics are read from."""
    edges, _ = density.reachability(t.vectors().select(F.col("vec_id").alias("id"), "embedding"), 6, 3)
    return spanning_forest(edges).withColumn("w", F.round("w", 6))


@query
def density_topics(t: Tables) -> DataFrame:
    found, _ = density.density_clusters(t.vectors().select(F.col("vec_id").alias("id"), "embedding"), min_size=5, samples=3)
    return found.select("id", "topic", F.round("density", 6).alias("density"), F.round("strength", 6).alias("strength"))


@query
def embed_job(t: Tables) -> DataFrame:
    texts = t.noisy_documents().select(
        "video_id",
        input_text(F.col("source"), F.array("lang"), F.col("description")).alias("text"),
    )
    # Read by the fit and by the encoding.
    texts = materialize(texts, "texts")
    found = embedding.embed(texts, HashedTermsEncoder.fit(texts))
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return found.select(
        "video_id", F.size("embedding").alias("size"), F.round(F.sqrt(length), 4).alias("norm"),
        F.col("embedding").isNull().alias("failed"),
    )


@query
def fit_topics(t: Tables) -> DataFrame:
    return topics.fit_topics(t.vectors().select("video_id", "embedding"), k=10)[0]


# -- language ------------------------------------------------------------------------------


@query
def script_languages(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", script_language(F.col("text")).alias("lang"))


def _titles(t: Tables) -> DataFrame:
    return language.recent_titles(t.doc_videos(), t.doc_events())


@query
def recent_titles(t: Tables) -> DataFrame:
    return _titles(t).withColumn("title", F.md5("title"))


@query
def channel_language_review(t: Tables) -> DataFrame:
    channels = t.doc_channels()
    funnel = views.channel_funnel(t.doc_events(), channels)
    answers = F.when(F.col("channel_id") % 3 == 0, "Code: fr").when(
        F.col("channel_id") % 3 == 1, "xx, or it"
    )
    guesses = channels.select("channel_id", answers.alias("answer"))
    return language.channel_language_review(channels, funnel, _titles(t), guesses)


def _reviewed(t: Tables) -> DataFrame:
    """A review file with one row per document."""
    d = t.documents()
    chosen = (
        F.when(F.col("doc_id") % 7 == 0, "")
        .when(F.col("doc_id") % 7 == 1, "zz")
        .when(F.col("doc_id") % 7 == 2, "da")
        .otherwise(F.concat(F.lit(" "), F.upper("lang")))
    )
    return d.select(
        F.col("doc_id").cast("string").alias("channel_id"),
        chosen.alias("primary_language"),
        F.coalesce(script_language(F.col("text")), F.lit("")).alias("unicode_detected"),
        F.when(F.col("n_chars") % 2 == 0, F.col("lang")).otherwise("").alias("mistral_guess"),
        F.when(F.col("doc_id") % 11 == 0, "already_human").otherwise("unicode").alias("detection_method"),
    )


@query
def language_import(t: Tables) -> DataFrame:
    return language.language_source(_reviewed(t))


@query
def language_apply(t: Tables) -> DataFrame:
    channels = t.documents().select(
        F.col("doc_id").alias("channel_id"),
        F.when(F.col("lang") == "en", "no").alias("primary_language"),
        F.when(F.col("lang") == "en", "human").alias("language_source"),
    )
    return language.apply_review(channels, _reviewed(t))


# -- topics --------------------------------------------------------------------------------


def _members(t: Tables) -> DataFrame:
    return t.vectors().select(
        F.col("label").alias("topic"), "video_id",
        F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 7 * 5).cast("int").alias("category_id"),
    )


@query
def topic_keywords(t: Tables) -> DataFrame:
    return topics.topic_keywords(t.topic_documents().drop("source"))


@query
def topic_category(t: Tables) -> DataFrame:
    return topics.topic_category(_members(t), dim_categories(t.spark))


@query
def topic_language(t: Tables) -> DataFrame:
    channels = t.doc_channels().withColumn(
        "primary_language",
        F.coalesce("primary_language", F.when(F.col("channel_id") % 2 == 0, "de")),
    )
    return topics.topic_language(_members(t), topics.video_language(t.doc_videos(), channels))


def _labelled(t: Tables) -> DataFrame:
    keywords = topics.keyword_lists(topics.topic_keywords(t.topic_documents().drop("source")))
    given = t.topic_documents().groupBy("topic").agg(F.min("source").alias("s")).select(
        "topic",
        F.when(F.col("topic") % 3 == 0, F.concat(F.lit('"Label '), "s", F.lit('" ')))
        .when(F.col("topic") % 3 == 1, "I'm sorry, no").alias("label"),
    )
    return topics.topic_labels(keywords, given)


@query
def topic_labels(t: Tables) -> DataFrame:
    return _labelled(t).select("topic", "topic_label")


@query
def topic_reports(t: Tables) -> DataFrame:
    sizes = _members(t).groupBy("topic").agg(F.count(F.lit(1)).alias("video_count"))
    categories = dim_categories(t.spark)
    winners = topics.topic_category(_members(t), categories).select("topic", "category_id")
    rows = _labelled(t).join(sizes, "topic").join(winners, "topic").withColumnRenamed(
        "topic", "topic_id"
    )
    return topic_report(rows, categories)


def _map(t: Tables) -> DataFrame:
    """Mean vector of each label as the frozen topic map."""
    parts = t.vectors().select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    pairs = F.sort_array(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(pairs.alias("p")).select(
        F.col("label").cast("bigint").alias("topic_id"),
        F.transform("p", lambda x: F.round(x["m"], 9)).alias("centroid"),
        F.lit(0.2).alias("radius"),
    )


@query
def assign_topics(t: Tables) -> DataFrame:
    topic_map = _map(t)
    placed = topics.nearest_topic(
        t.vectors().select("video_id", "embedding"), topic_map, topic_map.count()
    )
    return placed.withColumn("cosine", F.round("cosine", 6))


@query
def new_assignments(t: Tables) -> DataFrame:
    """Assignments of all vectors by label, with those of labelled documents stored before."""
    pairs = t.vectors().select("video_id", F.col("label").cast("bigint").alias("topic_id"), "vec_id")
    known = t.read("labels").select(F.col("doc_id").alias("vec_id"))
    old = pairs.join(known, "vec_id", "left_semi")
    return append_assignments(old.select("video_id", "topic_id"), pairs)


# -- further questions ---------------------------------------------------------------------


@query
def streaks(t: Tables) -> DataFrame:
    return insights.streaks(t.order_events())


@query
def rolling_avg(t: Tables) -> DataFrame:
    e = t.order_events()
    return insights.rolling_average(views.daily_summary(e, t.dates_of(e), t.as_of(e)))


@query
def yoy(t: Tables) -> DataFrame:
    e = t.order_events()
    monthly = views.monthly_summary(e, t.dates_of(e), t.as_of(e), since="1995-01-01")
    return insights.year_over_year(monthly)


@query
def rewatches(t: Tables) -> DataFrame:
    return insights.rewatches(t.order_events())


def _video_topics(t: Tables) -> DataFrame:
    return t.keyed_events().select("k").distinct().select(
        F.concat(F.lit("v"), "k").alias("video_id"), (F.col("k") % 6).alias("topic_id")
    )


@query
def channel_topics(t: Tables) -> DataFrame:
    return insights.channel_topics(t.events(), _video_topics(t))


@query
def topic_share(t: Tables) -> DataFrame:
    return insights.topic_share(t.events(), _video_topics(t))


@query
def quarantined_records(t: Tables) -> DataFrame:
    """Records landed as lines, every seventh of them cut short, read back and classified."""
    line = F.to_json(F.struct("title", "titleUrl", "time", "details", "subtitles"))
    cut = F.substring(line, F.lit(1), F.length(line) - 9)
    path = scratch_path(t.spark, "broken-exports")
    t.records().select(F.when(F.col("pos") % 7 == 0, cut).otherwise(line).alias("value")).write.text(path)
    landed = ingest.land(read_export(t.spark, path, lines=True))
    kinds = landed.groupBy("record_class").agg(F.count(F.lit(1)).alias("n"))
    held = ingest.quarantine(landed).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return kinds.union(held).toDF("kind", "n")


@query
def enrich_job(t: Tables) -> DataFrame:
    """Status after batches of requests, of which every third failed as a whole."""
    v = t.videos()
    batches = enrichment.candidates(v).select(
        "video_id", F.pmod(F.substring("video_id", 2, 20).cast("bigint"), F.lit(6)).alias("batch")
    )
    answers = batches.select("batch").distinct().select(
        F.concat(F.lit("responses/batch-"), "batch", F.lit(".json")).alias("file_name"),
        (F.col("batch") % 3 != 1).alias("answered"),
    )
    attempted = enrichment.attempts(batches, answers)
    got = t.metadata().join(attempted.where("answered"), "video_id", "left_semi")
    now = _now()
    done = enrichment.flip_missing(enrichment.apply_metadata(v, got, now), attempted, got, now)
    return done.select("video_id", "status", "enriched_at")


@query
def length_mix(t: Tables) -> DataFrame:
    return insights.length_mix(t.events(), t.videos())


@query
def category_gaps(t: Tables) -> DataFrame:
    return insights.category_gaps(t.events(), t.videos(), dim_categories(t.spark))


@query
def category_views(t: Tables) -> DataFrame:
    return insights.category_views(t.events(), t.videos(), dim_categories(t.spark))


@query
def daytype(t: Tables) -> DataFrame:
    e = t.order_events()
    return insights.day_types(views.daily_summary(e, t.dates_of(e), t.as_of(e)))


@query
def top_channels(t: Tables) -> DataFrame:
    e = t.order_events()
    return insights.top_channels(views.channel_monthly(e, t.channels_of(e), t.dates_of(e)))


@query
def row_counts(t: Tables) -> DataFrame:
    """Row count of each table."""
    parts = [
        t.read(n).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(n).alias("table_name"), "row_count"
        )
        for n in TABLES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
