"""The driver's tables seen as a watch-history star schema (FIXTURES.md)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.calendar import local_date
from watchloom.functions.constants import CATEGORIES
from watchloom.session import prepare
from watchloom.sources.dims import dim_date

SITE = "https://video.example/watch"


class Tables:
    """Fixtures over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = str(sf_dir).rstrip("/")
        self._spans: list[tuple[DataFrame, tuple[date, date]]] = []

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for heavy row work.

        A file with one row group is read by one task; the test tables are such files. A table
        of as many files as there are cores is left as it is.
        """
        df = self.read(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if len(df.inputFiles()) < cores else df

    # -- events ----------------------------------------------------------------------------

    def keyed_events(self, spread: bool = False) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        df = self.spread("events") if spread else self.read("events")
        return df.withColumn("k", k)

    def events(self) -> DataFrame:
        return self.keyed_events().select(
            "event_id",
            F.concat(F.lit("v"), "k").alias("video_id"),
            F.when(F.col("event_type") != "error", F.col("user_id")).alias("channel_id"),
            F.col("ts").alias("watched_at"),
        )

    def viewer_events(self) -> DataFrame:
        return self.keyed_events().select(
            "event_id",
            F.col("user_id").alias("viewer"),
            F.concat(F.lit("v"), "k").alias("video_id"),
            (F.col("k") % 20).alias("channel_id"),
            F.col("ts").alias("watched_at"),
        )

    def order_events(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("event_id"),
            F.concat(F.lit("o"), F.col("o_orderkey") % 3000).alias("video_id"),
            F.col("o_custkey").alias("channel_id"),
            F.col("o_orderdate").alias("watched_at"),
        )

    def line_events(self) -> DataFrame:
        return self.read("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
            F.concat(F.lit("p"), "l_partkey").alias("video_id"),
            F.col("l_suppkey").alias("channel_id"),
            F.col("l_shipdate").alias("watched_at"),
        )

    def doc_events(self) -> DataFrame:
        """Each document watched once, in document order."""
        return self.documents().select(
            F.col("doc_id").alias("event_id"), "video_id", "channel_id", "watched_at"
        )

    # -- dimensions ------------------------------------------------------------------------

    @staticmethod
    def channels_of(events: DataFrame) -> DataFrame:
        ids = events.where(F.col("channel_id").isNotNull()).select("channel_id").distinct()
        return ids.select(
            "channel_id",
            F.concat(F.lit("ch"), "channel_id").alias("channel_name"),
            F.concat(F.lit("u/"), "channel_id").alias("channel_url"),
        )

    def videos(self) -> DataFrame:
        k = F.col("k")
        ids = F.array(*[F.lit(c) for c, _ in CATEGORIES])
        stamp = F.lit("2024-01-01").cast("timestamp_ntz")
        return self.keyed_events().select("k").distinct().select(
            F.concat(F.lit("v"), k).alias("video_id"),
            F.concat(F.lit("Video "), k).alias("title"),
            F.concat(F.lit(f"{SITE}?v=v"), k).alias("title_url"),
            (k % 150).alias("channel_id"),
            F.when(k % 10 == 0, "unavailable").when(k % 10 == 1, "private").otherwise("active")
            .alias("status"),
            F.lit(None).cast("string").alias("description"),
            F.lit(None).cast("array<string>").alias("tags"),
            F.get(ids, (k % 29).cast("int")).alias("category_id"),
            F.when(k % 7 != 0, k * 37 % 3000).alias("duration_seconds"),
            F.lit(None).cast("bigint").alias("view_count"),
            F.lit(None).cast("bigint").alias("like_count"),
            F.lit(False).alias("has_transcript"),
            F.when(k % 4 == 0, stamp).alias("enriched_at"),
            stamp.alias("created_at"),
            stamp.alias("updated_at"),
        )

    def metadata(self) -> DataFrame:
        """What a metadata service returned: videos bought at least as often as viewed."""
        seen = self.keyed_events().groupBy("k").agg(
            F.count(F.lit(1)).alias("n"),
            F.max("user_id").alias("m"),
            F.count_if(F.col("event_type") == "purchase").alias("bought"),
            F.count_if(F.col("event_type") == "view").alias("viewed"),
        )
        return seen.where(F.col("bought") >= F.col("viewed")).select(
            F.concat(F.lit("v"), "k").alias("video_id"),
            F.concat(F.lit("about "), "k").alias("description"),
            F.when(F.col("k") % 2 == 0, F.array(F.lit("a"), F.lit("b")))
            .otherwise(F.array().cast("array<string>")).alias("tags"),
            F.when(F.col("k") % 5 != 0, F.lit(10)).alias("category_id"),
            (F.col("k") * 3).alias("duration_seconds"),
            F.col("n").alias("view_count"),
            F.when(F.col("k") % 4 != 1, F.col("m")).alias("like_count"),
        )

    def dates_of(self, events: DataFrame) -> DataFrame:
        first, last = self.days_of(events)
        return dim_date(self.spark, date(first.year, 1, 1), date(last.year, 12, 31))

    def days_of(self, events: DataFrame) -> tuple[date, date]:
        """First and last local day of the events."""
        for known, days in self._spans:
            if known is events:
                return days
        span = events.agg(F.min("watched_at").alias("a"), F.max("watched_at").alias("b"))
        row = span.select(local_date("a").alias("a"), local_date("b").alias("b")).first()
        self._spans.append((events, (row["a"], row["b"])))
        return row["a"], row["b"]

    def as_of(self, events: DataFrame) -> date:
        """Two weeks after the last event, so that days without events follow."""
        return self.days_of(events)[1] + timedelta(days=14)

    # -- export records --------------------------------------------------------------------

    def records(self) -> DataFrame:
        """Export records, one per event."""
        e = self.keyed_events(spread=True)
        kind = (
            F.when(F.col("event_type") == "error", "ad")
            .when(F.col("event_type") == "signup", "removed")
            .when((F.col("event_type") == "view") & (F.col("k") % 10 == 0), "ghost")
            .otherwise("clean")
        )
        url = F.concat(F.lit(f"{SITE}?list=a%20b&v=v"), F.col("k"), F.lit("&t=5#top"))
        channel = F.concat(
            F.lit('[{"name":"ch'), F.col("user_id"), F.lit('","url":"u/'), F.col("user_id"),
            F.lit('"}]'),
        )
        return e.withColumn("kind", kind).select(
            F.when(F.col("kind") == "ghost", F.concat(F.lit("Watched "), url))
            .otherwise(F.concat(F.lit("Watched Video "), "k")).alias("title"),
            F.when(F.col("kind") != "removed", url).alias("titleUrl"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
            F.parse_json(
                F.when(F.col("kind") == "ad", '[{"name":"From Google Ads"}]').otherwise("[]")
            ).alias("details"),
            F.try_parse_json(F.when(F.col("kind") != "ghost", channel)).alias("subtitles"),
            F.lit("events").alias("file_name"),
            F.col("event_id").alias("pos"),
            F.col("ts"),
        )

    def first_export(self) -> DataFrame:
        """The records an earlier export held; later exports repeat them."""
        return self.records().where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))

    # -- documents and vectors -------------------------------------------------------------

    def documents(self) -> DataFrame:
        at = F.make_dt_interval(secs=F.col("doc_id").cast("decimal(18,6)"))
        return self.spread("documents").select(
            "*",
            F.concat(F.lit("d"), "doc_id").alias("video_id"),
            F.regexp_extract("source", r"(\d+)", 1).cast("bigint").alias("channel_id"),
            (F.lit("2024-03-01").cast("timestamp_ntz") + at).alias("watched_at"),
        )

    def noisy_documents(self) -> DataFrame:
        """Documents, every second one with an address, a time, a hashtag and the like in front."""
        noise = F.lit("https://a.b/c 12:34 #tag Subscribe twitter: @me ")
        text = F.when(F.col("doc_id") % 2 == 1, F.concat(noise, F.col("text"))).otherwise(F.col("text"))
        return self.documents().withColumn("description", text)

    def doc_videos(self) -> DataFrame:
        return self.documents().select(
            "video_id", "channel_id", F.col("text").alias("title"), F.lit("active").alias("status")
        )

    def doc_channels(self) -> DataFrame:
        """Document sources as channels; every fifth one was tagged by a human."""
        tagged = F.col("channel_id") % 5 == 0
        return self.documents().select("channel_id", "source").distinct().select(
            "channel_id",
            F.col("source").alias("channel_name"),
            F.when(tagged, "en").alias("primary_language"),
            F.when(tagged, "human").alias("language_source"),
        )

    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(
            F.concat(F.lit("d"), "vec_id").alias("video_id"), "embedding", "label", "vec_id"
        )

    def topic_documents(self) -> DataFrame:
        """Every document, with one of ten topics."""
        return self.spread("documents").select(
            F.pmod("doc_id", F.lit(10)).cast("int").alias("topic"), F.col("doc_id").alias("doc_key"),
            F.col("text").alias("document"), "source",
        )
