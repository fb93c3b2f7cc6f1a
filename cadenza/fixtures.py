"""The driver's tables seen as a music catalog; the SQL beside each function makes the same rows."""

from __future__ import annotations

import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators.dealing import parts

NOW = datetime(2024, 2, 1, tzinfo=UTC)
SEED = "00000000"


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id(c: str):
    return F.lpad(F.col(c).cast("string"), 8, "0")


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return _read(spark, sf, "part").select(
        _id("p_partkey").alias("track_id"),
        F.concat(F.lit("file:///music/"), _id("p_partkey"), F.lit(".mp3")).alias("source_uri"),
        F.when(k % 10 == 9, "missing").otherwise("active").alias("status"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"),
        F.concat(F.lower("p_type"), F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("genre"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".mp3")).alias("file_name"),
        (k * 7 % 1201 / F.lit(2.0)).alias("duration_seconds"), (F.col("p_size") / F.lit(50.0)).alias("rms_energy"), (60 + k % 120).cast("double").alias("tempo_bpm"),
        F.lit(16000).alias("sample_rate"), (k * 37 % 8000).cast("double").alias("spectral_centroid"),
    )


TRACKS = """tracks AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS track_id, 'file:///music/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.mp3' AS source_uri,
  CASE WHEN p_partkey % 10 = 9 THEN 'missing' ELSE 'active' END AS status, p_name AS title, p_brand AS artist, p_type AS album,
  lower(p_type) || ', ' || split_part(p_name, ' ', 1) AS genre, replace(p_name, ' ', '-') || '.mp3' AS file_name, (p_partkey * 7 % 1201) / 2.0::DOUBLE AS duration_seconds,
  p_size / 50.0::DOUBLE AS rms_energy, CAST(60 + p_partkey % 120 AS DOUBLE) AS tempo_bpm, 16000 AS sample_rate, CAST(p_partkey * 37 % 8000 AS DOUBLE) AS spectral_centroid FROM part)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    zone = spark.conf.get("spark.sql.session.timeZone")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int") % 4
    return _read(spark, sf, "events").select(
        F.col("event_id").alias("id"), _id("user_id").alias("track_id"),
        F.when(kind == "click", "play").when(kind == "view", "complete").when(kind == "purchase", "like").when(kind == "signup", "replay").when(F.col("event_id") % 2 == 0, "skip").otherwise("dislike").alias("event_type"),
        F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone).alias("occurred_at"),
        F.when(k == 0, "coding").when(k == 1, "Gym").when(k == 2, " work ").alias("context"), F.col("value").alias("seconds_played"),
    )


EVENTS = """ev AS (SELECT event_id AS id, lpad(CAST(user_id AS VARCHAR), 8, '0') AS track_id,
  CASE event_type WHEN 'click' THEN 'play' WHEN 'view' THEN 'complete' WHEN 'purchase' THEN 'like' WHEN 'signup' THEN 'replay' ELSE CASE WHEN event_id % 2 = 0 THEN 'skip' ELSE 'dislike' END END AS event_type,
  ts AS occurred_at, CASE CAST(json_extract(props, '$.k') AS INT) % 4 WHEN 0 THEN 'coding' WHEN 1 THEN 'Gym' WHEN 2 THEN ' work ' END AS context, value AS seconds_played,
  pow(0.5, greatest(0, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 8.64e10 / 30) AS decay FROM events)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select(_id("vec_id").alias("track_id"), F.col("embedding").alias("vector"))


VECTORS = "vecs AS (SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS track_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Item rows of one playlist for each order.

    Orders are dealt out once, over so many parts that a part's size doesn't grow with
    the table.  A part is sorted, which spills, and repeated parts of an order are
    passed over in its stream; no set of all items is held.
    """
    lines = _read(spark, sf, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey")
    again = (F.row_number().over(order) > 1) & F.col("l_partkey").eqNullSafe(F.lag("l_partkey").over(order))
    rows = lines.select("l_orderkey", "l_partkey").repartition(max(spark.sparkContext.defaultParallelism, parts(lines)), "l_orderkey")
    rows = rows.select("l_orderkey", "l_partkey", (F.dense_rank().over(order) - 1).alias("position"), again.alias("_again")).filter("NOT _again")
    return rows.select(F.col("l_orderkey").alias("playlist_id"), "position", _id("l_partkey").alias("track_id"))


ITEMS = """items AS (SELECT l_orderkey AS playlist_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS position, lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS track_id
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))"""


def playlists(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each order with ``items`` named by place (``p0``, ``p1``, ...), each with its ``track``."""
    entry = F.struct("position", F.concat(F.lit("p"), F.col("position").cast("string")).alias("track_id"), F.col("track_id").alias("track"))
    rows = items(spark, sf).groupBy("playlist_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    return rows.withColumn("items", F.transform("items", lambda x: F.struct(x["track_id"].alias("track_id"), x["track"].alias("track"))))


def judgments(spark: SparkSession, sf: str) -> DataFrame:
    """Graded documents; a query is a group of ids."""
    return _read(spark, sf, "labels").select((F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").cast("string").alias("track_id"), (2 * F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """A result list for each query: its documents by a mixed-up order of ids."""
    rows = _read(spark, sf, "documents").select((F.col("doc_id") % 20).alias("query_id"), "doc_id")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("doc_id") * 7919 % 10007, "doc_id"))
    return rows.select("query_id", at.alias("rank"), F.col("doc_id").cast("string").alias("track_id"))


JUDGED = """judg AS (SELECT doc_id % 20 AS query_id, doc_id, 2 * quality + 1 - toxic AS grade FROM labels),
 res AS (SELECT doc_id % 20 AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id * 7919 % 10007, doc_id) AS rank FROM documents)"""


class FlagProvider:
    """Text vectors of three numbers: whether a text holds each of two words, and a half."""

    words = ("small", "green")

    def embed_documents(self, texts: list[str]) -> list:
        return [[*(float(w in t.lower()) for w in self.words), 0.5] for t in texts]

    def embed_query(self, text: str) -> list:
        return self.embed_documents([text])[0]


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see, for what a query has to store."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.gettempdir()
    return f"{shared.rstrip('/')}/cadenza-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks with moods, voices, vectors in JSON and the other numbers of an analysis."""
    k = F.col("track_id").cast("long")
    numbers = lambda n, m: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: ((k + i * i) % m).cast("string")), ","), F.lit("]"))
    moods = F.when(k % 3 == 0, F.array(F.lit("dark"))).when(k % 3 == 1, F.array(F.lit("happy"), F.lit("sad"))).otherwise(F.array().cast("array<string>"))
    return tracks(spark, sf).withColumns(
        {
            "moods": moods,
            "vocal_preference": F.when(k % 4 == 0, "vocal").when(k % 4 == 1, "instrumental").otherwise("any"),
            "mfcc_json": F.when(k % 5 == 0, "broken").otherwise(numbers(13, 7)),
            "chroma_json": numbers(12, 5),
            "spectral_bandwidth": (k % 900).cast("double"),
            "spectral_rolloff": (k % 700).cast("double"),
            "zero_crossing_rate": (k % 10) / F.lit(10.0),
        }
    )


def stored_playlists(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a stored playlist, with scores by place."""
    item = F.struct(F.col("position").cast("int").alias("position"), "track_id", (1 / (1 + F.col("position"))).alias("sequence_score"), F.lit(0.5).alias("base_score"))
    rows = items(spark, sf).groupBy("playlist_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    name = F.concat(F.lit("Mix "), F.col("playlist_id").cast("string"))
    return rows.select(name.alias("name"), F.lower(name).alias("name_key"), F.lit(NOW).alias("created_at"), F.lit(NOW).alias("updated_at"), "items")
