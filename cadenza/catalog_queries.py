"""The catalog queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import fixtures as X
from cadenza.functions import scalars as S
from cadenza.operators import catalog, evaluation, hybrid, intent, lexical, preference, ranking, vectors
from cadenza.operators import events as E
from cadenza.operators import playlists as P
from cadenza.operators.dealing import look_up
from cadenza.plans import flows
from cadenza.schemas import EVENT_TYPES, SIGNALS
from cadenza.sources import ingest, playlist_files
from cadenza.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
REQUEST = "high energy cinematic something new"
CONTEXT, LEXICAL = "work", "small green anodized"
LIMIT = 25


def _r(c: str, alias: str | None = None):
    return (F.round(F.col(c), 6) + 0.0).alias(alias or c.split(".")[-1])


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH " + ",\n ".join(parts) + "\n"


# -- catalog ------------------------------------------------------------------------------

GENRES = "list_sort(list_distinct(list_filter(list_transform(string_split(genre, ','), lambda g: lower(trim(g))), lambda g: g <> '')))"


@query(_with(X.TRACKS) + "SELECT track_id, title, artist, album FROM tracks WHERE status = 'active'")
def catalog_active(s: SparkSession, d: str) -> DataFrame:
    return catalog.active(X.tracks(s, d)).select("track_id", "title", "artist", "album")


@query(_with(X.TRACKS) + "SELECT track_id, round(tempo_bpm, 6) AS tempo_bpm, round(least(1, greatest(0, rms_energy)), 6) AS energy, round(least(1, spectral_centroid / 8000), 6) AS brightness, 0 AS n_mfcc FROM tracks")
def music_dna(s: SparkSession, d: str) -> DataFrame:
    return catalog.music_dna(X.tracks(s, d)).select("track_id", _r("tempo_bpm"), _r("energy"), _r("brightness"), F.size("mfcc").alias("n_mfcc"))


@query(_with(X.TRACKS) + f"SELECT track_id, array_to_string({GENRES}, ';') AS genres FROM tracks WHERE status = 'active'")
def catalog_candidates(s: SparkSession, d: str) -> DataFrame:
    return catalog.candidates(X.tracks(s, d)).select("track_id", F.concat_ws(";", "genres").alias("genres"))


@query(_with(X.TRACKS) + "SELECT track_id, pos FROM tracks JOIN (VALUES ('00000012', 0), ('00000009', 1), ('00000003', 2), ('99999999', 3)) a(track_id, pos) USING (track_id) WHERE status = 'active'")
def candidates_by_ids(s: SparkSession, d: str) -> DataFrame:
    return catalog.candidates_by_ids(X.tracks(s, d), ["00000012", "00000009", "00000003", "99999999"]).select("track_id", "pos")


TEXT = "'title: ' || title || ' | artist: ' || artist || ' | album: ' || album || ' | genre: ' || genre || ' | file name: ' || file_name"


@query(_with(X.TRACKS) + f"SELECT track_id, {TEXT} AS text, sha256(source_uri) AS stable_id FROM tracks")
def catalog_text(s: SparkSession, d: str) -> DataFrame:
    t = X.tracks(s, d)
    return catalog.catalog_text(t).join(t.select("track_id", ingest.stable_track_id(F.col("source_uri")).alias("stable_id")), "track_id")


_SUMS = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, {15 if i < 3 else 15}) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS s{i}" for i in range(4))


@query(_with(X.TRACKS, f"rows AS (SELECT sha256(track_id || chr(0) || {TEXT}) AS h FROM tracks WHERE status = 'active')") + f"SELECT count(*) AS n, {_SUMS} FROM rows")
def catalog_fingerprint(s: SparkSession, d: str) -> DataFrame:
    got = vectors.fingerprint_parts(catalog.catalog_text(catalog.active(X.tracks(s, d))))
    return got.select("n", *(F.col(f"s{i}").cast("string").alias(f"s{i}") for i in range(4)))


_DESCRIBED = """tr AS (SELECT *, CAST(track_id AS BIGINT) AS k FROM tracks),
 des AS (SELECT *, CASE k % 3 WHEN 0 THEN ['dark'] WHEN 1 THEN ['happy', 'sad'] ELSE [] END AS moods, CASE k % 4 WHEN 0 THEN 'vocal' WHEN 1 THEN 'instrumental' ELSE 'any' END AS voice,
  CASE WHEN k % 5 = 0 THEN [] ELSE list_transform(range(1, 14), lambda i: CAST((k + i * i) % 7 AS DOUBLE)) END AS mfcc, list_transform(range(1, 13), lambda i: CAST((k + i * i) % 5 AS DOUBLE)) AS chroma FROM tr)"""


@query(_with(X.TRACKS, _DESCRIBED) + "SELECT track_id, array_to_string(mfcc, ',') AS mfcc, array_to_string(chroma, ',') AS chroma FROM des")
def music_dna_vectors(s: SparkSession, d: str) -> DataFrame:
    got = catalog.music_dna(X.described(s, d))
    return got.select("track_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("mfcc", "chroma")))


_RAW = "list_concat([tempo_bpm, rms_energy, spectral_centroid, CAST(k % 900 AS DOUBLE), CAST(k % 700 AS DOUBLE), (k % 10) / 10.0::DOUBLE], mfcc, chroma)"


@query(_with(X.TRACKS, _DESCRIBED, f"raw AS (SELECT track_id, {_RAW} AS x FROM des WHERE k % 5 <> 0)", "unit AS (SELECT track_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n FROM raw)") + "SELECT track_id, i - 1 AS place, round(CAST(CAST(x[i] / n AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM (SELECT *, unnest(range(1, 32)) AS i FROM unit)")
def dsp_embedding(s: SparkSession, d: str) -> DataFrame:
    whole = X.described(s, d).filter(F.col("mfcc_json") != "broken")  # a vector of another length is an error
    got = catalog.dsp_embedding(whole).select("track_id", F.posexplode_outer("vector").alias("place", "value"))  # outer: no filter on the vector runs ahead of the one above
    return got.select("track_id", "place", (F.round(F.col("value").cast("double"), 5) + 0.0).alias("value"))


_PATH = "'/music/' || (CASE k % 4 WHEN 0 THEN 'a b' WHEN 1 THEN 'ü+1' ELSE 'x' END) || track_id || (CASE k % 5 WHEN 0 THEN '.mp3' WHEN 1 THEN '.FLAC' WHEN 2 THEN '.txt' WHEN 3 THEN '.Opus' ELSE '' END)"
_CODED = "'file:///music/' || (CASE k % 4 WHEN 0 THEN 'a%20b' WHEN 1 THEN '%C3%BC%2B1' ELSE 'x' END) || track_id || (CASE k % 5 WHEN 0 THEN '.mp3' WHEN 1 THEN '.FLAC' WHEN 2 THEN '.txt' WHEN 3 THEN '.Opus' ELSE '' END)"


@query(_with(X.TRACKS, _DESCRIBED) + f"SELECT track_id, k % 5 IN (0, 1, 3) AS audio, {_CODED} AS uri FROM des")
def audio_paths(s: SparkSession, d: str) -> DataFrame:
    k = F.col("track_id").cast("long")
    middle = F.when(k % 4 == 0, "a b").when(k % 4 == 1, "ü+1").otherwise("x")
    ending = F.when(k % 5 == 0, ".mp3").when(k % 5 == 1, ".FLAC").when(k % 5 == 2, ".txt").when(k % 5 == 3, ".Opus").otherwise("")
    rows = X.tracks(s, d).withColumn("path", F.concat(F.lit("file:/music/"), middle, "track_id", ending))
    return rows.select("track_id", ingest.is_audio(F.col("path")).alias("audio"), ingest.file_uri(F.col("path")).alias("uri"))


@query(_with(X.TRACKS, "f AS (SELECT *, CAST(track_id AS BIGINT) AS k FROM tracks WHERE CAST(track_id AS BIGINT) % 7 <> 0)") + """SELECT source_uri, k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0 AS changed FROM f""")
def changed_files(s: SparkSession, d: str) -> DataFrame:
    """Files of the folder against what the last scan saw: sizes, times, rows and versions of some differ."""
    k = F.col("track_id").cast("long")
    rows = X.tracks(s, d).filter(k % 7 != 0)
    files = rows.select("source_uri", F.lit(10).alias("file_size"), F.lit(20).alias("modified_at_ns"))
    state = rows.filter(k % 11 != 0).select("source_uri", F.when(k % 13 == 0, 11).otherwise(10).alias("file_size"), F.when(k % 17 == 0, 21).otherwise(20).alias("modified_at_ns"), F.lit("h").alias("content_hash"))
    config = ingest.AnalysisConfig()
    version = F.when(k % 23 == 0, "old").otherwise(config.version)
    known = X.tracks(s, d).filter(k % 19 != 0).select("source_uri", "track_id", version.alias("analysis_version"), F.lit(1.0).alias("analysis_seconds"))
    return ingest.changed_files(files, state, known, config).select("source_uri", "changed")


# -- listening events -----------------------------------------------------------------------


CHANNELS = {
    "positive": "CASE event_type WHEN 'play' THEN 0.15 WHEN 'complete' THEN 0.35 WHEN 'like' THEN 1.0 ELSE 0 END",
    "negative": "CASE event_type WHEN 'dislike' THEN 1.0 ELSE 0 END",
    "replay": "CASE event_type WHEN 'replay' THEN 1.25 ELSE 0 END",
    "skip": "CASE event_type WHEN 'skip' THEN 0.75 ELSE 0 END",
}


def _counters(where: str = "true") -> str:
    parts = [f"sum(decay * {case}) AS {c}" for c, case in CHANNELS.items()]
    return f"pref AS (SELECT track_id, {', '.join(parts)}, sum(decay) AS exposure, tanh((positive + replay - negative - skip) / 2) AS preference_score, 1 / (1 + sum(decay)) AS novelty_score FROM ev WHERE {where} GROUP BY track_id)"


IN_CONTEXT = f"lower(trim(context)) = '{CONTEXT}'"


@query(_with(X.EVENTS, _counters()) + "SELECT track_id, round(positive, 6) + 0.0 AS positive, round(negative, 6) + 0.0 AS negative, round(preference_score, 6) + 0.0 AS preference_score FROM pref")
def pref_global(s: SparkSession, d: str) -> DataFrame:
    return preference.preference(X.events(s, d), now=X.NOW).select("track_id", _r("positive"), _r("negative"), _r("preference_score"))


@query(_with(X.EVENTS, _counters(IN_CONTEXT)) + "SELECT track_id, round(preference_score, 6) + 0.0 AS preference_score FROM pref")
def pref_context(s: SparkSession, d: str) -> DataFrame:
    return preference.contextual_preference(X.events(s, d), context=" WORK ", now=X.NOW).select("track_id", _r("preference_score"))


@query(_with(X.EVENTS, _counters(IN_CONTEXT)) + "SELECT track_id, round(exposure, 6) + 0.0 AS exposure, round(novelty_score, 6) + 0.0 AS novelty_score FROM pref")
def novelty_context(s: SparkSession, d: str) -> DataFrame:
    return preference.contextual_novelty(X.events(s, d), context=CONTEXT, now=X.NOW).select("track_id", _r("exposure"), _r("novelty_score"))


def _taste_sql() -> str:
    parts = [f"SELECT '{c}' AS channel, track_id AS value, round({c}, 6) + 0.0 AS strength, (SELECT min(id) FROM ev e WHERE e.track_id = pref.track_id AND {case} > 0) AS first_event FROM pref" for c, case in CHANNELS.items()]
    contexts = "SELECT 'context', context, NULL, min(id) FROM ev WHERE context <> '' GROUP BY context"
    return _with(X.EVENTS, _counters()) + f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE first_event IS NOT NULL UNION ALL {contexts}"


@query(_taste_sql())
def taste_profile(s: SparkSession, d: str) -> DataFrame:
    return preference.taste_profile(X.events(s, d), now=X.NOW).select("channel", "value", _r("strength"), "first_event")


@query(_with(X.EVENTS, _counters()) + "SELECT track_id, round(greatest(-1, least(1, positive + replay - negative - skip)), 6) + 0.0 AS boost FROM pref")
def preference_boost(s: SparkSession, d: str) -> DataFrame:
    net = S.preference_score(*(F.col(c) for c in ("positive", "negative", "replay", "skip")))
    return preference.preference(X.events(s, d), now=X.NOW).withColumn("boost", S.preference_boost(net)).select("track_id", _r("boost"))


@query(_with(X.EVENTS) + "SELECT id, track_id, event_type, epoch_us(occurred_at) AS micros FROM ev ORDER BY occurred_at DESC, id DESC LIMIT 1000")
def recent_events(s: SparkSession, d: str) -> DataFrame:
    return E.recent(X.events(s, d)).select("id", "track_id", "event_type", F.unix_micros("occurred_at").alias("micros"))


@query(_with(X.EVENTS) + f"SELECT k AS event_type, count(id) AS n FROM (SELECT unnest({list(EVENT_TYPES)}) AS k) LEFT JOIN ev ON event_type = k GROUP BY k")
def event_summary_types(s: SparkSession, d: str) -> DataFrame:
    return E.type_counts(X.events(s, d)).select("event_type", "n")


@query(_with(X.EVENTS) + "SELECT nullif(lower(trim(context)), '') AS context, count(*) AS event_count, count(DISTINCT track_id) AS distinct_tracks FROM ev GROUP BY 1")
def event_summary_contexts(s: SparkSession, d: str) -> DataFrame:
    return E.context_counts(X.events(s, d))


@query(_with(X.EVENTS) + "SELECT count(*) AS total_events, count(DISTINCT track_id) AS distinct_tracks FROM ev")
def event_summary_totals(s: SparkSession, d: str) -> DataFrame:
    return E.totals(X.events(s, d))


@query(_with(X.EVENTS) + "SELECT strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(occurred_at) % 1000000 <> 0 THEN strftime(occurred_at, '.%f') ELSE '' END || '+00:00' || chr(9) || event_type || chr(9) || track_id || chr(9) || coalesce(context, '') || chr(9) AS line FROM ev")
def event_lines(s: SparkSession, d: str) -> DataFrame:
    return E.format_events(X.events(s, d).withColumn("seconds_played", F.lit(None).cast("double")))


@query(_with(X.TRACKS, X.EVENTS) + "SELECT id, track_id FROM ev WHERE EXISTS (SELECT 1 FROM tracks t WHERE t.track_id = ev.track_id AND t.track_id <> '00000003')")
def events_of_known_tracks(s: SparkSession, d: str) -> DataFrame:
    return E.known_tracks(X.events(s, d).select("id", "track_id"), X.tracks(s, d).filter("track_id <> '00000003'"))


@query("SELECT * FROM (VALUES ('00000001', 'like', 'gym', 1704067200000000), ('00000001', 'skip', NULL, 1704070800000000), ('00000009', 'play', 'Work', 1704067200000001)) v(track_id, event_type, context, micros)")
def store_events(s: SparkSession, d: str) -> DataFrame:
    """Events recorded one by one (an unknown track is refused), as read back."""
    store = Store(s, X.scratch(s))
    store.replace("tracks", X.tracks(s, d))
    at = datetime(2024, 1, 1, tzinfo=UTC)
    store.record_event("00000001", "like", occurred_at=at, context="gym")
    store.record_event("00000001", "skip", occurred_at=at + timedelta(hours=1), context="  ")
    store.record_event("00000009", "play", occurred_at=at + timedelta(microseconds=1), context="Work")
    try:
        store.record_event("no track", "play", occurred_at=at)
    except ValueError:
        return store.table("listening_events").select("track_id", "event_type", "context", F.unix_micros("occurred_at").alias("micros"))
    raise AssertionError("an event of an unknown track was recorded")


# -- intent, ranking, flows --------------------------------------------------------------------

CAND = "cand AS (SELECT track_id, title, least(1, rms_energy) AS energy, tempo_bpm, least(1, spectral_centroid / 8000) AS brightness, 0.0::DOUBLE AS own_novelty FROM tracks WHERE status = 'active')"
# energy .8, mood cinematic (no evidence: 0), novelty wanted (own novelty 0)
SCORED = "scored AS (SELECT *, greatest(0, 1 - abs(energy - 0.8)) AS energy_match, (0 + greatest(0, 1 - abs(energy - 0.8)) + own_novelty) / 3 AS intent_score FROM cand)"
RECENT = "ev AS (SELECT * FROM ev0 ORDER BY occurred_at DESC, id DESC LIMIT 1000)"
EV0 = X.EVENTS.replace("ev AS", "ev0 AS", 1)
PERSONAL = "personal AS (SELECT s.*, coalesce(p.preference_score, 0) AS preference, coalesce(p.novelty_score, 1) AS novelty FROM scored s LEFT JOIN pref p USING (track_id))"
FUSED = "fused AS (SELECT *, 0.18 * intent_score + 0.18 * energy_match + 0.18 * preference + 0.05 * novelty AS score FROM personal)"
RANKED = f"ranked AS (SELECT * FROM fused ORDER BY round(score, 9) DESC, track_id LIMIT {LIMIT})"
FLOW = (X.TRACKS, EV0, RECENT, _counters(IN_CONTEXT), CAND, SCORED, PERSONAL, FUSED, RANKED)


@query(_with(X.TRACKS, CAND, SCORED) + "SELECT track_id, round(intent_score, 6) + 0.0 AS intent_score, round(energy_match, 6) + 0.0 AS energy_match, CASE WHEN energy_match > 0 THEN 'energy' ELSE '' END AS matched FROM scored")
def intent_scores(s: SparkSession, d: str) -> DataFrame:
    got = intent.score(catalog.candidates(X.tracks(s, d)), intent.parse_intent(REQUEST))
    return got.select("track_id", _r("intent_score"), _r("energy_match"), F.concat_ws(",", "matched_dimensions").alias("matched"))


_PHRASES = ("dark Tamil BGM for a chase", "very high energy south-indian mass entry", "calm folk songs without vocals", "something I know", "vocal romance, moderate", "nothing at all")
# what a reader finds in each of the phrases
_READ = """a(i, genres, moods, languages, regions, instrumentation, music_types, scenes, negative_terms, energy, vocal_preference, novelty, confidence) AS (VALUES
 (0, '', 'dark', 'tamil', '', '', 'bgm', 'chase', '', NULL, 'any', 'any', 0.8::DOUBLE),
 (1, '', 'mass', '', 'south_india', '', '', 'hero_entry', '', 0.95::DOUBLE, 'any', 'any', 0.8::DOUBLE),
 (2, '', 'folk', '', '', '', 'song', '', 'vocals', 0.3::DOUBLE, 'instrumental', 'any', 0.8::DOUBLE),
 (3, '', '', '', '', '', '', '', '', NULL, 'any', 'familiar', 0.2::DOUBLE),
 (4, '', '', '', '', '', '', 'romance', '', 0.5::DOUBLE, 'vocal', 'any', 0.6::DOUBLE),
 (5, '', '', '', '', '', '', '', '', NULL, 'any', 'any', 0.0::DOUBLE))"""


@query(_with(_READ) + "SELECT c_custkey AS request_id, genres, moods, languages, regions, instrumentation, music_types, scenes, negative_terms, energy, vocal_preference, novelty, confidence FROM customer JOIN a ON c_custkey % 6 = i")
def intent_requests(s: SparkSession, d: str) -> DataFrame:
    """A request for each customer, who signs with a number."""
    text = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("request_id"), F.concat(text, F.lit(", "), F.col("c_custkey").cast("string")).alias("text"))
    got = intent.parse_intents(rows)
    facets = ("genres", "moods", "languages", "regions", "instrumentation", "music_types", "scenes", "negative_terms")
    return got.select("request_id", *((F.concat_ws(",", f) if f in got.columns else F.lit("")).alias(f) for f in facets), "energy", "vocal_preference", "novelty", "confidence")


# dark and happy: two moods; energy .3; no vocals; something new
_FACETED = """fac AS (SELECT track_id, len(list_intersect(moods, ['dark', 'happy'])) / 2.0::DOUBLE AS mood, greatest(0, 1 - abs(least(1, rms_energy) - 0.3)) AS near,
  CASE voice WHEN 'vocal' THEN 0.0::DOUBLE WHEN 'instrumental' THEN 1.0 ELSE 0.5 END AS voice_score, (k % 10) / 10.0::DOUBLE AS own FROM des WHERE status = 'active')"""


@query(_with(X.TRACKS, _DESCRIBED, _FACETED) + "SELECT track_id, round((mood + near + voice_score + own) / 4, 6) + 0.0 AS intent_score, round(voice_score, 6) AS vocal_match, round(own, 6) AS novelty_match, concat_ws(',', CASE WHEN mood > 0 THEN 'moods' END, CASE WHEN near > 0 THEN 'energy' END, CASE WHEN voice_score > 0 THEN 'vocal' END, CASE WHEN own > 0 THEN 'novelty' END) AS matched FROM fac")
def intent_facets(s: SparkSession, d: str) -> DataFrame:
    own = (F.col("track_id").cast("long") % 10) / F.lit(10.0)
    rows = catalog.candidates(X.described(s, d)).withColumn("candidate_novelty", own)
    got = intent.score(rows, intent.parse_intent("dark happy calm, without vocals, something new"))
    return got.select("track_id", _r("intent_score"), _r("vocal_match"), _r("novelty_match"), F.concat_ws(",", "matched_dimensions").alias("matched"))


@query(_with(*FLOW) + "SELECT track_id, round(score, 6) + 0.0 AS score FROM ranked")
def fusion_rank(s: SparkSession, d: str) -> DataFrame:
    return _flow(s, d).ranked.select("track_id", _r("score"))


def _flow(s: SparkSession, d: str, mode: str = "smooth") -> flows.FlowResult:
    return flows.recommend(X.tracks(s, d), X.events(s, d), flows.Request(REQUEST, mode=mode, limit=LIMIT), context=CONTEXT, now=X.NOW)


_EXPLAIN = " UNION ALL ".join(f"SELECT track_id, '{n}' AS name, round({v}, 6) + 0.0 AS raw_score, {w} AS weight, round({v} * {w}, 6) + 0.0 AS contribution FROM ranked" for n, v, w in zip(SIGNALS, ("intent_score", "energy_match", "0.0::DOUBLE", "preference", "novelty", "0.0::DOUBLE"), ("0.18::DOUBLE", "0.18::DOUBLE", "0.36::DOUBLE", "0.18::DOUBLE", "0.05::DOUBLE", "0.05::DOUBLE"), strict=True))


@query(_with(*FLOW) + _EXPLAIN)
def fusion_explain(s: SparkSession, d: str) -> DataFrame:
    got = _flow(s, d).ranked.select("track_id", F.explode("contributions").alias("c"))
    return got.select("track_id", "c.name", _r("c.raw_score"), F.round("c.weight", 6).alias("weight"), _r("c.contribution"))


@query(_with(X.TRACKS, X.EVENTS, _counters(), "base AS (SELECT track_id, coalesce(preference_score, 0) AS p FROM tracks LEFT JOIN pref USING (track_id) WHERE status = 'active')") + "SELECT track_id, round(0.18 * p, 6) + 0.0 AS score FROM base ORDER BY round(0.18 * p, 9) DESC, track_id LIMIT 10")
def preference_rank(s: SparkSession, d: str) -> DataFrame:
    return ranking.preference_rank(catalog.candidates(X.tracks(s, d)), X.events(s, d), now=X.NOW).select("track_id", _r("score"))


@query(_with(X.TRACKS, X.EVENTS, _counters(IN_CONTEXT), "base AS (SELECT track_id, coalesce(novelty_score, 1) AS p FROM tracks LEFT JOIN pref USING (track_id) WHERE status = 'active')") + "SELECT track_id, round(0.05 * p, 6) + 0.0 AS score FROM base ORDER BY round(0.05 * p, 9) DESC, track_id LIMIT 10")
def novelty_rank(s: SparkSession, d: str) -> DataFrame:
    return ranking.novelty_rank(catalog.candidates(X.tracks(s, d)), X.events(s, d), now=X.NOW, context=CONTEXT).select("track_id", _r("score"))


_PARTS = {"metadata_score": "0.18 * intent_score", "dsp_score": "0.18 * energy_match", "preference_score": "0.18 * preference", "novelty_score": "0.05 * novelty"}
_LARGEST = f"greatest({', '.join(f'abs({p})' for p in _PARTS.values())})"
_STRONGEST = "CASE " + " ".join(f"WHEN abs({p}) > 0 AND abs({p}) = {_LARGEST} THEN '{n}'" for n, p in _PARTS.items()) + " END"


@query(_with(*FLOW) + f"SELECT track_id, {_STRONGEST} AS strongest FROM ranked")
def fusion_strongest(s: SparkSession, d: str) -> DataFrame:
    return _flow(s, d).ranked.select("track_id", F.col("strongest_signal").alias("strongest"))


_DIST = "0.5 * abs(w.energy - p.energy) + 0.3 / 60 * abs(w.tempo_bpm - p.tempo_bpm) + 0.2 * abs(w.brightness - p.brightness)"
_STEPS = {"smooth": f"p.score - ({_DIST})", "contrast": f"p.score + ({_DIST})", "journey": f"p.score - abs(p.energy - round(0.3 + 0.6 * (w.pos + 1) / {LIMIT - 1}.0, 10))", "discovery": "p.score + 0.5 * p.novelty"}


def _walk(mode: str, ranked: tuple[str, ...]) -> str:
    step = _STEPS[mode]
    walk = f"""walk AS (SELECT 0 AS pos, track_id, score AS val, energy, tempo_bpm, brightness, [track_id] AS used FROM (SELECT * FROM ranked ORDER BY round(score, 9) DESC, track_id LIMIT 1)
  UNION ALL SELECT w.pos + 1, c.track_id, c.val, c.energy, c.tempo_bpm, c.brightness, list_append(w.used, c.track_id) FROM walk w,
  LATERAL (SELECT p.track_id, p.energy, p.tempo_bpm, p.brightness, {step} AS val FROM ranked p WHERE NOT list_contains(w.used, p.track_id) ORDER BY round({step}, 9) DESC, p.track_id LIMIT 1) c)"""
    return "WITH RECURSIVE " + ",\n ".join((*ranked, walk)) + "\nSELECT pos AS position, track_id, round(val, 6) + 0.0 AS sequence_score FROM walk"


def _sequence(mode: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return _flow(s, d, mode).playlist.select("position", "track_id", _r("sequence_score"))

    run.__name__ = f"sequence_{mode}"
    query(_walk(mode, FLOW))(run)


for _mode in _STEPS:
    _sequence(_mode)


@query(_walk("smooth", FLOW))
def recommend_catalog(s: SparkSession, d: str) -> DataFrame:
    return _flow(s, d).playlist.select("position", "track_id", _r("sequence_score"))


_PLAIN = "fused AS (SELECT *, own_novelty AS novelty, 0.18 * intent_score + 0.18 * energy_match + 0.05 * own_novelty AS score FROM scored)"


@query(_walk("contrast", (X.TRACKS, CAND, SCORED, _PLAIN, RANKED)))
def flow_end_to_end(s: SparkSession, d: str) -> DataFrame:
    got = flows.end_to_end(catalog.candidates(X.tracks(s, d)), flows.Request(REQUEST, mode="contrast", limit=LIMIT))
    return got.playlist.select("position", "track_id", _r("sequence_score"))


# -- retrieval --------------------------------------------------------------------------------


def _lexical_sql(variants: list[str], limit: int, name: str = "lex") -> str:
    weights = {"title": 1.0, "artist": 0.85, "album": 0.75, "genre": 0.6, "file_name": 0.3}
    fields = list(weights)
    toks = ", ".join(f"list_distinct(list_transform(regexp_extract_all({f}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x))) AS t_{f}" for f in fields)
    parts = []
    for v in variants:
        words = sorted(set(v.split()))
        score = " + ".join("greatest(" + ", ".join(f"CASE WHEN list_contains(t_{f}, '{w}') THEN {weights[f]} ELSE 0 END" for f in fields) + ")" for w in words)
        hits = []
        for i, f in enumerate(fields):
            fresh = " OR ".join("(" + " AND ".join([f"list_contains(t_{f}, '{w}')", *(f"NOT list_contains(t_{g}, '{w}')" for g in fields[:i])]) + ")" for w in words)
            hits.append(f"CASE WHEN {fresh} THEN '{f}' END")
        parts.append(f"SELECT track_id, CAST({score} AS DOUBLE) / {len(words)} AS score, list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) AS fields, '{v}' AS variant FROM tok")
    best = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, fields, variant) AS n FROM ({' UNION ALL '.join(parts)}) WHERE score > 0) WHERE n = 1)"""
    return f"tok AS (SELECT track_id, {toks} FROM tracks WHERE status = 'active'),\n {best},\n {name} AS (SELECT * FROM best ORDER BY round(score, 9) DESC, track_id LIMIT {limit})"


def _lexical_out(df: DataFrame) -> DataFrame:
    return df.select("track_id", _r("score"), F.concat_ws(",", "matched_fields").alias("matched_fields"), "matched_query")


_LEX_OUT = "SELECT track_id, round(score, 6) + 0.0 AS score, array_to_string(fields, ',') AS matched_fields, variant AS matched_query FROM lex"


@query(_with(X.TRACKS, _lexical_sql([LEXICAL], LIMIT)) + _LEX_OUT)
def lexical_search(s: SparkSession, d: str) -> DataFrame:
    return _lexical_out(flows.SearchService(X.tracks(s, d)).search(LEXICAL, limit=LIMIT))


# a third of the tracks is a film's music by its album, another third an original soundtrack
_ALBUMS = X.TRACKS.replace("p_type AS album", "CASE p_partkey % 3 WHEN 0 THEN 'Original Soundtrack' WHEN 1 THEN 'Film Music' ELSE p_type END AS album")


def _albums(s: SparkSession, d: str) -> DataFrame:
    k = F.col("track_id").cast("long")
    return X.tracks(s, d).withColumn("album", F.when(k % 3 == 0, "Original Soundtrack").when(k % 3 == 1, "Film Music").otherwise(F.col("album")))


@query(_with(_ALBUMS, _lexical_sql(["small ost", "small soundtrack", "small original soundtrack"], 60)) + _LEX_OUT)
def lexical_search_expanded(s: SparkSession, d: str) -> DataFrame:
    return _lexical_out(lexical.search(_albums(s, d), "small  ost", limit=60, expand=True))


# the vectors of FlagProvider for the texts, and their cosine with those of "small" (1, 0, .5)
_FLAGS = f"""txt AS (SELECT track_id, title, artist, album, lower({TEXT}) AS t FROM tracks WHERE status = 'active'),
 flag AS (SELECT *, CAST(contains(t, 'small') AS INT) AS a, CAST(contains(t, 'green') AS INT) AS b FROM txt),
 live AS (SELECT track_id, title, artist, album, (a + 0.25) / (sqrt(1.25::DOUBLE) * sqrt(a + b + 0.25::DOUBLE)) AS score FROM flag)"""
_BEST = "SELECT track_id, round(score, 6) + 0.0 AS score, title FROM live ORDER BY round(score, 9) DESC, track_id LIMIT {n}"
_MEANT = "small"


@query(_with(X.TRACKS, _FLAGS) + _BEST.format(n=LIMIT))
def semantic_live(s: SparkSession, d: str) -> DataFrame:
    return flows.SearchService(X.tracks(s, d)).semantic_search(_MEANT, X.FlagProvider(), limit=LIMIT).select("track_id", _r("score"), "title")


_PROFILE = vectors.TextEmbeddingProfile("flags")


def _indexed(s: SparkSession, d: str) -> tuple[flows.SearchService, str]:
    """A semantic index of the whole catalog, built anew."""
    service, path = flows.SearchService(X.tracks(s, d)), X.scratch(s)
    service.rebuild_semantic_index(path, X.FlagProvider(), _PROFILE)
    return service, path


@query(_with(X.TRACKS, _FLAGS) + _BEST.format(n=40))
def semantic_indexed(s: SparkSession, d: str) -> DataFrame:
    service, path = _indexed(s, d)
    return service.semantic_search_indexed(_MEANT, path, X.FlagProvider(), _PROFILE, limit=40).select("track_id", _r("score"), "title")


@query(_with(X.TRACKS) + "SELECT count(*) AS stored, 3 AS dimension FROM tracks WHERE status = 'active'")
def semantic_index_size(s: SparkSession, d: str) -> DataFrame:
    facts = vectors.VectorIndex(s, _indexed(s, d)[1]).manifest()
    return s.createDataFrame([(facts["count"], facts["dimension"])], "stored long, dimension int")


def _live_hybrid(n: int) -> tuple[str, ...]:
    scale = lambda t: f"CASE WHEN max({t}.score) OVER () = min({t}.score) OVER () THEN 1 ELSE ({t}.score - min({t}.score) OVER ()) / (max({t}.score) OVER () - min({t}.score) OVER ()) END"
    return (X.TRACKS, _FLAGS, _lexical_sql([LEXICAL], n), f"sem AS (SELECT track_id, score FROM live2 ORDER BY round(score, 9) DESC, track_id LIMIT {n})",
            f"""hyb AS (SELECT coalesce(a.track_id, b.track_id) AS track_id, 0.6 * coalesce(a.n, 0) + 0.4 * coalesce(b.n, 0) AS score
  FROM (SELECT track_id, {scale('lex')} AS n FROM lex) a FULL JOIN (SELECT track_id, {scale('sem')} AS n FROM sem) b ON a.track_id = b.track_id)""")  # fmt: skip


# the query "small green anodized" asks (1, 1, .5)
_LIVE2 = "live2 AS (SELECT track_id, (a + b + 0.25) / (1.5 * sqrt(a + b + 0.25::DOUBLE)) AS score FROM flag)"
_W = hybrid.HybridWeights(0.6, 0.4)


def _fused_live(n: int) -> tuple[str, ...]:
    tracks, flags, *rest = _live_hybrid(n)
    return (tracks, flags, _LIVE2, *rest)


@query(_with(*_fused_live(LIMIT)) + f"SELECT track_id, round(score, 6) + 0.0 AS score FROM hyb ORDER BY round(score, 9) DESC, track_id LIMIT {LIMIT}")
def hybrid_live(s: SparkSession, d: str) -> DataFrame:
    return flows.SearchService(X.tracks(s, d)).hybrid_search(LEXICAL, X.FlagProvider(), limit=LIMIT, weights=_W).select("track_id", _r("score"))


@query(_with(*_fused_live(40)) + "SELECT track_id, round(score, 6) + 0.0 AS score FROM hyb ORDER BY round(score, 9) DESC, track_id LIMIT 40")
def hybrid_indexed(s: SparkSession, d: str) -> DataFrame:
    service, path = _indexed(s, d)
    return service.hybrid_search_indexed(LEXICAL, path, X.FlagProvider(), _PROFILE, limit=40, weights=_W).select("track_id", _r("score"))


def _retrieval(mode: str, parts: tuple[str, ...], table: str) -> None:
    """Candidates of a retrieval mode: the ids survive with the catalog's own facts, the scores don't."""

    def run(s: SparkSession, d: str) -> DataFrame:
        extra = {"provider": X.FlagProvider()} if mode != "lexical" else {}
        if mode.endswith("-indexed"):
            extra |= {"profile": _PROFILE, "index_path": _indexed(s, d)[1]}
        got = flows.retrieve(X.tracks(s, d), LEXICAL, mode, request_limit=10, retrieval_limit=70, weights=_W, **extra)
        return got.select("track_id", "title", F.concat_ws(";", "genres").alias("genres"), _r("energy"), _r("metadata_score"))

    run.__name__ = f"retrieve_{mode.replace('-', '_')}"
    query(_with(*parts) + f"SELECT track_id, title, array_to_string({GENRES}, ';') AS genres, round(least(1, rms_energy), 6) + 0.0 AS energy, 0.0::DOUBLE AS metadata_score FROM tracks WHERE track_id IN (SELECT track_id FROM {table} ORDER BY round(score, 9) DESC, track_id LIMIT 70)")(run)


_retrieval("lexical", (X.TRACKS, _lexical_sql([LEXICAL], 70)), "lex")
for _name in ("semantic", "semantic-indexed"):
    _retrieval(_name, (X.TRACKS, _FLAGS, _LIVE2), "live2")
for _name in ("hybrid", "hybrid-indexed"):
    _retrieval(_name, _fused_live(70), "hyb")


_COS = f"q AS (SELECT v AS qv FROM vecs WHERE track_id = '{X.SEED}'), cos AS (SELECT track_id, list_cosine_similarity(v, qv) AS score FROM vecs, q)"


def _seed(s: SparkSession, d: str) -> list[float]:
    return list(X.vectors(s, d).filter(F.col("track_id") == X.SEED).head()["vector"])


def _semantic(s: SparkSession, d: str, limit: int = LIMIT) -> DataFrame:
    scored = X.vectors(s, d).select("track_id", vectors.cosine(F.col("vector"), _seed(s, d)).alias("score"))
    return scored.orderBy(F.round("score", 9).desc(), "track_id").limit(limit)


@query(_with(X.VECTORS, _COS) + f"SELECT track_id, round(score, 6) + 0.0 AS score FROM cos ORDER BY round(score, 9) DESC, track_id LIMIT {LIMIT}")
def semantic_topk(s: SparkSession, d: str) -> DataFrame:
    return _semantic(s, d).select("track_id", _r("score"))


@query(_with(X.TRACKS, X.VECTORS, _COS) + f"SELECT track_id, round(0.36 * coalesce((score + 1) / 2, 0), 6) + 0.0 AS score FROM tracks LEFT JOIN cos USING (track_id) WHERE status = 'active' AND track_id <> '{X.SEED}' ORDER BY round(0.36 * coalesce((score + 1) / 2, 0), 9) DESC, track_id LIMIT {LIMIT}")
def learned_similar(s: SparkSession, d: str) -> DataFrame:
    similar = X.vectors(s, d).select("track_id", vectors.cosine(F.col("vector"), _seed(s, d)).alias("score"))
    rows = ranking.with_learned(catalog.candidates(X.tracks(s, d)), similar, X.SEED).filter(F.col("track_id") != X.SEED)
    return ranking.rank(rows, limit=LIMIT).select("track_id", _r("score"))


@query(_with(X.VECTORS, _COS) + f"SELECT track_id, round(score, 6) + 0.0 AS score FROM cos WHERE track_id <> '{X.SEED}' ORDER BY round(score, 9) DESC, track_id LIMIT 40")
def index_similar(s: SparkSession, d: str) -> DataFrame:
    """The nearest to a stored vector, from an index written and verified."""
    index = vectors.VectorIndex(s, X.scratch(s))
    index.save(X.vectors(s, d))
    return index.similar(X.SEED, limit=40).select("track_id", _r("score"))


# the flow with learned similarity: the seed's own track is left out
_WITH_LEARNED = f"fused AS (SELECT scored.*, own_novelty AS novelty, 0.18 * intent_score + 0.18 * energy_match + 0.05 * own_novelty + 0.36 * coalesce((c.score + 1) / 2, 0) AS score FROM scored LEFT JOIN cos c USING (track_id) WHERE track_id <> '{X.SEED}')"


@query(_walk("smooth", (X.TRACKS, X.VECTORS, _COS, CAND, SCORED, _WITH_LEARNED, RANKED)))
def flow_learned(s: SparkSession, d: str) -> DataFrame:
    index = vectors.VectorIndex(s, X.scratch(s))
    index.save(X.vectors(s, d))
    got = flows.learned(catalog.candidates(X.tracks(s, d)), flows.Request(REQUEST, limit=LIMIT), similar=index.scores(X.SEED), seed=X.SEED)
    return got.playlist.select("position", "track_id", _r("sequence_score"))


_SEM = "sem AS (SELECT track_id, score FROM cos JOIN tracks USING (track_id) WHERE status = 'active' ORDER BY round(score, 9) DESC, track_id LIMIT {n})"


def _hybrid_parts(n: int) -> tuple[str, ...]:
    scale = lambda t: f"CASE WHEN max({t}.score) OVER () = min({t}.score) OVER () THEN 1 ELSE ({t}.score - min({t}.score) OVER ()) / (max({t}.score) OVER () - min({t}.score) OVER ()) END"
    fused = f"""hyb AS (SELECT coalesce(a.track_id, b.track_id) AS track_id, coalesce(a.n, 0) AS ln, coalesce(b.n, 0) AS sn, 0.6 * coalesce(a.n, 0) + 0.4 * coalesce(b.n, 0) AS score
  FROM (SELECT track_id, {scale('lex')} AS n FROM lex) a FULL JOIN (SELECT track_id, {scale('sem')} AS n FROM sem) b ON a.track_id = b.track_id)"""
    return (X.TRACKS, X.VECTORS, _COS, _lexical_sql([LEXICAL], n), _SEM.format(n=n), fused)


def _hybrid(s: SparkSession, d: str, n: int) -> DataFrame:
    t = X.tracks(s, d)
    scored = X.vectors(s, d).join(catalog.active(t).select("track_id", "title", "artist", "album"), "track_id").select("track_id", vectors.cosine(F.col("vector"), _seed(s, d)).alias("score"), "title", "artist", "album")
    sem = scored.orderBy(F.round("score", 9).desc(), "track_id").limit(n)
    return hybrid.fuse(lexical.search(t, LEXICAL, limit=n), sem, weights=hybrid.HybridWeights(0.6, 0.4), limit=n)


@query(_with(*_hybrid_parts(LIMIT)) + f"SELECT track_id, round(score, 6) + 0.0 AS score, round(ln, 6) + 0.0 AS lexical_normalized_score, round(sn, 6) + 0.0 AS semantic_normalized_score FROM hyb ORDER BY round(score, 9) DESC, track_id LIMIT {LIMIT}")
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return _hybrid(s, d, LIMIT).select("track_id", _r("score"), _r("lexical_normalized_score"), _r("semantic_normalized_score"))


#: A request whose words are searched for, and which asks for energy .8 and discovery.
_ASKED = "small green energetic discovery"


def _asked_parts() -> tuple[str, ...]:
    return tuple(p if not p.startswith("tok AS") else _lexical_sql([_ASKED], 50) for p in _fused_live(50))


@query(_walk("journey", (*_asked_parts(), "ids AS (SELECT track_id FROM hyb ORDER BY round(score, 9) DESC, track_id LIMIT 50)", EV0, RECENT, _counters(IN_CONTEXT), CAND.replace("WHERE", "WHERE track_id IN (SELECT track_id FROM ids) AND"), SCORED.replace("0 + greatest", "greatest").replace("/ 3", "/ 2"), PERSONAL, FUSED, RANKED)))
def recommend_hybrid(s: SparkSession, d: str) -> DataFrame:
    """The whole service in hybrid mode; the request names what is looked for, an energy and something new."""
    got = flows.recommend(X.tracks(s, d), X.events(s, d), flows.Request(_ASKED, mode="journey", limit=LIMIT), context=CONTEXT, now=X.NOW, mode="hybrid", provider=X.FlagProvider(), weights=_W)
    return got.playlist.select("position", "track_id", _r("sequence_score"))


# -- playlists --------------------------------------------------------------------------------

AUDIT = "aud AS (SELECT i.*, CASE WHEN t.status IS NULL THEN 'missing' WHEN t.status = 'active' THEN 'active' ELSE 'inactive' END AS state FROM items i LEFT JOIN tracks t USING (track_id))"


@query(_with(X.TRACKS, X.ITEMS, AUDIT) + "SELECT playlist_id, count(*) FILTER (WHERE state = 'active') AS active_count, count(*) FILTER (WHERE state = 'inactive') AS inactive_count, count(*) FILTER (WHERE state = 'missing') AS missing_count FROM aud GROUP BY 1")
def playlist_audit(s: SparkSession, d: str) -> DataFrame:
    return P.audit_counts(P.audit(X.items(s, d), X.tracks(s, d)), "playlist_id")


@query(_with(X.TRACKS, X.ITEMS, AUDIT) + "SELECT playlist_id, position, track_id, CASE state WHEN 'active' THEN 'keep' ELSE 'remove' END AS action FROM aud")
def playlist_repair(s: SparkSession, d: str) -> DataFrame:
    return P.repair_plan(P.audit(X.items(s, d), X.tracks(s, d))).select("playlist_id", "position", "track_id", "action")


@query(_with(X.TRACKS, X.ITEMS) + "SELECT playlist_id, position, track_id FROM items WHERE track_id NOT IN (SELECT track_id FROM tracks WHERE status = 'active' AND lower(artist) = 'brand#12')")
def playlist_filter_remove(s: SparkSession, d: str) -> DataFrame:
    return P.filter_by_metadata(X.items(s, d), X.tracks(s, d), P.parse_edit("remove all tracks by  BRAND#12"))


@query(_with(X.TRACKS, X.ITEMS) + f"SELECT playlist_id, position, track_id FROM items WHERE track_id IN (SELECT track_id FROM tracks WHERE status = 'active' AND list_contains({GENRES}, 'small'))")
def playlist_filter_keep(s: SparkSession, d: str) -> DataFrame:
    return P.filter_by_metadata(X.items(s, d), X.tracks(s, d), P.parse_edit("keep only in genre Small"))


def _edit(name: str, commands: list[str], order: str, least: int) -> None:
    """``order`` is the new position of an item in terms of its old one (p) and the number of items (n); null drops it.

    Playlists of fewer than ``least`` items lack a track that the command names: they stay as they are, with a fault.
    """

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = P.apply_edits(X.playlists(s, d), P.parse_edits(commands), faults=True).withColumn("failed", F.col("fault").isNotNull())
        return P.exploded(rows, "playlist_id", "failed").select("playlist_id", "failed", F.col("position").cast("long").alias("position"), "track")

    run.__name__ = f"playlist_edit_{name}"
    sql = _with(X.ITEMS, f"big AS (SELECT playlist_id, track_id, position AS p, count(*) OVER (PARTITION BY playlist_id) AS n FROM items), done AS (SELECT *, CASE WHEN n >= {least} THEN {order} ELSE p END AS q FROM big)")
    query(sql + f"SELECT playlist_id, n < {least} AS failed, CAST(q AS BIGINT) AS position, track_id AS track FROM done WHERE q IS NOT NULL")(run)


_edit("remove", ["remove p1"], "CASE WHEN p = 0 THEN 0 WHEN p > 1 THEN p - 1 END", 2)
_edit("move", ["move p2 to 1"], "CASE WHEN p = 2 THEN 0 WHEN p < 2 THEN p + 1 ELSE p END", 3)
_edit("before", ["move p2 before p1"], "CASE p WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE p END", 3)
_edit("after", ["move p0 after p2"], "CASE WHEN p = 0 THEN 2 WHEN p <= 2 THEN p - 1 ELSE p END", 3)
_edit("swap", ["swap p0 with p2"], "CASE p WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE p END", 3)
_edit("trim", ["keep the first 2 tracks"], "CASE WHEN p < 2 THEN p END", 1)


@query(_with(X.ITEMS) + "SELECT playlist_id, track_id, position AS from_position, CASE WHEN position = 1 THEN NULL ELSE position - 1 END AS to_position FROM items WHERE position >= 1")
def playlist_diff(s: SparkSession, d: str) -> DataFrame:
    before = X.playlists(s, d)
    flat = lambda df: P.exploded(df, "playlist_id").select("playlist_id", F.col("position").cast("long").alias("position"), F.col("track").alias("track_id"))
    return P.diff(flat(before), flat(P.apply_edits(before, [P.Remove("p1")], faults=True)), "playlist_id")


# the first six active tracks: the third goes to the front, those of one artist go, three stay
_PLAN = """p0 AS (SELECT track_id, artist, row_number() OVER (ORDER BY track_id) AS n FROM (SELECT * FROM tracks WHERE status = 'active' ORDER BY track_id LIMIT 6)),
 p1 AS (SELECT track_id, artist, CASE WHEN n = 3 THEN 1 WHEN n < 3 THEN n + 1 ELSE n END AS n FROM p0),
 p2 AS (SELECT track_id, row_number() OVER (ORDER BY n) AS n FROM p1 WHERE lower(artist) <> (SELECT lower(artist) FROM p0 WHERE n = 2)),
 p3 AS (SELECT * FROM p2 WHERE n <= 3)"""


@query(_with(X.TRACKS, _PLAN) + "SELECT 1 AS step, n - 1 AS position, track_id FROM p1 UNION ALL SELECT 2, n - 1, track_id FROM p2 UNION ALL SELECT 3, n - 1, track_id FROM p3")
def playlist_plan(s: SparkSession, d: str) -> DataFrame:
    """The steps of commands on one playlist, names resolved against the catalog."""
    t = X.tracks(s, d)
    first = catalog.active(t).orderBy("track_id").limit(6).collect()
    items = s.createDataFrame([(r["track_id"], n) for n, r in enumerate(first)], "track_id string, position int")
    steps = P.plan_edits(items, t, [f"move track {first[2]['track_id']} to position 1", f"remove all tracks by {first[1]['artist']}", "keep first 3 tracks"])
    rows = [(k, n, i) for k, step in enumerate(steps, 1) for n, i in enumerate(step.after)]
    return s.createDataFrame(rows, "step int, position long, track_id string")


@query(_with(X.TRACKS, X.ITEMS) + "SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY position) - 1 AS position, CASE WHEN status = 'active' THEN track_id END AS track_id, CASE WHEN status <> 'active' THEN 'not an active track' END AS fault FROM items JOIN tracks USING (track_id)")
def m3u8_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Every playlist written as a document and read again; tracks no longer in use are faults."""
    t = X.tracks(s, d)
    docs = playlist_files.to_m3u8(look_up(X.items(s, d), t.select("track_id"), "track_id", "left_semi"), t, "playlist_id")
    got = playlist_files.import_rows(docs.select(F.col("playlist_id").cast("string").alias("path"), F.col("m3u8").alias("value")), t)
    return got.select(F.col("path").cast("long").alias("playlist_id"), F.col("position").cast("long").alias("position"), "track_id", "fault")


@query(_with(X.ITEMS) + "SELECT 'Mix ' || playlist_id AS name, position, track_id, round(1.0::DOUBLE / (1 + position), 6) AS sequence_score, 0.5::DOUBLE AS base_score, NULL AS fault FROM items")
def json_round_trip(s: SparkSession, d: str) -> DataFrame:
    docs = playlist_files.json_documents(X.stored_playlists(s, d))
    got = playlist_files.json_rows(docs.select(F.col("name_key").alias("path"), "value"))
    rows = got.select("name", "fault", F.explode("items").alias("i"))
    return rows.select("name", (F.col("i.position") - 1).cast("long").alias("position"), "i.track_id", _r("i.sequence_score"), "i.base_score", "fault")


@query(_with(X.ITEMS) + "SELECT CASE playlist_id WHEN 2 THEN 'Renamed' ELSE 'Mix ' || playlist_id END AS name, count(*) AS n, string_agg(track_id, ',' ORDER BY position) AS tracks FROM items WHERE playlist_id <> 3 GROUP BY playlist_id")
def store_playlists(s: SparkSession, d: str) -> DataFrame:
    """All playlists in a store, of which one is renamed, one deleted and one saved again."""
    store = Store(s, X.scratch(s))
    store.replace("playlists", X.stored_playlists(s, d))
    store.rename("MIX  2", "Renamed", now=X.NOW)
    store.delete("mix 3")
    kept = store.get("mix 1")
    if kept is not None:
        store.save("Mix 1", [(i["track_id"], 1.0, 1.0) for i in kept[1]], now=X.NOW)
    ids = F.transform("items", lambda x: x["track_id"])
    return store.list().select("name", F.size("items").cast("long").alias("n"), F.array_join(ids, ",").alias("tracks"))


@query(_with(X.TRACKS, X.ITEMS, "act AS (SELECT * FROM tracks WHERE status = 'active' AND track_id IN (SELECT track_id FROM items))") + "SELECT key, string_agg(track_id, ',' ORDER BY track_id) AS track_ids FROM (SELECT lower(title) AS key, track_id FROM act UNION SELECT lower(file_name), track_id FROM act) GROUP BY key")
def reference_resolution(s: SparkSession, d: str) -> DataFrame:
    return P.reference_map(X.items(s, d), X.tracks(s, d)).select("key", F.concat_ws(",", "track_ids").alias("track_ids"))


@query(_with(X.TRACKS, X.ITEMS) + "SELECT playlist_id, position, '#EXTINF:' || CAST(CAST(round_even(duration_seconds, 0) AS BIGINT) AS VARCHAR) || ',' || title || ' — ' || artist AS label, source_uri AS uri FROM items JOIN tracks USING (track_id)")
def m3u8_lines(s: SparkSession, d: str) -> DataFrame:
    t = X.tracks(s, d)
    return playlist_files.m3u8_lines(P.audit(X.items(s, d), t).filter("state != 'missing'"), t, "playlist_id")


# -- evaluation -------------------------------------------------------------------------------

_EVAL = f"""pool AS (SELECT query_id, count(*) AS judged, count(*) FILTER (WHERE grade >= 2) AS relevant, sum(CASE WHEN n <= 10 THEN (pow(2, grade) - 1) / log2(n + 1) END) AS idcg
   FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, CAST(doc_id AS VARCHAR)) AS n FROM judg) GROUP BY query_id),
 top AS (SELECT r.query_id, sum(coalesce((pow(2, grade) - 1) / log2(rank + 1), 0)) AS dcg, count(*) FILTER (WHERE grade >= 2) AS hits, min(rank) FILTER (WHERE grade >= 2) AS first FROM res r LEFT JOIN judg j USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1)"""


def _measured(s: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate(X.results(s, d), X.judgments(s, d))


@query(_with(X.JUDGED, _EVAL) + "SELECT query_id, CASE WHEN judged >= 3 AND idcg > 0 THEN round(coalesce(dcg, 0) / idcg, 6) + 0.0 END AS ndcg FROM pool LEFT JOIN top USING (query_id)")
def eval_ndcg(s: SparkSession, d: str) -> DataFrame:
    return _measured(s, d).select("query_id", _r("ndcg"))


@query(_with(X.JUDGED, _EVAL) + "SELECT query_id, CASE WHEN judged >= 3 AND relevant > 0 THEN round(coalesce(hits, 0) / relevant, 6) + 0.0 END AS recall FROM pool LEFT JOIN top USING (query_id)")
def eval_recall(s: SparkSession, d: str) -> DataFrame:
    return _measured(s, d).select("query_id", _r("recall"))


@query(_with(X.JUDGED, _EVAL) + "SELECT query_id, CASE WHEN judged >= 3 AND relevant > 0 THEN round(coalesce(1.0 / first, 0)::DOUBLE, 6) + 0.0 END AS rr FROM pool LEFT JOIN top USING (query_id)")
def eval_mrr(s: SparkSession, d: str) -> DataFrame:
    return _measured(s, d).select("query_id", _r("rr"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


