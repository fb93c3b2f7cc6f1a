from __future__ import annotations

import json
import math
from datetime import UTC, datetime, timedelta, timezone

import pytest
from cadenza import schemas
from cadenza.functions import scalars as S
from cadenza.operators import catalog, evaluation, events, hybrid, intent, lexical, preference, ranking, sequencing, vectors
from cadenza.operators import playlists as P
from cadenza.plans import flows
from cadenza.sources import ingest, playlist_files
from cadenza.sources.store import Store
from pyspark.sql import functions as F

NOW = datetime(2026, 9, 29, 12, tzinfo=UTC)


def track_rows(spark, *rows):
    base = {"status": "active", "source_uri": None, "title": None, "artist": None, "album": None, "album_artist": None, "composer": None, "genre": None, "file_name": "track.mp3", "rms_energy": None, "tempo_bpm": 100.0, "sample_rate": None, "spectral_centroid": None, "mfcc_json": None, "chroma_json": None, "duration_seconds": None}
    schema = "track_id string, status string, source_uri string, title string, artist string, album string, album_artist string, composer string, genre string, file_name string, rms_energy double, tempo_bpm double, sample_rate int, spectral_centroid double, mfcc_json string, chroma_json string, duration_seconds double"
    return spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)


def event_rows(spark, *rows):
    return spark.createDataFrame([(n, t, k, at, c, None) for n, (t, k, at, c) in enumerate(rows)], schemas.EVENTS)


def signals(spark, **by_track):
    rows = [(t, *(float(v.get(s, 0.0)) for s in schemas.SIGNALS)) for t, v in by_track.items()]
    return spark.createDataFrame(rows, "track_id string, " + ", ".join(f"{s} double" for s in schemas.SIGNALS))


# -- scalars and projections ----------------------------------------------------------------


def test_dna(spark):
    t = track_rows(spark, {"track_id": "a", "rms_energy": -0.5, "sample_rate": 16000, "spectral_centroid": 4000.0, "mfcc_json": "[1, 2.5]", "chroma_json": "{}"}, {"track_id": "b", "rms_energy": 1.5, "sample_rate": 0, "spectral_centroid": 1.0, "mfcc_json": "no"}, {"track_id": "c"})
    got = {r.track_id: r for r in catalog.music_dna(t).collect()}
    assert (got["a"].energy, got["a"].brightness, got["a"].mfcc, got["a"].chroma) == (0.0, 0.5, [1.0, 2.5], [])
    assert (got["b"].energy, got["b"].brightness, got["b"].mfcc) == (1.0, None, [])
    assert got["c"].energy is None and got["c"].brightness is None


def test_candidates_and_order(spark):
    t = track_rows(spark, {"track_id": "b", "genre": " Rock, pop ,ROCK,"}, {"track_id": "a"}, {"track_id": "c", "status": "inactive"})
    assert [r.track_id for r in catalog.candidates(t, limit=5).collect()] == ["a", "b"]
    assert catalog.candidates(t).filter("track_id = 'b'").head().genres == ["pop", "rock"]
    assert [r.track_id for r in catalog.candidates_by_ids(t, ["b", "zz", "c", "a"]).collect()] == ["b", "a"]
    for bad in (True, 0, -1):
        with pytest.raises(ValueError):
            catalog.candidates(t, limit=bad)
    with pytest.raises(ValueError):
        catalog.candidates_by_ids(t, ["a", "a"])


def test_catalog_text_and_embedding(spark):
    t = track_rows(spark, {"track_id": "a", "title": "Hero", "artist": "", "genre": "bgm", "file_name": "h.mp3"})
    assert catalog.catalog_text(t).head().text == "title: Hero | genre: bgm | file name: h.mp3"
    full = track_rows(spark, {"track_id": "a", "mfcc_json": json.dumps([1.0] * 13), "chroma_json": json.dumps([2.0] * 14), "tempo_bpm": None})
    v = catalog.dsp_embedding(full).head().vector
    assert len(v) == 31 and math.isclose(sum(x * x for x in v), 1, rel_tol=1e-6)
    with pytest.raises(Exception, match="31 numbers"):
        catalog.dsp_embedding(t).collect()


def test_similarity_and_boost(spark):
    got = spark.createDataFrame([(0.9,), (0.1,), (float("nan"),), (-3.0,)], "x double").select(S.similarity_score(F.col("x")).alias("s"), S.preference_boost(F.col("x")).alias("b")).collect()
    assert [round(r.s, 9) for r in got] == [0.95, 0.55, 0.0, 0.0] and got[3].b == -1.0
    with pytest.raises(ValueError):
        S.preference_boost(F.col("x"), 1, 1)


# -- search -----------------------------------------------------------------------------------


def test_field_scores(spark):
    t = track_rows(spark, {"track_id": "t", "title": "hero"}, {"track_id": "a", "artist": "Hero"}, {"track_id": "g", "genre": "HERO"}, {"track_id": "x", "title": "hero", "status": "missing"})
    assert [(r.track_id, r.score, r.matched_fields) for r in lexical.search(t, "hero").collect()] == [("t", 1.0, ["title"]), ("a", 0.85, ["artist"]), ("g", 0.6, ["genre"])]
    two = track_rows(spark, {"track_id": "both", "title": "Hero entry"}, {"track_id": "one", "title": "hero"})
    assert [(r.track_id, r.score) for r in lexical.search(two, "hero entry").collect()] == [("both", 1.0), ("one", 0.5)]
    for bad in ("", "  ", "!!"):
        with pytest.raises(ValueError):
            lexical.search(t, bad)


def test_expansion(spark):
    assert lexical.expand_query(" hero  bgm ") == ["hero bgm", "hero background music", "hero background score"]
    assert lexical.expand_query("lost") == ["lost"]
    assert lexical.expand_query("lost", legacy_substring=True)[1] == "lsoundtrack"
    t = track_rows(spark, {"track_id": "s", "title": "soundtrack"}, {"track_id": "o", "title": "original soundtrack"})
    assert [(r.track_id, r.matched_query) for r in lexical.search(t, "ost", expand=True).collect()] == [("o", "original soundtrack"), ("s", "soundtrack")]
    assert lexical.search(t, "ost").count() == 0


class Static:
    def embed_documents(self, texts):
        return [(1.0, 0.0) if "hero" in t.lower() else (0.0, 1.0) for t in texts]

    def embed_query(self, text):
        return (1.0, 0.0)


def test_semantic_and_hybrid(spark):
    t = track_rows(spark, {"track_id": "a", "title": "Hero"}, {"track_id": "b", "title": "calm"}, {"track_id": "c", "title": "hero", "status": "missing"})
    s = flows.SearchService(t)
    assert [(r.track_id, r.score) for r in s.semantic_search("q", Static()).collect()] == [("a", 1.0), ("b", 0.0)]
    assert [(r.track_id, r.score) for r in s.hybrid_search("hero", Static()).collect()] == [("a", 1.0), ("b", 0.0)]
    v = spark.createDataFrame([([1.0, 0.0],), ([0.6, 0.8],), ([-1.0, 0.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in v.select(vectors.cosine(F.col("v"), [1.0, 0.0])).collect()] == [1.0, 0.6, -1.0, 0.0]


def results(spark, *rows):
    return spark.createDataFrame([(t, s, None, None, None) for t, s in rows], "track_id string, score double, title string, artist string, album string")


def test_fusion_of_results(spark):
    none = results(spark)
    assert [(r.track_id, r.score) for r in hybrid.fuse(none, results(spark, ("x", -0.5), ("y", 0.5))).collect()] == [("y", 0.5), ("x", 0.0)]
    got = {r.track_id: r for r in hybrid.fuse(results(spark, ("a", 0.8), ("b", 0.8)), none).collect()}
    assert got["a"].lexical_normalized_score == got["b"].lexical_normalized_score == 1.0
    for bad in ((("a", float("nan")),), (("a", 1.0), ("a", 2.0)), ((" ", 1.0),)):
        with pytest.raises(Exception, match="unique ids and finite scores"):
            hybrid.fuse(results(spark, *bad), none).collect()
    for bad in ((True, 1), (-1, 2), (0, 0), (float("inf"), 1)):
        with pytest.raises(ValueError):
            hybrid.HybridWeights(*bad)


def test_vector_index(spark, tmp_path):
    index = vectors.VectorIndex(spark, str(tmp_path / "v"))
    assert index.load().count() == 0 and index.search([1.0, 0.0]).count() == 0
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [-1.0, 0.0])], "track_id string, vector array<float>")
    assert index.save(rows) == 3
    assert [r.track_id for r in index.search([2.0, 0.0], limit=2).collect()] == ["a", "b"]
    assert [r.track_id for r in index.similar("a", limit=2).collect()] == ["b", "c"]
    for bad in ([0.0, 0.0], [1.0], [float("nan"), 1.0]):
        assert index.search(bad).count() == 0
    with pytest.raises(KeyError):
        index.similar("zz")
    with pytest.raises(ValueError):
        index.save(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], rows.schema))
    for part in (tmp_path / "v" / index.manifest()["data"]).glob("part-*"):
        part.unlink()
    with pytest.raises(ValueError):
        index.load()


def test_semantic_index_freshness(spark, tmp_path):
    t = track_rows(spark, {"track_id": "a", "title": "Hero"}, {"track_id": "b", "title": "calm"})
    index, profile = vectors.SemanticTextIndex(spark, str(tmp_path / "s")), vectors.TextEmbeddingProfile("m")
    with pytest.raises(FileNotFoundError):
        index.search(t, "hero", Static(), profile)
    assert index.rebuild(t, Static(), profile) == 2
    assert [r.track_id for r in index.search(t, "hero", Static(), profile).collect()] == ["a", "b"]
    with pytest.raises(vectors.StaleIndexError):
        index.search(t.withColumn("title", F.lit("new")), "hero", Static(), profile)
    with pytest.raises(vectors.StaleIndexError):
        index.search(t, "hero", Static(), vectors.TextEmbeddingProfile("other"))
    assert index.rebuild(t.limit(0), Static(), profile) == 0
    with pytest.raises(ValueError):
        vectors.TextEmbeddingProfile(" ")


# -- events, preference, ranking ------------------------------------------------------------------


def test_preference_and_novelty(spark):
    e = event_rows(spark, ("a", "like", NOW, " Coding "), ("b", "like", NOW - timedelta(days=30), "coding"), ("a", "skip", NOW, "gym"), ("c", "play", NOW + timedelta(days=9), "coding"), ("c", "play", NOW, "coding"))
    got = {r.track_id: r.preference_score for r in preference.contextual_preference(e, context="coding", now=NOW).collect()}
    assert got["a"] == 0.46211715726000974 and round(got["b"], 10) == 0.2449186624
    new = {r.track_id: round(r.novelty_score, 9) for r in preference.contextual_novelty(e, context="CODING", now=NOW).collect()}
    assert new["a"] == 0.5 and new["c"] == round(1 / 3, 9)
    assert preference.contextual_preference(e, context="  ", now=NOW).count() == 0
    with pytest.raises(ValueError):
        preference.preference(e, now=datetime(2026, 1, 1))
    both = {r.track_id: (r.preference_score, round(r.novelty_score, 9)) for r in preference.personal(e, context="coding", now=NOW).collect()}
    assert both["a"] == (got["a"], 0.5)


def test_summary_and_recent(spark):
    e = event_rows(spark, ("a", "play", NOW, "coding"), ("a", "like", NOW, " Coding"), ("b", "play", NOW, "gym"), ("b", "skip", NOW - timedelta(1), "GYM "), ("c", "play", NOW, " "))
    assert [(r.context, r.event_count, r.distinct_tracks) for r in events.context_counts(e).collect()] == [("coding", 2, 1), ("gym", 2, 1), (None, 1, 1)]
    assert [(r.event_type, r.n) for r in events.type_counts(e).collect()] == [("play", 3), ("complete", 0), ("skip", 1), ("like", 1), ("dislike", 0), ("replay", 0)]
    assert [r.id for r in events.recent(e, limit=2).collect()] == [4, 2]
    lines = events.format_events(event_rows(spark, ("a", "play", NOW, "x\ty\n"))).head().line
    assert lines == "2026-09-29T12:00:00+00:00\tplay\ta\tx\\ty\\n\t"
    profile = preference.taste_lists(preference.taste_profile(e, now=NOW))
    assert profile["positive"] == ["a", "b", "c"] and profile["skip"] == ["b"] and profile["negative"] == [] and profile["context"] == [" ", " Coding", "GYM ", "coding", "gym"]


def test_fusion(spark):
    # .18 * .2 + .18 * 1 - .05 * 2 = .116; equal halves of learned and preference weigh .36 and .18
    rows = signals(spark, x={"metadata_score": 0.2, "dsp_score": 1.0, "novelty_score": -2.0}, y={"learned_score": 0.4, "preference_score": 0.4}, n={"diversity_score": float("inf")}, m={})
    got = ranking.rank(rows).collect()
    assert [(r.track_id, round(r.score, 9)) for r in got] == [("y", 0.216), ("x", 0.116), ("m", 0.0), ("n", 0.0)]
    assert [r.strongest_signal for r in got] == ["learned_score", "dsp_score", None, None]
    assert [round(c["contribution"], 9) for c in got[1].contributions] == [0.036, 0.18, 0.0, 0.0, -0.1, 0.0]
    with pytest.raises(ValueError):
        ranking.FusionWeights(0, 0, 0, 0, 0, 0).normalized()
    with pytest.raises(ValueError):
        ranking.rank(signals(spark, a={}), limit=0)
    similar = spark.createDataFrame([("p", -0.5), ("q", 0.5), ("seed", 1.0), ("odd", float("nan"))], "track_id string, score double")
    learned = {r.track_id: r.learned_score for r in ranking.with_learned(signals(spark, p={}, q={}, seed={}, odd={}, far={"learned_score": 0.3}), similar, "seed").collect()}
    assert {k: round(v, 9) for k, v in learned.items()} == {"p": 0.25, "q": 0.75, "seed": 0.0, "odd": 0.0, "far": 0.3}


INTENTS = ["dark Tamil BGM for a chase", "very high energy south-indian mass entry", "calm folk songs without vocals", "something I know", "vocal romance, moderate", "nothing at all", "High_energy intense discovery less vocal"]


def test_intent_on_driver_and_columns(spark):
    i = intent.parse_intent("Emotional South Indian hero-entry BGM, very high energy, no vocals, something new")
    assert (i.regions, i.scenes, i.music_types, i.moods, i.energy, i.vocal_preference, i.novelty, i.negative_terms, i.confidence) == (("south_india",), ("hero_entry",), ("bgm",), ("emotional",), 0.95, "instrumental", "discovery", ("vocals",), 1.0)
    got = intent.parse_intents(spark.createDataFrame([(n, t) for n, t in enumerate(INTENTS)], "n int, text string")).orderBy("n").collect()
    for text, row in zip(INTENTS, got, strict=True):
        one = intent.parse_intent(text)
        for f in (*intent.VOCABULARY, "negative_terms"):
            assert tuple(row[f]) == getattr(one, f), (text, f)
        assert (row.energy, row.vocal_preference, row.novelty, row.confidence) == (one.energy, one.vocal_preference, one.novelty, one.confidence)
    with pytest.raises(ValueError):
        intent.parse_intent(" ")


def test_intent_scores(spark):
    t = track_rows(spark, {"track_id": "a", "rms_energy": 0.8}, {"track_id": "b"}).withColumn("moods", F.array(F.lit("dark")))
    got = {r.track_id: r for r in intent.score(catalog.candidates(t), intent.parse_intent("dark high energy no vocals discovery")).collect()}
    assert round(got["a"].intent_score, 9) == round((1 + 1 + 0.5 + 0) / 4, 9) and got["b"].energy_match == 0.5
    assert got["a"].matched_dimensions == ["moods", "energy", "vocal"]
    assert intent.score(catalog.candidates(t), intent.parse_intent("hello")).head().intent_score == 0.0


def sequence_rows(**rows):
    base = {"base_score": 0.5, "energy": None, "tempo_bpm": None, "brightness": None, "novelty_score": 0.0}
    return [base | {"track_id": k} | v for k, v in rows.items()]


def test_sequences(spark):
    """Five tracks whose steps are worked out by hand: distance is .5 of energy, .005 of tempo and .2 of brightness."""
    rows = sequence_rows(
        dawn={"base_score": 0.70, "energy": 0.2, "tempo_bpm": 80.0, "brightness": 0.1},
        noon={"base_score": 0.60, "energy": 0.9, "tempo_bpm": 140.0, "brightness": 0.8, "novelty_score": 0.1},
        dusk={"base_score": 0.55, "energy": 0.3, "tempo_bpm": 90.0, "brightness": None, "novelty_score": 0.9},
        night={"base_score": 0.40, "energy": None, "tempo_bpm": 60.0, "brightness": 0.1, "novelty_score": 0.6},
        rain={"base_score": 0.55, "energy": 0.3, "tempo_bpm": 90.0, "brightness": 0.6, "novelty_score": 0.9},
    )
    got = lambda mode, limit=5, **k: [(i, round(s, 6)) for i, s, _ in sequencing.order(rows, mode, limit, **k)]
    # from dawn: noon .6 - (.35 + .3 + .14), dusk .55 - (.05 + .05), night .4 - .1, rain .55 - (.05 + .05 + .1)
    assert got("smooth", 2) == [("dawn", 0.7), ("dusk", 0.45)]
    # then from dusk: rain .55 - 0 (brightness unknown), noon .6 - (.3 + .25), night .4 - .15
    assert got("smooth", 4)[2:] == [("rain", 0.55), ("night", 0.15)]
    assert got("contrast", 2) == [("dawn", 0.7), ("noon", 1.39)]
    # journey over three: targets .3, .6, .9
    assert got("journey", 3) == [("dawn", 0.7), ("night", 0.4), ("noon", 0.6)]
    assert got("discovery", 3) == [("dawn", 0.7), ("dusk", 1.0), ("rain", 1.0)]
    assert got("smooth", 2, seed="night")[0] == ("night", 0.4)
    assert [sequencing.target_energy(i, 4) for i in range(4)] == [0.3, 0.5, 0.7, 0.9] and sequencing.target_energy(0, 1) == 0.5
    assert sequencing.order([], "smooth", 3) == []
    for bad in ({"energy": 1.01}, {"tempo_bpm": -4.0}, {"base_score": float("inf")}, {"brightness": -0.1}):
        with pytest.raises(ValueError):
            sequencing.order(sequence_rows(one=bad), "smooth", 5)
    with pytest.raises(ValueError):
        sequencing.order(rows, "smooth", 5, seed="fog")
    kinds = "track_id string, base_score double, energy double, tempo_bpm double, brightness double, novelty_score double"
    names = [k.split()[0] for k in kinds.split(", ")]
    frame = spark.createDataFrame([(q, *(r[n] for n in names)) for q in ("first", "second") for r in rows], "request_id string, " + kinds)
    both = sequencing.sequence(frame, mode="contrast", limit=3).orderBy("request_id", "position").collect()
    one = [i for i, _ in got("contrast", 3)]
    assert [(r.request_id, r.track_id) for r in both] == [(q, t) for q in ("first", "second") for t in one]


def test_flows(spark):
    t = track_rows(spark, *({"track_id": i, "title": f"Cinematic {i}", "genre": "cinematic", "rms_energy": e} for i, e in (("a", 0.8), ("b", 0.5), ("c", 0.2))))
    request = flows.Request("high energy", limit=2)
    assert [r.track_id for r in flows.end_to_end(catalog.candidates(t), request).playlist.orderBy("position").collect()] == ["a", "b"]
    e = event_rows(spark, ("c", "like", NOW, "coding"))
    got = flows.recommend(t, e, flows.Request("cinematic", limit=3), context="coding", now=NOW).ranked.collect()
    assert got[0].track_id == "c" and got[0].preference_score == 0.46211715726000974 and got[0].novelty_score == 0.5 and got[1].novelty_score == 1.0
    similar = spark.createDataFrame([("b", 0.9), ("c", 0.1)], "track_id string, score double")
    assert [r.track_id for r in flows.learned(catalog.candidates(t), flows.Request("x", limit=5), similar=similar, seed="a").ranked.collect()] == ["b", "c"]
    for mode, k in (("lexical", {}), ("semantic", {"provider": Static()}), ("hybrid", {"provider": Static()})):
        assert {r.track_id for r in flows.retrieve(t, "cinematic", mode, request_limit=2, **k).collect()} == {"a", "b", "c"}
    for bad in ({"mode": "x"}, {"mode": "semantic"}, {"mode": "lexical", "catalog_limit": 3}, {"mode": "semantic-indexed", "provider": Static()}):
        with pytest.raises(ValueError):
            flows.retrieve(t, "q", request_limit=2, **bad)
    with pytest.raises(ValueError):
        flows.recommend(t, e, request, context=" ", now=NOW)


# -- playlists ------------------------------------------------------------------------------------

ACCEPTED = {
    "remove track-a": P.Remove("track-a"), "Delete track 'a b'": P.Remove("a b"), "drop x": P.Remove("x"), "skip track x": P.Remove("x"),
    "move a before b": P.MoveBefore("a", "b"), "move track a after track b": P.MoveAfter("a", "b"), "move a to 3": P.Move("a", 2), "move a into position 1": P.Move("a", 0), "move a position 2": P.Move("a", 1),
    "swap a with b": P.Swap("a", "b"), "switch tracks a and b": P.Swap("a", "b"), "trim to 4": P.Trim(4), "shorten playlist at 2": P.Trim(2), "limit to 1": P.Trim(1),
    "keep first 3 tracks": P.Trim(3), "retain the 2 items": P.Trim(2), "remove all by X  Y": P.MetadataFilter("remove", "artist", "X Y"), "remove all tracks from album Z": P.MetadataFilter("remove", "album", "Z"),
    "KEEP ONLY tracks in genre bgm": P.MetadataFilter("keep_only", "genre", "bgm"), "remove all tracks": P.Remove("all tracks"),
}


def test_grammar():
    for text, command in ACCEPTED.items():
        assert P.parse_edit(text) == command, text
    for bad in ("", "  ", "dance", "move a to 0", "trim to 0", "swap a with a", "move a before a", "remove ''"):
        with pytest.raises(ValueError):
            P.parse_edit(bad)
    assert [P.describe(c) for c in (P.Move("a", 0), P.Swap("a", "b"), P.MetadataFilter("keep_only", "album", "Z"))] == ["move a to position 1", "swap a with b", "keep only tracks from album Z"]


def test_edits(spark):
    rows = spark.createDataFrame([(1, [("a",), ("b",), ("c",), ("d",)])], "id int, items array<struct<track_id string>>")
    after = lambda *e: "".join(x["track_id"] for x in P.apply_edits(rows, e).head()["items"])
    assert after(P.Remove("b")) == "acd" and after(P.Move("d", 0)) == "dabc" and after(P.Move("a", 3)) == "bcda"
    assert after(P.MoveBefore("d", "b")) == "adbc" and after(P.MoveAfter("a", "c")) == "bcad" and after(P.Swap("a", "d")) == "dbca"
    assert after(P.Trim(2)) == "ab" and after(P.Remove("a"), P.Swap("b", "d"), P.Trim(2)) == "dc"
    for bad in (P.Remove("z"), P.Move("a", 4), P.MoveBefore("a", "z")):
        with pytest.raises(Exception, match="playlist"):
            P.apply_edits(rows, [bad]).collect()
    twice = spark.createDataFrame([(1, [("a",), ("a",)])], rows.schema)
    with pytest.raises(Exception, match="unique"):
        P.apply_edits(twice, [P.Trim(1)]).collect()


def items(spark, *ids):
    return spark.createDataFrame([(n, t, 0.5, 0.25) for n, t in enumerate(ids)], "position int, track_id string, sequence_score double, base_score double")


def test_edits_of_tables_with_faults(spark):
    rows = spark.createDataFrame([(1, [("a",), ("b",), ("c",)]), (2, [("a",)]), (3, [("b",), ("a",)])], "id int, items array<struct<track_id string>>")
    got = {r.id: ("".join(x["track_id"] for x in r["items"]), r.fault) for r in P.apply_edits(rows, [P.Swap("a", "b"), P.Move("a", 2), P.Remove("b")], faults=True).collect()}
    assert got == {1: ("ca", None), 2: ("a", "track not in playlist: b"), 3: ("ab", "position outside the playlist")}
    with pytest.raises(Exception, match="playlist"):
        P.apply_edits(rows, [P.Remove("b")]).collect()


def test_commands_of_many_words():
    cases = {
        "move track before x": P.MoveBefore("track", "x"), "move before dawn after dusk": P.MoveAfter("before dawn", "dusk"), "move to the sea to 2": P.Move("to the sea", 1),
        "swap bread and butter with jam": P.Swap("bread", "butter with jam"), "delete all by x": P.Remove("all by x"), "remove track": P.Remove("track"), "KEEP THE FIRST 4": P.Trim(4),
        "move track 7 to position 3": P.Move("7", 2), "remove all track from album first": P.MetadataFilter("remove", "album", "first"), "keep only by 'A  b'": P.MetadataFilter("keep_only", "artist", "A b"),
    }
    for text, command in cases.items():
        assert P.parse_edit(text) == command, text
    for bad in ("keep first", "keep only", "retain only by x", "trim 4", "move a to", "swap a b", "move a to x", "keep 3 songs"):
        with pytest.raises(ValueError):
            P.parse_edit(bad)


def test_catalog_edits(spark):
    t = track_rows(spark, {"track_id": "1", "title": "Alpha Song", "artist": "X  Y", "genre": "bgm"}, {"track_id": "2", "title": "Beta", "artist": "Z", "genre": "pop, bgm"}, {"track_id": "3", "title": "beta", "artist": "x y", "status": "inactive"}, {"track_id": "4", "title": "Beta", "file_name": "four.mp3"})
    left = lambda command: [r.track_id for r in P.filter_by_metadata(items(spark, "1", "2", "3", "9"), t, P.parse_edit(command)).orderBy("position").collect()]
    assert left("remove all by x y") == ["2", "3", "9"] and left("keep only in genre BGM") == ["1", "2"]
    steps = P.plan_edits(items(spark, "1", "2", "3"), t, ["move alpha  song to 3", "remove beta", "keep only in genre pop"][:2])
    assert [s[1] for s in steps] == [["2", "3", "1"], ["3", "1"]]
    assert [P.describe_change(*c) for c in steps[0][2]] == ["move 1 from position 1 to position 3", "move 2 from position 2 to position 1", "move 3 from position 3 to position 2"]
    with pytest.raises(ValueError, match="ambiguous"):
        P.plan_edits(items(spark, "2", "4"), t, ["remove beta"])
    audited = P.audit(items(spark, "1", "3", "9"), t)
    assert [r.state for r in audited.orderBy("position").collect()] == ["active", "inactive", "missing"]
    assert tuple(P.audit_counts(audited).head()) == (1, 1, 1)
    assert [r.action for r in P.repair_plan(audited).orderBy("position").collect()] == ["keep", "remove", "remove"]
    assert P.changes(["a", "b"], ["b", "c"]) == [("a", 0, None), ("b", 1, 0), ("c", None, 1)]


def test_json_and_m3u8(spark, tmp_path):
    text = playlist_files.to_json("Mü", NOW, NOW, [{"track_id": "a", "sequence_score": 1.0, "base_score": 0.5}])
    assert text.endswith("}\n") and "Mü" in text and '"position": 1' in text
    assert playlist_files.parse_json(text) == ("Mü", [("a", 1.0, 0.5)])
    good = json.loads(text)
    item = good["items"][0]
    for bad in ({"version": True}, {"version": 2}, {"name": " "}, {"created_at": "2026-01-01T00:00:00"}, {"items": {}}, {"items": [item | {"position": 2}]}, {"items": [item | {"base_score": True}]}, {"items": [item, item | {"position": 2}]}, {"items": [item | {"track_id": ""}]}):
        with pytest.raises(ValueError):
            playlist_files.parse_json(json.dumps(good | bad))
    t = track_rows(spark, {"track_id": "a", "source_uri": "file:///a.mp3", "title": " T ", "artist": "A", "duration_seconds": 2.5}, {"track_id": "b", "source_uri": "file:///b.mp3", "duration_seconds": -1.0}, {"track_id": "w", "source_uri": "http://w"})
    doc = playlist_files.to_m3u8(items(spark, "a", "b"), t).head().m3u8
    assert doc == "#EXTM3U\n#EXTINF:2,T — A\nfile:///a.mp3\n#EXTINF:-1,b\nfile:///b.mp3\n"
    (tmp_path / "p.m3u8").write_text(doc)
    assert [r.track_id for r in playlist_files.load_m3u8(spark, str(tmp_path / "p.m3u8"), t).orderBy("position").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="no local file"):
        playlist_files.to_m3u8(items(spark, "w"), t).collect()
    ids = {"file:///a.mp3": "a"}
    for bad in ("", "x", "#EXTM3U\nfile:///a.mp3", "#EXTM3U\n#EXTINF:1,x\n#EXTINF:1,x\nfile:///a.mp3", "#EXTM3U\n#EXTINF:1,x", "#EXTM3U\n#EXTINF:n,x\nfile:///a.mp3", "#EXTM3U\n#EXTINF:1,x\nhttp://a", "#EXTM3U\n#EXTINF:1,x\nfile:///z.mp3"):
        with pytest.raises(ValueError):
            playlist_files.parse_m3u8(bad, ids)
    rows = playlist_files.m3u8_rows(spark.createDataFrame([("p", doc + "file:///c.mp3\n")], "path string, value string")).orderBy("n").collect()
    assert [(r.uri, r.seconds, r.fault) for r in rows] == [("file:///a.mp3", 2.0, None), ("file:///b.mp3", -1.0, None), ("file:///c.mp3", None, "track without a description")]


# -- store and ingestion -----------------------------------------------------------------------------


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.replace("tracks", spark.createDataFrame([("a", "missing")], "track_id string, status string"))
    row = store.record_event("a", "like", occurred_at=datetime(2026, 1, 1, 2, tzinfo=timezone(timedelta(hours=2))), context="  ")
    assert row["id"] == 1 and row["context"] is None and store.record_event("a", "play")["id"] == 2
    for bad in (("zz", "like", {}), ("a", "hum", {}), ("a", "like", {"occurred_at": datetime(2026, 1, 1)}), ("a", "like", {"seconds_played": -1.0}), ("a", "like", {"seconds_played": True})):
        with pytest.raises(ValueError):
            store.record_event(bad[0], bad[1], **bad[2])
    assert store.table("listening_events").count() == 2
    store.save("My  Mix", [("a", 1.0, 0.5), ("b", 0.5, 0.5)], now=NOW)
    store.save("my mix", [("b", 1.0, 1.0)], now=NOW + timedelta(1))
    head, rows = store.get("MY MIX")
    assert head["name"] == "my mix" and head["created_at"] < head["updated_at"] and [r["track_id"] for r in rows] == ["b"]
    store.save("other", [], now=NOW)
    with pytest.raises(ValueError):
        store.rename("other", "My mix")
    assert store.rename("my mix", "MY MIX", now=NOW) and not store.rename("no", "yes")
    assert [(r.name, len(r["items"] or [])) for r in store.list().collect()] == [("MY MIX", 1), ("other", 0)]
    assert store.delete("my mix") and not store.delete("my mix") and store.get("my mix") is None
    with pytest.raises(ValueError):
        store.save("x", [("a", 1.0, 1.0), ("a", 1.0, 1.0)])


def test_publishing_leaves_no_gap(spark, tmp_path, monkeypatch):
    """A crash at any step of publishing leaves the old version to be read; a stray part file is nothing."""
    path = str(tmp_path / "p" / "current")
    assert vectors.published(spark, path) is None
    for n in range(12):
        vectors.publish(spark, path, f"version {n}")
        assert vectors.published(spark, path) == f"version {n}"
    assert len([f for f in (tmp_path / "p").iterdir() if f.name.startswith("current.v")]) == 2
    real = vectors._fs

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "rename":
                raise OSError("the machine stops here")
            return getattr(self.fs, name)

    monkeypatch.setattr(vectors, "_fs", lambda spark, path: (Broken(real(spark, path)[0]), real(spark, path)[1]))
    with pytest.raises(OSError):
        vectors.publish(spark, path, "never")
    monkeypatch.undo()
    assert vectors.published(spark, path) == "version 11"


def test_damaged_index_is_not_searched(spark, tmp_path):
    index = vectors.VectorIndex(spark, str(tmp_path / "v"))
    index.save(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "track_id string, vector array<double>"))
    spark.createDataFrame([("c", [1.0, 0.0])], "track_id string, vector array<double>").write.mode("append").parquet(str(tmp_path / "v" / index.manifest()["data"]))
    with pytest.raises(ValueError, match="manifest"):
        index.search([1.0, 0.0])
    with pytest.raises(ValueError, match="manifest"):
        index.similar("a")
    assert index.search([1.0, 0.0], verify=False).count() == 3


def test_unchanged_files_are_not_opened(spark, tmp_path):
    music = tmp_path / "music"
    music.mkdir()
    for name in ("old.mp3", "new.mp3"):
        (music / name).write_bytes(b"sound")
    store = Store(spark, str(tmp_path / "db"))
    meta = lambda content, name: {"title": name}
    silent = lambda content, name: {"sample_rate": 8000, "channels": 1, "analysis_seconds": 0.0, "mfcc_json": "[]", "chroma_json": "[]"}
    assert ingest.scan(store, str(music), metadata=meta, analyzer=silent)[0] == 2
    row = store.table("tracks").filter("file_name = 'old.mp3'").head()
    assert (row.source_type, row.analysis_mode, row.analysis_seconds, row.sample_rate, row.tempo_bpm) == ("local_file", "bounded", 0.0, 8000, None)
    opened = tmp_path / "opened"
    opened.mkdir()

    def watched(content, name):
        (opened / name).touch()
        return {"title": name}

    (music / "new.mp3").write_bytes(b"another sound")
    (music / "sp ace+%.mp3").write_bytes(b"x")
    n, issues = ingest.scan(store, str(music), metadata=watched, analyzer=silent)
    assert store.table("tracks").filter("file_name = 'sp ace+%.mp3'").head().source_uri == (music / "sp ace+%.mp3").as_uri()
    assert n == 2 and issues.count() == 0 and sorted(p.name for p in opened.iterdir()) == ["new.mp3", "sp ace+%.mp3"]


def test_documents_in_the_plan(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.save("Mix", [("a", 1.0, 0.5), ("b", 0.25, 0.5)], now=NOW)
    docs = playlist_files.json_documents(store.table("playlists"))
    assert playlist_files.parse_json(docs.head().value) == ("Mix", [("a", 1.0, 0.5), ("b", 0.25, 0.5)])
    good = json.loads(docs.head().value)
    item = good["items"][0]
    bad = [{"version": 2}, {"name": " "}, {"created_at": "2026-01-01T00:00:00"}, {"items": None}, {"items": [item | {"position": 2}]}, {"items": [item | {"base_score": None}]}, {"items": [item, item | {"position": 2}]}, {"items": [item | {"track_id": ""}]}]
    texts = [json.dumps(good)] + [json.dumps(good | b) for b in bad] + ["no json"]
    got = playlist_files.json_rows(spark.createDataFrame(list(enumerate(texts)), "path int, value string")).orderBy("path").collect()
    assert got[0].fault is None and [i["track_id"] for i in got[0]["items"]] == ["a", "b"]
    assert all(r.fault is not None and r["items"] is None for r in got[1:]), [r.fault for r in got]
    t = track_rows(spark, {"track_id": "a", "source_uri": "file:///a.mp3"}, {"track_id": "b", "source_uri": "file:///b.mp3", "status": "missing"})
    text = "#EXTM3U\n#EXTINF:1,x\nfile:///a.mp3\n#EXTINF:1,y\nfile:///b.mp3\n"
    rows = playlist_files.import_rows(spark.createDataFrame([("p", text)], "path string, value string"), t).orderBy("position").collect()
    assert [(r.position, r.track_id, r.fault) for r in rows] == [(0, "a", None), (1, None, "not an active track")]


def test_incremental_scan(spark, tmp_path):
    music = tmp_path / "music"
    (music / "sub").mkdir(parents=True)
    for name in ("a.mp3", "sub/b.FLAC", "notes.txt"):
        (music / name).write_bytes(name.encode())
    store = Store(spark, str(tmp_path / "db"))
    meta = lambda content, name: {"title": content.decode(), "duration_seconds": 9.0}
    tone = lambda content, name: {"tempo_bpm": 120.0, "analysis_seconds": 60.0, "mfcc_json": "[0.1]", "sample_rate": 44100, "channels": 1}
    scan = lambda **k: ingest.scan(store, str(music), metadata=k.pop("metadata", meta), analyzer=k.pop("analyzer", tone), **k)
    assert scan()[0] == 2
    rows = {r.file_name: r for r in store.table("tracks").collect()}
    import hashlib

    uri = (music / "a.mp3").as_uri()
    assert rows["a.mp3"].track_id == hashlib.sha256(uri.encode()).hexdigest() and rows["a.mp3"].source_uri == uri
    assert rows["a.mp3"].content_hash == hashlib.sha256(b"a.mp3").hexdigest() and rows["b.FLAC"].title == "sub/b.FLAC" and rows["a.mp3"].tempo_bpm == 120.0
    assert scan()[0] == 0
    assert scan(config=ingest.AnalysisConfig(60.0))[0] == 2
    assert store.table("tracks").head().analysis_version == "m0.5|max=60|off=0"

    def broken(content, name):
        raise OSError("no sound")

    (music / "a.mp3").write_bytes(b"longer than before")
    n, issues = scan(config=ingest.AnalysisConfig(60.0), analyzer=broken)
    row = store.table("tracks").filter("file_name = 'a.mp3'").head()
    assert n == 1 and [(i.stage, i.error_type) for i in issues.collect()] == [("analysis", "OSError")]
    assert row.analysis_mode == "failed" and row.analysis_seconds is None and row.tempo_bpm == 120.0
    (music / "a.mp3").unlink()
    scan(analyze=False)
    assert {r.file_name: r.status for r in store.table("tracks").collect()} == {"a.mp3": "missing", "b.FLAC": "active"}


# -- evaluation and streaming ---------------------------------------------------------------------------


def test_evaluation(spark):
    judged = spark.createDataFrame([("q", t, g) for t, g in (("a", 3), ("b", 2), ("c", 0), ("d", 1))] + [("low", "a", 1), ("low", "b", 0), ("low", "c", 0), ("few", "a", 3)], "query_id string, track_id string, grade int")
    found = spark.createDataFrame([("q", 1, "x"), ("q", 2, "b"), ("q", 3, "a"), ("low", 1, "a")], "query_id string, rank int, track_id string")
    got = {r.query_id: r for r in evaluation.evaluate(found, judged).collect()}
    ideal = 7 + 3 / math.log2(3) + 1 / 2
    assert math.isclose(got["q"].ndcg, (3 / math.log2(3) + 7 / 2) / ideal) and got["q"].recall == 1.0 and got["q"].rr == 0.5 and got["q"].unjudged == 1
    assert got["low"].ndcg == 1.0 and got["low"].recall is None and got["low"].rr is None
    assert got["few"].ndcg is None
    assert tuple(evaluation.means(evaluation.evaluate(found, judged)).head())[3:] == (2, 1, 1)


def test_event_stream(spark, tmp_path):
    from cadenza.streaming import event_stream

    rows = event_rows(spark, ("a", "play", NOW, None), ("b", "hum", NOW, None), ("a", "like", NOW, None))
    rows.unionByName(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.EVENTS).parquet(str(tmp_path / "in"))
    event_stream.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2]
    assert {(r.event_type, r.n) for r in event_stream.counts(rows).collect()} == {("play", 1), ("hum", 1), ("like", 1)}
