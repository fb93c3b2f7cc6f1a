from __future__ import annotations

import argparse
from datetime import UTC, datetime

import pytest
from cadenza.cli import App, build_parser, parse_now
from cadenza.operators.vectors import HashingProvider, VectorIndex
from cadenza.sources import audio_embedding
from cadenza.sources.store import Store

from .test_catalog import track_rows


@pytest.fixture
def run(spark, tmp_path):
    db = str(tmp_path / "db")
    store = Store(spark, db)
    store.replace("tracks", track_rows(spark, *({"track_id": t, "title": f"Cinematic {t}", "artist": "X", "genre": "bgm", "rms_energy": e, "source_uri": f"file:///{t}.mp3"} for t, e in (("a", 0.9), ("b", 0.5), ("c", 0.1)))))

    def call(*argv: str) -> list[str]:
        out: list[str] = []
        App(spark, build_parser().parse_args(["--db", db, *argv]), out.append, provider=HashingProvider(16)).run()
        return "\n".join(out).split("\n")

    return call


def test_times():
    assert parse_now("2026-01-01T02:00:00+02:00") == parse_now("2026-01-01T00:00:00Z") == datetime(2026, 1, 1, tzinfo=UTC)
    with pytest.raises(argparse.ArgumentTypeError):
        parse_now("2026-01-01T00:00:00")


def test_events_and_search(run):
    assert run("event", "list") == ["No listening events."]
    assert run("event", "add", "c", "like", "--at", "2026-01-01T00:00:00Z", "--context", "gym") == ["Recorded: 2026-01-01T00:00:00+00:00\tlike\tc\tgym\t"]
    assert run("event", "list") == ["2026-01-01T00:00:00+00:00\tlike\tc\tgym\t"]
    assert "  gym: 1 event, 1 track" in run("event", "summary")
    assert run("search", "cinematic b", "--explain-retrieval")[:2] == ["1. b\t1.000000\tCinematic b — X\tmatched=title", "   matched-query: cinematic b"]
    assert len(run("search", "cinematic", "--semantic")) == 3
    assert run("search", "cinematic b", "--hybrid")[0].startswith("1. b\t")


def test_recommend_and_playlists(run, tmp_path):
    run("event", "add", "c", "like", "--at", "2026-01-01T00:00:00Z", "--context", "gym")
    out = run("recommend", "cinematic", "--context", "gym", "--now", "2026-01-01T00:00:00Z", "--explain", "--save-playlist", "Mix")
    assert out[0] == "Intent: cinematic" and out[2].startswith("1. c\t") and "   strongest: preference_score" in out and out[-1] == "Saved playlist: Mix"
    shown = run("playlist", "show", "mix")
    assert shown[0] == "Playlist: Mix" and len(shown) == 4
    told = run("playlist", "edit", "mix", "--edit", "move cinematic a to 1", "--edit", "remove all by X", "--preview-edits")
    assert told[:3] == ["Playlist: Mix", "Edit preview:", "1. command: move cinematic a to position 1"] and "   → move a to position 1" in told
    assert told[-1] == "Playlist preview:" and run("playlist", "show", "mix") == shown
    assert run("playlist", "edit", "mix", "--edit", "move cinematic a to 1", "--edit", "remove b")[-3:] == ["Playlist: Mix", "1. a", "2. c"]
    with pytest.raises(ValueError):
        run("playlist", "edit", "mix")
    out = str(tmp_path / "mix.json")
    assert run("playlist", "export", "mix", out) == [f"Exported playlist: Mix -> {out}"]
    assert run("playlist", "import", out, "--name", "Copy") == [f"Imported playlist: Copy <- {out}"]
    with pytest.raises(ValueError, match="already exists"):
        run("playlist", "import", out)
    assert run("playlist", "import", out, "--preview")[-1].startswith("Action: blocked")
    out = str(tmp_path / "mix.m3u8")
    assert run("playlist", "m3u8", "mix", out) == [f"Exported M3U8 playlist: Mix -> {out}"]
    assert run("playlist", "m3u8-import", out, "--name", "M", "--preview") == [f"M3U8 import preview: {out}", "Playlist: M", "Tracks: 2", "Action: create new playlist"]
    assert run("playlist", "list") == ["1. Copy\t2 tracks", "2. Mix\t2 tracks"]
    assert run("playlist", "audit", "mix") == ["Playlist: Mix", "1. a\tactive", "2. c\tactive", "Summary: 2 active, 0 inactive, 0 missing"]
    assert run("playlist", "repair-plan", "mix")[1:] == ["1. a\tactive\tkeep", "2. c\tactive\tkeep", "Plan: 2 keep, 0 remove"]
    assert run("playlist", "rename", "mix", "Other") == ["Renamed playlist: mix -> Other"] and run("playlist", "delete", "other") == ["Deleted playlist: other"]
    with pytest.raises(ValueError, match="not found"):
        run("playlist", "show", "other")


def test_recommend_previews_edits(run):
    args = ("recommend", "cinematic", "--context", "gym", "--now", "2026-01-01T00:00:00Z")
    plain = run(*args)
    told = run(*args, "--edit", "remove all by X", "--preview-edits")
    assert "Edit preview:" in told and "Playlist:" not in told and told[-1] == "Playlist preview:"
    assert run(*args, "--edit", "remove b")[-2:] == [x for x in (f"{n}. {i}" for n, i in enumerate([line[3:] for line in plain[-3:] if line[3:] != "b"], 1))]
    for bad in (("--preview-edits",), ("--preview-edits", "--edit", "remove b", "--save-playlist", "x")):
        with pytest.raises(ValueError):
            run(*args, *bad)


def test_learned_seed_reaches_every_candidate(spark, run, tmp_path):
    """Similarity isn't cut to the nearest tracks: the farthest candidate has its own."""
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.save(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [-1.0, 0.0])] + [(f"x{i}", [1.0, i / 1e4]) for i in range(1200)], "track_id string, vector array<double>"))
    out = run("recommend", "hello", "--context", "gym", "--now", "2026-01-01T00:00:00Z", "--seed-track-id", "a", "--index", str(tmp_path / "i"), "--explain")
    assert out[2].startswith("1. b\t") and "   learned_score: raw=0.800000 weight=0.360000 contribution=0.288000" in out
    assert {r.track_id: round(r.score, 9) for r in index.scores("a").filter("track_id in ('a', 'b', 'c')").collect()} == {"a": 1.0, "b": 0.6, "c": -1.0}


def test_audio_index(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.mp3").write_bytes(name.encode())
    t = track_rows(spark, *({"track_id": n, "source_uri": (tmp_path / f"{n}.mp3").as_uri()} for n in ("a", "b", "gone")))
    index = audio_embedding.LearnedIndex(VectorIndex(spark, str(tmp_path / "i")), lambda path: [1.0, 0.0 if path.endswith("a.mp3") else 1.0])
    n, issues = index.rebuild(t)
    assert n == 2 and [r.track_id for r in issues.collect()] == ["gone"]
    assert [(r.track_id, round(r.score, 6)) for r in index.similar(t, "a").collect()] == [("b", 0.707107)]
    with pytest.raises(KeyError):
        index.similar(t, "zz")
    with pytest.raises(FileNotFoundError):
        index.similar(t, "gone")
    assert audio_embedding.local_path("file:///x%20y.mp3") == "/x y.mp3" and audio_embedding.local_path("http://x") is None and audio_embedding.local_path("file://host/x") == "//host/x"
    assert audio_embedding.patches(audio_embedding.np.ones((10, 4)), 16, 8).shape == (1, 16, 4)


def test_network_input_and_output():
    np = audio_embedding.np
    power = np.array([[0.0, 1.0], [np.e, 1e-20]])
    assert np.allclose(audio_embedding.log_bands(power), [[np.log(1e-10), 1.0], [0.0, np.log(1e-10)]])
    long = np.arange(200 * 3, dtype=float).reshape(200, 3)
    got = audio_embedding.patches(long, 128, 62)
    assert got.shape == (2, 128, 3) and (got[1] == long[62:190]).all()
    network = audio_embedding.Network(audio_embedding.NetworkConfig("none", width=2))
    inputs = [type("Input", (), {"name": "x"})()]

    def session(out):
        return type("Session", (), {"get_inputs": lambda self: inputs, "run": lambda self, names, feed: out})()

    network._session = session([None, np.array([[3.0, 0.0], [0.0, 3.0]])])
    assert np.allclose(network.pooled(got), [0.5**0.5, 0.5**0.5])
    network._session = session([None, np.array([[1.0, 0.0], [-1.0, 0.0]])])
    assert network.pooled(got) == [0.0, 0.0]
    for bad in ([None], [None, np.ones((2, 3))]):
        network._session = session(bad)
        with pytest.raises(RuntimeError):
            network.pooled(got)
