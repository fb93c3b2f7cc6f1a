"""Schemas of the stored tables."""

from __future__ import annotations

TRACKS = (
    "track_id string, content_hash string, source_type string, source_uri string, file_name string, file_size bigint, "
    "modified_at_ns bigint, status string, created_at timestamp, updated_at timestamp, title string, artist string, album string, "
    "album_artist string, composer string, genre string, year int, duration_seconds double, bitrate int, sample_rate int, channels int, "
    "tempo_bpm double, rms_energy double, spectral_centroid double, spectral_bandwidth double, spectral_rolloff double, "
    "zero_crossing_rate double, mfcc_json string, chroma_json string, analysis_mode string, analysis_seconds double, analysis_version string"
)
SCAN_STATE = "source_uri string, last_seen_at timestamp, file_size bigint, modified_at_ns bigint, content_hash string"
EVENTS = "id bigint, track_id string, event_type string, occurred_at timestamp, context string, seconds_played double"
PLAYLISTS = "name string, name_key string, created_at timestamp, updated_at timestamp, items array<struct<position: int, track_id: string, sequence_score: double, base_score: double>>"
EVENT_TYPES = ("play", "complete", "skip", "like", "dislike", "replay")
SIGNALS = ("metadata_score", "dsp_score", "learned_score", "preference_score", "novelty_score", "diversity_score")
FACETS = ("genres", "moods", "languages", "regions", "instrumentation", "music_types", "scenes")
