"""Command line over a catalog folder: ``python -m cadenza.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cadenza.functions import checks
from cadenza.operators import events as E
from cadenza.operators import playlists as P
from cadenza.operators import sequencing
from cadenza.operators.hybrid import HybridWeights
from cadenza.operators.vectors import FastEmbedProvider, TextEmbeddingProfile, VectorIndex
from cadenza.plans import flows
from cadenza.schemas import EVENT_TYPES, EVENTS
from cadenza.sources import audio_embedding, ingest, playlist_files
from cadenza.sources.store import Store


#: Where the network of audio vectors lies, and the name of the network of text vectors.
NETWORK, TEXT_MODEL = "models/audio.onnx", "BAAI/bge-small-en-v1.5"
TEXT_PREFIXES = ("query: ", "passage: ")


def parse_now(text: str) -> datetime:
    """An ISO time with a zone (Z counts), in UTC."""
    at = datetime.fromisoformat(text)
    if at.tzinfo is None or at.utcoffset() is None:
        raise argparse.ArgumentTypeError("the time must carry a zone")
    return at.astimezone(UTC)


def build_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cadenza")
    top.add_argument("--db", default="cadenza-db", help="folder of the catalog's tables")
    sub = top.add_subparsers(dest="command", required=True)

    def command(*path: str, parents=sub, **k) -> argparse.ArgumentParser:
        p = parents.add_parser(path[-1], **k)
        p.set_defaults(path=" ".join(path))
        return p

    def group(name: str):
        return sub.add_parser(name).add_subparsers(dest="action", required=True)

    p = command("scan")
    p.add_argument("folder")
    p.add_argument("--no-content-hash", action="store_true")
    p.add_argument("--no-analysis", action="store_true")
    p.add_argument("--analysis-seconds", type=float, default=180.0)
    p.add_argument("--analysis-offset", type=float, default=0.0)

    g = group("model")
    p = command("model", "fetch-effnet", parents=g)
    p.add_argument("--path", default=NETWORK)
    p.add_argument("--url", default=audio_embedding.MODEL_URL)

    g = group("learned-index")
    for name in ("rebuild", "similar"):
        p = command("learned-index", name, parents=g)
        p.add_argument("--index", default="learned-index")
        p.add_argument("--model", default=NETWORK)
        p.add_argument("--limit", type=int, default=None if name == "rebuild" else 10)
        if name == "similar":
            p.add_argument("track_id")

    def retrieval(p: argparse.ArgumentParser) -> None:
        p.add_argument("--expand-query", action="store_true")
        p.add_argument("--lexical-weight", type=float, default=0.5)
        p.add_argument("--semantic-weight", type=float, default=0.5)

    def embedding(p: argparse.ArgumentParser, head: str = "", index: str = "index") -> None:
        """Options of text vectors; all commands keep them under the same names."""
        p.add_argument(f"--{head}model", dest="text_model", default=TEXT_MODEL)
        p.add_argument(f"--{head}query-prefix", dest="text_query_prefix", default=TEXT_PREFIXES[0])
        p.add_argument(f"--{head}document-prefix", dest="text_document_prefix", default=TEXT_PREFIXES[1])
        p.add_argument(f"--{index}", dest="text_index", default="semantic-index")

    p = command("search")
    p.add_argument("query")
    p.add_argument("--limit", type=int, default=10)
    kind = p.add_mutually_exclusive_group()
    kind.add_argument("--semantic", action="store_true")
    kind.add_argument("--semantic-indexed", action="store_true")
    p.add_argument("--hybrid", action="store_true")
    p.add_argument("--explain-retrieval", action="store_true")
    retrieval(p)
    embedding(p, "semantic-", "semantic-index")

    g = group("semantic-index")
    embedding(command("semantic-index", "rebuild", parents=g))

    g = group("event")
    p = command("event", "add", parents=g)
    p.add_argument("track_id")
    p.add_argument("event_type", choices=EVENT_TYPES)
    p.add_argument("--at", type=parse_now)
    p.add_argument("--context")
    p.add_argument("--seconds-played", type=float)
    for name in ("list", "summary"):
        command("event", name, parents=g).add_argument("--limit", type=int, default=20 if name == "list" else 1000)

    g = group("playlist")
    command("playlist", "list", parents=g)
    for name in ("show", "delete", "export", "m3u8", "audit", "repair-plan"):
        p = command("playlist", name, parents=g)
        p.add_argument("name")
        if name in ("export", "m3u8"):
            p.add_argument("output")
    p = command("playlist", "rename", parents=g)
    p.add_argument("old_name")
    p.add_argument("new_name")
    for name in ("import", "m3u8-import"):
        p = command("playlist", name, parents=g)
        p.add_argument("input")
        p.add_argument("--name", required=name == "m3u8-import")
        p.add_argument("--preview", action="store_true")
        p.add_argument("--replace-existing", action="store_true")
    p = command("playlist", "edit", parents=g)
    p.add_argument("name")
    p.add_argument("--edit", action="append", default=[])
    p.add_argument("--preview-edits", action="store_true")

    p = command("recommend")
    p.add_argument("text")
    p.add_argument("--context", required=True)
    p.add_argument("--now", type=parse_now)
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--mode", choices=sequencing.MODES, default="smooth")
    p.add_argument("--seed-track-id")
    p.add_argument("--model", default=NETWORK)
    p.add_argument("--index", default="learned-index")
    p.add_argument("--event-limit", type=int, default=1000)
    p.add_argument("--catalog-limit", type=int)
    p.add_argument("--retrieval", choices=flows.MODES, default="catalog")
    p.add_argument("--retrieval-limit", type=int)
    p.add_argument("--explain", action="store_true")
    p.add_argument("--edit", action="append", default=[])
    p.add_argument("--preview-edits", action="store_true")
    p.add_argument("--save-playlist", metavar="NAME")
    retrieval(p)
    embedding(p, "text-", "text-index")

    def data_folder(parser: argparse.ArgumentParser) -> None:
        """``--db`` may stand behind a command too; without it there, the one before the command counts."""
        for action in parser._actions:
            if isinstance(action, argparse._SubParsersAction):
                for child in action.choices.values():
                    data_folder(child)
                    if child.get_default("path"):
                        child.add_argument("--db", default=argparse.SUPPRESS)

    data_folder(top)
    return top


class App:
    def __init__(self, spark: SparkSession, args: argparse.Namespace, say: Callable[[str], None] = print, provider=None) -> None:
        self.spark, self.a, self.say = spark, args, say
        self.store = Store(spark, args.db)
        self._provider = provider

    def provider(self):
        if self._provider is None:
            self._provider = FastEmbedProvider(checks.text(self.a.text_model, "model"), self.a.text_query_prefix, self.a.text_document_prefix)
        return self._provider

    def profile(self) -> TextEmbeddingProfile:
        return TextEmbeddingProfile(self.a.text_model, self.a.text_query_prefix, self.a.text_document_prefix)

    def run(self) -> None:
        getattr(self, self.a.path.replace(" ", "_").replace("-", "_"))()

    # -- library --------------------------------------------------------------------

    def scan(self) -> None:
        a = self.a
        n, issues = ingest.scan(self.store, a.folder, compute_content_hash=not a.no_content_hash, analyze=not a.no_analysis, config=ingest.AnalysisConfig(a.analysis_seconds, a.analysis_offset))
        self.say(f"Scanned changed tracks: {n}")
        for i in issues.toLocalIterator():
            self.say(f"{i.stage}\t{i.source}\t{i.error_type}\t{i.message}")

    def model_fetch_effnet(self) -> None:
        self.say(audio_embedding.fetch_model(self.a.path, url=self.a.url))

    def _learned(self) -> audio_embedding.LearnedIndex:
        return audio_embedding.LearnedIndex(VectorIndex(self.spark, self.a.index), audio_embedding.Network(audio_embedding.NetworkConfig(self.a.model)))

    def learned_index_rebuild(self) -> None:
        n, issues = self._learned().rebuild(self.store.table("tracks"), limit=self.a.limit)
        self.say(f"Indexed learned embeddings: {n}")
        for i in issues.toLocalIterator():
            self.say(f"{i.track_id}\t{i.issue}")

    def learned_index_similar(self) -> None:
        for r in self._learned().similar(self.store.table("tracks"), self.a.track_id, limit=self.a.limit).collect():
            self.say(f"{r.track_id}\t{r.score:.6f}")

    # -- search -----------------------------------------------------------------------

    def search(self) -> None:
        a = self.a
        s = flows.SearchService(self.store.table("tracks"))
        weights = HybridWeights(a.lexical_weight, a.semantic_weight)
        if a.hybrid and a.semantic_indexed:
            found = s.hybrid_search_indexed(a.query, a.text_index, self.provider(), self.profile(), limit=a.limit, expand=a.expand_query, weights=weights)
        elif a.hybrid:
            found = s.hybrid_search(a.query, self.provider(), limit=a.limit, expand=a.expand_query, weights=weights)
        elif a.semantic_indexed:
            found = s.semantic_search_indexed(a.query, a.text_index, self.provider(), self.profile(), limit=a.limit)
        elif a.semantic:
            found = s.semantic_search(a.query, self.provider(), limit=a.limit)
        else:
            found = s.search(a.query, limit=a.limit, expand=a.expand_query)
        for n, r in enumerate(found.collect(), 1):
            names = " — ".join(v for v in (r.title, r.artist, r.album) if v)
            line = f"{n}. {r.track_id}\t{r.score:.6f}" + (f"\t{names}" if names else "")
            if a.hybrid:
                self.say(line + f"\thybrid lexical={r.lexical_score:.6f} semantic={r.semantic_score:.6f}")
                for k in ("lexical_normalized_score", "semantic_normalized_score", "lexical_contribution", "semantic_contribution") if a.explain_retrieval else ():
                    self.say(f"   {k.replace('_', '-')}: {r[k]:.6f}")
            elif a.semantic or a.semantic_indexed:
                self.say(line + ("\tsemantic-indexed" if a.semantic_indexed else "\tsemantic"))
            else:
                self.say(line + (f"\tmatched={', '.join(r.matched_fields)}" if r.matched_fields else ""))
                if a.explain_retrieval:
                    self.say(f"   matched-query: {r.matched_query}")

    def semantic_index_rebuild(self) -> None:
        n = flows.SearchService(self.store.table("tracks")).rebuild_semantic_index(self.a.text_index, self.provider(), self.profile())
        self.say(f"Indexed semantic text vectors: {n}")

    # -- events -------------------------------------------------------------------------

    def event_add(self) -> None:
        a = self.a
        row = self.store.record_event(a.track_id, a.event_type, occurred_at=a.at, context=a.context, seconds_played=a.seconds_played)
        self.say("Recorded: " + E.format_events(self.spark.createDataFrame([tuple(row[c.split()[0]] for c in EVENTS.split(", "))], EVENTS)).head().line)

    def event_list(self) -> None:
        found = E.format_events(E.recent(self.store.table("listening_events"), limit=self.a.limit)).collect()
        for r in found:
            self.say(r.line)
        if not found:
            self.say("No listening events.")

    def event_summary(self) -> None:
        rows = E.recent(self.store.table("listening_events"), limit=self.a.limit).cache()
        total = E.totals(rows).head()
        plural = lambda n, word: f"{n} {word}" + ("" if n == 1 else "s")
        self.say(f"Listening summary (most recent {plural(self.a.limit, 'event')})")
        self.say(f"Events: {total.total_events}")
        self.say(f"Distinct tracks: {total.distinct_tracks}")
        self.say("By event type:")
        for r in E.type_counts(rows).collect():
            self.say(f"  {r.event_type}: {r.n}")
        self.say("By context:")
        found = E.context_counts(rows).collect()
        for r in found:
            self.say(f"  {r.context or '(none)'}: {plural(r.event_count, 'event')}, {plural(r.distinct_tracks, 'track')}")
        if not found:
            self.say("  (none)")
        rows.unpersist()

    # -- playlists ----------------------------------------------------------------------

    def _existing(self, name: str) -> tuple[dict, list[dict]]:
        got = self.store.get(name)
        if got is None:
            raise ValueError(f"playlist not found: {name!r}")
        return got

    def _show(self, name: str, ids: list[str]) -> None:
        self.say(f"Playlist: {name}")
        for n, i in enumerate(ids, 1):
            self.say(f"{n}. {i}")

    def playlist_list(self) -> None:
        for n, r in enumerate(self.store.list().collect(), 1):
            self.say(f"{n}. {r.name}\t{len(r['items'] or [])} tracks")

    def playlist_show(self) -> None:
        head, items = self._existing(self.a.name)
        self._show(head["name"], [i["track_id"] for i in items])

    def playlist_delete(self) -> None:
        if not self.store.delete(self.a.name):
            raise ValueError(f"playlist not found: {self.a.name!r}")
        self.say(f"Deleted playlist: {self.a.name}")

    def playlist_rename(self) -> None:
        if not self.store.rename(self.a.old_name, self.a.new_name):
            raise ValueError(f"playlist not found: {self.a.old_name!r}")
        self.say(f"Renamed playlist: {self.a.old_name} -> {' '.join(self.a.new_name.split())}")

    def _write(self, kind: str, name: str, text: str) -> None:
        Path(self.a.output).write_text(text, encoding="utf-8")
        self.say(f"Exported {kind}: {name} -> {self.a.output}")

    def playlist_export(self) -> None:
        head, items = self._existing(self.a.name)
        at = lambda k: head[k].replace(tzinfo=UTC)
        self._write("playlist", head["name"], playlist_files.to_json(head["name"], at("created_at"), at("updated_at"), items))

    def playlist_m3u8(self) -> None:
        head, _ = self._existing(self.a.name)
        rows = playlist_files.to_m3u8(self.store.items(self.a.name), self.store.table("tracks")).collect()
        self._write("M3U8 playlist", head["name"], rows[0].m3u8 if rows else "#EXTM3U\n")

    def _audited(self) -> list:
        head, _ = self._existing(self.a.name)
        self.say(f"Playlist: {head['name']}")
        return P.repair_plan(P.audit(self.store.items(self.a.name), self.store.table("tracks"))).orderBy("position").collect()

    def playlist_audit(self) -> None:
        rows = self._audited()
        for n, r in enumerate(rows, 1):
            self.say(f"{n}. {r.track_id}\t{r.state}")
        self.say("Summary: " + ", ".join(f"{sum(r.state == s for r in rows)} {s}" for s in ("active", "inactive", "missing")))

    def playlist_repair_plan(self) -> None:
        rows = self._audited()
        for n, r in enumerate(rows, 1):
            self.say(f"{n}. {r.track_id}\t{r.state}\t{r.action}")
        self.say("Plan: " + ", ".join(f"{sum(r.action == s for r in rows)} {s}" for s in ("keep", "remove")))

    def _import(self, name: str, rows: DataFrame, kind: str) -> None:
        items = [tuple(r) for r in rows.orderBy("position").select("track_id", "sequence_score", "base_score").collect()]
        there = self.store.get(name) is not None
        if self.a.preview:
            self.say(f"{'M3U8 import' if kind == 'M3U8 playlist' else 'Import'} preview: {self.a.input}")
            self.say(f"Playlist: {name}")
            self.say(f"Tracks: {len(items)}")
            action = "create new playlist" if not there else "replace existing playlist" if self.a.replace_existing else "blocked; playlist already exists (use --replace-existing)"
            self.say(f"Action: {action}")
            return
        if there and not self.a.replace_existing:
            raise ValueError(f"playlist already exists: {name!r}; use --replace-existing")
        self.store.save(name, items)
        self.say(f"Imported {kind}: {name} <- {self.a.input}")

    def playlist_import(self) -> None:
        name, rows = playlist_files.load_json(self.spark, self.a.input)
        self._import(self.a.name or name, rows, "playlist")

    def playlist_m3u8_import(self) -> None:
        self._import(self.a.name, playlist_files.load_m3u8(self.spark, self.a.input, self.store.table("tracks")), "M3U8 playlist")

    def _plan(self, rows: DataFrame, ids: list[str]) -> list[str]:
        """The ids after the commands; with ``--preview-edits`` each step is told."""
        steps = P.plan_edits(rows, self.store.table("tracks"), self.a.edit)
        if self.a.preview_edits:
            self.say("Edit preview:")
            for n, step in enumerate(steps, 1):
                self.say(f"{n}. command: {P.describe(step.asked)}")
                for e in map(P.describe, step.resolved):
                    self.say(f"   → {e}")
                if not step.resolved:
                    self.say("   → no matching tracks")
                self.say("   changes:" if step.changes else "   changes: none")
                for c in step.changes:
                    self.say(f"      - {P.describe_change(*c)}")
            self.say("Playlist preview:")
            for n, i in enumerate(steps[-1].after, 1):
                self.say(f"{n}. {i}")
        return steps[-1].after if steps else ids

    def playlist_edit(self) -> None:
        if not self.a.edit:
            raise ValueError("give at least one --edit")
        head, items = self._existing(self.a.name)
        scores = {i["track_id"]: (i["sequence_score"], i["base_score"]) for i in items}
        if self.a.preview_edits:
            self.say(f"Playlist: {head['name']}")
        after = self._plan(self.store.items(self.a.name), [i["track_id"] for i in items])
        if not self.a.preview_edits:
            self.store.save(head["name"], [(i, *scores[i]) for i in after])
            self._show(head["name"], after)

    # -- recommendations ------------------------------------------------------------------

    def recommend(self) -> None:
        a = self.a
        if a.preview_edits and (a.save_playlist or not a.edit):
            raise ValueError("--preview-edits needs at least one --edit and can't go with --save-playlist")
        tracks, events = self.store.table("tracks"), self.store.table("listening_events")
        retrieval = {"retrieval_limit": a.retrieval_limit, "catalog_limit": a.catalog_limit, "expand": a.expand_query, "weights": HybridWeights(a.lexical_weight, a.semantic_weight)}
        if a.retrieval not in ("catalog", "lexical"):
            retrieval |= {"provider": self.provider(), "profile": self.profile(), "index_path": a.text_index}
        # every vector of the index is scored: a candidate far from the seed has a similarity too
        similar = VectorIndex(self.spark, a.index).scores(a.seed_track_id) if a.seed_track_id else None
        request = flows.Request(a.text, mode=a.mode, limit=a.limit)
        got = flows.recommend(tracks, events, request, context=a.context, now=a.now or datetime.now(UTC), event_limit=a.event_limit, mode=a.retrieval, similar=similar, learned_seed=a.seed_track_id, **retrieval)
        self.say(f"Intent: {got.intent.raw_text}")
        self.say("Ranked:")
        for n, r in enumerate(got.ranked.collect(), 1):
            self.say(f"{n}. {r.track_id}\t{r.score:.6f}")
            if a.explain:
                self.say(f"   strongest: {r.strongest_signal or 'none'}")
                for c in r.contributions:
                    self.say(f"   {c['name']}: raw={c['raw_score']:.6f} weight={c['weight']:.6f} contribution={c['contribution']:.6f}")
        items = got.playlist.orderBy("position").collect()
        scores, ids = {r.track_id: (r.sequence_score, r.base_score) for r in items}, [r.track_id for r in items]
        if a.edit:
            rows = self.spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "track_id string, position int")
            ids = self._plan(rows, ids)
        if not a.preview_edits:
            self.say("Playlist:")
            for n, i in enumerate(ids, 1):
                self.say(f"{n}. {i}")
        if a.save_playlist:
            self.store.save(a.save_playlist, [(i, *scores[i]) for i in ids])
            self.say(f"Saved playlist: {a.save_playlist}")


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName("cadenza").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        App(spark, args).run()
    except (ValueError, KeyError, FileNotFoundError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())


__all__ = ["App", "build_parser", "main", "parse_now"]
