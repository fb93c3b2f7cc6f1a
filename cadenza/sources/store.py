"""The catalog's tables in one folder: versioned Parquet snapshots behind a pointer, one writer at a time.

A playlist and its items are one row, so one pointer publishes both.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.functions import checks
from cadenza.operators import events as E
from cadenza.operators.vectors import publish, published

TABLES = {"tracks": schemas.TRACKS, "scan_state": schemas.SCAN_STATE, "listening_events": schemas.EVENTS, "playlists": schemas.PLAYLISTS}


def name_key(name: str) -> str:
    return " ".join(checks.text(name, "name").split()).casefold()


class Store:
    """Tables under ``path``; a missing table is empty."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        version = published(self.spark, f"{self.path}/{name}/current")
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{version}")

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a new snapshot, then point to it: readers see the old table or the new one, never a mixture."""
        version = uuid.uuid4().hex
        target = self.spark.createDataFrame([], TABLES[name]).schema
        rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target)).write.parquet(f"{self.path}/{name}/{version}")
        publish(self.spark, f"{self.path}/{name}/current", version)
        return self.table(name)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add files to the current snapshot, or start one."""
        version = published(self.spark, f"{self.path}/{name}/current")
        if version is None:
            self.replace(name, rows)
            return
        target = self.spark.createDataFrame([], TABLES[name]).schema
        rows.select(*(F.col(f.name).cast(f.dataType) for f in target)).write.mode("append").parquet(f"{self.path}/{name}/{version}")

    def log(self, name: str, rows: DataFrame) -> DataFrame:
        """Write rows to a folder of their own and return them as read from there."""
        path = f"{self.path}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # -- events ---------------------------------------------------------------------

    def record_event(self, track_id: str, event_type: str, **facts) -> dict:
        """Append a checked event of a track that the catalog holds, active or not."""
        event = E.new_event(track_id, event_type, **facts)
        if not self.table("tracks").filter(F.col("track_id") == track_id).limit(1).collect():
            raise ValueError(f"unknown track: {track_id!r}")
        last = self.table("listening_events").agg(F.max("id")).head()[0] or 0
        row = {"id": last + 1} | event
        self.append("listening_events", self.spark.createDataFrame([tuple(row[c.split()[0]] for c in schemas.EVENTS.split(", "))], schemas.EVENTS))
        return row

    # -- playlists ------------------------------------------------------------------

    def save(self, name: str, items: list[tuple[str, float, float]], *, now: datetime | None = None) -> None:
        """Write a playlist under its key; a playlist of that key keeps its creation time and loses its old items."""
        key, at = name_key(name), _utc(now)
        checks.unique_ids([i[0] for i in items])
        old = self.table("playlists").filter(F.col("name_key") == key).limit(1).collect()
        own = [(n, *i) for n, i in enumerate(items)]
        row = self.spark.createDataFrame([(" ".join(name.split()), key, old[0]["created_at"].replace(tzinfo=UTC) if old else at, at, own)], schemas.PLAYLISTS)
        self.replace("playlists", self.table("playlists").filter(F.col("name_key") != key).unionByName(row))

    def get(self, name: str) -> tuple[dict, list[dict]] | None:
        key = name_key(name)
        head = self.table("playlists").filter(F.col("name_key") == key).limit(1).collect()
        if not head:
            return None
        row = head[0].asDict(recursive=True)
        return row, sorted(row.pop("items"), key=lambda i: i["position"])

    def items(self, name: str) -> DataFrame:
        rows = self.table("playlists").filter(F.col("name_key") == name_key(name))
        return rows.select("name_key", F.explode("items").alias("i")).select("name_key", "i.*").orderBy("position")

    def list(self) -> DataFrame:
        """All playlists by key, each with its ordered items."""
        return self.table("playlists").orderBy("name_key")

    def delete(self, name: str) -> bool:
        key = name_key(name)
        if self.get(name) is None:
            return False
        self.replace("playlists", self.table("playlists").filter(F.col("name_key") != key))
        return True

    def rename(self, old: str, new: str, *, now: datetime | None = None) -> bool:
        """False where there is no such playlist; an error where the new key is taken by another."""
        a, b = name_key(old), name_key(new)
        if self.get(old) is None:
            return False
        if a != b and self.get(new) is not None:
            raise ValueError(f"a playlist of that name exists: {new!r}")
        mine = F.col("name_key") == a
        changes = {"name": F.lit(" ".join(new.split())), "updated_at": F.lit(_utc(now)), "name_key": F.lit(b)}
        rows = self.table("playlists")
        self.replace("playlists", rows.select(*(F.when(mine, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rows.columns)))
        return True


def _utc(now: datetime | None) -> datetime:
    at = now or datetime.now(UTC)
    if at.tzinfo is None or at.utcoffset() is None:
        raise ValueError("now must carry a time zone")
    return at.astimezone(UTC)
