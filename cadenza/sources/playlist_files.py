"""Playlists as JSON and M3U8 text: strict reading, stable writing."""

from __future__ import annotations

import json
import math
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import checks
from cadenza.operators.dealing import deal, look_up
from cadenza.operators.vectors import read_text

ITEM = "track_id string, sequence_score double, base_score double"


def to_json(name: str, created_at: datetime, updated_at: datetime, items: list[dict]) -> str:
    """One playlist, indented, positions from 1, with a line end."""
    rows = [{"position": n, "track_id": i["track_id"], "sequence_score": i["sequence_score"], "base_score": i["base_score"]} for n, i in enumerate(items, 1)]
    body = {"version": 1, "name": name, "created_at": created_at.isoformat(), "updated_at": updated_at.isoformat(), "items": rows}
    return json.dumps(body, indent=2, ensure_ascii=False) + "\n"


def _time(value, name: str) -> None:
    try:
        at = datetime.fromisoformat(value) if isinstance(value, str) else None
    except ValueError:
        at = None
    if at is None or at.tzinfo is None or at.utcoffset() is None:
        raise ValueError(f"{name} must be an ISO time with a zone")


def parse_json(text: str) -> tuple[str, list[tuple[str, float, float]]]:
    """The name and items of a version 1 playlist; anything else is an error."""
    try:
        got = json.loads(text)
    except ValueError as error:
        raise ValueError("not a JSON playlist") from error
    if not isinstance(got, dict) or isinstance(got.get("version"), bool) or got.get("version") != 1:
        raise ValueError("a playlist must be a JSON object of version 1")
    name = got.get("name")
    if not isinstance(name, str):
        raise ValueError("name must be a string")
    checks.text(name, "name")
    _time(got.get("created_at"), "created_at")
    _time(got.get("updated_at"), "updated_at")
    if not isinstance(got.get("items"), list):
        raise ValueError("items must be a list")
    items = []
    for n, item in enumerate(got["items"], 1):
        if not isinstance(item, dict) or isinstance(item.get("position"), bool) or item.get("position") != n:
            raise ValueError("positions must follow each other from 1")
        if not isinstance(item.get("track_id"), str):
            raise ValueError("track_id must be a string")
        items.append((item["track_id"], checks.number(item.get("sequence_score"), "sequence_score"), checks.number(item.get("base_score"), "base_score")))
    checks.unique_ids([i[0] for i in items])
    return name, items


def load_json(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    name, items = parse_json(read_text(spark, path))
    return name, spark.createDataFrame([(n, *i) for n, i in enumerate(items)], f"position int, {ITEM}")


def m3u8_lines(items: DataFrame, tracks: DataFrame, *keys: str) -> DataFrame:
    """``label`` and ``uri`` lines of item rows; unknown tracks and other URIs raise when the plan runs."""
    known = tracks.select("track_id", "source_uri", "title", "artist", "duration_seconds", F.lit(True).alias("_known"))
    met = look_up(items, known, "track_id")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    names = [F.when(strip(F.col(c)) != "", strip(F.col(c))) for c in ("title", "artist")]
    label = F.concat_ws(" — ", *names)
    d = F.col("duration_seconds").cast("double")
    seconds = F.when(d.isNull() | F.isnan(d) | (d < 0) | (d == float("inf")), F.lit(-1)).otherwise(F.bround(d, 0).cast("long"))
    uri = F.when(F.col("_known") & F.col("source_uri").startswith("file://"), F.col("source_uri")).otherwise(F.raise_error(F.concat(F.lit("no local file for track: "), F.col("track_id"))).cast("string"))
    return met.select(*keys, "position", F.concat(F.lit("#EXTINF:"), seconds.cast("string"), F.lit(","), F.when(label != "", label).otherwise(F.col("track_id"))).alias("label"), uri.alias("uri"))


def to_m3u8(items: DataFrame, tracks: DataFrame, *keys: str) -> DataFrame:
    """``m3u8``: a document for each playlist (all rows are one playlist without keys)."""
    lines = m3u8_lines(items, tracks, *keys)
    lines = deal(lines, *keys) if keys else lines
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "label", "uri"))), lambda x: F.concat(x["label"], F.lit("\n"), x["uri"], F.lit("\n")))
    return lines.groupBy(*keys).agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(parts, "")).alias("m3u8"))


def parse_m3u8(text: str, ids: dict[str, str]) -> list[tuple[str, float, float]]:
    """Items of an M3U8 document whose URIs are active tracks."""
    rows = [line.strip() for line in text.lstrip("﻿").splitlines()]
    rows = [r for r in rows if r]
    if not rows or rows[0] != "#EXTM3U":
        raise ValueError("an M3U8 playlist starts with #EXTM3U")
    out, waiting, uris = [], False, set()
    for row in rows[1:]:
        if row.startswith("#EXTINF:"):
            seconds, comma, _ = row[8:].partition(",")
            try:
                fine = bool(comma) and math.isfinite(float(seconds))
            except ValueError:
                fine = False
            if waiting or not fine:
                raise ValueError(f"misplaced or broken line: {row!r}")
            waiting = True
        elif not row.startswith("#"):
            if not waiting or not row.startswith("file://") or row in uris:
                raise ValueError(f"not a new local track after its description: {row!r}")
            if row not in ids:
                raise ValueError(f"not an active track: {row!r}")
            uris.add(row)
            out.append((ids[row], 0.0, 0.0))
            waiting = False
    if waiting:
        raise ValueError("the last description has no track")
    checks.unique_ids([i[0] for i in out])
    return out


def load_m3u8(spark: SparkSession, path: str, tracks: DataFrame) -> DataFrame:
    """Item rows of one document; only the URIs it names are asked of the catalog."""
    text = read_text(spark, path)
    uris = [(u.strip(),) for u in text.splitlines() if u.strip().startswith("file://")]
    asked = spark.createDataFrame(uris, "source_uri string").distinct()
    found = tracks.filter("status = 'active'").join(F.broadcast(asked), "source_uri", "left_semi").select("source_uri", "track_id").collect()
    return spark.createDataFrame([(n, *i) for n, i in enumerate(parse_m3u8(text, {r[0]: r[1] for r in found}))], f"position int, {ITEM}")


def m3u8_rows(documents: DataFrame) -> DataFrame:
    """Many documents (``path, value``) as rows ``path, n, seconds, label, uri, fault`` without the driver.

    A fault names what is wrong with a row: a location without its description, a
    second description, or a location that isn't a local file.
    """
    lines = documents.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "raw")).select("path", "n", F.trim("raw").alias("line"))
    kept = lines.filter((F.col("line") != "") & (~F.col("line").startswith("#") | F.col("line").startswith("#EXTINF:")))
    kept = deal(kept, "path")
    order = Window.partitionBy("path").orderBy("n")
    prior, after = F.lag("line").over(order), F.lead("line").over(order)
    kept = kept.withColumn("_before", prior).withColumn("_after", after)
    is_info, after_info = F.col("line").startswith("#EXTINF:"), F.coalesce(F.col("_before").startswith("#EXTINF:"), F.lit(False))
    fault = F.when(is_info & F.coalesce(F.col("_after").startswith("#EXTINF:"), F.lit(True)), "description without a track").when(~is_info & ~after_info, "track without a description").when(~is_info & ~F.col("line").startswith("file://"), "not a local file")
    seconds = F.expr("try_cast(regexp_extract(_before, '^#EXTINF:([^,]*),', 1) AS DOUBLE)")
    label = F.regexp_extract("_before", r"^#EXTINF:[^,]*,(.*)$", 1)
    rows = kept.withColumn("fault", fault).filter(~is_info | F.col("fault").isNotNull())
    return rows.select("path", "n", seconds.alias("seconds"), label.alias("label"), F.col("line").alias("uri"), "fault")


def import_rows(documents: DataFrame, tracks: DataFrame) -> DataFrame:
    """Many M3U8 documents (``path, value``) as item rows ``path, position, track_id, fault``: URIs are joined with the active tracks.

    A row whose URI no active track has gets a fault, like a row that breaks the format.
    """
    rows = m3u8_rows(documents)
    known = tracks.filter("status = 'active'").select(F.col("source_uri").alias("uri"), "track_id")
    met = deal(look_up(rows, known, "uri"), "path")
    fault = F.coalesce(F.col("fault"), F.when(F.col("track_id").isNull(), "not an active track"))
    at = F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1
    return met.select("path", at.alias("position"), "track_id", fault.alias("fault"))


def json_documents(playlists: DataFrame) -> DataFrame:
    """``name_key, value``: a version 1 JSON document for each row of stored playlists."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    item = lambda x, n: F.struct((n + 1).alias("position"), x["track_id"].alias("track_id"), x["sequence_score"].alias("sequence_score"), x["base_score"].alias("base_score"))
    body = F.struct(F.lit(1).alias("version"), "name", stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"), F.transform("items", item).alias("items"))
    return playlists.select("name_key", F.to_json(body).alias("value"))


def json_rows(documents: DataFrame) -> DataFrame:
    """Many JSON documents (``path, value``) as ``path, name, items, fault``, read in the plan.

    A fault says which rule of the format a document breaks; its items are null then.
    """
    scores = "sequence_score: double, base_score: double"
    shape = f"version int, name string, created_at string, updated_at string, items array<struct<position: int, track_id: string, {scores}>>"
    zoned = lambda c: F.coalesce(F.col(c).rlike(r"^\d{4}-\d\d-\d\d[T ].*([+-]\d\d:?\d\d|Z)$") & F.expr(f"try_to_timestamp({c})").isNotNull(), F.lit(False))
    rows = documents.select("path", F.from_json("value", shape).alias("d")).select("path", "d.*")
    ids = F.transform("items", lambda x: x["track_id"])
    bad_item = F.exists("items", lambda x: x["track_id"].isNull() | (F.trim(x["track_id"]) == "") | ~F.coalesce(F.abs(x["sequence_score"]) < float("inf"), F.lit(False)) | ~F.coalesce(F.abs(x["base_score"]) < float("inf"), F.lit(False)))
    in_order = F.forall(F.transform("items", lambda x, n: F.coalesce(x["position"] == n + 1, F.lit(False))), lambda ok: ok)
    rules = (
        (~F.coalesce(F.col("version") == 1, F.lit(False)), "not a playlist of version 1"), (F.col("name").isNull() | (F.trim("name") == ""), "no name"),
        (~zoned("created_at") | ~zoned("updated_at"), "a time without a zone"), (F.col("items").isNull(), "no items"), (~in_order, "positions that don't follow each other"),
        (bad_item, "a broken item"), (F.size(F.array_distinct(ids)) != F.size(ids), "a track twice"),
    )
    fault = F.lit(None).cast("string")
    for broken, says in reversed(rules):
        fault = F.when(broken, says).otherwise(fault)
    return rows.withColumn("fault", fault).select("path", "name", F.when(F.col("fault").isNull(), F.col("items")).alias("items"), "fault")
