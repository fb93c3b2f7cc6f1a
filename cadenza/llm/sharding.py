"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells.  Each shard owns ``vnodes`` cells as
virtual nodes; a document hashes to a cell and belongs to the first virtual node
clockwise.  No shard takes more than its bound; documents beyond it continue
clockwise to the next virtual node whose shard has room.  The bounds add up to
the number of documents, so counts differ by one at most (law ``rows``).

How it is distributed
---------------------
Only the number of documents in each cell reaches the driver: a table of fixed
size, whatever the input.  From it the driver lays out segments (a range of ranks
in a cell, its shard, its first slot); there are at most two for each cell and
one for each shard, which bounds the broadcast.  Ranks are taken inside a part of a
cell, of which a cell has ``SALTS`` by id and text, and the parts before are added.

Defined results
---------------
Null texts have size 16 and the checksum of the empty text.  Null ids are keys
like any other.  Equal texts under different ids are spread over the ring; rows
equal in id and text share a cell, in any order.  An empty table gives an empty
one.  Very long texts are measured whole.  Other columns stay as they are; columns of
the names added give way to the new ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.frames import hide, place, restored, take
from cadenza.llm.storage import cut
from cadenza.llm.words import mix

SHARDS, VNODES, CELLS, SALTS = 40, 64, 1 << 14, 16


def ring(shards: int, vnodes: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the virtual nodes in clockwise order, and their shards.

    A node's cell depends on its shard and number alone; where two meet the smaller
    shard wins, so one shard more leaves all other nodes where they are.
    """
    ids = np.arange(shards * vnodes, dtype=np.uint64)
    shard = np.tile(np.arange(shards), vnodes)
    number = np.repeat(np.arange(vnodes, dtype=np.uint64), shards)
    where = mix(mix(shard.astype(np.uint64) + np.uint64(1)) + number) % np.uint64(cells)
    order = np.lexsort((shard, where))
    first = np.unique(where[order], return_index=True)[1]
    assert len(ids) == len(order)
    return where[order][first].astype(np.int64), shard[order][first]


def bounds(total: int, shards: int) -> np.ndarray:
    return total // shards + (np.arange(shards) < total % shards)


def layout(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, first rank, end rank, shard, first slot) for the counts of the cells."""
    at, owner = ring(shards, vnodes, cells)
    room = bounds(sum(counts.values()), shards)
    filled = np.zeros(shards, np.int64)
    out, over = [], []

    def give(cell: int, low: int, n: int, s: int) -> None:
        out.append((cell, low, low + n, int(s), int(filled[s])))
        filled[s] += n

    for cell in sorted(counts):  # a document's own shard first
        node = int(np.searchsorted(at, cell)) % len(at)
        n = int(min(counts[cell], room[owner[node]] - filled[owner[node]]))
        if n:
            give(cell, 0, n, owner[node])
        if n < counts[cell]:
            over.append((cell, node, n))
    for cell, node, low in over:  # then clockwise
        step = node
        while low < counts[cell]:
            step = (step + 1) % len(at)
            n = int(min(counts[cell] - low, room[owner[step]] - filled[owner[step]]))
            if n:
                give(cell, low, n, owner[step])
                low += n
            elif step == node:  # a shard without a virtual node of its own
                s = int(np.argmax(room - filled))
                n = int(min(counts[cell] - low, room[s] - filled[s]))
                give(cell, low, n, s)
                low += n
    return out


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """The columns of ``docs`` and ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    if shards < 1 or vnodes < 1 or cells < shards * vnodes:
        raise ValueError("need shards and virtual nodes, and a cell for each of them at least")
    spark = docs.sparkSession
    text, doc_id = F.col(place(docs, "text")), F.col(place(docs, "doc_id"))
    plain = F.coalesce(text, F.lit(""))
    cell, salt = F.pmod(F.xxhash64(doc_id), F.lit(cells)).cast("int"), F.pmod(F.xxhash64("_crc", doc_id, F.lit(5)), F.lit(SALTS)).cast("int")
    rows = hide(docs).select("*", cell.alias("_cell"), (F.octet_length(plain) + 16).cast("long").alias("_size"), F.crc32(plain.cast("binary")).alias("_crc")).withColumn("_salt", salt)
    # at most ``cells * SALTS`` rows
    sizes = rows.groupBy("_cell", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_cell").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sizes.select("_cell", "_salt", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    counts = {r[0]: r[1] for r in offsets.groupBy("_cell").agg(F.sum("_n")).collect()}  # at most ``cells`` rows
    plan = spark.createDataFrame(layout(counts, shards, vnodes, cells), "_at int, _low long, _high long, _shard int, _slot0 long")
    inside = F.row_number().over(Window.partitionBy("_cell", "_salt").orderBy(doc_id, "_crc", "_size")) - 1
    ranked = rows.withColumn("_in", inside).join(offsets.drop("_n"), ["_cell", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    met = ranked.join(F.broadcast(plan), (F.col("_cell") == F.col("_at")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    add = {
        "size": F.col("_size"),
        "text_crc32": F.col("_crc"),
        "law": F.lit("rows"),
        "shard": F.col("_shard"),
        "slot": F.col("_slot0") + F.col("_rank") - F.col("_low"),
        "grown_shard": F.lit(None).cast("int"),
    }
    return restored(met, docs, add=add)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of a result of :func:`shard_documents`."""
    return take(result, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
