"""Line dedup in DataFrame operations only.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at its ends and
with A-Z in lower case.  Keys of at least ``min_chars`` code points that occur in
at least ``min_docs`` documents lose all their lines except in the largest doc_id
that holds them.

How it is distributed
---------------------
Texts are split and hashed once, and only 128-bit hashes of keys travel; they are
written to the shared folder.  There they are range-partitioned with a salt, so
that a line in a third of all documents is cut over many ranges, and sorted by
document (largest first) and position.  One pass over that order streams each
document's first occurrence of a key; these first occurrences are counted with
partial aggregation.  The repeated keys are written too and meet the
occurrences in an equi-join that Spark may split.  Each document gets back a keep bitmap
of 63 lines to a word, without the words whose lines all stay.  Texts move once, to meet
their bitmaps.

Defined results
---------------
Null and empty texts are one empty line; very long ones are split whole.  An empty
table gives an empty one.  Rows with the same id and text count as
one document, and all rows with the largest doc_id keep the line.  Null ids are
smaller than any other.  Other columns stay as they are; columns of the names added
give way to the new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.frames import hide, place, restored, take
from cadenza.llm.storage import cut, parallelism

MIN_CHARS, MIN_DOCS = 40, 5
SALTS = 64
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BITS = 63
_ALL = (1 << _BITS) - 1


def line_key(line):
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def occurrences(rows: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough: hashes, salt, row, document and position."""
    lines = rows.select("_row", "_id", F.posexplode(F.split("_lines_of", "\n")).alias("_pos", "_line"))
    keyed = lines.filter(F.char_length("_line") >= min_chars).select("_row", "_id", "_pos", line_key(F.col("_line")).alias("_k"))
    return keyed.filter(F.char_length("_k") >= min_chars).select(
        F.xxhash64("_k").alias("_h1"), F.xxhash64(F.lit(1), "_k").alias("_h2"), F.pmod("_row", F.lit(SALTS)).alias("_salt"), "_row", "_id", "_pos"
    )


def repeated_keys(found: DataFrame, parts: int, min_docs: int) -> DataFrame:
    """Hashes of keys in at least ``min_docs`` documents, with the largest document id."""
    order = Window.partitionBy("_h1", "_h2", "_salt").orderBy(F.desc_nulls_last("_id"), "_row", "_pos")
    ranged = found.repartitionByRange(parts, "_h1", "_h2", "_salt")
    before = F.lag("_row").over(order)
    first = ranged.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("_row")))
    return first.groupBy("_h1", "_h2").agg(F.count("*").alias("_docs"), F.max("_id").alias("_keeper")).filter(F.col("_docs") >= min_docs)


def keep_bitmaps(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """For each row that loses lines, a map from word number to the bits of the lines that stay; words missing there keep all."""
    drops = found.join(repeated, ["_h1", "_h2"]).filter(~F.col("_id").eqNullSafe(F.col("_keeper")))
    word = F.floor(F.col("_pos") / _BITS)
    gone = drops.groupBy("_row", "_id", word.alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, _pos % {_BITS})")).alias("_gone"))
    kept = gone.withColumn("_bits", F.lit(_ALL).bitwiseXOR(F.col("_gone")))
    return kept.groupBy("_row", "_id").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_keep"))


def line_dedup(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The columns of ``docs`` with the kept lines as ``text``, and ``n_lines``, ``n_dropped`` and ``keep_bits``."""
    parts = parallelism(docs.sparkSession)
    text, doc_id = place(docs, "text"), place(docs, "doc_id")
    own = hide(docs)
    rows = own.select(F.xxhash64(doc_id, text).alias("_row"), F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_lines_of"))
    found = cut(occurrences(rows, min_chars))
    # as a table of their own the keys have a known size, and the join's other side can be split where a key is hot
    repeated = cut(repeated_keys(found, parts, min_docs))
    marks = keep_bitmaps(found, repeated).withColumnsRenamed({"_row": "_mark_row", "_id": "_mark_id"})
    keyed = own.withColumn("_row", F.xxhash64(doc_id, text))
    met = keyed.join(marks, (F.col("_row") == F.col("_mark_row")) & F.col(doc_id).eqNullSafe(F.col("_mark_id")), "left")
    met = met.withColumn("_lines", F.split(F.coalesce(text, F.lit("")), "\n"))
    kept = F.expr(f"filter(_lines, (x, i) -> coalesce(_keep[CAST(floor(i / {_BITS}) AS BIGINT)], {_ALL}L) & shiftleft(1L, i % {_BITS}) <> 0L)")
    met = met.withColumn("_kept", F.when(F.col("_keep").isNull(), F.col("_lines")).otherwise(kept))
    counts = {"n_lines": F.size("_lines").cast("long"), "n_dropped": (F.size("_lines") - F.size("_kept")).cast("long"), "keep_bits": F.col("_keep")}
    whole = F.when(F.col("_keep").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join("_kept", "\n"))
    return restored(met, docs, {"text": whole}, counts)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of a result of :func:`line_dedup`."""
    return take(result, "doc_id", "n_lines", "n_dropped", "text").select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
