"""Lines that many documents share go: explode, hash, count documents, drop, reassemble.

A text is cut at ``\\n`` (null and empty texts have one empty line). A line's key is the line without
ASCII blanks at both ends and with A-Z lower-cased. Every line whose key occurs in at least
``min_docs`` documents goes, in every document; the others stay in their order.

* Keys are 128-bit hashes. A document sends each of its keys once, and documents per key are counted
  map-side first, so a line that all documents share is one row per task.
* Places of dropped lines are found by a join of hashes, not of lines. Hashes found in more than a
  thousandth of all documents' keys cannot be more than a thousand and are broadcast; no other hash
  has so many rows that one task would feel it.
* Dropped places are gathered per document and text hash, and whole texts are shuffled once.

Every row is a document of its own, also if it repeats another; equal rows lose the same lines. A
null text comes back as an empty one, as does a text that loses all its lines. An empty table gives
an empty result. Texts of any length are processed whole, in time proportional to their lines. All
other columns are carried through; the columns added here win over equal names. Only built-in
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowrill.llm.frames import ROW, discard, packed, stored, unpacked
from flowrill.llm.words import lowered

BLANKS = " \t\n\x0b\x0c\r"
HEAVY_SHARE = 1000


def line_array(text: Column) -> Column:
    """The lines of a text; one empty line for null."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column, min_chars: int) -> Column:
    """A hash for each line; null for keys shorter than ``min_chars``."""

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        return F.when(F.length(key) >= min_chars, F.md5(key))

    return F.transform(line_array(lowered(text)), hashed)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``kept_text, n_lines, n_dropped``: the text without common lines."""
    text, doc_id = F.col(f"{ROW}.text"), F.col(f"{ROW}.doc_id").cast("string")
    who = [doc_id.alias("doc"), F.xxhash64(text, F.lit(11)).alias("text_hash")]
    rows = packed(docs)
    keys, keys_path = stored(rows.select(*who, line_keys(text, min_chars).alias("keys")), "line-keys", "zstd")

    once = keys.select(F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    counts, counts_path = stored(
        once.groupBy(F.unhex("key").alias("key")).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "line-counts"
    )
    total = keys.agg(F.sum(F.size("keys"))).first()[0] or 0
    heavy = F.col("n") * HEAVY_SHARE >= total
    lines = keys.select("doc", "text_hash", F.posexplode("keys").alias("place", "key")).where("key is not null")
    lines = lines.withColumn("key", F.unhex("key")).join(
        F.broadcast(counts.where(heavy).select("key", F.lit(True).alias("hot"))), "key", "left"
    )
    rest = lines.where("hot is null").join(counts.where(~heavy).select("key"), "key", "left_semi")
    places = lines.where("hot").select("doc", "text_hash", "place").union(rest.select("doc", "text_hash", "place"))
    # Equal rows send equal places.
    dropped, dropped_path = stored(
        places.groupBy("doc", "text_hash").agg(F.collect_set("place").alias("places")), "line-places"
    )
    discard(keys_path, counts_path)

    found = rows.select(ROW, *who).join(
        dropped.select(F.col("doc").alias("of"), F.col("text_hash").alias("of_hash"), "places"),
        F.col("doc").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left",
    )

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
        return F.array_join(F.transform(places, lambda place: F.get(lines, place)), "\n")

    # In an array of one element the lines are cut once, and not again for each place.
    without = F.get(F.transform(F.array(line_array(text)), kept), F.lit(0))
    result = found.select(
        ROW,
        F.when(F.col("places").isNull(), F.coalesce(text, F.lit(""))).otherwise(without).alias("kept_text"),
        F.size(line_array(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return unpacked(result, "kept_text", "n_lines", "n_dropped")
