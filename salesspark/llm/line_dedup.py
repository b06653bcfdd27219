"""Operator 1: line dedup [native]: hashed lines, range-partitioned, sorted by document and position.

A line's key is the line without white space at its ends and with A-Z lower-cased. The table of lines holds a
128-bit hash of the key, the document and the position, never the text. It is range-partitioned by hash and a salt
of the document (so that a line in a third of all documents spreads over as many ranges as it takes) and sorted by document
and position inside; a pass over that order marks each document's first occurrence. Sums of the marks per hash, first per
salt and then over salts, give the number of documents of a line. What comes back per document is a compressed keep bitmap: 64-line
words, of which those that keep every line are left out.

Defined results: a null text is one empty line, as is an empty one. A document is a ``doc_id``: rows that repeat a
``doc_id`` count once for a line, and rows without one count as one document together. Keys shorter than
``min_chars`` are never dropped. Other columns of the input don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesspark.llm.common import hash128, lower_ascii, settled, strip_white, with_text

#: Salts that each hash gets at least, and rows of all lines that one more salt stands for.
SALTS, ROWS_A_SALT = 64, 4_000_000


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), text.alias("text"),
                       F.xxhash64(text).alias("t"))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points: doc, t (which text of that doc), pos, h1, h2."""
    lines = _texts(docs, id_col, text_col).select(
        "doc", "t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = lower_ascii(strip_white(F.col("line")))
    return (lines.select("doc", "t", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
            .select("doc", "t", "pos", *hash128(F.col("key"), "h1", "h2")))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2,
                 min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """Per text that loses lines: doc, t, n_dropped, and ``keep``, a map from word number to the word's keep bits.

    Line ``p`` stays if bit ``p % 64`` of word ``p div 64`` is set or the word is not in the map. Lines whose key is in
    ``min_docs`` documents or more are dropped: all but the first in the order (doc, position) with ``keep_first``,
    else all of them.
    """
    lines = settled(line_hashes(docs, id_col, text_col, min_chars))
    salts = max(SALTS, lines.count() // ROWS_A_SALT)
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    at = Window.partitionBy("h1", "h2", "salt").orderBy("doc", "t", "pos")
    ranged = (salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc", "t", "pos")
              .withColumn("nth", F.row_number().over(at))
              .withColumn("opens", (F.col("nth") == 1) | ~F.col("doc").eqNullSafe(F.lag("doc").over(at))))
    spot = F.struct("doc", "t", "pos")
    per_salt = ranged.groupBy("h1", "h2", "salt").agg(F.sum(F.col("opens").cast("long")).alias("docs"),
                                                      F.min(spot).alias("first"))
    # written first: Spark splits a hot key in the join only if no aggregate stands between its shuffle and the join
    frequent = settled(per_salt.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))
                       .filter(F.col("docs") >= min_docs).select("h1", "h2", "first"))
    dropped = lines.join(frequent, ["h1", "h2"])
    if keep_first:
        dropped = dropped.filter(~spot.eqNullSafe(F.col("first")))
    words = (dropped.select("doc", "t", "pos").distinct()
             .groupBy("doc", "t", F.floor(F.col("pos") / 64).cast("int").alias("word"))
             .agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"),
                  F.count(F.lit(1)).alias("n")))
    return words.groupBy("doc", "t").agg(
        F.sum("n").alias("n_dropped"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct) with n_lines, n_dropped and ``kept``, the text of the lines that stay."""
    texts, b = _texts(docs, id_col, text_col), bitmaps.withColumnsRenamed({"doc": "b_doc", "t": "b_t"})
    joined = texts.join(b, texts["doc"].eqNullSafe(b["b_doc"]) & (texts["t"] == b["b_t"]), "left")
    lines = F.split("text", "\n", -1)

    def stays(_, i):
        word = F.try_element_at(F.col("keep"), F.floor(i / 64).cast("int"))
        return word.isNull() | (F.call_function("bit_get", word, i % 64) == 1)

    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return joined.select("row", F.size(lines).cast("long").alias("n_lines"),
                         F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """``docs`` with the same columns, texts without their repeated lines and ``n_chars`` (if there) to match."""
    applied = apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **rule), id_col, text_col)
    return applied.select(*with_text(docs, "row", F.col("kept"), text_col))
