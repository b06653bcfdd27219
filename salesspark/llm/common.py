"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesspark.session import ensure_checkpoint_dir

#: The white space that separates words and the letters that are lower-cased.
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once, and read again after an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip_white(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def word_count(c: Column) -> Column:
    """Words of a text; null counts as no word."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash128(c: Column, a: str, b: str) -> list[Column]:
    """Two 64-bit hashes of ``c`` with different seeds, as columns ``a`` and ``b``."""
    return [F.xxhash64(c).alias(a), F.xxhash64(F.lit(7_046_029_254), c).alias(b)]


def with_text(docs: DataFrame, row: str, text: Column, text_col: str) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``, with ``text`` in place of the text and its length in ``n_chars``."""
    own = {text_col: text, "n_chars": F.char_length(text).cast("long")}
    return [own.get(c, F.col(row).getField(c)).alias(c) for c in docs.columns]
