"""Q2: which of many values occur in a text, found in one pass over each text by an Aho-Corasick automaton.

A vocabulary of up to ``SHARD`` values travels to the tasks in one broadcast and becomes one automaton per worker. A larger one is dealt in
shards by hash; each shard is packed in one row, sent to the tasks that hold its copy of the texts, and scanned there, so neither the driver
nor a task ever holds more than a shard. Memory for a text is that of the text, whatever its length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 100_000


class Matcher:
    """Smallest value of each field whose lower-case form occurs in a text. ``words``: (lower-case form, smallest value by field)."""

    def __init__(self, words: list[tuple], fields: int):
        self.fields, self.always = fields, [w[1:] for w in words if w[0] == ""]
        self.automaton = ahocorasick.Automaton()
        for w in words:
            if w[0]:
                self.automaton.add_word(w[0], tuple(w[1:]))
        if len(self.automaton):
            self.automaton.make_automaton()

    def first(self, text: str | None) -> list[str | None]:
        best: list[str | None] = [None] * self.fields
        if text is None:
            return best
        found = set(self.always)
        if len(self.automaton):
            found.update(values for _, values in self.automaton.iter(text))
        for values in found:
            for i, v in enumerate(values):
                if v is not None and (best[i] is None or v < best[i]):
                    best[i] = v
        return best


_BUILT: dict[str, Matcher] = {}


def _matcher(name: str, shared) -> Matcher:
    """The automaton of a broadcast vocabulary, built once per worker; only the last one is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher(*shared.value)
    return _BUILT[name]


def with_matches(texts: DataFrame, text: str, vocab: DataFrame, fields: list[str]) -> DataFrame:
    """``texts`` with one column per field: the smallest of its values in ``vocab`` (Field, Value) that occurs, ignoring case, in the
    lower-case column ``text``."""
    spark = texts.sparkSession
    words = vocab.filter("Value IS NOT NULL").groupBy(F.lower("Value").alias("part")).agg(
        *(F.min(F.when(F.col("Field") == f, F.col("Value"))).alias(f) for f in fields))
    few = [tuple(r) for r in words.limit(SHARD + 1).collect()]
    if len(few) <= SHARD:
        shared, name = spark.sparkContext.broadcast((few, len(fields))), uuid.uuid4().hex

        @F.pandas_udf(", ".join(f"`{f}` string" for f in fields))
        def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            matcher = _matcher(name, shared)
            for batch in batches:
                yield pd.DataFrame([matcher.first(t) for t in batch], columns=fields, dtype=object)

        found = texts.withColumn("_hits", hits(F.col(text)))
        return found.select(*texts.columns, *(F.col("_hits").getField(f).alias(f) for f in fields))

    shards = -(-words.count() // SHARD) + 1
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod(F.xxhash64("part"), F.lit(shards))
    packed = words.groupBy(shard.alias("shard")).agg(F.collect_list(F.struct("part", *fields)).alias("words"))
    lows = texts.select(F.col(text).alias("low")).filter("low IS NOT NULL").distinct()
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    dealt = lows.select(every, F.pmod(F.xxhash64("low"), F.lit(n)).alias("salt"), "low") \
        .withColumn("words", F.lit(None).cast(packed.schema["words"].dataType))
    copies = packed.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("salt"),
                           F.lit(None).cast("string").alias("low"), "words")
    meeting = copies.unionByName(dealt).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("low").asc_nulls_first())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's words, followed by the texts that meet it."""
        matcher = None
        for batch in batches:
            out = []
            for low, own in zip(batch.column("low").to_pylist(), batch.column("words"), strict=True):
                if low is None:
                    matcher = Matcher([tuple(w.values()) for w in own.as_py()], len(fields))
                else:
                    first = matcher.first(low)
                    if any(v is not None for v in first):
                        out.append((low, *first))
            columns = list(zip(*out, strict=True)) if out else [[]] * (len(fields) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["low", *fields])

    rows = meeting.mapInArrow(scan, "low string, " + ", ".join(f"`{f}` string" for f in fields))
    best = rows.groupBy(F.col("low").alias(text)).agg(*(F.min(f).alias(f) for f in fields))
    return texts.join(best, text, "left")
