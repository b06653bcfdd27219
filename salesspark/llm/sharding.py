"""Operator 3: sharding by vector bin packing.

Groups of equal texts are vectors of bytes, tokens and rows, in shares of the corpus. Largest first, each goes to the shard
whose residual capacity has the highest dot product with it. The number of groups grows with the corpus, so what is
packed is bounded: a group above 1/``items`` of any total is an item of its own, all smaller groups are dealt into ``items`` bundles by the
hash of their text. Groups stay whole, unless whole groups alone would fill a shard beyond its share of the bytes: then the largest of them are
cut, by a hash of ``doc_id`` and the row's number among equal rows, into pieces of at most ``piece`` of a shard. At most
3 * items + items + 3 * shards / piece items reach the driver, whatever the input. Last, single bundles move from
the largest to the smallest shard while that brings their bytes closer, so that the law ``bytes`` holds: sizes near equal.

Slots number each shard's rows from 0 without gaps, in buckets of a hash of ``doc_id``, text and number among equal rows: counts of the
buckets give each bucket's first slot, so no task ever sorts a whole shard, also if a third of the rows has one id or none.

Defined results: a null text has no bytes, no tokens and the CRC of nothing; its size is 1 (the separator). All empty and null texts are
one group. Rows that repeat each other get slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesspark.llm.common import hash128, settled, word_count
from salesspark.llm.ordered import running_by_key

MEASURES = ("bytes", "tokens", "rows")


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of ``vectors``: shares of each total), by dot product with the residual capacity."""
    load, at = np.zeros((shards, vectors.shape[1])), np.zeros(len(vectors), np.int64)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        at[i] = int(np.argmax((1.0 / shards - load) @ vectors[i]))
        load[at[i]] += vectors[i]
    return even_out(vectors, at, shards)


def even_out(vectors: np.ndarray, at: np.ndarray, shards: int) -> np.ndarray:
    """Move one item at a time from the shard with most bytes to the one with least while that brings them closer."""
    size = np.bincount(at, weights=vectors[:, 0], minlength=shards)
    for _ in range(10 * len(at)):
        top, low = int(np.argmax(size)), int(np.argmin(size))
        own = np.flatnonzero(at == top)
        gap = size[top] - size[low]
        fits = own[(vectors[own, 0] > 0) & (vectors[own, 0] < gap)]
        if not len(fits):
            break
        i = fits[np.argmin(np.abs(vectors[fits, 0] - gap / 2))]
        at[i] = low
        size[top] -= vectors[i, 0]
        size[low] += vectors[i, 0]
    return at


def groups_to_cut(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Which groups can't stay whole: while whole groups alone give a shard more than its share of the bytes, its largest group goes."""
    cut = np.zeros(len(vectors), bool)
    for _ in range(len(vectors)):
        whole = np.flatnonzero(~cut)
        load, at = np.zeros(shards), np.zeros(len(whole), np.int64)
        for i in np.argsort(-vectors[whole, 0], kind="stable"):
            at[i] = int(np.argmin(load))
            load[at[i]] += vectors[whole[i], 0]
        full = int(np.argmax(load)) if len(whole) else 0
        if load[full] <= 1.0 / shards:
            break
        own = whole[at == full]
        cut[own[np.argmax(vectors[own, 0])]] = True
    return cut


def shard(docs: DataFrame, shards: int = 8, items: int = 2048, piece: float = 1 / 32, bucket_rows: int = 20_000,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, tokens, text_crc32, law, shard, slot and grown_shard of each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = settled(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        word_count(text).alias("tokens"), F.crc32(text).alias("text_crc32"), *hash128(text, "g1", "g2")))
    alike = slim.withColumns({"at": F.monotonically_increasing_id(), "alike": F.xxhash64("doc_id", "g1", "g2")})
    rows = settled(running_by_key(alike, "alike", [F.col("at")], {}, place="nth").drop("at", "alike"))
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = [float(x or 1) for x in rows.agg(*sums).first()]
    groups = rows.groupBy("g1", "g2").agg(*sums)
    shares = [F.col(m) / t for m, t in zip(MEASURES, total, strict=True)]
    heavy = groups.filter(F.greatest(*shares) > 1.0 / items).select("g1", "g2", *(s.alias(m) for m, s in zip(MEASURES, shares, strict=True))) \
        .orderBy("g1", "g2").collect()  # at most 3 * items by that bound
    cut = groups_to_cut(np.array([[r[m] for m in MEASURES] for r in heavy], float).reshape(-1, 3), shards)
    heavy_table = spark.createDataFrame([(r["g1"], r["g2"], math.ceil(max(r[m] for m in MEASURES) * shards / piece) if c else 1)
                                         for r, c in zip(heavy, cut, strict=True)], "g1 long, g2 long, pieces int")
    spread = F.xxhash64("doc_id", "g1", "nth", F.lit(3))
    placed = (rows.join(F.broadcast(heavy_table), ["g1", "g2"], "left")
              .withColumn("bundle", F.when(F.col("pieces").isNull(), F.pmod("g1", F.lit(items))).otherwise(F.lit(-1)))
              .withColumn("h1", F.when(F.col("pieces").isNotNull(), F.col("g1")).otherwise(F.lit(0)))
              .withColumn("h2", F.when(F.col("pieces").isNotNull(), F.col("g2")).otherwise(F.lit(0)))
              .withColumn("piece", F.coalesce(F.pmod(spread, F.col("pieces")), F.lit(0))))
    key = ["bundle", "h1", "h2", "piece"]
    packed = placed.groupBy(*key).agg(*sums).orderBy(*key).collect()
    vectors = np.array([[r[m] / t for m, t in zip(MEASURES, total, strict=True)] for r in packed], float).reshape(-1, 3)
    at = pack(vectors, shards)
    where = spark.createDataFrame([(*[r[k] for k in key], int(s)) for r, s in zip(packed, at, strict=True)],
                                  "bundle long, h1 long, h2 long, piece long, shard int")
    n_buckets = max(1, math.ceil(total[2] / shards / bucket_rows))
    dealt = placed.join(F.broadcast(where), key).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "g1", "nth", F.lit(5)), F.lit(n_buckets)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    nth = Window.partitionBy("shard", "bucket").orderBy("doc_id", "g1", "g2", "nth")
    return (dealt.withColumn("nth", F.row_number().over(nth)).join(first, ["shard", "bucket"])
            .select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
