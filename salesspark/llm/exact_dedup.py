"""Operator 9: exact dedup by a minimal perfect hash over the distinct digests of a history.

Texts are equal when they are identical without white space; their digest is the SHA-256 of that. The index is two
tables. ``pilots`` has one number for each bucket of a shard; ``slots`` has, at the place that digest and pilot
hash to, the full digest, the locator of the row that stays and the size of its group. A shard has as many slots as
digests, so the hash is minimal and perfect. Shards hold about ``SHARD_DIGESTS`` digests each and are built apart.

A lookup is two equi-joins (bucket to pilot, place to slot) and a comparison of all 32 bytes. Rows whose digest is in
the index are repeats of the history; the others are grouped among themselves by digest. Digests that no
pilot can place (two of one bucket with one 64-bit hash) are left out of the index and so go the second way, which is exact.

Defined results: a null text is an empty one, and empty texts are equal to each other and to texts of white space
only. Of equal texts the one with the most code points stays, then the smallest ``doc_id``; rows without a
``doc_id`` only stay if their group has no other. Rows that repeat the ``doc_id`` that stays are all marked as kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesspark.llm.common import WHITE_SPACE, settled

SHARD_DIGESTS = 4096
BUCKET_DIGESTS = 4
PILOT_BLOCK = 256
PILOT_BLOCKS = 4096

INDEX_SCHEMA = "shard long, at int, pilot long, digest binary, keep_id long, group_size long"


def normalised(c: Column) -> Column:
    for w in WHITE_SPACE:
        c = F.replace(c, F.lit(w), F.lit(""))
    return c


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (32 bytes) and n_points (code points of the original text) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
                       F.char_length(text).alias("n_points"))


def winners(digested: DataFrame) -> DataFrame:
    """digest, keep_id, group_size; partial aggregates come before the shuffle, so a hot text costs one row per task."""
    best = F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("less")))
    return (digested.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.bitwise_not("best.less").alias("keep_id"), "group_size"))


def spark_hash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``xxhash64(seeded, value)`` as Spark computes it for a long, on arrays of uint64 (XXH64 of eight bytes)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                  0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = seed + p5 + np.uint64(8)
    h = h ^ (turn(value * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def place_digests(bucket: np.ndarray, base: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A pilot for each bucket so that all digests fall into places of their own; place -1: no pilot was found."""
    n = len(base)
    pilots, place, free = np.zeros(n_buckets, np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    ends = np.cumsum(sizes)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        own = order[ends[b] - sizes[b]:ends[b]]
        for block in range(PILOT_BLOCKS):
            tried = np.arange(block * PILOT_BLOCK, (block + 1) * PILOT_BLOCK, dtype=np.uint64)
            h = spark_hash_long(tried[:, None], base[own][None, :]).astype(np.int64)
            at = np.mod(h, n)
            ok = free[at].all(axis=1)
            if len(own) > 1 and ok.any():
                s = np.sort(at, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                i = int(np.argmax(ok))
                pilots[b], place[own] = int(tried[i]), at[i]
                free[at[i]] = False
                break
            if len(set(base[own].tolist())) < len(own):
                break
    return pilots, place


def _shard_of(digest: Column, n_shards: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), digest), n_shards)


def _bucket_of(digest: Column, n_slots: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(13), digest), F.ceil(n_slots / F.lit(BUCKET_DIGESTS))).cast("int")


class DigestIndex:
    """``pilots`` (shard, n_slots, bucket, pilot) and ``slots`` (shard, slot, digest, keep_id, group_size)."""

    def __init__(self, pilots: DataFrame, slots: DataFrame, n_shards: int):
        self.pilots, self.slots, self.n_shards = pilots, slots, n_shards


def build_index(history: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shard_digests: int = SHARD_DIGESTS) -> DigestIndex:
    """Index the distinct digests of ``history``; ``shard_digests`` bounds what one task holds."""
    return index_winners(settled(winners(digests(history, id_col, text_col))), shard_digests)


def index_winners(kept: DataFrame, shard_digests: int = SHARD_DIGESTS) -> DigestIndex:
    n_shards = max(1, -(-kept.count() // shard_digests))
    sharded = kept.withColumn("shard", _shard_of(F.col("digest"), F.lit(n_shards)))
    counted = sharded.join(sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_slots")), "shard")
    keyed = counted.withColumn("bucket", _bucket_of(F.col("digest"), F.col("n_slots"))) \
        .withColumn("base", F.xxhash64("digest"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        pilots, place = place_digests(pdf["bucket"].to_numpy(np.int64), pdf["base"].to_numpy(np.int64).view(np.uint64),
                                      -(-n // BUCKET_DIGESTS))
        shard = int(pdf["shard"].iloc[0])
        slots = pd.DataFrame({"shard": shard, "at": place, "pilot": None, "digest": pdf["digest"],
                              "keep_id": pdf["keep_id"].astype("Int64"), "group_size": pdf["group_size"].astype("Int64")})
        heads = pd.DataFrame({"shard": shard, "at": np.arange(len(pilots)), "pilot": pilots, "digest": None,
                              "keep_id": None, "group_size": n})
        return pd.concat([slots[place >= 0].astype(object), heads.astype(object)], ignore_index=True)

    built = settled(keyed.groupBy("shard").applyInPandas(build, INDEX_SCHEMA))
    pilots = built.filter(F.col("pilot").isNotNull()).select("shard", F.col("at").alias("bucket"), "pilot",
                                                             F.col("group_size").alias("n_slots"))
    slots = built.filter(F.col("pilot").isNull()).select("shard", F.col("at").alias("slot"), F.col("digest").alias("s_digest"),
                                                         F.col("keep_id").alias("s_keep"), F.col("group_size").alias("s_size"))
    return DigestIndex(pilots, slots, n_shards)


def dedup_digests(digested: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest and ``in_history`` of each row of ``digested``."""
    d = digested.withColumn("shard", _shard_of(F.col("digest"), F.lit(index.n_shards)))
    sizes = index.pilots.select("shard", "n_slots").distinct()
    at = (d.join(sizes, "shard", "left").withColumn("bucket", _bucket_of(F.col("digest"), F.col("n_slots")))
          .join(index.pilots.select("shard", "bucket", "pilot"), ["shard", "bucket"], "left")
          .withColumn("slot", F.pmod(F.xxhash64("digest", "pilot"), F.col("n_slots")).cast("int")))
    found = settled(at.join(index.slots, ["shard", "slot"], "left").select(
        "doc_id", "digest", "n_points", F.coalesce(F.col("s_digest") == F.col("digest"), F.lit(False)).alias("in_history"),
        "s_keep", "s_size"))
    repeats = found.filter("in_history").select("doc_id", "digest", F.col("s_keep").alias("keep_id"),
                                                F.col("s_size").alias("group_size"), "in_history")
    fresh = found.filter(~F.col("in_history"))
    others = fresh.select("doc_id", "digest", "in_history").join(winners(fresh), "digest") \
        .select("doc_id", "digest", "keep_id", "group_size", "in_history")
    return repeats.unionByName(others).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compare a batch with the history of ``index``: a row of the batch stays if it is the history's winner itself, or
    if its text is new and it is the winner among the batch's equal texts."""
    return dedup_digests(settled(digests(docs, id_col, text_col)), index)


def dedup_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Dedup a table against the index of itself."""
    digested = settled(digests(docs, id_col, text_col))
    return dedup_digests(digested, index_winners(settled(winners(digested))))
