"""Operator 13: the prefix tree of conversations, all prefixes from ROLLUP over columns of turn ids.

A turn's id is the first half of the SHA-256 of its role and text, with the text's length in bytes. Turns stand in blocks of ``WIDTH``
columns t1 to t8, one row per conversation and block. ``GROUP BY block, prior, ROLLUP (t1, ..., t8)`` counts all prefixes that end in the block at once:
``grouping_id`` says how many columns a group holds, and a group whose last column is null is no prefix. ``prior`` is the node at which the block before
ended, so equal blocks after different beginnings stay apart and long conversations need no more columns, only more rows. Equal rows are
aggregated before the rollup, so a conversation that is repeated often costs one row per task.

A node's key is the sum, over its turns, of two hashes of (depth, turn id), in exact decimals. So the keys of all blocks of all conversations come from
running sums at once, not block after block, also where one conversation holds a third of all rows.

What a subtree adds up to comes from a second rollup, over the nodes: each brings its own saved tokens and, if nothing follows it, itself as a
leaf. What lies in later blocks is brought by the node's smallest member: its row of a block carries the sum of all that it stands for
further down, to which each node of the block is a beginning.

Defined results: null turns come first, turns that tie stand by role, then by the SHA-256 of the text; a null role or text is
empty. Rows without conv_id belong to no conversation. Repeated rows are turns of their own. Conversations left without turns are members of the root
only. No conversation, no row. Texts are read whole, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesspark.llm.common import settled
from salesspark.llm.ordered import running_by_key

WIDTH = 8
TURNS = [f"t{j}" for j in range(1, WIDTH + 1)]
#: Ids that one hashed piece of text holds at most.
PIECE_BITS = 12
_KEY = "decimal(38,0)"


def turn_ids(rows: DataFrame) -> DataFrame:
    """conv, place (from 1) and turn (id and bytes of the text) of each row of a conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.sha2(text, 256)
    ident = F.substring(F.unhex(F.sha2(F.concat(digest, role), 256)), 1, 16)
    own = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), role.alias("role"), digest.alias("digest"),
        F.struct(ident.alias("id"), F.octet_length(text).cast("long").alias("bytes")).alias("turn"))
    return running_by_key(own, "conv", [F.col("at"), F.col("role"), F.col("digest")], {}, place="place").select("conv", "place", "turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations with their number of turns, and their turns: the first ``h`` of conversation c - c % 5, then c's own after its first ``h``."""
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select(
        "conv", "n", (F.col("conv") - F.col("conv") % 5).alias("base"), (F.crc32(F.col("conv").cast("string")) % 9).alias("h"))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").select(
        "conv", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("head"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest"))
    head = turns.filter("place <= 8").withColumnRenamed("conv", "base").join(convs.filter("head > 0").select("conv", "base", "head"), "base") \
        .filter("place <= head").select("conv", "place", "turn")
    rest = turns.join(convs.filter("rest > 0").select("conv", "h", "head"), "conv").filter("place > h") \
        .select("conv", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "turn")
    return convs.select("conv", (F.col("head") + F.col("rest")).alias("n_turns")), head.unionByName(rest)


def _hashes(place: Column, turn: Column) -> list[Column]:
    """Two hashes of a turn at its depth, exact enough to add up; null without turn."""
    return [F.when(turn.isNotNull(), F.xxhash64(F.lit(seed), place, turn["id"], turn["bytes"])).cast(_KEY) for seed in (11, 23)]


def _blocks(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation and block: conv, block, p1 and p2 (key of the node before the block), t1 to t8. Block 0 is never missing."""
    block = F.expr(f"(place - 1) div {WIDTH}")
    h1, h2 = _hashes(F.col("place").cast("long"), F.col("turn"))
    column = lambda j: F.max(F.when((F.col("place") - 1) % WIDTH == j, F.col("turn"))).alias(TURNS[j])
    none = turns.schema["turn"].dataType
    empty = convs.filter("n_turns = 0").select("conv", F.lit(0).cast("long").alias("block"), *(F.lit(None).cast(none).alias(t) for t in TURNS),
                                               *(F.lit(0).cast(_KEY).alias(s) for s in ("s1", "s2")))
    full = turns.withColumns({"block": block.cast("long"), "h1": h1, "h2": h2}).groupBy("conv", "block").agg(
        *(column(j) for j in range(WIDTH)), *(F.sum(h).cast(_KEY).alias(s) for h, s in (("h1", "s1"), ("h2", "s2"))))
    summed = running_by_key(full.unionByName(empty), "conv", [F.col("block")], {"e1": "s1", "e2": "s2"})
    return summed.select("conv", "block", (F.col("e1") - F.col("s1")).cast(_KEY).alias("p1"), (F.col("e2") - F.col("s2")).cast(_KEY).alias("p2"),
                         F.col("e1").cast(_KEY).alias("e1"), F.col("e2").cast(_KEY).alias("e2"), *TURNS)


def _rolled(df: DataFrame, aggregates: str) -> DataFrame:
    """``aggregates`` for each prefix of t1 to t8 within (block, p1, p2), with its depth ``d`` in the block; d = 0 for the root alone."""
    sets = df.sparkSession.sql(
        f"SELECT block, p1, p2, {', '.join(TURNS)}, {aggregates}, {WIDTH} - bit_count(grouping_id()) AS d "
        f"FROM {{rows}} GROUP BY block, p1, p2, ROLLUP ({', '.join(TURNS)})", rows=df)
    last = F.coalesce(*(F.when(F.col("d") == j + 1, F.col(t)) for j, t in enumerate(TURNS)))
    return sets.withColumn("last", last).filter("d > 0 AND last IS NOT NULL OR d = 0 AND block = 0")


def _keyed(nodes: DataFrame) -> DataFrame:
    """k1, k2 (key of the node) and u1, u2 (key of its parent) from the columns of a prefix."""
    out = {}
    for nth, (k, u, p) in enumerate((("k1", "u1", "p1"), ("k2", "u2", "p2"))):
        steps = [F.coalesce(F.when(F.col("d") > j, _hashes(F.col("block") * WIDTH + j + 1, F.col(t))[nth]), F.lit(0)) for j, t in enumerate(TURNS)]
        whole = sum(steps, F.col(p)).cast(_KEY)
        end = F.coalesce(*(F.when(F.col("d") == j + 1, steps[j]) for j in range(WIDTH)), F.lit(0))
        out |= {k: whole, u: (whole - end).cast(_KEY)}
    return nodes.withColumns(out)


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending, joined by commas. Ids are joined in bounded pieces along their order; the
    digest itself must read the pieces of a node in turn, which one task does as they stream past."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) for c in ("k1", "k2", "conv")]
    placed = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    pieces = placed.groupBy("k1", "k2", F.shiftright("at", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"), F.min("conv").alias("first"))
    schema = pa.schema([("k1", pa.decimal128(38, 0)), ("k2", pa.decimal128(38, 0)), ("ends_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, sha.hexdigest()), strict=True))], schema)

    return pieces.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "ids") \
        .mapInArrow(hashed, f"k1 {_KEY}, k2 {_KEY}, ends_sha256 string")


def _with_parents(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """``parent_conv_id`` for each node. Parents of a thousandth of all nodes or more, a thousand at most, are broadcast, so that their many
    children need not meet in one task; the others are joined by key."""
    parents = own.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    wide = F.col("n_children") * 1000 >= nodes.count()
    big = F.broadcast(parents.filter(wide).drop("n_children"))
    near = nodes.join(big, ["u1", "u2"], "left")  # the root has no parent: its own key stands in u1 and u2
    rest = near.filter("parent_conv_id IS NULL AND depth > 0").drop("parent_conv_id") \
        .join(parents.filter(~wide & (F.col("n_children") > 0)).drop("n_children"), ["u1", "u2"])
    root = near.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return near.filter("parent_conv_id IS NOT NULL AND depth > 0").unionByName(rest).unionByName(root)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node over conversations ``convs`` (conv, n_turns) with ``turns`` (conv, place from 1 without gaps, turn)."""
    blocks = settled(_blocks(convs, turns))
    same = blocks.groupBy("block", "p1", "p2", *TURNS).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    nodes = settled(_keyed(_rolled(same, "sum(n) AS n_convs, min(conv) AS conv_id")))
    one = nodes.select("k1", "k2", "n_convs", "conv_id", (F.col("block") * WIDTH + F.col("d")).alias("depth"), "u1", "u2")
    children = one.filter("depth > 0").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))

    saved = F.coalesce((F.col("n_convs") - 1) * F.col("last")["bytes"], F.lit(0))
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0)
    own = settled(nodes.join(children, ["k1", "k2"], "left").select(
        "k1", "k2", "block", "p1", "p2", *TURNS, "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        leaf.cast("long").alias("leaf"), saved.cast(_KEY).alias("saved")))
    stands = own.groupBy(F.col("conv_id").alias("conv"), "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").cast(_KEY).alias("saved")) \
        .filter("leaf > 0 OR saved > 0")
    of_conv = blocks.join(stands, ["conv", "block"], "left").na.fill(0, ["leaf"]).withColumn("saved", F.coalesce("saved", F.lit(0).cast(_KEY)))
    several = of_conv.join(blocks.filter("block = 1").select("conv"), "conv", "left_semi")  # others have no later block
    later = running_by_key(several, "conv", [F.col("block").desc()], {"leaves": "leaf", "saves": "saved"}).select(
        "block", "p1", "p2", *TURNS, (F.col("leaves") - F.col("leaf")).cast("long").alias("leaf"),
        (F.col("saves") - F.col("saved")).cast(_KEY).alias("saved")).filter("leaf > 0 OR saved > 0")
    brought = own.select("block", "p1", "p2", *TURNS, "leaf", "saved").unionByName(later)
    below = _keyed(_rolled(brought, "sum(leaf) AS n_leaves, sum(saved) AS saved_tokens")).select("k1", "k2", "n_leaves", "saved_tokens")

    last = blocks.join(convs.select("conv", F.floor((F.greatest("n_turns", F.lit(1)) - 1) / WIDTH).alias("block")), ["conv", "block"], "left_semi")
    digests = _end_digests(last.select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv"))
    kids = own.select("k1", "k2", "n_children")
    return _with_parents(one, own).join(kids, ["k1", "k2"]).join(below, ["k1", "k2"]).join(digests, ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves",
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
