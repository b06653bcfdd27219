"""Operator 4: MinHash near-dedup with tensored banding.

A text's set holds its distinct shingles of five words (A-Z lower-cased), as 64-bit hashes. Two collections of ``PIECES``
small hashes are taken of each set, a small hash being ``PIECE_MINS`` minimums; a table's key joins one small hash of the
first collection with one of the second. So PIECES * PIECES tables of 2 * PIECE_MINS minimums each come from
2 * PIECES * PIECE_MINS minimums per text, about the square root of what as many separate tables take. Two sets of
similarity 0.75 share no table with a probability below 4e-5, sets of 0.8 below 2e-7.

The tables are formed in two steps: texts that share a small hash of the first collection with another text, and only
those, go on to be joined with the second. Then

1. equal word sequences are one class, enter once and are linked under a number of their own;
2. in each table key's group every member is paired with the group's smallest member (a star, not all pairs), the pairs are
   confirmed on the full sets, and confirmed links are joined to components;
3. links between components that no star has shown are found by an exact way, whatever the size of the groups. Only
   shingles found in several components can be shared by two of them, and sets alike by 0.75 share that part of either set. So
   a set with fewer such shingles is done, and of the others, in one order by frequency, two alike sets meet in the rarest
   few, at places that leave room for all they must share (prefix and positional filtering). Texts that have just a
   passage in common are never paired.

Components come from alternating large-star and small-star steps over the link table, checkpointed each round.

Defined results: a text of fewer than five words has its whole sequence as its one shingle; a null or empty text or one
of white space only has an empty set, is linked with nothing and is its own component. Texts that share a ``doc_id`` are linked each on
its own. A null ``doc_id`` is linked with nothing. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesspark.llm.common import hash128, settled
from salesspark.llm.kept import Kept, done_with, owns, working_for

SHINGLE_WORDS = 5
PERCENT = 75
PIECES, PIECE_MINS = 20, 3
ID_BITS = 1 << 24
KEPT_BYTES = 24 << 20
HUBS = 1000

_POWERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F], dtype=np.uint64)


_WORDS = Kept(xxhash.xxh64_intdigest, KEPT_BYTES, longest=64)
owns("near_dup", _WORDS.forget)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; bytes.lower and bytes.split know just A-Z and the six ASCII white-space characters."""
    return (text or b"").lower().split()


def shingles(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words together, if there are fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width = min(n, size)
    sums = np.full(n - width + 1, np.uint64(width * 1_000_003), np.uint64)
    for k in range(width):
        sums += h[k:n - width + 1 + k] * _POWERS[k]
    return np.unique(_scrambled(sums))


def small_hashes(sets: np.ndarray, collection: int) -> np.ndarray:
    """The PIECES small hashes of one collection, each of PIECE_MINS minimums of seeded multiplicative orders."""
    rng = np.random.default_rng(1000 + collection)
    n = PIECES * PIECE_MINS
    odd = (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    low = ((sets >> np.uint64(17)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    mins = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        part = low[None, at:at + 4096] * odd
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(mins, part.min(axis=1), out=mins)
    mins = mins.reshape(PIECES, PIECE_MINS).astype(np.uint64)
    joined = np.arange(PIECES, dtype=np.uint64) + np.uint64(collection * 1000 + 1)
    for k in range(PIECE_MINS):
        joined = _scrambled(joined * np.uint64(0x9E3779B97F4A7C15) + mins[:, k])
    return joined


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    working_for("near_dup")
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        done_with("near_dup")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.uint64)
    for b in _chunks(batches):
        c1, c2, sizes, first, second = [], [], [], [], []
        for text in b.column("text").to_pylist():
            words = words_of(text)
            digest = xxhash.xxh128_digest(b" ".join(words))
            s = shingles(words)
            c1.append(int.from_bytes(digest[:8], "little", signed=True))
            c2.append(int.from_bytes(digest[8:], "little", signed=True))
            sizes.append(len(s))
            banded = len(words) >= SHINGLE_WORDS
            first.append(small_hashes(s, 0) if banded else none)
            second.append(small_hashes(s, 1) if banded else none)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("t1"), b.column("t2"), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
             pa.array(sizes, pa.int64()), _lists(first), _lists(second)], names=["doc_id", "t1", "t2", "c1", "c2", "n", "first", "second"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _chunks(batches):
        sets = [shingles(words_of(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc"), _lists(sets)], names=["doc", "shingles"])


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of the nodes of ``links`` (a, b), by alternating star steps.

    A hub's smallest neighbour reaches its many members by broadcast (of the nodes with a thousandth of all links each), so that they need not
    meet in one task."""
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        wide = F.col("n") * HUBS >= 2 * before[0]  # true of HUBS nodes at most, as all have 2 * edges neighbours together
        marked = both.filter("v > u").join(F.broadcast(least.filter(wide).select("u", F.col("m").alias("hub_m"))), "u", "left")
        others = marked.filter("hub_m IS NULL").select("u", "v").join(least.filter(~wide).select("u", "m"), "u")
        large = marked.filter("hub_m IS NOT NULL").select("v", F.col("hub_m").alias("m")).unionByName(others.select("v", "m")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = settled(large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
                        .select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _groups(keyed: DataFrame) -> DataFrame:
    """key and the smallest doc of the keys that several docs have."""
    return (keyed.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).filter("hub < last")
            .select("key", "hub"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike: percent * union <= 100 * intersection."""
    size_a, size_b = F.size("set_a"), F.size("set_b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    near = pairs.select("a", "b").distinct()
    return (near.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("set_b")), "b")
            .join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("set_a")), "a")
            .filter((100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b))
                    & (100 * both >= percent * (size_a + size_b - both)))
            .select("a", "b"))


def _prefixes(sets: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """s, doc, c, n, m, nth: the rarest shingles of each set among those found in several components, as many as prefix
    filtering needs (two sets of different components that are alike share one of these)."""
    at = sets.join(joined.withColumnsRenamed({"node": "doc", "component": "c"}), "doc", "left")
    rows = at.select("doc", F.coalesce("c", "doc").alias("c"), F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    shared = rows.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("df")) \
        .filter("lo < hi").select("s", "df")
    own = Window.partitionBy("doc")
    least = F.ceil(F.col("n") * percent / 100)
    return settled(rows.join(shared, "s").withColumn("nth", F.row_number().over(own.orderBy("df", "s")))
                   .withColumn("m", F.count(F.lit(1)).over(own)).filter(F.col("nth") <= F.col("m") + 1 - least)
                   .select("s", "doc", "c", "n", "m", "nth"))


def _between_components(sets: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that hold all pairs whose sets are alike. At the first shingle that two such
    sets share in the common order, what is left of either holds all they share, so shorter rests are no pair."""
    prefix = _prefixes(sets, joined, percent)
    other = prefix.select("s", *[F.col(c).alias(c + "2") for c in ("doc", "c", "n", "m", "nth")])
    alike = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    rest = F.least(F.col("m") - F.col("nth"), F.col("m2") - F.col("nth2")) + 1
    enough = (100 + percent) * rest >= percent * (F.col("n") + F.col("n2"))
    return prefix.join(other, "s").filter((F.col("doc") < F.col("doc2")) & (F.col("c") != F.col("c2")) & alike & enough) \
        .select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct()


def text_key(text: Column) -> list[Column]:
    """t1 and t2: which text of a ``doc_id`` a row has."""
    return hash128(text.cast("binary"), "t1", "t2")


def _texts_of(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc and text of the classes ``wanted`` (doc, doc_id, t1, t2), once each. A bitmap of ID_BITS hashed ids (2 MB, whatever
    the input) sorts most other texts out before the join, so they are not shuffled."""
    place = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(ID_BITS))
    word = 32768
    bitmap = wanted.select(place.alias("p")).groupBy(F.expr(f"p div {word}").alias("part")).agg(
        F.bitmap_construct_agg(F.col("p") % word).alias("bits"))  # at most ID_BITS / 32768 rows of 4 KB
    rows = own.filter("doc_id IS NOT NULL").withColumn("p", place) \
        .withColumn("part", F.expr(f"p div {word}")).withColumn("at", (F.col("p") % word).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(bits, at div 8 + 1, 1)")), 16, 10).cast("int")
    near = rows.join(F.broadcast(bitmap), "part").filter(F.call_function("bit_get", byte, F.col("at") % 8) == 1)
    return near.select("doc_id", "t1", "t2", "text").join(wanted, ["doc_id", "t1", "t2"]).dropDuplicates(["doc"]).select("doc", "text")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, ``class_id`` (smallest doc_id of the same word sequence), t1 and t2 (``text_key``) and
    ``component`` (a number for the component, null for what is linked with nothing by rule), a row per row.

    Classes of equal word sequences are what is linked, not ids: texts that share a ``doc_id`` are told apart."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *text_key(F.col(text_col)))
    signed = settled(own.mapInArrow(_signatures, "doc_id long, t1 long, t2 long, c1 long, c2 long, n long, first array<long>, second array<long>"))
    whole = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = settled(whole.groupBy("c1", "c2").agg(
        F.min(F.struct("doc_id", "t1", "t2")).alias("row"), F.first("n").alias("n"), F.first("first").alias("first"),
        F.first("second").alias("second"))).withColumn("doc", F.monotonically_increasing_id())
    banded = classes.filter(F.size("first") > 0)

    ones = banded.select("doc", "second", F.explode("first").alias("key"))
    shared = settled(ones.join(_groups(ones).select("key"), "key"))
    tables = shared.select("doc", F.explode(F.transform("second", lambda b: F.xxhash64("key", b))).alias("key"))
    stars = settled(tables.join(_groups(tables), "key").filter("hub < doc")
                    .select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct())
    involved = stars.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    wanted = involved.join(classes.select("doc", "row.*"), "doc")
    sets = settled(_texts_of(own, wanted).mapInArrow(_full_sets, "doc long, shingles array<long>"))

    links = settled(_confirmed(stars, sets, percent))
    joined = settled(components(links))

    rest = _between_components(sets, joined, percent).join(stars, ["a", "b"], "left_anti")
    more = _confirmed(rest, sets, percent)
    final = settled(components(links.unionByName(more)))

    firsts = classes.select("doc", F.col("row.doc_id").alias("first_doc"))
    members = final.unionByName(final.select(F.col("component").alias("node"), "component").distinct())  # the smallest has no row
    smallest = members.join(firsts.withColumnRenamed("doc", "node"), "node").groupBy("component").agg(F.min("first_doc").alias("linked"))
    same = classes.select("c1", "c2", "doc", F.col("row.doc_id").alias("first_doc")) \
        .join(members.withColumnRenamed("node", "doc").join(smallest, "component"), "doc", "left")
    out = signed.join(same, ["c1", "c2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.coalesce("linked", "first_doc")).alias("component_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("first_doc")).alias("class_id"), "t1", "t2",
                      F.when(~alone, F.coalesce("component", "doc")).alias("component")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
