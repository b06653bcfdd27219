"""Operator 6: approximate nearest neighbours by shifted space-filling curves.

Each of ``CURVES`` orderings projects the centred vectors on ``DIMS`` random orthogonal directions, shifts them at random on a
grid of 2**BITS cells a side and sorts them by the cell's place on a Hilbert curve. The grid is as fine as doubles go, so a group of near-equal
vectors is ordered by nearness too, differently on each curve, however tight it is. Spark range-partitions the rows by
(curve, key), and counts per range give each row its place on its curve. A query's candidates are the rows at most ``window``
places away on any curve; the window is a share of all rows, so recall is alike at every size. Rows are grouped in blocks of ``BLOCK`` places,
queries go to the blocks that their windows touch, in batches of about ``QUERIES`` (a block comes along with each batch), each block reranks its
own rows by distance in double precision and the best of all blocks and curves merge.

Equal vectors are one class that stands on the curves once, by its smallest id; its k + 1 smallest ids come back at the end, which is all that a
query can need. So no number of equal vectors widens a block, and ties go to smaller ids.

Defined results: vectors that are null, empty, all zero or hold a null or non-finite component take no part, neither do those of another
length than the most frequent one (the smaller of two). Rows without id take no part. Rows that repeat an id and vector count once; vectors that share an
id are candidates of their own, and a query never finds its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesspark.llm.common import hash128, settled
from salesspark.plans.prefix import running_total

CURVES, DIMS, BITS = 24, 16, 48
WINDOW_SHARE, LEAST_WINDOW = 0.025, 64
BLOCK, QUERIES = 1024, 1024
REACH = 64.0


def _transposed(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places on the Hilbert curve, one row per dimension: their bits are those of all dimensions by turns, highest first."""
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & one == one, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= turn
    return x


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``cells`` (integers below 2**bits), all rows at once."""
    x = _transposed(cells, bits)
    dims, one = len(x), np.uint64(1)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def hilbert_bytes(cells: np.ndarray, bits: int) -> list[bytes]:
    """The same places as big-endian bytes, for any number of bits."""
    x = _transposed(cells, bits)
    places = np.concatenate([((x >> np.uint64(level)) & np.uint64(1)).astype(np.uint8) for level in range(bits - 1, -1, -1)])
    return [row.tobytes() for row in np.packbits(places, axis=0).T]


def curve_keys(vectors: np.ndarray, centre: np.ndarray, spread: float, curve: int) -> list[bytes]:
    rng = np.random.default_rng(100 + curve)
    n = vectors.shape[1]
    dims = min(DIMS, n)
    directions = np.linalg.qr(rng.standard_normal((n, n)))[0][:, :dims]
    at = ((vectors - centre) @ directions / spread + REACH) / (2 * REACH)
    cells = np.clip((at + rng.random(dims)) * 2.0 ** (BITS - 1), 0, 2 ** BITS - 1).astype(np.int64)
    return hilbert_bytes(cells, BITS)


def _valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    e = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e")).filter(F.col("vec_id").isNotNull() & (F.size("e") > 0))
    sound = F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    return own.filter(sound & F.exists("e", lambda x: x != 0))


def _centre(reps: DataFrame, length: int) -> tuple[np.ndarray, float]:
    """Mean vector and root mean square of a component around it, from sums per task."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(length), 0.0
        for f in frames:
            v = np.array(f["e"].tolist(), float).reshape(-1, length)
            n, s, q = n + len(v), s + v.sum(axis=0), q + float((v * v).sum())
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q]})

    parts = reps.select("e").mapInPandas(sums, "n long, s array<double>, q double").collect()
    n = max(1, sum(p["n"] for p in parts))
    centre = np.sum([p["s"] for p in parts], axis=0) / n if parts else np.zeros(length)
    spread = np.sqrt(max(0.0, sum(p["q"] for p in parts) / n / length - float(centre @ centre) / length))
    return centre, float(spread) or 1.0


def nearest(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            window_share: float = WINDOW_SHARE) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found of every row for which ``is_query(id)`` holds."""
    valid = _valid(rows, id_col, vector_col)
    lengths = valid.groupBy(F.size("e").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").limit(1).collect()
    length = lengths[0]["length"] if lengths else 1
    hashed = valid.filter(F.size("e") == length).select("vec_id", "e", *hash128(F.col("e"), "h1", "h2")) \
        .dropDuplicates(["vec_id", "h1", "h2"])
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    firsts = settled(hashed.withColumn("nth", nth).filter(F.col("nth") <= k + 1))
    reps = firsts.filter("nth = 1").select("h1", "h2", F.col("vec_id").alias("rep"), "e")
    n = reps.count()
    window = max(LEAST_WINDOW, int(np.ceil(window_share * n)))
    centre, spread = _centre(reps, length)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = np.array(f["e"].tolist(), float).reshape(-1, length)
            for c in range(CURVES):
                yield pd.DataFrame({"curve": c, "key": curve_keys(v, centre, spread, c), "h1": f["h1"], "h2": f["h2"]})

    keys = reps.select("h1", "h2", "e").mapInPandas(keyed, "curve int, key binary, h1 long, h2 long")
    placed = running_total(keys.withColumn("one", F.lit(1)), "one", [F.col(c) for c in ("curve", "key", "h1", "h2")], rank="nth")
    at = (F.col("nth") - 1) % n
    spots = settled(placed.select("curve", at.alias("at"), "h1", "h2"))

    asked = hashed.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    wanted = settled(asked.select("h1", "h2").distinct().join(reps, ["h1", "h2"]).select("h1", "h2", F.col("rep").alias("q"), "e"))
    block = F.expr(f"at div {BLOCK}")
    low, high = F.expr(f"greatest(at - {window}, 0) div {BLOCK}"), F.expr(f"least(at + {window}, {max(n - 1, 0)}) div {BLOCK}")
    met = wanted.count() * min(1.0, (2 * window + BLOCK) / max(n, 1))  # queries that a block meets
    batches = int(met // QUERIES) + 1
    queries = (spots.join(wanted, ["h1", "h2"])
               .select(F.col("curve").alias("q_curve"), "q", F.col("at").alias("q_at"), F.col("e").alias("q_e"),
                       F.pmod(F.xxhash64("q"), F.lit(batches)).alias("q_batch"), F.explode(F.sequence(low, high)).alias("q_block")))
    members = spots.withColumn("block", block).join(reps, ["h1", "h2"]).select(
        "curve", "block", "rep", "at", "e", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"))

    def rerank(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(c) and len(q):
            ids, places, v = c["rep"].to_numpy(np.int64), c["at"].to_numpy(np.int64), np.array(c["e"].tolist(), float)
            for qid, place, e in zip(q["q"], q["q_at"], q["q_e"], strict=True):
                near = np.flatnonzero(np.abs(places - place) <= window)
                d = np.sqrt(((v[near] - np.asarray(e, float)) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], d))[:k + 1]
                out.append(pd.DataFrame({"q": qid, "rep": ids[near][best], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "rep": [], "score": []}).astype(
            {"q": "int64", "rep": "int64", "score": "float64"})

    found = members.groupBy("curve", "block", "batch").cogroup(queries.groupBy("q_curve", "q_block", "q_batch")).applyInPandas(
        rerank, "q long, rep long, score double").dropDuplicates(["q", "rep"])
    order = Window.partitionBy("q").orderBy("score", "rep")
    classes = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).select("q", "rep", "score")
    ids = firsts.select("h1", "h2", "vec_id").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "vec_id")
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    listed = classes.join(ids, "rep").withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1) \
        .select("q", "vec_id", "score")
    per_query = asked.join(reps.select("h1", "h2", F.col("rep").alias("q")), ["h1", "h2"]).select("query_id", "q")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (per_query.join(listed, "q").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(ranked))
            .filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
