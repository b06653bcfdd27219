"""Operator 12: exact top-k by inner product with a pivot table.

The components are whole numbers, floor(256 x). With M the largest length of a vector, each candidate x gets one more component
sqrt(M^2 - |x|^2), each query a zero there; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products are the smallest distances, and
those obey the triangle inequality. ``PIVOTS`` candidates, chosen far apart out of a sample of ``SAMPLE`` rows, give every row its
row of the pivot table, the distances to all of them. The largest difference between a query's and a row's distances is a lower bound of theirs.

Rows are range-partitioned by (nearest pivot, distance to it), so near rows stand together, and packed in chunks of ``CHUNK`` with the
least and largest distance to each pivot. The queries of a chunk are its batches (of ``BATCH``); their k-th best score within their own chunk is where
they start from. A batch meets the bounds of all chunks, in groups of about ``GROUP``, and goes on only to chunks that can hold a better row for
any of its queries. There the rows' bounds are ordered and evaluated in growing slices, until the next bound is beyond the k-th best: nothing that
could be among the k best, or tie with them, is left out, so the result is exact. Bounds are rounded towards keeping.

All is exact: products in double precision where no sum can pass 2**53, else in Python's integers; a score that no long holds is an error.

Defined results: vectors that are null or hold a null or non-finite component take no part; an empty vector scores 0. Shorter vectors count
as if zeros followed. Rows are told apart by their place, so a row that repeats an id is one more query and one more candidate. A
row without id is a candidate only, and stands after all ids where scores tie. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesspark.llm.common import settled

PIVOTS, SAMPLE, CHUNK, BATCH, GROUP = 48, 2048, 2048, 64, 256
SCALE = 256
#: Batches that meet one chunk in a task.
MEETINGS = 64
#: Share of the distances by which single precision may be wrong.
SLACK = 1e-6
EXACT = 2.0 ** 53


def _sound(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    e = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e")).filter(F.col("e").isNotNull())
    return own.filter(F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0)))))


class Space:
    """The whole-number vectors, their pivots and the distances to these."""

    def __init__(self, dims: int, most: float, largest: float, sample: list[list[float]], pivots: int):
        self.dims, self.m2 = dims, most * (1 + 1e-9)  # most: largest squared length
        self.kind = "<i2" if largest < 2 ** 15 else "<i4" if largest < 2 ** 31 else "<f8"
        self.exact = most < EXACT
        s = self.whole(sample)
        rest, chosen = np.full(len(s), np.inf), []
        for _ in range(min(pivots, len(s))):  # each pivot is the sampled row farthest from those before it
            at = int(np.argmax(rest)) if chosen else 0
            if rest[at] <= 0:
                break
            chosen.append(at)
            rest = np.minimum(rest, self._squared(s, s[at:at + 1])[:, 0])
        self.points = s[chosen]

    def whole(self, vectors: list[list[float]]) -> np.ndarray:
        out = np.zeros((len(vectors), self.dims))
        for i, v in enumerate(vectors):
            out[i, :len(v)] = v
        return np.floor(SCALE * out)

    def _raised(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.m2 - (x * x).sum(axis=1)))

    def _squared(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 2 * self.m2 - 2 * (x @ p.T + np.outer(self._raised(x), self._raised(p))))

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of candidates to the pivots."""
        return np.sqrt(self._squared(x, self.points)).astype("<f4")

    def asked_to_pivots(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to the pivots."""
        return np.sqrt(np.maximum(0.0, (q * q).sum(axis=1)[:, None] + self.m2 - 2 * (q @ self.points.T))).astype("<f4")

    def reach(self, q: np.ndarray, score: float) -> float:
        """The distance at which a candidate has this score; what lies farther scores less. A little more, for what rounding hides."""
        square = float(q @ q) + self.m2
        return np.sqrt(max(0.0, square - 2 * score) + 1e-12 * square) + SLACK * 4 * np.sqrt(square)

    def scores(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact:
            return x @ q
        exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
        if any(not -2 ** 63 <= s < 2 ** 63 for s in exact):
            raise OverflowError("an inner product does not fit a long")
        return np.array(exact, object)


def _best(scores: np.ndarray, ids: list[int | None], k: int) -> list[int]:
    """Places of the k largest scores, ties to smaller ids, missing ids last."""
    places = range(len(scores))
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least).tolist()
    return sorted(places, key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[:k]


def bounded_search(space: Space, x: np.ndarray, table: np.ndarray, ids: list[int | None], q: np.ndarray, to_pivots: np.ndarray, k: int,
                   least: float | None, skip: int = -1) -> tuple[list[tuple[int | None, int]], int]:
    """(id, score) of the k best rows of a chunk that reach the score ``least``, and how many rows were evaluated."""
    bounds = np.abs(table - to_pivots).max(axis=1) if table.shape[1] else np.zeros(len(table), "f4")
    if skip >= 0:
        bounds[skip] = np.inf
    reach = np.inf if least is None else space.reach(q, least)
    open_ = np.flatnonzero(bounds <= reach) if np.isfinite(reach) else np.flatnonzero(np.isfinite(bounds))
    order = open_[np.argsort(bounds[open_], kind="stable")]
    found_at, found, done, size = np.empty(0, np.int64), np.empty(0), 0, 16 * k
    while done < len(order) and bounds[order[done]] <= reach:
        part = order[done:done + size]
        done, size = done + len(part), 2 * size
        got = space.scores(x[part], q)
        both, at = np.concatenate([found, got]), np.concatenate([found_at, part])
        keep = _best(both, [ids[i] for i in at], k)
        found, found_at = both[keep], at[keep]
        if len(found) == k:
            reach = min(reach, space.reach(q, float(found[-1])))
    hits = [(ids[i], int(s)) for i, s in zip(found_at, found, strict=True) if least is None or s >= least]
    return hits, done


def _unpacked(space: Space, values: bytes) -> np.ndarray:
    return np.frombuffer(values, space.kind).reshape(-1, space.dims).astype(float)


def _table(space: Space, values: bytes) -> np.ndarray:
    return np.frombuffer(values, "<f4").reshape(-1, len(space.points))


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def top_k(rows: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          pivots: int = PIVOTS, chunk_rows: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products of every row for which ``is_query(id)`` holds, with all other rows."""
    spark = rows.sparkSession
    valid = _sound(rows, id_col, vector_col)
    floors = F.transform("e", lambda x: F.floor(x * SCALE).cast("double"))
    square = F.aggregate(floors, F.lit(0.0), lambda s, x: s + x * x)
    largest = F.aggregate(floors, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    size = valid.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("e")).alias("dims"), F.max(square).alias("most"), F.max(largest).alias("largest")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = [r["e"] for r in valid.orderBy(F.xxhash64("e", "vec_id")).select("e").limit(SAMPLE).collect()]
    space = Space(max(1, size["dims"]), size["most"], size["largest"], sample, pivots)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = space.whole(b["e"].to_pylist())
            d = space.to_pivots(x)
            home = d.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], b["asked"], pa.array(home), pa.array(d.min(axis=1)), pa.array([r.tobytes() for r in x.astype(space.kind)], pa.binary()),
                 pa.array([r.tobytes() for r in d], pa.binary())], ["vec_id", "asked", "home", "near", "x", "d"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = F.coalesce(is_query(F.col("vec_id")), F.lit(False)).alias("asked")
    order = ["home", "near", "mix"]
    placed = valid.select("vec_id", asked, "e").mapInArrow(tabled, "vec_id long, asked boolean, home int, near float, x binary, d binary") \
        .withColumn("mix", F.xxhash64("vec_id")).repartitionByRange(n, *order).sortWithinPartitions(*order).drop(*order)

    chunk_schema = "chunk long, ids array<long>, asked array<int>, x binary, d binary, low binary, high binary"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, part = 0, TaskContext.get().partitionId()
        waiting: list[dict] = []

        def whole() -> pa.RecordBatch:
            d = _table(space, b"".join(r["d"] for r in waiting))
            row = {"chunk": (part << 33) + nth, "ids": [r["vec_id"] for r in waiting], "asked": [i for i, r in enumerate(waiting) if r["asked"]],
                   "x": b"".join(r["x"] for r in waiting), "d": d.tobytes(), "low": d.min(axis=0).tobytes(), "high": d.max(axis=0).tobytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("asked", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("x", "d", "low", "high"))]))

        for batch in batches:
            for row in batch.to_pylist():
                waiting.append(row)
                if len(waiting) == chunk_rows:
                    yield whole()
                    waiting, nth = [], nth + 1
        if waiting:
            yield whole()

    chunks = settled(placed.mapInArrow(packed, chunk_schema))

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of a chunk with the k-th best score that they find in it."""
        schema = pa.schema([("batch", pa.int64()), ("home", pa.int64()), ("rows", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())),
                            ("x", pa.binary()), ("least", pa.list_(pa.float64()))])
        for c in _one_by_one(batches):
            x, d = _unpacked(space, c["x"]), _table(space, c["d"])
            for nth, at in enumerate(range(0, len(c["asked"]), BATCH)):
                own = c["asked"][at:at + BATCH]
                to_pivots, least = space.asked_to_pivots(x[own]), []
                for i, p in zip(own, to_pivots, strict=True):
                    hits, _ = bounded_search(space, x, d, c["ids"], x[i], p, k, None, skip=i)
                    least.append(float(np.nextafter(float(hits[-1][1]), -np.inf)) if len(hits) == k else None)
                yield pa.RecordBatch.from_pylist([{
                    "batch": c["chunk"] * (chunk_rows // BATCH + 1) + nth, "home": c["chunk"], "rows": own, "ids": [c["ids"][i] for i in own],
                    "x": x[own].astype(space.kind).tobytes(), "least": least}], schema)

    asked_rows = settled(chunks.filter(F.size("asked") > 0).select("chunk", "ids", "asked", "x", "d").mapInArrow(
        batched, "batch long, home long, rows array<int>, ids array<long>, x binary, least array<double>"))
    n_chunks, n_batches = chunks.count(), asked_rows.count()
    groups, spread = n_chunks // GROUP + 1, n_batches // MEETINGS + 1

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of a group that may hold better rows for a query of a batch."""
        for m in _one_by_one(batches):
            q = _unpacked(space, m["x"])
            to_pivots = space.asked_to_pivots(q)
            reach = np.array([np.inf if s is None else space.reach(v, s) for v, s in zip(q, m["least"], strict=True)])
            hit = []
            for c in m["bounds"]:
                low, high = _table(space, c["low"]), _table(space, c["high"])
                bound = np.maximum(low - to_pivots, to_pivots - high).max(axis=1, initial=0)
                if (bound <= reach).any():
                    hit.append(c["chunk"])
            yield pa.RecordBatch.from_arrays([pa.array([m["batch"]] * len(hit), pa.int64()), pa.array(hit, pa.int64())], ["batch", "chunk"])

    bounds = chunks.select(F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("g"), F.struct("chunk", "low", "high").alias("b")) \
        .groupBy("g").agg(F.collect_list("b").alias("bounds"))
    pairs = asked_rows.select("batch", "x", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g")) \
        .join(bounds, "g").select("batch", "x", "least", "bounds").mapInArrow(wanted, "batch long, chunk long")

    salt = F.pmod(F.xxhash64("batch"), F.lit(spread)).alias("salt")
    to_chunks = pairs.join(asked_rows, "batch").select(
        "chunk", salt, "batch", "home", "rows", "ids", "x", "least", F.lit(None).cast("binary").alias("d"))
    nothing = {"home": "long", "rows": "array<int>", "least": "array<double>"}
    copies = chunks.join(pairs.select("chunk", salt).distinct(), "chunk").select(
        "chunk", "salt", F.lit(None).cast("long").alias("batch"), "ids", "x", "d", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    meeting = to_chunks.unionByName(copies).repartition(n, "chunk", "salt").sortWithinPartitions("chunk", "salt", F.col("batch").asc_nulls_first())

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk, followed by the batches that meet it."""
        x = d = ids = None
        for r in _one_by_one(batches):
            if r["batch"] is None:
                x, d, ids = _unpacked(space, r["x"]), _table(space, r["d"]), r["ids"]
                continue
            q, out = _unpacked(space, r["x"]), []
            for i, qid, v, p, least in zip(r["rows"], r["ids"], q, space.asked_to_pivots(q), r["least"], strict=True):
                hits, _ = bounded_search(space, x, d, ids, v, p, k, least, skip=i if r["home"] == r["chunk"] else -1)
                out += [(r["home"], i, qid, vec_id, score) for vec_id, score in hits]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (
                pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["home", "row", "query_id", "vec_id", "score"])

    found = meeting.mapInArrow(searched, "home long, row int, query_id long, vec_id long, score long")
    best = Window.partitionBy("home", "row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
