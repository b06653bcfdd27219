"""Groupings with exact distinct counts against plain Python, and their plan."""

import os
import random

import pytest

from pyspark.sql import functions as F

from salesspark import session
from salesspark.operators import rollup as R

SETS = [(), ("a",), ("b",), ("a", "b"), ("p",), ("a", "p"), ("a", "b", "p"), ("c", "a"), ("c",), ("m",), ("m", "a")]
GROUPINGS = [R.Grouping(i, s) for i, s in enumerate(SETS)]
MEASURES = {"total": "x", "rows": "1L"}


def lines_of(rng, orders=120):
    """``a``, ``b``, ``c`` belong to the order, ``p`` to the line; ``m`` belongs to the order but for one order. One order holds a third of the lines."""
    rows = []
    for o in range(orders):
        own = (rng.choice("uvw"), rng.choice(["k", None]), f"c{rng.randrange(60)}", rng.choice("mn"))
        for i in range(rng.randint(1, 5) if o else 150):
            rows.append((o if o != 7 else None, *own[:3], rng.choice(["p1", "p2", "p3", None]), own[3] if o != 5 else "mn"[i % 2], rng.randint(0, 9)))
    return rows


@pytest.mark.parametrize("share", [R.CUBE_SHARE, 0, 100])
def test_against_plain_python(spark, monkeypatch, share):
    monkeypatch.setattr(R, "CUBE_SHARE", share)
    rows = lines_of(random.Random(1))
    lines = spark.createDataFrame(rows, "o long, a string, b string, c string, p string, m string, x long")
    place = {c: i for i, c in enumerate("oabcpmx")}
    want = {}
    for g in GROUPINGS:
        for r in rows:
            key = (g.name, *(r[place[c]] if c in g.columns else None for c in "abcpm"))
            x, n, seen = want.setdefault(key, [0, 0, set()])
            want[key] = [x + r[6], n + 1, seen | ({r[0]} - {None})]
    got = R.rollups(lines, "o", GROUPINGS, MEASURES)
    assert {(r["_gid"], *(r[c] for c in "abcpm")): (r["total"], r["rows"], r["Orders"]) for r in got.collect()} == \
        {k: (x, n, len(seen)) for k, (x, n, seen) in want.items()}
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_which_columns_vary(spark):
    rows = lines_of(random.Random(2))
    lines = spark.createDataFrame(rows, "o long, a string, b string, c string, p string, m string, x long")
    varying, values, orders = R.varying_columns(lines, "o", list("abcpm"))
    assert varying == {"p", "m"} and values["a"] == 3 and orders == 120


def test_empty(spark):
    lines = spark.createDataFrame([], "o long, a string, b string, c string, p string, m string, x long")
    assert R.rollups(lines, "o", GROUPINGS[1:], MEASURES).count() == 0


def test_small_tasks_bound_what_a_task_reads_and_leave_the_session_as_it_was(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_SIZE", "1m")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before, rows = [spark.conf.get(k, None) for k in names], spark.range(500_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    with pytest.raises(ValueError), session.small_tasks(spark):
        assert rows.groupBy("k").count().checkpoint(eager=True).rdd.getNumPartitions() > 8
        raise ValueError
    assert [spark.conf.get(k, None) for k in names] == before


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in blocks.splitlines() if "/shuffle_" in f}


@pytest.mark.parametrize("reduced", [None, lambda groups, g: groups.groupBy("_gid").agg(F.max("total").alias("top"))])
def test_no_file_of_the_way_there_stays(spark, reduced):
    """Neither shuffle files nor kept rows: they would add up from grouping to grouping."""
    lines = spark.createDataFrame(lines_of(random.Random(3)), "o long, a string, b string, c string, p string, m string, x long")
    place, before = spark.sparkContext.getCheckpointDir().removeprefix("file:"), _shuffle_files(spark)
    got = R.rollups(lines, "o", GROUPINGS, MEASURES, **({"reduced": reduced} if reduced else {}))
    assert not _shuffle_files(spark) - before and not [f for f in os.listdir(place) if f.startswith("kept-")]
    assert got.select("_gid").distinct().count() == len(GROUPINGS)
    if reduced:
        whole = R.rollups(lines, "o", GROUPINGS, MEASURES).groupBy("_gid").agg(F.max("total"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_columns_that_the_first_guess_misses(spark, monkeypatch):
    lines = spark.createDataFrame(lines_of(random.Random(4)), "o long, a string, b string, c string, p string, m string, x long")
    want = R.rollups(lines, "o", GROUPINGS, MEASURES).select("_gid", *"abcpm", *MEASURES, "Orders").collect()
    monkeypatch.setattr(R, "GUESS_LINES", 1)
    got = R.rollups(lines, "o", GROUPINGS, MEASURES).select("_gid", *"abcpm", *MEASURES, "Orders").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
