"""Co-purchase cosine top-n against a brute-force numpy computation."""


import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesspark.operators import basket
from salesspark.operators.basket import copurchase_top, recommend

BASKETS = {1: ["A", "B", "C"], 2: ["A", "B"], 3: ["B", "C", "D"], 4: ["E"], 5: ["A", "A", "F"], 6: ["G", "H"]}


def brute(n, baskets=BASKETS):
    lines = [(o, p) for o, ps in baskets.items() for p in ps]
    products = sorted({p for _, p in lines})
    orders = sorted(baskets)
    m = np.zeros((len(products), len(orders)))
    for o, p in set(lines):
        m[products.index(p), orders.index(o)] = 1
    out = {}
    for i, a in enumerate(products):
        scores = []
        for j, b in enumerate(products):
            if i == j:
                continue
            co = float(m[i] @ m[j])
            scores.append((-(co / np.sqrt(m[i].sum() * m[j].sum())), b, co))
        partners = sorted(s for s in scores if s[2] > 0)
        fillers = sorted(b for s, b, co in scores if co == 0)
        ranked = [(b, co, round(-s, 3)) for s, b, co in partners] + [(b, 0.0, 0.0) for b in fillers]
        out[a] = ranked[:n]
    return out


@pytest.mark.parametrize("n", [1, 2, 5])
def test_copurchase_matches_brute_force(spark, n):
    view = spark.createDataFrame([(o, p) for o, ps in BASKETS.items() for p in ps], "Order_ID long, Product string")
    got = {}
    for r in copurchase_top(view, n).orderBy("Product", "Rank").collect():
        got.setdefault(r["Product"], []).append((r["Recommended_Product"], float(r["Co_Orders"]), r["Similarity_Score"]))
    want = brute(n)
    assert got == want
    for p, recs in got.items():
        assert len(recs) == min(n, len(want) - 1)


def test_recommend_unknown_product_is_empty(spark):
    view = spark.createDataFrame([(1, "A"), (1, "B")], "Order_ID long, Product string")
    recs = copurchase_top(view, 5)
    assert recommend(recs, "Nope").count() == 0
    assert [r["Product"] for r in recommend(recs, "A").collect()] == ["B"]


@pytest.mark.parametrize("tile", [512, 4, 1])
def test_hot_order_with_a_third_of_the_lines(spark, monkeypatch, tile):
    """Whole, or in tiles whose pairs are bounded by the scores of the other orders."""
    monkeypatch.setattr(basket, "TILE", tile)
    rnd = random.Random(11)
    products = [f"P{i:02d}" for i in range(30)]
    baskets = {o: rnd.sample(products, rnd.randint(1, 3)) for o in range(1, 41)}
    small_lines = sum(len(v) for v in baskets.values())
    baskets[0] = products[: max(2, small_lines // 2)]  # one order holds about a third of all lines
    view = spark.createDataFrame([(o, p) for o, ps in baskets.items() for p in ps], "Order_ID long, Product string")
    got = {}
    for r in copurchase_top(view, 5).orderBy("Product", "Rank").collect():
        got.setdefault(r["Product"], []).append((r["Recommended_Product"], float(r["Co_Orders"]), r["Similarity_Score"]))
    assert got == brute(5, baskets)


def test_tiles_of_a_giant_order_meet_once(spark, monkeypatch):
    """Each pair of an order is made once, whatever its tiles, and no task's share of a giant order grows with the square of its size."""
    monkeypatch.setattr(basket, "TILE", 10)
    rows = spark.range(300).select(F.lit(1).alias("Order_ID"), F.concat(F.lit("P"), F.col("id")).alias("Product"), F.lit(1).alias("_n"),
                                   F.lit(300).alias("_size"), F.lit(0.0).alias("_least"))
    pairs = basket._pairs(rows)
    assert pairs.count() == 300 * 299 // 2 and pairs.filter("Co_Orders <> 1 OR _p >= _q").count() == 0


def test_pairs_that_cannot_reach_a_score_are_not_made(spark):
    rows = spark.createDataFrame([(1, "A", 1, 3, 0.5), (1, "B", 100, 3, 0.5), (1, "C", 100, 3, 0.0)],
                                 "Order_ID int, Product string, _n int, _size int, _least double")
    assert {(r["_p"], r["_q"]) for r in basket._pairs(rows).collect()} == {("A", "C"), ("B", "C")}  # A with B reach 1 / sqrt(100) at most


def test_products_travel_as_their_place_in_name_order(spark):
    view = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "a"), (2, "c"), (2, None)], "Order_ID long, Product string")
    products = basket._numbered(view)
    places = {r["Product"]: r["_id"] for r in products.collect()}
    assert [p for p, _ in sorted(places.items(), key=lambda x: x[1])] == [None, "a", "b", "c"]
    want = {(1, places["a"]), (1, places["b"]), (None, places["a"]), (2, places["c"])}
    for hashed in (F.xxhash64, lambda c: F.length(c)):  # all names share this hash
        assert sorted(map(tuple, basket._basket(view, products, hashed).collect()), key=str) == sorted(want, key=str)


def test_pairs_without_tiles_are_the_same(spark):
    rows = spark.createDataFrame([(o, p, len(ps), 3, 0.0) for o, ps in BASKETS.items() for p in sorted(set(ps))],
                                 "Order_ID int, Product string, _n int, _size int, _least double")
    assert sorted(basket._pairs(rows, tiled=False).collect()) == sorted(basket._pairs(rows).collect())
