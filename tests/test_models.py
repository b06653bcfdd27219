"""Model contracts: labels, shapes, determinism, injected outliers (no accuracy thresholds)."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesspark.operators import anomaly as AN
from salesspark.operators import churn as CH
from salesspark.operators import forest as FO
from salesspark.operators import segments as SG


@pytest.fixture(scope="module")
def rfm_features(spark):
    rnd = random.Random(42)
    rows = []
    for i in range(4):  # good customers
        rows.append((i, f"Good{i}", "Enterprise", float(rnd.randint(0, 9)), rnd.randint(20, 39), float(rnd.randint(5000, 9999))))
    for i in range(4, 8):  # poor customers
        rows.append((i, f"Poor{i}", "SMB", float(rnd.randint(200, 399)), rnd.randint(1, 2), float(rnd.randint(50, 499))))
    return spark.createDataFrame(rows, "Customer_Key long, Customer string, Segment string, Recency_Days double, "
                                       "Frequency long, Monetary double")


def test_two_clusters_get_top_two_labels(rfm_features):
    seg = {r["Customer"]: r["RFM_Segment"] for r in SG.segment_customers(rfm_features, k=2).collect()}
    assert {seg[f"Good{i}"] for i in range(4)} == {"Champions"}
    assert {seg[f"Poor{i}"] for i in range(4, 8)} == {"Loyal Customers"}


def test_k_out_of_range(rfm_features):
    with pytest.raises(ValueError):
        SG.segment_customers(rfm_features, k=5)


def test_zscores_use_population_std(rfm_features):
    rows = SG.rfm_scores(rfm_features).collect()
    z = [r["Z_Frequency"] for r in rows]
    assert sum(z) == pytest.approx(0.0, abs=1e-9)
    assert sum(v * v for v in z) / len(z) == pytest.approx(1.0)


def test_segment_profile(rfm_features):
    prof = SG.segment_profile(SG.segment_customers(rfm_features, k=2)).collect()
    assert sum(r["Customers"] for r in prof) == 8


def test_segments_with_z_scores_in_the_thousands(spark, monkeypatch):
    rows = [(i, 0.01 * i, -0.02 * i, 0.01 * (i % 7), 0.0) for i in range(40)] + [(40, 0.5, 5000.0, 5000.0, 3333.5)]
    scored = spark.createDataFrame(rows, ["Customer_Key", *SG.Z, "Composite_Score"])
    monkeypatch.setattr(SG, "rfm_scores", lambda features: features)
    seg = {r["Customer_Key"]: r["Cluster"] for r in SG.segment_customers(scored, k=2).collect()}
    assert seg == {i: int(i < 40) for i in range(41)}


def test_nearest_centres_are_exact_at_any_distance():
    rng = np.random.default_rng(3)
    for scale in (10**6, 2 * 10**9, 10**12):
        x, centres = rng.integers(-scale, scale, (300, 3)), rng.integers(-scale, scale, (4, 3))
        x[0], centres[1] = centres[3], centres[3]
        at, d = SG._nearest(x, centres)
        for p, a, least in zip(x.tolist(), at, d, strict=True):
            whole = [sum((u - v) ** 2 for u, v in zip(p, c, strict=True)) for c in centres.tolist()]
            assert (whole.index(min(whole)), min(whole)) == (a, least)


def test_starts_are_drawn_by_squared_distance(spark):
    """Against plain loops: the running total in key order, the first customer beyond the draw."""
    rng = np.random.default_rng(3)
    rows = [(int(k), *map(int, rng.integers(-10**6, 10**6, 3))) for k in rng.permutation(200)]
    rows[5] = (rows[5][0], 4 * 10**12, 0, 0)  # squares far beyond 64 bits
    points = spark.createDataFrame(rows, "Customer_Key long, Z_Recency long, Z_Frequency long, Z_Monetary long")
    got = SG._starts(points, 4, 6, 42).tolist()
    for r in range(6):
        centres = [list(min(rows, key=lambda x: hashlib.md5(f"42|{r}|{x[0]}".encode()).hexdigest())[1:])]
        for step in (1, 2, 3):
            d = [(k, min(sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in centres), list(p)) for k, *p in sorted(rows)]
            left = (int(hashlib.md5(f"42|{r}|{step}".encode()).hexdigest()[:13], 16) * sum(x[1] for x in d)) >> 52
            for _, apart, p in d:
                if left < apart:
                    centres.append(p)
                    break
                left -= apart
        assert got[r] == centres


def test_starts_of_few_and_equal_customers(spark):
    schema = "Customer_Key long, Z_Recency long, Z_Frequency long, Z_Monetary long"
    assert SG._starts(spark.createDataFrame([(1, 1, 2, 3), (2, 4, 5, 6)], schema), 4, 3, 42).shape == (3, 2, 3)
    assert SG._starts(spark.createDataFrame([(k, 7, 7, 7) for k in range(9)], schema), 4, 2, 42).tolist() == [[[7, 7, 7]] * 4] * 2
    assert SG._starts(spark.createDataFrame([], schema), 4, 2, 42).size == 0


@pytest.fixture(scope="module")
def labeled(spark):
    rnd = random.Random(1)
    rows = []
    for c in range(400):
        churned = c % 2
        freq = rnd.randint(1, 3) if churned else rnd.randint(4, 12)
        rows.append((c, freq, freq * rnd.uniform(50, 150), rnd.uniform(50, 150), rnd.randint(0, 400),
                     rnd.uniform(1, 5), churned))
    return spark.createDataFrame(rows, "Customer_Key long, Frequency long, Monetary double, Avg_Order_Value double, "
                                       "Tenure_Days int, Customer_Rating double, Churned int")


def test_churn_model_contract(labeled):
    model = CH.train_churn(labeled, trees=20)
    m = model.metrics.collect()[0]
    assert 0 <= m["accuracy"] <= 1 and 0 <= m["roc_auc"] <= 1
    assert m["churn_rate_actual"] == pytest.approx(50.0)
    risk = CH.predict_risk(model, labeled)
    rows = risk.collect()
    assert len(rows) == 400
    probs = [r["Churn_Probability"] for r in rows]
    assert probs == sorted(probs, reverse=True) and len(set(probs)) > 2
    assert {r["Risk_Tier"] for r in rows} <= {"Low Risk", "Medium Risk", "High Risk"}
    imp = model.importance.collect()
    assert sorted(r["Feature"] for r in imp) == sorted(CH.FEATURES)
    assert sum(r["Importance"] for r in imp) == pytest.approx(1.0)


def test_roc_auc_counts_all_pairs(spark):
    rng = np.random.default_rng(2)
    score, label = rng.integers(0, 700, 5000), rng.integers(0, 2, 5000)
    got = CH.roc_auc(spark.createDataFrame(list(zip(score.tolist(), label.tolist(), strict=True)), "s long, y int"), "s", "y").first()[0]
    p, q = score[label == 1][:, None], score[label == 0][None, :]
    assert got == ((p > q).sum() * 2 + (p == q).sum()) / (2.0 * p.size * q.size)
    assert math.isnan(CH.roc_auc(spark.createDataFrame([(1, 1), (2, 1)], "s long, y int"), "s", "y").first()[0])


def test_bootstrap_draws_like_poisson():
    bounds = np.array(FO.poisson_bounds())
    draws = np.frombuffer(b"".join(FO.bootstrap(42, str(k), 200, bounds) for k in range(500)), np.uint8)
    assert abs(draws.mean() - 1) < 0.01 and abs((draws == 0).mean() - math.exp(-1)) < 0.01 and draws.max() < 10
    assert FO.bootstrap(42, "7", 200, bounds)[:5] == FO.bootstrap(42, "7", 5, bounds)


def test_forest_finds_the_splits(spark):
    """Two features that decide the class between them, one that says nothing, one constant; repeated values share a bin."""
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(0, 40)), float(rng.integers(0, 3)), float(rng.normal()), 1.0) for i in range(3000)]
    rows = [(*r, int(r[1] > 20 or r[2] == 2)) for r in rows]
    data = spark.createDataFrame(rows, "k long, a double, b double, c double, d double, y int")
    n1 = sum(r[-1] for r in rows)
    forest = FO.grow(data, ["a", "b", "c", "d"], "y", "k", (len(rows) - n1, n1), trees=30, depth=5, seed=1)
    again = FO.grow(data.repartition(3), ["a", "b", "c", "d"], "y", "k", (len(rows) - n1, n1), trees=30, depth=5, seed=1)
    assert forest == again  # whatever the partitions
    importance = dict(zip(forest.features, forest.importance(), strict=True))
    assert importance["a"] + importance["b"] > 0.9 and importance["d"] == 0.0
    scored = FO.summed_probability(data, forest, "s").collect()
    assert np.mean([(r["s"] * 2 > 30 * FO.UNIT) == (r["y"] == 1) for r in scored]) > 0.98
    for (t, n), node in forest.nodes.items():  # counts add up along every split
        if node.feature >= 0:
            left, right = forest.nodes[t, 2 * n], forest.nodes[t, 2 * n + 1]
            assert (node.c0, node.c1) == (left.c0 + right.c0, left.c1 + right.c1) and node.gain >= 0


def test_churn_needs_both_classes(labeled):
    with pytest.raises(ValueError):
        CH.train_churn(labeled.withColumn("Churned", F.lit(0)), trees=5)


@pytest.fixture(scope="module")
def lines(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        s = rnd.uniform(100, 1000)
        d = s * rnd.uniform(0, 0.1)
        q = float(rnd.randint(1, 10))
        rows.append((i, s, d, q, s - d - s * 0.6))
    for i in range(3000, 3010):  # injected outliers
        rows.append((i, 50000.0, 40000.0, 500.0, -60000.0))
    return spark.createDataFrame(rows, "Order_ID long, Sales_Amount double, Discount_Amount double, Quantity double, "
                                       "Profit_Amount double")


def test_isolation_forest_flags_outliers(lines):
    scored = AN.detect_anomalies(lines, contamination=0.02, trees=100, key="Order_ID")
    rows = scored.collect()
    flagged = {r["Order_ID"] for r in rows if r["Is_Anomaly"]}
    assert set(range(3000, 3010)) <= flagged
    scores = np.array([r["Anomaly_Score"] for r in rows])
    assert (scores < 0).sum() == (scores < np.quantile(scores, 0.02)).sum() and len(flagged) == 61
    again = {r["Order_ID"] for r in AN.detect_anomalies(lines, contamination=0.02, trees=100, key="Order_ID").collect() if r["Is_Anomaly"]}
    assert again == flagged


@pytest.mark.parametrize("copies", [AN.COPIES, 300])
def test_equal_lines_count_as_often_as_they_occur(spark, monkeypatch, copies):
    """100,000 lines of 50 different ones, with the queries' own kind of key, the MD5 of the line: every tree draws 256 lines, on average
    five copies of each value, not all or none of them; one value holds a third of the lines."""
    monkeypatch.setattr(AN, "COPIES", copies)
    value = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    lines = spark.range(100_000).select(*[(value * (i + 1)).cast("double").alias(c) for i, c in enumerate(AN.FEATURES)])
    lines = lines.withColumn("Sales_Key", F.md5(F.concat_ws("|", *AN.FEATURES)))
    distinct = AN.distinct_lines(lines.withColumnRenamed("Sales_Key", "_key")).checkpoint()
    assert distinct.count() == 50 and AN.numbered_lines(distinct).count() == 100_000
    drawn = AN.tree_samples(distinct, 100_000, 20, 42, 256)
    by_tree = {r["tree"]: (r["n"], r["values"], r["zeros"]) for r in drawn.groupBy("tree").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("Sales_Amount").alias("values"),
        F.sum((F.col("Sales_Amount") == 0).cast("int")).alias("zeros")).collect()}
    assert len(by_tree) == 20 and all(n == 256 and v > 35 and 50 < z < 130 for n, v, z in by_tree.values())
    nodes, psi = AN.fit_forest(distinct, 100_000, trees=20)
    roots = [n for n in nodes if n[1] == 1]
    assert psi == 256 and len(roots) == 20 and all(n[4] == 256 for n in roots)
    out = AN.detect_anomalies(lines, trees=20)
    assert out.count() == 100_000 and AN.anomaly_summary(AN.scored_lines(lines, trees=20)).first()["Lines"] == 100_000


def test_too_low_a_bound_is_raised(spark, monkeypatch):
    monkeypatch.setattr(AN, "draw_bound", lambda psi, lines: 40)
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("_key"), *[F.col("id").cast("double").alias(c) for c in AN.FEATURES])
    distinct = AN.distinct_lines(rows).checkpoint()
    low = sorted(map(tuple, AN.tree_samples(distinct, 20_000, 9, 1, 64).collect()))
    monkeypatch.undo()
    assert low == sorted(map(tuple, AN.tree_samples(distinct, 20_000, 9, 1, 64).collect())) and len(low) == 9 * 64


def test_exact_quantile(spark):
    values = [3.0, 1.0, 2.0, 2.0, 10.0, 7.0, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.0, 0.02, 0.25, 0.5, 0.9, 1.0):
        assert AN.exact_quantile(df, "v", q) == pytest.approx(float(np.quantile(values, q)))
    assert AN.exact_quantile(df.limit(0), "v", 0.5) is None


def test_average_path_length():
    c = AN.average_path_length(np.array([0, 1, 2, 256]))
    assert c[0] == 0 and c[1] == 0 and c[2] == 1
    assert c[3] == pytest.approx(2 * (np.log(255) + AN.EULER) - 2 * 255 / 256)


@pytest.mark.parametrize("cells", [AN.CELLS, 2_000, 0])
def test_look_ups_find_the_leaves_of_the_way_down(monkeypatch, cells):
    """For any line, on a split and beyond all of them too, and for trees that are too large for look-ups."""
    monkeypatch.setattr(AN, "CELLS", cells)
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 5, 3000), rng.exponential(size=3000), np.zeros(3000)])
    nodes = [n for t in range(12) for n in AN._grow(t, x[rng.choice(3000, 256, replace=False)], 42, 8)]
    nodes += [(12, 1, -1, 0.0, 256, 0)]  # a tree of equal lines has no split
    edges = np.array([n[3] for n in nodes if n[2] >= 0][:200])
    x = np.concatenate([x, np.column_stack([edges] * 4), [[np.inf] * 4, [-np.inf] * 4, [np.nan] * 4]])
    assert (AN._total_paths(x, *AN._lookups(nodes)) == AN._descend(x, AN._flatten(nodes))).all()
    assert len(AN._total_paths(x[:0], *AN._lookups(nodes))) == 0


@pytest.mark.parametrize("lines", [300, 20_000])
def test_draws_are_the_smallest_hashes(spark, lines):
    rows = spark.range(lines).select(F.col("id").alias("_key"), *[F.col("id").cast("double").alias(c) for c in AN.FEATURES])
    drawn = AN.tree_samples(AN.distinct_lines(rows).checkpoint(), lines, 9, 7, 64).collect()

    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()
    for tree in range(9):
        order = sorted(range(lines), key=lambda k: (md5(f"7|draw|{tree // 8}|{k}|1")[tree % 8 * 4:][:4], md5(f"7|{tree}|{k}|1")))
        assert sorted(r[1] for r in drawn if r["tree"] == tree) == sorted(map(float, order[:64]))


def test_lines_get_their_scores_without_a_join(lines):
    flagged = AN.detect_anomalies(lines, trees=10, key="Order_ID", flagged_only=True)
    assert "Join" not in flagged._jdf.queryExecution().toString()
    assert flagged.count() == 61
