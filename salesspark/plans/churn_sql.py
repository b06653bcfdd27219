"""The churn forest as chained DuckDB CTEs: bins, bootstrap, six levels of splits, then every customer's way down."""

from __future__ import annotations

from salesspark.operators.churn import FEATURES, RISK_TIERS
from salesspark.operators.forest import BINS, PER_HASH, UNIT, poisson_bounds

N = range(len(FEATURES))


def _weigh(c0: str, c1: str) -> str:
    a, b = f"(CAST({c0} AS DOUBLE) * CAST(n1 AS DOUBLE))", f"(CAST({c1} AS DOUBLE) * CAST(n0 AS DOUBLE))"
    return f"(({a} * {a} + {b} * {b}) / ({a} + {b}))"


def forest_ctes(trees: int = 200, depth: int = 6, seed: int = 42, subset: int = 2) -> list[str]:
    values = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS f{i}" for i, c in enumerate(FEATURES))
    fs, bs = ", ".join(f"f{i}" for i in N), ", ".join(f"b{i}" for i in N)
    draw = f"CAST('0x' || substr(md5('{seed}|boot|' || (tree // {PER_HASH}) || '|' || k), CAST(4 * (tree % {PER_HASH}) + 1 AS BIGINT), 4) AS BIGINT)"
    weight = " + ".join(f"CASE WHEN u >= {b} THEN 1 ELSE 0 END" for b in poisson_bounds())
    out = [f"every AS MATERIALIZED (SELECT CAST(Customer_Key AS VARCHAR) AS k, {values}, Churned AS y, Split FROM split)",
           "n AS MATERIALIZED (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE y = 0) AS n0, COUNT(*) FILTER (WHERE y = 1) AS n1 FROM every WHERE Split = 'train')",
           f"binned AS MATERIALIZED (SELECT k, y, {fs}, {', '.join(f'((RANK() OVER (ORDER BY f{i}) - 1) * {BINS}) // n AS b{i}' for i in N)} "
           "FROM every, n WHERE Split = 'train')",
           "edges AS MATERIALIZED (" + " UNION ALL ".join(
               f"SELECT {i} AS feature, b{i} AS bin, MIN(f{i}) AS low, MAX(f{i}) AS high FROM binned GROUP BY b{i}" for i in N) + ")",
           f"l0 AS MATERIALIZED (SELECT tree, 1 AS node, y, {bs}, {weight} AS w FROM "
           f"(SELECT t.tree, binned.*, {draw} AS u FROM binned, range(0, {trees}) AS t(tree)) d WHERE {weight} > 0)",
           "roots AS MATERIALIZED (SELECT tree, SUM(w) FILTER (WHERE y = 0) AS c0, SUM(w) FILTER (WHERE y = 1) AS c1 FROM l0 GROUP BY tree)",
           "root AS MATERIALIZED (SELECT tree, COALESCE(c0, 0) AS c0, COALESCE(c1, 0) AS c1 FROM roots)"]
    for d in range(depth):
        out += [f"""
h{d} AS MATERIALIZED (SELECT tree, node, feature, bin, COALESCE(SUM(w) FILTER (WHERE y = 0), 0) AS c0, COALESCE(SUM(w) FILTER (WHERE y = 1), 0) AS c1
  FROM (SELECT tree, node, y, w, unnest([{', '.join(map(str, N))}]) AS feature, unnest([{bs}]) AS bin FROM l{d}) x GROUP BY ALL)""", f"""
c{d} AS (SELECT tree, node, feature, bin, LEAD(bin) OVER o AS nxt, SUM(c0) OVER o AS l0, SUM(c1) OVER o AS l1,
    SUM(c0) OVER w AS c0, SUM(c1) OVER w AS c1 FROM h{d}
  WINDOW o AS (PARTITION BY tree, node, feature ORDER BY bin), w AS (PARTITION BY tree, node, feature))""", f"""
p{d} AS (SELECT *, {_weigh('l0', 'l1')} + {_weigh('c0 - l0', 'c1 - l1')} AS score FROM c{d}, n WHERE nxt IS NOT NULL AND c0 > 0 AND c1 > 0)""", f"""
q{d} AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tree, node ORDER BY md5('{seed}|feature|' || tree || '|' || node || '|' || feature)) AS nth
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tree, node, feature ORDER BY score DESC, bin) AS r FROM p{d}) x WHERE r = 1)""", f"""
s{d} AS MATERIALIZED (SELECT z.tree, z.node, z.feature, z.bin, z.l0, z.l1, z.c0, z.c1, (e.high + g.low) / 2.0 AS threshold,
    floor((score - {_weigh('z.c0', 'z.c1')}) / (CAST(root.c0 * n1 AS DOUBLE) + CAST(root.c1 * n0 AS DOUBLE)) * {float(UNIT)} + 0.5)::HUGEINT AS gain
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tree, node ORDER BY score DESC, feature) AS best FROM q{d} WHERE nth <= {subset}) z
  JOIN edges e ON e.feature = z.feature AND e.bin = z.bin JOIN edges g ON g.feature = z.feature AND g.bin = z.nxt
  JOIN root ON root.tree = z.tree WHERE best = 1)""", f"""
l{d + 1} AS MATERIALIZED (SELECT l.tree, 2 * l.node + CASE WHEN CASE s.feature {' '.join(f'WHEN {i} THEN b{i}' for i in N)} END > s.bin THEN 1 ELSE 0 END AS node,
  y, {bs}, w FROM l{d} l JOIN s{d} s ON l.tree = s.tree AND l.node = s.node)"""]
    every = " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(depth))
    share = f"CASE WHEN c0 + c1 = 0 THEN {UNIT // 2} ELSE floor(CAST(c1 * n0 AS DOUBLE) / (CAST(c0 * n1 AS DOUBLE) + CAST(c1 * n0 AS DOUBLE)) * {float(UNIT)} + 0.5) END"
    out += [f"splits AS MATERIALIZED ({every})", f"""
nodes AS MATERIALIZED (SELECT tree, node, CAST({share} AS HUGEINT) AS p FROM (
  SELECT tree, 1 AS node, c0, c1 FROM root UNION ALL SELECT tree, 2 * node, l0, l1 FROM splits
  UNION ALL SELECT tree, 2 * node + 1, c0 - l0, c1 - l1 FROM splits) x, n)""",
            f"w0 AS (SELECT k, y, Split, {fs}, t.tree, 1 AS node FROM every, range(0, {trees}) AS t(tree))"]
    for d in range(depth):
        value = f"CASE s.feature {' '.join(f'WHEN {i} THEN f{i}' for i in N)} END"
        out.append(f"w{d + 1} AS MATERIALIZED (SELECT k, y, Split, {fs}, w.tree, CASE WHEN s.node IS NULL THEN w.node ELSE 2 * w.node + "
                   f"CASE WHEN {value} > s.threshold THEN 1 ELSE 0 END END AS node FROM w{d} w LEFT JOIN splits s ON w.tree = s.tree AND w.node = s.node)")
    out.append(f"summed AS MATERIALIZED (SELECT k, y, Split, SUM(COALESCE(p, {UNIT // 2})) AS s FROM w{depth} w LEFT JOIN nodes ON nodes.tree = w.tree "
               "AND nodes.node = w.node GROUP BY k, y, Split)")
    tiers, low = "", -0.01
    for high, label in RISK_TIERS:
        tiers += f" WHEN p > {low} AND p <= {high} THEN '{label}'"
        low = high
    out.append(f"risk AS (SELECT *, CASE{tiers} END AS tier FROM (SELECT k, CAST(s AS DOUBLE) / {float(trees * UNIT)} AS p FROM summed) x)")
    return out


RISK = """SELECT churn.*, p AS Churn_Probability, tier AS Risk_Tier FROM churn JOIN risk ON k = CAST(Customer_Key AS VARCHAR)
ORDER BY p DESC, Customer_Key"""

METRICS = f"""
SELECT (tp + tn) / CAST(m AS DOUBLE) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
  (SELECT CAST(SUM(CASE WHEN a.s > b.s THEN 2 WHEN a.s = b.s THEN 1 ELSE 0 END) AS DOUBLE) / (2.0 * COUNT(*)) FROM summed a, summed b
   WHERE a.Split = 'test' AND b.Split = 'test' AND a.y = 1 AND b.y = 0) AS roc_auc, rate AS churn_rate_actual
FROM (SELECT COUNT(*) AS m, COUNT(*) FILTER (WHERE said AND y = 1) AS tp, COUNT(*) FILTER (WHERE said AND y = 0) AS fp,
        COUNT(*) FILTER (WHERE NOT said AND y = 1) AS fn, COUNT(*) FILTER (WHERE NOT said AND y = 0) AS tn
      FROM (SELECT y, s * 2 > {200 * UNIT} AS said FROM summed WHERE Split = 'test') t) c,
     (SELECT 100.0 * CAST(SUM(y) AS DOUBLE) / COUNT(*) AS rate FROM every) r"""

IMPORTANCE = f"""
SELECT name AS Feature, CAST(SUM(share) AS DOUBLE) / CAST((SUM(SUM(share)) OVER ()) AS DOUBLE) AS Importance
FROM (SELECT f.name, (COALESCE(g, 0) * {UNIT}) // total AS share
      FROM (SELECT tree, SUM(gain) AS total FROM splits GROUP BY tree HAVING SUM(gain) > 0) t
      CROSS JOIN (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(FEATURES))}) f(i, name)
      LEFT JOIN (SELECT tree, feature, SUM(gain) AS g FROM splits GROUP BY tree, feature) x ON x.tree = t.tree AND x.feature = f.i) y
GROUP BY name"""
