"""Item-item cosine similarity over order baskets, top n per product.

``basket`` = distinct (order, product), taken from the lines once and kept. Co-occurrence counts come from a self-join on the order,
aggregated map-side per product pair; similarity is ``co / sqrt(n_a * n_b)``. A product goes through the shuffles of lines and pairs as its
place in name order, eight bytes that break ties as the name does; only the few best partners get their names back.

An order of m products has m^2 / 2 pairs. Its products are dealt by hash into tiles of about ``TILE``, and it is pairs of tiles that meet, so an
order with a third of all lines is many tasks by construction. Where there are such orders, the pairs of the others give each
product a score that its n-th partner reaches at least; a pair whose best thinkable score, ``min(n_a, n_b) / sqrt(n_a * n_b)``, is below that of
both its products is never made.

Products with fewer than n partners are topped up with zero-similarity products in name order, as the reference's nearest-neighbour search
returns n rows whenever n products exist.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesspark.plans.prefix import running_total
from salesspark.session import ensure_checkpoint_dir, small_tasks

BASKET_COLUMNS = ["Order_ID", "Product"]
#: Products of one tile of an order, on average at most.
TILE = 512


def _similarity(co: Column) -> Column:
    return co / F.sqrt(F.col("_na").cast("double") * F.col("_nb"))


def _pairs(rows: DataFrame, tiled: bool = True) -> DataFrame:
    """_p, _q (_p < _q by name), _na, _nb and Co_Orders from rows (Order_ID, Product, _n, _size, _least); not ``tiled``, the rows of an order
    meet where they lie, without a shuffle by tiles."""
    if not tiled:
        one, other = (rows.select("Order_ID", F.struct("Product", "_n").alias(side)) for side in "ab")
        return _counted(one.join(other, "Order_ID").filter(F.col("a.Product") < F.col("b.Product")), F.col("a"), F.col("b"))
    tiles = F.ceil(F.col("_size") / TILE)
    dealt = rows.withColumn("_tiles", tiles).withColumn("_tile", F.pmod(F.xxhash64("Product"), F.col("_tiles")))

    def side(name: str, own: str, other: str, others: Column) -> DataFrame:
        return dealt.select("Order_ID", F.col("_tile").alias(own), F.explode(others).alias(other),
                            F.struct("Product", "_n", "_least").alias(name))

    a = side("a", "_i", "_j", F.sequence(F.col("_tile"), F.col("_tiles") - 1))
    b = side("b", "_j", "_i", F.sequence(F.lit(0).cast("long"), F.col("_tile")))
    bound = F.least("a._n", "b._n") / F.sqrt(F.col("a._n").cast("double") * F.col("b._n"))
    met = a.join(b, ["Order_ID", "_i", "_j"]).filter(
        ((F.col("_i") < F.col("_j")) | (F.col("a.Product") < F.col("b.Product"))) & (bound >= F.least("a._least", "b._least")))
    swap = F.col("a.Product") > F.col("b.Product")
    low, high = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    return _counted(met, low, high)


def _counted(met: DataFrame, low: Column, high: Column) -> DataFrame:
    return met.select(low.alias("low"), high.alias("high")).groupBy(
        F.col("low.Product").alias("_p"), F.col("high.Product").alias("_q"), F.col("low._n").alias("_na"), F.col("high._n").alias("_nb")) \
        .agg(F.count(F.lit(1)).alias("Co_Orders"))


def _ranked(pairs: DataFrame, n: int) -> DataFrame:
    """Each product's n best partners: Product, Recommended_Product, Co_Orders, _sim, Rank."""
    scored = pairs.withColumn("_sim", _similarity(F.col("Co_Orders")))
    both = scored.select(F.inline(F.array(
        F.struct(F.col("_p").alias("Product"), F.col("_q").alias("Recommended_Product"), "Co_Orders", "_sim"),
        F.struct(F.col("_q").alias("Product"), F.col("_p").alias("Recommended_Product"), "Co_Orders", "_sim"))))
    w = Window.partitionBy("Product").orderBy(F.col("_sim").desc(), F.col("Recommended_Product").asc())
    return both.withColumn("Rank", F.row_number().over(w)).filter(F.col("Rank") <= int(n))


def copurchase_top(view: DataFrame, n: int = 5) -> DataFrame:
    """(Product, Rank, Recommended_Product, Co_Orders, Similarity_Score) for every product."""
    ensure_checkpoint_dir(view.sparkSession)
    products = _numbered(view)
    basket = _basket(view, products).checkpoint(eager=True)
    counts = basket.groupBy("Product").agg(F.count(F.lit(1)).alias("_n"))
    sizes = basket.groupBy("Order_ID").agg(F.count(F.lit(1)).alias("_size"))
    rows = basket.join(counts, "Product").join(sizes, "Order_ID").withColumn("_least", F.lit(0.0))
    largest = sizes.agg(F.max("_size")).first()[0] or 0
    if largest > TILE:
        rows = rows.drop("_least").checkpoint(eager=True)
        others = _ranked(_pairs(rows.filter(F.col("_size") <= TILE).withColumn("_least", F.lit(0.0))), n)
        least = others.filter(F.col("Rank") == int(n)).select("Product", F.col("_sim").alias("_least"))  # more orders only raise it
        rows = rows.join(least, "Product", "left").fillna(0.0, ["_least"])
    with small_tasks(view.sparkSession):  # a task makes all pairs of its orders
        best = _ranked(_pairs(rows, largest > TILE), n).checkpoint(eager=True)  # read for the answer and for what it lacks
    top = (best.withColumnsRenamed({"Product": "_p", "Recommended_Product": "_q"})
           .join(products.select(F.col("_id").alias("_p"), "Product"), "_p")
           .join(products.select(F.col("_id").alias("_q"), F.col("Product").alias("Recommended_Product")), "_q")
           .select("Product", "Rank", "Recommended_Product", "Co_Orders", "_sim"))
    filled = _fill_with_unrelated(products.select("Product"), top, n)
    return (top.unionByName(filled)
            .select("Product", "Rank", "Recommended_Product", "Co_Orders",
                    F.round(F.col("_sim"), 3).alias("Similarity_Score")))


def _numbered(view: DataFrame) -> DataFrame:
    """Every different Product and ``_id``, its place in name order."""
    names = view.select("Product").distinct().withColumn("_one", F.lit(1))
    return running_total(names, "_one", [F.col("Product").asc()], out="_upto", rank="_id").select("Product", "_id").checkpoint(eager=True)


def _basket(view: DataFrame, products: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The different (Order_ID, Product) with a product's ``_id`` for its name. A line meets its product by a hash of the name, or by the name
    itself if two products share a hash."""
    named = products.filter(F.col("Product").isNotNull())
    keyed = named.withColumn("_h", hashed(F.col("Product")))
    lines = view.select("Order_ID", "Product").filter(F.col("Product").isNotNull())
    if keyed.groupBy("_h").count().filter("count > 1").isEmpty():
        met = lines.select("Order_ID", hashed(F.col("Product")).alias("_h")).join(keyed.select("_h", "_id"), "_h")
    else:
        met = lines.join(named, "Product")
    return met.select("Order_ID", F.col("_id").alias("Product")).distinct()


def _fill_with_unrelated(products: DataFrame, top: DataFrame, n: int) -> DataFrame:
    """Zero-similarity fillers for products with fewer than n partners.

    A product with k < n partners needs n - k names outside itself and its
    partners; the first 2n names of the catalogue always contain that many, so the
    fan-out is bounded by 2n per short product (never all pairs).
    """
    first_names = [r[0] for r in products.orderBy("Product").limit(2 * int(n)).collect()]
    if not first_names:
        return top.limit(0)
    degree = top.groupBy("Product").agg(F.count(F.lit(1)).alias("_k"))
    short = (products.join(degree, "Product", "left").fillna(0, ["_k"]).filter(F.col("_k") < int(n)))
    candidates = (short.select("Product", "_k",
                               F.explode(F.array(*[F.lit(x) for x in first_names])).alias("Recommended_Product"))
                  .filter(F.col("Product") != F.col("Recommended_Product"))
                  .join(top.select("Product", "Recommended_Product"), ["Product", "Recommended_Product"], "left_anti"))
    w = Window.partitionBy("Product").orderBy("Recommended_Product")
    return (candidates.withColumn("_i", F.row_number().over(w))
            .filter(F.col("_i") <= F.lit(int(n)) - F.col("_k"))
            .select("Product", (F.col("_k") + F.col("_i")).cast("int").alias("Rank"), "Recommended_Product",
                    F.lit(0).cast("long").alias("Co_Orders"), F.lit(0.0).alias("_sim")))


def recommend(recommendations: DataFrame, product: str) -> DataFrame:
    """Rows for one product (empty for an unknown product)."""
    return (recommendations.filter(F.col("Product") == F.lit(product))
            .select("Rank", F.col("Recommended_Product").alias("Product"), "Similarity_Score")
            .orderBy("Rank"))
