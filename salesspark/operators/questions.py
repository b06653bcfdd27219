"""Plain-English questions, parsed and answered as one batch job.

Questions are a column of a DataFrame (e.g. every user turn of ``conversations``).
Parsing is a fixed set of column expressions (keyword tests, regex extraction).
Answering never runs one query per question: questions are reduced to their
filter masks (which of the seven filters they set - at most 2^7), the view is
reduced once and rolled up to each mask (``operators/rollup.py``), and questions join
their aggregate on (mask, filter values). Breakdown questions pick the leading group
with ``min_by`` - an aggregate that combines map-side, so a huge group never
lands in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesspark.functions.matching import with_matches
from salesspark.functions.scalars import fill_template
from salesspark.operators.metrics import distinct_values
from salesspark.operators.rollup import Grouping, rollups
from salesspark.session import ensure_checkpoint_dir, ship_package
from salesspark.schema import MONTH_NAMES
from salesspark.sources.coded import NAMED

# Metric keywords; the first metric (in this order) with a keyword in the text wins.
METRIC_KEYWORDS = {
    "Return_Rate": ["return rate", "returns", "returned"],
    "Net_Revenue": ["revenue", "sales", "sale"],
    "Profit": ["profit", "margin", "profitability"],
    "Orders": ["orders", "order count", "transactions"],
    "Units": ["units", "quantity", "volume"],
}
# Phrases that ask for a breakdown, checked in this order.
DIMENSION_PHRASES = {
    "Region": ["by region", "per region", "across regions", "each region"],
    "Category": ["by category", "per category", "each category"],
    "Product": ["by product", "per product", "top product"],
    "Customer": ["by customer", "top customer"],
    "Salesperson": ["by salesperson", "sales rep", "each rep"],
}
# How KPI answers name each metric (KPI field, label, is a percentage).
KPI_ANSWER = {
    "Net_Revenue": ("total_revenue", "net revenue", False),
    "Profit": ("total_profit", "total profit", False),
    "Orders": ("total_orders", "total orders", False),
    "Units": ("total_line_items", "total line items", False),
    "Return_Rate": ("return_rate_pct", "return rate", True),
}
BREAKDOWN_METRICS = ("Net_Revenue", "Profit", "Orders", "Units")
#: What KPI answers are made of, and its type.
KPI_TOTALS = {"Net_Revenue": "double", "Profit": "double", "Orders": "double", "_lines": "long", "_returned": "long"}
# The answer sentences and what they say where no filter is set.
KPI_ANSWER_TEXT = "The {label} for {filters} is **{value}**.{note}"
KPI_DROPPED_NOTE = " (A per-{dimension} breakdown isn't available for {label}, so this is the overall figure.)"
BREAKDOWN_ANSWER_TEXT = "Breakdown by {dimension} for {filters}: **{leader}** leads with {metric} of {value}."
NO_DATA_ANSWER = "No matching data was found for that question."
NO_FILTER_KPI = "across all data"
NO_FILTER_BREAKDOWN = "all data"
# Word boundaries as in Python's Unicode ``\b``: letters, digits and '_' are word characters.
_NOT_WORD = r"[^\p{L}\p{N}_]"
QUARTER_PATTERN = rf"(?:^|{_NOT_WORD})q([1-4])(?:{_NOT_WORD}|$)"
YEAR_PATTERN = rf"(?:^|{_NOT_WORD})(20[0-9]{{2}})(?:{_NOT_WORD}|$)"

VOCAB_FIELDS = ("Region", "Category", "Channel", "Segment")
FILTER_FIELDS = ("Region", "Category", "Channel", "Segment", "Quarter", "Year", "Month")
ANSWER_COLUMNS = list(FILTER_FIELDS) + ["Product", "Customer", "Salesperson", "Net_Revenue", "Profit_Amount",
                                        "Order_ID", "Quantity", "Is_Returned"]


def vocabulary(frames: DataFrame | list[DataFrame]) -> DataFrame:
    """Field and Value: the distinct values of the four recognised dimensions (the dropdown lists), of the view or of frames that have
    them between them."""
    return distinct_values(frames, list(VOCAB_FIELDS)).withColumnRenamed("Filter", "Field")


def _any_contains(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _first_contained(text: Column, values: list[str]) -> Column:
    """First value (in the given order) whose lower-case form occurs in ``text``."""
    if not values:
        return F.lit(None).cast("string")
    return F.get(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: text.contains(F.lower(v))), 0)


def parse_questions(questions: DataFrame, vocab: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds Metric, Dimension, the seven filter columns and Recognized_Terms (array); ``vocab`` has Field and Value."""
    ship_package(questions.sparkSession)  # the automaton runs on the executors
    questions = with_matches(questions.withColumn("_low", F.lower(F.col(text_col))), "_low", vocab, list(VOCAB_FIELDS))
    low = F.col("_low")
    metric_hit = None
    for metric, words in METRIC_KEYWORDS.items():
        cond = _any_contains(low, words)
        metric_hit = F.when(cond, F.lit(metric)) if metric_hit is None else metric_hit.when(cond, F.lit(metric))
    dimension = None
    for dim, words in DIMENSION_PHRASES.items():
        cond = _any_contains(low, words)
        dimension = F.when(cond, F.lit(dim)) if dimension is None else dimension.when(cond, F.lit(dim))
    quarter = F.regexp_extract(low, QUARTER_PATTERN, 1)
    year = F.regexp_extract(low, YEAR_PATTERN, 1)
    month_names = [m.lower() for m in MONTH_NAMES]
    month_hit = _first_contained(low, month_names)
    month = F.array_position(F.array(*[F.lit(m) for m in month_names]), month_hit).cast("int")

    parsed = questions.select(
        "*",
        metric_hit.alias("_metric_hit"),
        dimension.alias("Dimension"),
        F.when(quarter != "", F.concat(F.lit("Q"), quarter)).alias("Quarter"),
        F.when(year != "", year.cast("int")).alias("Year"),
        F.when(month_hit.isNotNull(), month).alias("Month"),
        F.initcap(month_hit).alias("_month_title"),
    )
    terms = F.array_compact(F.array(
        F.col("_metric_hit"),
        *[F.concat(F.lit(f + "="), F.col(f)) for f in VOCAB_FIELDS],
        F.concat(F.lit("Quarter="), F.col("Quarter")),
        F.concat(F.lit("Year="), F.col("Year").cast("string")),
        F.concat(F.lit("Month="), F.col("_month_title")),
    ))
    return (parsed.withColumn("Metric", F.coalesce(F.col("_metric_hit"), F.lit("Net_Revenue")))
            .withColumn("Recognized_Terms", terms)
            .drop("_metric_hit", "_month_title", "_low"))


def _mask(cols) -> Column:
    """Bit per filter (first filter = most significant), 1 when the filter is absent -
    the same layout as Spark's ``grouping_id()``."""
    n = len(cols)
    return reduce(lambda a, b: a + b,
                  [F.when(F.col(c).isNull(), F.lit(1 << (n - 1 - i))).otherwise(F.lit(0)) for i, c in enumerate(cols)])


def _filter_description(default: str) -> Column:
    parts = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f + "="), F.col(f).cast("string"))) for f in FILTER_FIELDS]
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def _join_keys(q: DataFrame, agg: DataFrame) -> Column:
    cond = q["_gid"] == agg["_gid"]
    for c in FILTER_FIELDS:
        cond = cond & q[c].eqNullSafe(agg[c])
    return cond


def answer_questions(parsed: DataFrame, view: DataFrame, key_cols: list[str], names: DataFrame | None = None) -> DataFrame:
    """(key columns, Metric, Dimension, Answer_Value, Leader, Answer) for every parsed question.

    Every KPI mask and every (mask, dimension) pair present is one grouping of ``rollup.rollups``, which counts distinct orders exactly without a
    copy of a line per grouping and reads some columns of the view a few times. Of a breakdown's groups only the leaders stay. With ``names`` the
    view has numbers for the names of products, customers and salespeople (``sources.coded``).
    """
    breakdown = F.col("Dimension").isNotNull() & F.col("Metric").isin(*BREAKDOWN_METRICS)
    # The question table is read twice (to plan the grouping sets, then to join the answers):
    # checkpoint it once instead of re-deriving it from its sources.
    ensure_checkpoint_dir(parsed.sparkSession)
    q = parsed.select(*key_cols, "Metric", "Dimension", *FILTER_FIELDS, _mask(FILTER_FIELDS).alias("_mask"),
                      F.when(breakdown, F.col("Dimension")).alias("_bd")).checkpoint(eager=True)
    # Filter masks and (mask, dimension) pairs present: at most 128 and 640 values.
    plan_rows = q.select("_mask", "_bd").distinct().collect()
    dims = sorted({r["_bd"] for r in plan_rows if r["_bd"] is not None})
    d = len(dims)
    dv = {dim: f"_dv{i}" for i, dim in enumerate(dims)}
    n = len(FILTER_FIELDS)

    def gid(mask: int, dim: str | None) -> int:
        absent = sum(1 << (d - 1 - i) for i, x in enumerate(dims) if x != dim)
        return (mask << d) | absent

    groupings, dim_of = {}, {}
    for r in plan_rows:
        cols = [c for i, c in enumerate(FILTER_FIELDS) if not (r["_mask"] >> (n - 1 - i)) & 1]
        g = gid(r["_mask"], r["_bd"])
        dim_of[g] = r["_bd"]
        groupings[g] = Grouping(g, (*cols, *([dv[r["_bd"]]] if r["_bd"] is not None else [])))
    gid_of_question = F.col("_mask") * F.lit(1 << d) + F.coalesce(
        *[F.when(F.col("_bd") == dim, F.lit(gid(0, dim))) for dim in dims], F.lit(gid(0, None)))
    q = q.withColumn("_gid", gid_of_question)

    coded = set(NAMED) if names is not None else set()
    widened = view.select(*FILTER_FIELDS, *[F.col(dim).cast("long" if dim in coded else "string").alias(dv[dim]) for dim in dims],
                          "Net_Revenue", "Profit_Amount", "Order_ID", "Quantity", "Is_Returned")
    if not groupings:  # no question, no answer
        groupings[gid((1 << n) - 1, None)] = Grouping(gid((1 << n) - 1, None), ())

    def wanted(groups: DataFrame, g: Grouping) -> DataFrame:
        """A mask's totals, or the leading group by each metric."""
        groups = groups.withColumns({m: F.col(m).cast("double") for m in BREAKDOWN_METRICS})
        by = ["_gid", *(c for c in groups.columns if c in FILTER_FIELDS)]
        dim = dim_of.get(g.name)
        if dim is None:
            return groups.select(*by, *KPI_TOTALS)
        key, lead = F.col(dv[dim]), "_code_" if dim in coded else "_lead_"
        return groups.groupBy(*by).agg(*[agg for m in BREAKDOWN_METRICS for agg in (
            F.min_by(key, F.struct(-F.col(m), key.isNotNull(), key)).alias(lead + m), F.max(m).alias("_top_" + m))])

    summed = rollups(widened, "Order_ID", list(groupings.values()), {
        "Net_Revenue": "Net_Revenue", "Profit": "Profit_Amount", "Units": "Quantity", "_lines": "1L", "_returned": "Is_Returned"}, reduced=wanted)
    kinds = {c: widened.schema[c].dataType for c in FILTER_FIELDS} | KPI_TOTALS | {
        prefix + m: kind for prefix, kind in (("_lead_", "string"), ("_code_", "long"), ("_top_", "double")) for m in BREAKDOWN_METRICS}
    groups = summed.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in summed.columns})
    is_bd = reduce(lambda a, b: a | b, [F.col("_gid").bitwiseAND(F.lit(1 << i)) == 0 for i in range(d)], F.lit(False))
    parts = []

    kpi_q = q.filter(F.col("_bd").isNull())
    kpis = groups.filter(~is_bd)
    joined = kpi_q.join(kpis, _join_keys(kpi_q, kpis), "left").select(
        kpi_q["*"], *[kpis[c] for c in ("Net_Revenue", "Profit", "Orders", "_lines", "_returned")])
    value = F.coalesce(
        F.when(F.col("Metric") == "Net_Revenue", F.col("Net_Revenue"))
        .when(F.col("Metric") == "Profit", F.col("Profit"))
        .when(F.col("Metric") == "Orders", F.col("Orders"))
        .when(F.col("Metric") == "Units", F.col("_lines").cast("double"))
        .otherwise(F.when(F.col("_lines") > 0, F.lit(100.0) * F.col("_returned") / F.col("_lines").cast("double"))),
        F.lit(0.0))
    label = F.coalesce(*[F.when(F.col("Metric") == m, F.lit(lbl)) for m, (_, lbl, _) in KPI_ANSWER.items()],
                       F.lit("net revenue"))
    value_text = F.when(F.col("Metric") == "Return_Rate",
                        F.concat(F.regexp_replace(F.format_number(value, 2), ",", ""), F.lit("%"))) \
        .otherwise(F.format_number(value, 0))
    note = F.when(F.col("Dimension").isNotNull(), fill_template(
        KPI_DROPPED_NOTE, dimension=F.col("Dimension"), label=label)).otherwise(F.lit(""))
    parts.append(joined.select(
        *key_cols, "Metric", "Dimension", value.alias("Answer_Value"), F.lit(None).cast("string").alias("Leader"),
        fill_template(KPI_ANSWER_TEXT, label=label, filters=_filter_description(NO_FILTER_KPI), value=value_text,
                      note=note).alias("Answer")))

    if dims:
        leaders = groups.filter(is_bd)
        bd_q = q.filter(F.col("_bd").isNotNull())
        joined = bd_q.join(leaders, _join_keys(bd_q, leaders), "left").select(
            bd_q["*"], *[leaders[c] for c in leaders.columns if c.startswith(("_lead_", "_code_", "_top_"))])
        found = F.col("_top_Net_Revenue").isNotNull()
        leader, code = (F.coalesce(*[F.when(F.col("Metric") == m, F.col(prefix + m)) for m in BREAKDOWN_METRICS]) for prefix in ("_lead_", "_code_"))
        if names is not None:
            joined = joined.withColumn("_code", code).checkpoint(eager=True)
            named = names.join(joined.select(F.col("_code").alias("_id")).distinct(), "_id").select("_id", F.col("Value").alias("_name"))
            joined = joined.join(named, F.col("_code") == F.col("_id"), "left")
            leader = F.coalesce(leader, F.col("_name"))
        value = F.coalesce(*[F.when(F.col("Metric") == m, F.col("_top_" + m)) for m in BREAKDOWN_METRICS])
        parts.append(joined.select(
            *key_cols, "Metric", "Dimension", value.alias("Answer_Value"), leader.alias("Leader"),
            F.when(~found, F.lit(NO_DATA_ANSWER)).otherwise(fill_template(
                BREAKDOWN_ANSWER_TEXT, dimension=F.col("Dimension"), filters=_filter_description(NO_FILTER_BREAKDOWN),
                leader=F.coalesce(leader, F.lit("None")), metric=F.regexp_replace(F.col("Metric"), "_", " "),
                value=F.format_number(value, 0))).alias("Answer")))
    return reduce(lambda a, b: a.unionByName(b), parts)


# Templates of the data-derived question bank.
QUESTION_TEMPLATES = [
    "Show revenue in the {Region} region for {Quarter} {Year}",
    "What is the return rate for the {Channel} channel in {Year}?",
    "profit by category for {Segment} customers in {Quarter}",
    "Top products by units in {Region} during {Month}",
    "How many orders did {Segment} customers place by region in {Year}?",
    "revenue by salesperson for the {Channel} channel",
    "top customer by profit in {Month} {Year}",
    "returns by region for {Segment} in {Quarter} {Year}",
]
BANK_COLUMNS = ["Region", "Segment", "Year", "Quarter", "Channel", "Month_Name"]


def question_bank(view: DataFrame) -> DataFrame:
    """One question per (Region, Segment, Year, Quarter) present in the data, worded by a
    template chosen from the combination (Question_ID, text).

    The smallest of strings is looked for among the different combinations, which are few and kept first: over the lines, Spark would sort
    all of a task's lines for it."""
    ensure_checkpoint_dir(view.sparkSession)
    combos = (view.select(*BANK_COLUMNS).distinct().checkpoint(eager=True).groupBy("Region", "Segment", "Year", "Quarter")
              .agg(F.min("Channel").alias("Channel"), F.min("Month_Name").alias("Month")))
    pick = (F.col("Year") * 7 + F.substring("Quarter", 2, 1).cast("int") * 3 + F.length("Region")
            + F.length("Segment")) % len(QUESTION_TEMPLATES)
    text = F.element_at(F.array(*[F.lit(t) for t in QUESTION_TEMPLATES]), pick + 1)
    for field in ("Region", "Segment", "Year", "Quarter", "Channel", "Month"):
        text = F.replace(text, F.lit("{" + field + "}"), F.col(field).cast("string"))
    qid = F.concat_ws("|", "Region", "Segment", F.col("Year").cast("string"), "Quarter")
    return combos.select(qid.alias("Question_ID"), text.alias("text"))
