"""Question parsing and answers on the star fixture against results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from salesspark.functions import matching
from salesspark.operators import questions as Q

# question: metric, dimension, region, category, channel, segment, quarter, year, month, recognised terms
PARSED = [
    ("Show revenue in the South region for Q1 2024",
     "Net_Revenue", None, "South", None, None, None, "Q1", 2024, None, ["Net_Revenue", "Region=South", "Quarter=Q1", "Year=2024"]),
    ("What is the return rate for the Online channel?",
     "Return_Rate", None, None, None, "Online", None, None, None, None, ["Return_Rate", "Channel=Online"]),
    ("profit by region in march", "Profit", "Region", None, None, None, None, None, None, 3, ["Profit", "Month=March"]),
    ("Top products by revenue in Widgets",
     "Net_Revenue", "Product", None, "Widgets", None, None, None, None, None, ["Net_Revenue", "Category=Widgets"]),
    ("How many orders did Enterprise customers place in 2024?",
     "Orders", None, None, None, None, "Enterprise", None, 2024, None, ["Orders", "Segment=Enterprise", "Year=2024"]),
    ("units per category", "Units", "Category", None, None, None, None, None, None, None, ["Units"]),
    ("returns by region", "Return_Rate", "Region", None, None, None, None, None, None, None, ["Return_Rate"]),
    ("maybe sales rep numbers for the north",
     "Net_Revenue", "Salesperson", "North", None, None, None, None, None, 5, ["Net_Revenue", "Region=North", "Month=May"]),
    ("top customer by profit in Q2", "Profit", "Customer", None, None, None, None, "Q2", None, None, ["Profit", "Quarter=Q2"]),
    ("nothing recognisable here", "Net_Revenue", None, None, None, None, None, None, None, None, []),
    ("revenue by salesperson for SMB in february 2024",
     "Net_Revenue", "Salesperson", None, None, None, "SMB", None, 2024, 2,
     ["Net_Revenue", "Segment=SMB", "Year=2024", "Month=February"]),
    ("order count each region q3 2031",
     "Orders", "Region", None, None, None, None, "Q3", 2031, None, ["Orders", "Quarter=Q3", "Year=2031"]),
]
# value, leader, sentence; the four lines are 180 and 90 (Alice, North, Widget A, January and March) and 150 and 405 (Bob, South,
# Widget B, February and March), all sold online by Sam in Q1 2024, one of them (90) returned
ANSWERS = [
    (555.0, None, "The net revenue for Region=South, Quarter=Q1, Year=2024 is **555**."),
    (25.0, None, "The return rate for Channel=Online is **25.00%**."),
    (165.0, "South", "Breakdown by Region for Month=3: **South** leads with Profit of 165."),
    (555.0, "Widget B", "Breakdown by Product for Category=Widgets: **Widget B** leads with Net Revenue of 555."),
    (2.0, None, "The total orders for Segment=Enterprise, Year=2024 is **2**."),
    (7.0, "Widgets", "Breakdown by Category for all data: **Widgets** leads with Units of 7."),
    (25.0, None, "The return rate for across all data is **25.00%**. (A per-Region breakdown isn't available for return rate, "
                 "so this is the overall figure.)"),
    (None, None, "No matching data was found for that question."),
    (None, None, "No matching data was found for that question."),
    (825.0, None, "The net revenue for across all data is **825**."),
    (150.0, "Sam", "Breakdown by Salesperson for Segment=SMB, Year=2024, Month=2: **Sam** leads with Net Revenue of 150."),
    (None, None, "No matching data was found for that question."),
]
VOCAB = [("Region", "North"), ("Region", "South"), ("Category", "Widgets"), ("Channel", "Online"),
         ("Segment", "Enterprise"), ("Segment", "SMB")]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PARSED)], "qid int, text string")
    return Q.parse_questions(df, spark.createDataFrame(VOCAB, "Field string, Value string"))


def test_parse(parsed):
    rows = {r["qid"]: r for r in parsed.collect()}
    assert len(rows) == len(PARSED)
    for i, (text, *want) in enumerate(PARSED):
        got = [rows[i][c] for c in ("Metric", "Dimension", "Region", "Category", "Channel", "Segment", "Quarter", "Year", "Month")]
        assert got + [list(rows[i]["Recognized_Terms"])] == want, text


def test_vocabulary_from_view(view):
    assert sorted(map(tuple, Q.vocabulary(view).collect())) == sorted(VOCAB)


def test_large_vocabulary_and_odd_texts(spark):
    vocab = spark.range(200_000).select(F.lit("Region").alias("Field"), F.concat(F.lit("Zone-"), F.col("id").cast("string")).alias("Value"))
    df = spark.createDataFrame([(0, "revenue in zone-199999 please"), (1, None), (2, ""), (3, "ZONE-70 and zone-7")],
                               "qid int, text string")
    got = {r["qid"]: r["Region"] for r in Q.parse_questions(df, vocab).collect()}
    assert got == {0: "Zone-1", 1: None, 2: None, 3: "Zone-7"}


@pytest.mark.parametrize("shard", [100_000, 50])
def test_matching_is_a_substring_search(spark, monkeypatch, shard):
    """Against a search value by value: nested, overlapping, equal and empty values, and a text of a million letters."""
    monkeypatch.setattr(matching, "SHARD", shard)
    rng = random.Random(4)
    values = [(f, "".join(rng.choice("abAB") for _ in range(rng.randint(1, 5)))) for f in ("x", "y") for _ in range(120)]
    values += [("x", None), ("z", "needle"), ("z", "Needless")]
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, "", "a" * 1_000_000 + "needless"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, low string")
    got = {r["i"]: (r["x"], r["y"], r["z"]) for r in matching.with_matches(
        df, "low", spark.createDataFrame(values, "Field string, Value string"), ["x", "y", "z"]).collect()}
    for i, t in enumerate(texts):
        want = [min((v for f, v in values if f == field and v is not None and t is not None and v.lower() in t), default=None) for field in "xyz"]
        assert got[i] == tuple(want), t
    empty = spark.createDataFrame([("x", "")], "Field string, Value string")
    assert [r["x"] for r in matching.with_matches(df.filter("i < 3"), "low", empty, ["x"]).collect()] == [""] * 3
    assert matching.with_matches(df, "low", empty.limit(0), ["x"]).filter("x IS NOT NULL").count() == 0


def test_answers(view, parsed):
    got = {r["qid"]: r for r in Q.answer_questions(parsed, view, ["qid"]).collect()}
    assert len(got) == len(ANSWERS)
    for i, (value, leader, text) in enumerate(ANSWERS):
        assert (got[i]["Answer"], got[i]["Leader"]) == (text, leader), PARSED[i][0]
        if value is not None:
            assert got[i]["Answer_Value"] == pytest.approx(value)


def test_question_bank_keeps_the_combinations_before_it_looks_for_the_smallest(spark):
    """The smallest of strings takes a sort, which must not be one of all lines."""
    rows = [("N", "S", 1997, "Q1", c, m) for c in ("HIGH", "LOW", None) for m in ("March", "January")] + [("N", "T", 1997, "Q2", None, None)]
    view = spark.createDataFrame(rows * 3, "Region string, Segment string, Year int, Quarter string, Channel string, Month_Name string")
    bank = Q.question_bank(view)
    plan = bank._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and plan.count("Aggregate") == 1
    assert {r["Question_ID"] for r in bank.collect()} == {"N|S|1997|Q1", "N|T|1997|Q2"}
