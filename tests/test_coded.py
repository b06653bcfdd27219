"""Lines with numbers for names: the same rows as the sales view, whatever keys repeat, are null or lead nowhere."""

from datetime import date

import pytest

from salesspark.operators import questions as Q
from salesspark.sources import coded as C
from salesspark.sources.tables import sales_view

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "ASIA"), (1, "EUROPE")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "INDIA", 0), (1, "FRANCE", 1), (2, "NOWHERE", None)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                 [(1, "Ann", 0, 0.0, "TOYS"), (2, "Ann", 1, 0.0, None), (3, None, 1, 0.0, "TOYS"), (3, "Zoe", 0, 0.0, "FOOD"), (None, "Bob", 0, 0.0, "FOOD")]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
                 [(1, "Sam", 0, 0.0), (1, "Tom", 0, 0.0), (1, None, 0, 0.0), (2, "Sam", 0, 0.0), (None, "Una", 0, 0.0)]),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
             [(1, "ring", "B1", "SMALL", 1, 10.0), (1, "ring", "B1", "SMALL", 1, 10.0), (2, None, "B1", "LARGE", 1, 10.0), (None, "bolt", "B2", "LARGE", 1, 1.0)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string",
               [(1, 1, "O", date(1997, 1, 5), "5-LOW"), (2, 2, "O", date(1997, 5, 5), "1-URGENT"), (2, 3, "F", date(1998, 5, 5), "5-LOW"),
                (3, 3, "O", date(1997, 1, 9), None), (4, 9, "O", date(1997, 1, 9), "2-HIGH"), (None, 1, "O", date(1997, 1, 9), "2-HIGH")]),
    "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
                 "l_tax double, l_returnflag string, l_linestatus string, l_shipdate date",
                 [(o, i, p, s, 2.0 + i, 100.0 * (i + 1), 0.1, 0.0, "RN"[i % 2], "O", date(1997, 2, 1))
                  for o in (1, 2, 3, 4, None) for i, (p, s) in enumerate([(1, 1), (1, 2), (2, 1), (2, 7), (2, None), (3, 1), (None, 1), (2, 1)])]),
}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("coded")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{place}/{name}.parquet")
    return str(place)


COLUMNS = sorted({*Q.ANSWER_COLUMNS, *Q.BANK_COLUMNS, "City", "Sub_Category", "Order_Line_ID"})


def test_same_rows_as_the_view(spark, sf_dir):
    names = C.line_names(spark, sf_dir)
    listed = sorted(map(tuple, names.collect()))
    assert [i for _, _, i in listed] == list(range(1, len(listed) + 1)) and {v for f, v, _ in listed if f == "Customer"} == {"Ann", "Bob", "Zoe"}
    name = {i: v for _, v, i in listed}
    with C.coded_lines(spark, sf_dir, COLUMNS, names) as lines:
        got = [tuple(name.get(r[c]) if c in C.NAMED else r[c] for c in COLUMNS) for r in lines.collect()]
        assert lines.columns == COLUMNS and lines.inputFiles()
    want = [tuple(r) for r in sales_view(spark, sf_dir, COLUMNS, keys_complete=True).collect()]
    assert len(want) > 30 and sorted(map(str, got)) == sorted(map(str, want))


def test_same_answers_as_from_the_view(spark, sf_dir):
    texts = ["top products by units in asia", "revenue by salesperson", "top customer by profit in 1997", "how many orders by customer",
             "orders by category in may", "return rate in europe", "units by product in q9", "profit by region", "orders for toys", "top products in small"]
    view = sales_view(spark, sf_dir, COLUMNS, keys_complete=True)
    parsed = Q.parse_questions(spark.createDataFrame(list(enumerate(texts)), "qid int, text string"), Q.vocabulary(view)).checkpoint()
    want = Q.answer_questions(parsed, view, ["qid"]).collect()
    names = C.line_names(spark, sf_dir)
    with C.coded_lines(spark, sf_dir, Q.ANSWER_COLUMNS, names) as lines:
        got = Q.answer_questions(parsed, lines, ["qid"], names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == len(texts)  # the files are gone by now
    assert {r["Leader"] for r in want} >= {None, "Ann", "LARGE", "ring #1"}
