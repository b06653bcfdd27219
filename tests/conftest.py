import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from salesspark.session import get_session  # noqa: E402
from salesspark.sources.star import STAR_SCHEMAS, view_from_star  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"

# The star fixture that the expected results are worked out for, 4 order lines, 2 regions, 2 products, 2 customers.
DIM_DATE = [(1, "2024-01-05", 2024, "1", 1, "January"), (2, "2024-02-10", 2024, "1", 2, "February"),
            (3, "2024-03-15", 2024, "1", 3, "March"), (4, "2024-03-01", 2024, "1", 3, "March")]
DIM_REGION = [(1, "North", "India", "TN", "Chennai"), (2, "South", "India", "KA", "Bengaluru")]
DIM_PRODUCT = [(1, "Widget A", "Widgets", "Standard", 50.0, 100.0), (2, "Widget B", "Widgets", "Premium", 80.0, 150.0)]
DIM_CUSTOMER = [(1, "Alice", "Enterprise", 4.5), (2, "Bob", "SMB", 3.8)]
DIM_CHANNEL = [(1, "Online")]
DIM_SALESPERSON = [(1, "Sam")]
FACT_SALES = [
    (1, 1001, 1, 1, 1, 1, 1, 1, 1, 2.0, 200.0, 20.0, 100.0, 80.0, 5.0, "Card", 0),
    (2, 1002, 1, 2, 2, 2, 2, 1, 1, 1.0, 150.0, 0.0, 80.0, 70.0, 10.0, "Cash", 0),
    (3, 1003, 1, 3, 1, 1, 1, 1, 1, 1.0, 100.0, 10.0, 50.0, 40.0, 5.0, "Card", 1),
    (4, 1004, 1, 4, 2, 2, 2, 1, 1, 3.0, 450.0, 45.0, 240.0, 165.0, 15.0, "Card", 0),
]


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 8, driver_memory="4g")
    yield s


@pytest.fixture(scope="session")
def star(spark):
    rows = {"dim_date": DIM_DATE, "dim_region": DIM_REGION, "dim_product": DIM_PRODUCT,
            "dim_customer": DIM_CUSTOMER, "dim_channel": DIM_CHANNEL, "dim_salesperson": DIM_SALESPERSON,
            "fact_sales": FACT_SALES}
    return {name: spark.createDataFrame(data, STAR_SCHEMAS[name]) for name, data in rows.items()}


@pytest.fixture(scope="session")
def view(star):
    return view_from_star(star).cache()
