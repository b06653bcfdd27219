"""Column lists and fixed vocabularies of the sales view."""

from __future__ import annotations

# Columns of the flattened order-line view, in view order.
VIEW_COLUMNS = [
    "Sales_Key", "Order_ID", "Order_Line_ID", "Order_Date", "Year", "Quarter", "Month", "Month_Name",
    "Region", "Country", "State", "City", "Product", "Category", "Sub_Category", "Unit_Cost",
    "Unit_Price", "Customer", "Segment", "Customer_Rating", "Customer_Key", "Salesperson",
    "Salesperson_Key", "Channel", "Quantity", "Sales_Amount", "Discount_Amount", "Cost_Amount",
    "Profit_Amount", "Shipping_Cost", "Net_Revenue", "Payment_Mode", "Is_Returned",
]

# The 14 filter names accepted by every operator (name -> view column).
FILTER_COLUMNS = {
    "Region": "Region", "Country": "Country", "State": "State", "City": "City",
    "Year": "Year", "Quarter": "Quarter", "Month": "Month",
    "Category": "Category", "Sub_Category": "Sub_Category",
    "Customer": "Customer", "Salesperson": "Salesperson", "Product": "Product",
    "Channel": "Channel", "Segment": "Segment",
}

# Selections that mean "no filter".
NO_FILTER_SENTINELS = (None, "All", "")

# Full month names, January first.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June",
               "July", "August", "September", "October", "November", "December"]

# Short month names, January first.
SHORT_MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
                     "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Metrics a breakdown can be ordered by.
BREAKDOWN_METRICS = ("Net_Revenue", "Profit", "Orders", "Units")
