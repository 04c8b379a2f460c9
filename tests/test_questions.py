"""Questions over a test table: SQL by hand gives the same rows; others are refused."""

import pytest

from tidewater.plans import console
from tidewater.plans.questions import understand

COLUMNS = ["order_id", "customer", "status", "total_price", "order_date", "city"]
ASKED = {
    "How many orders are there?": "SELECT count(*) FROM orders",
    "number of orders per status": "SELECT status, count(*) FROM orders GROUP BY status",
    "What is the average total price by city?": "SELECT city, avg(total_price) FROM orders GROUP BY city",
    "total total_price for each customer": "SELECT customer, sum(total_price) FROM orders GROUP BY customer",
    "highest total price in orders": "SELECT max(total_price) FROM orders",
    "show orders where status is open": "SELECT * FROM orders WHERE status = 'open'",
    "orders with total price over 50": "SELECT * FROM orders WHERE total_price > 50",
    "how many orders with total price between 20 and 60": "SELECT count(*) FROM orders WHERE total_price BETWEEN 20 AND 60",
    "how many orders have status open and city is 'New York'": "SELECT count(*) FROM orders WHERE city = 'New York' AND status = 'open'",
    "how many different customers are there": "SELECT count(DISTINCT customer) FROM orders",
    "orders where city is missing": "SELECT * FROM orders WHERE city IS NULL",
    "how many orders without city": "SELECT count(*) FROM orders WHERE city IS NULL",
    "show customer and city of orders where total price is at least 90": "SELECT customer, city FROM orders WHERE total_price >= 90",
    "top 3 orders by total price": "SELECT * FROM orders ORDER BY total_price DESC LIMIT 3",
    "bottom 2 orders by total price": "SELECT * FROM orders ORDER BY total_price LIMIT 2",
    "average total price and highest total price per status": "SELECT status, avg(total_price), max(total_price) FROM orders GROUP BY status",
    "how many orders with status other than open per city": "SELECT city, count(*) FROM orders WHERE status <> 'open' GROUP BY city",
    "customers starting with 'An'": None, "orders where customer starts with 'An'": "SELECT * FROM orders WHERE customer LIKE 'An%'",
    "latest order date by customer": "SELECT customer, max(order_date) FROM orders GROUP BY customer",
    "count orders by status and city": "SELECT status, city, count(*) FROM orders GROUP BY status, city",
    "how many orders where order date before '2024-03-01'": "SELECT count(*) FROM orders WHERE order_date < '2024-03-01'",
}


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(i, ["Anna", "Bo", "Andy"][i % 3], ["open", "closed"][i % 2], float(i * 7 % 101), f"2024-0{1 + i % 5}-10", [None, "Rome", "New York", "Oslo"][i % 4]) for i in range(40)]
    spark.createDataFrame(rows, "order_id int, customer string, status string, total_price double, order_date string, city string").createOrReplaceTempView("orders")
    return console.Console(spark)


def test_questions_give_the_rows_of_their_sql(spark, orders):
    for question, sql in ASKED.items():
        if sql is None:
            continue
        got = orders.run(orders.ask(question, {"orders": COLUMNS})).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, spark.sql(sql).collect()), key=str), question


@pytest.mark.parametrize("question", ["which orders will be late", "average weight of orders", "orders near Rome", "how many sheep", "top 5 orders", "predict total price", "why"])
def test_other_questions_are_refused(orders, question):
    assert understand(question, {"orders": COLUMNS}) is None
    with pytest.raises(ValueError, match="not understood"):
        orders.ask(question, {"orders": ["order_id", *COLUMNS[1:]]}) if "top" not in question else orders.ask(question + " by nothing", {"orders": COLUMNS})


def test_standard_looks_and_tables(orders):
    two = {"orders": COLUMNS, "stores": ["store_id", "city"]}
    assert understand("how many stores per city", two).sql() == "SELECT city, COUNT(*) AS row_count FROM stores GROUP BY city"
    assert understand("how many rows per city", two) is None  # of which table?
    assert "duplicate_count" in orders.ask("find duplicate rows in orders", two) and "null_count" in orders.ask("any missing values in orders", two)
    assert understand("how many orders where customer is 'O''Hara'", two).conditions == ["customer = 'O''Hara'"]
    told = orders.answer("how many orders per status", two)
    assert told["affected_tables"] == ["orders"] and not told["is_destructive"] and orders.recent() == ["how many orders per status"]
