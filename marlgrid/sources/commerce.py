"""A hand-checkable six-table shop, made in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Three customers, four orders; o1 has two items and two payments, o3 no review."""
    make = spark.createDataFrame
    return {
        "customers": make([("c1", "Ada", "BR"), ("c2", "Binh", "VN"), ("c3", "Chi", "VN")], "customer_id string, name string, country string"),
        "products": make([("p1", "books", 12.5), ("p2", "toys", 30.0), ("p3", "books", 7.25)], "product_id string, category string, unit_price double"),
        "orders": make([("o1", "c1", "2024-01-03", "delivered"), ("o2", "c2", "2024-01-09", "delivered"), ("o3", "c3", "2024-02-11", "canceled"), ("o4", "c1", "2024-03-02", "delivered")], "order_id string, customer_id string, ordered_at string, status string"),
        "order_items": make([("o1", 1, "p1", 12.5, 2.0), ("o1", 2, "p2", 30.0, 3.5), ("o2", 1, "p3", 7.25, 1.0), ("o3", 1, "p2", 30.0, 4.0), ("o4", 1, "p1", 12.5, 2.5)], "order_id string, item_number int, product_id string, price double, freight double"),
        "payments": make([("o1", 1, "card", 40.0), ("o1", 2, "voucher", 8.0), ("o2", 1, "card", 8.25), ("o3", 1, "card", 34.0), ("o4", 1, "boleto", 15.0)], "order_id string, sequence int, payment_type string, amount double"),
        "reviews": make([("r1", "o1", 5), ("r2", "o2", 3), ("r3", "o4", 4)], "review_id string, order_id string, score int"),
    }
