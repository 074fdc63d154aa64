"""Semantic views: each at one grain, so that joining them multiplies nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.functions.dialect import days_between, moment

#: Where a coordinate of a zip centroid may lie.
LATITUDE, LONGITUDE = (-34.0, 6.0), (-74.0, -34.0)


def zip_centroids(geolocation: DataFrame) -> DataFrame:
    """Mean place and smallest labels per zip prefix, of coordinates within bounds."""
    inside = geolocation.where(F.col("geolocation_lat").between(*LATITUDE) & F.col("geolocation_lng").between(*LONGITUDE))
    return inside.groupBy("geolocation_zip_code_prefix").agg(
        F.avg("geolocation_lat").alias("latitude"),
        F.avg("geolocation_lng").alias("longitude"),
        F.min("geolocation_city").alias("representative_city"),
        F.min("geolocation_state").alias("representative_state"),
        F.count(F.lit(1)).alias("source_row_count"),
    )


def item_totals(items: DataFrame) -> DataFrame:
    """Items, revenue and freight per order."""
    return items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"), F.sum("price_cents").alias("product_revenue_cents"), F.sum("freight_value_cents").alias("freight_cents"))


def payment_totals(payments: DataFrame, order: str, kind: str, paid_cents) -> DataFrame:
    """Payment rows, distinct kinds and the sum paid per order."""
    return payments.groupBy(F.col(order).alias("order_id")).agg(F.count(F.lit(1)).alias("payment_row_count"), F.countDistinct(kind).alias("distinct_payment_type_count"), F.sum(paid_cents).alias("paid_value_cents"))


def review_summary(reviews: DataFrame, order: str, score: str) -> DataFrame:
    """Reviews and their mean, least and greatest score per order."""
    return reviews.groupBy(F.col(order).alias("order_id")).agg(
        F.count(F.lit(1)).alias("review_row_count"), F.avg(score).alias("average_review_score"), F.min(score).alias("minimum_review_score"), F.max(score).alias("maximum_review_score")
    )


def delivery_facts(orders: DataFrame) -> DataFrame:
    """Days to delivery and days late per order; null while there is no delivery."""
    bought, got, due = (moment(F.col(c)) for c in ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"))
    return orders.select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        F.when(got.isNotNull(), days_between(got, bought)).alias("delivery_days"),
        F.when(got.isNotNull(), days_between(got, due)).alias("delay_days"),
        F.when(got.isNotNull() & (got > due), 1).when(got.isNotNull(), 0).alias("is_late_delivered"),
    )


def customer_facts(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """First order and number of orders per person (not per customer record)."""
    return (
        customers.select("customer_id", "customer_unique_id")
        .join(orders.select("order_id", "customer_id", "order_purchase_timestamp"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(F.min("order_purchase_timestamp").alias("first_order_timestamp"), F.countDistinct("order_id").alias("order_count"))
    )


def products_named(products: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Products with readable columns and, where there is one, the translated category."""
    renamed = products.select(
        "product_id",
        "product_category_name",
        F.col("product_name_lenght").alias("product_name_length"),
        F.col("product_description_lenght").alias("product_description_length"),
        "product_photos_qty",
        "product_weight_g",
    )
    if names is None:
        return renamed.withColumn("product_category_name_english", F.lit(None).cast("string"))
    return renamed.join(names.select("product_category_name", "product_category_name_english"), "product_category_name", "left")
