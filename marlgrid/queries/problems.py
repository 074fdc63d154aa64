"""Queries of the general data problems: nearby points (p1) and broken references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgrid.operators.references import by_period, unresolved
from marlgrid.operators.spatial import near_join, near_joins
from marlgrid.session import table

#: Where the points of p1 may lie, and the two distances in metres.
LATITUDE, LONGITUDE = (-34.0, 6.0), (-74.0, -34.0)
ROW_RADIUS_M, ZIP_RADIUS_M = 8.0, 500.0
POINT = ("geolocation_row_id", "geolocation_lat", "geolocation_lng")
CENTROID = ("geolocation_zip_code_prefix", "latitude", "longitude")


def _places(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "olist_geolocation_dataset")
    return rows.where(F.col("geolocation_lat").between(*LATITUDE) & F.col("geolocation_lng").between(*LONGITUDE))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Rows near each row, and zip centroids near each row."""
    centroids = table(spark, base, "geo_zip_centroids")
    pairs = near_joins(_places(spark, base), POINT, [(None, None, ROW_RADIUS_M), (centroids, CENTROID, ZIP_RADIUS_M)])
    return pairs.select(F.col("left_id").alias("geolocation_row_id"), F.when(F.col("target") == 0, "row").otherwise("zip").alias("near_kind"), F.col("right_id").cast("bigint").alias("near_key"))


def p1_zip_load(spark: SparkSession, base: str) -> DataFrame:
    """How many rows lie within reach of each zip centroid."""
    pairs = near_join(_places(spark, base), table(spark, base, "geo_zip_centroids"), ZIP_RADIUS_M, left_cols=POINT, right_cols=CENTROID)
    return pairs.groupBy(F.col("right_id").cast("bigint").alias("zip")).agg(F.count(F.lit(1)).alias("rows_near"))


def _references(spark: SparkSession, base: str) -> DataFrame:
    """All four reference checks: table_name, field_name, row_key, loaded_at, reason."""
    orders, items = table(spark, base, "olist_orders_dataset"), table(spark, base, "olist_order_items_dataset")
    customers, products = table(spark, base, "olist_customers_dataset"), table(spark, base, "olist_products_dataset")
    traces, runs = table(spark, base, "trace_events"), table(spark, base, "runs")
    c, none = F.col, None
    item_key, trace_key = F.concat_ws(":", "order_id", "order_item_id"), F.concat_ws(":", "run_id", "sequence")
    checks = [
        ("olist_orders_dataset", "customer_id", orders, customers, "customer_id", c("order_id"), c("deleted_at")),
        ("olist_order_items_dataset", "order_id", items, orders, "order_id", item_key, none),
        ("olist_order_items_dataset", "product_id", items, products, "product_id", item_key, c("deleted_at")),
        ("trace_events", "run_id", traces, runs, "run_id", trace_key, c("deleted_at")),
    ]
    found = None
    for name, field, child, parent, key, row_key, deleted in checks:
        one = unresolved(
            child, parent, reference=c(field), row_key=row_key, parent_key=c(key), child_loaded=c("loaded_at"), parent_loaded=c("loaded_at"), parent_deleted=deleted
        ).select(F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), "row_key", "loaded_at", "reason")
        found = one if found is None else found.unionAll(one)
    return found


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Every unresolved reference, once."""
    return _references(spark, base).select("table_name", "field_name", "row_key", "reason").distinct()


def p6_by_month(spark: SparkSession, base: str) -> DataFrame:
    """Unresolved references per table, field, month of loading and reason."""
    return by_period(_references(spark, base), "table_name", "field_name")


def _reference_sql(select: str) -> str:
    def one(name, field, parent, key, row_key, deleted):
        gone = "max(deleted_at)" if deleted else "NULL::TIMESTAMP"
        all_gone = "count(deleted_at) = count(*)" if deleted else "FALSE"
        return f"""
        SELECT '{name}' AS table_name, '{field}' AS field_name, row_key, loaded_at, unnest(reasons) AS reason FROM (
          SELECT c.row_key, c.loaded_at, CASE WHEN p.k IS NULL THEN ['missing'] ELSE
            list_concat(CASE WHEN p.deleted <= c.loaded_at THEN ['deleted'] ELSE [] END, CASE WHEN p.loaded > c.loaded_at THEN ['late'] ELSE [] END) END AS reasons
          FROM (SELECT lower(trim({field})) AS k, {row_key} AS row_key, loaded_at FROM {name} WHERE {field} IS NOT NULL) c
          LEFT JOIN (SELECT lower(trim({key})) AS k, min(loaded_at) AS loaded, CASE WHEN {all_gone} THEN {gone} END AS deleted FROM {parent} WHERE {key} IS NOT NULL GROUP BY 1) p ON p.k = c.k)"""

    item, trace = "concat_ws(':', order_id, order_item_id)", "concat_ws(':', run_id, sequence)"
    parts = [
        one("olist_orders_dataset", "customer_id", "olist_customers_dataset", "customer_id", "order_id", True),
        one("olist_order_items_dataset", "order_id", "olist_orders_dataset", "order_id", item, False),
        one("olist_order_items_dataset", "product_id", "olist_products_dataset", "product_id", item, True),
        one("trace_events", "run_id", "runs", "run_id", trace, True),
    ]
    return f"WITH f AS ({' UNION ALL '.join(parts)}) {select}"


def _near_sql(tables: str, step: float, limit: float, extra: str, select: str) -> str:
    """Exact pairs by equal latitude steps; a great-circle test decides."""
    return f"""
    WITH g AS (SELECT geolocation_row_id AS id, geolocation_lat AS lat, geolocation_lng AS lng FROM olist_geolocation_dataset
               WHERE geolocation_lat BETWEEN -34 AND 6 AND geolocation_lng BETWEEN -74 AND -34),
         z AS (SELECT geolocation_zip_code_prefix AS id, latitude AS lat, longitude AS lng FROM geo_zip_centroids WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
         a AS (SELECT *, unnest([floor(lat / {step}) - 1, floor(lat / {step}), floor(lat / {step}) + 1]) AS k FROM g),
         b AS (SELECT *, floor(lat / {step}) AS k FROM {tables})
    {select} FROM a JOIN b ON a.k = b.k {extra}
    WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= {limit}"""


QUERIES = {"p1_found": p1_found, "p1_zip_load": p1_zip_load, "p6_found": p6_found, "p6_by_month": p6_by_month}

SQL = {
    "p1_found": "SELECT * FROM ("
    + _near_sql("g", 0.0001, ROW_RADIUS_M, "AND a.id < b.id", "SELECT a.id AS geolocation_row_id, 'row' AS near_kind, CAST(b.id AS BIGINT) AS near_key")
    + ") UNION ALL SELECT * FROM ("
    + _near_sql("z", 0.005, ZIP_RADIUS_M, "", "SELECT a.id AS geolocation_row_id, 'zip' AS near_kind, CAST(b.id AS BIGINT) AS near_key")
    + ")",
    "p1_zip_load": _near_sql("z", 0.005, ZIP_RADIUS_M, "", "SELECT CAST(b.id AS BIGINT) AS zip, count(*) AS rows_near") + " GROUP BY 1",
    "p6_found": _reference_sql("SELECT DISTINCT table_name, field_name, row_key, reason FROM f"),
    "p6_by_month": _reference_sql("SELECT table_name, field_name, strftime(loaded_at, '%Y-%m') AS month, reason, count(DISTINCT row_key) AS n_rows FROM f GROUP BY ALL"),
}
