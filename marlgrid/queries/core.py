"""Queries of the relational, retrieval, governance and evaluation operators, with their SQL.

A query in ``STATED`` is one text that both engines run, or a pair where the two
dialects differ.  The others are built with the DataFrame API or with the
engine's own operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgrid import evaluation, linking, policy, quality, retrieval, trace, validation
from marlgrid.catalog import Catalog
from marlgrid.engine import Engine
from marlgrid.errors import EngineError
from marlgrid.functions import dialect
from marlgrid.plans import questions, views
from marlgrid.session import table
from marlgrid.sources.files import content_hash

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings olist_geolocation_dataset olist_customers_dataset "
    "olist_sellers_dataset olist_orders_dataset olist_order_items_dataset olist_products_dataset trace_events runs olist_acceptance_60"
).split()
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "olist_customers_dataset": ["customer_id"], "olist_sellers_dataset": ["seller_id"], "olist_orders_dataset": ["order_id"],
    "olist_order_items_dataset": ["order_id", "order_item_id"], "olist_products_dataset": ["product_id"], "runs": ["run_id"],
}
FOREIGN = {
    "nation": [(["n_regionkey"], "region", ["r_regionkey"])],
    "customer": [(["c_nationkey"], "nation", ["n_nationkey"])],
    "supplier": [(["s_nationkey"], "nation", ["n_nationkey"])],
    "orders": [(["o_custkey"], "customer", ["c_custkey"])],
    "lineitem": [(["l_orderkey"], "orders", ["o_orderkey"]), (["l_partkey"], "part", ["p_partkey"]), (["l_suppkey"], "supplier", ["s_suppkey"])],
    "events": [(["user_id"], "customer", ["c_custkey"])],
    "olist_orders_dataset": [(["customer_id"], "olist_customers_dataset", ["customer_id"])],
    "olist_order_items_dataset": [(["order_id"], "olist_orders_dataset", ["order_id"]), (["product_id"], "olist_products_dataset", ["product_id"]), (["seller_id"], "olist_sellers_dataset", ["seller_id"])],
    "trace_events": [(["run_id"], "runs", ["run_id"])],
}

# The views over the data; payments and reviews have no table here, so lines of an
# order and events of a user stand in for their shape.
VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "zip_centroids": lambda s, d: views.zip_centroids(table(s, d, "olist_geolocation_dataset")),
    "order_item_totals": lambda s, d: views.item_totals(table(s, d, "olist_order_items_dataset")),
    "order_payment_totals": lambda s, d: views.payment_totals(table(s, d, "lineitem"), "l_orderkey", "l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("bigint")),
    "order_review_summary": lambda s, d: views.review_summary(table(s, d, "events").withColumn("score", F.floor("value").cast("int")), "user_id", "score"),
    "order_delivery_facts": lambda s, d: views.delivery_facts(table(s, d, "olist_orders_dataset")),
    "customer_order_facts": lambda s, d: views.customer_facts(table(s, d, "olist_customers_dataset"), table(s, d, "olist_orders_dataset")),
    "products_semantic": lambda s, d: views.products_named(table(s, d, "olist_products_dataset"), table(s, d, "olist_products_dataset").groupBy("product_category_name").agg(F.upper(F.max("product_category_name")).alias("product_category_name_english")).where("product_category_name LIKE '%care'")),
}
MOMENT = "CAST(replace(regexp_replace({c}, 'Z$', ''), 'T', ' ') AS TIMESTAMP)"
BOUGHT, GOT, DUE = (MOMENT.format(c=c) for c in ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"))
VIEW_SQL = {
    "zip_centroids": "SELECT geolocation_zip_code_prefix, AVG(geolocation_lat) AS latitude, AVG(geolocation_lng) AS longitude, MIN(geolocation_city) AS representative_city, MIN(geolocation_state) AS representative_state, COUNT(*) AS source_row_count FROM olist_geolocation_dataset WHERE geolocation_lat BETWEEN -34.0 AND 6.0 AND geolocation_lng BETWEEN -74.0 AND -34.0 GROUP BY 1",
    "order_item_totals": "SELECT order_id, COUNT(*) AS item_count, CAST(SUM(price_cents) AS BIGINT) AS product_revenue_cents, CAST(SUM(freight_value_cents) AS BIGINT) AS freight_cents FROM olist_order_items_dataset GROUP BY order_id",
    "order_payment_totals": "SELECT l_orderkey AS order_id, COUNT(*) AS payment_row_count, COUNT(DISTINCT l_returnflag) AS distinct_payment_type_count, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS paid_value_cents FROM lineitem GROUP BY 1",
    "order_review_summary": "SELECT user_id AS order_id, COUNT(*) AS review_row_count, AVG(CAST(floor(value) AS INTEGER)) AS average_review_score, MIN(CAST(floor(value) AS INTEGER)) AS minimum_review_score, MAX(CAST(floor(value) AS INTEGER)) AS maximum_review_score FROM events GROUP BY 1",
    "order_delivery_facts": f"SELECT order_id, customer_id, order_status, order_purchase_timestamp, order_delivered_customer_date, order_estimated_delivery_date, (epoch_us({GOT}) - epoch_us({BOUGHT})) / 86400000000.0 AS delivery_days, (epoch_us({GOT}) - epoch_us({DUE})) / 86400000000.0 AS delay_days, CASE WHEN order_delivered_customer_date IS NOT NULL AND {GOT} > {DUE} THEN 1 WHEN order_delivered_customer_date IS NOT NULL THEN 0 END AS is_late_delivered FROM olist_orders_dataset",
    "customer_order_facts": "SELECT c.customer_unique_id, MIN(o.order_purchase_timestamp) AS first_order_timestamp, COUNT(DISTINCT o.order_id) AS order_count FROM olist_customers_dataset c JOIN olist_orders_dataset o ON o.customer_id = c.customer_id GROUP BY 1",
}

O, I, C, P = "olist_orders_dataset", "olist_order_items_dataset", "olist_customers_dataset", "olist_products_dataset"
STATED: dict[str, str | tuple[str, str]] = {
    "count_all": f"SELECT COUNT(*) AS n FROM {O}",
    "count_filter": f"SELECT COUNT(*) AS n FROM {O} WHERE order_status = 'canceled'",
    "project_alias": f"SELECT product_id, product_weight_g AS grams FROM {P} WHERE product_photos_qty > 1",
    "sum_cents": f"SELECT CAST(SUM(price_cents) AS BIGINT) AS revenue_cents FROM {I}",
    "two_metric_row": f"SELECT CAST(SUM(price_cents) AS BIGINT) AS revenue_cents, CAST(SUM(freight_value_cents) AS BIGINT) AS freight_cents FROM {I}",
    "count_distinct": f"SELECT COUNT(DISTINCT customer_unique_id) AS n FROM {C}",
    "avg_round": f"SELECT ROUND(AVG(product_weight_g), 2) AS mean_grams FROM {P} WHERE product_weight_g IS NOT NULL",
    "min_max": f"SELECT MIN(price_cents) AS least, MAX(price_cents) AS most FROM {I}",
    "group_count_ordered": f"SELECT order_status, COUNT(*) AS n FROM {O} GROUP BY order_status ORDER BY n DESC, order_status ASC",
    "group_year": f"SELECT SUBSTR(order_purchase_timestamp, 1, 4) AS year, COUNT(*) AS n FROM {O} GROUP BY year ORDER BY year",
    "group_month": f"SELECT SUBSTR(order_purchase_timestamp, 1, 7) AS month, COUNT(*) AS n FROM {O} GROUP BY 1 ORDER BY 1",
    "topk_tiebreak": f"SELECT c.customer_state, COUNT(*) AS n FROM {O} o JOIN {C} c ON c.customer_id = o.customer_id GROUP BY c.customer_state ORDER BY n DESC, c.customer_state ASC LIMIT 3",
    "topk_join_coalesce": f"SELECT COALESCE(p.product_category_name, 'unknown') AS category, CAST(SUM(i.price_cents) AS BIGINT) AS revenue_cents FROM {I} i LEFT JOIN {P} p ON p.product_id = i.product_id GROUP BY 1 ORDER BY revenue_cents DESC, category ASC LIMIT 5",
    "null_filter": f"SELECT COUNT(*) AS n FROM {P} WHERE product_category_name IS NULL",
    "not_null_filter": f"SELECT COUNT(*) AS n FROM {O} WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL",
    "conditional_rate": f"SELECT ROUND(100.0 * SUM(CASE WHEN order_status = 'canceled' THEN 1 ELSE 0 END) / COUNT(*), 4) AS rate FROM {O}",
    "having_count": f"SELECT COUNT(*) AS n FROM (SELECT order_id FROM {I} GROUP BY order_id HAVING COUNT(*) > 1) t",
    "dup_count": f"SELECT COUNT(*) - COUNT(DISTINCT order_id) AS n FROM {I}",
    "half_open_range": f"SELECT COUNT(*) AS n FROM {O} WHERE order_purchase_timestamp >= '2022-01-01' AND order_purchase_timestamp < '2023-01-01'",
    "in_list": f"SELECT order_status, COUNT(*) AS n FROM {O} WHERE order_status IN ('shipped', 'created', 'approved') GROUP BY order_status",
    "arithmetic": f"SELECT order_id, order_item_id, price_cents + freight_value_cents AS total_cents, 100.0 * freight_value_cents / (price_cents + freight_value_cents) AS freight_share FROM {I} WHERE price_cents > 50000",
    "inner_join": f"SELECT o.order_status, COUNT(*) AS n FROM {I} i JOIN {O} o ON o.order_id = i.order_id GROUP BY o.order_status",
    "left_join": f"SELECT i.order_id, i.order_item_id, p.product_category_name FROM {I} i LEFT JOIN {P} p ON p.product_id = i.product_id",
    "anti_join": f"SELECT COUNT(*) AS n FROM {O} o LEFT JOIN {I} i ON i.order_id = o.order_id WHERE i.order_id IS NULL",
    "semi_join_in": f"SELECT COUNT(*) AS n FROM {O} WHERE order_id IN (SELECT i.order_id FROM {I} i WHERE i.price_cents > 20000)",
    "exists_correlated": f"SELECT COUNT(*) AS n FROM {O} o WHERE EXISTS (SELECT 1 FROM {I} i WHERE i.order_id = o.order_id AND i.price_cents > 20000)",
    "not_exists_correlated": f"SELECT COUNT(*) AS n FROM {O} o WHERE NOT EXISTS (SELECT 1 FROM {I} i WHERE i.order_id = o.order_id)",
    "three_way_join": f"SELECT c.customer_state, p.product_category_name, COUNT(*) AS n FROM {I} i JOIN {O} o ON o.order_id = i.order_id JOIN {C} c ON c.customer_id = o.customer_id LEFT JOIN {P} p ON p.product_id = i.product_id GROUP BY 1, 2",
    "composite_key_join": f"SELECT COUNT(*) AS n FROM (SELECT DISTINCT order_id, order_item_id FROM {I}) a JOIN {I} b ON a.order_id = b.order_id AND a.order_item_id = b.order_item_id",
    "column_compare": "SELECT COUNT(*) AS n FROM order_item_totals t JOIN order_delivery_facts f ON f.order_id = t.order_id WHERE t.freight_cents > t.product_revenue_cents",
    "view_join": "SELECT f.order_status, COUNT(*) AS n, CAST(SUM(t.product_revenue_cents) AS BIGINT) AS revenue_cents FROM order_item_totals t JOIN order_delivery_facts f ON f.order_id = t.order_id GROUP BY f.order_status",
    "nested_aggregate": "SELECT ROUND(AVG(item_count), 4) AS mean_items, MAX(item_count) AS most_items FROM order_item_totals",
    "payment_kinds": "SELECT COUNT(*) AS n FROM order_payment_totals WHERE distinct_payment_type_count > 1",
    "review_counts": "SELECT COUNT(*) AS n FROM order_review_summary WHERE review_row_count > 1",
    "repeat_customers": "SELECT COUNT(*) AS n FROM customer_order_facts WHERE order_count > 1",
    "late_population": "SELECT COUNT(*) AS n, CAST(SUM(is_late_delivered) AS BIGINT) AS n_late FROM order_delivery_facts WHERE is_late_delivered IS NOT NULL",
    "delay_mean": "SELECT ROUND(AVG(delay_days), 4) AS mean_delay FROM order_delivery_facts WHERE delay_days > 0",
    "preagg_vs_fanout": f"SELECT CAST(SUM(t.product_revenue_cents) AS BIGINT) AS kept, (SELECT CAST(SUM(price_cents) AS BIGINT) FROM {I}) AS base FROM order_item_totals t",
    "scalar_subquery": f"SELECT COUNT(*) AS n FROM {I} WHERE price_cents > (SELECT AVG(price_cents) FROM {I})",
    "derived_table": f"SELECT MAX(n) AS most FROM (SELECT seller_id, COUNT(*) AS n FROM {I} GROUP BY seller_id) t",
    "cte": f"WITH big AS (SELECT order_id, SUM(price_cents) AS cents FROM {I} GROUP BY order_id) SELECT COUNT(*) AS n FROM big WHERE cents > 30000",
    "recursive_cte": "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT CAST(SUM(n) AS BIGINT) AS total, COUNT(*) AS steps FROM r",
    "union_distinct": f"SELECT customer_state AS state FROM {C} UNION SELECT seller_state FROM olist_sellers_dataset",
    "union_all": f"SELECT state, COUNT(*) AS n FROM (SELECT customer_state AS state FROM {C} UNION ALL SELECT seller_state FROM olist_sellers_dataset) t GROUP BY state",
    "intersect": f"SELECT customer_zip_code_prefix AS zip FROM {C} INTERSECT SELECT seller_zip_code_prefix FROM olist_sellers_dataset",
    "except": f"SELECT seller_zip_code_prefix AS zip FROM olist_sellers_dataset EXCEPT SELECT customer_zip_code_prefix FROM {C}",
    "select_distinct": f"SELECT DISTINCT order_status, SUBSTR(order_purchase_timestamp, 1, 4) AS year FROM {O}",
    "limit_offset": f"SELECT order_id FROM (SELECT DISTINCT order_id FROM {O}) t ORDER BY order_id LIMIT 7 OFFSET 5",
    "like_escape": (r"SELECT COUNT(*) AS n FROM documents WHERE text LIKE '%order\\_id%' ESCAPE '\\'", r"SELECT COUNT(*) AS n FROM documents WHERE text LIKE '%order\_id%' ESCAPE '\'"),
    "json_extract": ("SELECT get_json_object(config_json, '$.max_repairs') AS repairs, COUNT(*) AS n FROM runs GROUP BY 1", "SELECT config_json ->> '$.max_repairs' AS repairs, COUNT(*) AS n FROM runs GROUP BY 1"),
    "money_matches": ("SELECT COUNT(*) AS n FROM olist_order_items_dataset WHERE CAST(ROUND(CAST(price AS DECIMAL(18,2)) * 100) AS BIGINT) != price_cents", "SELECT COUNT(*) AS n FROM olist_order_items_dataset WHERE CAST(ROUND(CAST(price AS DECIMAL(18,2)) * 100) AS BIGINT) != price_cents"),
    "integer_division": ("SELECT order_id, order_item_id, price_cents DIV 100 AS whole FROM olist_order_items_dataset", "SELECT order_id, order_item_id, price_cents // 100 AS whole FROM olist_order_items_dataset"),
    "region_revenue": "SELECT r.r_name, CAST(SUM(CAST(ROUND(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue_cents FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name",
}
FLAGSHIP = "SELECT c.c_mktsegment AS segment, CAST(SUM(CAST(ROUND(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue_cents FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_mktsegment ORDER BY revenue_cents DESC, segment ASC LIMIT 5"


def _named(text: str, names) -> list[str]:
    words = set(re.findall(r"\w+", text))
    return [n for n in names if n in words]


def run_text(spark: SparkSession, base: str, text: str) -> DataFrame:
    """A query text over the data folder's tables and views."""
    for name in _named(text, TABLES):
        table(spark, base, name).createOrReplaceTempView(name)
    for name in _named(text, VIEWS):
        VIEWS[name](spark, base).createOrReplaceTempView(name)
    return spark.sql(text)


def with_views(text: str) -> str:
    """A DuckDB query with the views it names as common table expressions."""
    used = [f"{n} AS ({VIEW_SQL[n]})" for n in _named(text, VIEW_SQL)]
    if not used:
        return text
    return f"WITH {', '.join(used)} {text}"


def engine_over(spark: SparkSession, base: str, names=TABLES) -> Engine:
    engine = Engine(spark)
    engine.register("data", {n: table(spark, base, n) for n in names}, keys=KEYS, foreign=FOREIGN, domain="olist")
    return engine


def flagship(spark: SparkSession, base: str) -> DataFrame:
    """The top segments by revenue, through policy and default limit."""
    return engine_over(spark, base, ["customer", "orders", "lineitem"]).sql("data", FLAGSHIP)


# -- operators beyond one statement ------------------------------------------------------------

TERMS = ["late", "freight", "order", "order", "warehouse"]
TERM_TEXT = " ".join(TERMS)


def _bm25(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    return retrieval.bm25(docs, "doc_id", retrieval.ascii_tokens(F.col("text")), TERMS)


def bm25_topk(spark: SparkSession, base: str) -> DataFrame:
    scores = _bm25(spark, base).withColumn("score", F.round("score", 6))
    return retrieval.top(scores, "doc_id", 20)


def cosine_topk(spark: SparkSession, base: str) -> DataFrame:
    """For every fiftieth vector its ten nearest ones among all."""
    vectors = table(spark, base, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.nearest(vectors, "vec_id", "embedding", asked, 10).withColumn("score", F.round("score", 6))


def rrf_fusion(spark: SparkSession, base: str) -> DataFrame:
    lexical = bm25_topk(spark, base)
    longest = retrieval.top(table(spark, base, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id", 20)
    fused = retrieval.fuse({"bm25": lexical, "length": longest}, "doc_id")
    return fused.select("doc_id", F.round("score", 8).alias("score"), F.concat_ws(",", "sources").alias("sources"))


BOOSTED = "freight_value_cents by seller_state in olist_orders_dataset"


def identifier_boost(spark: SparkSession, base: str) -> DataFrame:
    docs = retrieval.document_frame(spark, engine_over(spark, base).catalog("data"))
    return retrieval.identifier_boost(docs, "document_id", ["table_name", "column_name"], BOOSTED).where("score > 0")


def token_estimate(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", dialect.token_estimate(F.coalesce("text", F.lit(""))).alias("size"))


def unicode_tokens(spark: SparkSession, base: str) -> DataFrame:
    """Most frequent folded words of the questions (accents need Python's Unicode tables)."""
    words = table(spark, base, "runs").select(F.explode(retrieval.token_column(F.col("question"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(50)


def _catalog(spark: SparkSession, base: str) -> Catalog:
    return engine_over(spark, base).catalog("data")


def catalog_rows(spark: SparkSession, base: str) -> DataFrame:
    return _catalog(spark, base).rows(spark)


def join_closure(spark: SparkSession, base: str) -> DataFrame:
    """Join paths that connect sellers, customers and products."""
    tables, joins = linking.closure(_catalog(spark, base), ["olist_sellers_dataset", "olist_products_dataset", "olist_customers_dataset"])
    return spark.createDataFrame([("table", t) for t in sorted(tables)] + [("join", j) for j in joins], "kind string, item string")


def schema_search(spark: SparkSession, base: str) -> DataFrame:
    engine = engine_over(spark, base)
    found = retrieval.search(spark, engine.catalog("data"), "product revenue by product_category_name and customer_state", k=10)
    return spark.createDataFrame([(d["document_id"], float(round(d["score"], 8)), ",".join(d["sources"])) for d in found], "document_id string, score double, sources string")


def route_intent(spark: SparkSession, base: str) -> DataFrame:
    asked = table(spark, base, "runs").select("question").unionAll(table(spark, base, "olist_acceptance_60").select("question"))
    return asked.groupBy(questions.route_column(F.col("question")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def accuracy_slices(spark: SparkSession, base: str) -> DataFrame:
    cases = table(spark, base, "olist_acceptance_60").withColumn("correct", F.col("gold_sql").isNotNull())
    return evaluation.accuracy(cases, ["partition", "language", "difficulty"])


def failure_counts(spark: SparkSession, base: str) -> DataFrame:
    cases = table(spark, base, "runs").withColumn("correct", F.col("status") == "COMPLETED")
    return evaluation.failures(cases, "status")


def schema_recall(spark: SparkSession, base: str) -> DataFrame:
    cases = table(spark, base, "olist_acceptance_60").select("id", F.coalesce("required_concepts", F.array().cast("array<string>")).alias("wanted"), F.coalesce("invariants", F.array().cast("array<string>")).alias("found"))
    return evaluation.macro(evaluation.recall(cases, "wanted", "found"))


def nearest_rank(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "olist_order_items_dataset")
    return rows.groupBy("seller_id").agg(*[evaluation.nearest_rank("price_cents", q).cast("bigint").alias(f"p{int(q * 100)}") for q in (0.5, 0.95)])


def multiset_equal(spark: SparkSession, base: str) -> DataFrame:
    """Rows that the stated view and the totals of delivered orders alone have more often than each other."""
    by_view = VIEWS["order_item_totals"](spark, base)
    by_sql = run_text(spark, base, VIEW_SQL["order_item_totals"].replace(" GROUP BY", " WHERE price_cents > 5000 GROUP BY"))
    return evaluation.multiset_difference(by_view, by_sql).groupBy("side").agg(F.sum(F.abs("surplus")).alias("n"))


def stratified_cases(spark: SparkSession, base: str) -> DataFrame:
    cases = table(spark, base, "olist_acceptance_60")
    return evaluation.stratified(cases, "difficulty", ["id"], 30).select("id", "difficulty")


def complexity_scores(spark: SparkSession, base: str) -> DataFrame:
    """Relations, joins and set operations of the stated queries, counted on their parsed plans."""
    rows = []
    for n, t in STATED.items():
        kinds = [policy._kind(x) for x in policy.once(policy.parse(spark, t if isinstance(t, str) else t[0]))]
        rows.append((n, kinds.count("UnresolvedRelation"), kinds.count("Join"), kinds.count("Union") + kinds.count("Intersect") + kinds.count("Except")))
    return spark.createDataFrame(rows, "query string, tables bigint, joins bigint, sets bigint")


def complexity_classes(spark: SparkSession, base: str) -> DataFrame:
    rows = [(n, *evaluation.complexity(spark, t if isinstance(t, str) else t[0])) for n, t in STATED.items()]
    return spark.createDataFrame(rows, "query string, score int, class string")


def quality_checks(spark: SparkSession, base: str) -> DataFrame:
    """The twenty checks; reviews and payments, which have no table here, on stand-ins of their shape."""
    names = ["olist_customers_dataset", "olist_geolocation_dataset", I, O, P, "olist_sellers_dataset", "trace_events", "runs", "lineitem"]
    t = {n: table(spark, base, n) for n in names}
    totals, paid = VIEWS["order_item_totals"](spark, base), VIEWS["order_payment_totals"](spark, base)
    reviews = table(spark, base, "events")  # an event of a user stands for a review of an order
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    whole = lambda df, c: df.agg(F.sum(c).alias("n"))
    known = _catalog(spark, base)
    lost = None
    for name, key in known.edges():
        if name.startswith("olist_") and len(key.columns) == 1:
            one = quality.orphans(table(spark, base, name), key.columns[0], table(spark, base, key.target), key.target_columns[0])
            lost = one if lost is None else lost.unionAll(one)
    broken = [n for n in names if not quality.readable(t[n])]
    return quality.suite(
        [
            quality.one("integrity_check", spark.range(1).select(F.lit(len(broken)).alias("n")), 0),
            quality.one("foreign_key_check", whole(lost, "n"), 0),
            *[quality.one(f"row_count:{n}", quality.count(t[n]), quality.count(t[n].distinct())) for n in names],
            quality.one("products_missing_category", quality.count(t[P].where("product_category_name IS NULL")), 0),
            quality.one("duplicate_review_id_occurrences", quality.duplicates(reviews, "event_id"), 0),
            quality.one("repeated_order_review_rows_beyond_first", quality.duplicates(reviews, "user_id"), 0),
            quality.one("orders_with_multiple_review_rows", quality.count(reviews.groupBy("user_id").count().where("count > 1")), 0),
            quality.one("item_revenue_preserved", whole(t[I], "price_cents"), whole(totals, "product_revenue_cents")),
            quality.one("freight_preserved", whole(t[I], "freight_value_cents"), whole(totals, "freight_cents")),
            quality.one("payment_preserved", t["lineitem"].agg(F.sum(cents).alias("n")), whole(paid, "paid_value_cents")),
            quality.one("geo_centroid_unique", quality.duplicates(table(spark, base, "geo_zip_centroids"), "geolocation_zip_code_prefix"), 0),
            quality.one("raw_money_matches_cents", quality.count(t[I].where((dialect.cents(F.col("price")) != F.col("price_cents")) | (dialect.cents(F.col("freight_value")) != F.col("freight_value_cents")))), 0),
        ]
    )


def correction_outcomes(spark: SparkSession, base: str) -> DataFrame:
    """Repairs of the stored runs, by trigger and stop reason: statuses and configurations stand for outcomes."""
    runs = table(spark, base, "runs")
    outcomes = runs.select(
        F.col("config_json").isNotNull().alias("attempted"), F.coalesce(F.col("status") == "COMPLETED", F.lit(False)).alias("recovered"),
        F.get_json_object("config_json", "$.max_repairs").cast("int").alias("repairs"), F.lit(1).alias("calls"), F.col("status").alias("trigger"), F.substring("created_at", 1, 4).alias("stop_reason"),
    )
    return evaluation.correction_metrics(outcomes)


def gold_schemas(spark: SparkSession, base: str) -> DataFrame:
    """Tables, columns, join edges and declared keys of three queries, from their analysed plans."""
    engine = engine_over(spark, base, [O, I, C])
    known, rows = engine.catalog("data"), []
    for name, sql in GOLD.items():
        for part, items in evaluation.gold_schema(engine.sql("data", sql, limit=False), known).items():
            rows += [(name, part, x) for x in items]
    return spark.createDataFrame(rows, "query string, part string, item string")


GOLD = {
    "one table": f"SELECT COUNT(*) AS n FROM {O} WHERE order_status = 'canceled'",
    "aliases": f"SELECT c.customer_state, SUM(i.price_cents) AS cents FROM {O} o JOIN {I} i ON i.order_id = o.order_id JOIN {C} c ON c.customer_id = o.customer_id GROUP BY c.customer_state",
    "derived": f"WITH late AS (SELECT o.order_id AS id FROM {O} o WHERE o.order_status = 'shipped') SELECT COUNT(*) AS n FROM late l JOIN {I} i ON i.order_id = l.id WHERE i.price_cents > 100",
}


def schema_parts(spark: SparkSession, base: str) -> DataFrame:
    """Macro and micro recall of tables, columns, edges and keys over the acceptance records' sets."""
    cases = table(spark, base, "olist_acceptance_60")
    none = F.array().cast("array<string>")
    wanted, found = F.coalesce("required_concepts", none), F.coalesce("invariants", none)

    def of_length(sets, k: int):
        return F.filter(sets, lambda x: F.length(x) % 4 == k)

    parts = {f"{side}_{part}": of_length(sets, k) for side, sets in (("gold", wanted), ("found", found)) for k, part in enumerate(evaluation.PARTS)}
    return evaluation.schema_summary(evaluation.schema_scores(cases.select("id", *[c.alias(n) for n, c in parts.items()])))


def manifest_check(spark: SparkSession, base: str) -> DataFrame:
    """Faults of a manifest that lists the acceptance records by difficulty with hashes of their language, and knows no hard ones."""
    cases = table(spark, base, "olist_acceptance_60")
    listed = cases.select("id", F.col("difficulty").alias("part"), F.upper("language").alias("case_hash")).unionAll(cases.where("partition = 'holdout'").select("id", F.lit("easy"), F.upper("language")))
    actual = cases.where("source IS NOT NULL").select("id", F.upper(F.regexp_replace("language", "vi", "pt")).alias("case_hash"))
    return evaluation.manifest_faults(listed, actual, ["easy", "medium"]).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def key_closure(spark: SparkSession, base: str) -> DataFrame:
    """All tables within reach of each other along declared keys, and the fewest keys between them: a recursive query over the edges."""
    edges = spark.createDataFrame([(name, key.target) for name, key in _catalog(spark, base).edges()], "child string, parent string")
    edges.createOrReplaceTempView("key_edges")
    return spark.sql("WITH RECURSIVE " + KEY_CLOSURE)


KEY_CLOSURE = """either(a, b) AS (SELECT child, parent FROM key_edges UNION ALL SELECT parent, child FROM key_edges),
    walk(a, b, steps) AS (SELECT a, b, 1 FROM either UNION ALL SELECT w.a, e.b, w.steps + 1 FROM walk w JOIN either e ON e.a = w.b WHERE w.steps < 4)
    SELECT a, b, MIN(steps) AS steps FROM walk WHERE a <> b GROUP BY a, b"""


def foreign_keys(spark: SparkSession, base: str) -> DataFrame:
    """References without a parent, per declared key of one column."""
    known = _catalog(spark, base)
    checks = [quality.one(f"{name}.{k.columns[0]}", quality.orphans(table(spark, base, name), k.columns[0], table(spark, base, k.target), k.target_columns[0]), 0) for name, k in known.edges() if len(k.columns) == 1]
    return quality.suite(checks)


def latest_run_state(spark: SparkSession, base: str) -> DataFrame:
    events = table(spark, base, "trace_events").select("run_id", "sequence", "layer", "event").dropDuplicates()
    return trace.latest(events)


def content_hashes(spark: SparkSession, base: str) -> DataFrame:
    """Rows and order-independent hash per table; the hash of the same rows in another order must be the same."""
    out = None
    for name in TABLES:
        df = table(spark, base, name)
        one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), content_hash(df).alias("content_hash"))
        out = one if out is None else out.unionAll(one)
    return out


def content_differences(spark: SparkSession, base: str) -> DataFrame:
    """Per table: rows, and whether its hash stays when rows are put in another order and changes when rows are doubled."""
    out = None
    for name in TABLES:
        df = table(spark, base, name)
        columns = df.columns
        whole, turned, doubled = (x.agg(F.count(F.lit(1)).alias("n_rows"), content_hash(x).alias("h")) for x in (df, df.orderBy(F.hash(*[F.to_json(F.struct(*columns))])), df.unionAll(df)))
        one = whole.select("n_rows", "h").crossJoin(F.broadcast(turned.select(F.col("h").alias("t")))).crossJoin(F.broadcast(doubled.select(F.col("h").alias("d"))))  # one row each
        one = one.select(F.lit(name).alias("table_name"), "n_rows", (F.col("h") == F.col("t")).alias("order_free"), (F.col("h") != F.col("d")).alias("copies_count"))
        out = one if out is None else out.unionAll(one)
    return out


HOSTILE = [
    "DROP TABLE orders", "DELETE FROM orders", "INSERT INTO orders SELECT * FROM orders", "UPDATE orders SET o_custkey = 1", "SELECT 1; SELECT 2", "PRAGMA table_info(orders)",
    "ATTACH 'x' AS y", "CREATE VIEW v AS SELECT 1", "SET spark.sql.shuffle.partitions=1", "CACHE TABLE orders", "EXECUTE IMMEDIATE 'SELECT 1'", "SELECT * FROM parquet.`/root`",
    "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT reflect('java.lang.System', 'getProperty', 'x')", "SELECT TRANSFORM(o_custkey) USING 'cat' FROM orders", "SELECT 1 -- x", "SELECT /* x */ 1",
    "INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT 1", "BEGIN SELECT 1; END", "WITH t AS (SELECT 1 AS a) INSERT INTO orders SELECT a FROM t", "SELECT * FROM secrets", "SELECT * FROM range(10)",
    "SELECT c_name FROM customer WHERE c_custkey IN (SELECT c_custkey FROM orders)", "MERGE INTO orders USING customer ON 1 = 1 WHEN MATCHED THEN DELETE", "",
]


#: Why each of HOSTILE is refused; the statements that are none fail in the parser.
REFUSALS = {
    "syntax": (4, 5, 6, 24), "node": (0, 1, 2, 3, 7, 8, 9, 10, 14, 17, 18, 19, 23), "path": (11,), "function": (12, 13, 25, 26, 27), "comment": (15, 16), "table": (20,), "table function": (21,), "outer column": (22, 28),
}
HOSTILE += ["SELECT input_file_name() FROM orders", "SELECT current_user()", "SELECT rand() FROM orders", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT c_name AS x FROM customer) t)"]


def _refusal(spark: SparkSession, sql: str, known: Catalog) -> str:
    """The kind of reason for which a statement may not run; anything but a refusal of the engine's own is an error here."""
    try:
        decision = policy.check(spark, sql, known)
    except EngineError as error:
        return "comment" if "comments" in str(error) else "syntax" if error.kind.name == "SYNTAX_ERROR" else str(error)
    if decision.allowed:
        return "allowed"
    said = decision.reason
    for kind, words in (("outer column", "belongs to the outer query"), ("function", "function "), ("path", "only registered tables"), ("table", " is not registered"), ("table function", "UnresolvedTableValuedFunction"), ("node", "is not permitted in a read-only query")):
        if words in said:
            return kind
    return said


def policy_corpus(spark: SparkSession, base: str) -> DataFrame:
    """Hostile statements, none of which is run, and why each is refused."""
    known = _catalog(spark, base)
    return spark.createDataFrame([(sql, _refusal(spark, sql, known)) for sql in HOSTILE], "statement string, reason string")


def semantic_cases(spark: SparkSession, base: str) -> DataFrame:
    """Signals of queries that miss what was asked."""
    cases = [
        ("Which customer state has the most orders?", f"SELECT customer_state, COUNT(*) AS n FROM {C} GROUP BY customer_state"),
        ("Top 3 states by orders", f"SELECT customer_state, COUNT(*) AS n FROM {C} GROUP BY customer_state ORDER BY n DESC LIMIT 3"),
        ("What is the average price?", f"SELECT SUM(price_cents) AS s FROM {I}"),
        ("How many orders were delivered late?", f"SELECT COUNT(*) AS n FROM {O} WHERE order_status = 'delivered'"),
    ]
    planner = questions.LexicalPlanner()
    rows = [(q, ",".join(validation.semantic_signals(spark, q, planner.plan(q), s, "olist"))) for q, s in cases]
    return spark.createDataFrame(rows, "question string, signals string")


def ask_answers(spark: SparkSession, base: str) -> DataFrame:
    """Questions answered end to end."""
    engine = engine_over(spark, base)
    asked = ["What is the total product revenue by state?", "How many orders were canceled?", "Delete every canceled order", "hello there friend"]
    rows = []
    for q in asked:
        a = engine.ask("data", q)
        rows.append((q, a.status, len(a.preview.rows) if a.preview else 0))
    return spark.createDataFrame(rows, "question string, status string, n_rows int")


def default_limit(spark: SparkSession, base: str) -> DataFrame:
    """How many rows the governed engine lets an unbounded and a bounded query return."""
    engine = engine_over(spark, base, ["orders", "customer"])
    cases = [("unbounded", "SELECT o_orderkey FROM orders"), ("own_limit", "SELECT o_orderkey FROM orders LIMIT 7"), ("scalar", "SELECT COUNT(*) AS n FROM orders")]
    out = None
    for name, sql in cases:
        one = engine.sql("data", sql).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionAll(one)
    return out


# -- the SQL of those that SQL can say ---------------------------------------------------------

_TFS = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(sorted(set(TERMS))))
_DFS = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(set(TERMS))))
_SUM = " + ".join(
    f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * {retrieval.K1 + 1} / (tf{i} + {retrieval.K1} * (1 - {retrieval.B} + {retrieval.B} * length / mean))" for i in (sorted(set(TERMS)).index(t) for t in TERMS)
)
_BM25 = f"""t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS toks FROM documents),
    c AS (SELECT doc_id, len(toks) AS length, {_TFS} FROM t), s AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean, {_DFS} FROM c),
    b AS (SELECT doc_id, round({_SUM}, 6) AS score FROM c, s), l AS (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM b WHERE score > 0 QUALIFY rank <= 20)"""
_ROUTED = "CASE WHEN length(q) < 4 THEN 'CLARIFY' WHEN regexp_matches(q, '\\b(insert|update|delete|drop|alter|create|truncate|merge|attach|detach)\\b') THEN 'WRITE_REQUEST' WHEN regexp_matches(q, '\\b(return rate|returns|returned|refund|refunds|refunded)\\b|trả hàng|hoàn hàng|hoàn tiền|tỷ lệ trả') THEN 'CLARIFY' ELSE 'QUERY' END"
_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"



def _listed(rows: list[tuple], names: str) -> str:
    """Rows as a query of constants, for both dialects of SQL."""
    text = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {text}) v({names})"


_KEY_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', {i})" for t, keys in KEYS.items() for i, c in enumerate(keys, 1)) + ") v(table_name, column_name, place)"
_COLUMN_ROWS = (
    "SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
    "WHEN 'VARCHAR[]' THEN 'array<string>' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' ELSE lower(data_type) END AS data_type FROM duckdb_columns() WHERE NOT internal AND table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"
)
_GOLD_ROWS = [
    ("one table", "tables", O), ("one table", "columns", f"{O}.order_status"),
    *[("aliases", "tables", t) for t in (O, I, C)], *[("aliases", "columns", c) for c in (f"{C}.customer_state", f"{C}.customer_id", f"{O}.customer_id", f"{O}.order_id", f"{I}.order_id", f"{I}.price_cents")],
    *[("aliases", part, e) for part in ("edges", "keys") for e in (f"{I}.order_id = {O}.order_id", f"{C}.customer_id = {O}.customer_id")],
    *[("derived", "tables", t) for t in (O, I)], *[("derived", "columns", c) for c in (f"{O}.order_id", f"{O}.order_status", f"{I}.order_id", f"{I}.price_cents")],
]
_COUNTED = ["olist_customers_dataset", "olist_geolocation_dataset", I, O, P, "olist_sellers_dataset", "trace_events", "runs", "lineitem"]
_LOST = " + ".join(f"(SELECT count(*) FROM {t} c WHERE {a[0]} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} q WHERE q.{b[0]} = c.{a[0]}))" for t, keys in FOREIGN.items() if t.startswith("olist_") for a, p, b in keys)
_QUALITY = (
    "WITH c(check_name, actual, expected) AS (SELECT 'integrity_check', 0, 0 UNION ALL SELECT 'foreign_key_check', " + _LOST + ", 0 UNION ALL "
    + " UNION ALL ".join(f"SELECT 'row_count:{n}', (SELECT count(*) FROM {n}), (SELECT count(*) FROM (SELECT DISTINCT * FROM {n}))" for n in _COUNTED)
    + f" UNION ALL SELECT 'products_missing_category', (SELECT count(*) - count(product_category_name) FROM {P}), 0"
    " UNION ALL SELECT 'duplicate_review_id_occurrences', (SELECT count(*) - count(DISTINCT event_id) FROM events), 0 UNION ALL SELECT 'repeated_order_review_rows_beyond_first', (SELECT count(*) - count(DISTINCT user_id) FROM events), 0"
    " UNION ALL SELECT 'orders_with_multiple_review_rows', (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1)), 0"
    f" UNION ALL SELECT 'item_revenue_preserved', (SELECT sum(price_cents) FROM {I}), (SELECT sum(n) FROM (SELECT order_id, sum(price_cents) AS n FROM {I} GROUP BY 1))"
    f" UNION ALL SELECT 'freight_preserved', (SELECT sum(freight_value_cents) FROM {I}), (SELECT sum(n) FROM (SELECT order_id, sum(freight_value_cents) AS n FROM {I} GROUP BY 1))"
    " UNION ALL SELECT 'payment_preserved', (SELECT sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FROM lineitem), (SELECT sum(n) FROM (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS n FROM lineitem GROUP BY 1))"
    " UNION ALL SELECT 'geo_centroid_unique', (SELECT count(*) - count(DISTINCT geolocation_zip_code_prefix) FROM geo_zip_centroids), 0"
    f" UNION ALL SELECT 'raw_money_matches_cents', (SELECT count(*) FROM {I} WHERE CAST(round(CAST(price AS DECIMAL(18,2)) * 100) AS BIGINT) <> price_cents OR CAST(round(CAST(freight_value AS DECIMAL(18,2)) * 100) AS BIGINT) <> freight_value_cents), 0)"
    " SELECT check_name, CAST(actual AS BIGINT) AS actual, CAST(expected AS BIGINT) AS expected, actual = expected AS passed FROM c"
)

BUILT: dict[str, tuple[Callable, str | None]] = {
    "flagship": (flagship, FLAGSHIP),
    "bm25_topk": (bm25_topk, f"WITH {_BM25} SELECT doc_id, score, rank FROM l"),
    "cosine_topk": (
        cosine_topk,
        f"WITH v AS (SELECT vec_id, {_UNIT} AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, greatest(0.0, list_cosine_similarity(v.e, q.e)) AS exact FROM v, v q WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, round(exact, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(exact, 12) DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10",
    ),
    "rrf_fusion": (
        rrf_fusion,
        f"WITH {_BM25}, g AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents QUALIFY rank <= 20), u AS (SELECT doc_id, 1.0::DOUBLE / (60 + rank) AS part, 'bm25' AS source FROM l UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + rank), 'length' FROM g) SELECT doc_id, round(sum(part), 8) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM u GROUP BY doc_id",
    ),
    "identifier_boost": (
        identifier_boost,
        f"WITH c AS ({_COLUMN_ROWS}), r AS ({_listed([(t, ','.join(a), f'relationship:{t}.{','.join(a)}->{p}') for t, keys in FOREIGN.items() for a, p, _ in keys], 'table_name, a, document_id')}), d AS (SELECT DISTINCT 'table:' || table_name AS document_id, table_name, NULL AS column_name FROM c UNION ALL SELECT 'column:' || table_name || '.' || column_name, table_name, column_name FROM c UNION ALL SELECT document_id, table_name, NULL FROM r), s AS (SELECT document_id, 4.0::DOUBLE * (contains(q, table_name)::INT + coalesce(contains(q, column_name)::INT, 0)) AS score FROM d, (SELECT '{BOOSTED}' AS q)) SELECT document_id, score FROM s WHERE score > 0",
    ),
    "token_estimate": (token_estimate, "SELECT doc_id, CAST(greatest(1, ceil(strlen(coalesce(text, '')) / 3.0)) AS BIGINT) AS size FROM documents"),
    "unicode_tokens": (
        unicode_tokens,
        "WITH w AS (SELECT row_number() OVER () AS i, regexp_extract_all(lower(question), '[\\p{L}\\p{N}_]+') AS ws FROM runs WHERE question IS NOT NULL), f AS (SELECT i, list_concat(ws, flatten(list_transform(ws, lambda x: list_filter(string_split(x, '_'), lambda y: y <> '')))) AS found FROM w), a AS (SELECT found, list_distinct(list_filter(list_transform(found, lambda x: strip_accents(replace(x, 'đ', 'd'))), lambda y: NOT list_contains(found, y))) AS bare FROM f) SELECT token, count(*) AS n FROM (SELECT unnest(list_concat(found, bare)) AS token FROM a) GROUP BY token ORDER BY n DESC, token LIMIT 50",
    ),
    "catalog_rows": (catalog_rows, f"WITH k AS ({_KEY_ROWS}), c AS ({_COLUMN_ROWS}) SELECT 'data' AS db_id, c.table_name, 'table' AS kind, c.column_name, c.data_type, k.place IS NULL AS nullable, CAST(coalesce(k.place, 0) AS INTEGER) AS key_position FROM c LEFT JOIN k ON k.table_name = c.table_name AND k.column_name = c.column_name"),
    "join_closure": (
        join_closure,
        _listed([("table", t) for t in (C, I, O, P, "olist_sellers_dataset")] + [("join", f"{I}.order_id = {O}.order_id"), ("join", f"{I}.product_id = {P}.product_id"), ("join", f"{I}.seller_id = olist_sellers_dataset.seller_id"), ("join", f"{O}.customer_id = {C}.customer_id")], "kind, item"),
    ),
    "schema_search": (schema_search, None),
    "route_intent": (route_intent, f"SELECT {_ROUTED} AS intent, count(*) AS n FROM (SELECT trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS q FROM (SELECT question FROM runs UNION ALL SELECT question FROM olist_acceptance_60)) GROUP BY 1"),
    "accuracy_slices": (accuracy_slices, "SELECT \"partition\", language, difficulty, count(*) AS n, count(gold_sql) AS n_correct, round(count(gold_sql)::DOUBLE / count(*), 6) AS accuracy FROM olist_acceptance_60 GROUP BY ALL"),
    "failure_counts": (failure_counts, "SELECT status, count(*) AS n FROM runs WHERE status <> 'COMPLETED' GROUP BY 1"),
    "schema_recall": (
        schema_recall,
        "WITH c AS (SELECT list_distinct(coalesce(required_concepts, [])) AS w, list_distinct(coalesce(invariants, [])) AS f FROM olist_acceptance_60), h AS (SELECT len(list_intersect(w, f)) AS hits, len(w) AS nw, len(f) AS nf FROM c) SELECT round(avg(CASE WHEN nw > 0 THEN hits::DOUBLE / nw END), 6) AS mean_recall, round(avg(CASE WHEN nf > 0 THEN hits::DOUBLE / nf END), 6) AS mean_precision, count(*) FILTER (WHERE nw > 0) AS n_recall FROM h",
    ),
    "nearest_rank": (nearest_rank, "SELECT seller_id, CAST(quantile_disc(price_cents, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(price_cents, 0.95) AS BIGINT) AS p95 FROM olist_order_items_dataset GROUP BY 1"),
    "multiset_equal": (
        multiset_equal,
        f"WITH a AS ({VIEW_SQL['order_item_totals']}), b AS ({VIEW_SQL['order_item_totals'].replace(' GROUP BY', ' WHERE price_cents > 5000 GROUP BY')}) SELECT 'left' AS side, count(*) AS n FROM (FROM a EXCEPT ALL FROM b) HAVING count(*) > 0 UNION ALL SELECT 'right', count(*) FROM (FROM b EXCEPT ALL FROM a) HAVING count(*) > 0",
    ),
    "stratified_cases": (
        stratified_cases,
        "WITH g AS (SELECT difficulty, count(*) AS n, least(5, count(*)) AS base FROM olist_acceptance_60 GROUP BY 1), seats AS (SELECT difficulty, n::DOUBLE / k AS worth FROM (SELECT difficulty, n, unnest(range(base, n)) AS k FROM g)), won AS (SELECT difficulty, count(*) AS more FROM (SELECT difficulty, row_number() OVER (ORDER BY worth DESC, difficulty) AS place FROM seats) WHERE place <= 30 - (SELECT sum(base) FROM g) GROUP BY 1), q AS (SELECT g.difficulty, n, base + coalesce(more, 0) AS quota FROM g LEFT JOIN won ON won.difficulty = g.difficulty), picks AS (SELECT difficulty, CAST(floor((i + 0.5) * n / quota) AS BIGINT) AS at FROM (SELECT difficulty, n, quota, unnest(range(0, quota)) AS i FROM q)), r AS (SELECT id, difficulty, row_number() OVER (PARTITION BY difficulty ORDER BY id) - 1 AS at FROM olist_acceptance_60) SELECT id, r.difficulty FROM r JOIN picks ON picks.difficulty = r.difficulty AND picks.at = r.at",
    ),
    "complexity_scores": (
        complexity_scores,
        f"WITH q AS ({_listed([(n, (t if isinstance(t, str) else t[0]).upper()) for n, t in STATED.items()], 'query, t')}), c AS (SELECT query, len(regexp_extract_all(t, '(FROM|JOIN) [A-Z]')) AS tables, len(regexp_extract_all(t, 'SELECT ')) AS selects, len(regexp_extract_all(t, ' JOIN ')) AS joins, len(regexp_extract_all(t, ' UNION | INTERSECT | EXCEPT ')) AS sets, len(regexp_extract_all(t, ' GROUP BY ')) AS grouped, len(regexp_extract_all(t, ' HAVING ')) AS having FROM q) SELECT query, tables, joins, sets FROM c",
    ),
    "quality_checks": (quality_checks, _QUALITY),
    "correction_outcomes": (
        correction_outcomes,
        "WITH r AS (SELECT status, substr(created_at, 1, 4) AS y, CAST(coalesce(config_json ->> '$.max_repairs', '0') AS BIGINT) AS repairs, coalesce(status = 'COMPLETED', FALSE)::INT AS won FROM runs WHERE config_json IS NOT NULL) SELECT 'total' AS kind, 'attempted' AS name, count(*) AS n, CAST(sum(won) AS BIGINT) AS n_recovered FROM r UNION ALL SELECT 'total', 'repairs', CAST(sum(repairs) AS BIGINT), 0 FROM r UNION ALL SELECT 'total', 'calls', count(*), 0 FROM r UNION ALL SELECT 'stop_reason', coalesce(y, 'NONE'), count(*), CAST(sum(won) AS BIGINT) FROM r GROUP BY 1, 2 UNION ALL SELECT 'trigger', status, count(*), CAST(sum(won) AS BIGINT) FROM r WHERE status IS NOT NULL GROUP BY 1, 2",
    ),
    "gold_schemas": (gold_schemas, _listed(_GOLD_ROWS, "query, part, item")),
    "schema_parts": (
        schema_parts,
        "WITH c AS (SELECT id, list_distinct(coalesce(required_concepts, [])) AS g, list_distinct(coalesce(invariants, [])) AS f FROM olist_acceptance_60), p AS (SELECT * FROM (VALUES (0, 'tables'), (1, 'columns'), (2, 'edges'), (3, 'keys')) v(k, part)), s AS (SELECT part, len(list_intersect(list_filter(g, lambda x: length(x) % 4 = k), list_filter(f, lambda x: length(x) % 4 = k))) AS hits, len(list_filter(g, lambda x: length(x) % 4 = k)) AS gold FROM c, p) SELECT part, round(avg(CASE WHEN gold > 0 THEN hits::DOUBLE / gold END), 6) AS macro, round(sum(hits)::DOUBLE / nullif(sum(gold), 0), 6) AS micro, count(*) FILTER (WHERE gold > 0) AS n FROM s GROUP BY part",
    ),
    "manifest_check": (
        manifest_check,
        "WITH f AS (SELECT a.id, a.difficulty, a.\"partition\" = 'holdout' AS twice, a.source IS NULL AS gone, a.language = 'vi' AS changed FROM olist_acceptance_60 a) SELECT fault, count(*) AS n FROM (SELECT 'LISTED_TWICE' AS fault FROM f WHERE twice UNION ALL SELECT 'IN_TWO_PARTS' FROM f WHERE twice AND difficulty <> 'easy' UNION ALL SELECT 'UNKNOWN_PART' FROM f WHERE coalesce(least(difficulty, CASE WHEN twice THEN 'easy' ELSE difficulty END), '') NOT IN ('easy', 'medium') UNION ALL SELECT 'NO_CASE' FROM f WHERE gone UNION ALL SELECT 'CASE_CHANGED' FROM f WHERE NOT gone AND changed) GROUP BY 1",
    ),
    "key_closure": (key_closure, f"WITH RECURSIVE key_edges(child, parent) AS ({_listed([(t, p) for t, keys in FOREIGN.items() for _, p, _ in keys], 'child, parent')}), {KEY_CLOSURE}"),
    "content_differences": (content_differences, " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, TRUE AS order_free, TRUE AS copies_count FROM {n}" for n in TABLES)),
    "foreign_keys": (
        foreign_keys,
        " UNION ALL ".join(
            f"SELECT '{t}.{a[0]}' AS check_name, (SELECT count(*) FROM {t} WHERE {a[0]} IS NOT NULL AND {a[0]} NOT IN (SELECT {b[0]} FROM {p} WHERE {b[0]} IS NOT NULL)) AS actual, 0::BIGINT AS expected, (SELECT count(*) FROM {t} WHERE {a[0]} IS NOT NULL AND {a[0]} NOT IN (SELECT {b[0]} FROM {p} WHERE {b[0]} IS NOT NULL)) = 0 AS passed"
            for t, keys in FOREIGN.items()
            for a, p, b in keys
        ),
    ),
    "latest_run_state": (latest_run_state, "SELECT run_id, sequence, layer, event FROM (SELECT DISTINCT run_id, sequence, layer, event FROM trace_events) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC) = 1"),
    "content_hashes": (content_hashes, None),
    "complexity_classes": (complexity_classes, None),
    "policy_corpus": (policy_corpus, _listed([(sql, next(k for k, at in REFUSALS.items() if i in at)) for i, sql in enumerate(HOSTILE)], "statement, reason")),
    "semantic_cases": (
        semantic_cases,
        _listed([("Which customer state has the most orders?", "RANKING_ORDER_MISSING,RANKING_LIMIT_MISMATCH,TOP_K_MISSING_ORDER,TOP_K_MISSING_LIMIT"), ("Top 3 states by orders", ""), ("What is the average price?", "AVERAGE_AGGREGATE_MISSING"), ("How many orders were delivered late?", "DELIVERY_POPULATION_NARROWED_BY_STATUS")], "question, signals"),
    ),
    "ask_answers": (ask_answers, None),
    "default_limit": (default_limit, "SELECT 'unbounded' AS kind, least(200, (SELECT count(*) FROM orders)) AS n UNION ALL SELECT 'own_limit', least(7, (SELECT count(*) FROM orders)) UNION ALL SELECT 'scalar', 1"),
}


#: Added before rounding for comparison, so that exact halves do not depend on the engine.
NUDGE = 3.7e-11


def _stated(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, base: run_text(spark, base, text)


def _view(name: str) -> Callable[[SparkSession, str], DataFrame]:
    rounded = {"latitude": 6, "longitude": 6, "average_review_score": 6, "delivery_days": 6, "delay_days": 6}

    def run(spark: SparkSession, base: str) -> DataFrame:
        df = VIEWS[name](spark, base)
        return df.select(*[F.round(F.col(c) + NUDGE, rounded[c]).alias(c) if c in rounded else c for c in df.columns])

    return run


def _view_sql(name: str) -> str:
    columns = {"zip_centroids": ["latitude", "longitude"], "order_review_summary": ["average_review_score"], "order_delivery_facts": ["delivery_days", "delay_days"]}.get(name, [])
    replaced = ", ".join(f"round({c} + {NUDGE}, 6) AS {c}" for c in columns)
    return f"SELECT * {f'REPLACE ({replaced})' if columns else ''} FROM ({VIEW_SQL[name]})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = (
    {n: _stated(t if isinstance(t, str) else t[0]) for n, t in STATED.items()} | {f"view_{n}": _view(n) for n in VIEWS} | {n: f for n, (f, _) in BUILT.items()}
)
SQL: dict[str, str] = (
    {n: with_views(t if isinstance(t, str) else t[1]) for n, t in STATED.items()}
    | {f"view_{n}": _view_sql(n) for n in VIEW_SQL}
    | {
        "view_products_semantic": "SELECT p.product_id, p.product_category_name, t.product_category_name_english, p.product_name_lenght AS product_name_length, p.product_description_lenght AS product_description_length, p.product_photos_qty, p.product_weight_g FROM olist_products_dataset p LEFT JOIN (SELECT product_category_name, upper(max(product_category_name)) AS product_category_name_english FROM olist_products_dataset WHERE product_category_name LIKE '%care' GROUP BY 1) t ON t.product_category_name = p.product_category_name"
    }
    | {n: s for n, (_, s) in BUILT.items() if s}
)
