import time

import pytest

from marlgrid import correction, evaluation, linking, policy, quality, retrieval, validation
from marlgrid.catalog import catalog, describe
from marlgrid.engine import Engine
from marlgrid.errors import EngineError, ErrorClass, classify, redact_paths
from marlgrid.executor import Caps, Preview, run
from marlgrid.plans.questions import Intent, LexicalPlanner, QuestionPlan, route, route_column
from marlgrid.queries import core
from marlgrid.sources import commerce, files
from marlgrid.trace import TraceStore, latest, like_literal


@pytest.fixture(scope="module")
def shop(spark):
    engine = Engine(spark)
    tables = commerce.tables(spark)
    engine.register("shop", tables, keys={"orders": ["order_id"]}, foreign={"order_items": [(["order_id"], "orders", ["order_id"]), (["product_id"], "products", ["product_id"])], "orders": [(["customer_id"], "customers", ["customer_id"])]})
    return engine


def status(engine, sql):
    try:
        engine.sql("shop", sql)
        return "ok"
    except EngineError as e:
        return e.kind.value


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT COUNT(*) AS n FROM orders", "ok"),
        ("SELECT status FROM orders UNION SELECT country FROM customers", "ok"),
        ("WITH t AS (SELECT order_id FROM orders) SELECT * FROM t", "ok"),
        ("SELECT * FROM orders o WHERE EXISTS (SELECT 1 FROM order_items i WHERE i.order_id = o.order_id)", "ok"),
        ("SELECT * FROM orders WHERE order_id IN (SELECT order_id FROM order_items)", "ok"),
        ("SELECT * FROM orders WHERE order_id IN (SELECT status FROM order_items)", "POLICY_VIOLATION"),
        ("SELECT * FROM Orders", "POLICY_VIOLATION"),
        ("SELECT '-- not a comment' AS a", "POLICY_VIOLATION"),
        ("SELECT \"status\" FROM orders", "POLICY_VIOLATION"),
        ("SELECT nothing FROM orders", "UNKNOWN_COLUMN"),
        ("SELECT status, COUNT(*) FROM orders", "AGGREGATION_ERROR"),
        ("SELECT order_id FROM orders o JOIN order_items i ON i.order_id = o.order_id", "AMBIGUOUS_COLUMN"),
        ("SELECT strftime('%m', ordered_at) FROM orders", "TYPE_OR_FUNCTION_ERROR"),
        ("SELEC 1", "SYNTAX_ERROR"),
        ("", "SYNTAX_ERROR"),
    ],
)
def test_policy(shop, sql, want):
    assert status(shop, sql) == want


def test_hostile_statements_are_refused(spark, data):
    rows = core.policy_corpus(spark, data).collect()
    assert len(rows) == len(core.HOSTILE) and not any(r.reason == "allowed" for r in rows)


def test_caps(spark, shop):
    df = spark.range(20).selectExpr("id", "repeat('x', 20) AS s")
    cut = run(df, Caps(rows=5))
    assert len(cut.rows) == 5 and cut.truncated
    assert not run(df, Caps(rows=20)).truncated
    with pytest.raises(EngineError):
        run(df, Caps(bytes=10))
    with pytest.raises(EngineError) as e:
        run(spark.range(5).crossJoin(spark.range(5)), Caps())
    assert e.value.kind == ErrorClass.POLICY_VIOLATION


def test_errors():
    assert classify(RuntimeError("[DIVIDE_BY_ZERO] no")).kind == ErrorClass.TYPE_OR_FUNCTION_ERROR
    assert classify(RuntimeError("what")).kind == ErrorClass.UNKNOWN_RUNTIME_ERROR
    assert redact_paths("at /root/secret/x.parquet") == "at <path>"


@pytest.mark.parametrize(
    "question, want",
    [("", Intent.CLARIFY), ("abc", Intent.CLARIFY), ("Delete every order", Intent.WRITE_REQUEST), ("What is the refund rate?", Intent.CLARIFY), ("thank you!", Intent.UNSUPPORTED), ("How many orders?", Intent.QUERY), ("xóa hết dữ liệu", Intent.WRITE_REQUEST)],
)
def test_route(spark, question, want):
    assert route(question) == want
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(route_column(F.col("q"))).first()[0] == want.value


def test_planner():
    plan = LexicalPlanner().plan("Top 5 categories by revenue in 2017, tie-break by name")
    assert (plan.task, plan.limit, plan.metrics, plan.dimensions, plan.years) == ("ranking", 5, ("revenue",), ("category",), ("2017",))
    assert LexicalPlanner().plan("Which state has the most orders?").limit == 1
    assert LexicalPlanner().plan("What is the maximum number of orders?").limit is None


def test_tokens():
    assert {"tong", "phi", "olist_order_items", "order", "items"} <= set(retrieval.tokens("Tổng phí olist_order_items"))
    assert retrieval.tokens("alpha") == ["alpha", "alpha"]


def test_bm25_by_hand(spark):
    import math

    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None), (4, ["c"])], "id int, t array<string>")
    got = {r.id: r.score for r in retrieval.bm25(docs, "id", F.col("t"), ["b", "b"]).collect()}
    idf = math.log(1 + (4 - 1 + 0.5) / (1 + 0.5))
    assert got == {1: pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.0)))}
    assert retrieval.bm25(docs, "id", F.col("t"), []).count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, []), (6, [3.0, 0.0])], "id int, e array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, query_vector array<double>")
    got = [(r.vec_id, r.score, r["rank"]) for r in retrieval.nearest(v, "id", "e", q, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0, 1), (6, 1.0, 2), (2, 0.0, 3)]


def test_fusion(spark):
    make = lambda ids: spark.createDataFrame([(d, i) for i, d in enumerate(ids, 1)], "doc int, rank int")
    got = retrieval.fuse({"bm25": make([1, 0]), "dense": make([0])}, "doc", 2).collect()
    assert [(r.doc, r.sources) for r in got] == [(0, ["bm25", "dense"]), (1, ["bm25"])]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)


@pytest.mark.parametrize("seeds", [["order_items", "products"], ["products", "order_items"], ["products", "order_items", "decoy"]])
def test_closure(spark, shop, seeds):
    known = shop.catalog("shop")
    tables = [*known.tables, describe("decoy", spark.range(1), "view")]
    got, joins = linking.closure(catalog("shop", tables), seeds)
    assert got == {"order_items", "products"} and joins == ["order_items.product_id = products.product_id"]
    assert linking.within_hops(known, ["customers"], 1) == {"customers", "orders"}
    with pytest.raises(ValueError):
        linking.closure(known, seeds, 3)


def test_link_and_search(spark, shop):
    known = shop.catalog("shop")
    plan = QuestionPlan("product category revenue", metrics=("revenue",), dimensions=("category",))
    found = retrieval.search(spark, known, linking.expanded_query(plan))
    context = linking.link(plan, found, known)
    assert "products" in context.tables and "products.category" in context.columns and context.size <= 1200
    with pytest.raises(ValueError):
        linking.link(plan, found, known, budget=1)
    assert linking.fit(["a" * 30, "b" * 300, "c" * 3], 12) == ["a" * 30, "c" * 3]


def test_catalog(spark, shop):
    known = shop.catalog("shop")
    assert known.digest == catalog("shop", reversed(known.tables)).digest != known.subset(["view"]).digest
    assert known.table("orders").primary_key == ("order_id",) and known.rows(spark).count() == sum(len(t.columns) for t in known.tables)


def test_signals(spark):
    planner = LexicalPlanner()

    def signals(q, sql):
        return set(validation.semantic_signals(spark, q, planner.plan(q), sql, "olist"))

    c, o = "olist_customers_dataset", "olist_orders_dataset"
    assert "RANKING_PRIMARY_NOT_DESC" in signals("Top 3 states by orders", f"SELECT a, COUNT(*) AS n FROM {c} GROUP BY a ORDER BY n LIMIT 3")
    assert signals("Which state has the most orders, tie-break by state", f"SELECT a, COUNT(*) AS n FROM {c} GROUP BY a ORDER BY n DESC, a LIMIT 1") == set()
    assert "ALPHABETICAL_TIE_BREAK_MISSING" in signals("most orders, tie-break by state", f"SELECT a, COUNT(*) AS n FROM {c} GROUP BY a ORDER BY n DESC LIMIT 1")
    assert "SCALAR_MAXIMUM_AGGREGATE_MISSING" in signals("What is the maximum number of items", f"SELECT COUNT(*) AS n FROM {o}")
    assert "RECORD_COUNT_MUST_NOT_BE_DISTINCT" in signals("How many customer records", f"SELECT COUNT(DISTINCT a) AS n FROM {c}")
    assert "CUSTOMER_IDENTITY_NOT_UNIQUE" in signals("How many returning customers", f"SELECT COUNT(*) AS n FROM {o}")
    assert "RETURNING_CUSTOMER_REPEAT_FILTER_MISSING" in signals("How many returning customers", "SELECT COUNT(*) AS n FROM customer_order_facts")
    assert "FREIGHT_PER_ORDER_GRAIN_MISMATCH" in signals("average freight per order", "SELECT AVG(freight) AS f FROM olist_order_items_dataset")
    assert "MULTIPLE_REVIEW_ROWS_RULE_MISSING" in signals("orders with more than one review row", f"SELECT COUNT(*) AS n FROM {o}")
    assert "PRODUCT_PHOTO_QUANTITY_FILTER_MISSING" in signals("products with more than one photo", f"SELECT COUNT(*) AS n FROM {o}")
    assert "YEAR_MONTH_CONTEXT_LOST" in signals("tháng nào có doanh thu", f"SELECT date_format(a, 'MM') AS m FROM {o}")


def test_fan_out(spark, data):
    engine = core.engine_over(spark, data)
    known = catalog("x", [*engine.catalog("data").tables, describe("olist_order_reviews_dataset", spark.sql("SELECT 1 AS review_id, 2 AS order_id"), keys=["review_id"], foreign=[(["order_id"], "olist_orders_dataset", ["order_id"])])])
    sql = "SELECT SUM(price_cents) AS s FROM olist_order_items_dataset i JOIN olist_order_reviews_dataset r ON r.order_id = i.order_id"
    assert validation.fan_out(spark, sql, known) and not validation.fan_out(spark, sql.replace("SUM(", "SUM(DISTINCT "), known)


def test_validate(shop):
    report, preview = shop.validate("shop", "SELECT COUNT(*) AS n FROM orders")
    assert report.accepted and preview.rows == ((4,),)
    report, preview = shop.validate("shop", "SELECT order_id FROM orders WHERE status = 'none'")
    assert report.warnings == ("EMPTY_RESULT",)
    report, preview = shop.validate("shop", "DROP TABLE orders")
    assert report.error == ErrorClass.POLICY_VIOLATION and preview is None


def test_hint():
    def preview(columns, rows):
        return Preview(columns, rows, False, 0.0)

    assert validation.display_hint(preview(("n",), ((1,),))) == "kpi"
    assert validation.display_hint(preview(("month", "n"), (("2020-01", 1), ("2020-02", 2)))) == "line"
    assert validation.display_hint(preview(("state", "n"), (("SP", 1), ("RJ", 2)))) == "bar"


class Scripted:
    """A writer that gives one text after the other."""

    def __init__(self, *texts):
        self.texts, self.advice = list(texts), []

    def write(self, plan, context, guidance=()):
        self.advice.append(guidance)
        return self.texts.pop(0) if len(self.texts) > 1 else self.texts[0]


@pytest.mark.parametrize(
    "texts, want, attempts",
    [
        (["SELECT order_count FROM orders", "SELECT COUNT(*) AS n FROM orders"], "SUCCEEDED", 2),
        (["SELECT order_count FROM orders"], "INVALID_SQL", 1),
        (["SELECT a FROM orders", "SELECT b FROM orders", "SELECT COUNT(*) AS n FROM orders"], "INVALID_SQL", 2),
        (["DROP TABLE orders"], "POLICY_BLOCKED", 1),
        (["```sql\nSELECT COUNT(*) AS n FROM orders;\n```"], "SUCCEEDED", 1),
    ],
)
def test_repair(spark, shop, texts, want, attempts):
    writer = Scripted(*texts)
    engine = Engine(spark, writer=writer)
    engine._catalogs, engine._domains, engine._frames = shop._catalogs, shop._domains, shop._frames
    answer = engine.ask("shop", "How many orders are there?")
    assert (answer.status, answer.attempts) == (want, attempts)


def test_budget():
    bad = validation.Report(False, ErrorClass.SYNTAX_ERROR)
    assert correction.Budget(repairs=0).stop_reason(bad) == "REPAIRS_USED"
    assert correction.Budget(seconds=0).stop_reason(bad) == "DEADLINE"
    budget = correction.Budget(repairs=2)
    assert budget.stop_reason(bad) is None and budget.stop_reason(bad) == "REPEATED_ERROR"
    assert correction.Budget().stop_reason(validation.Report(False, ErrorClass.TIMEOUT)) == "NOT_REPAIRABLE"


def test_trace(spark, shop, tmp_path):
    from marlgrid.streaming.traces import drain, layer_rates

    store = TraceStore(spark, str(tmp_path / "trace"))
    engine = Engine(spark, trace=store)
    engine._catalogs, engine._domains, engine._frames = shop._catalogs, shop._domains, shop._frames
    answer = engine.ask("shop", "Delete every order")
    assert answer.status == "WRITE_BLOCKED"
    rows = store.events(answer.run_id).collect()
    assert [r.sequence for r in rows] == [1, 2] and store.events(answer.run_id, after=1).count() == 1
    assert store.latest().collect()[0].event == "WRITE_BLOCKED"
    assert drain(layer_rates(store.stream()), "rates", "complete").groupBy().sum("n_events").first()[0] == 2


def test_like_literal(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("50%_x",), ("50axx",)], "s string")
    assert df.where(F.expr(f"s LIKE '{like_literal('%_').replace(chr(92), chr(92) * 2)}' ESCAPE '{chr(92) * 2}'")).count() == 1


def test_comparators(spark):
    assert evaluation.equal_sets([[1, "a"], [2, "b"]], [["b", 2], ["a", 1]], ordered=False)
    assert not evaluation.equal_sets([[1, "a"], [2, "b"]], [["b", 2], ["a", 1]], ordered=True)
    wide = [list(range(12))]
    assert evaluation.equal_sets(wide, wide, ordered=False) and not evaluation.equal_sets(wide, [wide[0][::-1]], ordered=False)
    assert evaluation.equal_sets([], [], True) and not evaluation.equal_sets([[1]], [[1, 2]], True)
    assert not evaluation.equal_sets([[1, 2], [2, 1]], [[1, 1], [2, 2]], False)
    assert evaluation.equal_sets([[1.0000001]], [[1]], True)
    assert evaluation.equal_rows([[1.0], [2.0]], [[2.05], [1.0]], ordered=False, tolerance=0.1)
    assert not evaluation.equal_rows([[1.0], [2.0]], [[2.0], [1.0]], ordered=True)
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert evaluation.multiset_difference(a, a).count() == 0
    assert [(r.side, r.surplus) for r in evaluation.multiset_difference(a, a.dropDuplicates()).collect()] == [("left", 1)]


def test_quotas():
    assert evaluation.quotas({"a": 3, "b": 50, "c": 10}, 20) == {"a": 3, "b": 12, "c": 5}
    with pytest.raises(ValueError):
        evaluation.quotas({"a": 1}, 2)


def test_complexity(spark):
    assert evaluation.complexity(spark, "SELECT a FROM t") == (0, "easy")
    assert evaluation.complexity(spark, "SELECT a FROM t JOIN u ON t.x = u.x WHERE a IN (SELECT b FROM v GROUP BY b HAVING COUNT(*) > 1)")[1] == "extra"
    assert evaluation.has_order(spark, "SELECT * FROM (SELECT a FROM t ORDER BY a) x") and not evaluation.has_order(spark, "SELECT a FROM t")


def test_quality(spark, shop):
    t = commerce.tables(spark)
    rows = quality.suite([quality.one("n", quality.count(t["orders"]), 4), quality.one("orphans", quality.orphans(t["order_items"], "order_id", t["orders"], "order_id"), 1)]).collect()
    assert [(r.check_name, r.passed) for r in rows] == [("n", True), ("orphans", False)]


def test_csv_contract(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text('﻿order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\no1,1,p,s,2020-01-01 00:00:00,"12.345",0.1\no2,2,p,s,,bad,1\n', encoding="utf-8")
    header = "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value".split(",")
    got = files.order_items(files.read_csv(spark, str(path), header)).orderBy("order_id").collect()
    assert [(r.order_id, r.order_item_id, r.price_cents, r.freight_value_cents) for r in got] == [("o1", 1, 1234, 10), ("o2", 2, None, 100)]
    with pytest.raises(files.ContractError):
        files.read_csv(spark, str(path), ["other"])


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "table")
    files.publish(spark.range(3), out)
    with pytest.raises(files.ContractError):
        files.publish(spark.range(9), out, check=lambda df: df.count() == 3)
    assert files.current(spark, out).count() == 3
    path = str(tmp_path / "done.jsonl")
    files.append_case(path, {"id": "a"})
    assert files.remaining(["a", "b"], path) == ["b"]
    with pytest.raises(files.ContractError):
        files.remaining(["b", "a"], path)


def test_content_hashes_of_every_table(spark, data):
    from marlgrid.queries import core

    rows = core.content_hashes(spark, data).collect()
    assert sorted(r.table_name for r in rows) == sorted(core.TABLES) and all(r.content_hash or not r.n_rows for r in rows)
    assert files.observed(spark.range(300_000), "t").first().content_hash is not None  # the sum is past 63 bits


def test_content_hash(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    h = lambda df: files.observed(df, "t").first().content_hash
    assert h(a) == h(a.orderBy("b").repartition(3)) != h(a.dropDuplicates())
    manifest = spark.createDataFrame([("t", 3), ("u", 1)], "table_name string, n_rows bigint")
    assert {r.table_name: r.passed for r in files.verify(files.observed(a, "t"), manifest).collect()} == {"t": True, "u": False}


def test_boundary():
    """Nothing outside the subpackage imports the training-data operators."""
    from pathlib import Path

    root = Path(core.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "marlgrid.llm" not in path.read_text(), path


def test_deadline(spark):
    """The caller gets TIMEOUT at the deadline, whether or not Spark has stopped by then."""
    df = spark.range(0, 4 * 10**9, 1, 4).selectExpr("SUM(hash(id) % 7) AS s")
    began = time.time()
    with pytest.raises(EngineError) as e:
        run(df, Caps(seconds=0.3))
    assert e.value.kind == ErrorClass.TIMEOUT and time.time() - began < 5
    spark.sparkContext.cancelAllJobs()
