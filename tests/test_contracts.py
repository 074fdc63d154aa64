"""Sources under contract, stores, prompts, and the measures of an evaluation."""

import json
import zipfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlgrid import evaluation, linking, prompts, retrieval
from marlgrid.engine import Engine
from marlgrid.errors import EngineError
from marlgrid.executor import Caps
from marlgrid.functions.dialect import cents
from marlgrid.plans.questions import LexicalPlanner, QuestionPlan
from marlgrid.queries import core
from marlgrid.sources import files
from marlgrid.trace import FeedbackStore, RunStore


def test_cents(spark):
    texts = ["1.00499", "1.005", "1.015", "-0.125", "7", "x", None, "0.005"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(cents(F.col("t"))).collect()] == [100, 100, 102, -12, 700, None, None, 0]
    with pytest.raises((PySparkException, Py4JJavaError)):
        df.select(cents(F.col("t"), strict=True)).collect()


ROWS = {
    "olist_customers_dataset": "c1,u1,01037,sao paulo,SP", "olist_geolocation_dataset": "01037,-23.5,-46.6,sao paulo,SP", "olist_order_items_dataset": "o1,1,p1,s1,2020-01-01 00:00:00,10.00,1.50",
    "olist_order_payments_dataset": "o1,1,voucher,2,11.50", "olist_order_reviews_dataset": 'r1,o1,5,,"two\nlines",2020-01-02,2020-01-03', "olist_orders_dataset": "o1,c1,delivered,2020-01-01 00:00:00,,,,2020-01-09",
    "olist_products_dataset": "p1,,1,2,3,4,5,6,", "olist_sellers_dataset": "s1,01037,sao paulo,SP", "product_category_name_translation": "beleza,beauty",
}


@pytest.mark.parametrize("name", list(ROWS))
def test_nine_files(spark, tmp_path, name):
    header = files.HEADERS[name].split()
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text("\ufeff" * (i == 0) + ",".join(header) + "\n" + ROWS[name] + "\n", encoding="utf-8")
    df = files.load(spark, str(tmp_path), name)
    got = [r.asDict() for r in df.collect()]
    assert len(got) == 2
    if name.endswith(("geolocation_dataset", "reviews_dataset")):
        assert sorted(r[df.columns[0]] for r in got) == [1, 2]
    if name.endswith("reviews_dataset"):
        assert got[0]["review_comment_message"] == "two\nlines" and got[0]["review_score"] == 5
    if name.endswith("payments_dataset"):
        assert got[0]["payment_value_cents"] == 1150
    if name.endswith("orders_dataset"):
        assert got[0]["order_approved_at"] is None and got[0]["order_estimated_delivery_date"] == "2020-01-09"
    if name.endswith("products_dataset"):
        assert got[0]["product_category_name"] is None and got[0]["product_weight_g"] == 4 and got[0]["product_width_cm"] is None
    (tmp_path / "2.csv").write_text(",".join(["wrong", *header[1:]]) + "\n" + ROWS[name] + "\n")
    with pytest.raises((files.ContractError, PySparkException, Py4JJavaError)):
        files.load(spark, str(tmp_path), name).collect()


def test_numbers_go_on_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7)
    got = files.numbered(df.where("id % 3 = 0"), "n").collect()
    assert [r.n for r in got] == list(range(1, 335)) and [r.id for r in got] == list(range(0, 1000, 3))
    assert files.numbered(df.limit(0), "n").count() == 0


def test_files_against_a_manifest(spark, tmp_path):
    for name, text in (("a.csv", "1"), ("b.csv", "22"), ("c.csv", "333")):
        (tmp_path / name).write_text(text)
    found = files.observed_files(spark, str(tmp_path))
    hashes = {r.file: (r.n_bytes, r.sha256) for r in found.collect()}
    manifest = [("a.csv", *hashes["a.csv"]), ("b.csv", 3, hashes["b.csv"][1]), ("c.csv", 3, "0" * 64), ("d.csv", 1, "x")]
    got = files.verify_files(found, spark.createDataFrame(manifest, "file string, n_bytes bigint, sha256 string"))
    assert sorted(tuple(r) for r in got.collect()) == [("b.csv", "SIZE"), ("c.csv", "HASH"), ("d.csv", "MISSING")]
    assert [tuple(r) for r in files.verify_files(found, spark.createDataFrame(manifest[:1], "file string, n_bytes bigint, sha256 string")).orderBy("file").collect()] == [("b.csv", "UNEXPECTED"), ("c.csv", "UNEXPECTED")]


def test_archives(tmp_path):
    def packed(*names):
        path = tmp_path / f"{len(names)}{names[0].count('.')}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return str(path)

    assert files.unpack(packed("a.csv", "b.csv"), {"a.csv", "b.csv"}, str(tmp_path / "out")) == ["a.csv", "b.csv"]
    for bad in (packed("../a.csv"), packed("a.csv", "b.csv", "c.csv")):
        with pytest.raises(files.ContractError):
            files.unpack(bad, {"a.csv", "b.csv"}, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_build_is_all_or_nothing(spark, tmp_path):
    parents, children = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 1), (2, None)], "c int, k int")
    target, rules = str(tmp_path / "db"), {"keys": {"p": ["k"], "c": ["c"]}, "foreign": {"c": [(["k"], "p", ["k"])]}}
    at = files.build({"p": parents, "c": children}, target, **rules)
    before = (tmp_path / "db" / "current").read_text()
    assert at.endswith(before)
    for bad in ({"p": parents.unionAll(parents), "c": children}, {"p": parents, "c": children.unionAll(spark.createDataFrame([(3, 9)], "c int, k int"))}, {"p": parents.unionAll(spark.createDataFrame([(None,)], "k int")), "c": children}):
        with pytest.raises(files.ContractError):
            files.build(bad, target, **rules)
    assert (tmp_path / "db" / "current").read_text() == before and len(list((tmp_path / "db").glob("v-*"))) == 1


def test_reports_and_cases(tmp_path):
    files.write_report(str(tmp_path / "r" / "x.json"), {"n": 1, "details": [1]}, public=True)
    assert json.loads((tmp_path / "r" / "x.json").read_text()) == {"n": 1} and len(list((tmp_path / "r").iterdir())) == 1
    path, cases, seen = str(tmp_path / "cases.jsonl"), [{"id": f"c{i}", "question": f"q{i}", "gold_sql": "secret"} for i in range(4)], []
    evaluation.infer(cases, lambda q: seen.append(q) or q.upper(), path, most_new=2)
    with open(path, "a") as out:
        out.write('{"id": "c2", "res')  # cut while it was written
    got = evaluation.infer(cases, lambda q: seen.append(q) or q.upper(), path)
    assert seen == ["q0", "q1", "q2", "q3"] and [r["result"] for r in got] == ["Q0", "Q1", "Q2", "Q3"]
    with pytest.raises(files.ContractError):
        evaluation.infer(cases[1:], str, path)
    with pytest.raises(ValueError):
        evaluation.infer(cases, str, path, most_new=0)


def test_stores(spark, tmp_path):
    runs, feedback = RunStore(spark, str(tmp_path / "runs")), FeedbackStore(spark, str(tmp_path / "feedback"))
    assert runs.get("r1") is None and runs.latest().count() == 0
    runs.put(run_id="r1", question="How many orders?", status="QUEUED")
    runs.put(run_id="r1", status="RUNNING")
    runs.put(run_id="r2", question="Revenue", status="COMPLETED", result_json="{}")
    assert runs.get("r1")["question"] == "How many orders?" and runs.get("r1")["version"] == 2
    assert runs.recover() == 1 and runs.get("r1")["status"] == "FAILED" and runs.recover() == 0
    assert [r.run_id for r in runs.search("ORDERS").collect()] == ["r1"] and "result_json" not in runs.search().columns
    feedback.put(run_id="r1", rating=1, comment="bad")
    feedback.put(run_id="r1", rating=5)
    assert (feedback.get("r1")["rating"], feedback.get("r1")["comment"]) == (5, "bad") and feedback.latest().count() == 1


def test_prompts(spark, data):
    engine = core.engine_over(spark, data, ["orders", "customer"])
    known = engine.catalog("data")
    plan = QuestionPlan("How many orders?", metrics=("order count",))
    builder = prompts.PromptBuilder({"shop": "orders: one row each"})
    whole = builder.sql(plan, known)
    assert "FK orders(o_custkey) -> customer(c_custkey)" in whole and "No rules beyond" in whole and known.digest in whole
    found = linking.link(plan, retrieval.search(spark, known, plan.question), known)
    assert found.text in builder.sql(plan, known, found, "shop", ("Group by every column.",)) and "one row each" in builder.sql(plan, known, found, "shop")
    answers = iter(["no json", '```json\n{"sql": "SELECT 1 AS a"}\n```'])
    writer = prompts.ModelWriter(lambda prompt, schema: next(answers), builder, known)
    assert writer.write(plan, "TABLE orders(o_orderkey bigint)") == "SELECT 1 AS a" and writer.calls == 2
    for bad in ('{"sql": 1}', '{"explanation": "x"}', '{"sql": "a", "other": 1}', "[1]"):
        with pytest.raises(prompts.MalformedAnswer):
            prompts.ask(lambda p, s, bad=bad: bad, "x", prompts.SQL_ANSWER)


def test_stated_overrides_the_model():
    planner = prompts.ModelPlanner(lambda p, s: '{"task": "lookup", "metrics": ["x"], "dimensions": ["y"], "limit": 99}', LexicalPlanner())
    ranked = planner.plan("Top 3 states by revenue")
    assert ranked.task == "ranking" and ranked.limit == 3 and "x" in ranked.metrics and planner.calls == 1
    assert planner.plan("What is the total revenue?").limit is None


def test_guard_of_sql(spark, data):
    engine = core.engine_over(spark, data, ["orders", "customer"])
    cross = "SELECT COUNT(*) AS n FROM orders CROSS JOIN customer"
    with pytest.raises(EngineError):
        engine.sql("data", cross)
    with pytest.raises(EngineError):
        engine.sql("data", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT MAX(c_acctbal) FROM customer JOIN orders ON o_totalprice < c_acctbal)")
    free = Engine(spark, Caps(allow_cross=True))
    free.register("data", {n: core.table(spark, data, n) for n in ("orders", "customer")})
    assert free.sql("data", cross).count() == 1
    for sql in ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM (SELECT c_custkey FROM customer) t)", "WITH t AS (SELECT c_custkey AS k FROM customer) SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM t)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT x FROM (VALUES (1), (2)) v(x))"):
        engine.sql("data", sql)


def test_search_runs_no_job(spark, data):
    known = core.engine_over(spark, data).catalog("data")
    found = retrieval.search(spark, known, "product revenue by product_category_name", k=5)
    assert found[0]["document_id"] == "column:olist_products_dataset.product_category_name" and found[0]["sources"] == ("bm25",) and len(found) == 5
    vectors = spark.createDataFrame([(d["document_id"], [float(i == 3), 1.0]) for i, d in enumerate(retrieval.documents(known))], "document_id string, embedding array<double>")
    dense = retrieval.search(spark, known, "x", k=1, vectors=vectors, query_vector=[1.0, 1.0], mode="dense")
    assert dense[0]["document_id"] == retrieval.documents(known)[3]["document_id"] and dense[0]["sources"] == ("dense",)
    both = retrieval.search(spark, known, "product_category_name", k=30, vectors=vectors, query_vector=[1.0, 1.0])
    assert any(len(d["sources"]) == 2 for d in both)


def test_link_stops_at_the_budget(spark, data):
    known = core.engine_over(spark, data).catalog("data")
    plan = QuestionPlan("product revenue by category and state", metrics=("revenue",), dimensions=("category", "state"))
    found = retrieval.search(spark, known, linking.expanded_query(plan))
    whole = linking.link(plan, found, known)
    assert all(side in whole.columns for j in whole.joins for pair in j.split(" AND ") for side in pair.split(" = "))
    small = linking.link(plan, found, known, budget=whole.size - 1)
    assert small.size < whole.size
    with pytest.raises(ValueError):
        linking.link(plan, found, known, budget=10)


def test_evaluation_caps(spark):
    few, many = spark.range(5), spark.range(20)
    assert evaluation.compare_queries(few, spark.range(4, -1, -1), ordered=False) and not evaluation.compare_queries(few, spark.range(4, -1, -1), ordered=True)
    with pytest.raises(ValueError):
        evaluation.answer_rows(many, Caps(rows=10))


def test_release():
    reports = {"a": {"case_count": 60, "result_accuracy": 0.9, "limitations": ["x"]}, "b": {"case_count": 200, "result_accuracy": 0.5}}
    got = evaluation.release_report(reports, {"a": 60, "b": 200})
    assert set(got["parts"]) == {"a", "b"} and "result_accuracy" not in got and got["limitations"] == ["x"]
    for required in ({"a": 61}, {"c": 1}):
        with pytest.raises(ValueError):
            evaluation.release_report(reports, required)
