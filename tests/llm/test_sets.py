"""Overlap across splits, packing, mixing, and the registered queries."""

import math
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from marlgrid.llm import asked, mixing, overlap, packing, queries, spelling, tokens
from tests.compare import canonical, connect, expected


BASE = "SELECT SUM(i.price_cents) FROM olist_orders_dataset o JOIN olist_order_items_dataset i ON i.order_id = o.order_id WHERE o.order_status = 'shipped' AND SUBSTR(o.order_purchase_timestamp, 1, 7) = '2022-08' AND i.price_cents > 40900"


def test_clauses():
    a = asked.query(BASE)
    b = asked.query("-- seen\nselect sum(i.price_cents) as s\nfrom olist_orders_dataset as ord inner join olist_order_items_dataset i on ord.order_id=i.order_id where 40900 < i.price_cents and ord.order_purchase_timestamp like '2022-08%' and ord.order_status='shipped' ;")
    assert a.clauses == b.clauses and a.marks == b.marks == "'2022-08' 'shipped' 40900"
    for change in (("shipped", "canceled"), ("40900", "40901"), ("SUM(", "MAX("), ("2022-08", "2022-09"), ("> 40900", "< 40900"), ("i.order_id = o.order_id", "i.order_id = o.customer_id"), ("JOIN", "LEFT JOIN")):
        assert asked.query(BASE.replace(*change)).clauses != a.clauses
    assert asked.query(None) is None and asked.query("  ") is None and asked.query("-- only").tokens == []
    one, other = asked.query("SELECT COUNT(*) FROM olist_orders_dataset"), asked.query("select count(1) from olist_products_dataset")
    assert one.clauses != other.clauses and one.facts() is None and one.clauses == asked.query("select count(1) as n from olist_orders_dataset;").clauses
    ranged = asked.query("SELECT a FROM t WHERE x BETWEEN 1 AND 5 AND y = 'k'")
    assert ranged.clauses == asked.query("select a from t where y='k' and x <= 5 and x >= 1").clauses != asked.query("select a from t where y='k' and x <= 5 and x >= 2").clauses
    assert asked.query("select a from t where x=1 or y=2").clauses != asked.query("select a from t where x=1 and y=2").clauses
    assert asked.query("select a.k from t a join t b on a.k=b.j").clauses != asked.query("select a.k from t a join t b on b.k=a.j").clauses
    assert not asked.query("WITH t AS (SELECT 1 AS a) SELECT a FROM t").plain and not asked.query("garbage (").plain


def facts(question):
    return asked.slot_facts(asked.slots(asked.words(question)))


def test_questions():
    en = "Give the number of orders that were canceled in the pet care category from customers in AM bought in March 2022 with freight below 825500 cents?"
    vi = "Hãy đếm số đơn hàng đã hủy mua vào tháng 3 năm 2022 của khách hàng ở bang AM thuộc danh mục pet care có phí vận chuyển dưới 825.500 cents"
    assert facts(en) and facts(en) == facts(vi)
    assert facts(en.replace("AM", "AP")) != facts(en) and facts(en.replace("825500", "825501")) != facts(en)
    sql = "SELECT COUNT(*) FROM olist_orders_dataset o JOIN olist_order_items_dataset i ON i.order_id = o.order_id JOIN olist_products_dataset p ON p.product_id = i.product_id JOIN olist_customers_dataset c ON c.customer_id = o.customer_id WHERE o.order_status = 'canceled' AND p.product_category_name = 'pet_care' AND c.customer_state = 'AM' AND SUBSTR(o.order_purchase_timestamp, 1, 7) = '2022-03' AND i.freight_value_cents < 825500"
    assert asked.query(sql).facts() == facts(en)
    for change in (("i.product_id", "i.seller_id"), ("AND c.customer_state = 'AM'", ""), ("= 'AM'", "!= 'AM'"), ("JOIN olist_products_dataset", "LEFT JOIN olist_products_dataset")):
        assert asked.query(sql.replace(*change)).facts() is None
    assert facts("something else 12") is None and asked.words(None) == [] and asked.slots([]) == {"status": "", "by": ""}


def test_spelling(spark):
    said = ["the seller shipped"] * 60 + ["teh seler shippde", "tte cellars shipped"] + ["many"] * 30 + ["may"] * 60 + [None]
    df = spark.createDataFrame([(i, t.split() if t else None) for i, t in enumerate(said)], "id int, words array<string>")
    got = {r.id: r.words for r in spelling.corrected(df, "words", ["id"]).collect()}
    assert got[0] == ["the", "seller", "shipped"] == got[60] and got[61] == ["the", "cellars", "shipped"] and got[70] == ["many"]
    assert spelling.corrected(df.limit(0), "words", ["id"]).count() == 0


def brute(records):
    def shapes(t):
        return {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}

    out = set()
    for i, train, t, m in records:
        for j, other, u, w in records:
            if i is not None and j is not None and train is True and other is False and t and u and (m or "") == (w or ""):
                x, y = shapes(t), shapes(u)
                if len(x & y) >= 0.8 * len(x | y):
                    out.add((i, j))
    return out


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 300, 60)] for _ in range(12)]
    records = []
    for i, words in enumerate(base):
        for j in range(12):
            changed = list(words)
            for at in rng.integers(0, 60, j // 3):
                changed[at] = f"z{rng.integers(0, 99)}"
            records.append((f"{i}-{j}", bool(j % 2), changed, "1" if j % 5 else "2"))
    records += [("short", True, ["a"], None), ("short2", False, ["a"], ""), ("none", True, [], ""), (None, False, ["a"], ""), ("short", True, ["a"], None)]
    records += [(f"hot{i}", i % 3 == 0, ["same", "text"], "") for i in range(60)]
    df = spark.createDataFrame(records, "id string, is_train boolean, tokens array<string>, marks string")
    got = [(r.train_id, r.eval_id) for r in overlap.cross_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(records)
    assert overlap.cross_pairs(df.limit(0)).count() == 0
    counted = {r.eval_id: r.n_links for r in overlap.links(df).collect()}
    assert counted == Counter(e for _, e in set(got))


def test_recall_of_the_bands(spark):
    """Near pairs of many texts, every one found through the bands, against all pairs."""
    rng = np.random.default_rng(9)
    records = []
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 2000, 80)]
        for j in range(4):
            changed = list(words)
            for at in rng.integers(0, 80, j):
                changed[at] = f"z{rng.integers(0, 999)}"
            records.append((f"{i}-{j}", j == 0, changed, ""))
    got = overlap.cross_pairs(spark.createDataFrame(records, "id string, is_train boolean, tokens array<string>, marks string")).collect()
    want, near = brute(records), {(r.train_id, r.eval_id) for r in got if r.routes == [":bands"]}
    assert len(want) > 150 and len(near) > 140 and {(r.train_id, r.eval_id) for r in got} <= want and len(got) >= 0.99 * len(want)


def test_questions_meet_by_their_words(spark, tmp_path):
    whole = "Doanh thu sản phẩm theo cents là bao nhiêu từ các đơn đã giao thuộc danh mục sports storage của khách hàng ở bang RO mua vào tháng 1 năm 2022 tốn hơn 5376700 cents kể cả phí?"
    unread = whole.replace("Doanh", "Dqqxnh")  # no metric is read
    assert facts(whole) and not facts(unread)
    held = {"near": unread, "number": unread.replace("5376700", "5376800"), "state": unread.replace("RO", "RJ"), "grouped": unread.replace("?", ", chia theo bang người bán?"), "status": unread.replace("đã giao", "đã hủy")}
    rows = [("dev", "dev", whole, None), *((k, "holdout", q, None) for k, q in held.items())]
    rows += [("d2", "dev", None, "SELECT COUNT(*) FROM olist_orders_dataset"), ("e2", "holdout", None, "SELECT COUNT(*) FROM olist_products_dataset"), ("d3", "dev", None, BASE), ("e3", "holdout", None, BASE.replace("i.order_id = o.order_id", "i.order_id = o.customer_id"))]
    rows += [("e4", "regression", None, BASE.lower().replace("40900", "40900 ;").replace("substr(o.order_purchase_timestamp, 1, 7) = '2022-08'", "o.order_purchase_timestamp like '2022-08%'")), ("e5", "unknown", whole, BASE), ("e6", None, whole, BASE)]
    spark.createDataFrame([(*r, None) for r in rows], "id string, partition string, question string, gold_sql string, source string").write.parquet(f"{tmp_path}/olist_acceptance_60.parquet")
    assert sorted(tuple(r) for r in queries.p3_found(spark, str(tmp_path)).collect()) == [("d3", "e4"), ("dev", "near")]
    report = {r.partition: tuple(r)[2:] for r in queries.p3_report(spark, str(tmp_path)).collect()}
    assert report == {"holdout": (7, 1, 0, 1, 0), "regression": (1, 1, 1, 0, 0)}


def test_slot_read_on_both_sides_decides(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [("t", True, words, "", {"state": "am", "by": ""}), ("same", False, words[1:], "", {"state": "am", "by": ""}), ("unread", False, words[2:], "", {"by": ""}), ("other", False, words[3:], "", {"state": "ap", "by": ""}), ("by", False, words[4:], "", {"by": "seller_state"})]
    df = spark.createDataFrame(rows, "id string, is_train boolean, tokens array<string>, marks string, slots map<string,string>")
    assert sorted(r.eval_id for r in overlap.cross_pairs(df).collect()) == ["same", "unread"]


def best_fit_decreasing(sizes, capacity):
    """One item at a time, the smallest gap that holds it."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - size)
    return sorted(gaps)


@pytest.mark.parametrize("capacity, top", [(100, 100), (64, 9), (1000, 400), (7, 3)])
def test_sweep_is_best_fit_decreasing(capacity, top):
    rng = np.random.default_rng(6)
    sizes = np.sort(np.concatenate([rng.integers(1, top + 1, 700), np.full(300, top // 2 + 1)]))
    sweep = packing.Sweep(np.bincount(sizes, minlength=capacity + 1), capacity)
    container = sweep.container(np.arange(len(sizes)))
    held = np.bincount(container, sizes, minlength=sweep.n_containers).astype(int)
    assert len(held) == sweep.n_containers and sorted(capacity - held) == best_fit_decreasing(sizes.tolist(), capacity)
    assert packing.Sweep(np.zeros(8, int), 7).n_containers == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_packing(spark, parts):
    rng = np.random.default_rng(7)
    sizes = [int(x) for x in rng.lognormal(4, 1, 900)] + [0, 0, 256, 512, 513]
    rows = [(i, s, "x") for i, s in enumerate(sizes)] + [(10_000, None, "x"), (0, sizes[0], "x")]
    items = spark.createDataFrame(rows, "key bigint, n int, pack_id string").repartition(parts)
    kinds = spark.createDataFrame([("small", 256), ("big", 1024)], "pack_name string, capacity_tokens int")
    packed = packing.pack(items, "key", "n", kinds)
    got = packed.collect()
    for name, capacity in (("small", 256), ("big", 1024)):
        own = [r for r in got if r.pack_name == name]
        held = Counter()
        for r in own:
            if r.pack_id is not None:
                held[r.pack_id] += r.size
        assert max(held.values()) <= capacity
        per = Counter()
        for r in own:
            per[r.key] += r.size
        assert per == Counter({i: s for i, s in enumerate(sizes)}) + Counter({0: sizes[0]}) | Counter({k: 0 for k in per})
        assert all(r.pack_id is None for r in own if r.size == 0)
        assert all(len([r for r in own if r.key == k]) == max(1, -(-sizes[k] // capacity)) for k in range(1, len(sizes)))
        least = math.ceil(sum(held.values()) / capacity)
        assert len(held) <= least * 1.01 + 1
    same = packing.pack(items.repartition(5), "key", "n", kinds).collect()
    assert sorted(Counter(r.pack_id for r in same if r.key not in (0, 10_000)).values()) == sorted(Counter(r.pack_id for r in got if r.key not in (0, 10_000)).values())
    assert {r.pack_name: r.all_fit for r in packing.fill(packed, kinds).collect()} == {"small": True, "big": True}
    assert packing.pack(items.limit(0), "key", "n", kinds).count() == 0
    assert packing.pack(items, "key", "n", kinds.limit(0)).count() == 0


def test_rates():
    for cap in (1, 3, 8):
        for mean in (0.1, 0.5 * cap, 0.99 * cap):
            assert mixing.capped_mean(mixing.rate_for(mean, cap), cap) == pytest.approx(mean, abs=1e-6)
    assert mixing.rate_for(0, 3) == 0


def test_mix(spark):
    rng = np.random.default_rng(8)
    rows = [(i, ["a", "b", "c"][i % 10 % 3], int(s)) for i, s in enumerate(rng.lognormal(3, 1, 6000))] + [(9001, None, 5), (9002, "other", 5), (9003, "a", None), (9004, "a", 0)]
    sized = spark.createDataFrame(rows, "key bigint, source string, size int")
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.3, 3), ("c", 0.4, 4), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    chosen, total = mixing.plan(sized, targets)
    mix = mixing.replicate(sized, chosen)
    got = {r.source: r for r in mixing.shares(mix, sized, targets, chosen).collect()}
    for s, share in (("a", 0.2), ("b", 0.3), ("c", 0.4)):
        assert got[s].actual_share == pytest.approx(share / 0.9, rel=0.01) and got[s].most_repeats <= got[s].max_repeats
    assert got["gone"].actual_share == 0 and sum(r.n_tokens for r in got.values()) == pytest.approx(total, rel=0.01)
    first = mixing.shuffled(mix).collect()
    assert [r.order_key for r in first] == sorted(r.order_key for r in first) and first == mixing.shuffled(mixing.replicate(sized.repartition(3), chosen)).collect()
    assert mixing.plan(sized.limit(0), targets) == ({}, 0.0)


def test_token_counts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "id int, t string")
    got = {r.id: r.n for r in df.select("id", tokens.token_count(F.col("t")).alias("n")).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] is None and got[4] > 1


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    if name in queries.SQL:
        assert canonical(df.columns, rows) == expected(connect(data), queries.SQL[name])
    else:
        assert rows
    assert name in entry.queries()
