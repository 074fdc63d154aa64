"""Comparing results with reference answers, and measuring over many cases."""

from __future__ import annotations

import hashlib
import heapq
import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlgrid import policy
from marlgrid.catalog import Catalog
from marlgrid.executor import Caps, run


def _close(a, b, tolerance: float) -> bool:
    numbers = isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool)
    return math.isclose(a, b, rel_tol=0.0, abs_tol=tolerance) if numbers else a == b


def equal_rows(a: list, b: list, ordered: bool, tolerance: float = 0.0) -> bool:
    """Equality row by row; without order the rows are compared in order of their text."""
    if len(a) != len(b):
        return False
    if not ordered:
        a, b = sorted(a, key=repr), sorted(b, key=repr)
    return all(len(x) == len(y) and all(_close(p, q, tolerance) for p, q in zip(x, y)) for x, y in zip(a, b))


def plain(value, places: int = 6) -> str:
    """One text for values that count as equal: numbers to ``places`` decimals, the rest by type."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"# {float(value):.{places}f}" if math.isfinite(value) else f"# {value}"
    return f"{type(value).__name__} {value!r}"


def equal_sets(a: list, b: list, ordered: bool, widest: int = 8) -> bool:
    """Equality as multisets under some order of the columns (sought up to ``widest`` columns).

    Only columns that hold the same values, as often, can stand for each other,
    so columns are paired by what they hold and few orders remain to be tried.
    """
    if len(a) != len(b) or (a and len(a[0]) != len(b[0])):
        return False
    if not a:
        return True
    left, right = ([[plain(v) for v in column] for column in zip(*rows)] for rows in (a, b))
    collect = list if ordered else Counter
    wanted = collect(zip(*right))
    if collect(zip(*left)) == wanted:
        return True
    width = len(left)
    if width > widest:
        return False
    holds = [(collect(column)) for column in left]
    fits = [[i for i in range(width) if holds[i] == collect(column)] for column in right]

    def pair(chosen: tuple[int, ...]) -> bool:
        if len(chosen) == width:
            return collect(zip(*(left[i] for i in chosen))) == wanted
        return any(pair((*chosen, i)) for i in fits[len(chosen)] if i not in chosen)

    return pair(())


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with ``side``: equal tables give none.

    Both sides are counted per distinct row, so the comparison is one shuffle of
    distinct rows at any size.
    """
    names = a.columns
    both = a.select(*names, F.lit(1).alias("_sign")).unionAll(b.toDF(*names).select(*names, F.lit(-1).alias("_sign")))
    return both.groupBy(*names).agg(F.sum("_sign").alias("surplus")).where("surplus != 0").withColumn("side", F.when(F.col("surplus") > 0, "left").otherwise("right"))


def nearest_rank(value: str, q: float) -> Column:
    """The value at rank ceil(q*n), at least the first."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def accuracy(cases: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """Cases, correct ones and their share per group."""
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("n_correct"), F.round(F.count_if(F.col(correct)) / F.count(F.lit(1)), 6).alias("accuracy"))


def failures(cases: DataFrame, category: str = "category", correct: str = "correct") -> DataFrame:
    """Failure categories, the most common first."""
    return cases.where(~F.col(correct)).groupBy(category).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), category)


def recall(cases: DataFrame, wanted: str, found: str) -> DataFrame:
    """Recall and precision of set columns; null where there is nothing to find."""
    hit, asked, got = F.size(F.array_intersect(wanted, found)), F.size(F.array_distinct(wanted)), F.size(F.array_distinct(found))
    return cases.withColumn("hits", hit).withColumn("recall", hit / F.nullif(asked, F.lit(0))).withColumn("precision", hit / F.nullif(got, F.lit(0)))


def macro(cases: DataFrame) -> DataFrame:
    """Mean recall and precision; cases with a null one are left out of its mean."""
    return cases.agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("precision"), 6).alias("mean_precision"), F.count("recall").alias("n_recall"))


def complexity(spark: SparkSession, sql: str) -> tuple[int, str]:
    """A score over the parsed plan, and its class."""
    kinds = [policy._kind(n) for n in policy.once(policy.parse(spark, sql))]
    tables, joins = kinds.count("UnresolvedRelation"), kinds.count("Join")
    selects = kinds.count("Project") + kinds.count("Aggregate")
    sets = kinds.count("Union") + kinds.count("Intersect") + kinds.count("Except")
    score = max(0, tables - 1) + 2 * max(0, selects - 1) + joins + 2 * sets + kinds.count("Aggregate") + kinds.count("UnresolvedHaving")
    return score, "easy" if score <= 1 else "medium" if score <= 3 else "hard" if score <= 5 else "extra"


def has_order(spark: SparkSession, sql: str) -> bool:
    """Whether a query orders rows anywhere."""
    try:
        return any(policy._kind(n) == "Sort" for n in policy.walk(policy.parse(spark, sql)))
    except Exception:  # noqa: BLE001
        return False


def quotas(sizes: dict[str, int], total: int, floor: int = 5) -> dict[str, int]:
    """Cases per group: up to ``floor`` each, every further one where most cases wait per place."""
    if sum(sizes.values()) < total:
        raise ValueError("too few cases")
    places = {g: min(floor, n) for g, n in sizes.items()}
    # The k-th place of a group is worth size/k to it; of each group only the next one waits.
    waiting = [(-sizes[g] / k, g) for g, k in places.items() if 0 < k < sizes[g]]
    heapq.heapify(waiting)
    for _ in range(total - sum(places.values())):
        _, g = heapq.heappop(waiting)
        places[g] += 1
        if places[g] < sizes[g]:
            heapq.heappush(waiting, (-sizes[g] / places[g], g))
    return places


def stratified(cases: DataFrame, group: str, order: list[str], total: int, floor: int = 5) -> DataFrame:
    """Per group its quota of cases, at the midpoints of equal shares of the ordered group.

    Groups are few by contract (their sizes are read by the driver); cases are not.
    """
    sizes = {r[group]: r["count"] for r in cases.groupBy(group).count().collect()}
    shares = quotas(sizes, total, floor)
    spark = cases.sparkSession
    picks = spark.createDataFrame([(g, math.floor((i + 0.5) * sizes[g] / n)) for g, n in shares.items() for i in range(n)], "g string, position int")
    ranked = cases.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    return ranked.join(picks, (ranked[group] == picks["g"]) & (ranked["position"] == picks["position"]), "left_semi").drop("position")


#: Rows and seconds that one query of an evaluation may take; more of either is an error and no answer.
EVALUATION_CAPS = Caps(rows=100_000, bytes=1 << 30, seconds=10.0)


def answer_rows(df: DataFrame, caps: Caps = EVALUATION_CAPS) -> list[tuple]:
    """A query's rows within the evaluation's caps."""
    preview = run(df, caps)
    if preview.truncated:
        raise ValueError(f"more than {caps.rows} rows")
    return list(preview.rows)


def compare_queries(got: DataFrame, gold: DataFrame, ordered: bool, caps: Caps = EVALUATION_CAPS) -> bool:
    """Whether two queries give the same answer, within the evaluation's caps."""
    return equal_sets(answer_rows(got, caps), answer_rows(gold, caps), ordered)


def correction_metrics(cases: DataFrame) -> DataFrame:
    """Rows (kind, name, n, n_recovered): all outcomes, repairs and calls; then by trigger and by stop reason.

    ``cases`` has attempted, recovered (boolean), repairs, calls (int), trigger and
    stop_reason (string); cases without an outcome have a null ``attempted``.  One
    aggregation over grouping sets, whatever the number of cases.
    """
    held = cases.where("attempted IS NOT NULL")
    sets = held.select(
        "*",
        F.explode(
            F.array(
                *[F.struct(F.lit("total").alias("kind"), F.lit(k).alias("name"), v.cast("bigint").alias("one"), r.cast("bigint").alias("won")) for k, v, r in (
                    ("attempted", F.col("attempted"), F.col("attempted") & F.col("recovered")), ("repairs", F.coalesce("repairs", F.lit(0)), F.lit(0)), ("calls", F.coalesce("calls", F.lit(0)), F.lit(0)))],
                F.struct(F.lit("stop_reason").alias("kind"), F.coalesce("stop_reason", F.lit("NONE")).alias("name"), F.lit(1).cast("bigint").alias("one"), F.col("recovered").cast("bigint").alias("won")),
                F.struct(F.lit("trigger").alias("kind"), F.col("trigger").alias("name"), F.lit(1).cast("bigint").alias("one"), F.col("recovered").cast("bigint").alias("won")),
            )
        ).alias("x"),
    )
    return sets.where("x.name IS NOT NULL").groupBy("x.kind", "x.name").agg(F.sum("x.one").alias("n"), F.coalesce(F.sum("x.won"), F.lit(0)).alias("n_recovered"))


def gold_schema(df: DataFrame, catalog: Catalog, names: dict[str, str] | None = None) -> dict[str, frozenset[str]]:
    """Tables, columns, join edges and declared keys that an analysed query uses.

    Taken from the analysed plan: every attribute of it is traced by its expression
    id to the relation it comes from, through aliases, derived tables and CTEs.
    Edges are written 'a.x = b.y' with the smaller side first.
    """
    by_lower = {t.name.lower(): t for t in catalog.tables}
    owner: dict[int, str] = {}
    used: set[int] = set()
    equal: list[tuple[int, int]] = []
    stack, nodes = [df._jdf.queryExecution().analyzed()], []
    while stack:
        node = stack.pop()
        nodes.append(node)
        kind = policy._kind(node)
        if kind == "SubqueryAlias" and node.alias().lower() in by_lower and policy._kind(policy._items(node.children())[0]) != "SubqueryAlias":
            for a in policy._items(node.output()):
                owner[a.exprId().id()] = f"{node.alias().lower()}.{a.name().lower()}"
        if kind == "View":
            name = node.desc().identifier().table().lower()
            if name in by_lower:
                for a in policy._items(node.output()):
                    owner[a.exprId().id()] = f"{name}.{a.name().lower()}"
                continue  # what is inside a registered table or view is not the query's
        stack.extend(policy._items(node.children()))
        stack.extend(x for x in policy._items(node.innerChildren()) if hasattr(x, "expressions"))
        stack.extend(policy.nested(node))
    tables = {policy_name.split(".")[0] for policy_name in owner.values()}
    for node in nodes:
        if policy._kind(node) in ("View", "SubqueryAlias", "Project") and all(policy._kind(e) == "AttributeReference" for e in policy._items(node.expressions())) and policy._kind(node) != "Project":
            continue
        for e in policy.expressions(node):
            kind = policy._kind(e)
            if kind == "AttributeReference":
                used.add(e.exprId().id())
            elif kind == "EqualTo":
                sides = [e.left(), e.right()]
                if all(policy._kind(x) == "AttributeReference" for x in sides):
                    equal.append(tuple(x.exprId().id() for x in sides))
    columns = {owner[i] for i in used if i in owner}
    edges = {" = ".join(sorted((owner[a], owner[b]))) for a, b in equal if a in owner and b in owner and owner[a].split(".")[0] != owner[b].split(".")[0]}
    declared = {" = ".join(sorted((f"{t.name}.{x}".lower(), f"{k.target}.{y}".lower()))) for t in catalog.tables for k in t.foreign_keys for x, y in zip(k.columns, k.target_columns)}
    return {"tables": frozenset(tables), "columns": frozenset(columns), "edges": frozenset(edges), "keys": frozenset(edges & declared)}


#: The parts of a schema that retrieval is measured on.
PARTS = ("tables", "columns", "edges", "keys")


def schema_scores(cases: DataFrame) -> DataFrame:
    """Adds to cases with gold_* and found_* sets (of PARTS) the hits, recalls and precision; a recall of nothing is null."""
    out = cases
    for part in PARTS:
        hit, asked = F.size(F.array_intersect(f"gold_{part}", f"found_{part}")), F.size(F.array_distinct(f"gold_{part}"))
        out = out.withColumn(f"{part}_hits", hit).withColumn(f"{part}_gold", asked).withColumn(f"{part}_recall", hit / F.nullif(asked, F.lit(0)))
    both = F.col("tables_hits") + F.col("columns_hits")
    got = F.size(F.array_distinct("found_tables")) + F.size(F.array_distinct("found_columns"))
    return out.withColumn("schema_recall", both / F.nullif(F.col("tables_gold") + F.col("columns_gold"), F.lit(0))).withColumn("context_precision", both / F.nullif(got, F.lit(0)))


def schema_summary(scored: DataFrame) -> DataFrame:
    """Rows (part, macro, micro, n): mean of the cases' recalls without the null ones, and hits over gold of all cases."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_recall").alias("recall"), F.col(f"{p}_hits").alias("hits"), F.col(f"{p}_gold").alias("gold")) for p in PARTS]))
    return scored.select(each.alias("x")).groupBy("x.part").agg(F.round(F.avg("x.recall"), 6).alias("macro"), F.round(F.sum("x.hits") / F.nullif(F.sum("x.gold"), F.lit(0)), 6).alias("micro"), F.count("x.recall").alias("n"))


def manifest_faults(manifest: DataFrame, cases: DataFrame, parts: list[str]) -> DataFrame:
    """Rows (fault, id) of a manifest (id, part, case_hash) against the cases (id, case_hash) it names.

    Faults: an id listed twice, in two parts, of no known part, without its case,
    or whose case is another than when it was listed.  None: the manifest holds.
    """
    listed = manifest.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts"), F.min("part").alias("part"), F.min("case_hash").alias("listed_hash"))
    known = cases.groupBy(F.col("id").alias("case_id")).agg(F.min("case_hash").alias("case_hash"))
    joined = listed.join(known, F.col("id") == F.col("case_id"), "left")
    tests = {
        "LISTED_TWICE": F.col("n") > 1, "IN_TWO_PARTS": F.col("parts") > 1, "UNKNOWN_PART": ~F.coalesce(F.col("part").isin(parts), F.lit(False)),
        "NO_CASE": F.col("case_id").isNull(), "CASE_CHANGED": F.col("case_id").isNotNull() & ~F.col("case_hash").eqNullSafe(F.col("listed_hash")),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    return joined.select(F.explode(found).alias("fault"), "id")


def infer(cases: list[dict], answer, path: str, most_new: int | None = None) -> list[dict]:
    """Answer a manifest's cases in order, resuming behind what is stored; the gold never reaches ``answer``.

    ``answer`` gets the question alone.  Stored results must be a prefix of the
    manifest; every result is stored before the next case begins.
    """
    from marlgrid.sources.files import append_case, remaining, stored_cases

    if most_new is not None and most_new < 1:
        raise ValueError("most_new must be positive")
    todo = remaining([c["id"] for c in cases], path)
    asked = {c["id"]: c["question"] for c in cases}
    for case in todo[:most_new]:
        append_case(path, {"id": case, "result": answer(asked[case])})
    return stored_cases(path)


def release_report(reports: dict[str, dict], required: dict[str, int]) -> dict:
    """One statement over several evaluations whose scores stay apart; incomplete ones are refused.

    ``reports`` maps a name to its report (case_count, result_accuracy, ...),
    ``required`` the names that a release needs to their numbers of cases.
    """
    for name, cases in required.items():
        if int(reports.get(name, {}).get("case_count", 0)) != cases:
            raise ValueError(f"a release needs a complete report of {name} with {cases} cases")
    digest = lambda r: hashlib.sha256(json.dumps(r, sort_keys=True, default=str).encode()).hexdigest()
    kept = ("evaluation_id", "case_count", "database_count", "by_partition", "result_accuracy", "workflow_completion_rate")
    parts = {name: {k: r[k] for k in kept if k in r} | {"sha256": digest(r)} for name, r in sorted(reports.items())}
    limits = sorted({x for r in reports.values() for x in r.get("limitations", [])})
    return {"release_status": "complete", "score_policy": "scores of different sets are never blended", "parts": parts, "limitations": limits}
