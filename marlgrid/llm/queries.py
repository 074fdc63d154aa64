"""Queries of the training-data problems, and the SQL that checks them where SQL can."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgrid.llm import asked, canonical, mixing, overlap, packing, percentiles, pii, spelling, tokens, unify
from marlgrid.session import cut, table

QUANTILES = [0.5, 0.9, 0.95, 0.99]
#: Rank error that p2 promises: this share of a group's values and one rank more (values lie between ranks).
RANK_BOUND = 0.01


def _timings(spark: SparkSession, base: str) -> DataFrame:
    """Each trace event's time taken once, laid down per layer and day."""
    rows = table(spark, base, "trace_events").select("run_id", "sequence", "layer", "elapsed_ms", F.substring("created_at", 1, 10).alias("day"))
    # Redelivered events are exact copies: rows that agree in all of this are one event.
    return percentiles.runs(rows.distinct(), "elapsed_ms", ["layer", "day"])


def p2_layer_day(spark: SparkSession, base: str) -> DataFrame:
    """Certified percentiles per layer and day."""
    stored, keys = _timings(spark, base), ["layer", "day"]
    found = percentiles.estimates(percentiles.digests(stored, keys), keys, QUANTILES)
    return percentiles.certify(stored, keys, found, QUANTILES)


def p2_layer(spark: SparkSession, base: str) -> DataFrame:
    """Certified percentiles per layer, from the merged digests of the days."""
    stored = _timings(spark, base)
    days = percentiles.digests(stored, ["layer", "day"])
    found = percentiles.estimates(percentiles.merge(days, ["layer"]), ["layer"], QUANTILES)
    return percentiles.certify(stored, ["layer"], found, QUANTILES)


def p2_bound_held(spark: SparkSession, base: str) -> DataFrame:
    """Per layer and quantile: exact counts, and whether the ranks of the estimate keep the bound around the exact percentile."""
    found = p2_layer(spark, base)
    reach = RANK_BOUND * F.col("n") + 1
    held = (F.col("n_below") <= F.col("q") * F.col("n") + reach) & (F.col("n_below") + F.col("n_equal") >= F.col("q") * F.col("n") - reach)
    return found.select("layer", "q", "n", "n_unusable", F.coalesce(held, F.lit(True)).alias("within_bound"))


def p2_extremes(spark: SparkSession, base: str) -> DataFrame:
    """Per layer: exact count, least and greatest value and the sum of the clusters' weights, all from merged digests."""
    days = percentiles.digests(_timings(spark, base), ["layer", "day"])
    merged = percentiles.merge(days, ["layer"])
    weight = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x).cast("bigint")
    mean = F.aggregate(F.zip_with("means", "weights", lambda m, w: m * w), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.col("n"), F.lit(0))
    return merged.select("layer", "n", "n_unusable", F.col("low").alias("least"), F.col("high").alias("most"), weight.alias("weight"), F.round(mean, 4).alias("mean"))


#: Values at which p2_counted counts, by the quantile that each stands in for.
PROBES = {0.5: 50.0, 0.9: 400.0, 0.95: 1000.0, 0.99: 5000.0}


def p2_counted(spark: SparkSession, base: str) -> DataFrame:
    """The counting pass at stated values in place of estimates: what it counts can be checked."""
    stored = _timings(spark, base)
    found = percentiles.estimates(percentiles.digests(stored, ["layer"]), ["layer"], QUANTILES)
    probe = F.element_at(F.create_map(*[F.lit(x) for pair in PROBES.items() for x in pair]), F.col("q"))
    counted = percentiles.certify(stored, ["layer"], found.withColumn("estimate", F.when(F.col("n") > 0, probe)), QUANTILES)
    return counted.select("layer", "q", "n", "n_unusable", "n_below", "n_equal")


TRAIN, EVALUATION = "dev", ["regression", "holdout"]
_VIEWED = "id string, is_train boolean, view string, tokens array<string>, marks string, slots map<string,string>"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(questions: pd.Series) -> pd.Series:
    return questions.map(asked.words)


def _question_views(batches):
    """(id, is_train, tokens) with corrected words -> their words and, where all was understood, their facts."""
    for pdf in batches:
        out = []
        for key, train, tokens in zip(pdf["id"], pdf["is_train"], pdf["tokens"]):
            found = asked.slots(list(tokens))
            out.append((key, train, "words", list(tokens), asked.number_marks(tokens), found))
            facts = asked.slot_facts(found)
            if facts:
                out.append((key, train, "facts", list(facts), "", {}))
        yield pd.DataFrame(out, columns=["id", "is_train", "view", "tokens", "marks", "slots"])


def _sql_views(batches):
    """(id, is_train, gold_sql) -> the query's tokens, decided by its clauses, and its facts."""
    for pdf in batches:
        out = []
        for key, train, sql in zip(pdf["id"], pdf["is_train"], pdf["gold_sql"]):
            query = asked.query(sql)
            if query:
                out.append((key, train, "sql", query.tokens, query.marks, {"clauses": asked.digest(query.clauses)}))
                facts = query.facts()
                if facts:
                    out.append((key, train, "facts", list(facts), "", {}))
        yield pd.DataFrame(out, columns=["id", "is_train", "view", "tokens", "marks", "slots"])


def _records(spark: SparkSession, base: str) -> DataFrame:
    records = table(spark, base, "olist_acceptance_60").where(F.col("partition").isin(TRAIN, *EVALUATION))
    return records.withColumn("is_train", F.col("partition") == TRAIN)


def _asked(spark: SparkSession, base: str) -> DataFrame:
    """What each acceptance record asks: a row per view (SQL, words, facts)."""
    records = _records(spark, base)
    said = cut(records.where("question IS NOT NULL").select("id", "is_train", F.xxhash64("question").alias("asked"), _words("question").alias("tokens")))
    spelled = spelling.corrected(said, "tokens", ["id", "is_train", "asked"])
    questions = spelled.select("id", "is_train", "tokens").mapInPandas(_question_views, _VIEWED)
    return questions.unionByName(records.select("id", "is_train", "gold_sql").where("gold_sql IS NOT NULL").mapInPandas(_sql_views, _VIEWED))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Evaluation records that a training record asks too."""
    pairs = overlap.cross_pairs(_asked(spark, base))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).where("id_a < id_b")


def p3_routes(spark: SparkSession, base: str) -> DataFrame:
    """Pairs by the views and routes that found them."""
    return overlap.cross_pairs(_asked(spark, base)).groupBy(F.concat_ws(",", "routes").alias("routes")).agg(F.count(F.lit(1)).alias("n_pairs"))


def p3_report(spark: SparkSession, base: str) -> DataFrame:
    """Per evaluation split and source: records, those found in training, and links per view; no pair is listed for it."""
    met = overlap.links(_asked(spark, base)).groupBy("eval_id").agg(*[F.sum(F.when(F.col("view") == v, F.col("n_links"))).alias(v) for v in ("sql", "words", "facts")])
    records = _records(spark, base).where("NOT is_train").select("id", "partition", "source")
    joined = records.join(met, records["id"] == met["eval_id"], "left")
    return joined.groupBy("partition", "source").agg(F.count(F.lit(1)).alias("n_records"), F.count("eval_id").alias("n_overlapping"), *[F.coalesce(F.sum(v), F.lit(0)).alias(f"links_{v}") for v in ("sql", "words", "facts")])


def p3_near_text(spark: SparkSession, base: str) -> DataFrame:
    """Cross-split pairs whose questions are near as they stand: plain words, equal numbers, nothing corrected or read."""
    plain = F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+"), F.lit(0))
    numbers = F.array_join(F.array_sort(F.filter(plain, lambda w: w.rlike("^[0-9]+$"))), " ")
    pairs = overlap.cross_pairs(_records(spark, base).select("id", "is_train", plain.alias("tokens"), numbers.alias("marks")))
    return pairs.select("train_id", "eval_id")


#: Tables with typed city names: name, key, city, state.
CITIES = [
    ("olist_geolocation_dataset", "geolocation_row_id", "geolocation_city", "geolocation_state"),
    ("olist_customers_dataset", "customer_id", "customer_city", "customer_state"),
    ("olist_sellers_dataset", "seller_id", "seller_city", "seller_state"),
]


def _cities(spark: SparkSession, base: str, tables=CITIES) -> DataFrame:
    """table_name, row_key, city, state of all rows with typed cities."""
    found = None
    for name, key, city, state in tables:
        one = table(spark, base, name).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.col(city).alias("city"), F.upper(F.col(state)).alias("state"))
        found = one if found is None else found.unionAll(one)
    return found


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Rows whose city the normaliser changes, for a character other than the ordinary one."""
    rows = _cities(spark, base, CITIES[:2]).where(F.col("city").isNotNull())
    return rows.where(unify.odd(F.col("city"))).select("table_name", "row_key").distinct()


def p4_unified(spark: SparkSession, base: str) -> DataFrame:
    """Every row's city in the one form."""
    return _cities(spark, base, CITIES[:2]).select("table_name", "row_key", unify.unified(F.col("city")).alias("city"))


def _city_map(spark: SparkSession, base: str, rows: DataFrame) -> DataFrame:
    """The entry of each distinct (city, state) that is not literally one of its state."""
    reference = table(spark, base, "city_reference")
    literal = reference.select(F.col("city_name").alias("city"), F.upper("state_code").alias("state")).distinct()
    values = rows.where(F.trim("city") != "").select("city", "state").distinct()
    anywhere, known = literal.select(F.col("city").alias("known_city")).distinct(), literal.select(F.col("city").alias("known_city"), F.col("state").alias("known_state"))
    open_ = values.where("state IS NOT NULL").join(known, (F.col("city") == F.col("known_city")) & (F.col("state") == F.col("known_state")), "left_anti")
    open_ = open_.unionAll(values.where("state IS NULL").join(anywhere, F.col("city") == F.col("known_city"), "left_anti"))
    names = reference.select(F.col("city_id").alias("entry_id"), F.col("city_name").alias("name"), F.col("state_code").alias("context"), F.lit(False).alias("former")).unionAll(
        reference.where("former_name IS NOT NULL").select("city_id", "former_name", "state_code", F.lit(True))
    )
    return canonical.match_values(open_.select(F.col("city").alias("value"), F.col("state").alias("context")), names)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """The reference entry of every row's city that is not literally one, or -1."""
    rows = _cities(spark, base)
    mapped = _city_map(spark, base, rows)
    joined = rows.join(mapped, (rows["city"] == mapped["value"]) & rows["state"].eqNullSafe(mapped["context"]), "inner")
    return joined.select("table_name", "row_key", F.coalesce("entry_id", F.lit(-1)).cast("bigint").alias("city_id")).distinct()


def p5_unmatched(spark: SparkSession, base: str) -> DataFrame:
    """Values without an entry, with the rows they stand in per table."""
    rows = _cities(spark, base)
    mapped = _city_map(spark, base, rows).where("entry_id IS NULL")
    joined = rows.join(mapped, (rows["city"] == mapped["value"]) & rows["state"].eqNullSafe(mapped["context"]), "inner")
    return joined.groupBy("table_name", "city").agg(F.count(F.lit(1)).alias("n_rows"))


def _sized(spark: SparkSession, base: str) -> DataFrame:
    """Every document's key, source and size in tokens, stored once."""
    return cut(table(spark, base, "documents").select(F.col("doc_id").alias("key"), "source", tokens.token_count(F.col("text"), tokens.vocabulary(spark)).alias("size")))


def p7_packed(spark: SparkSession, base: str) -> DataFrame:
    """The pack of every document, or piece of one, for each kind of pack."""
    return packing.pack(_sized(spark, base), "key", "size", table(spark, base, "pack_sizes")).withColumnRenamed("key", "doc_id")


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    """How full the packs of each kind are."""
    kinds = table(spark, base, "pack_sizes")
    return packing.fill(packing.pack(_sized(spark, base), "key", "size", kinds), kinds)


def p7_laws(spark: SparkSession, base: str) -> DataFrame:
    """How many documents every kind of pack holds, and how often a rule of packing is broken."""
    sized, kinds = _sized(spark, base), table(spark, base, "pack_sizes")
    return packing.laws(packing.pack(sized, "key", "size", kinds), "key", sized, kinds)


def p8_mix(spark: SparkSession, base: str) -> DataFrame:
    """The documents of the mix, each as often as it was drawn, in one global random order."""
    sized = _sized(spark, base)
    chosen, _ = mixing.plan(sized, table(spark, base, "mix_targets"))
    return mixing.shuffled(mixing.replicate(sized, chosen)).select(F.col("key").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copy", "order_key")


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    """The share of all tokens that each source was to have and has."""
    sized, targets = _sized(spark, base), table(spark, base, "mix_targets")
    chosen, _ = mixing.plan(sized, targets)
    return mixing.shares(mixing.replicate(sized, chosen), sized, targets, chosen)


def p8_laws(spark: SparkSession, base: str) -> DataFrame:
    """Per target source: its documents, and whether its cap held for each of them and for all."""
    sized, targets = _sized(spark, base), table(spark, base, "mix_targets")
    chosen, _ = mixing.plan(sized, targets)
    mix = mixing.replicate(sized, chosen)
    got = mixing.shares(mix, sized, targets, chosen)
    strays = mix.groupBy("source").agg(F.count(F.lit(1)).alias("copies")).join(sized.groupBy(F.col("source").alias("own")).agg(F.count(F.lit(1)).alias("documents")), F.col("source") == F.col("own"), "left")
    held = got.join(strays.select(F.col("source").alias("s"), "copies", "documents"), F.col("source") == F.col("s"), "left")
    return held.select(
        "source", F.coalesce("documents", F.lit(0)).alias("n_available"), (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_held"),
        (F.coalesce("copies", F.lit(0)) <= F.coalesce("documents", F.lit(0)) * F.col("max_repeats")).alias("total_within_caps"),
    )


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Every piece of personal information with its type and first character."""
    return pii.find(table(spark, base, "documents"), "doc_id", "text").select("doc_id", "pii_type", "start_char")


def p9_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    return table(spark, base, "documents").select("doc_id", pii.redacted(F.col("text")).alias("text"))


QUERIES = {
    "p2_layer_day": p2_layer_day,
    "p2_layer": p2_layer,
    "p2_bound_held": p2_bound_held,
    "p2_extremes": p2_extremes,
    "p2_counted": p2_counted,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_routes": p3_routes,
    "p3_near_text": p3_near_text,
    "p4_found": p4_found,
    "p4_unified": p4_unified,
    "p5_found": p5_found,
    "p5_unmatched": p5_unmatched,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p7_laws": p7_laws,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_laws": p8_laws,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

SQL = {
    "p2_counted": f"""
        WITH t AS (SELECT DISTINCT run_id, sequence, layer, elapsed_ms AS v FROM trace_events), g AS (SELECT layer, v, v IS NOT NULL AND isfinite(v) AND v >= 0 AS good FROM t),
             p AS (SELECT * FROM (VALUES {", ".join(f"({q}::DOUBLE, {x}::DOUBLE)" for q, x in PROBES.items())}) v(q, x))
        SELECT layer, q, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS n_unusable, count(*) FILTER (WHERE good AND v < x) AS n_below, count(*) FILTER (WHERE good AND v = x) AS n_equal
        FROM g, p GROUP BY layer, q""",
    "p2_extremes": """
        WITH t AS (SELECT DISTINCT run_id, sequence, layer, elapsed_ms AS v FROM trace_events),
             g AS (SELECT layer, v, v IS NOT NULL AND isfinite(v) AND v >= 0 AS good FROM t)
        SELECT layer, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS n_unusable, min(v) FILTER (WHERE good) AS least, max(v) FILTER (WHERE good) AS most,
               count(*) FILTER (WHERE good) AS weight, round(avg(v) FILTER (WHERE good), 4) AS mean FROM g GROUP BY layer""",
    "p7_laws": "SELECT pack_name, (SELECT count(*) FROM documents) AS n_items, 0::BIGINT AS n_incomplete, 0::BIGINT AS n_cut_needlessly, 0::BIGINT AS n_overfull FROM pack_sizes",
    "p8_laws": """
        SELECT t.source, coalesce(d.n, 0) AS n_available, TRUE AS cap_held, TRUE AS total_within_caps
        FROM mix_targets t LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) d ON d.source = t.source""",
    "p3_near_text": """
        WITH t AS (SELECT id, "partition" = 'dev' AS train, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM olist_acceptance_60 WHERE "partition" IN ('dev', 'regression', 'holdout')),
             s AS (SELECT id, train, array_to_string(list_sort(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$'))), ' ') AS marks,
                          list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i+4], ' '))) AS sh FROM t WHERE len(w) > 0)
        SELECT DISTINCT a.id AS train_id, b.id AS eval_id FROM s a JOIN s b ON a.train AND NOT b.train AND a.marks = b.marks
        WHERE len(list_intersect(a.sh, b.sh)) >= 0.8 * (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh)))""",
    "p2_bound_held": """
        WITH t AS (SELECT DISTINCT run_id, sequence, layer, elapsed_ms AS v FROM trace_events),
             g AS (SELECT layer, count(*) AS rows_all, count(*) FILTER (WHERE v IS NOT NULL AND isfinite(v) AND v >= 0) AS n FROM t GROUP BY layer)
        SELECT layer, unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS q, n, rows_all - n AS n_unusable, TRUE AS within_bound FROM g""",
}
