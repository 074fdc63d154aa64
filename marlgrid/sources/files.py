"""Sources under contract, content hashes, and sinks that can be resumed."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgrid.functions.dialect import cents, empty_to_null


class ContractError(ValueError):
    """A source is not what its contract says."""


def read_csv(spark: SparkSession, path: str, header: list[str], multiline: bool = False) -> DataFrame:
    """CSV files whose headers must equal the contract; every column is text, a byte-order mark is dropped.

    A file is read in splits.  The header of one file is checked at once, those of
    all when they are read: a file with another one fails the query.  Only text
    with line breaks inside quotes needs ``multiline``, which takes a file as a whole.
    """
    first = spark.read.text(path).limit(1).collect()
    found = first[0][0].lstrip("\ufeff").rstrip("\r").split(",") if first else []
    found = [c.strip('"') for c in found]
    if found != header:
        raise ContractError(f"header {found} is not {header}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, quote='"', escape='"', multiLine=multiline)


#: Headers of the nine source files, as they are published.
HEADERS = {
    "olist_customers_dataset": "customer_id customer_unique_id customer_zip_code_prefix customer_city customer_state",
    "olist_geolocation_dataset": "geolocation_zip_code_prefix geolocation_lat geolocation_lng geolocation_city geolocation_state",
    "olist_order_items_dataset": "order_id order_item_id product_id seller_id shipping_limit_date price freight_value",
    "olist_order_payments_dataset": "order_id payment_sequential payment_type payment_installments payment_value",
    "olist_order_reviews_dataset": "review_id order_id review_score review_comment_title review_comment_message review_creation_date review_answer_timestamp",
    "olist_orders_dataset": "order_id customer_id order_status order_purchase_timestamp order_approved_at order_delivered_carrier_date order_delivered_customer_date order_estimated_delivery_date",
    "olist_products_dataset": "product_id product_category_name product_name_lenght product_description_lenght product_photos_qty product_weight_g product_length_cm product_height_cm product_width_cm",
    "olist_sellers_dataset": "seller_id seller_zip_code_prefix seller_city seller_state",
    "product_category_name_translation": "product_category_name product_category_name_english",
}


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 1 in the order in which the source gives them, without a global sort.

    The rows of every partition are counted, and each partition goes on where the
    one before it ended: two passes over the source, as many numbers on the driver
    as there are partitions.
    """
    part = df.select(F.spark_partition_id().alias("part"), F.struct(*df.columns).alias("row"))
    begin, ends = 0, {}
    for r in sorted(part.groupBy("part").count().collect(), key=lambda r: r["part"]):
        ends[r["part"]] = begin
        begin += r["count"]
    # The low 33 digits of Spark's own number count a partition's rows.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    offsets = F.map_from_entries(F.array(*[F.struct(F.lit(p).alias("k"), F.lit(n).cast("bigint").alias("v")) for p, n in ends.items()])) if ends else F.lit(None).cast("map<int,bigint>")
    return part.select((F.element_at(offsets, F.col("part")) + place + 1).alias(name), "row").select(name, "row.*")


def _cast(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return raw.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in raw.columns])


def customers(raw: DataFrame) -> DataFrame:
    return _cast(raw, {"customer_zip_code_prefix": "int"})


def sellers(raw: DataFrame) -> DataFrame:
    return _cast(raw, {"seller_zip_code_prefix": "int"})


def geolocation(raw: DataFrame) -> DataFrame:
    """Places with a row number, as their file has no key."""
    return _cast(numbered(raw, "geolocation_row_id"), {"geolocation_zip_code_prefix": "int", "geolocation_lat": "double", "geolocation_lng": "double"})


def order_payments(raw: DataFrame) -> DataFrame:
    typed = _cast(raw, {"payment_sequential": "int", "payment_installments": "int"})
    return typed.withColumn("payment_value_cents", cents(F.col("payment_value"), strict=True))


def order_reviews(raw: DataFrame) -> DataFrame:
    """Reviews with a row number; empty titles and messages stay empty texts."""
    return _cast(numbered(raw, "review_row_id"), {"review_score": "int"})


def orders(raw: DataFrame) -> DataFrame:
    """Orders; times that are missing are null and not empty."""
    return raw.select(*[F.col(c) if c in ("order_id", "customer_id", "order_status") else empty_to_null(F.col(c)).alias(c) for c in raw.columns])


def translation(raw: DataFrame) -> DataFrame:
    return raw.select(*[empty_to_null(F.col(c)).alias(c) for c in raw.columns])


def order_items(raw: DataFrame) -> DataFrame:
    """Items with integer keys and exact cents beside the original texts."""
    return raw.select(
        "order_id",
        F.col("order_item_id").cast("int").alias("order_item_id"),
        "product_id",
        "seller_id",
        "shipping_limit_date",
        "price",
        "freight_value",
        cents(F.col("price")).alias("price_cents"),
        cents(F.col("freight_value")).alias("freight_value_cents"),
    )


def products(raw: DataFrame) -> DataFrame:
    """Products with empty texts as null and measures as integers."""
    numbers = [c for c in raw.columns if c not in ("product_id", "product_category_name")]
    return raw.select("product_id", empty_to_null(F.col("product_category_name")).alias("product_category_name"), *[empty_to_null(F.col(c)).cast("int").alias(c) for c in numbers])


TRANSFORMS = {
    "olist_customers_dataset": customers, "olist_geolocation_dataset": geolocation, "olist_order_items_dataset": order_items, "olist_order_payments_dataset": order_payments,
    "olist_order_reviews_dataset": order_reviews, "olist_orders_dataset": orders, "olist_products_dataset": products, "olist_sellers_dataset": sellers, "product_category_name_translation": translation,
}


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the nine files, under its contract, with its types."""
    return TRANSFORMS[name](read_csv(spark, path, HEADERS[name].split(), multiline=name == "olist_order_reviews_dataset"))


def read_cases(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a strict schema; a line that does not follow it fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def observed(df: DataFrame, name: str) -> DataFrame:
    """What a manifest states of a table: rows, and a hash that does not depend on their order."""
    return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), content_hash(df).alias("content_hash"))


def content_hash(df: DataFrame):
    """Order-independent hash of all rows; repeated rows count by sum, so they do not cancel."""
    row = F.xxhash64(*[F.col(c).cast("string") if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in df.columns])
    # The sum of 48-bit numbers leaves 63 bits from some 65,000 rows on; it is taken modulo 2^63.
    total = F.sum(F.shiftrightunsigned(row, 16).cast("decimal(20,0)"))
    return F.hex((total % F.lit("9223372036854775808").cast("decimal(19,0)")).cast("bigint"))


def verify(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every table of a manifest with what was found, and whether it agrees."""
    want = manifest.select("table_name", F.col("n_rows").alias("expected_rows"))
    return want.join(found, "table_name", "full").withColumn("passed", F.col("n_rows").eqNullSafe(F.col("expected_rows")))


def observed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_bytes, sha256) of every file of a folder, hashed where it lies."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, fault) against a manifest (file, n_bytes, sha256): MISSING, UNEXPECTED, SIZE or HASH; a file that agrees gives nothing."""
    want = manifest.select(F.col("file").alias("want"), F.col("n_bytes").alias("want_bytes"), F.col("sha256").alias("want_hash"))
    both = want.join(found, F.col("want") == F.col("file"), "full")
    fault = F.when(F.col("file").isNull(), "MISSING").when(F.col("want").isNull(), "UNEXPECTED").when(F.col("n_bytes") != F.col("want_bytes"), "SIZE").when(F.col("sha256") != F.lower("want_hash"), "HASH")
    return both.select(F.coalesce("file", "want").alias("file"), fault.alias("fault")).where("fault IS NOT NULL")


def unpack(archive: str, members: set[str], target: str) -> list[str]:
    """Extract an archive that holds exactly the expected members and none outside the target folder."""
    import zipfile

    with zipfile.ZipFile(archive) as packed:
        names = [n for n in packed.namelist() if not n.endswith("/")]
        unsafe = [n for n in names if n.startswith(("/", "\\")) or ".." in Path(n).parts or ":" in n]
        if unsafe or set(names) != set(members) or len(names) != len(set(names)):
            raise ContractError(f"the archive holds {sorted(names)}, not {sorted(members)}")
        Path(target).mkdir(parents=True, exist_ok=True)
        packed.extractall(target, members=names)
    return sorted(names)


def build(tables: dict[str, DataFrame], target: str, keys: dict[str, list[str]] | None = None, foreign: dict[str, list[tuple]] | None = None) -> str:
    """Stage several tables, check their keys against each other, and publish all of them or none.

    A table's key must be unique and without nulls; every reference must resolve.
    """
    root, version = Path(target), f"v-{uuid.uuid4().hex[:12]}"
    staged = root / version
    spark = next(iter(tables.values())).sparkSession
    try:
        for name, df in tables.items():
            df.write.parquet(str(staged / name))
        stored = {name: spark.read.parquet(str(staged / name)) for name in tables}
        faults = []
        for name, columns in (keys or {}).items():
            if name in stored:
                n, distinct, nulls = stored[name].agg(F.count(F.lit(1)), F.countDistinct(*columns), F.count_if(F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False)))).first()
                faults += [f"{name}: key not unique"] * (n - nulls != distinct) + [f"{name}: null key"] * bool(nulls)
        for name, listed in (foreign or {}).items():
            for columns, parent, parent_columns in listed:
                if name in stored and parent in stored:
                    child = stored[name].select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)]).dropna()
                    lost = child.join(stored[parent].select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(parent_columns)]), [f"_{i}" for i in range(len(columns))], "left_anti").limit(1).count()
                    faults += [f"{name}: {', '.join(columns)} without {parent}"] * bool(lost)
        if faults:
            raise ContractError("; ".join(faults))
        pointer = root / f"current.{uuid.uuid4().hex[:8]}"
        pointer.write_text(version)
        os.replace(pointer, root / "current")
    except BaseException:
        shutil.rmtree(staged, ignore_errors=True)
        raise
    return str(staged)


def write_report(path: str, report: dict, public: bool = False) -> None:
    """A report as one JSON file, replaced as a whole; a public one has no details of its cases."""
    kept = {k: v for k, v in report.items() if not (public and k == "details")}
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    fresh = at.with_name(f"{at.name}.{uuid.uuid4().hex[:8]}.tmp")
    fresh.write_text(json.dumps(kept, indent=2, ensure_ascii=False, default=str) + "\n")
    os.replace(fresh, at)


def publish(df: DataFrame, target: str, check=None) -> str:
    """Write a new version beside the old ones, check it, then move the pointer to it.

    Readers follow ``current``; a failed write or check leaves it as it was.
    Local and shared file systems; object stores need their own rename.
    """
    root = Path(target)
    version = f"v-{uuid.uuid4().hex[:12]}"
    staged = root / version
    df.write.parquet(str(staged))
    try:
        if check is not None and not check(df.sparkSession.read.parquet(str(staged))):
            raise ContractError("the staged version did not pass its check")
        pointer = root / f"current.{uuid.uuid4().hex[:8]}"
        pointer.write_text(version)
        os.replace(pointer, root / "current")
    except BaseException:
        shutil.rmtree(staged, ignore_errors=True)
        raise
    return str(staged)


def current(spark: SparkSession, target: str) -> DataFrame:
    """The published version of a table."""
    root = Path(target)
    return spark.read.parquet(str(root / (root / "current").read_text()))


def stored_cases(path: str) -> list[dict]:
    """Results stored so far; a line that was cut while it was written does not count."""
    if not Path(path).exists():
        return []
    lines = Path(path).read_text().split("\n")
    return [json.loads(line) for line in lines[:-1] if line]


def remaining(cases: list[str], path: str) -> list[str]:
    """Cases still to do: what is stored must be a prefix of the manifest."""
    done = [r["id"] for r in stored_cases(path)]
    if done != cases[: len(done)]:
        raise ContractError("stored results are no prefix of the manifest")
    return cases[len(done) :]


def append_case(path: str, record: dict) -> None:
    """Add one result at the end of the file, on the disk before this returns; what a crash left of a line goes first."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    with at.open("ab+") as out:
        size = out.seek(0, os.SEEK_END)
        if size:
            out.seek(max(0, size - 1))
            if out.read(1) != b"\n":
                out.seek(0)
                out.truncate(out.read().rfind(b"\n") + 1)
        out.write((json.dumps(record, ensure_ascii=False) + "\n").encode())
        out.flush()
        os.fsync(out.fileno())


def missing_embeddings(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts whose vectors the cache does not hold yet."""
    return wanted.join(cache.select("cache_key"), "cache_key", "left_anti")
