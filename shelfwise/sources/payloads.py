"""Readers for landed payload files: one row for each product, branch, category or page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files of JSON by a declared shape; what isn't of that shape is null."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_storefront_pages(spark: SparkSession, path: str, chain: str) -> DataFrame:
    return _json(spark, path, schemas.STOREFRONT).select(F.lit(chain).alias("chain"), F.posexplode("products").alias("seq", "product"))


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.SEARCH).select("pagination", F.posexplode("results").alias("seq", "product"))


def read_graphql_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page without products gives no rows, whatever its errors."""
    return _json(spark, path, schemas.GRAPHQL).select(F.col("data.products.page_info").alias("page_info"), F.posexplode("data.products.items").alias("seq", "product"))


def read_catalog_pages(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.CATALOG).select("total", F.posexplode("data").alias("seq", "product"))


def read_autocomplete(spark: SparkSession, path: str) -> DataFrame:
    """Items without the marks of other pages, and has_prev and has_next of their file; a payload that is no list fails."""
    files = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    listed = files.withColumn("value", F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a list: "), "file"))))
    items = listed.select("file", F.from_json("value", f"array<struct<{_fields(schemas.AUTOCOMPLETE)}>>").alias("items"))
    marks = [F.array_contains(F.transform("items", lambda i: i["id"]), mark) for mark in ("prev", "next")]
    return items.select("file", marks[0].alias("has_prev"), marks[1].alias("has_next"), F.posexplode("items").alias("seq", "item")).where(~F.col("item.id").isin("prev", "next")).select("file", "seq", "item.*", "has_prev", "has_next")


def _fields(schema: str) -> str:
    head, _, parts = schema.partition(", parts ")
    return ", ".join(":".join(x.split(" ", 1)) for x in head.split(", ")) + (f", parts:{parts}" if parts else "")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML or XML files as page_id, url (the file) and html."""
    return spark.read.option("wholetext", True).text(path).select(F.xxhash64(F.input_file_name()).alias("page_id"), F.input_file_name().alias("url"), F.col("value").alias("html"))


def read_latest_snapshot(spark: SparkSession, path: str, schema: str = schemas.UNIFIED) -> DataFrame:
    """The rows of the newest file of each chain and role; file names are role_chain*.json. Unreadable rows carry the text in error."""
    rows = spark.read.schema(f"{schema}, error string").option("columnNameOfCorruptRecord", "error").json(path)
    stem = F.element_at(F.split(F.col("_metadata.file_name"), "[_.]"), 1), F.element_at(F.split(F.col("_metadata.file_name"), "[_.]"), 2)
    told = rows.select("*", stem[0].alias("role"), stem[1].alias("file_chain"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_name").alias("file"))
    newest = told.groupBy("role", "file_chain").agg(F.max(F.struct("modified", "file")).alias("newest"))
    return told.join(newest, ["role", "file_chain"]).where((F.col("modified") == F.col("newest.modified")) & (F.col("file") == F.col("newest.file"))).drop("newest", "modified")


def read_branches(spark: SparkSession, path: str, chain: str) -> DataFrame:
    """Branch rows; those whose internet id isn't a whole number are left out."""
    rows = spark.read.schema(schemas.BRANCHES).json(path).withColumn("internet_id", F.col("internet_id").try_cast("int"))
    return rows.where("internet_id is not null").withColumn("chain", F.lit(chain))


def read_category_tree(spark: SparkSession, path: str) -> DataFrame:
    """id, name and depth of active categories without children, the least depth of each id."""
    level = _json(spark, path, schemas.CATEGORY_TREE).drop("_corrupt")
    found = []
    for depth in range(4):
        children = F.col("children") if "children" in level.columns else None
        leaf = (F.coalesce(F.size(children), F.lit(0)) <= 0) if children is not None else F.lit(True)
        usable = level.where(leaf & F.col("is_category") & (F.col("status") != 0) & F.col("id").startswith("category-node-"))
        found.append(usable.select(F.regexp_extract("id", r"(\d+)$", 1).alias("category_id"), "name", F.lit(depth).alias("depth")))
        if children is not None:
            level = level.select(F.explode("children").alias("child")).select("child.*")
    return reduce(DataFrame.unionByName, found).where("category_id <> ''").groupBy("category_id").agg(F.min(F.struct("depth", "name")).alias("at")).select("category_id", "at.name", "at.depth")


def harvest_categories(products: DataFrame, ids: Column, order: list[str]) -> DataFrame:
    """Distinct category ids in the order in which they are first seen."""
    seen = products.select(*order, F.posexplode(ids).alias("place", "category_id"))
    return seen.groupBy("category_id").agg(F.min(F.struct(*order, "place")).alias("first_seen"))


def live_or_static(live: DataFrame, static: DataFrame, keys: list[str]) -> DataFrame:
    """Both lists' stores, the live row where both have one."""
    both = live.withColumn("_rank", F.lit(0)).unionByName(static.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_rank")


def demo_products(spark: SparkSession) -> DataFrame:
    """Fifteen products by a rule, for trying things out: five commodities in three shops."""
    goods = [("חלב 3% 1 ליטר", "volume", 1000.0, False, 6.2), ("סוכר לבן 1 קג", "mass", 1000.0, False, 4.9), ("טונה בשמן 160 גרם", "mass", 160.0, False, 5.5), ("חזה עוף טרי", "mass", 1000.0, True, 34.9), ("ביצים L 12", "count", 12.0, False, 13.5)]
    rows = [(chain, "1", f"{chain} 1", f"{chain}-{i}", name, round(price + step * 0.3, 2), None if i == 4 else f"729000000{i:04d}", dimension, qty, weighed) for step, chain in enumerate(("carrefour", "ramilevi", "shufersal")) for i, (name, dimension, qty, weighed, price) in enumerate(goods)]
    return spark.createDataFrame(rows, "chain string, store_id string, store_name string, product_id string, name string, price double, barcode string, unit_dimension string, unit_qty_si double, is_weighable boolean").withColumn("price", F.col("price").cast("decimal(18,2)"))
