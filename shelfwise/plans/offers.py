"""The star schema's tables seen as offers, lists, branches and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.deals import DEAL
from ..functions.units import normalize_unit

UNITS = ["g", "kg", "ml", "litre", "unit"]
MONEY = "decimal(18,2)"
#: Names of commodities that parts stand for, where a query needs names that have groups.
GOODS = ["חלב 3% 1 ליטר", "חלב עיזים 3.5% אורגני", "סוכר חום", "קמח מלא", "אורז בסמטי", "טונה בשמן", "חזה עוף טרי", "פילה סלמון קפוא", "בשר טחון 15%", "קוטג' 5%", "ביצים L 12 יחידות", "שוקולד מריר"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """Line items as offers: the supplier is the store, its nation the chain, the part the product."""
    part = table(spark, sf_dir, "part")
    line = table(spark, sf_dir, "lineitem") if line is None else line
    rows = line.join(part, line["l_partkey"] == part["p_partkey"]).join(stores(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    regular = F.col("l_extendedprice").cast(MONEY)
    sale = F.when(F.col("l_discount") > 0, (regular * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY))
    rows = rows.select(
        F.col("n_name").alias("chain"), F.col("l_suppkey").alias("store_id"), F.col("s_name").alias("store_name"), F.col("l_partkey").alias("product_id"),
        F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"), unit).alias("name"), F.col("p_brand").alias("brand"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("729"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))).alias("barcode"),
        regular.alias("regular_price"), sale.alias("sale_price"), F.coalesce(sale, regular).alias("price"),
        F.col("p_size").cast("double").alias("unit_qty"), unit.alias("unit_of_measure"), (F.col("p_partkey") % 11 == 0).alias("is_weighable"), F.col("p_type").alias("category"),
        (F.col("l_returnflag") != "R").alias("is_active"), F.col("l_shipdate").alias("scraped_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.year("l_shipdate").alias("batch"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.element_at(F.array(*map(F.lit, GOODS)), (F.col("p_partkey") % len(GOODS) + 1).cast("int")).alias("goods"),
    )
    size = normalize_unit(F.col("unit_of_measure"), F.col("unit_qty"))
    return rows.withColumn("_unit", size).withColumns({"unit_qty_si": F.col("_unit.qty_si"), "unit_dimension": F.col("_unit.dimension")}).drop("_unit")


def with_deals(rows: DataFrame) -> DataFrame:
    """Offers with promotions: every third line a bundle, else a reduction where there is a sale; every 17th order states a wrong price."""
    qty = (F.col("line") % 2 + 2).cast("int")
    bundle, wrong = F.col("line") % 3 == 0, F.when(F.col("order_id") % 17 == 0, F.lit(1.0)).otherwise(0.0)
    total = F.when(bundle, (F.col("price") * qty * F.lit("0.90").cast("decimal(3,2)")).cast(MONEY)).otherwise(F.col("sale_price"))
    each = F.when(bundle, F.round(total.cast("double") / qty, 4)).otherwise(total.cast("double")) + wrong
    deal = F.struct(F.lit(True).alias("has_deal"), F.when(bundle, "multi_buy").otherwise("price_reduction").alias("deal_type"), F.lit("deal").alias("deal_description"), total.alias("deal_price"), F.when(bundle, qty).otherwise(1).alias("deal_min_qty"), each.alias("deal_price_per_unit"), F.lit(None).cast("double").alias("price_per_base_unit"), F.lit(None).cast("double").alias("price_per_base_unit_deal")).cast(DEAL)
    return rows.withColumn("deal", F.when(bundle | F.col("sale_price").isNotNull(), deal)).withColumn("discount_percent", F.lit(None).cast("double"))


#: As many stores go to all tasks at most; more are joined by a shuffle.
MOST_STORES = 500_000


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation's name, broadcast unless they are very many."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = supplier.select("s_suppkey", "s_name", "s_nationkey").join(F.broadcast(nation.select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))
    return F.broadcast(rows) if supplier.count() <= MOST_STORES else rows


def _one_of_each(line: DataFrame, store: str, order: list) -> DataFrame:
    """The first line of each part and store in the given order. Lines are dealt by part, so the join with parts that follows deals nothing again; columns that a query doesn't use aren't dealt at all."""
    place = F.row_number().over(Window.partitionBy("l_partkey", store).orderBy(*order))
    return line.repartition("l_partkey").withColumn("_n", place).where("_n = 1").drop("_n")


def latest_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each store and product: the last that came.

    The last is found among line items, before they are joined with products, stores and chains; what
    a query doesn't use isn't made at all.
    """
    line = table(spark, sf_dir, "lineitem")
    return offers(spark, sf_dir, _one_of_each(line, "l_suppkey", [F.desc("l_shipdate"), F.desc(F.col("l_orderkey") * 10 + F.col("l_linenumber"))]))


def first_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each chain and product: the first that came, found among line items too."""
    line, supplier = table(spark, sf_dir, "lineitem"), stores(spark, sf_dir).select("s_suppkey", F.col("s_nationkey").alias("l_nationkey"))
    keyed = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).drop("s_suppkey")
    return offers(spark, sf_dir, _one_of_each(keyed, "l_nationkey", [F.col("l_shipdate"), F.col("l_orderkey") * 10 + F.col("l_linenumber")]))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("chain"), key.alias("store_id"), F.col("s_name").alias("store_name"), (29.5 + (key * 37 % 350) / 100).alias("lat"), (34.2 + (key * 53 % 150) / 100).alias("lng"))


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a shopping list; of lines with one number the least part and the largest quantity."""
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("item_id"))
    return lines.agg(F.min("l_partkey").alias("canonical_product_id"), F.max("l_quantity").alias("quantity")).withColumn("group_key", F.lit(None).cast("string"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines of chains' refreshes."""
    return table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("chain"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("products"), "value")


#: The same in SQL, as common table expressions.
OFFERS_SQL = """
units AS (SELECT p_partkey, ['g','kg','ml','litre','unit'][CAST(p_partkey % 5 AS INT) + 1] AS unit_of_measure,
    CASE WHEN p_partkey % 5 IN (1, 3) THEN 1000.0 ELSE 1.0 END AS si, CASE WHEN p_partkey % 5 < 2 THEN 'mass' WHEN p_partkey % 5 < 4 THEN 'volume' ELSE 'count' END AS unit_dimension FROM part),
priced AS (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS regular_price, CASE WHEN l_discount > 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) END AS sale_price FROM lineitem),
offers AS (SELECT n_name AS chain, l_suppkey AS store_id, s_name AS store_name, l_partkey AS product_id, p_name || ' ' || p_type || ' ' || p_size || ' ' || u.unit_of_measure AS name, p_brand AS brand,
    CASE WHEN p.p_partkey % 4 <> 0 THEN '729' || lpad(CAST(p.p_partkey AS VARCHAR), 9, '0') END AS barcode, regular_price, sale_price, coalesce(sale_price, regular_price) AS price,
    CAST(p_size AS DOUBLE) AS unit_qty, u.unit_of_measure, p.p_partkey % 11 = 0 AS is_weighable, p_type AS category, l_returnflag <> 'R' AS is_active, l_shipdate AS scraped_at,
    l_orderkey * 10 + l_linenumber AS seq, year(l_shipdate) AS batch, l_orderkey AS order_id, l_linenumber AS line, CAST(p_size AS DOUBLE) * si AS unit_qty_si, u.unit_dimension
    FROM priced JOIN part p ON l_partkey = p.p_partkey JOIN units u ON u.p_partkey = p.p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
latest AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY scraped_at DESC, seq DESC) AS n FROM offers) WHERE n = 1),
branches AS (SELECT n_name AS chain, s_suppkey AS store_id, s_name AS store_name, 29.5 + (s_suppkey * 37 % 350) / 100 AS lat, 34.2 + (s_suppkey * 53 % 150) / 100 AS lng FROM supplier JOIN nation ON s_nationkey = n_nationkey),
list_items AS (SELECT l_orderkey AS list_id, l_linenumber AS item_id, min(l_partkey) AS canonical_product_id, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)"""
DEALS_SQL = """
deals AS (SELECT *, line % 3 = 0 AS bundle, CASE WHEN line % 3 = 0 THEN CAST(line % 2 + 2 AS INT) ELSE 1 END AS min_qty, line % 3 = 0 OR sale_price IS NOT NULL AS has_deal,
    CASE WHEN line % 3 = 0 THEN CAST(price * CAST(line % 2 + 2 AS INT) * CAST(0.90 AS DECIMAL(3,2)) AS DECIMAL(18,2)) ELSE sale_price END AS deal_price FROM latest)"""
