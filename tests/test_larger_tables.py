"""What only shows in larger tables: queries with SQL on copies of the tables with other keys, and rows that plans make."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import plain

from shelfwise.functions.deals import DEAL
from shelfwise.operators import basket, catalog, search
from shelfwise.plans import offers
from shelfwise.plans import queries as plans
from shelfwise.plans import rules  # noqa: F401  registers its queries with the others

KEYS = {"part": ["p_partkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey"], "lineitem": ["l_partkey", "l_suppkey", "l_orderkey"], "nation": []}


@pytest.fixture(scope="module")
def copied(spark, sf_dir, tmp_path_factory):
    """make(shift, copies) gives a folder of as many copies of the tables, whose keys are shifted on from shift."""

    def make(shift: int, copies: int = 1, sf_dir: str = sf_dir) -> str:
        folder = tmp_path_factory.mktemp("copies")
        for name, keys in KEYS.items():
            rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            if keys:
                rows = rows.crossJoin(spark.range(copies).withColumnRenamed("id", "_i")).withColumns({k: F.col(k) + shift + F.col("_i") * 100_000 for k in keys}).drop("_i")
            rows.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return make


def assert_as_sql(spark, name: str, folder: str) -> None:
    tables = duckdb.connect()
    for table in KEYS:
        tables.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = plans.QUERIES[name](spark, folder)
    theirs = tables.sql(f"SELECT {', '.join(found.columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in found.collect()) == sorted(tuple(map(plain, r)) for r in theirs)


@pytest.fixture(scope="module")
def millions(copied):
    """Parts' numbers have seven digits, as many as a short barcode."""
    return copied(1_000_000, sf_dir="/root/testdata/sf0.01")  # the smallest tables have no anchors


def test_numbers_of_seven_digits_are_no_barcodes(spark, millions):
    assert_as_sql(spark, "barcode_matches", millions)


def test_numbers_of_seven_digits_are_no_keys_of_references(spark, millions):
    assert_as_sql(spark, "reference_catalog", millions)


def _top(frame) -> str:
    """The first node of the optimised plan."""
    return frame._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]


PRODUCT = "canonical_product_id long, barcode_digits string, match_key string, normalized_name string, normalized_brand string, unit_qty_si double, unit_dimension string"


def test_pairs_are_told_once_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PAIRED", 7)  # a class has several shares
    rows = [(i, "729" if i % 2 else "", f"k{i % 5}" if i < 20 else None, "milk" if i % 3 else "", "b", 1.0 if i % 4 else None, None) for i in range(60)]
    found = catalog.equivalent_products(spark.createDataFrame(rows, PRODUCT))

    def same(a, b):
        return a[0] == b[0] or (a[1] and a[1] == b[1]) or (a[2] and a[2] == b[2]) or (a[3] and a[3:6] == b[3:6])

    assert sorted(map(tuple, found.collect())) == sorted((a[0], b[0]) for a in rows for b in rows if same(a, b))
    assert not _top(found).startswith("Aggregate")


def test_equal_texts_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(search, "TOLD", 7)
    products = spark.range(60).select(F.col("id").alias("canonical_product_id"), F.when(F.col("id") % 2 == 0, "red widget b").otherwise("blue gadget b").alias("search_text"))
    queries = spark.createDataFrame([(1, "Red Widget"), (2, "red  widget"), (3, "b gadget"), (4, "red gadget"), (5, "")], "query_id long, query string")
    even, odd = range(0, 60, 2), range(1, 60, 2)
    many = search.search_many(products, queries)
    assert sorted(map(tuple, many.collect())) == sorted([(q, i) for q in (1, 2) for i in even] + [(3, i) for i in odd])
    alike = search.similar_many(products, queries, least=0.6)
    assert sorted(r[:2] for r in alike.collect()) == sorted([(q, i) for q in (1, 2) for i in even] + [(3, i) for i in odd])
    for frame in (many, alike):  # words and trigrams are made of the two texts, not of 60 products
        made = frame._jdf.queryExecution().analyzed().toString()
        assert "min(canonical_product_id" in made


def test_columns_that_are_not_used_are_not_dealt(spark, sf_dir):
    for rows in (offers.latest_offers(spark, sf_dir), offers.first_offers(spark, sf_dir)):
        plan = rows.select("store_id", "product_id")._jdf.queryExecution().optimizedPlan().toString().split("\n")
        dealt = [below for above, below in zip(plan, plan[1:]) if "RepartitionByExpression" in above]
        assert dealt and not any("l_extendedprice" in line or "l_returnflag" in line for line in dealt)


def test_detail_of_products_with_shared_and_own_keys(spark):
    rows = [(1, "729", "a", "milk", "b", 1.0, None), (2, "729", "b", "tea", "b", 1.0, None), (3, "", "c", "tea", "b", 1.0, None), (4, "", "d", "salt", "b", 1.0, None), (5, "", "e", "", "b", 1.0, None)]
    sold = [(i, chain, 10 * i, i, float(price), i == 3) for i, chain, price in ((1, "x", 5), (2, "x", 4), (2, "y", 7), (3, "y", 6), (4, "x", 9))]
    found = catalog.product_detail(spark.createDataFrame(rows, PRODUCT), spark.createDataFrame(sold, "canonical_product_id long, chain string, store_id long, product_id long, price double, is_weighable boolean"))
    assert sorted(map(tuple, found.select("id", "chain", "product_id", "place", "weighable").collect())) == [
        (1, "x", 2, 1, False), (1, "y", 2, 2, False), (2, "x", 2, 1, True), (2, "y", 3, 2, True), (3, "x", 2, 1, True), (3, "y", 3, 2, True), (4, "x", 4, 1, False),
    ]


def test_lines_are_priced_where_their_lists_are(spark, monkeypatch):
    monkeypatch.setattr(basket, "ITEMS", 2)  # several ranges of lists
    schema = f"chain string, store_id long, product_id long, canonical_product_id long, price double, regular_price double, is_weighable boolean, unit_qty_si double, unit_dimension string, deal {DEAL}, is_active boolean"
    rows = [(c, s, 10 * p + k, p, 5.0 + p + s - k, 9.0, p == 2, 500.0, "mass" if p == 2 else "count", None, p != 4) for c, s in (("a", 1), ("b", 1), ("b", 2)) for p in (1, 2, 4) for k in range(1 + s % 2)]
    sold = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([(i, n, float(n + 1) / 2, p) for i in range(6) for n, p in enumerate((1, 2, 3, 4))], "list_id long, item_id int, quantity double, canonical_product_id long")
    found = basket.product_lines(items, sold)
    expected = basket.best_lines(items.join(sold.where("is_active"), "canonical_product_id").withColumn("family", F.lit(None).cast("string")))
    assert found.select("range").distinct().count() > 1
    assert sorted(map(tuple, found.select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))
