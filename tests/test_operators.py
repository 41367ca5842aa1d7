"""Catalogue, basket, search, coverage, checks and status on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.deals import DEAL
from shelfwise.operators import basket, catalog, checks, coverage, filters, pages, search, status
from shelfwise.operators.tables import write_id_catalog, write_json, write_match_matrix, write_products, write_run_summary

OFFER = f"chain string, store_id string, product_id string, canonical_product_id long, price double, regular_price double, is_weighable boolean, unit_qty_si double, unit_dimension string, deal {DEAL}, is_active boolean"


def deal(kind, price, qty):
    return (True, kind, "d", price, qty, price / qty, None, None)


def offers(spark, rows):
    from decimal import Decimal

    fixed = [(*r[:9], (*r[9][:3], Decimal(str(r[9][3])), *r[9][4:]) if r[9] else None, r[10]) for r in rows]
    return spark.createDataFrame(fixed, OFFER)


def test_basket_goldens(spark):
    rows = offers(spark, [
        ("a", "1", "big", 1, 70.0, 70.0, False, 1000.0, "mass", None, True), ("a", "1", "small", 1, 32.0, 32.0, False, 500.0, "mass", None, True),
        ("b", "1", "pack", 1, 40.0, 40.0, False, 500.0, "mass", deal("multi_buy", 70.0, 2), True), ("c", "1", "loose", 1, 50.0, 60.0, True, 1000.0, "mass", None, True),
    ])
    items = spark.createDataFrame([(1, 1, 1.0, None, "salmon")], "list_id long, item_id long, quantity double, canonical_product_id long, group_key string")
    members = rows.withColumn("group_key", F.lit("salmon")).withColumn("family", F.lit("salmon"))
    candidates = items.drop("canonical_product_id").join(members, "group_key")
    best = {r.chain: r for r in basket.best_lines(candidates).collect()}
    assert (best["a"].product_id, best["a"].line_total, best["a"].package_count, best["a"].deal_applied) == ("small", 64.0, 2, False)
    assert (best["b"].line_total, best["b"].package_count, best["b"].deal_applied) == (70.0, 2, True)
    assert (best["c"].line_total, best["c"].purchased_quantity, best["c"].package_count) == (50.0, 1.0, None)
    half = {r.chain: r for r in basket.best_lines(candidates.withColumn("quantity", F.lit(0.5))).collect()}
    assert (half["c"].line_total, half["c"].purchased_quantity, half["c"].deal_applied) == (25.0, 0.5, True)
    ranked = basket.compare_baskets(items, rows, members).orderBy("place").collect()
    assert [r.chain for r in ranked] == ["c", "a", "b"]


def test_items_and_fractions_of_other_goods(spark):
    rows = offers(spark, [("a", "1", "x", 1, 4.0, 5.0, False, 6.0, "count", deal("multi_buy", 10.0, 3), True)])
    for quantity, total, packs in ((7.0, 24.0, 7), (2.0, 8.0, 2), (1.5, 6.0, None)):
        items = spark.createDataFrame([(1, 1, quantity, 1, None)], "list_id long, item_id long, quantity double, canonical_product_id long, group_key string")
        (line,) = basket.best_lines(items.drop("group_key").join(rows, "canonical_product_id").withColumn("family", F.lit(None).cast("string"))).collect()
        assert (line.line_total, line.package_count) == (total, packs)


def test_nearer_store_wins_and_missing_items_count(spark):
    rows = offers(spark, [("a", s, "x", 1, 4.0, 4.0, False, None, None, None, True) for s in ("1", "2")] + [("b", "1", "x", 1, 3.0, 3.0, False, None, None, None, True), ("a", "1", "y", 2, 9.0, 9.0, False, None, None, None, True), ("a", "2", "y", 2, 9.0, 9.0, False, None, None, None, True)])
    items = spark.createDataFrame([(1, 1, 1.0, 1, None), (1, 2, 1.0, 2, None)], "list_id long, item_id long, quantity double, canonical_product_id long, group_key string")
    branches = spark.createDataFrame([("a", "1", 9.0), ("a", "2", 1.0)], "chain string, store_id string, distance_km double")
    ranked = basket.compare_baskets(items, rows, branches=branches).orderBy("place").collect()
    assert [(r.chain, r.store_id, r.missing, r.complete) for r in ranked] == [("a", "2", 0, True), ("b", "1", 1, False)]
    good, bad = basket.valid_items(items.union(spark.createDataFrame([(1, 3, 0.0, 1, None), (1, 4, 1.0, None, None)], items.schema)))
    assert (good.count(), bad.count()) == (2, 2)
    changed = basket.upsert_items(items, spark.createDataFrame([(1, 9, 5.0, 2, None)], items.schema))
    assert sorted((r.item_id, r.quantity) for r in changed.collect()) == [(1, 1.0), (9, 5.0)]


def test_upserts(spark):
    old = spark.createDataFrame([("a", "1", "x", 1.0), ("a", "1", "y", 2.0)], "chain string, store_id string, product_id string, price double")
    new = spark.createDataFrame([("a", "1", "x", 5.0, 1), ("a", "1", "x", 6.0, 2), ("b", "1", "z", 7.0, 3)], "chain string, store_id string, product_id string, price double, seq int")
    once = catalog.upsert(old, new, catalog.OFFER_KEY, ["seq"])
    assert sorted(r.price for r in once.collect()) == [2.0, 6.0, 7.0]
    assert sorted(catalog.upsert(once, new, catalog.OFFER_KEY, ["seq"]).collect()) == sorted(once.collect())
    branch = "chain string, store_id string, store_name string, lat double, lng double"
    base = spark.createDataFrame([("a", "1", "old", 1.0, 2.0)], branch)
    for change, expected in ((("a", "1", "new", 5.0, None), ("a", "1", "new", 1.0, 2.0)), (("a", "1", "", 5.0, 6.0), ("a", "1", "old", 5.0, 6.0))):
        assert [tuple(r) for r in catalog.upsert_branches(base, spark.createDataFrame([change], branch)).collect()] == [expected]


def test_deals_replace(spark):
    rows = spark.createDataFrame([("a", "1", "x", 5.0, 1.0, "d1"), ("a", "1", "y", 6.0, 2.0, "d2"), ("b", "1", "x", 7.0, 3.0, "d3")], "chain string, store_id string, product_id string, price double, sale_price double, deal string")
    staged = spark.createDataFrame([("a", "1", "x", 4.0, 4.0, "new"), ("a", "9", "q", 1.0, 1.0, "unknown")], rows.schema)
    found = {(r.chain, r.product_id): (r.price, r.sale_price, r.deal) for r in catalog.replace_deals(rows, staged, ["a"]).collect()}
    assert found == {("a", "x"): (4.0, 4.0, "new"), ("a", "y"): (6.0, None, None), ("b", "x"): (7.0, 3.0, "d3")}


def test_equivalents_are_one_hop(spark):
    rows = spark.createDataFrame([(1, "7", "k1", "milk", "b", 1.0, None), (2, "7", "k2", "other", "b", None, None), (3, "", "k3", "other", "b", None, None), (4, "", "k4", "", "b", None, None)], "canonical_product_id long, barcode_digits string, match_key string, normalized_name string, normalized_brand string, unit_qty_si double, unit_dimension string")
    found = sorted(map(tuple, catalog.equivalent_products(rows).collect()))
    assert found == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 4)]
    assert "NestedLoop" not in catalog.equivalent_products(rows)._jdf.queryExecution().toString()


def test_deal_contract(spark):
    base = {"chain": "a", "store_id": "1", "product_id": "x", "regular_price": 10.0, "sale_price": None, "discount_percent": None, "unit_qty_si": None, "unit_dimension": None, "is_weighable": False, "deal": None}
    schema = f"chain string, store_id string, product_id string, regular_price double, sale_price double, discount_percent double, unit_qty_si double, unit_dimension string, is_weighable boolean, deal {DEAL}"
    from decimal import Decimal

    def rules(**changes):
        row = base | changes
        return sorted(r.rule for r in checks.deal_violations(spark.createDataFrame([tuple(row.values())], schema)).collect())

    assert rules() == []
    assert rules(sale_price=8.0, discount_percent=20.0) == ["discounted_without_deal", "percent_without_deal"]
    assert rules(sale_price=8.0, deal=(True, "price_reduction", "d", Decimal(8), 1, 8.0, None, None)) == []
    assert rules(deal=(False, "gift", " ", None, None, None, None, None)) == ["has_deal_not_true", "no_description", "unknown_type"]
    assert rules(deal=(True, "multi_buy", "d", Decimal(12), 2, 5.0, None, None)) == ["multi_buy_per_unit"]
    assert rules(deal=(True, "multi_buy", "d", None, 0, None, None, None)) == ["multi_buy_min_qty", "multi_buy_price"]
    assert rules(deal=(True, "other", "d", Decimal(9), 2, 4.5, None, None)) == []
    assert rules(unit_qty_si=500.0, unit_dimension="mass", deal=(True, "price_reduction", "d", Decimal(8), 1, 8.0, 2.0, 1.6)) == []
    assert rules(unit_qty_si=500.0, unit_dimension="mass", deal=(True, "price_reduction", "d", Decimal(8), 1, 8.0, None, 1.7)) == ["deal_unit_price", "regular_unit_price"]


def test_search(spark):
    schema = "canonical_product_id long, normalized_name string, search_text string"
    rows = spark.createDataFrame([(1, "קוטג 5", "קוטג 5 תנובה"), (2, "גבינה קוטג", "גבינה קוטג"), (3, "חלב", "חלב תנובה"), (4, "", "קוטג")], schema)
    active = rows.select("canonical_product_id", (F.col("canonical_product_id") != 4).alias("is_active"))
    page = search.search_products(rows, active, "קוטג׳").collect()
    assert [(r.canonical_product_id, r["rank"], r.total) for r in page] == [(1, 0, 2), (2, 2, 2)]
    assert search.search_products(rows, active, "קו").count() == 0
    assert [r.canonical_product_id for r in search.search_products(rows, active, "תנובה קוטג").collect()] == [1]
    assert [r.canonical_product_id for r in search.fuzzy_search(rows, "קוטז").collect()] == [1, 2]
    assert search.fuzzy_search(rows, "!!").count() == 0
    queries = spark.createDataFrame([(10, "תנובה חלב"), (11, "nothing")], "query_id long, query string")
    assert [tuple(r) for r in search.search_many(rows, queries).collect()] == [(10, 3)]
    assert search.suggest(rows, active, "קוטג", 50).count() == 2


def test_fuzzy_search_scores_all_candidates(spark):
    rows = spark.range(1500).selectExpr("id as canonical_product_id", "'wire' as normalized_name", "concat('wire no', id) as search_text")
    last = spark.createDataFrame([(9000, "widget", "red widget")], rows.schema)
    assert [r.canonical_product_id for r in search.fuzzy_search(rows.unionByName(last), "widgt").collect()] == [9000]


def test_coverage(spark):
    schema = "chain string, product_id string, name string, brand string, barcode string, unit_dimension string, unit_qty_si double, is_weighable boolean, seq long"
    rows = spark.createDataFrame([
        ("r", "1", "dark chocolate bar", "elite", "7290000000017", "mass", 100.0, False, 1), ("r", "2", "milk chocolate bar big", "elite", "", "mass", 100.0, False, 2), ("r", "3", "tomato soup cup", "osem", "", "mass", 50.0, False, 3),
        ("r", "4", "dark chocolate", None, "7290000000017", "mass", 100.0, False, 4), ("r", "5", "strange thing", "nobody", "", None, None, False, 5),
        ("t", "a", "chocolate", "x", "7290000000017", "mass", 1.0, False, 6), ("t", "b", "bar big chocolate milk", "elite", "", "mass", 100.0, False, 7), ("t", "c", "tomato soup cups", "osem", "", "mass", 50.0, False, 8), ("t", "d", "tomato soup cup", "knorr", "", "mass", 50.0, False, 9),
    ], schema)
    reference = coverage.reference_catalog(rows.where("chain = 'r'"), "r")
    found = {r.name: r for r in reference.collect()}
    assert len(found) == 4 and found["dark chocolate bar"].source_chains == ["r"]
    assert sorted(r.reference_id for r in found.values()) == [f"R{n:06d}" for n in range(1, 5)]
    prepared = coverage.prepared(reference)
    target = coverage.prepared(rows.where("chain = 't'")).select("*", F.col("product_id").alias("target_id"), F.lit("t").alias("target_chain"))
    matches = coverage.match_catalog(prepared, target, ["t"])
    got = {r.name: (r.target_id, r.reason) for r in matches.join(reference.select("reference_id", "name"), "reference_id").collect()}
    assert got == {"dark chocolate bar": ("a", "barcode"), "milk chocolate bar big": ("b", "exact_key"), "tomato soup cup": ("c", "fuzzy"), "strange thing": (None, "no_candidate")}
    (summary,) = coverage.coverage_summary(matches).collect()
    assert (summary.total, summary.matched, summary.missing, summary.coverage_percent, summary.reasons["fuzzy"]) == (4, 3, 1, 75.0, 1)
    assert coverage.match_matrix(matches, ["t"]).columns == ["reference_id", "t_matched", "t_score", "t_reason"]
    assert [r.reason for r in coverage.missing_sample(matches).collect()] == ["no_candidate"]


def test_compare_rows(spark):
    schema = "kind string, row_index int, chain_name string, store_name string, place string, deal_text string, deal_price_text string, row_price_text string, deal_type string"
    left = spark.createDataFrame([("p", 0, "a", "s", "x", "", "", "5.00", "none"), ("p", 1, "a", "s", "x", "", "", "bad", "none"), ("p", 2, "a", "s", "x", "", "", "5.00", "none")], schema)
    right = spark.createDataFrame([("p", 0, "a", "t", "x", "", "", "5.10", "other"), ("p", 1, "a", "s ", "x", "", "", "5.0", "none")], schema)
    found = sorted((r.row_index, r.check) for r in checks.compare_rows(left, right).collect())
    assert found == [(0, "deal_type_mismatch"), (0, "field_mismatch:store_name"), (0, "price_mismatch"), (1, "price_unparseable"), (2, "row_count")]


def test_pages(spark):
    table = '<table class="results-table"><tr><th>h</th></tr><tr><td>Chain</td><td>St<span data-x="q">hidden</span>ore</td><td>Street 1</td><td>Deal: <button class="btn btn-discount" data-discount-desc="2 ב-15.00">15<span data-x="q">0</span>.00</button></td><td>8.00</td></tr><tr class="display_when_narrow"><td>no</td><td>no</td><td>no</td><td>no</td><td>1</td></tr><tr><td>short</td></tr></table>'
    online = '<table class="results-table"><tr><td>Chain</td><td>Web</td><td>https://www.shop.co.il/a</td><td><button class="btn-discount">7.50</button></td><td>9.90</td></tr></table>'
    html = f'<style>span[data-x="q"]{{display:none}}</style>{table}{online}<a href="/p/our_123/45?x=1">p</a><loc>https://s/temp_9%20</loc><a href=\'/z/temp_77\'>t</a>'
    rows = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "x" * 200)], "page_id long, url string, html string")
    found = pages.extract_compare_rows(rows).orderBy("kind").collect()
    assert [(r.kind, r.store_name, r.row_price, r.skipped) for r in found] == [("online", "Web", 9.9, 0), ("physical", "Store", 8.0, 1)]
    assert (found[0].deal.deal_type, found[1].deal.deal_type, found[1].deal.deal_min_qty) == ("price_reduction", "multi_buy", 2)
    assert (found[1].deal_text, found[1].deal_price_text, found[0].deal_text) == ("2 ב-15.00", "15.00", "")
    assert sorted(r.product_id for r in pages.extract_product_ids(rows).collect()) == ["our_123", "temp_77"]
    assert [r.page_id for r in checks.obfuscated_pages(rows, long=100).collect()] == [3]
    hidden = spark.createDataFrame([(9, "​" * 201), (10, "&#8203;" * 201), (11, "​" * 200)], "page_id long, html string")
    assert sorted(r.page_id for r in checks.obfuscated_pages(hidden).collect()) == [9, 10]


def test_status(spark):
    now = dt.datetime(2026, 1, 2)
    runs = spark.createDataFrame([(1, "prices", "done", now - dt.timedelta(hours=30), now - dt.timedelta(hours=29), None), (2, "prices", "failed", now - dt.timedelta(hours=1), None, "x"), (3, "deals", "running", now - dt.timedelta(hours=1), None, None)], "run_id long, kind string, status string, started_at timestamp, finished_at timestamp, error string")
    assert {r.kind: r.run_id for r in status.latest_runs(runs).collect()} == {"prices": 2, "deals": 3}
    assert [(r.kind, r.fresh) for r in status.catalog_fresh(runs, F.lit(now)).collect()] == [("prices", False)]
    assert {r.run_id: r.status for r in status.fail_stale_runs(runs, F.lit(now)).collect()}[3] == "failed"
    assert [status.activation_guard(*x) for x in ((0, 0, True), (1, 10, False), (500, 2000, False), (599, 2000, False), (600, 2000, False), (400, 2000, True))] == [False, True, False, False, True, True]
    counts = spark.createDataFrame([("a", 3)], "chain string, product_count long")
    assert status.catalog_status(runs, counts, F.lit(now)).first().chains == {"a": 3}
    lines = spark.createDataFrame([("a", "page 1 — 20 products"), ("a", "x - 5 products"), ("b", "nothing")], "chain string, line string")
    assert [tuple(r) for r in status.log_product_counts(lines).collect()] == [("a", 25)]


def test_filters(spark):
    rows = spark.createDataFrame([("1", "Red Bull Can", ["a", "b"], "9"), ("2", "Bull", ["c"], "8")], "store_id string, name string, category_ids array<string>, barcode string")
    assert filters.filter_name_words(rows, "can red").count() == 1 and filters.filter_name_words(rows, " ").count() == 2
    assert filters.filter_categories(rows, ["b", "z"]).count() == 1 and filters.filter_barcode(rows, "8").count() == 1
    assert filters.resolve_chains(None, ["a", "b"]) == ["a", "b"] and filters.resolve_chains(["b", "x", " "], ["a", "b"]) == ["b"]
    branches = spark.createDataFrame([("c", "1", "North", None, None, None), ("c", "2", "South", 91.0, 1.0, "not_found"), ("c", "3", "North End", 32.0, 34.0, None)], "chain string, store_id string, store_name string, lat double, lng double, geocode_status string")
    assert sorted(r.store_id for r in filters.resolve_branches(branches, ["2", "north"]).collect()) == ["1", "2", "3"]
    assert filters.resolve_branches(branches, []).count() == 3
    assert [r.store_id for r in filters.missing_geocode(branches, 5).collect()] == ["1"]
    assert [r.lat for r in filters.with_valid_coordinates(branches).orderBy("store_id").collect()] == [None, None, 32.0]
    assert filters.fresh_branches(branches, rows).count() == 2


@pytest.mark.parametrize("order", [1, -1])
def test_order_of_rows_changes_nothing(spark, sf_dir, order):
    from shelfwise.plans import offers as O

    rows = O.offers(spark, sf_dir).orderBy(F.col("seq") * order).where("seq % 7 = 0")
    last = catalog.last_per_key(rows, ["store_id", "product_id"], ["scraped_at", "seq"])
    assert last.count() == rows.select("store_id", "product_id").distinct().count()


def test_the_grid_matches_brute_force(spark):
    items = [(1, 1, 10), (1, 2, 20), (2, 1, 20), (3, 1, 99)]
    lines = [(1, 1, "a", 1, 2.0), (1, 2, "a", 2, 3.0), (1, 1, "b", 3, 1.0), (1, 2, "b", 3, 4.0), (2, 1, "a", 1, 5.0)]
    item_rows = spark.createDataFrame(items, "list_id long, item_id int, canonical_product_id long")
    line_rows = spark.createDataFrame(lines, "list_id long, item_id int, chain string, store_id long, line_total double")
    stores, told = {(x[0], x[2], x[3]) for x in lines}, {x[:4]: x[4] for x in lines}
    expected = sorted((a, b, chain, store, told.get((a, b, chain, store))) for a, b, _ in items for x, chain, store in stores if x == a)
    key = lambda r: tuple(str(x) for x in r)
    found = basket.line_grid(line_rows, item_rows).select("list_id", "item_id", "chain", "store_id", "line_total").collect()
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    names = item_rows.select("list_id", "item_id", F.concat(F.lit("p"), F.col("canonical_product_id").cast("string")).alias("name"))
    missing = {(r.list_id, r.store_id): (r.missing, r.missing_names) for r in basket.missing_items(line_rows, item_rows, names).collect()}
    assert missing == {(1, 1): (1, ["p20"]), (1, 2): (1, ["p10"])}


def test_files_for_other_programs(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", "p", 1.5), ("a", "2", "q", 2.5), ("b", "1", "p", 3.5)], "chain string, store_id string, product_id string, price double")
    write_products(rows, f"{tmp_path}/products")
    assert spark.read.json(f"{tmp_path}/products/chain=a/store_id=2").collect()[0].product_id == "q"
    write_run_summary(rows, f"{tmp_path}/summary")
    assert sorted((r.chain, r.products) for r in spark.read.json(f"{tmp_path}/summary").collect()) == [("a", 1), ("a", 1), ("b", 1)]
    write_json(rows, f"{tmp_path}/all")
    assert spark.read.json(f"{tmp_path}/all").count() == 3
    write_match_matrix(rows, f"{tmp_path}/matrix")
    assert spark.read.option("header", True).csv(f"{tmp_path}/matrix").columns == rows.columns
    write_id_catalog(rows, rows, rows, f"{tmp_path}/ids")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/ids/ids").collect()) == ["p", "p", "q"]


def test_page_data_of_a_product_goes_first(spark):
    page = """<input id='displayed_product_code' value='7290_72900001'><input id="displayed_product_name_and_contents" value=" Cocoa 500 g ">
      <table><tr><td><h3>Cocoa, (יצרן/מותג: Elite, ברקוד: 7290000000123)</h3></td></tr></table><table class="results-table"></table>"""
    rows = spark.createDataFrame([(1, page), (2, "<table><tr><td>no headline</td></tr></table>"), (3, None), (4, "<input id='displayed_product_code' value='temp_555'>")], "page_id long, html string")
    told = pages.compare_products(rows)
    assert {r.page_id: tuple(r)[1:] for r in told.collect()} == {1: ("7290_72900001", "Cocoa 500 g", "Elite", "7290000000123"), 2: (None,) * 4, 3: (None,) * 4, 4: ("temp_555", None, None, None)}
    items = spark.createDataFrame([(1, "old", "Cocoa", "x", None, 1.0), (2, "our_9876543", "Tea", "y", None, 2.0), (3, "our_x1", "Jam", "z", "111", 3.0), (4, "b", "Oil", None, None, 4.0)], "page_id long, product_id string, name string, brand string, barcode string, price double")
    merged = {r.page_id: tuple(r)[1:] for r in pages.with_page_products(items, told).collect()}
    assert merged == {1: ("7290_72900001", "Cocoa 500 g", "Elite", "7290000000123", 1.0), 2: ("our_9876543", "Tea", "y", "9876543", 2.0), 3: ("our_x1", "Jam", "z", "111", 3.0), 4: ("temp_555", "Oil", None, "555", 4.0)}


def test_kinds_of_rows_and_valid_products(spark):
    rows = spark.createDataFrame([("physical", 1), ("online", 2)], "kind string, n int")
    assert [r.n for r in pages.of_kind(rows, "online").collect()] == [2]
    names = "names map<string, struct<long: string, short: string>>, localName string"
    branch = "branch struct<isActive: boolean, isVisible: boolean, isOutOfStock: boolean, regularPrice: double>"
    products = spark.createDataFrame([((({"1": ("a", None)}), None, (True, True, False, 1.0)),), ((({"1": (" ", "b")}), None, (True, False, None, 1.0)),), ((None, "c", (True, True, True, 0.0)),), ((None, " ", (True, True, None, 2.0)),), ((None, "d", (True, True, None, None)),)], f"product struct<{names.replace(' map', ': map').replace('localName string', 'localName: string')}, {branch.replace('branch struct', 'branch: struct')}>")
    assert filters.valid_storefront(products).count() == 1 and filters.priced_storefront(products).count() == 3 and filters.in_stock(products).count() == 4


def test_failed_ranges(spark):
    stats = spark.createDataFrame([(i, 404 if i in (3, 4, 5, 9, 15, 16, 17) else 200) for i in range(20)] + [(30, None), (30, None)], "page_id long, status int").withColumn("ids", F.lit(0))
    assert sorted(map(tuple, pages.failed_ranges(stats, span=16).collect())) == [(3, 5, 3), (9, 9, 1), (15, 15, 1), (16, 17, 2), (30, 30, 1)]
    assert pages.page_summary(stats).first().failed == 9


def test_products_of_one_barcode_make_no_pairs(spark):
    """10,000 products with one barcode: each gets the best offer of every chain, through one row for each chain."""
    n = 10_000
    products = spark.range(n).select(F.col("id").alias("canonical_product_id"), F.lit("729").alias("barcode_digits"), F.concat(F.lit("k"), "id").alias("match_key"), F.lit("").alias("normalized_name"), F.lit("").alias("normalized_brand"), F.lit(None).cast("double").alias("unit_qty_si"), F.lit(None).cast("string").alias("unit_dimension"))
    offers = spark.range(n).select(F.col("id").alias("canonical_product_id"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("chain"), F.lit(1).alias("store_id"), F.col("id").alias("product_id"), (F.lit(1.0) + F.col("id")).alias("price"), F.lit(False).alias("is_weighable"))
    detail = catalog.product_detail(products, offers)
    assert detail.count() == 3 * n
    assert [tuple(r) for r in detail.select("chain", "product_id", "price", "place").distinct().orderBy("place").collect()] == [("c0", 0, 1.0, 1), ("c1", 1, 2.0, 2), ("c2", 2, 3.0, 3)]
    classes = catalog.equivalence_classes(products).where("rule = 'barcode'")
    assert classes.select("class", "size").distinct().collect() == [(0, n)] and classes.count() == n


def test_masks_of_long_lists(spark):
    """More items than a word of a mask holds; an item without a name, and a store that has all."""
    items = spark.createDataFrame([(1, i, i) for i in range(150)], "list_id long, item_id int, canonical_product_id long")
    lines = spark.createDataFrame([(1, i, "a", 1, 1.0) for i in range(150)] + [(1, i, "a", 2, 1.0) for i in range(150) if i % 50] + [(1, 149, "b", 3, 1.0)], "list_id long, item_id int, chain string, store_id long, line_total double")
    names = items.where("item_id <> 50").select("list_id", "item_id", F.format_string("p%03d", "item_id").alias("name"))
    found = {r.store_id: (r.missing, r.missing_names) for r in basket.missing_items(lines, items, names).collect()}
    assert found == {2: (3, ["p000", "p100"]), 3: (149, [f"p{i:03d}" for i in range(149) if i != 50])}


def test_baskets_of_groups_packages_and_fractions(spark):
    """Items of products and of groups; meat by the kilogram in packages, weighed goods, and half an item. Prices are shared by lists."""
    deal = "deal struct<has_deal: boolean, deal_type: string, deal_min_qty: int, deal_price: double>"
    schema = f"canonical_product_id long, chain string, store_id long, product_id long, price double, regular_price double, is_weighable boolean, unit_qty_si double, unit_dimension string, is_active boolean, {deal}"
    offers = spark.createDataFrame([
        (1, "a", 1, 10, 10.0, 12.0, False, 1.0, "count", True, None), (1, "b", 2, 10, 9.0, 9.0, False, 1.0, "count", True, (True, "multi_buy", 2, 15.0)), (2, "a", 1, 20, 30.0, 30.0, True, 1000.0, "mass", True, None), (1, "b", 2, 11, 1.0, 1.0, False, 1.0, "count", False, None),
    ], schema)
    members = spark.createDataFrame([(None, "a", 1, 30, 20.0, 20.0, False, 400.0, "mass", True, None), (None, "a", 1, 31, 60.0, 60.0, False, 1000.0, "mass", True, None), (None, "b", 2, 32, 25.0, 25.0, False, 500.0, "mass", True, None)], schema).withColumns({"group_key": F.lit("chicken|breast"), "family": F.lit("chicken")})
    items = spark.createDataFrame([(1, 1, 1, None, 3.0), (1, 2, 2, None, 1.5), (1, 3, None, "chicken|breast", 1.0), (2, 1, 1, None, 3.0), (2, 2, 1, None, 0.5), (3, 1, None, "nobody", 1.0)], "list_id long, item_id int, canonical_product_id long, group_key string, quantity double")
    prices = basket.priced_wants(items, offers, members)
    assert prices.count() == 2 + 2 + 1 + 2  # (product 1, 3) at two stores, (1, 0.5) at two, (2, 1.5) at one, the group at two
    lines = {(r.list_id, r.item_id, r.store_id): (r.line_total, r.product_id, r.package_count) for r in basket.wanted(items, prices).collect()}
    assert lines == {(1, 1, 1): (30.0, 10, 3), (1, 1, 2): (24.0, 10, 3), (1, 2, 1): (45.0, 20, None), (1, 3, 1): (60.0, 31, 1), (1, 3, 2): (50.0, 32, 2), (2, 1, 1): (30.0, 10, 3), (2, 1, 2): (24.0, 10, 3), (2, 2, 1): (5.0, 10, None), (2, 2, 2): (4.5, 10, None)}
    totals = {(r.list_id, r.chain): (r.total, r.missing, r.place) for r in basket.compare_baskets(items, offers, members).collect()}
    assert totals == {(1, "a"): (135.0, 0, 1), (1, "b"): (74.0, 1, 2), (2, "a"): (35.0, 0, 2), (2, "b"): (28.5, 0, 1)}


def test_candidates_grow_with_the_tables(spark):
    """Rows that references are compared with, among an eighth of the products and all: in proportion, not in the square."""
    from shelfwise.plans import queries

    counts, (references, targets) = [], queries._matched(spark, "/root/testdata/sf0.01")
    for parts in (8, 1):
        reference, target = (f.where(F.pmod(F.xxhash64("name_norm"), F.lit(parts)) == 0) for f in (references, targets))
        key = ["target_chain", "reference_id"]
        r = reference.where("code = ''").select("reference_id", *(F.col(x).alias(f"r_{x}") for x in ("brand_norm", "tokens")))
        t = target.select("target_chain", "target_id", "seq", *(F.col(x).alias(f"t_{x}") for x in ("brand_norm", "tokens")))
        rest = r.withColumn("target_chain", F.explode(F.array(*map(F.lit, queries._TARGETS))))
        found, _, _ = coverage._candidates(rest, t, key)
        counts.append((rest.count(), t.count(), found.count()))
    (few, _, a), (many, _, b) = counts
    assert a > 500 and many > 5 * few and b / a < (many / few) ** 1.2
