"""Payload files of each platform, read and normalised, in batch and as streams."""

import json

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import tables
from shelfwise.sources import normalise, payloads
from shelfwise.streaming import jobs


def put(folder, name, payload):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")
    return str(folder)


def storefront(i, **changes):
    branch = {"id": 5, "isActive": True, "isVisible": True, "isOutOfStock": False, "regularPrice": 10.0, "salePrice": None, "specials": None} | changes
    return {"id": i, "productId": 100 + i, "localName": "חלב 3%", "names": {"1": {"long": "", "short": None}}, "image": {"url": "https://x/{{size}}/7290000000001-{{extension||'jpg'}}"}, "isWeighable": False, "weight": 1.5, "unitOfMeasure": {"names": {"1": "ליטר"}}, "brand": {"names": {"1": " תנובה "}}, "family": {"categories": [{"id": 7}]}, "branch": branch}


def test_storefront(spark, tmp_path):
    special = [{"description": "2 ב-15", "firstLevel": {"type": 2, "firstPurchaseTotal": 2, "firstGift": {"total": 15}}}]
    path = put(tmp_path / "s", "a.json", {"total": 3, "products": [storefront(1), storefront(2, salePrice=8.0), storefront(3, specials=special)]})
    rows = payloads.read_storefront_pages(spark, path, "victory")
    found = {r.product_id: r for r in normalise.normalise_storefront(rows).collect()}
    one, two, three = found["101"], found["102"], found["103"]
    assert (one.name, one.barcode, one.brand, one.store_id, float(one.price), one.deal, one.unit_description) == ("חלב 3%", "7290000000001", "תנובה", "5", 10.0, None, "1.5 ליטר")
    assert (one.unit_qty_si, one.unit_dimension, one.price_per_base_unit, one.category_ids) == (1500.0, "volume", 0.6667, ["7"])
    assert (float(two.price), two.discount_percent, two.deal.deal_type, two.deal.price_per_base_unit_deal) == (8.0, 20.0, "price_reduction", 0.5333)
    assert (three.deal.deal_type, three.deal.deal_price_per_unit) == ("multi_buy", 7.5)
    loose = normalise.normalise_storefront(rows, strict=False, requested_category="9").first()
    assert loose.brand is None and "medium" in loose.image_url


def test_search_graphql_and_catalog(spark, tmp_path):
    item = {"code": "P_1", "name": " סוכר ", "ean": "729", "price": {"value": 10.0}, "categoryPrice": {"value": 8.0}, "promotionMsg": None, "promotionCodes": [], "allCategoryCodes": ["c"], "images": [], "sellingMethod": {"code": "BY_WEIGHT"}, "brand": {"name": "b"}, "unitDescription": "1 קג", "unitForComparison": None, "valueForComparison": None}
    rows = payloads.read_search_pages(spark, put(tmp_path / "q", "a.json", {"pagination": {"pageSize": 20}, "results": [item, item | {"code": "P_2", "promotionMsg": "2 יח' ב- 15 ₪", "categoryPrice": None}, item | {"code": "P_3", "price": None, "categoryPrice": None}]}))
    found = {r.product_id: r for r in normalise.normalise_search(rows).collect()}
    assert sorted(found) == ["P_1", "P_2"]
    assert (float(found["P_1"].sale_price), found["P_1"].is_weighable, found["P_1"].deal.deal_type, found["P_1"].store_id) == (8.0, True, "price_reduction", "global")
    assert (float(found["P_2"].sale_price), found["P_2"].discount_percent, found["P_2"].deal.deal_min_qty) == (7.5, 25.0, 2)

    least = {"minimum_price": {"regular_price": {"value": 10.0}, "final_price": {"value": 9.0}, "discount": {"percent_off": 0}}}
    page = {"data": {"products": {"items": [{"id": "1", "sku": "729", "name": "x", "by_kilo": 0, "item_unit": "גרם", "categories": [{"id": "3"}], "price_range": least}]}}}
    folder = put(tmp_path / "g", "a.json", page)
    put(tmp_path / "g", "b.json", {"errors": [{"message": "no"}]})
    (one,) = normalise.normalise_graphql(payloads.read_graphql_pages(spark, folder), "s").collect()
    assert (one.barcode, float(one.sale_price), one.discount_percent, one.unit_dimension, one.unit_qty_si) == ("729", 9.0, None, "mass", None)

    goods = {"id": 5, "name": "יוגורט", "barcode": 7290000000001, "price": {"price": 12.0}, "prop": {"by_kilo": 0}, "gs": {"BrandName": "b", "Net_Content": {"UOM": "גרם", "value": "4*140"}}, "sale": [{"scm": 10.0, "name": "s"}], "images": {"small": ""}, "department": {"id": 1}, "group_id": 2, "subGroup": {"id": 1}}
    folder = put(tmp_path / "c", "a.json", {"total": 2, "data": [goods, goods | {"id": 6, "prop": {"by_kilo": 1}, "sale": None}]})
    put(tmp_path / "c", "b.json", "[1, 2]")
    found = {r.product_id: r for r in normalise.normalise_catalog(payloads.read_catalog_pages(spark, folder), "1314").collect()}
    assert (found["5"].unit_qty_si, float(found["5"].sale_price), found["5"].category_ids) == (560.0, 10.0, ["1", "2"])
    assert (found["6"].unit_qty_si, found["6"].unit_dimension, found["6"].is_weighable) == (None, "mass", True)


def test_other_files(spark, tmp_path):
    items = [{"id": "prev"}, {"id": "our_1", "value": "v", "label": "l", "parts": {"manufacturer_and_barcode": "יצרן: אסם, ברקוד: 7290000000001"}}, {"id": "next"}]
    (one,) = normalise.compare_attributes(payloads.read_autocomplete(spark, put(tmp_path / "a", "a.json", items))).collect()
    assert (one.id, one.has_prev, one.has_next, one.barcode, one.brand, one.is_weighable) == ("our_1", True, True, "7290000000001", "אסם", True)
    with pytest.raises(Exception, match="not a list"):
        payloads.read_autocomplete(spark, put(tmp_path / "b", "a.json", {"x": 1})).collect()
    leaf = {"id": "category-node-7", "name": "n", "is_category": True, "status": 1}
    tree = leaf | {"id": "category-node-1", "children": [leaf, leaf | {"id": "category-node-8", "status": 0}, leaf | {"id": "x-9"}, leaf | {"id": "category-node-2", "children": [leaf | {"id": "category-node-3"}]}]}
    assert sorted(r.category_id for r in payloads.read_category_tree(spark, put(tmp_path / "t", "a.json", tree)).collect()) == ["3", "7"]
    folder = put(tmp_path / "n", "a.json", '{"store_id": "1", "name": "n", "internet_id": "5", "lat": 99, "lng": 1}\n{"store_id": "2", "internet_id": null}\n{"store_id": "3", "internet_id": "x"}')
    (branch,) = normalise.branch_payload(payloads.read_branches(spark, folder, "c")).collect()
    assert (branch.store_id, branch.lat, branch.geocode_status) == ("1", None, None)
    assert payloads.demo_products(spark).count() == 15
    put(tmp_path / "h", "x.html", "<html>1</html>")
    assert payloads.read_pages(spark, str(tmp_path / "h")).first().html == "<html>1</html>"
    products = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "c"])], "seq long, ids array<string>")
    harvested = payloads.harvest_categories(products, F.col("ids"), ["seq"]).orderBy("first_seen")
    assert [r.category_id for r in harvested.collect()] == ["b", "a", "c"]


def test_latest_snapshot(spark, tmp_path):
    import os

    folder = put(tmp_path / "z", "reference_victory_1.json", '{"chain": "victory", "product_id": "old"}')
    put(tmp_path / "z", "reference_victory_2.json", '{"chain": "victory", "product_id": "new"}')
    os.utime(tmp_path / "z" / "reference_victory_1.json", (1, 1))
    assert [r.product_id for r in payloads.read_latest_snapshot(spark, folder).collect()] == ["new"]


def test_streams(spark, tmp_path):
    schema = "chain string, store_id string, product_id string, price double, seq int"
    folder = tmp_path / "in"
    put(folder, "1.json", '{"chain": "a", "store_id": "1", "product_id": "x", "price": 1.0, "seq": 1}\n{"chain": "a", "store_id": "1", "product_id": "y", "price": 2.0, "seq": 2}')
    catalog = tables.Catalog(spark, str(tmp_path / "catalog"))
    for n in (2, 3):
        stream = spark.readStream.schema(schema).json(str(folder))
        jobs.ingest_payloads(stream, catalog, lambda rows: rows, str(tmp_path / "check")).awaitTermination(120)
        put(folder, f"{n}.json", f'{{"chain": "a", "store_id": "1", "product_id": "x", "price": {n}.5, "seq": {n}}}')
    jobs.ingest_payloads(spark.readStream.schema(schema).json(str(folder)), catalog, lambda rows: rows, str(tmp_path / "check")).awaitTermination(120)
    assert sorted((r.product_id, r.price) for r in catalog.read("offers").collect()) == [("x", 3.5), ("y", 2.0)]

    logs = put(tmp_path / "logs", "1.json", '{"chain": "a", "products": 3}\n{"chain": "a", "products": 4}\n{"chain": "b", "products": 1}')
    query = jobs.live_progress(spark.readStream.schema("chain string, products long").json(logs)).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("progress").collect())) == [("a", 7, 2), ("b", 1, 1)]

    seen = put(tmp_path / "pages", "1.json", "\n".join(f'{{"chain": "a", "store_id": "1", "product_id": "{p}", "scraped_at": "2026-01-01T00:0{i}:00"}}' for i, p in enumerate("xyx")))
    rows = spark.readStream.schema("chain string, store_id string, product_id string, scraped_at timestamp").json(seen)
    query = jobs.dedupe_pages(rows).writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.product_id for r in spark.table("deduped").collect()) == ["x", "y"]


def test_states_of_chains_with_late_lines_and_timeouts(spark, tmp_path):
    folder, check = tmp_path / "lines", str(tmp_path / "check")
    schema = "run_id string, chain string, step string, products long, ts timestamp"
    line = lambda chain, step, n, at: f'{{"run_id": "r", "chain": "{chain}", "step": "{step}", "products": {n}, "ts": "2026-01-01T{at}:00"}}'
    out: list = []

    def run(n, *lines):
        put(folder, f"{n}.json", "\n".join(lines))
        states = jobs.chain_states(spark.readStream.schema(schema).json(str(folder)))
        query = states.writeStream.outputMode("update").foreachBatch(lambda batch, _: out.append({(r.chain, r.step, r.products, r.error) for r in batch.collect()})).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        told = set().union(*out)
        out.clear()
        return told

    first = run(1, line("a", "fetched", 7, "10:02"), line("a", "started", 0, "10:00"), line("b", "started", 0, "10:01"))
    assert first == {("a", "fetched", 7, None), ("b", "started", 0, None)}
    second = run(2, line("a", "done", 9, "10:30"), line("c", "started", 0, "10:31"))
    assert ("a", "done", 9, None) in second and ("c", "started", 0, None) in second
    third = run(3, line("d", "started", 0, "11:00"), line("b", "fetched", 3, "09:00"))  # b's line is later than the lateness
    fourth = run(4, line("d", "fetched", 5, "11:01"))
    late = third | fourth
    assert ("b", "failed", 0, "timed out") in late and not [x for x in late if x[0] == "b" and x[2] == 3]
    assert not [x for x in late if x[0] == "a"]  # it had ended: forgotten in silence
