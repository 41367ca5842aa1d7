"""Versions of tables: switches, writes in proportion to a batch, and the refresh jobs."""

import datetime as dt
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import status
from shelfwise.operators.catalog import build_groups, group_members
from shelfwise.operators.tables import Catalog, Lost, prune, refresh_deals, refresh_prices, upsert_offers

SCHEMA = "chain string, store_id string, product_id string, name string, price double, sale_price double, unit_dimension string, unit_qty_si double, is_weighable boolean, is_active boolean, seq int"
SUGAR, MILK = "סוכר לבן", "חלב 3%"
NOW = dt.datetime(2026, 1, 2)


def rows(spark, *offers):
    """(chain, store, product, price, seq), sugar unless the product begins with m."""
    return spark.createDataFrame([(c, s, p, MILK if p[0] == "m" else SUGAR, x, None, "volume" if p[0] == "m" else "mass", 1000.0, False, True, n) for c, s, p, x, n in offers], SCHEMA)


def results(spark, *told):
    return spark.createDataFrame(list(told), "chain string, error string")


def files(folder):
    return {str(p) for p in Path(folder).rglob("part-*.parquet")}


def groups_hold(tables):
    """The groups that were kept up to date are those of all offers."""
    plain = build_groups(group_members(tables.read("offers")))
    columns = ["group_key", "family", "label", "cheapest_price", "offer_count", "chain_count"]
    assert sorted(map(tuple, tables.read("groups").select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_a_small_batch_writes_its_parts_only(spark, tmp_path):
    tables = Catalog(spark, str(tmp_path / "c"), buckets=8)
    many = rows(spark, *((c, str(s), f"{k}{p}", 1.0 + p, p) for c in "ab" for s in range(4) for k in "xm" for p in range(25)))
    upsert_offers(tables, many, ["seq"])
    before, first = files(tmp_path / "c"), tables.current()
    assert len({f for f in before if "/offers/" in f}) == 16
    upsert_offers(tables, rows(spark, ("a", "1", "x3", 0.5, 99)), ["seq"])
    new = files(tmp_path / "c") - before
    assert len([f for f in new if "/offers/" in f]) == 1 and len([f for f in new if "/group_members/" in f]) == 1
    changed = {(r.chain, r.store_id, r.product_id): r.price for r in tables.read("offers").collect()}
    assert len(changed) == 400 and changed["a", "1", "x3"] == 0.5 and changed["a", "1", "x4"] == 5.0
    assert {(r.chain, r.store_id, r.product_id): r.price for r in tables.read("offers", first).collect()}["a", "1", "x3"] == 4.0
    assert {r.chain for r in tables.read("offers", chains=["b"]).collect()} == {"b"}
    assert len(tables.read("offers", chains=["b"]).inputFiles()) == 8
    groups_hold(tables)


def test_of_two_writers_one_wins(spark, tmp_path):
    tables = Catalog(spark, str(tmp_path / "c"))
    upsert_offers(tables, rows(spark, ("a", "1", "x", 1.0, 1)), ["seq"])
    n, _ = tables.head()
    for version in ("one", "two"):
        tables.stage({"offers": rows(spark, ("a", "1", version, 1.0, 1))}, version, {"offers": ["chain", "store_id", "product_id"]})
    won, gate = {}, threading.Barrier(2)

    def switch(version):
        gate.wait()
        won[version] = Catalog(spark, tables.folder).swap(version, after=n)

    writers = [threading.Thread(target=switch, args=(v,)) for v in ("one", "two")]
    [w.start() for w in writers], [w.join() for w in writers]
    assert sorted(won.values()) == [False, True] and won[tables.current()] and tables.head()[0] == n + 1
    assert not tables.swap("one", after=n) and not [p for p in Path(tables.folder, "pointer").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_the_loser_starts_again_from_what_won(spark, tmp_path):
    tables = Catalog(spark, str(tmp_path / "c"))
    upsert_offers(tables, rows(spark, ("a", "1", "x", 1.0, 1)), ["seq"])
    calls = []

    def change(version, manifest):
        calls.append(version)
        if len(calls) == 1:  # meanwhile another writer comes
            upsert_offers(Catalog(spark, tables.folder), rows(spark, ("b", "1", "y", 2.0, 2)), ["seq"])
        return manifest | {"note": tables.write(version, "note", spark.range(len(calls)))}

    tables.transact(change)
    assert len(calls) == 2 and tables.read("note").count() == 2 and {r.chain for r in tables.read("offers").collect()} == {"a", "b"}
    assert not Path(tables.folder, calls[0]).exists()

    def always_late(version, manifest):
        upsert_offers(Catalog(spark, tables.folder), rows(spark, ("b", "1", "y", 3.0, 3)), ["seq"])
        return manifest

    with pytest.raises(Lost):
        tables.transact(always_late, attempts=2)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    tables = Catalog(spark, str(tmp_path / "c"))
    batch = rows(spark, ("a", "1", "x", 1.0, 1), ("a", "1", "x", 2.0, 2), (None, "1", "z/ü", 3.0, 1))
    for _ in range(2):
        assert upsert_offers(tables, batch, ["seq"], "batch-0") == "batch-0"
    assert tables.head() == (1, "batch-0") and sorted(r.price for r in tables.read("offers").collect()) == [2.0, 3.0]


def test_old_versions_go_but_not_what_newer_ones_name(spark, tmp_path):
    tables = Catalog(spark, str(tmp_path / "c"), buckets=4)
    assert prune(tables) == [] and tables.current() is None
    for i in range(5):
        upsert_offers(tables, rows(spark, ("a", "1", f"x{i}", float(i), i)), ["seq"], f"v{i}")
    assert sorted(prune(tables, keep=2)) == ["v0", "v1", "v2"]
    assert sorted(r.product_id for r in tables.read("offers").collect()) == [f"x{i}" for i in range(5)]
    assert tables.read("offers", "v3").count() == 4
    assert prune(tables, keep=2) == [] and tables.pointers() == [4, 5]


def test_price_refresh_switches_all_at_once(spark, tmp_path):
    tables = Catalog(spark, str(tmp_path / "c"))
    first = rows(spark, ("a", "1", "x", 5.0, 1), ("a", "1", "x", 4.0, 2), ("b", "1", "y", 6.0, 3), ("b", "1", "m", 7.0, 3))
    run = refresh_prices(tables, first, results(spark, ("a", None), ("b", None)), "r1", now=NOW)
    assert (run["status"], run["chains_scraped"], run["chains_failed"], run["products_upserted"], run["errors"]) == ("done", ["a", "b"], [], 3, [])
    assert sorted(r.price for r in tables.read("offers").collect()) == [4.0, 6.0, 7.0]
    groups_hold(tables)
    sugar = [g for g in tables.read("groups").collect() if g.offer_count == 2]
    assert [(g.cheapest_price, g.chain_count) for g in sugar] == [(4.0, 2)]
    at = tables.head()
    assert refresh_prices(tables, first, results(spark, ("a", None)), "r1", now=NOW)["products_upserted"] == 3 and tables.head() == at  # told already

    partial = refresh_prices(tables, rows(spark, ("a", "1", "x", 9.0, 1)), results(spark, ("a", "slow"), ("b", None), ("c", "timed out")), "r2", now=NOW)
    assert partial["status"] == "done" and partial["chains_failed"] == ["b", "c"]
    assert partial["errors"][:3] == ["a: slow", "b: no products returned", "c: timed out"] and partial["errors"][3].startswith("partial_refresh")
    assert [r.price for r in tables.read("offers").collect()] == [9.0]

    none = refresh_prices(tables, first.limit(0), results(spark, ("a", "down")), "r3", now=NOW)
    assert none["status"] == "failed" and none["errors"][0] == "a: down" and none["errors"][1].startswith("swap_skipped: no products")
    assert [r.price for r in tables.read("offers").collect()] == [9.0]
    logged = {r.run_id: r for r in tables.read("runs").collect()}
    assert {k: (r.kind, r.status) for k, r in logged.items()} == {"r1": ("prices", "done"), "r2": ("prices", "done"), "r3": ("prices", "failed")}
    assert logged["r2"].errors == partial["errors"] and logged["r3"].errors == none["errors"]


def test_a_small_catalogue_does_not_replace_a_large_one(spark, tmp_path):
    tables = Catalog(spark, str(tmp_path / "c"), buckets=2)
    large = spark.range(1200).select(F.lit("a").alias("chain"), F.lit("1").alias("store_id"), F.concat(F.lit("x"), "id").alias("product_id"), F.lit(SUGAR).alias("name"), F.lit(1.0).alias("price"), F.lit(None).cast("double").alias("sale_price"), F.lit("mass").alias("unit_dimension"), F.lit(1000.0).alias("unit_qty_si"), F.lit(False).alias("is_weighable"), F.lit(True).alias("is_active"), F.lit(1).alias("seq"))
    assert refresh_prices(tables, large, results(spark, ("a", None)), "r1")["status"] == "done"
    run = refresh_prices(tables, large.limit(499), results(spark, ("a", None), ("b", "down")), "r2")
    assert run["status"] == "failed" and run["errors"][-1] == "swap_skipped: 499 products staged, 1200 active, at least 500 needed"
    assert tables.read("offers").count() == 1200
    assert refresh_prices(tables, large.limit(500), results(spark, ("a", None), ("b", "down")), "r3")["status"] == "done" and tables.read("offers").count() == 500


def test_deal_refresh(spark, tmp_path):
    tables = Catalog(spark, str(tmp_path / "c"))
    offers = rows(spark, ("a", "1", "x", 5.0, 1), ("a", "1", "y", 6.0, 1), ("b", "1", "x", 7.0, 1), ("c", "1", "x", 8.0, 1)).withColumn("sale_price", F.lit(4.5))
    refresh_prices(tables, offers, results(spark, *((c, None) for c in "abc")), "r1", now=NOW)
    before = files(tmp_path / "c")
    deals = rows(spark, ("a", "1", "x", 3.0, 1), ("a", "1", "new", 1.0, 1), ("b", "1", "x", 2.0, 1)).withColumn("sale_price", F.lit(2.5))
    run = refresh_deals(tables, deals, results(spark, ("a", None), ("b", "half of it"), ("c", None)), "r2", now=NOW)
    assert (run["status"], run["chains_scraped"], run["chains_failed"], run["products_upserted"]) == ("done", ["a"], ["b", "c"], 1)
    assert run["errors"] == ["b: half of it", "c: no products returned"]
    found = {(r.chain, r.product_id): (r.price, r.sale_price) for r in tables.read("offers").collect()}
    assert found == {("a", "x"): (3.0, 2.5), ("a", "y"): (6.0, None), ("b", "x"): (7.0, 4.5), ("c", "x"): (8.0, 4.5)}
    assert not [f for f in files(tmp_path / "c") - before if "/offers/_part=6" in f and "/offers/_part=61-" not in f]  # chain a's parts only
    groups_hold(tables)
    failed = refresh_deals(tables, deals.limit(0), results(spark, ("a", "down")), "r3", now=NOW)
    assert failed["status"] == "failed" and failed["errors"] == ["a: down"] and {r.run_id for r in tables.read("runs").collect()} == {"r1", "r2", "r3"}
    assert refresh_deals(tables, deals.limit(0), results(spark), "r4", now=NOW)["errors"] == ["deal_replace_skipped: no deals came"]


def test_status_tells_progress(spark):
    runs = spark.createDataFrame([("r1", "prices", "done", NOW, NOW), ("r2", "deals", "running", NOW, None)], "run_id string, kind string, status string, started_at timestamp, finished_at timestamp")
    chains = spark.createDataFrame([("a", 3), ("b", 4)], "chain string, product_count long")
    lines = spark.createDataFrame([("r2", "a", "started", 0), ("r2", "a", "fetched", 10), ("r2", "b", "started", 0), ("r2", "a", "done", 10), ("r1", "a", "done", 99)], "run_id string, chain string, step string, products long")
    one = status.catalog_status(runs, chains, F.lit(NOW), lines).first()
    assert (one.active.run_id, one.active.progress_percent, one.active.chains_done, one.active.chains_started, one.active.products) == ("r2", 50, 1, 2, 10)
    assert one.chains == {"a": 3, "b": 4} and one.fresh == {"prices": True}
    idle = status.catalog_status(runs.where("status = 'done'"), chains, F.lit(NOW), lines).first()
    assert idle.active is None
    assert status.catalog_status(runs.limit(0), chains, F.lit(NOW)).first().last_status is not None
