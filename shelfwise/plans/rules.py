"""More queries: rules, checks, views and jobs, on tables shaped so that every rule has rows for which it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, deals, links, text, units
from ..operators import basket, catalog, checks, coverage, filters, pages, search, status
from ..sources import normalise, payloads
from . import offers as O
from .queries import ORACLE_SQL, _WITH, _items, _LINES, _lists, _PRODUCTS, _products, _query, _round, _runs

c = F.col


def _pick(number: Column, *values) -> Column:
    """One of the values, in turn."""
    return F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), F.pmod(number, F.lit(len(values))).cast("int"))


def _part(spark, sf_dir) -> DataFrame:
    return O.table(spark, sf_dir, "part")


_SIZES = "sized AS (SELECT p_partkey, p_size * [1, 10, 37, 100][CAST(p_partkey % 4 AS INT) + 1] AS q, ['volume','mass','count','mass'][CAST(p_partkey % 4 AS INT) + 1] AS d, p_partkey % 11 = 0 AS w FROM part)"


@_query(f"""WITH {_SIZES}, b AS (SELECT *, CASE WHEN q > 0 AND q <> 100 THEN CAST(CASE WHEN q < 100 THEN q WHEN q < 1500 THEN round_even(q / 10, 0) * 10 ELSE round_even(q / 50, 0) * 50 END AS BIGINT) END AS v FROM sized)
    SELECT p_partkey, CAST(v AS VARCHAR) AS bucket, CASE d WHEN 'volume' THEN CASE WHEN v % 1000 = 0 THEN v // 1000 || ' ליטר' ELSE v || ' מ״ל' END WHEN 'mass' THEN CASE WHEN v % 1000 = 0 THEN v // 1000 || ' ק״ג' ELSE v || ' גרם' END ELSE v || ' יחידות' END AS size,
        CASE WHEN w THEN CASE WHEN d = 'volume' THEN 'לליטר' ELSE 'לק"ג' END WHEN d = 'mass' THEN 'ל-100 גרם' WHEN d = 'volume' THEN 'ל-100 מ"ל' ELSE 'ליחידה' END AS unit_label FROM b""")
def size_labels(spark, sf_dir):
    """U-5, U-6, U-8."""
    rows = _part(spark, sf_dir).select("p_partkey", (c("p_size") * _pick(c("p_partkey"), 1, 10, 37, 100)).alias("q"), _pick(c("p_partkey"), "volume", "mass", "count", "mass").alias("d"), (c("p_partkey") % 11 == 0).alias("w"))
    bucket = units.qty_bucket_group(c("q"))
    return rows.select("p_partkey", bucket.alias("bucket"), units.size_label(c("d"), bucket).alias("size"), units.comparison_unit_label(c("d"), c("w")).alias("unit_label"))


@_query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'mass' END AS d, CASE WHEN p_partkey % 4 = 1 THEN 0.2 ELSE CAST(p_size AS DOUBLE) END AS q, p_partkey % 5 = 0 AS w,
        ['pack 500g', '1.5 l', NULL, '2kg', 'none', '750 ml'][CAST(p_partkey % 6 AS INT) + 1] AS t FROM part)
    SELECT p_partkey, CASE WHEN d IS NOT NULL AND round_even(q, 0) > 0 THEN 'mass:' || CAST(round_even(q, 0) AS BIGINT) WHEN w THEN 'weighable'
        WHEN t = 'pack 500g' THEN 'mass:500' WHEN t = '2kg' THEN 'mass:2000' WHEN t = '750 ml' THEN 'volume:750' WHEN t = '1.5 l' THEN 'volume:5000' ELSE '' END AS signature FROM p""")
def quantity_signatures(spark, sf_dir):
    """T-9. In "1.5 l" the point is punctuation, so 5 litres are read."""
    k = c("p_partkey")
    return _part(spark, sf_dir).select(k, text.quantity_signature(F.when(k % 3 != 0, "mass"), F.when(k % 4 == 1, 0.2).otherwise(c("p_size").cast("double")), k % 5 == 0, _pick(k, "pack 500g", "1.5 l", F.lit(None).cast("string"), "2kg", "none", "750 ml")).alias("signature"))


@_query("""WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN '' ELSE lower(replace(p_brand, '#', ' ')) END AS r, [lower(replace(p_brand, '#', ' ')), '', 'big ' || lower(replace(p_brand, '#', ' ')), 'br', 'brand', 'other'][CAST(p_partkey % 6 AS INT) + 1] AS t FROM part)
    SELECT p_partkey, r = '' OR t = '' OR r = t OR (length(r) >= 3 AND contains(t, r)) OR (length(t) >= 3 AND contains(r, t)) AS compatible FROM b""")
def compatible_brands(spark, sf_dir):
    """T-12."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit(" ")))
    told = _pick(c("p_partkey"), brand, "", F.concat(F.lit("big "), brand), "br", "brand", "other")
    return _part(spark, sf_dir).select("p_partkey", text.brands_compatible(F.when(c("p_partkey") % 7 == 6, "").otherwise(brand), told).alias("compatible"))


@_query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS a, ['red', 'widget', 'standard'] AS b FROM part)
    SELECT p_partkey, CAST(round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(a), 6) AS DOUBLE) AS contained, CAST(round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) AS DOUBLE) AS jaccard FROM w""")
def word_overlaps(spark, sf_dir):
    """T-11, S-5."""
    a, b = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")), F.array(*map(F.lit, ("red", "widget", "standard")))
    return _part(spark, sf_dir).select("p_partkey", F.round(text.containment(a, b), 6).alias("contained"), F.round(text.jaccard(a, b), 6).alias("jaccard"))


_IMAGES = ["https://x/gs1-products/12/large/72900000{k}-3.jpg", "https://x/a_P_7290{k}_z.png", "https://x/729000{k}-1/b.jpg", "https://x/DEFAULT/{k}.jpg", "https://x/no-image.png", "", "https://x/{{{{size}}}}/{k}.{{{{extension||'jpg'}}}}"]


@_query(f"""WITH u AS (SELECT p_partkey, [{', '.join("'" + u.format(k="' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '").replace("'jpg'", "''jpg''") + "'" for u in _IMAGES)}][CAST(p_partkey % 7 AS INT) + 1] AS url, lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS k, p_partkey % 7 AS n FROM part)
    SELECT p_partkey, CASE n WHEN 0 THEN '72900000' || k WHEN 1 THEN '7290' || k WHEN 2 THEN '729000' || k END AS barcode, CASE WHEN n = 6 THEN 'https://x/large/' || k || '.jpg' ELSE url END AS expanded, CASE WHEN n IN (3, 4, 5) THEN NULL ELSE url END AS displayed FROM u""")
def image_links(spark, sf_dir):
    """T-15, T-16, F-12."""
    k = F.lpad(c("p_partkey").cast("string"), 5, "0")
    made = [reduce(lambda a, b: F.concat(a, k, b), [F.lit(x) for x in u.replace("{{{{", "\0").replace("}}}}", "\1").split("{k}")]) for u in _IMAGES]
    url = F.translate(F.replace(F.replace(_pick(c("p_partkey"), *made), F.lit("\0"), F.lit("{{")), F.lit("\1"), F.lit("}}")), "", "")
    return _part(spark, sf_dir).select("p_partkey", url.alias("url")).select("p_partkey", links.barcode_from_image(c("url")).alias("barcode"), links.expand_image_url(c("url")).alias("expanded"), links.displayable_image(c("url")).alias("displayed"))


_PLACES = "places AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 91.0 WHEN s_suppkey % 5 = 1 THEN NULL ELSE 31.5 END AS lat, CASE WHEN s_suppkey % 5 IN (1, 2) THEN NULL ELSE 34.5 END AS lng, CASE WHEN s_suppkey % 10 = 1 THEN 'not_found' END AS geocode_status FROM supplier)"


def _places(spark, sf_dir) -> DataFrame:
    k = c("s_suppkey")
    return O.table(spark, sf_dir, "supplier").select(F.lit("x").alias("chain"), k.alias("store_id"), "s_name", F.when(k % 5 == 0, 91.0).when(k % 5 == 1, None).otherwise(31.5).alias("lat"), F.when(k % 5 <= 2, F.when(k % 5 == 0, 34.5)).otherwise(34.5).alias("lng"), F.when(k % 10 == 1, "not_found").alias("geocode_status"))


@_query(f"WITH {_PLACES} SELECT k AS store_id, CASE WHEN lat <= 90 AND lng IS NOT NULL THEN lat END AS lat, CASE WHEN lat <= 90 AND lng IS NOT NULL THEN lng END AS lng FROM places")
def valid_places(spark, sf_dir):
    """F-13."""
    return filters.with_valid_coordinates(_places(spark, sf_dir)).select("store_id", "lat", "lng")


@_query(f"WITH {_PLACES} SELECT k AS store_id FROM places WHERE lat IS NULL AND lng IS NULL AND coalesce(geocode_status, '') <> 'not_found' ORDER BY 1 LIMIT 50")
def places_to_geocode(spark, sf_dir):
    """F-11: the first 50."""
    return filters.missing_geocode(_places(spark, sf_dir), 50).select("store_id")


@_query("""WITH a AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Street ' || s_suppkey WHEN 1 THEN ' ' END AS street, CASE WHEN s_suppkey % 2 = 0 THEN 'Haifa, ISRAEL' ELSE '' END AS city, s_name AS n FROM supplier)
    SELECT k AS store_id, concat_ws(', ', nullif(trim(street), ''), nullif(city, ''), n) || CASE WHEN city = '' THEN ', Israel' ELSE '' END AS query FROM a""")
def geocode_queries(spark, sf_dir):
    """T-20."""
    k = c("s_suppkey")
    street, city = F.when(k % 3 == 0, F.concat(F.lit("Street "), k.cast("string"))).when(k % 3 == 1, " "), F.when(k % 2 == 0, "Haifa, ISRAEL").otherwise("")
    return O.table(spark, sf_dir, "supplier").select(k.alias("store_id"), links.geocode_query(street, city, c("s_name")).alias("query"))


@_query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') || '__' || p_partkey WHEN 1 THEN 'item' ELSE replace(p_name, ' ', '_') || '__2' END AS slug,
    CAST(p_partkey % 40 AS VARCHAR) AS city_id, CASE WHEN p_partkey % 4 = 0 THEN '9000' ELSE CAST(p_size AS VARCHAR) END AS street_id FROM part""")
def slugs_and_cities(spark, sf_dir):
    """T-21, T-23."""
    k = c("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("  "), "p_name", F.lit(" #"), k.cast("string"))).when(k % 3 == 1, "??!").otherwise(F.concat("p_name", F.lit("  @2/")))
    city = text.split_city_id(F.concat_ws("_", (k % 40).cast("string"), F.when(k % 4 != 0, c("p_size").cast("string"))), c("p_name"))
    return _part(spark, sf_dir).select("p_partkey", text.safe_slug(name).alias("slug"), city["city_id"].alias("city_id"), city["street_id"].alias("street_id"))


@_query("""WITH r AS (SELECT event_id, event_id % 12 AS done, event_id % 15 AS fetched, event_id % 18 AS started, event_id % 11 AS total, event_type = 'purchase' AS finished FROM events)
    SELECT event_id, CASE WHEN finished THEN 100 WHEN total > 0 THEN CAST(least(greatest(round_even(greatest(CAST(done AS DOUBLE), fetched * 0.7, started * 0.25) / total * 100, 0), 0), 100) AS INT) ELSE 0 END AS percent FROM r""")
def refresh_progress(spark, sf_dir):
    """T-22."""
    e = c("event_id")
    return O.table(spark, sf_dir, "events").select(e, links.progress_percent(e % 12, e % 15, e % 18, e % 11, c("event_type") == "purchase").cast("int").alias("percent"))


def _deal(rows: DataFrame, deal: Column) -> DataFrame:
    told = rows.select("l_orderkey", "l_linenumber", deal.alias("deal"))
    return told.select("l_orderkey", "l_linenumber", "deal.deal_type", "deal.deal_description", c("deal.deal_price").cast("double").alias("deal_price"), "deal.deal_min_qty", c("deal.deal_price_per_unit").alias("per_unit"))


@_query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_orderkey % 6 AS n, CAST(l_linenumber AS INT) + 1 AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE n WHEN 0 THEN 'price_reduction' WHEN 1 THEN 'multi_buy' WHEN 2 THEN 'price_reduction' WHEN 3 THEN 'other' WHEN 4 THEN 'other' END AS deal_type,
        CASE n WHEN 0 THEN 'מחיר מבצע' WHEN 1 THEN q || ' יח'' ב- 20 ₪' WHEN 2 THEN 'ב- 7.5 ₪' WHEN 3 THEN 'new' WHEN 4 THEN 'מבצע' END AS deal_description,
        CASE n WHEN 0 THEN 8.0 WHEN 1 THEN 20.0 WHEN 2 THEN 7.5 END AS deal_price, CASE n WHEN 0 THEN 1 WHEN 1 THEN q WHEN 2 THEN 1 END AS deal_min_qty, CASE n WHEN 0 THEN 8.0 WHEN 1 THEN {_round('20.0 / q', 4)} WHEN 2 THEN 7.5 END AS per_unit FROM m""")
def message_deals(spark, sf_dir):
    """D-2."""
    n, q = c("l_orderkey"), (c("l_linenumber") + 1).cast("int").cast("string")
    message = _pick(n, F.lit(None).cast("string"), F.concat(q, F.lit(" יח' ב- 20 ₪")), "ב- 7.5 ₪", "new", " ", F.lit(None).cast("string"))
    codes = F.when(n % 6 == 4, F.array(F.lit("c1")))
    return _deal(O.table(spark, sf_dir, "lineitem"), deals.deal_from_message(message, codes, F.when(n % 6 >= 4, 12.0).otherwise(8.0), F.lit(10.0)))


@_query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_orderkey % 4 AS n, CAST(l_linenumber AS INT) + 1 AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE n WHEN 0 THEN 'price_reduction' WHEN 1 THEN 'multi_buy' WHEN 2 THEN 'multi_buy' END AS deal_type, CASE n WHEN 0 THEN 'מחיר מבצע' WHEN 1 THEN q || ' יחידות' WHEN 2 THEN '3 יחידות' END AS deal_description,
        CASE n WHEN 0 THEN 9.0 WHEN 1 THEN 4.5 * q WHEN 2 THEN 12.0 END AS deal_price, CASE n WHEN 0 THEN 1 WHEN 1 THEN q WHEN 2 THEN 3 END AS deal_min_qty, CASE n WHEN 0 THEN 9.0 WHEN 1 THEN 4.5 WHEN 2 THEN 4.0 END AS per_unit FROM m""")
def tier_deals(spark, sf_dir):
    """D-3: the cheapest tier, one without a price last."""
    n, q = c("l_orderkey"), (c("l_linenumber") + 1).cast("double")

    def tier(price: Column, qty: Column) -> Column:
        return F.struct(qty.alias("quantity"), F.struct(price.cast("double").alias("value")).alias("final_price"))

    none = F.lit(None)
    lists = _pick(n, F.array(tier(F.lit(1.0), F.lit(2.0))), F.array(tier(none, F.lit(9.0)), tier(F.lit(4.5), q), tier(F.lit(5.0), F.lit(2.0))), F.array(tier(F.lit(4.0), F.lit(3.0))), F.array(tier(none, F.lit(2.0))))
    return _deal(O.table(spark, sf_dir, "lineitem"), deals.deal_from_tiers(lists, F.when(n % 4 == 0, 9.0).otherwise(10.0), F.lit(10.0)))


@_query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_orderkey % 4 AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN n < 3 AND n <> 1 THEN 'price_reduction' END AS deal_type, CASE n WHEN 0 THEN 'first' WHEN 2 THEN 'label' END AS deal_description, CASE n WHEN 0 THEN 5.0 WHEN 2 THEN 6.0 END AS deal_price,
        CASE WHEN n IN (0, 2) THEN 1 END AS deal_min_qty, CASE n WHEN 0 THEN 5.0 WHEN 2 THEN 6.0 END AS per_unit FROM m""")
def sale_list_deals(spark, sf_dir):
    """D-4: the first sale only."""

    def sale(scm: float, name: str, label: str) -> Column:
        return F.struct(F.lit(scm).alias("scm"), F.lit(name).alias("name"), F.lit(label).alias("label"))

    lists = _pick(c("l_orderkey"), F.array(sale(5.0, "first", "x"), sale(1.0, "second", "x")), F.array(sale(12.0, "dear", "x"), sale(1.0, "second", "x")), F.array(sale(6.0, "", "label")), F.slice(F.array(sale(1.0, "", "")), 1, 0))
    return _deal(O.table(spark, sf_dir, "lineitem"), deals.deal_from_sale_list(lists, F.lit(10.0)))


_COMPARE = [("", "", "10", None, "none"), ("2 ב-15", "15.00", "8.00", "multi_buy", "multi_buy"), ("", "7.50*", "9.90", "price_reduction", "price_reduction"), ("only 6.5 ש\"ח today", "", "9", "price_reduction", "price_reduction"), ("gift", "12", "9", "other", "other"), ("3 ב- 10<br/>x", "", "5", "multi_buy", "multi_buy")]


@_query("WITH m AS (SELECT l_orderkey, l_linenumber, l_orderkey % 6 AS n FROM lineitem) SELECT l_orderkey, l_linenumber, CASE n " + " ".join(f"WHEN {i} THEN " + (f"'{x[3]}'" if x[3] else "NULL") for i, x in enumerate(_COMPARE)) + " END AS deal_type, CASE n " + " ".join(f"WHEN {i} THEN '{x[4]}'" for i, x in enumerate(_COMPARE)) + " END AS expected FROM m")
def compare_deals(spark, sf_dir):
    """D-5, D-6."""
    told, button, shelf = (_pick(c("l_orderkey"), *(x[i] for x in _COMPARE)) for i in range(3))
    deal = deals.deal_from_compare_text(told, button, shelf.cast("double"))
    return O.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", deal["deal_type"].alias("deal_type"), deals.expected_deal_type(told, button, shelf, F.lit(None).cast("string")).alias("expected"))


@_query(f"""{_WITH} SELECT store_id, product_id, CASE WHEN is_weighable THEN {_round('regular_price', 4)} WHEN unit_dimension IN ('mass','volume') THEN {_round('CAST(regular_price AS DOUBLE) / unit_qty_si * 100', 4)} ELSE {_round('CAST(regular_price AS DOUBLE) / unit_qty_si', 4)} END AS regular_unit,
    CASE WHEN is_weighable THEN {_round('sale_price', 4)} WHEN unit_dimension IN ('mass','volume') THEN {_round('CAST(sale_price AS DOUBLE) / unit_qty_si * 100', 4)} ELSE {_round('CAST(sale_price AS DOUBLE) / unit_qty_si', 4)} END AS deal_unit FROM latest WHERE sale_price IS NOT NULL""")
def deal_unit_prices(spark, sf_dir):
    """D-7."""
    rows = O.latest_offers(spark, sf_dir).where("sale_price is not null")
    deal = deals.with_unit_prices(deals.price_reduction(c("sale_price"), F.lit("x")), c("regular_price"), c("unit_qty_si"), c("unit_dimension"), c("is_weighable"))
    return rows.select("store_id", "product_id", deal.alias("deal")).select("store_id", "product_id", c("deal.price_per_base_unit").alias("regular_unit"), c("deal.price_per_base_unit_deal").alias("deal_unit"))


@_query("""WITH p AS (SELECT user_id % 10 AS chain, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) * 20 AS expected, CAST(sum(event_id % 2) AS BIGINT) AS fetched FROM events GROUP BY 1) SELECT *, expected - fetched AS shortfall FROM p WHERE fetched < expected""")
def count_shortfalls(spark, sf_dir):
    """Q-6."""
    rows = O.log_lines(spark, sf_dir).select("chain", (c("products") * 20).alias("expected"), (c("event_id") % 2).alias("fetched"))
    return checks.count_shortfall(rows)


@_query("SELECT user_id % 10 AS chain, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS products FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def logged_products(spark, sf_dir):
    """A-18: from lines of text, of which some tell no number."""
    line = F.when(c("event_id") % 3 == 0, "started").otherwise(F.concat(F.lit("chain — "), c("products").cast("string"), F.lit(" products")))
    return status.log_product_counts(O.log_lines(spark, sf_dir).withColumn("line", line))


@_query(f"""{_WITH} SELECT match_key, count(*) AS offers, min(price) AS cheapest FROM (SELECT CASE WHEN coalesce(barcode, '') <> '' THEN 'barcode:' || barcode ELSE 'part:' || product_id END AS match_key, price FROM latest) GROUP BY 1""")
def offers_by_key(spark, sf_dir):
    """J-1, N-8: offers meet their product through its key."""
    rows = O.latest_offers(spark, sf_dir)
    products = rows.select("product_id", "barcode").distinct().withColumn("match_key", F.when(F.coalesce("barcode", F.lit("")) != "", F.concat(F.lit("barcode:"), "barcode")).otherwise(F.concat(F.lit("part:"), c("product_id").cast("string")))).withColumn("canonical_product_id", F.xxhash64("match_key"))
    payload = catalog.offer_payload(rows.withColumn("category_ids", F.lit(None).cast("array<string>")))
    joined = payload.join(products.select("product_id", "match_key", "canonical_product_id"), "product_id")
    return joined.groupBy("canonical_product_id", "match_key").agg(F.count("*").alias("offers"), F.min("price").alias("cheapest")).drop("canonical_product_id")


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 300 <> 0 THEN coalesce((SELECT min_by(q.p_brand, q.p_partkey) FROM part q WHERE q.p_partkey % 2 = 1 AND q.p_partkey % 3 <> 0 AND q.p_partkey % 50 = part.p_partkey % 50), NULL) WHEN p_partkey % 3 = 0 THEN (SELECT min_by(q.p_brand, q.p_partkey) FROM part q WHERE q.p_partkey % 2 = 1 AND q.p_partkey % 3 <> 0 AND q.p_partkey % 50 = part.p_partkey % 50) ELSE p_brand END AS brand FROM part""")
def inferred_brands(spark, sf_dir):
    """J-13: of the anchor chain's first branded product with the same barcode, if there is one."""
    k = c("p_partkey")
    rows = _part(spark, sf_dir).select(k, F.when(k % 2 == 1, "anchor").otherwise("other").alias("chain"), F.concat(F.lit("7290"), (k % 50).cast("string")).alias("barcode"), F.when(k % 3 == 0, "").otherwise(c("p_brand")).alias("brand"), k.alias("seq"))
    return coverage.infer_brands(rows, "anchor").select("p_partkey", "brand")


@_query("SELECT p_partkey, printf('R%06d', row_number() OVER (ORDER BY p_brand, p_name, p_partkey)) AS reference_id FROM part")
def numbered_references(spark, sf_dir):
    """W-5."""
    return coverage.numbered(_part(spark, sf_dir).select("p_brand", "p_name", "p_partkey"), ["p_brand", "p_name", "p_partkey"]).select("p_partkey", "reference_id")


# what the rules make of GOODS, in their order: milk needs a volume; the others, but eggs, a mass
_GROUPS = [("volume", "milk|cow|fat:3|{q}", "milk"), ("volume", "milk|goat|fat:3.5|{q}|organic", "milk"), ("mass", "sugar|{q}|brown", "sugar"), ("mass", "flour|{q}|whole_wheat", "flour"), ("mass", "rice|{q}|basmati", "rice"), ("mass", "tuna|{q}|oil", "tuna"), ("meat", "chicken|{p}|fresh|cut:breast{w}", "chicken"), ("meat", "salmon|{p}|frozen|cut:fillet{w}", "salmon"), ("meat", "ground_beef|{p}|fresh|cut:fat:15{w}", "ground_beef"), ("mass", "cottage|{q}|fat:5", "cottage"), ("any", "eggs|size:L|count:12", "eggs")]


def _group_sql(kind: str, key: str) -> str:
    made = "'" + key.format(q="' || qty || '", p="' || CASE WHEN is_weighable THEN 'weight' ELSE 'packaged' END || '", w="' || CASE WHEN is_weighable THEN '' ELSE '|' || qty END || '") + "'"
    test = {"volume": "unit_dimension = 'volume' AND qty IS NOT NULL", "mass": "unit_dimension = 'mass' AND qty IS NOT NULL", "meat": "unit_dimension = 'mass' AND (is_weighable OR qty IS NOT NULL)", "any": "true"}[kind]
    return f"CASE WHEN {test} THEN {made} END"


_MEMBERS = f"""{_WITH}, q AS (SELECT *, 'qty:' || CASE WHEN unit_qty_si > 0 AND unit_qty_si <> 100 THEN CAST(CASE WHEN unit_qty_si < 100 THEN round_even(unit_qty_si, 0) WHEN unit_qty_si < 1500 THEN round_even(unit_qty_si / 10, 0) * 10 ELSE round_even(unit_qty_si / 50, 0) * 50 END AS BIGINT) END AS qty FROM latest),
    members AS (SELECT * FROM (SELECT *, CASE product_id % 12 {' '.join(f"WHEN {i} THEN {_group_sql(k, key)}" for i, (k, key, _) in enumerate(_GROUPS))} END AS group_key, CASE product_id % 12 {' '.join(f"WHEN {i} THEN '{f}'" for i, (_, _, f) in enumerate(_GROUPS))} END AS family FROM q) WHERE group_key IS NOT NULL)"""


def _members(spark, sf_dir) -> DataFrame:
    return catalog.group_members(O.latest_offers(spark, sf_dir).withColumn("name", c("goods")))


@_query(f"{_MEMBERS} SELECT group_key, min(family) AS family, min(price) AS cheapest_price, count(*) AS offer_count, count(DISTINCT chain) AS chain_count FROM members GROUP BY 1")
def commodity_groups(spark, sf_dir):
    """C-1, C-2, C-3, A-3: offers under the names of commodities, classified and grouped, active or not."""
    return catalog.build_groups(_members(spark, sf_dir)).drop("label")


@_query(f"{_MEMBERS} SELECT DISTINCT store_id, product_id, group_key, family FROM members")
def commodity_members(spark, sf_dir):
    """C-1, J-3."""
    return _members(spark, sf_dir).select("store_id", "product_id", "group_key", "family").distinct()


#: J-10 in pairs: groups that share a class.
ORACLE_SQL["compatible_groups"] = f"""{_MEMBERS}, g AS (SELECT DISTINCT group_key, family FROM members), k AS (SELECT group_key, CASE WHEN family IN ('chicken', 'salmon', 'ground_beef') THEN family || CASE WHEN group_key LIKE '%|frozen|%' THEN '|frozen' ELSE '|fresh' END ELSE group_key END AS compatible FROM g)
    SELECT a.group_key, b.group_key AS other FROM k a JOIN k b USING (compatible)"""


@_query(f"""{_MEMBERS}, g AS (SELECT DISTINCT group_key, family FROM members) SELECT group_key, CASE WHEN family IN ('chicken', 'salmon', 'ground_beef') THEN family || CASE WHEN group_key LIKE '%|frozen|%' THEN '|frozen' ELSE '|fresh' END ELSE group_key END AS compatible FROM g""")
def compatible_classes(spark, sf_dir):
    """J-10: groups that can stand for each other share a class; classes aren't expanded into pairs."""
    return _members(spark, sf_dir).select("group_key", classify.compatible_key(c("group_key"), c("family")).alias("compatible")).distinct()


@_query(f"""{_MEMBERS} SELECT group_key, min(price) AS cheapest_price, count(*) AS offer_count, count(DISTINCT chain) AS chain_count FROM members WHERE is_active AND family = 'chicken' GROUP BY 1 HAVING count(DISTINCT chain) >= 2 ORDER BY 4 DESC, 3 DESC, 2, 1 LIMIT 6""")
def commodity_search(spark, sf_dir):
    """C-6, W-11: the first six groups whose label has both words."""
    return catalog.search_groups(_members(spark, sf_dir), "עוף חזה").drop("family", "label")


@_query(f"""{_MEMBERS}, best AS (SELECT *, row_number() OVER (PARTITION BY group_key, chain ORDER BY price, store_id, product_id) AS n FROM members WHERE is_active) SELECT group_key, chain, store_id, product_id, price, row_number() OVER (PARTITION BY group_key ORDER BY price, chain) AS place FROM best WHERE n = 1""")
def commodity_detail(spark, sf_dir):
    """C-7, W-13."""
    return catalog.group_detail(_members(spark, sf_dir)).select("group_key", "chain", "store_id", "product_id", "price", "place")


_CHAINS = "chains AS (SELECT n_name AS chain, 'Chain ' || n_nationkey AS label FROM nation WHERE n_nationkey % 5 <> 0)"


def _chains(spark, sf_dir) -> DataFrame:
    return O.table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(c("n_name").alias("chain"), F.concat(F.lit("Chain "), c("n_nationkey").cast("string")).alias("label"))


@_query(f"""{_WITH}, {O.DEALS_SQL}, {_CHAINS}, best AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) AS n, count(DISTINCT chain) OVER (PARTITION BY product_id) AS chain_count FROM deals WHERE is_active)
    SELECT product_id AS canonical_product_id, p_name AS name, p_brand AS brand, best.is_weighable, CASE WHEN product_id % 3 = 0 THEN 'own.jpg' ELSE 'offer' || store_id END AS image_url, price AS cheapest_price, best.chain AS cheapest_chain, coalesce(label, best.chain) AS cheapest_chain_label, store_name AS cheapest_store_name, has_deal, chain_count
    FROM best JOIN part ON p_partkey = product_id LEFT JOIN chains ON chains.chain = best.chain WHERE n = 1""")
def product_previews(spark, sf_dir):
    """N-12, J-18, A-6."""
    rows = O.with_deals(O.latest_offers(spark, sf_dir)).withColumns({"canonical_product_id": c("product_id"), "image_url": F.concat(F.lit("offer"), c("store_id").cast("string"))})
    products = _part(spark, sf_dir).select(c("p_partkey").alias("canonical_product_id"), c("p_name").alias("name"), c("p_brand").alias("brand"), F.when(c("p_partkey") % 3 == 0, "own.jpg").otherwise("").alias("image_url"))
    return catalog.product_previews(products, rows, _chains(spark, sf_dir))


@_query(f"""{_WITH}, {_CHAINS} SELECT store_id, product_id, coalesce(label, latest.chain) AS chain_label, price, CAST(NULL AS VARCHAR) AS product_url, CAST(round((product_id % 97) / 7.0, 1) AS DOUBLE) AS distance_km FROM latest LEFT JOIN chains USING (chain) WHERE is_active""")
def offer_views(spark, sf_dir):
    """N-13, J-18. The star schema's chains have no pages; product_urls has links of chains that do."""
    rows = O.latest_offers(spark, sf_dir).where("is_active").withColumn("distance_km", (c("product_id") % 97) / F.lit(7.0))
    return catalog.offer_view(rows, _chains(spark, sf_dir)).select("store_id", "product_id", "chain_label", "price", "product_url", "distance_km")


@_query(f"""{_WITH}, p AS (SELECT product_id, min(price) AS cheapest_price, count(DISTINCT chain) AS chain_count FROM latest WHERE is_active GROUP BY 1), g AS (SELECT category, min(price) AS cheapest_price, count(DISTINCT chain) AS chain_count FROM latest WHERE is_active GROUP BY 1),
    i AS (SELECT list_items.*, CASE WHEN item_id % 3 = 0 THEN CASE WHEN list_id % 10 = 0 THEN 'gone' ELSE p_type END END AS k FROM list_items JOIN part ON p_partkey = canonical_product_id)
    SELECT list_id, item_id, CAST(round(quantity, 3) AS DOUBLE) AS quantity, p.cheapest_price, p.chain_count, NULL AS group_key, canonical_product_id FROM i JOIN p ON product_id = canonical_product_id WHERE k IS NULL
    UNION ALL SELECT list_id, item_id, CAST(round(quantity, 3) AS DOUBLE), g.cheapest_price, g.chain_count, k, NULL FROM i JOIN g ON category = k""")
def list_previews(spark, sf_dir):
    """J-17: items of products and of groups; some groups are gone."""
    part = _part(spark, sf_dir).select(c("p_partkey").alias("canonical_product_id"), "p_type")
    key = F.when(c("item_id") % 3 == 0, F.when(c("list_id") % 10 == 0, "gone").otherwise(c("p_type")))
    items = O.list_items(spark, sf_dir).join(part, "canonical_product_id").withColumn("group_key", key).withColumn("quantity", c("quantity").cast("double"))
    active = O.latest_offers(spark, sf_dir).where("is_active")
    previews = catalog.offer_preview(active, "product_id").select(c("product_id").alias("canonical_product_id"), c("price").alias("cheapest_price"), "chain_count")
    groups = catalog.offer_preview(active, "category").select(c("category").alias("group_key"), c("price").alias("cheapest_price"), "chain_count")
    return catalog.list_previews(items, previews, groups)


@_query(f"""{_LINES}, s AS (SELECT DISTINCT list_id, chain, store_id FROM lines), m AS (SELECT s.*, p_name FROM s JOIN list_items i USING (list_id) JOIN part ON p_partkey = canonical_product_id LEFT JOIN lines l ON l.list_id = s.list_id AND l.item_id = i.item_id AND l.store_id = s.store_id WHERE l.item_id IS NULL)
    SELECT list_id, count(*) AS missing, max(names) AS longest FROM (SELECT list_id, store_id, string_agg(p_name, ',' ORDER BY p_name) AS names FROM m GROUP BY 1, 2) GROUP BY 1""")
def missing_items(spark, sf_dir):
    """A-8: of each list the stores that lack items, and the last of their lists of names."""
    items, rows = _items(spark, sf_dir)
    candidates = items.join(rows.where("is_active"), "canonical_product_id").withColumn("family", F.lit(None).cast("string"))
    names = items.join(_part(spark, sf_dir).select(c("p_partkey").alias("canonical_product_id"), c("p_name").alias("name")), "canonical_product_id").select("list_id", "item_id", "name")
    found = basket.missing_items(basket.best_lines(candidates), items, names)
    return found.groupBy("list_id").agg(F.count("*").alias("missing"), F.max(F.array_join("missing_names", ",")).alias("longest"))


@_query(f"""{_WITH}, old AS (SELECT list_id, item_id, canonical_product_id, quantity FROM list_items), new AS (SELECT list_id, item_id, canonical_product_id, quantity + 1 AS quantity FROM list_items WHERE item_id % 2 = 0)
    SELECT list_id, item_id, canonical_product_id, CAST(quantity AS DOUBLE) AS quantity FROM new UNION ALL SELECT list_id, item_id, canonical_product_id, CAST(quantity AS DOUBLE) FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.list_id = old.list_id AND new.canonical_product_id = old.canonical_product_id)""")
def list_upserts(spark, sf_dir):
    """B-4."""
    items = O.list_items(spark, sf_dir).withColumn("quantity", c("quantity").cast("double"))
    return basket.upsert_items(items, items.where("item_id % 2 = 0").withColumn("quantity", c("quantity") + 1)).drop("group_key")


@_query("""WITH i AS (SELECT l_orderkey AS list_id, l_linenumber AS item_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS p, CASE WHEN l_linenumber % 3 = 0 OR l_linenumber = 5 THEN 'g' END AS g, CASE WHEN l_orderkey % 9 = 0 THEN 0 WHEN l_orderkey % 9 = 1 THEN 1000 ELSE l_quantity END AS q FROM lineitem)
    SELECT (p IS NULL) <> (g IS NULL) AND q BETWEEN 0.1 AND 999 AS good, count(*) AS n FROM i GROUP BY 1""")
def valid_list_items(spark, sf_dir):
    """F-14."""
    k, o = c("l_linenumber"), c("l_orderkey")
    items = O.table(spark, sf_dir, "lineitem").select(F.when(k % 3 != 0, c("l_partkey")).alias("canonical_product_id"), F.when((k % 3 == 0) | (k == 5), "g").alias("group_key"), F.when(o % 9 == 0, 0).when(o % 9 == 1, 1000).otherwise(c("l_quantity")).alias("quantity"))
    return reduce(DataFrame.unionByName, (rows.agg(F.count("*").alias("n")).select(F.lit(good).alias("good"), "n") for good, rows in zip((True, False), basket.valid_items(items))))


@_query("SELECT s_suppkey AS store_id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 48)")
def fresh_branches(spark, sf_dir):
    """F-10."""
    sold = O.table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(c("l_suppkey").alias("store_id"))
    return filters.fresh_branches(O.branches(spark, sf_dir), sold).select("store_id")


@_query(f"{_WITH} SELECT store_id, product_id, 'barcode' AS by FROM latest WHERE barcode = '729000000013' UNION ALL SELECT store_id, product_id, 'category' FROM latest WHERE category IN ('PROMO', 'ECONOMY')")
def offers_by_code_and_category(spark, sf_dir):
    """F-1, F-2."""
    rows = O.latest_offers(spark, sf_dir)
    by_category = filters.filter_categories(rows.withColumn("category_ids", F.array("category")), ["PROMO", "ECONOMY"])
    return filters.filter_barcode(rows, "729000000013").select("store_id", "product_id", F.lit("barcode").alias("by")).unionByName(by_category.select("store_id", "product_id", F.lit("category").alias("by")))


@_query(f"""WITH {_PRODUCTS}, hit AS (SELECT id, name || ' ' || brand AS t, name FROM products WHERE contains(name || ' ' || brand, 'blue')), page AS (SELECT id, CASE WHEN starts_with(name, 'blue') THEN 0 WHEN starts_with(t, 'blue') THEN 1 ELSE 2 END AS rank FROM hit ORDER BY 2, 1 LIMIT 8)
    SELECT id AS canonical_product_id, rank, (SELECT count(*) FROM page) AS total FROM page""")
def suggestions(spark, sf_dir):
    """W-10."""
    products = _products(spark, sf_dir)
    return search.suggest(products, products.select("canonical_product_id", F.lit(True).alias("is_active")), "blue", 8).select("canonical_product_id", "rank", "total")


@_query(f"""{_WITH}, {O.DEALS_SQL} SELECT product_id AS page_id, array_to_string(list_sort(list(DISTINCT CASE WHEN bundle THEN 'multi_buy' ELSE 'price_reduction' END) FILTER (has_deal)), ',') AS deal_types, count(DISTINCT line % 2) AS tables, count(*) AS rows FROM deals GROUP BY 1""")
def deal_type_presence(spark, sf_dir):
    """A-19."""
    rows = O.with_deals(O.latest_offers(spark, sf_dir)).withColumns({"page_id": c("product_id"), "kind": F.when(c("line") % 2 == 0, "physical").otherwise("online")})
    return pages.deal_type_presence(rows).withColumn("deal_types", F.nullif(F.array_join("deal_types", ","), F.lit("")))


@_query(f"""{_WITH} SELECT product_id AS page_id, store_name, CAST(price AS DOUBLE) AS row_price, row_number() OVER (PARTITION BY product_id ORDER BY price, store_name) AS place FROM latest""")
def rows_by_price(spark, sf_dir):
    """A-16."""
    rows = O.latest_offers(spark, sf_dir).select(c("product_id").alias("page_id"), "store_name", c("price").cast("double").alias("row_price"), F.lit("physical").alias("kind"), F.lit(0).alias("row_index"))
    return pages.rows_by_price(rows).select("page_id", "store_name", "row_price", "place")


@_query("""WITH s AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 404 WHEN page_id % 29 = 0 THEN NULL ELSE 200 END AS status FROM pages) SELECT count(*) AS pages, min(page_id) AS first_page, max(page_id) AS last_page, array_to_string(list_sort(list(page_id) FILTER (coalesce(status, 0) <> 200)), ',') AS failed_pages FROM s""")
def failed_pages(spark, sf_dir):
    """A-14."""
    k = c("page_id")
    p = O.table(spark, sf_dir, "pages").withColumn("status", F.when(k % 13 == 0, 404).when(k % 29 == 0, None).otherwise(200))
    stats = pages.page_stats(p, pages.links(p))
    failed = stats.where("coalesce(status, 0) <> 200").agg(F.array_join(F.sort_array(F.collect_list("page_id")), ",").alias("failed_pages"))  # asked for as one text
    return pages.page_summary(stats).join(failed).select("pages", "first_page", "last_page", "failed_pages")


@_query("""WITH f AS (SELECT page_id, page_id // 64 AS span FROM pages WHERE page_id % 13 = 0 OR page_id % 29 = 0 OR page_id % 40 < 7), r AS (SELECT *, page_id - row_number() OVER (PARTITION BY span ORDER BY page_id) AS run FROM f)
    SELECT min(page_id) AS first_page, max(page_id) AS last_page, count(*) AS pages FROM r GROUP BY span, run""")
def failed_page_ranges(spark, sf_dir):
    """A-14: runs of failed pages, here in spans of 64 ids."""
    k = c("page_id")
    p = O.table(spark, sf_dir, "pages").withColumn("status", F.when((k % 13 == 0) | (k % 40 < 7), 404).when(k % 29 == 0, None).otherwise(200))
    return pages.failed_ranges(pages.page_stats(p, pages.links(p)), span=64)


@_query(f"""{_MEMBERS} SELECT group_key, family, CAST(round(CAST(min(price) AS DOUBLE), 2) AS DOUBLE) AS cheapest_price, count(*) AS offer_count, count(DISTINCT chain) AS chain_count FROM members GROUP BY 1, 2""")
def group_views(spark, sf_dir):
    """N-14."""
    return catalog.group_view(catalog.build_groups(_members(spark, sf_dir))).drop("label")


_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@_query(f"""WITH p AS (SELECT p_partkey AS id, {_GRAMS.format("lower(p_name || ' ' || p_type)")} AS g FROM part), q AS (SELECT p_partkey AS query_id, {_GRAMS.format("lower(substr(p_name, 1, length(p_name) - 1) || 'x')")} AS h FROM part WHERE p_partkey % 100 = 0),
    s AS (SELECT query_id, id, len(list_intersect(g, h)) AS n, len(g) AS a, len(h) AS b FROM p, q), t AS (SELECT *, n / CAST(a + b - n AS DOUBLE) AS x FROM s) SELECT query_id, id AS canonical_product_id, CAST(round(x, 6) AS DOUBLE) AS similarity FROM t WHERE x >= 0.4""")
def similar_products(spark, sf_dir):
    """C-4, T-14: names with an error in their last letter, of the parts whose number is divisible by 100, against all parts."""
    part = _part(spark, sf_dir)
    texts = part.select(c("p_partkey").alias("canonical_product_id"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("search_text"))
    asked = part.where("p_partkey % 100 = 0").select(c("p_partkey").alias("query_id"), F.expr("concat(substr(p_name, 1, length(p_name) - 1), 'x')").alias("query"))
    return search.similar_many(texts, asked, least=0.4)


@_query(f"""{_WITH}, p AS (SELECT p_partkey AS id, lower(p_name) AS name, lower(p_name || ' ' || p_type) AS text FROM part), q AS (SELECT 'red widgte' AS q), s AS (SELECT *, len(list_intersect({_GRAMS.format('text')}, {_GRAMS.format('q')})) / CAST(len(list_distinct(list_concat({_GRAMS.format('text')}, {_GRAMS.format('q')}))) AS DOUBLE) AS x FROM p, q),
    hits AS (SELECT *, CASE WHEN name LIKE q || '%' THEN 0 WHEN text LIKE q || '%' THEN 1 ELSE 2 END AS rank FROM s WHERE (contains(text, q) OR (contains(text, 'red') AND contains(text, 'widgte')) OR x > 0.05) AND id IN (SELECT product_id FROM latest WHERE is_active))
    SELECT id AS canonical_product_id, rank, CAST(round(x, 6) AS DOUBLE) AS similarity, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY rank, x DESC, id LIMIT 20""")
def similarity_search(spark, sf_dir):
    """C-4: the similarity path, for a query with two letters changed about."""
    products = _part(spark, sf_dir).select(c("p_partkey").alias("canonical_product_id"), F.lower("p_name").alias("normalized_name"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("search_text"))
    active = O.latest_offers(spark, sf_dir).withColumn("canonical_product_id", c("product_id"))
    found = search.search_products(products, active, "red widgte", by_similarity=True)
    return found.select("canonical_product_id", "rank", F.round("similarity", 6).alias("similarity"), "total")


@_query("""WITH r AS (SELECT event_id // 50 AS run_id, CASE WHEN event_id // 50 % 2 = 0 THEN 'prices' ELSE 'deals' END AS kind, 'c' || user_id % 10 AS chain, sum(event_id % 7) AS rows, CASE WHEN count(*) FILTER (event_type = 'error') > 2 THEN 'timeout' END AS error FROM events GROUP BY ALL),
    a AS (SELECT run_id, kind, list_sort(list(DISTINCT chain)) AS q, list_sort(list(DISTINCT chain) FILTER (rows > 0 AND error IS NULL)) AS s, list_sort(list(DISTINCT chain) FILTER (rows = 0 OR error IS NOT NULL)) AS f, list_sort(list(chain || ': ' || error) FILTER (error IS NOT NULL)) AS e, CAST(sum(rows) AS BIGINT) AS rows, count(*) FILTER (rows = 0 OR error IS NOT NULL) AS bad FROM r GROUP BY 1, 2)
    SELECT run_id, kind, CASE WHEN rows >= 145 THEN 'done' ELSE 'failed' END AS status, array_to_string(q, ',') AS chains_requested, coalesce(array_to_string(s, ','), '') AS chains_succeeded, coalesce(array_to_string(f, ','), '') AS chains_failed,
        array_to_string(list_concat(list_concat(coalesce(e, []), CASE WHEN bad > 0 THEN ['partial_refresh'] ELSE [] END), CASE WHEN rows < 145 THEN ['swap_skipped'] ELSE [] END), ',') AS errors, rows FROM a""")
def run_log(spark, sf_dir):
    """R-7: fifty events are a run; one is swapped in if it staged 145 rows at least."""
    run = F.floor(c("event_id") / 50)
    results = O.table(spark, sf_dir, "events").groupBy(run.alias("run_id"), F.when(run % 2 == 0, "prices").otherwise("deals").alias("kind"), F.concat(F.lit("c"), (c("user_id") % 10).cast("string")).alias("chain")).agg(F.sum(c("event_id") % 7).alias("rows"), F.when(F.count_if(c("event_type") == "error") > 2, "timeout").alias("error"))
    log = status.run_log(results, c("rows") >= 145)
    return log.select("run_id", "kind", "status", *(F.array_join(x, ",").alias(x) for x in ("chains_requested", "chains_succeeded", "chains_failed", "errors")), "rows")


@_query("SELECT event_id AS run_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS chains FROM events")
def run_views(spark, sf_dir):
    """N-15: null lists are empty ones."""
    runs = _runs(spark, sf_dir).withColumn("chains", F.when(c("run_id") % 2 == 0, F.array("kind")))
    return status.run_view(runs).select("run_id", F.array_join("chains", ",").alias("chains"))


@_query("SELECT user_id % 10 AS chain FROM events GROUP BY 1 HAVING sum(event_id % 2) > 0 AND count(*) FILTER (event_type = 'error' AND event_id % 5 = 0) < 40")
def deal_refresh_chains(spark, sf_dir):
    """R-3: chains with rows and without errors, of those whose errors pass a bound."""
    lines = O.log_lines(spark, sf_dir).groupBy("chain").agg(F.sum(c("event_id") % 2).alias("rows"), F.count_if((c("kind") == "error") & (c("event_id") % 5 == 0)).alias("n"))
    return status.refresh_deals_plan(lines.select("chain", "rows", F.when(c("n") >= 40, 1).otherwise(0).alias("errors")))


@_query("""SELECT s_suppkey AS store_id, CASE s_suppkey % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'static' WHEN 2 THEN 'live' ELSE 'sold' END AS told FROM supplier""")
def store_lists(spark, sf_dir):
    """S-2, S-3, S-1: live rows before static ones, and stores that only products name."""
    stores = O.table(spark, sf_dir, "supplier").select(F.lit("x").alias("chain"), c("s_suppkey").alias("store_id"))
    live, static = stores.where("store_id % 2 = 0").withColumn("told", F.lit("live")), stores.where("store_id % 4 <= 1").withColumn("told", F.lit("static"))
    known = payloads.live_or_static(live, static, ["chain", "store_id"])
    return status.branch_metadata(known, stores).select("store_id", F.coalesce("told", F.lit("sold")).alias("told"))


@_query("""WITH b AS (SELECT s_suppkey AS k, s_suppkey % 3 AS n FROM supplier) SELECT CAST(CASE n WHEN 0 THEN 's' || k WHEN 1 THEN 'i' || k ELSE 'c' || k END AS VARCHAR) AS store_id, CASE WHEN k % 2 = 0 THEN 'Store' ELSE CASE n WHEN 0 THEN 's' || k WHEN 1 THEN 'i' || k ELSE 'c' || k END END AS store_name, CASE WHEN k % 5 <> 0 THEN 31.5 END AS lat, CASE WHEN k % 5 <> 0 THEN 'resolved' END AS geocode_status FROM b""")
def branch_rows(spark, sf_dir):
    """N-9."""
    k = c("s_suppkey")
    own = [F.when(k % 3 == i, F.concat(F.lit(name[0]), k.cast("string"))).alias(name) for i, name in enumerate(("store_id", "id"))] + [F.concat(F.lit("c"), k.cast("string")).alias("store_code")]
    rows = O.table(spark, sf_dir, "supplier").select(F.lit("x").alias("chain"), *own, F.when(k % 2 == 0, " Store ").otherwise(" ").alias("name"), F.lit("").alias("city"), F.lit("").alias("address"), F.when(k % 5 == 0, 95.0).otherwise(31.5).alias("lat"), F.lit(34.5).alias("lng"))
    return normalise.branch_payload(rows).select("store_id", "store_name", "lat", "geocode_status")


@_query(f"""{_LINES.replace("ORDER BY missing, total, store_id) AS k FROM sized", "ORDER BY missing, total, km, store_id) AS k FROM (SELECT *, (store_id * 37 % 100) / 4.0 AS km FROM sized)")} SELECT list_id, chain, store_id, missing, row_number() OVER (PARTITION BY list_id ORDER BY missing = 0 DESC, missing, total, CAST(round(km, 1) AS DOUBLE), store_id, chain) AS place FROM chains""")
def basket_by_distance(spark, sf_dir):
    """J-5, W-3, W-4: nearer stores go before others of one price."""
    items, rows = _items(spark, sf_dir)
    near = O.branches(spark, sf_dir).withColumn("distance_km", (c("store_id") * 37 % 100) / F.lit(4.0))
    return basket.compare_baskets(items, rows, branches=near, lists=_lists(spark, sf_dir)).select("list_id", "chain", "store_id", "missing", "place")


#: The one rule that each of these offers breaks, and how it differs from a good reduction from 10 to 8.
_BROKEN = {
    "discounted_without_deal": {"deal": False}, "percent_without_deal": {"deal": False, "sale": None, "percent": 5.0}, "has_deal_not_true": {"has_deal": False}, "unknown_type": {"type": "gift"}, "no_description": {"text": " "},
    "reduction_min_qty": {"qty": 2}, "reduction_price": {"price": 0.0, "each": 0.0, "sale": None}, "reduction_per_unit": {"each": 7.0, "sale": None}, "multi_buy_min_qty": {"type": "multi_buy", "qty": 0, "sale": None},
    "multi_buy_price": {"type": "multi_buy", "qty": 2, "price": 0.0, "each": 0.0, "sale": None}, "multi_buy_per_unit": {"type": "multi_buy", "qty": 2, "price": 16.0, "each": 7.0, "sale": None}, "other_per_unit": {"type": "coupon", "qty": 2, "price": 16.0, "each": 7.0, "sale": None},
    "deal_unit_price": {"size": 500.0, "by_unit": 2.0}, "regular_unit_price": {"size": 500.0, "by_unit_deal": 1.6}, "sale_per_unit": {"sale": 5.0},
}
_GOOD = {"deal": True, "has_deal": True, "type": "price_reduction", "text": "8 for one", "price": 8.0, "qty": 1, "each": 8.0, "sale": 8.0, "percent": None, "size": None, "by_unit": None, "by_unit_deal": None}


@_query("SELECT p_partkey AS product_id, rule FROM part JOIN (VALUES " + ", ".join(f"({i}, '{rule}')" for i, rule in enumerate(_BROKEN)) + f") AS broken(i, rule) ON p_partkey % {len(_BROKEN) + 1} = i")
def deal_rules(spark, sf_dir):
    """Q-1: each rule has offers that break it and no other; every sixteenth offer breaks none."""
    from ..functions.deals import DEAL

    n = len(_BROKEN) + 1
    cases = [_GOOD | change for change in _BROKEN.values()] + [_GOOD]
    kinds = {"deal": "boolean", "has_deal": "boolean", "type": "string", "text": "string", "qty": "int"}
    told = {k: F.element_at(F.array(*(F.lit(x[k]).cast(kinds.get(k, "double")) for x in cases)), (c("p_partkey") % n + 1).cast("int")) for k in _GOOD}
    deal = F.struct(told["has_deal"].alias("has_deal"), told["type"].alias("deal_type"), told["text"].alias("deal_description"), told["price"].alias("deal_price"), told["qty"].alias("deal_min_qty"), told["each"].alias("deal_price_per_unit"), told["by_unit"].alias("price_per_base_unit"), told["by_unit_deal"].alias("price_per_base_unit_deal")).cast(DEAL)
    rows = _part(spark, sf_dir).select(F.lit("a").alias("chain"), F.lit("1").alias("store_id"), c("p_partkey").alias("product_id"), F.lit(10.0).alias("regular_price"), told["sale"].alias("sale_price"), told["percent"].alias("discount_percent"), told["size"].alias("unit_qty_si"), F.when(told["size"].isNotNull(), "mass").alias("unit_dimension"), F.lit(False).alias("is_weighable"), F.when(told["deal"], deal).alias("deal"))
    return checks.deal_violations(rows).select("product_id", "rule")


@_query(f"{_WITH} SELECT n_name AS chain FROM nation WHERE n_name NOT IN (SELECT chain FROM offers WHERE store_id % 9 = 1)")
def chains_not_served(spark, sf_dir):
    """S-7: chains that were asked and of which no row came; here those without a store whose number leaves 1 by 9."""
    asked = O.table(spark, sf_dir, "nation").select(c("n_name").alias("chain"))
    return status.failed_chains(asked, O.offers(spark, sf_dir).where("store_id % 9 = 1").select("chain").distinct())


_FIELDS = ["chain_name", "store_name", "place", "deal_text", "deal_price_text"]
_ROW_CHECKS = [f"field_mismatch:{f}" for f in _FIELDS] + ["price_unparseable", "price_mismatch", "deal_type_mismatch", "row_count", None, "row_count"]


@_query("SELECT kind, row_index, \"check\" FROM (SELECT DISTINCT l_orderkey AS kind, l_linenumber AS row_index FROM lineitem) JOIN (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(_ROW_CHECKS) if x) + f") AS told(n, \"check\") ON (kind + row_index) % {len(_ROW_CHECKS)} = n")
def row_checks(spark, sf_dir):
    """Q-3: each check has rows that fail it and no other; every eleventh row differs only in blanks, commas and hidden characters. Either side lacks some rows."""
    rows = O.table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("kind"), c("l_linenumber").alias("row_index")).distinct().withColumn("n", (c("kind") + c("row_index")) % len(_ROW_CHECKS))
    shape = lambda f, price, kind: ["kind", "row_index", *(f(i).alias(x) for i, x in enumerate(_FIELDS)), price.alias("row_price_text"), kind.alias("deal_type")]
    left = rows.where("n <> 10").select(*shape(lambda i: F.lit("a b"), F.lit("1,000.00"), F.lit("other")))
    right = rows.where("n <> 8").select(*shape(lambda i: F.when(c("n") == i, "c").when(c("n") == 9, " a  b ").otherwise("a b"), F.when(c("n") == 5, "none").when(c("n") == 6, "1000.02").otherwise("​1000"), F.when(c("n") == 7, "coupon").otherwise("other")))
    return checks.compare_rows(left, right)


@_query("SELECT page_id FROM pages WHERE page_id % 7 < 4")
def hidden_pages(spark, sf_dir):
    """Q-5: pages of each way to hide rows, after the page's address; those one short of a bound, or long with their table, are left."""
    shapes = ["​" * 201, "&#8203;&#x200B;&#65279;" * 67, "user-select : none;" * 21 + "data-" * 2001, "x" * 20_001, "x" * 20_001 + "results-table", "​" * 200 + "&#8203;" * 200, "user-select:none;" * 20 + "data-" * 2001]
    padded = _pick(c("page_id"), *shapes)
    return checks.obfuscated_pages(O.table(spark, sf_dir, "pages").select("page_id", F.concat("url", padded).alias("html")), long=20_000)


@_query("SELECT l_orderkey, l_linenumber, CASE l_orderkey % 7 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 700.25 ELSE CAST(l_quantity AS INT) + 0.5 END AS price FROM lineitem")
def price_repairs(spark, sf_dir):
    """U-10: signs and commas, doubled points, a price stuck to another of which the hint tells the right one, and texts without a price."""
    q = c("l_quantity").cast("int").cast("string")
    damaged = _pick(c("l_orderkey"), F.concat(F.lit("₪ "), q, F.lit(".50")), F.concat(q, F.lit(",50")), F.concat(q, F.lit("..50")), F.concat(F.lit("9.90"), q, F.lit(".50")), "none", "600", "700.25")
    hint = F.when(c("l_orderkey") % 7 == 3, F.concat(q, F.lit(".5*")))
    return O.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", units.repair_price(damaged, hint).alias("price"))


_ASKED = [("{n} kg rice", "rice", "n", "mass"), ("rice {n}g", "rice", "n * 0.001", "mass"), ("oil {n},5 liter", "oil", "n + 0.5", "volume"), ("{n}ml oil", "oil", "n * 0.001", "volume"), ("oil {n} ליטר extra", "oil extra", "n", "volume"), ("rice {n} גרם", "rice", "n * 0.001", "mass"), ("{n} גלידה", "{n} גלידה", None, None), ("{n} kg", "{n} kg", "n", "mass")]


@_query("WITH p AS (SELECT p_partkey, p_size AS n, p_partkey % 8 AS k FROM part) SELECT p_partkey, CASE k " + " ".join(f"WHEN {i} THEN replace('{x[1]}', '{{n}}', CAST(n AS VARCHAR))" for i, x in enumerate(_ASKED)) + " END AS query_text, CAST(round(CAST(CASE k " + " ".join(f"WHEN {i} THEN {x[2]}" for i, x in enumerate(_ASKED) if x[2]) + " END AS DECIMAL(18,6)), 6) AS DOUBLE) AS value, CASE k " + " ".join(f"WHEN {i} THEN '{x[3]}'" for i, x in enumerate(_ASKED) if x[3]) + " END AS dimension FROM p")
def quantity_texts(spark, sf_dir):
    """U-7: each unit in Latin and Hebrew letters, a decimal comma, a word that only begins as a unit, and a size without other words."""
    n = c("p_size").cast("string")
    asked = F.replace(_pick(c("p_partkey"), *(x[0] for x in _ASKED)), F.lit("{n}"), n)
    found = units.parse_quantity_query(asked)
    return _part(spark, sf_dir).select("p_partkey", found["text"].alias("query_text"), F.round(found["value"], 6).alias("value"), found["dimension"].alias("dimension"))


@_query("""WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_linenumber AS i, CAST(l_quantity AS DOUBLE) AS p, l_orderkey % 3 AS n FROM lineitem)
    SELECT CAST(id AS VARCHAR) AS product_id, CASE WHEN n = 0 THEN 'shop' || i || '.co.il' ELSE 'chain:store:street ' || i END AS store_id, CASE WHEN n < 2 THEN p / 2 ELSE p END AS price, CASE WHEN n < 2 THEN p / 2 END AS sale_price, CASE WHEN n < 2 THEN 50.0 END AS discount_percent FROM r""")
def compare_offers(spark, sf_dir):
    """N-6: rows of comparison pages as offers; websites are told by their host, and only a reduction makes a sale price."""
    n, i, q = c("l_orderkey") % 3, c("l_linenumber"), c("l_quantity").cast("double")
    place = F.when(n == 0, F.concat(F.lit("https://www.shop"), i.cast("string"), F.lit(".co.il/a?b=c"))).otherwise(F.concat(F.lit("street "), i.cast("string")))
    deal = F.when(n < 2, deals.price_reduction(q / 2, F.lit("half"))).otherwise(deals.multi_buy(F.lit(2), q, F.lit("two")))
    rows = O.table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 8 + i).alias("page_id"), F.when(n == 0, "online").otherwise("physical").alias("kind"), F.lit("chain").alias("chain_name"), F.lit("store").alias("store_name"), place.alias("place"), q.alias("row_price"), deal.alias("deal"))
    return normalise.normalise_compare(rows).select("product_id", "store_id", *(c(x).cast("double").alias(x) for x in ("price", "sale_price", "discount_percent")))


def _storefront(spark, sf_dir) -> DataFrame:
    """Parts as products of a storefront: some branches are closed or hidden, some sold out, some prices null or 0, some names blank."""
    k = c("p_partkey")
    names = F.create_map(F.lit("1"), F.struct(F.when(k % 2 == 0, c("p_name")).otherwise(" ").alias("long"), F.when(k % 4 == 1, c("p_name")).alias("short")))
    price = F.when(k % 7 == 0, 0.0).when(k % 7 != 1, c("p_retailprice").cast("double"))
    branch = F.struct((k % 3 != 0).alias("isActive"), (k % 5 != 0).alias("isVisible"), F.when(k % 11 != 0, k % 11 == 1).alias("isOutOfStock"), price.alias("regularPrice"))
    return _part(spark, sf_dir).select(k, F.struct(names.alias("names"), F.when(k % 8 == 3, "local").otherwise("").alias("localName"), branch.alias("branch")).alias("product"))


@_query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 2 = 0 OR p_partkey % 4 = 1 OR p_partkey % 8 = 3 AS named, p_partkey % 7 AS n FROM part)
    SELECT k AS p_partkey, 'valid' AS filter FROM p WHERE named AND k % 3 <> 0 AND k % 5 <> 0 AND n > 1 UNION ALL SELECT k, 'priced' FROM p WHERE named AND n <> 1 UNION ALL SELECT k, 'in_stock' FROM p WHERE k % 11 <> 1""")
def storefront_products(spark, sf_dir):
    """F-3, F-4, F-5: what each platform's rule lets pass; a price of 0 passes where only a price is asked for, and an unknown stock is in stock."""
    rows = _storefront(spark, sf_dir)
    kept = {"valid": filters.valid_storefront(rows), "priced": filters.priced_storefront(rows), "in_stock": filters.in_stock(rows)}
    return reduce(DataFrame.unionByName, (found.select("p_partkey", F.lit(name).alias("filter")) for name, found in kept.items()))
