"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import classify, deals, links, text, units
from shelfwise.functions.deals import DEAL


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def of(*columns):
        row = one.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return of


def lit(x, kind=None):
    return F.lit(x).cast(kind) if kind else F.lit(x)


def no_text():
    return lit(None, "string")


def no_number():
    return lit(None, "double")


@pytest.mark.parametrize(
    ("unit", "qty", "description", "expected"),
    [
        ('מ"ל', 500.0, None, ('מ"ל', 500.0, "volume", 1.0)),
        ("ליטר", 1.5, None, ("ליטר", 1500.0, "volume", 1000.0)),
        ('ק"ג', 2.0, None, ('ק"ג', 2000.0, "mass", 1000.0)),
        ("מ'ל", 330.0, None, ('מ"ל', 330.0, "volume", 1.0)),
        ("KG", 2.0, None, ('ק"ג', 2000.0, "mass", 1000.0)),
        ("קופסה", 3.0, None, ("קופסה", 3.0, None, None)),
        (None, None, '500 מ"ל', ('מ"ל', 500.0, "volume", 1.0)),
        (None, None, "1,5 ליטר", ("ליטר", 1500.0, "volume", 1000.0)),
        ("גרם", None, None, ("גרם", None, "mass", 1.0)),
        (None, 3.0, "5 * 42 גרם", ("גרם", 3.0, "mass", 1.0)),
        (None, None, None, (None, None, None, None)),
    ],
)
def test_normalize_unit(value, unit, qty, description, expected):
    assert tuple(value(units.normalize_unit(lit(unit, "string"), lit(qty, "double"), lit(description, "string")))) == expected


@pytest.mark.parametrize(
    ("price", "qty", "dimension", "weighable", "expected"),
    [(5.0, 500.0, "volume", False, 1.0), (10.0, 250.0, "mass", False, 4.0), (25.9, None, None, True, 25.9), (5.0, 6.0, "count", False, 0.8333), (5.0, 0.0, "volume", False, None), (5.0, 5.0, None, False, None)],
)
def test_price_per_base_unit(value, price, qty, dimension, weighable, expected):
    assert value(units.price_per_base_unit(lit(price), lit(qty, "double"), lit(dimension, "string"), lit(weighable))) == expected


def test_buckets_labels_and_prices(value):
    assert value(*(units.qty_bucket_match(lit(q, "double")) for q in (1003, 12.5, 994, 1510, 0.3, None))) == ("1000", "12", "990", "1500", "", "")
    assert value(*(units.qty_bucket_group(lit(q, "double")) for q in (100, 160, 1003, 0, 2))) == (None, "160", "1000", None, "2")
    assert value(*(units.size_label(lit(d), lit(q)) for d, q in (("volume", "1000"), ("volume", "750"), ("mass", "2000"), ("mass", "160"), ("count", "12")))) == ("1 ליטר", "750 מ״ל", "2 ק״ג", "160 גרם", "12 יחידות")
    assert value(units.discount_percent(lit(7.5), lit(10.0)), units.discount_percent(no_number(), lit(10.0))) == (25.0, None)
    assert value(*(units.parse_price(lit(t)) for t in ("1,234.5", " 12 ", "x", "", "​3.5"))) == (1234.5, 12.0, None, None, 3.5)
    assert value(units.repair_price(lit("4.510.50"), lit("4.50 *")), units.repair_price(lit("24..9900"), no_text()), units.repair_price(lit("₪ 12,90"), no_text()), units.repair_price(lit("abc"), no_text())) == (4.51, 24.99, 12.9, None)
    assert [tuple(value(units.parse_quantity_query(lit(q)))) for q in ("קמח 500 גרם", "milk 1.5 liter", "5 kg", "rice")] == [("קמח", 0.5, "mass"), ("milk", 1.5, "volume"), ("5 kg", 5.0, "mass"), ("rice", None, None)]
    assert value(units.quantity_with_unit(lit(1.5), lit("mass"), lit(True)), units.quantity_with_unit(lit(2.0), lit("mass"), lit(False))) == ('1.5 ק"ג', "2 יח'")
    assert value(units.comparison_unit_label(lit("mass"), lit(False)), units.comparison_unit_label(lit("volume"), lit(True))) == ("ל-100 גרם", "לליטר")


def test_texts_and_keys(value):
    def key(name, barcode=None, qty=1000.0):
        return text.match_key(lit(barcode, "string"), lit("תנובה"), lit(name), lit("mass"), lit(qty), lit("גרם"))

    assert value(key("x", "729-0000-066882")) == "barcode:7290000066882"
    a, b = value(key("קוטג׳ 5%"), key("קוטג 5%"))
    assert a == b
    a, b = value(key("סוכר", qty=1000.0), key("סוכר", qty=1003.0))
    assert a == b
    assert value(text.normalize_text(lit("  Straße, L'Oréal! חָלָב "))) == "strasse lor al חָלָב"
    assert value(text.name_signature(lit("גבינה צהובה של עמק")), text.name_signature(lit("עם של"))) == ("גבינ צהוב", "עם של")
    assert value(text.tokenize_name(lit("חלב 3% 1 ליטר, ל g 500"))) == ["חלב", "3", "1", "500"]
    none = lit(None, "string")
    assert value(text.quantity_signature(lit("mass"), lit(500.4), lit(False), none), text.quantity_signature(none, no_number(), lit(True), none), text.quantity_signature(none, no_number(), lit(False), lit("15 kg")), text.quantity_signature(none, no_number(), lit(False), lit("?"))) == ("mass:500", "weighable", "mass:15000", "")
    arrays = [F.array(*map(F.lit, x)) for x in (["a", "b", "c"], ["b", "c", "d"], [])]
    assert value(text.jaccard(arrays[0], arrays[1]), text.containment(arrays[0], arrays[1])) == (0.5, 2 / 3)
    assert value(*(text.brands_compatible(lit(a), lit(b)) for a, b in (("", "x"), ("x", ""), ("osem", "osem"), ("osem", "osem group"), ("ab", "abc"), ("tnuva", "osem")))) == (True, True, True, True, False, False)
    assert value(text.audit_barcode(lit("12"), lit("7290001")), text.audit_barcode(lit(""), lit("7290001"))) == ("", "7290001")
    assert value(text.trigram_similarity(lit("word"), lit("two words"))) == pytest.approx(4 / 11)
    assert value(text.normalize_deal_text(lit("a  <br/> b")), text.normalize_compare_text(lit(" a ​b "))) == ("a<BR>b", "a b")
    assert tuple(value(text.split_city_id(lit("5000"), lit(" x ")))) == ("5000", "9000", "x")
    assert value(text.safe_slug(lit(" a b/c ")), text.safe_slug(lit("//"))) == ("a_b_c", "item")


def test_char_ratio(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(text.char_ratio("a", "b")).collect()] == [0.75, 1.0, 0.0]


def test_links_and_places(value):
    none = no_text()
    assert value(links.product_url(lit("shufersal"), lit("P_4131074"), none, none)) == "https://www.shufersal.co.il/online/he/p/P_4131074"
    assert value(links.product_url(lit("yochananof"), none, none, lit("a b/c~"))) == "https://www.yochananof.co.il/category?search=a%20b/c~"
    assert value(links.product_url(lit("ramilevi"), none, lit("729"), none)) == "https://www.rami-levy.co.il/he/online/search?q=729&item=729"
    assert value(links.product_url(lit("nowhere"), lit("1"), none, none)) is None
    assert value(*(links.barcode_from_image(lit(u)) for u in ("https://x/gs1-products/12/large/7290000066882-1.jpg", "https://x/a_P_7290000000001_s.png", "https://x/7290000-a.jpg", "https://x/a.jpg"))) == ("7290000066882", "7290000000001", "7290000", None)
    assert value(links.expand_image_url(lit("a/{{size}}.{{extension||'jpg'}}"))) == "a/large.jpg"
    assert value(*(links.displayable_image(lit(u)) for u in ("a.jpg", " ", "x/No-Image.png", "placeholder"))) == ("a.jpg", None, None, None)
    assert value(links.haversine_km(lit(32.0853), lit(34.7818), lit(31.7683), lit(35.2137))) == pytest.approx(53.9, abs=0.5)
    assert value(links.haversine_km(no_number(), lit(1.0), lit(1.0), lit(1.0))) is None
    assert value(links.geocode_query(lit("a 1"), lit("b"), lit("")), links.geocode_query(lit("x Israel"), none, none)) == ("a 1, b, Israel", "x Israel")
    images = F.from_json(lit('[{"imageType":"PRIMARY","format":"small","url":"s"},{"imageType":"PRIMARY","format":"large","url":"default-l"},{"imageType":"PRIMARY","format":"medium","url":"m"},{"imageType":"X","format":"large","url":"x"}]'), "array<struct<imageType:string,format:string,url:string>>")
    assert value(links.pick_image(images)) == "m"
    assert value(links.progress_percent(lit(1), lit(4), lit(4), lit(10), lit(False)), links.progress_percent(lit(0), lit(0), lit(0), lit(0), lit(True))) == (28, 100)


@pytest.mark.parametrize(
    ("text_", "button", "shelf", "expected"),
    [("2 ב-15.00", "", 8.0, ("multi_buy", 2, 15.0, 7.5)), ("", "7.50", 9.9, ("price_reduction", 1, 7.5, 7.5)), ("6 יחידות ב- 10.00 ש", "9.00", 12.0, ("price_reduction", 1, 9.0, 9.0)), ("מתנה", "", 5.0, ("other", None, None, None)), ("", "", 5.0, None), (None, None, 5.0, None)],
)
def test_compare_deals(value, text_, button, shelf, expected):
    deal = value(deals.deal_from_compare_text(lit(text_, "string"), lit(button, "string"), lit(shelf)))
    assert (deal and (deal.deal_type, deal.deal_min_qty, deal.deal_price and float(deal.deal_price), deal.deal_price_per_unit)) == expected
    told = value(deals.expected_deal_type(lit(text_, "string"), lit(button, "string"), lit(str(shelf)), no_text()))
    assert told == (expected[0] if expected else "none")


def test_other_deals(value):
    schema = "array<struct<description:string,names:struct<`1`:struct<name:string>>,firstLevel:struct<type:int,firstPurchaseTotal:double,firstGift:struct<total:double>>>>"
    specials = F.from_json(lit('[{"firstLevel":{"type":1}},{"description":"2 for 12","firstLevel":{"type":2,"firstPurchaseTotal":2,"firstGift":{"total":12}}}]'), schema)
    deal = value(deals.deal_from_specials(specials, no_number(), lit(8.0)))
    assert (deal.deal_type, deal.deal_min_qty, deal.deal_price_per_unit, deal.deal_description) == ("multi_buy", 2, 6.0, "2 for 12")
    assert value(deals.deal_from_specials(specials, lit(7.0), lit(8.0))).deal_type == "price_reduction"
    assert value(deals.deal_from_specials(F.lit(None).cast(schema), no_number(), lit(8.0))) is None
    codes = F.array().cast("array<string>")
    assert value(deals.deal_from_message(lit("3 יח' ב- 20 ₪"), codes, no_number(), lit(9.0))).deal_price_per_unit == 6.6667
    assert value(deals.deal_from_message(lit("ב- 7.90 ₪"), codes, no_number(), lit(9.0))).deal_type == "price_reduction"
    assert value(deals.deal_from_message(no_text(), F.array(lit("c")), no_number(), lit(9.0))).deal_type == "other"
    assert value(deals.deal_from_message(no_text(), codes, no_number(), lit(9.0))) is None
    tiers = F.from_json(lit('[{"quantity":3,"final_price":{"value":5.0}},{"quantity":2,"final_price":{"value":4.5}},{"quantity":9}]'), "array<struct<quantity:double,final_price:struct<value:double>>>")
    deal = value(deals.deal_from_tiers(tiers, no_number(), lit(6.0)))
    assert (deal.deal_type, deal.deal_min_qty, float(deal.deal_price)) == ("multi_buy", 2, 9.0)
    sales = F.from_json(lit('[{"scm":5.0,"name":"s"}]'), "array<struct<scm:double,name:string,label:string>>")
    assert value(deals.deal_from_sale_list(sales, lit(6.0))).deal_type == "price_reduction"
    assert value(deals.deal_from_sale_list(sales, lit(4.0))) is None
    filled = value(deals.with_unit_prices(F.lit(None).cast(DEAL), lit(5.0), lit(1.0), lit("mass"), lit(False)))
    assert filled is None


@pytest.mark.parametrize(
    ("name", "dimension", "qty", "weighable", "key", "label"),
    [
        ("חלב מועשר 3% בקבוק 1 ליטר", "volume", 1000.0, False, "milk|cow|fat:3|qty:1000|enriched", "חלב 3% 1 ליטר מועשר"),
        ("טונה בשמן", "mass", 160.0, False, "tuna|qty:160|oil", "טונה 160 גרם בשמן"),
        ("טונה במים", "mass", 160.0, False, "tuna|qty:160|water", "טונה 160 גרם במים"),
        ("חזה עוף טרי", "mass", 1000.0, True, "chicken|weight|fresh|cut:breast", "עוף חזה במשקל טרי"),
        ("פילה סלמון קפוא", "mass", 500.0, False, "salmon|packaged|frozen|cut:fillet|qty:500", "סלמון פילה ארוז 500 גרם קפוא"),
        ("ביצים L 12 יחידות", "count", 12.0, False, "eggs|size:L|count:12", "ביצים L 12 יחידות"),
        ("חלב בלי אחוז", "volume", 1000.0, False, None, None),
        ("סוכר חום", "mass", 1000.0, False, "sugar|qty:1000|brown", "סוכר 1 ק״ג חום"),
        ("פסטה", "mass", 500.0, False, "pasta|qty:500", "פסטה 500 גרם"),
        ("סוכר", "mass", 100.0, False, None, None),
        ("קוטג' 5%", "mass", 250.0, False, "cottage|qty:250|fat:5", "קוטג׳ 250 גרם 5%"),
        (None, "mass", 250.0, False, None, None),
    ],
)
def test_classify(value, name, dimension, qty, weighable, key, label):
    group = value(classify.classify_offer(lit(name, "string"), lit(dimension), lit(qty), lit(weighable)))
    assert (group and group.key, group and group.label) == (key, label)
    if key and key.startswith(("chicken", "salmon")):
        assert value(classify.compatible_key(lit(key), lit(key.split("|")[0]))) == "|".join([key.split("|")[0], "fresh" if "fresh" in key else "frozen"])
