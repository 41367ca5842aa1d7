"""Promotions: one struct for all the ways in which shops state them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_compare_text, normalize_deal_text
from .units import parse_price, price_per_base_unit

DEAL = "struct<has_deal:boolean,deal_type:string,deal_description:string,deal_price:decimal(18,2),deal_min_qty:int,deal_price_per_unit:double,price_per_base_unit:double,price_per_base_unit_deal:double>"
# The types, and how texts state a number of items for a price.
DEAL_TYPES = ["price_reduction", "multi_buy", "cart_total", "coupon", "other"]
N_FOR_PRICE = r"(\d+)\s+ב[-–]?\s*([\d.]+)"
N_UNITS_FOR_PRICE = r"(\d+)\s*יח['׳]?\s*ב-?\s*([\d.]+)\s*₪"
FOR_PRICE = r"ב-?\s*([\d.]+)\s*₪"
PRICE_IN_TEXT = r"([\d.]+)\s*ש"


def _deal(kind: Column | str, description: Column, price: Column, qty: Column, per_unit: Column) -> Column:
    none = F.lit(None).cast("double")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        F.lit(True).alias("has_deal"), kind.alias("deal_type"), description.alias("deal_description"), price.cast("decimal(18,2)").alias("deal_price"),
        qty.try_cast("int").alias("deal_min_qty"), per_unit.cast("double").alias("deal_price_per_unit"), none.alias("price_per_base_unit"), none.alias("price_per_base_unit_deal"),
    ).cast(DEAL)


def price_reduction(price: Column, description: Column) -> Column:
    return _deal("price_reduction", description, price, F.lit(1), price)


def multi_buy(qty: Column, total: Column, description: Column) -> Column:
    return _deal("multi_buy", description, total, qty, F.round(total.cast("double") / qty, 4))


def other_deal(description: Column, kind: str = "other") -> Column:
    nothing = F.lit(None)
    return _deal(kind, description, nothing, nothing, nothing)


def deal_from_specials(specials: Column, sale: Column, regular: Column, sale_text: str = "מחיר מבצע") -> Column:
    """A lower sale price; else the first special that states a bundle (type 2) or a cart total (type 3)."""

    def usable(s: Column) -> Column:
        level = s["firstLevel"]
        return ((level["type"] == 2) & (F.floor(level["firstPurchaseTotal"]) > 0) & (F.coalesce(level["firstGift"]["total"], F.lit(0)) != 0)) | (level["type"] == 3)

    first = F.get(F.filter(specials, usable), F.lit(0))
    words = F.coalesce(F.nullif(first["description"], F.lit("")), first["names"]["1"]["name"], F.lit("מבצע"))
    bundle = multi_buy(F.floor(first["firstLevel"]["firstPurchaseTotal"]), first["firstLevel"]["firstGift"]["total"], words)
    return F.when(sale < regular, price_reduction(sale, F.lit(sale_text))).when(first["firstLevel"]["type"] == 2, bundle).when(first["firstLevel"]["type"] == 3, other_deal(words, "cart_total"))


def deal_from_message(message: Column, codes: Column, promo: Column, regular: Column) -> Column:
    text = F.nullif(F.trim(message), F.lit(""))
    qty, total, single = F.regexp_extract(text, N_UNITS_FOR_PRICE, 1), F.regexp_extract(text, N_UNITS_FOR_PRICE, 2), F.regexp_extract(text, FOR_PRICE, 1)
    return (
        F.when(text.isNull() & (promo < regular), price_reduction(promo, F.lit("מחיר מבצע")))
        .when(qty != "", multi_buy(qty.try_cast("int"), total.try_cast("double"), text))
        .when(single != "", price_reduction(single.try_cast("double"), text))
        .when(text.isNotNull() | (F.size(F.coalesce(codes, F.array().cast("array<string>"))) > 0), other_deal(F.coalesce(text, F.lit("מבצע"))))
    )


def deal_from_tiers(tiers: Column, sale: Column, regular: Column) -> Column:
    """A lower final price; else the tier with the least one, a tier without a price last."""
    ranked = F.transform(tiers, lambda t, i: F.struct(F.coalesce(t["final_price"]["value"], F.lit(float("inf"))).alias("price"), i.alias("i"), t["quantity"].alias("qty")))
    best = F.array_min(ranked)
    total = best["price"] * best["qty"]
    words = F.format_string("%d יחידות", best["qty"].try_cast("int"))
    tier = F.when((best["price"] < float("inf")) & (best["qty"] > 0), _deal("multi_buy", words, total, best["qty"], best["price"]))
    return F.when(sale < regular, price_reduction(sale, F.lit("מחיר מבצע"))).otherwise(tier)


def deal_from_sale_list(sales: Column, regular: Column) -> Column:
    first = F.get(sales, F.lit(0))
    words = F.coalesce(F.nullif(first["name"], F.lit("")), first["label"], F.lit("מבצע"))
    return F.when(first["scm"] < regular, price_reduction(first["scm"], words))


def deal_from_compare_text(deal_text: Column, button: Column, shelf: Column) -> Column:
    text, price_text = normalize_deal_text(deal_text), normalize_compare_text(button)
    qty, total = F.regexp_extract(text, N_FOR_PRICE, 1), F.regexp_extract(text, N_FOR_PRICE, 2)
    on_button, in_text = parse_price(F.replace(price_text, F.lit("*"))), F.regexp_extract(text, PRICE_IN_TEXT, 1).try_cast("double")
    words = F.coalesce(F.nullif(text, F.lit("")), price_text)
    return (
        F.when((text == "") & (price_text == ""), None)
        .when(qty.try_cast("int") > 0, multi_buy(qty.try_cast("int"), total.try_cast("double"), words))
        .when(on_button < shelf, price_reduction(on_button, words))
        .when(in_text < shelf, price_reduction(in_text, words))
        .otherwise(other_deal(words))
    )


def expected_deal_type(deal_text: Column, button: Column, price: Column, price_raw: Column) -> Column:
    """The type by another way, to check the parser."""
    text, price_text = normalize_deal_text(deal_text), normalize_compare_text(button)
    shelf = F.coalesce(parse_price(price), parse_price(price_raw))
    on_button, in_text = parse_price(F.trim(F.replace(price_text, F.lit("*")))), F.regexp_extract(text, PRICE_IN_TEXT, 1).try_cast("double")
    return F.when((text == "") & (price_text == ""), "none").when(text.rlike(N_FOR_PRICE), "multi_buy").when((on_button < shelf - 1e-9) | (in_text < shelf - 1e-9), "price_reduction").otherwise("other")


def with_unit_prices(deal: Column, regular: Column, qty_si: Column, dimension: Column, weighable: Column) -> Column:
    """The deal with the regular and the deal's price by unit."""
    own = price_per_base_unit(deal["deal_price_per_unit"], qty_si, dimension, weighable)
    filled = deal.withField("price_per_base_unit", price_per_base_unit(regular, qty_si, dimension, weighable)).withField("price_per_base_unit_deal", own)
    return F.when(deal.isNotNull(), filled)
