"""Checks of promotions, of parsed rows and of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.deals import DEAL_TYPES
from ..functions.text import normalize_compare_text
from ..functions.units import parse_price, price_per_base_unit

TOLERANCE = 0.01


def _apart(a: Column, b: Column) -> Column:
    """Not within the tolerance; two nulls are equal, one is not."""
    a, b = a.cast("double"), b.cast("double")
    return F.coalesce(F.abs(a - b) > TOLERANCE + 1e-9, a.isNull() != b.isNull())


def deal_violations(products: DataFrame) -> DataFrame:
    """chain, store_id, product_id and rule for each rule that a product's deal breaks."""
    c, deal = F.col, F.col("deal")
    kind, price, qty, each = deal["deal_type"], deal["deal_price"].cast("double"), deal["deal_min_qty"], deal["deal_price_per_unit"]
    cheaper = c("sale_price") < c("regular_price")
    is_ = lambda *kinds: kind.isin(*kinds)
    by_unit = lambda value: price_per_base_unit(value, c("unit_qty_si"), c("unit_dimension"), c("is_weighable"))
    bundle = F.round(price / qty, 4)
    rules = {
        "discounted_without_deal": deal.isNull() & cheaper,
        "percent_without_deal": deal.isNull() & (c("discount_percent") > 0),
        "has_deal_not_true": deal.isNotNull() & ~deal["has_deal"].eqNullSafe(True),
        "unknown_type": deal.isNotNull() & ~F.coalesce(is_(*DEAL_TYPES), F.lit(False)),
        "no_description": deal.isNotNull() & (F.trim(F.coalesce(deal["deal_description"], F.lit(""))) == ""),
        "reduction_min_qty": is_("price_reduction") & ~qty.eqNullSafe(1),
        "reduction_price": is_("price_reduction") & ~F.coalesce(price > 0, F.lit(False)),
        "reduction_per_unit": is_("price_reduction") & price.isNotNull() & _apart(each, price),
        "multi_buy_min_qty": is_("multi_buy") & ~F.coalesce(qty >= 1, F.lit(False)),
        "multi_buy_price": is_("multi_buy") & ~F.coalesce(price > 0, F.lit(False)),
        "multi_buy_per_unit": is_("multi_buy") & price.isNotNull() & (qty > 0) & _apart(each, bundle),
        "other_per_unit": is_("cart_total", "coupon", "other") & price.isNotNull() & (qty > 0) & _apart(each, bundle),
        "deal_unit_price": deal.isNotNull() & each.isNotNull() & by_unit(each).isNotNull() & _apart(deal["price_per_base_unit_deal"], by_unit(each)),
        "regular_unit_price": deal.isNotNull() & c("regular_price").isNotNull() & by_unit(c("regular_price")).isNotNull() & _apart(deal["price_per_base_unit"], by_unit(c("regular_price"))),
        "sale_per_unit": deal.isNotNull() & cheaper & each.isNotNull() & _apart(c("sale_price"), each),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return products.select("chain", "store_id", "product_id", F.explode(broken).alias("rule"))


def violations_summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count("*").alias("n"))


def first_violations(violations: DataFrame, limit: int = 20) -> DataFrame:
    return violations.orderBy("chain", "store_id", "product_id", "rule").limit(limit)


def compare_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """kind, row_index and check for each difference between two lists of rows with the same places.

    Both have kind, row_index, the text columns of FIELDS, row_price and deal_type.
    """
    fields = ["chain_name", "store_name", "place", "deal_text", "deal_price_text"]
    joined = left.alias("a").join(right.alias("b"), ["kind", "row_index"], "full_outer")
    one_sided = F.col("a.row_price_text").isNull() & F.col("b.row_price_text").isNull()
    gone = F.col("a.chain_name").isNull() != F.col("b.chain_name").isNull()
    a, b = parse_price(F.col("a.row_price_text")), parse_price(F.col("b.row_price_text"))
    there = ~gone & ~one_sided
    checks = [F.when(gone, F.lit("row_count"))]
    checks += [F.when(there & (normalize_compare_text(F.col(f"a.{f}")) != normalize_compare_text(F.col(f"b.{f}"))), F.lit(f"field_mismatch:{f}")) for f in fields]
    checks += [
        F.when(there & (a.isNull() | b.isNull()), F.lit("price_unparseable")),
        F.when(there & (F.abs(a - b) > TOLERANCE), F.lit("price_mismatch")),
        F.when(there & (F.col("a.deal_type") != F.col("b.deal_type")), F.lit("deal_type_mismatch")),
    ]
    return joined.select("kind", "row_index", F.explode(F.array_compact(F.array(*checks))).alias("check"))


def obfuscated_pages(pages: DataFrame, long: int = 150_000) -> DataFrame:
    """page_id of pages that hide their rows: many zero-width characters or references, unselectable parts with many data attributes, or a long page without its table."""
    html = F.col("html")
    hidden = F.length(html) - F.length(F.regexp_replace(html, r"[​-‏﻿]", ""))
    references = F.regexp_count(html, F.lit(r"&#(?:8203|8204|8205|8206|8207|65279|x200[b-fB-F]|x[fF][eE][fF][fF]);"))
    unselectable = (F.regexp_count(html, F.lit(r"user-select\s*:\s*none")) > 20) & (F.regexp_count(html, F.lit("data-")) > 2000)
    return pages.where((hidden > 200) | (references > 200) | unselectable | ((F.length(html) > long) & ~F.contains(html, F.lit("results-table")))).select("page_id")


def count_shortfall(pages: DataFrame) -> DataFrame:
    """Chains with fewer rows than their pages told; pages: chain, expected, fetched."""
    sums = pages.groupBy("chain").agg(F.max("expected").alias("expected"), F.sum("fetched").alias("fetched"))
    return sums.where(F.col("fetched") < F.col("expected")).withColumn("shortfall", F.col("expected") - F.col("fetched"))
