"""Each platform's products as rows of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import deals, links
from ..functions.units import discount_percent, normalize_unit, price_per_base_unit

#: Columns of a unified row, in order (see schemas.UNIFIED).
MONEY = "decimal(18,2)"


def _text(*choices: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in choices))


def _finish(rows: DataFrame, deal: Column) -> DataFrame:
    """Adds unit, prices by unit and deal to rows that have all else."""
    c = F.col
    rows = rows.withColumn("_unit", normalize_unit(c("raw_unit"), c("unit_qty"), c("unit_description"))).withColumn("_deal", deal)
    dimension = F.when(c("force_mass"), "mass").otherwise(c("_unit.dimension"))
    size = F.when(~F.coalesce(c("force_mass"), F.lit(False)), c("_unit.qty_si"))
    price, sale = F.coalesce("sale_price", "regular_price"), c("sale_price")
    rows = rows.withColumns({"price": price.cast(MONEY), "unit_of_measure": c("_unit.label"), "unit_qty_si": size, "unit_dimension": dimension})
    rows = rows.withColumns({"price_per_base_unit": price_per_base_unit(c("price"), c("unit_qty_si"), c("unit_dimension"), c("is_weighable")), "deal": deals.with_unit_prices(c("_deal"), c("regular_price"), c("unit_qty_si"), c("unit_dimension"), c("is_weighable"))})
    rows = rows.withColumns({"sale_price": sale.cast(MONEY), "regular_price": c("regular_price").cast(MONEY)})
    return rows.select(
        "chain", "store_id", "store_name", "product_id", "name", "price", "regular_price", "sale_price", "discount_percent", "barcode", "image_url",
        "category_ids", "is_weighable", "unit_description", "unit_of_measure", "unit_qty", "unit_qty_si", "unit_dimension", "price_per_base_unit", "deal",
        "brand", "manufacturer", F.current_timestamp().alias("scraped_at"),
    )


def _ids(items: Column) -> Column:
    return F.transform(items, lambda x: x["id"].cast("string"))


def normalise_storefront(rows: DataFrame, strict: bool = True, requested_category: str | None = None) -> DataFrame:
    """Rows of read_storefront_pages.

    strict: the barcode is the image's, and the product's brand is taken. Otherwise there is no
    brand, the barcode may be the product's own, and a product without categories gets the requested one.
    """
    p, branch = F.col("product"), F.col("product.branch")
    image = links.expand_image_url(p["image"]["url"], "large" if strict else "medium")
    unit, weight = p["unitOfMeasure"]["names"]["1"], p["weight"]
    amount = F.regexp_replace(weight.cast("decimal(18,6)").cast("string"), r"\.?0+$", "")
    categories = _ids(p["family"]["categories"])
    base = rows.select(
        "chain", branch["id"].cast("string").alias("store_id"), F.lit(None).cast("string").alias("store_name"), F.coalesce(p["productId"], p["id"]).cast("string").alias("product_id"),
        _text(p["names"]["1"]["long"], p["names"]["1"]["short"], p["localName"]).alias("name"), branch["regularPrice"].alias("regular_price"), branch["salePrice"].alias("sale_price"),
        discount_percent(branch["salePrice"], branch["regularPrice"]).alias("discount_percent"),
        (links.barcode_from_image(image) if strict else _text(p["barcode"], links.barcode_from_image(image))).alias("barcode"), image.alias("image_url"),
        (categories if strict else F.when(F.size(categories) > 0, categories).otherwise(F.array(F.lit(requested_category)))).alias("category_ids"),
        F.coalesce(p["isWeighable"], F.lit(False)).alias("is_weighable"), F.concat_ws(" ", amount, unit).alias("unit_description"), unit.alias("raw_unit"), weight.alias("unit_qty"),
        F.lit(False).alias("force_mass"), (F.trim(p["brand"]["names"]["1"]) if strict else F.lit(None).cast("string")).alias("brand"), F.lit(None).cast("string").alias("manufacturer"),
        branch["specials"].alias("specials"),
    )
    return _finish(base, deals.deal_from_specials(F.col("specials"), F.col("sale_price"), F.col("regular_price")))


def normalise_search(rows: DataFrame, chain: str = "shufersal") -> DataFrame:
    """Rows of read_search_pages: one store, promotions in messages, which also tell the sale price if nothing else does."""
    p = F.col("product")
    listed, promo = p["price"]["value"], p["categoryPrice"]["value"]
    base = rows.select(
        F.lit(chain).alias("chain"), F.lit("global").alias("store_id"), F.lit(None).cast("string").alias("store_name"), F.coalesce(p["code"], p["sku"]).alias("product_id"), F.trim(p["name"]).alias("name"),
        F.when(listed > 0, listed).otherwise(promo).alias("regular_price"), F.when((promo > 0) & (listed > 0) & (promo < listed), promo).alias("promo"), p["promotionMsg"].alias("message"), p["promotionCodes"].alias("codes"),
        _text(p["ean"], links.barcode_from_image(links.pick_image(p["images"]))).alias("barcode"), links.pick_image(p["images"]).alias("image_url"), p["allCategoryCodes"].alias("category_ids"),
        F.coalesce(p["sellingMethod"]["code"] == "BY_WEIGHT", F.lit(False)).alias("is_weighable"), p["unitDescription"].alias("unit_description"), p["unitForComparison"].alias("raw_unit"), p["valueForComparison"].alias("unit_qty"),
        F.lit(False).alias("force_mass"), F.trim(p["brand"]["name"]).alias("brand"), p["manufacturer"].alias("manufacturer"),
    ).where("regular_price > 0")
    deal = deals.deal_from_message(F.col("message"), F.col("codes"), F.col("promo"), F.col("regular_price"))
    each = F.col("_told.deal_price_per_unit")
    base = base.withColumn("_told", deal).withColumn("sale_price", F.coalesce("promo", F.when(each < F.col("regular_price"), each)))
    return _finish(base.withColumn("discount_percent", discount_percent(F.col("sale_price"), F.col("regular_price"))), F.col("_told"))


def normalise_graphql(rows: DataFrame, store_id: str, chain: str = "yochananof") -> DataFrame:
    """Rows of read_graphql_pages: the barcode is the sku, and there is a unit without a quantity."""
    p = F.col("product")
    least = p["price_range"]["minimum_price"]
    regular, final = least["regular_price"]["value"], least["final_price"]["value"]
    base = rows.select(
        F.lit(chain).alias("chain"), F.lit(store_id).alias("store_id"), F.lit(None).cast("string").alias("store_name"), p["id"].alias("product_id"), F.trim(p["name"]).alias("name"), regular.alias("regular_price"),
        F.when(final < regular, final).alias("sale_price"), F.nullif(least["discount"]["percent_off"], F.lit(0.0)).alias("discount_percent"), p["sku"].alias("barcode"), p["small_image"]["url"].alias("image_url"),
        _ids(p["categories"]).alias("category_ids"), F.coalesce(p["by_kilo"] == 1, F.lit(False)).alias("is_weighable"), p["item_unit"].alias("unit_description"), p["item_unit"].alias("raw_unit"),
        F.lit(None).cast("double").alias("unit_qty"), F.lit(False).alias("force_mass"), F.trim(p["brand"]).alias("brand"), F.lit(None).cast("string").alias("manufacturer"), p["price_tiers"].alias("tiers"),
    ).where("regular_price > 0")
    return _finish(base, deals.deal_from_tiers(F.col("tiers"), F.col("sale_price"), F.col("regular_price")))


def net_content(value: Column) -> Column:
    """A number, or the product of several that are joined by stars."""
    parts = F.transform(F.split(value, r"\*"), lambda x: F.trim(x).try_cast("double"))
    return F.aggregate(parts, F.lit(1.0), lambda a, x: a * x)


def normalise_catalog(rows: DataFrame, store_id: str, chain: str = "ramilevi", image_base: str = "https://img.rami-levy.co.il") -> DataFrame:
    """Rows of read_catalog_pages: weighed goods are mass of no size, categories are departments and groups."""
    p = F.col("product")
    weighed = F.coalesce(p["prop"]["by_kilo"] == 1, F.lit(False))
    first = F.get(p["sale"], F.lit(0))["scm"]
    own = [F.coalesce(p[a]["id"], p[b]).cast("string") for a, b in (("department", "department_id"), ("group", "group_id"), ("subGroup", "sub_group_id"))]
    content, code = p["gs"]["Net_Content"], p["barcode"].cast("string")
    base = rows.select(
        F.lit(chain).alias("chain"), F.lit(store_id).alias("store_id"), F.lit(None).cast("string").alias("store_name"), p["id"].cast("string").alias("product_id"), F.trim(p["name"]).alias("name"), p["price"]["price"].alias("regular_price"),
        F.when(first < p["price"]["price"], first).alias("sale_price"), code.alias("barcode"), links.image_or_barcode(p["images"]["small"], code, image_base, "product").alias("image_url"), F.array_distinct(F.array_compact(F.array(*own))).alias("category_ids"),
        weighed.alias("is_weighable"), F.concat_ws(" ", content["value"], content["UOM"]).alias("unit_description"), content["UOM"].alias("raw_unit"), net_content(content["value"]).alias("unit_qty"), weighed.alias("force_mass"),
        F.trim(p["gs"]["BrandName"]).alias("brand"), p["gs"]["Manufacturer_Name"].alias("manufacturer"), p["sale"].alias("sale"),
    ).where("name <> '' and regular_price is not null").withColumn("discount_percent", discount_percent(F.col("sale_price"), F.col("regular_price")))
    return _finish(base, deals.deal_from_sale_list(F.col("sale"), F.col("regular_price")))


def normalise_compare(rows: DataFrame) -> DataFrame:
    """Rows of extract_compare_rows: only reductions make a sale price; a store's id is its website or chain, name and place."""
    host = F.regexp_extract("place", r"^(?:https?://)?(?:www\.)?([^/]+)", 1)
    store = F.when(F.col("kind") == "online", host).otherwise(F.concat_ws(":", "chain_name", "store_name", "place"))
    reduced = F.when(F.col("deal.deal_type") == "price_reduction", F.col("deal.deal_price"))
    sale = reduced.cast("double")
    return rows.select(F.col("chain_name").alias("chain"), store.alias("store_id"), "store_name", F.col("page_id").cast("string").alias("product_id"), F.coalesce(sale, "row_price").cast(MONEY).alias("price"), F.col("row_price").cast(MONEY).alias("regular_price"), sale.cast(MONEY).alias("sale_price"), discount_percent(sale, F.col("row_price")).alias("discount_percent"), "deal")


def compare_attributes(items: DataFrame) -> DataFrame:
    """Barcode, brand and weighing of autocomplete items, from their label and id."""
    label, own = F.col("parts.manufacturer_and_barcode"), F.col("id")
    barcode = F.coalesce(F.nullif(F.regexp_extract(label, r"(\d{7,14})", 1), F.lit("")), F.nullif(F.regexp_extract(own, r"(?:^temp_|_)(\d+)$", 1), F.lit("")))
    brand = F.nullif(F.trim(F.regexp_extract(label, r"(?:מותג|יצרן/מותג|יצרן)\s*:\s*([^,|]+)", 1)), F.lit(""))
    return items.select("*", barcode.alias("barcode"), brand.alias("brand"), own.startswith("our_").alias("is_weighable"))


def branch_payload(rows: DataFrame) -> DataFrame:
    """chain, store_id, store_name, city, address, lat, lng and geocode_status; bad coordinates are null."""
    store = _text(F.col("store_id"), F.col("id"), F.col("store_code"))
    good = links.valid_coordinates(F.col("lat"), F.col("lng"))
    place = [F.when(good, F.col(c)).alias(c) for c in ("lat", "lng")]
    return rows.select("chain", store.alias("store_id"), F.coalesce(F.nullif(F.trim("name"), F.lit("")), store).alias("store_name"), "city", "address", *place, F.when(good, "resolved").alias("geocode_status"))
