"""Row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import valid_coordinates
from ..functions.text import normalize_text


def filter_barcode(products: DataFrame, barcode: str) -> DataFrame:
    return products.where(F.col("barcode") == barcode)


def filter_categories(products: DataFrame, ids: list[str]) -> DataFrame:
    return products.where(F.arrays_overlap("category_ids", F.array(*map(F.lit, ids))))


def filter_name_words(products: DataFrame, query: str) -> DataFrame:
    """Every word of the query is in the name; an empty query passes all."""
    return reduce(lambda rows, w: rows.where(F.contains(F.lower("name"), F.lit(w))), query.lower().split(), products)


def valid_storefront(products: DataFrame) -> DataFrame:
    """An active and visible branch, a price, and a name; of rows of read_storefront_pages."""
    p = F.col("product")
    name = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (p["names"]["1"]["long"], p["names"]["1"]["short"], p["localName"])))
    return products.where(p["branch"]["isActive"] & p["branch"]["isVisible"] & (p["branch"]["regularPrice"] > 0) & name.isNotNull())


def priced_storefront(products: DataFrame) -> DataFrame:
    """A price, if only 0, and a name: what platforms without states of their branches ask of rows of read_storefront_pages."""
    p = F.col("product")
    name = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (p["names"]["1"]["long"], p["names"]["1"]["short"], p["localName"])))
    return products.where(p["branch"]["regularPrice"].isNotNull() & name.isNotNull())


def in_stock(products: DataFrame) -> DataFrame:
    return products.where(~F.coalesce(F.col("product.branch.isOutOfStock"), F.lit(False)))


def active_offers(offers: DataFrame, chains: list[str]) -> DataFrame:
    return offers.where(F.col("is_active") & F.col("chain").isin(chains))


def resolve_chains(asked: list[str] | None, registered: list[str]) -> list[str]:
    """All if nothing is asked for; else those that are registered, in the registry's order."""
    return registered if asked is None else [c for c in registered if c in {a.strip() for a in asked}]


def resolve_branches(branches: DataFrame, arguments: list[str]) -> DataFrame:
    """Branches whose id is one of the whole numbers or whose name has one of the other texts; all if there are none."""
    ids = [a for a in arguments if a.strip().isdigit()]
    names = [a.lower() for a in arguments if not a.strip().isdigit()]
    if not arguments:
        return branches
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower("store_name"), F.lit(n)) for n in names], F.col("store_id").cast("string").isin(ids or ["-"]))
    return branches.where(hit).dropDuplicates(["store_id"])


def fresh_branches(branches: DataFrame, products: DataFrame) -> DataFrame:
    """Branches that have a product; all if none has."""
    fresh = branches.join(products.select("store_id"), "store_id", "left_semi")
    return branches if fresh.isEmpty() else fresh


def missing_geocode(branches: DataFrame, limit: int) -> DataFrame:
    unknown = F.coalesce(F.col("geocode_status") != "not_found", F.lit(True))
    return branches.where(F.col("lat").isNull() & F.col("lng").isNull() & unknown).orderBy("chain", "store_id").limit(limit)


def with_valid_coordinates(branches: DataFrame) -> DataFrame:
    good = valid_coordinates(F.col("lat"), F.col("lng"))
    return branches.withColumns({c: F.when(good, F.col(c)) for c in ("lat", "lng")})


def matching_text(rows: DataFrame, query: str, column: str = "search_text") -> DataFrame:
    words = F.filter(F.split(normalize_text(F.lit(query)), " "), lambda w: w != "")
    return rows.where(F.forall(words, lambda w: F.contains(F.col(column), w)))
