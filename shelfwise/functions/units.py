"""Units, quantities and unit prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of units with their label, how many g, ml or items one is, and the dimension.
UNITS = [
    ('מ"ל', 1.0, "volume", ['מ"ל', "מ'ל", "מל", "ml"]),
    ("ליטר", 1000.0, "volume", ["ליטר", "ל'", 'ל"ל', "l", "liter", "litre"]),
    ("גרם", 1.0, "mass", ["גרם", "גר", "ג'", "gr", "gram", "grams", "g"]),
    ('ק"ג', 1000.0, "mass", ['ק"ג', "ק'ג", "קג", "kg", "kilogram"]),
    ("יח'", 1.0, "count", ["יח'", "יחידה", "יחידות", "unit", "units", "pcs", "pc"]),
]
# A number and a unit in a description.
NUMBER_AND_UNIT = r"""(\d+(?:[.,]\d+)?)\s*(מ["״’']?ל|ליטר|ל["״’']?|ק["״’']?ג|גר(?:ם)?|יח["״’']?|ml|ML|[lLgG]|kg|KG)"""
# Units in search texts, the number that makes one a litre or a kilogram, and the dimension.
QUERY_UNITS = [(r"ק[״\"']?ג|קילו(?:גרם)?|kg", 1.0, "mass"), (r"גרם|גר'?|g", 0.001, "mass"), (r"ליטר|liter|litre|l", 1.0, "volume"), (r"מ[״\"']?ל|ml", 0.001, "volume")]


def _unit_map() -> Column:
    entries = []
    for label, size, dimension, spellings in UNITS:
        entry = F.struct(F.lit(label).alias("label"), F.lit(size).alias("size"), F.lit(dimension).alias("dimension"))
        for spelling in spellings:
            entries += [F.lit(spelling), entry]
    return F.create_map(*entries)


def normalize_unit(unit: Column, qty: Column | None = None, description: Column | None = None) -> Column:
    """struct(label, qty_si, dimension, si_per_unit).

    The unit's own spelling is looked up, in any case; else the first number and unit in the
    description, whose number counts if qty is null. An unknown unit is passed on without a dimension.
    """
    qty = F.lit(None).cast("double") if qty is None else qty.cast("double")
    description = F.lit(None).cast("string") if description is None else description
    units = _unit_map()
    own = F.element_at(units, F.lower(F.trim(unit)))
    told = F.element_at(units, F.lower(F.nullif(F.regexp_extract(description, NUMBER_AND_UNIT, 2), F.lit(""))))
    number = F.regexp_replace(F.nullif(F.regexp_extract(description, NUMBER_AND_UNIT, 1), F.lit("")), ",", ".").cast("double")
    entry = F.coalesce(own, told)
    amount = F.when(own.isNotNull(), qty).when(told.isNotNull(), F.coalesce(qty, number)).otherwise(qty)
    return F.struct(
        F.coalesce(entry["label"], unit).alias("label"),
        F.when(entry.isNull(), amount).otherwise(amount * entry["size"]).alias("qty_si"),
        entry["dimension"].alias("dimension"),
        entry["size"].alias("si_per_unit"),
    )


def price_per_base_unit(price: Column, qty_si: Column, dimension: Column, weighable: Column) -> Column:
    """Per kg if weighed, per 100 g or ml, or per item; 4 decimals; null if the size is unknown."""
    price = price.cast("double")
    sized = qty_si > 0
    return (
        F.when(F.coalesce(weighable, F.lit(False)), F.round(price, 4))
        .when(dimension.isin("mass", "volume") & sized, F.round(price / qty_si * 100, 4))
        .when((dimension == "count") & sized, F.round(price / qty_si, 4))
    )


def discount_percent(sale: Column, regular: Column) -> Column:
    return F.when(sale.isNotNull() & (regular > 0), F.round((1 - sale.cast("double") / regular.cast("double")) * 100, 2))


def _bucketed(qty: Column) -> Column:
    """Whole numbers; tens from 100 on; fifties from 1500 on. Halves go to the even side."""
    whole = F.bround(qty)
    return F.when(whole < 100, whole).when(whole < 1500, F.bround(whole / 10) * 10).otherwise(F.bround(whole / 50) * 50).cast("long")


def qty_bucket_match(qty: Column) -> Column:
    qty = qty.cast("double")
    return F.coalesce(F.when(F.bround(qty) > 0, _bucketed(qty).cast("string")), F.lit(""))


def qty_bucket_group(qty: Column) -> Column:
    """As for matches, but null if not positive, and for exactly 100."""
    qty = qty.cast("double")
    bucket = F.when(qty < 100, F.bround(qty)).when(qty < 1500, F.bround(qty / 10) * 10).otherwise(F.bround(qty / 50) * 50)
    return F.when((qty > 0) & (qty != 100), bucket.cast("long").cast("string"))


def size_label(dimension: Column, qty: Column) -> Column:
    value = qty.cast("long")
    whole = value % 1000 == 0
    big, small = (value / 1000).cast("long").cast("string"), value.cast("string")
    return (
        F.when(dimension == "volume", F.when(whole, F.concat(big, F.lit(" ליטר"))).otherwise(F.concat(small, F.lit(" מ״ל"))))
        .when(dimension == "mass", F.when(whole, F.concat(big, F.lit(" ק״ג"))).otherwise(F.concat(small, F.lit(" גרם"))))
        .when(dimension == "count", F.concat(small, F.lit(" יחידות")))
    )


def parse_quantity_query(query: Column) -> Column:
    """struct(text, value, dimension): a number with a unit is taken out of a search text, in kg or litres."""
    value, dimension, text = F.lit(None).cast("double"), F.lit(None).cast("string"), query
    for unit, factor, kind in reversed(QUERY_UNITS):
        pattern = rf"(?i)(\d+(?:[.,]\d+)?)\s*(?:{unit})(?![0-9A-Za-z\u0590-\u05FF])"
        there = F.regexp_extract(query, pattern, 1)
        number = F.regexp_replace(F.nullif(there, F.lit("")), ",", ".").cast("double") * factor
        rest = F.trim(F.regexp_replace(F.regexp_replace(query, pattern, " "), r"\s+", " "))
        value, dimension, text = F.when(there != "", number).otherwise(value), F.when(there != "", kind).otherwise(dimension), F.when(there != "", rest).otherwise(text)
    return F.struct(F.coalesce(F.nullif(text, F.lit("")), query).alias("text"), value.alias("value"), dimension.alias("dimension"))


def comparison_unit_label(dimension: Column, weighable: Column) -> Column:
    big = F.when(dimension == "volume", 'לליטר').otherwise('לק"ג')
    return F.when(F.coalesce(weighable, F.lit(False)), big).when(dimension == "mass", "ל-100 גרם").when(dimension == "volume", 'ל-100 מ"ל').when(dimension == "count", "ליחידה")


def quantity_with_unit(qty: Column, dimension: Column, weighable: Column) -> Column:
    unit = F.when(F.coalesce(weighable, F.lit(False)), F.when(dimension == "volume", "ליטר").otherwise('ק"ג')).otherwise("יח'")
    return F.concat(F.regexp_replace(qty.cast("decimal(18,3)").cast("string"), r"\.?0+$", ""), F.lit(" "), unit)


def parse_price(text: Column) -> Column:
    """Blanks, zero-width characters and commas go; null if the rest is no number."""
    return F.trim(F.regexp_replace(text, "[\\u00a0\\u200b-\\u200f\\ufeff,]", "")).try_cast("double")


def repair_price(text: Column, hint: Column) -> Column:
    """A price from a damaged text: a plain number under 500, or of all that could be one the nearest to the hint.

    Candidates are all places, overlapping ones too, where 1 to 5 digits, a point and 1 or 2 digits stand.
    """
    clean = F.regexp_replace(F.translate(text, "₪  ", ""), ",", ".")
    plain = clean.try_cast("double")
    single = F.regexp_replace(clean, r"\.{2,}", ".")
    near = F.regexp_extract(F.translate(hint, "₪  ,*", ""), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.length(single), F.lit(1))), lambda i: F.regexp_extract(F.substring(single, i, F.lit(9)), r"^(\d{1,5}\.\d{1,2})", 1))
    found = F.transform(F.filter(tails, lambda x: x != ""), lambda x: x.cast("double"))
    nearest = F.array_min(F.transform(found, lambda x, i: F.struct(F.abs(x - near).alias("apart"), i.alias("at"), x.alias("price"))))["price"]
    return F.when((plain > 0) & (plain < 500), plain).when(near.isNotNull(), nearest).otherwise(F.get(found, F.lit(0)))
