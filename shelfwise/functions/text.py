"""Normalised texts, keys for matching, token sets and similarities."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .units import qty_bucket_match

# Characters that are deleted, and words that say nothing about a product.
APOSTROPHES = "'\"`´’‘ʼ׳״"
GENERIC_WORDS = ["עם", "ללא", "של", "טרי", "ארוז", "מבצע", "מחיר", "חדש", "יח", "יחידה", "יחידות", "שומן", "טעם", "בטעם", "קג", "מל", "גרם", "ליטר"]
# Fixed values of the coverage audit: punctuation, unit words, and noise words.
PUNCTUATION = r"""["'״׳`´,.:;!?()\[\]{}<>|\\/+*=~^%$#@_-]"""
UNIT_WORDS = {"קג": "kg", "קילו": "kg", "קילוגרם": "kg", "kg": "kg", "גרם": "g", "גר": "g", "g": "g", "מל": "ml", "ml": "ml", "ליטר": "l", "ל": "l", "l": "l"}
NOISE_WORDS = ["מחיר", "לפי", "משקל", "ארוז", "מארז", "חדש", "יח", "יחידה", "יחידות"]
NUMBER_AND_UNIT = r"([0-9]+(?:\.[0-9]+)?)\s*(kg|g|ml|l)"
#: A token: digits, or Latin and Hebrew letters but for the Hebrew marks that are punctuation. So one pass over a text is enough.
TOKEN = r"[0-9]+|[a-zA-Z\u0590-\u05BD\u05BF-\u05F2\u05F5-\u05FF]+"


def normalize_text(text: Column) -> Column:
    """Lower case, apostrophes deleted, all but digits, Latin and Hebrew letters made single spaces."""
    folded = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.translate(folded, APOSTROPHES, ""), r"[^0-9A-Za-z֐-׿]+", " "))


def normalize_audit_text(text: Column) -> Column:
    spaced = F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("־"), F.lit(" ")), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def normalize_compare_text(text: Column) -> Column:
    visible = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" ")), r"[​-‏﻿]", "")
    return F.regexp_replace(F.trim(visible), r"\s+", " ")


def normalize_deal_text(text: Column) -> Column:
    return F.regexp_replace(normalize_compare_text(text), r"(?i)\s*<\s*br\s*/?\s*>\s*", "<BR>")


def normalize_barcode(barcode: Column) -> Column:
    return F.regexp_replace(F.coalesce(barcode, F.lit("")), "[^0-9]", "")


def audit_barcode(barcode: Column, product_id: Column) -> Column:
    """The digits of the barcode, else of the product id, if there are 7 to 14."""
    digits = normalize_barcode(F.coalesce(F.nullif(barcode, F.lit("")), product_id.cast("string")))
    return F.when(F.length(digits).between(7, 14), digits).otherwise("")


def search_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(normalize_text(p), F.lit("")) for p in parts))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def name_signature(name: Column, words: int = 2, stem: int = 4) -> Column:
    """Stems of the longest words (ties in order of the alphabet) that say something about the product."""
    all_words = _words(normalize_text(name))
    telling = F.array_distinct(F.filter(all_words, lambda w: (F.length(w) >= 2) & ~w.isin(GENERIC_WORDS)))
    by_length = F.transform(F.array_sort(F.transform(telling, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    chosen = F.when(F.size(telling) > 0, F.slice(by_length, 1, words)).otherwise(F.slice(all_words, 1, words))
    return F.array_join(F.array_sort(F.transform(chosen, lambda w: F.substring(w, 1, stem))), " ")


def match_key(barcode: Column, brand: Column, name: Column, dimension: Column, qty_si: Column, unit: Column) -> Column:
    digits = normalize_barcode(barcode)
    text = F.concat(F.lit("text:"), F.concat_ws("|", normalize_text(brand), name_signature(name), normalize_text(dimension), qty_bucket_match(qty_si), normalize_text(unit)))
    return F.when(digits != "", F.concat(F.lit("barcode:"), digits)).otherwise(text)


def tokenize_name(name: Column) -> Column:
    """Numbers and words, units by one spelling; noise words and single letters go."""
    units = F.create_map(*(F.lit(x) for pair in UNIT_WORDS.items() for x in pair))
    found = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(TOKEN), F.lit(0))
    tokens = F.transform(found, lambda t: F.coalesce(F.element_at(units, t), t))
    return F.filter(tokens, lambda t: ~t.isin(NOISE_WORDS) & ((F.length(t) > 1) | t.between("0", "9")))


def quantity_signature(dimension: Column, qty_si: Column, weighable: Column, description: Column) -> Column:
    number, unit = (F.regexp_extract(normalize_audit_text(description), NUMBER_AND_UNIT, i) for i in (1, 2))
    size = F.bround(number.try_cast("double") * F.when(unit.isin("kg", "l"), 1000).otherwise(1)).cast("long").cast("string")
    own = F.when(F.trim(dimension) != "", F.when(F.bround(qty_si) > 0, F.concat(F.trim(dimension), F.lit(":"), F.bround(qty_si).cast("long").cast("string"))))
    told = F.when(number != "", F.concat(F.when(unit.isin("kg", "g"), "mass:").otherwise("volume:"), size))
    return F.coalesce(own, F.when(weighable, F.lit("weighable")), told, F.lit(""))


def exact_key(brand: Column, tokens: Column, signature: Column) -> Column:
    return F.concat_ws("|", normalize_audit_text(brand), F.array_join(F.array_sort(F.array_distinct(tokens)), " "), signature)


def reference_key(barcode: Column, key: Column) -> Column:
    return F.when(barcode != "", F.concat(F.lit("barcode:"), barcode)).otherwise(F.concat(F.lit("name:"), key))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_distinct(a))), F.lit(0.0))


def brands_compatible(reference: Column, target: Column) -> Column:
    within = ((F.length(reference) >= 3) & F.contains(target, reference)) | ((F.length(target) >= 3) & F.contains(reference, target))
    return (reference == "") | (target == "") | (reference == target) | within


@F.pandas_udf(DoubleType())
def char_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; no combination of built-in functions gives it."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def trigrams(text: Column) -> Column:
    """The distinct 3-grams of the words, each with two blanks before and one after."""
    grams = F.transform(_words(normalize_text(text)), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def safe_slug(text: Column, fallback: str = "item") -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", "_"), r"[^0-9A-Za-z_֐-׿.-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^_+|_+$", ""), F.lit("")), F.lit(fallback))


def split_city_id(value: Column, label: Column) -> Column:
    """struct(city_id, street_id, label) of "city_street"; the street is 9000 if it isn't told."""
    parts = F.split(value, "_")
    return F.struct(F.element_at(parts, 1).alias("city_id"), F.coalesce(F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.lit("9000")).alias("street_id"), F.trim(label).alias("label"))
