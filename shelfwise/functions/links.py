"""Image and product links, places and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Storefronts that share a platform, and the other shops' pages.
STOREFRONTS = {
    "carrefour": "https://www.carrefour.co.il",
    "tivtaam": "https://www.tivtaam.co.il",
    "machsanei": "https://www.mck.co.il",
    "keshet": "https://www.keshet-teamim.co.il",
    "quik": "https://www.quik.co.il",
    "victory": "https://www.victoryonline.co.il",
    "ybitan": "https://www.ybitan.co.il",
}
SHUFERSAL = "https://www.shufersal.co.il/online/he/p/"
RAMILEVI = "https://www.rami-levy.co.il/he/online/search?q="
YOCHANANOF = "https://www.yochananof.co.il/category?search="
# Where barcodes stand in image links, and links without a real image.
BARCODE_IN_IMAGE = [r"/gs1-products/\d+/[^/]+/(\d{8,14})-\d", r"_P_(\d{7,14})_", r"/(\d{7,14})-"]
NO_IMAGE = "default|no-image|no_image|noimage|placeholder"
IMAGE_FORMATS = ["large", "medium", "product", "small", "thumbnail"]
EARTH_KM = 6371.0088


def quoted(text: Column) -> Column:
    """Percent-encoding that leaves slashes and tildes, with %20 for a blank."""
    code = F.url_encode(text)
    for given, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        code = F.replace(code, F.lit(given), F.lit(wanted))
    return code


def product_url(chain: Column, product_id: Column, barcode: Column, name: Column) -> Column:
    own, code, title = (F.nullif(F.trim(c.cast("string")), F.lit("")) for c in (product_id, barcode, name))
    site = F.element_at(F.create_map(*(F.lit(x) for pair in STOREFRONTS.items() for x in pair)), chain)
    return (
        F.when(site.isNotNull(), F.concat(site, F.lit("/?catalogProduct="), quoted(own)))
        .when(chain == "shufersal", F.concat(F.lit(SHUFERSAL), quoted(own)))
        .when(chain == "ramilevi", F.coalesce(F.concat(F.lit(RAMILEVI), quoted(code), F.lit("&item="), quoted(code)), F.concat(F.lit(RAMILEVI), quoted(title))))
        .when(chain == "yochananof", F.concat(F.lit(YOCHANANOF), quoted(F.coalesce(code, title))))
    )


def barcode_from_image(url: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")) for pattern in BARCODE_IN_IMAGE))


def expand_image_url(url: Column, size: str = "large", extension: str = "jpg") -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"\{\{\s*size\s*\}\}", size), r"\{\{\s*extension[^}]*\}\}", extension)


def image_or_barcode(url: Column, barcode: Column, base: str, folder: str) -> Column:
    """A full link stays, a path gets the base; without any, the barcode's image."""
    given = F.nullif(F.trim(url), F.lit(""))
    path = F.when(given.startswith("http"), given).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(F.lit("/"), given)))
    return F.coalesce(path, F.concat(F.lit(f"{base.rstrip('/')}/{folder}/"), F.nullif(barcode, F.lit("")), F.lit(".jpg")))


def pick_image(images: Column) -> Column:
    """Of the primary images that have a link and aren't a default the one in the preferred format; else the first of any format."""
    primary = F.filter(images, lambda i: i["imageType"] == "PRIMARY")
    linked = F.filter(primary, lambda i: (F.coalesce(i["url"], F.lit("")) != "") & ~F.contains(F.lower(i["url"]), F.lit("default")))
    usable = F.filter(linked, lambda i: i["format"].isin(IMAGE_FORMATS))
    ranked = F.transform(usable, lambda i, n: F.struct(F.array_position(F.array(*map(F.lit, IMAGE_FORMATS)), i["format"]).alias("rank"), n.alias("n"), i["url"].alias("url")))
    return F.coalesce(F.array_min(ranked)["url"], F.get(linked, F.lit(0))["url"])


def displayable_image(url: Column) -> Column:
    return F.when((F.trim(url) != "") & ~F.lower(url).rlike(NO_IMAGE), url)


def valid_coordinates(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def geocode_query(address: Column, city: Column, name: Column, country: str = "Israel") -> Column:
    joined = F.concat_ws(", ", *(F.nullif(F.trim(c), F.lit("")) for c in (address, city, name)))
    return F.when(F.contains(F.lower(joined), F.lit(country.lower())), joined).otherwise(F.concat_ws(", ", F.nullif(joined, F.lit("")), F.lit(country)))


def progress_percent(done: Column, fetched: Column, started: Column, total: Column, finished: Column) -> Column:
    share = F.greatest(done.cast("double"), fetched * 0.7, started * 0.25) / total * 100
    return F.when(finished, 100).when(total > 0, F.least(F.greatest(F.bround(share), F.lit(0.0)), F.lit(100.0)).cast("int")).otherwise(0)
