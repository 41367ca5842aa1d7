"""The catalogue: keys, upserts, staging and swaps, previews and per-chain choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import classify_offer
from ..functions.links import product_url
from ..functions.text import match_key, normalize_barcode, normalize_text, search_text

OFFER_KEY = ["chain", "store_id", "product_id"]


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(rows, keys, [F.desc(c) for c in order])


def canonical_payload(products: DataFrame) -> DataFrame:
    """products with match_key, canonical_product_id, normalized_name, normalized_brand, barcode_digits and search_text."""
    brand = F.coalesce(F.nullif("brand", F.lit("")), F.col("manufacturer")) if "manufacturer" in products.columns else F.col("brand")
    key = match_key(F.col("barcode"), brand, F.col("name"), F.col("unit_dimension"), F.col("unit_qty_si"), F.col("unit_of_measure"))
    keyed = products.withColumns({"match_key": key, "normalized_name": normalize_text(F.col("name")), "normalized_brand": normalize_text(brand), "barcode_digits": normalize_barcode(F.col("barcode")), "search_text": search_text(F.col("name"), brand, F.col("barcode"))})
    return keyed.withColumn("canonical_product_id", F.xxhash64("match_key"))


def offer_payload(products: DataFrame) -> DataFrame:
    """products as offers: a null price is 0, null categories are none, and the offer is active."""
    return products.withColumns({"price": F.coalesce("price", F.lit(0).cast("decimal(18,2)")), "category_ids": F.coalesce("category_ids", F.array().cast("array<string>")), "is_active": F.lit(True)})


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old with the rows of new put in by key; of new rows with one key the last in the given order wins."""
    batch = last_per_key(new, keys, order).select(*old.columns)
    return old.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def upsert_branches(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (chain, store_id): new texts win unless blank; new coordinates only if both are there."""
    keys = ["chain", "store_id"]
    texts = [c for c in old.columns if c not in (*keys, "lat", "lng")]
    a, b = old.alias("a"), last_per_key(new, keys, ["seq"] if "seq" in new.columns else keys).alias("b")
    merged = a.join(b, keys, "full_outer")
    both = F.col("b.lat").isNotNull() & F.col("b.lng").isNotNull()
    place = [F.when(both, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("lat", "lng")]
    return merged.select(*keys, *(F.coalesce(F.nullif(f"b.{c}", F.lit("")), F.col(f"a.{c}")).alias(c) for c in texts), *place).select(*old.columns)


def products_with_offers(products: DataFrame, offers: DataFrame, key: str = "product_id") -> DataFrame:
    return products.join(offers.where("is_active").select(key), key, "left_semi")


#: What makes two products equivalent: one of these is the same in both.
EQUIVALENCE = {"barcode": ["barcode"], "match_key": ["match_key"], "name": ["name", "normalized_brand", "unit_qty_si", "unit_dimension"]}


def equivalence_keys(products: DataFrame, id_col: str = "canonical_product_id") -> DataFrame:
    """(id, rule, key): the keys by which a product is equivalent to others, and its own id, as rule id. Null sizes and dimensions are equal to each other; null or blank barcodes, keys and names to nothing."""
    own = products.select(F.col(id_col).alias("id"), F.nullif("barcode_digits", F.lit("")).alias("barcode"), "match_key", F.nullif("normalized_name", F.lit("")).alias("name"), "normalized_brand", "unit_qty_si", "unit_dimension")
    keys = [F.when(F.col(columns[0]).isNotNull(), F.struct(F.lit(rule).alias("rule"), F.to_json(F.struct(*columns)).alias("key"))) for rule, columns in EQUIVALENCE.items()]
    itself = F.struct(F.lit("id").alias("rule"), F.col("id").cast("string").alias("key"))
    return own.select("id", F.explode(F.array_compact(F.array(*keys, itself))).alias("_k")).select("id", "_k.*")


def equivalence_classes(products: DataFrame, id_col: str = "canonical_product_id") -> DataFrame:
    """(id, rule, class, size): of each rule that a product has a key for, the least product with that key, and how many have it.

    Two products are equivalent if they share a class of one rule. Members aren't expanded into pairs.
    """
    keyed = equivalence_keys(products, id_col).where("rule <> 'id'")
    classes = keyed.groupBy("rule", "key").agg(F.min("id").alias("class"), F.count("*").alias("size"))
    return keyed.join(classes, ["rule", "key"]).select("id", "rule", "class", "size")


#: Products of one key that a task pairs with all others of it at a time.
PAIRED = 1000


def equivalent_products(products: DataFrame, id_col: str = "canonical_product_id") -> DataFrame:
    """(id, other): products that share a key of one of the rules; itself too; not transitive.

    All pairs, for those who want them; equivalence_classes tells the same in one row for each product and rule. A pair is
    told by the first class that the two share, so pairs aren't shuffled to be made distinct; and a class is dealt out in shares of
    PAIRED products, each of which meets all others, so a task holds no more than a class's products.
    """
    order = {rule: i for i, rule in enumerate(EQUIVALENCE)}
    number = reduce(lambda a, r: a.when(F.col("rule") == r, order[r]), order, F).cast("int")
    classes = equivalence_classes(products, id_col).where("size > 1").select("id", F.struct(number.alias("rule"), "class").alias("class"), "size").distinct()
    own = classes.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("class", "size"))).alias("own"))  # as many as a product has keys
    each = own.select("id", F.col("own.class").alias("own"), F.explode("own").alias("_c")).select("id", F.col("_c.class").alias("class"), F.filter("own", lambda c: c < F.col("_c.class")).alias("before"), F.ceil(F.col("_c.size") / PAIRED).cast("int").alias("shares"))
    n = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = each.withColumn("share", F.pmod(F.xxhash64("id"), "shares").cast("int")).drop("shares")
    right = each.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(F.col("id").alias("other"), "class", "share", F.col("before").alias("before_"))
    met = left.repartition(n, "class", "share").join(right, ["class", "share"])
    first = (F.size("before") == 0) | (F.size("before_") == 0) | ~F.arrays_overlap("before", "before_")
    itself = products.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    return met.where(~F.col("id").eqNullSafe(F.col("other")) & first).select("id", "other").unionByName(itself.select("id", F.col("id").alias("other")))


def best_offer_per_chain(offers: DataFrame, keys: list[str], distance: str | None = None) -> DataFrame:
    """Of each key and chain the cheapest offer, then the nearest, then the least store and product."""
    order = [F.col("price"), *([F.col(distance).asc_nulls_last()] if distance else []), F.col("store_id"), F.col("product_id")]
    return first_per_key(offers, [*keys, "chain"], order)


def offer_preview(offers: DataFrame, key: str) -> DataFrame:
    """Of each key: the cheapest offer's price, chain, store and what else of PREVIEW there is, whether it has a deal, and the number of chains."""
    more = [c for c in PREVIEW if c in offers.columns]
    deal = [F.coalesce(F.col("deal")["has_deal"], F.lit(False)).alias("has_deal")] if "deal" in offers.columns else []
    best = F.min(F.struct("price", "store_id", "product_id", "chain", *more, *deal)).alias("best")
    return offers.groupBy(key).agg(best, F.countDistinct("chain").alias("chain_count")).select(key, "best.price", "best.chain", "best.store_id", *(f"best.{c}" for c in more), *(["best.has_deal"] if deal else []), "chain_count")


PREVIEW = ["store_name", "image_url", "is_weighable"]


def with_labels(rows: DataFrame, chains: DataFrame, name: str = "chain_label") -> DataFrame:
    """rows with their chain's label, by a join with the small table of chains (chain, label); a chain without one is its own label."""
    told = chains.select("chain", F.col("label").alias(name))
    return rows.join(told, "chain", "left").withColumn(name, F.coalesce(name, "chain"))


def product_previews(products: DataFrame, offers: DataFrame, chains: DataFrame, id_col: str = "canonical_product_id") -> DataFrame:
    """Products with an active offer, and their cheapest one: price, chain, its label, store, deal; the image is the offer's if the product has none."""
    best = with_labels(offer_preview(offers.where("is_active"), id_col), chains)
    image = [F.coalesce(F.nullif(products["image_url"], F.lit("")), best["image_url"]).alias("image_url")] if "image_url" in products.columns and "image_url" in best.columns else []
    own = [products[c] for c in products.columns if c not in (id_col, "image_url", "is_weighable")]
    told = {"price": "cheapest_price", "chain": "cheapest_chain", "chain_label": "cheapest_chain_label", "store_name": "cheapest_store_name"}
    rest = [best[c].alias(told.get(c, c)) for c in best.columns if c in told or c in ("has_deal", "is_weighable", "chain_count")]
    return products.join(best, id_col).select(id_col, *own, *image, *rest)


def offer_view(offers: DataFrame, chains: DataFrame) -> DataFrame:
    """Offers with their chain's label, their page's link, and distance (if told) to one decimal."""
    view = with_labels(offers, chains).withColumn("product_url", product_url(F.col("chain"), F.col("product_id"), F.col("barcode"), F.col("name")))
    return view.withColumn("distance_km", F.round("distance_km", 1)) if "distance_km" in view.columns else view


def list_previews(items: DataFrame, previews: DataFrame, groups: DataFrame) -> DataFrame:
    """Items with the cheapest price and number of chains of their product, or of their group; those whose product or group has no offer any more are left out."""
    own = ["list_id", "item_id", F.round("quantity", 3).alias("quantity")]
    products = items.where("group_key is null").join(previews.select("canonical_product_id", "cheapest_price", "chain_count"), "canonical_product_id")
    grouped = items.where("group_key is not null").drop("canonical_product_id").join(groups.select("group_key", "cheapest_price", "chain_count"), "group_key")
    columns = [*own, "cheapest_price", "chain_count"]
    return products.select(*columns, F.lit(None).cast("string").alias("group_key"), "canonical_product_id").unionByName(grouped.select(*columns, "group_key", F.lit(None).cast(items.schema["canonical_product_id"].dataType).alias("canonical_product_id")))


def product_detail(products: DataFrame, offers: DataFrame, branches: DataFrame | None = None, id_col: str = "canonical_product_id") -> DataFrame:
    """For each product the best offer of each chain among its equivalents' offers (cheapest, nearest, least store and product), cheapest first.

    No pair of products is made: offers are reduced to the best of each key and chain, then a product takes the
    best over its own keys. So a key of very many products has a row for each chain. A key that one product has alone tells
    nothing but its own offers, and those only count for a product that shares no key, as a shared key's offers have them among them.
    """
    if branches is not None:
        offers = offers.join(branches.select("chain", "store_id", "distance_km"), ["chain", "store_id"], "left")
    order = ["price", *([F.coalesce("distance_km", F.lit(float("inf"))).alias("far")] if branches is not None else []), "store_id", "product_id"]
    rest = [c for c in offers.columns if c not in (id_col, "chain")]
    place = F.struct(*order).alias("order")
    own = offers.select(F.col(id_col).alias("id"), "chain", place, F.struct(*rest).alias("offer"))
    shared = equivalence_classes(products, id_col).where("size > 1").select("id", "rule", "class").distinct()
    of_class = shared.join(own, "id").groupBy("rule", "class", "chain").agg(F.min("order").alias("order"), F.min_by("offer", "order").alias("offer"))
    told = shared.join(of_class, ["rule", "class"]).select("id", "chain", "order", "offer")
    alone = products.select(F.col(id_col).alias("id")).distinct().join(shared, "id", "left_anti").join(own, "id").select(told.columns)
    best = told.unionByName(alone).repartition("id").groupBy("id", "chain").agg(F.min_by("offer", "order").alias("offer")).select("id", "chain", "offer.*")
    place = F.row_number().over(Window.partitionBy("id").orderBy("price", "chain"))
    return best.withColumn("place", place).withColumn("weighable", F.max("is_weighable").over(Window.partitionBy("id")))


def deactivate_missing(offers: DataFrame, chain: str, run: int, stores: DataFrame) -> DataFrame:
    """Offers of the chain in the stores that the run hasn't seen are no longer active."""
    listed = stores.select("store_id").distinct().withColumn("_there", F.lit(True))
    marked = offers.join(listed, "store_id", "left")
    gone = (F.col("chain") == chain) & F.coalesce("_there", F.lit(False)) & (F.col("refresh_run_id") != run)
    return marked.withColumn("is_active", F.when(gone, False).otherwise(F.col("is_active"))).drop("_there").select(*offers.columns)


DEAL_COLUMNS = ["sale_price", "discount_percent", "deal", "price"]


def merge_deals(offers: DataFrame, staged: DataFrame) -> DataFrame:
    """offers with the deal columns of staged rows of the same key; unknown keys are dropped."""
    there = [c for c in DEAL_COLUMNS if c in offers.columns]
    news = staged.select(*OFFER_KEY, F.struct(*there).alias("_new"))
    joined = offers.join(news, OFFER_KEY, "left")
    return joined.withColumns({c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in there}).drop("_new").select(*offers.columns)


def replace_deals(offers: DataFrame, staged: DataFrame, chains: list[str]) -> DataFrame:
    """merge_deals for the chains, whose other offers lose their deals but keep their price."""
    ours = F.col("chain").isin(chains)
    cleared = offers.withColumns({c: F.when(ours, F.lit(None).cast(offers.schema[c].dataType)).otherwise(F.col(c)) for c in ("sale_price", "discount_percent", "deal") if c in offers.columns})
    return merge_deals(cleared, staged.where(ours))


def group_members(offers: DataFrame) -> DataFrame:
    """Offers that belong to a group of interchangeable commodities, with the group's key, family and label.

    Rules are applied to distinct names and sizes, of which there are far fewer than offers; the
    join back is by those columns, nulls equal to each other.
    """
    rule = ["name", "unit_dimension", "unit_qty_si", "is_weighable"]
    distinct = offers.select(*rule).distinct().withColumn("_name", normalize_text(F.col("name")))
    group = classify_offer(F.col("name"), F.col("unit_dimension"), F.col("unit_qty_si"), F.col("is_weighable"), F.col("_name"))
    # explode applies the long rule once, and drops what has no group
    found = distinct.select(*(F.col(c).alias(f"_{c}_") for c in rule), F.explode(F.array_compact(F.array(group))).alias("_group"))
    same = reduce(lambda a, b: a & b, (offers[c].eqNullSafe(found[f"_{c}_"]) for c in rule))
    return offers.join(found, same).select(*offers.columns, F.col("_group.key").alias("group_key"), F.col("_group.family").alias("family"), F.col("_group.label").alias("label"))


def group_view(groups: DataFrame) -> DataFrame:
    """Groups as search shows them: a label of group and family where it is blank, the price to two decimals, counts as numbers."""
    label = F.coalesce(F.nullif("label", F.lit("")), F.replace("group_key", F.lit("|"), F.lit(" ")))
    return groups.select("group_key", "family", label.alias("label"), F.round(F.col("cheapest_price").cast("double"), 2).alias("cheapest_price"), F.coalesce("offer_count", F.lit(0)).alias("offer_count"), F.coalesce("chain_count", F.lit(0)).alias("chain_count"))


def build_groups(members: DataFrame) -> DataFrame:
    """Key, family, label, cheapest price, offers and chains of each group, over all offers, active or not."""
    return members.groupBy("group_key").agg(F.min("family").alias("family"), F.min("label").alias("label"), F.min("price").alias("cheapest_price"), F.count("*").alias("offer_count"), F.countDistinct("chain").alias("chain_count"))


def search_groups(members: DataFrame, query: Column | str, limit: int = 6, least_chains: int = 2) -> DataFrame:
    """Groups whose label has all words of the query, over active offers, in at least two chains."""
    words = F.filter(F.split(normalize_text(F.lit(query) if isinstance(query, str) else query), " "), lambda w: w != "")
    hit = F.forall(words, lambda w: F.contains(normalize_text(F.col("label")), w))
    return top_groups(build_groups(members.where(hit & F.col("is_active"))).where(F.col("chain_count") >= least_chains), limit)


def top_groups(groups: DataFrame, limit: int = 6) -> DataFrame:
    return groups.orderBy(F.desc("chain_count"), F.desc("offer_count"), "cheapest_price", "group_key").limit(limit)


def group_detail(members: DataFrame, distance: str | None = None) -> DataFrame:
    """Of each group the best offer of each chain, cheapest first."""
    best = best_offer_per_chain(members.where("is_active"), ["group_key"], distance)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("group_key").orderBy("price", "chain")))


def chain_statuses(chains: DataFrame, offers: DataFrame) -> DataFrame:
    """Active offers of every registered chain; 0 for those that are disabled or have none."""
    counts = offers.where("is_active").groupBy("chain").agg(F.count("*").alias("n"))
    return chains.join(counts, "chain", "left").select(*chains.columns, F.when(F.col("enabled"), F.coalesce("n", F.lit(0))).otherwise(0).alias("product_count"))


def source_health(products: DataFrame, order: list[str]) -> DataFrame:
    """Per chain: products, and whether the first three of the first two in each store have name, price and store."""
    by_store = F.row_number().over(Window.partitionBy("chain", "store_id").orderBy(*order))
    sampled = products.withColumn("_n", by_store).where("_n <= 2").withColumn("_m", F.row_number().over(Window.partitionBy("chain").orderBy("store_id", "_n"))).where("_m <= 3")
    good = (F.coalesce(F.col("name"), F.lit("")) != "") & F.col("price").isNotNull() & F.col("store_id").isNotNull()
    seen = sampled.groupBy("chain").agg(F.min(good).alias("sample_ok"))
    return products.groupBy("chain").agg(F.count("*").alias("products")).join(seen, "chain").select("chain", "products", (F.col("sample_ok") & (F.col("products") > 0)).alias("passed"))
