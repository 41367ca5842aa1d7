"""Document fingerprints: weighted SimHash in DataFrame operations only.

Terms are pairs of neighbouring words and the last word alone; a term's weight is its number of
bytes, at most MOST_WEIGHT, so that pairs of short function words count for little. Each bit of a
term's 64-bit hash votes with the term's weight for or against the fingerprint's bit.

The votes are counted with ordinary sums. A long holds three counters of 21 bits, and one shift
and one mask put the bits j, j + 21 and j + 42 of a hash into them, so 22 sums count 64 bits. The
terms of a text are summed in chunks that can't make a counter overflow, then over the chunks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import partitions, whole_text, written

BITS = 64
COUNTER = 21
MOST_WEIGHT = 31
#: Terms of a chunk: CHUNK * MOST_WEIGHT is less than 2 ** COUNTER.
CHUNK = 1 << 16
#: Ids that bounds of ranges are taken from at most, if they are strings.
DRAWN = 10_000
_LANES = 1 | 1 << COUNTER | 1 << 2 * COUNTER


def _fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys (which tell rows apart) and fp of each row's column text."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pairs = texts.select(*keys, words.alias("words")).select(*keys, F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))).alias("b")).alias("pairs"))
    terms = pairs.select(*keys, F.posexplode_outer("pairs").alias("at", "pair"))
    weight = F.least(F.octet_length("pair.a") + F.coalesce(F.octet_length("pair.b"), F.lit(0)), F.lit(MOST_WEIGHT)).cast("long")
    terms = terms.select(*keys, F.shiftright("at", CHUNK.bit_length() - 1).alias("chunk"), F.coalesce(weight, F.lit(0)).alias("weight"), F.xxhash64("pair.a", "pair.b").alias("h"))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES)) * F.col("weight")).alias(f"s{j}") for j in range(COUNTER)]
    chunks = terms.groupBy(*keys, "chunk").agg(*lanes, F.sum(F.shiftrightunsigned("h", BITS - 1) * F.col("weight")).alias(f"s{COUNTER}"), F.sum("weight").alias("weight"))
    mask = (1 << COUNTER) - 1

    def votes(bit: int) -> Column:
        lane = COUNTER if bit == BITS - 1 else bit % COUNTER
        return F.col(f"s{COUNTER}") if lane == COUNTER else F.shiftrightunsigned(f"s{lane}", COUNTER * (bit // COUNTER)).bitwiseAND(F.lit(mask))

    summed = chunks.groupBy(*keys).agg(F.sum("weight").alias("weight"), *(F.sum(votes(bit)).alias(f"v{bit}") for bit in range(BITS)))
    set_bits = [F.when(F.col(f"v{bit}") * 2 > F.col("weight"), F.lit((1 << bit) - (1 << BITS if bit == BITS - 1 else 0)).cast("long")).otherwise(F.lit(0)) for bit in range(BITS)]
    fp = set_bits[0]
    for bit in set_bits[1:]:
        fp = fp.bitwiseOR(bit)
    return summed.select(*keys, fp.alias("fp"))


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (a long) of each row of docs; a text without words has fingerprint 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), whole_text(text_col).alias("text"))
    return _fingerprints(rows, ["row", "doc_id"]).drop("row")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / BITS


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def within_radius(queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """query, fp, distance: all fingerprints fp of table at most radius bits from the column query.

    Permuted block tables: a fingerprint is cut into blocks; two that differ in at most radius
    bits agree in at least blocks - radius whole blocks. There is a table for each choice of so
    many blocks, in which those blocks come first, and a query looks up all fingerprints that
    begin as it does. Complete distances are then verified. Repeated values count once. A key that
    many distinct fingerprints share is one of a join's, which Spark splits; each of its rows meets
    only the queries that begin as it does.
    """
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    bounds = [round(BITS * i / blocks) for i in range(blocks + 1)]

    def permuted(fp: str) -> Column:
        keys = []
        for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
            mask = sum(((1 << bounds[b + 1]) - 1) ^ ((1 << bounds[b]) - 1) for b in chosen)
            mask -= (1 << BITS) if mask >> (BITS - 1) else 0
            keys.append(F.struct(F.lit(n).alias("table"), F.col(fp).bitwiseAND(F.lit(mask).cast("long")).alias("key")))
        return F.inline(F.array(*keys))

    asked = queries.select("query").where("query is not null").distinct().select("query", permuted("query"))
    held = table.select("fp").where("fp is not null").distinct().select("fp", permuted("fp"))
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return asked.join(held, ["table", "key"]).where(distance <= radius).select("query", "fp", distance.alias("distance")).distinct()


def _bucket(value: Column, bounds: list) -> Column:
    """How many bounds are at most the value, by a balanced tree of comparisons."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(bounds[middle]), among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(bounds))


def _bounds(docs: DataFrame, id_col: str, ranges: int) -> list:
    """Values of the id that cut the rows into about so many ranges of about equal size, in ascending order."""
    kind = docs.schema[id_col].dataType
    if ranges < 2:
        return []
    if isinstance(kind, StringType):  # quantiles of the ids with the least hashes
        drawn = docs.select(F.col(id_col).alias("id")).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(min(DRAWN, 50 * ranges)).collect()
        ids = sorted((r["id"] for r in drawn), key=str.encode)
        return sorted({ids[len(ids) * i // ranges] for i in range(1, ranges)}, key=str.encode) if ids else []
    shares = [i / ranges for i in range(1, ranges)]
    return sorted(set(docs.agg(F.percentile_approx(id_col, shares, 4 * ranges)).first()[0] or []))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of an edited one, whose end comes from the next document.

    The last floor(n_chars / share) code points give way to the first as many (or all) of the
    next document in descending id order; after the last comes the first. Returns doc_id,
    n_chars, edited_sha256, fp, edited_fp, near_edited, near_next.

    Ids are numbers, dates, timestamps or strings, in the order of their own type. Null texts count
    as empty; a null id comes after all others; rows that repeat an id are ordered by their texts,
    the greatest first; a single document follows itself. An empty table gives an empty result.
    Other columns aren't read.

    Ids are cut into ranges of about equal numbers of rows (the driver gets a bound for each range),
    so the next row is found within a range. A range also gets the first row of the next one. The
    texts are shuffled once, by range.
    """
    bounds = _bounds(docs, id_col, buckets or 4 * partitions(docs.sparkSession))
    place = F.lit(len(bounds)) - _bucket(F.col("doc_id"), bounds) if bounds else F.lit(0)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).withColumn("bucket", F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(place))

    first = rows.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "text")).alias("head"))
    after = Window.orderBy("bucket")  # a row for each range
    ahead = F.coalesce(F.lead("head").over(after), F.first("head").over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    borrowed = first.select(F.col("bucket"), ahead.alias("head")).select(F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), "bucket", F.lit(True).alias("borrowed"))

    within = Window.partitionBy("bucket").orderBy("borrowed", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    all_rows = rows.withColumn("borrowed", F.lit(False)).unionByName(borrowed)
    all_rows = all_rows.withColumn("n", F.row_number().over(within)).withColumn("next", F.coalesce(F.lead("text").over(within), F.lit("")))
    n_chars = F.char_length("text").cast("long")
    cut = F.floor(F.char_length("text") / share).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - cut), F.substring("next", F.lit(1), cut))
    both = all_rows.select("bucket", "n", "borrowed", "doc_id", n_chars.alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "n", "borrowed", "doc_id", "n_chars", "edited_sha256", "side"]
    sides = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    prints = _fingerprints(both.select(*keys[:-1], sides), keys)
    pair = prints.groupBy(*keys[:-1]).agg(*(F.max(F.when(F.col("side") == side, F.col("fp"))).alias(name) for side, name in enumerate(("fp", "edited_fp"))))
    in_order = Window.partitionBy("bucket").orderBy("n")
    paired = pair.withColumn("next_fp", F.lead("fp").over(in_order)).where(~F.col("borrowed"))
    result = paired.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
    return written(result, "edited")
