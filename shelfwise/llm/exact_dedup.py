"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are
sorted, and a block's place in that order is its integer name. Then the names of adjacent blocks
are paired, the distinct pairs are sorted and named in the same way, and so on, until each
document has one name. Equal texts, and only they, end with the same name on the same level.

The blocks are sorted by keys of 128 bits of hash, not by their bytes, so that names need no
second shuffle of the texts. That every key stands for one block is not assumed but checked: the
least and the greatest block of each key must be equal, or all is done again with longer keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, ids_repeat, lower_az, one_of_each, whole_text, written

#: Bytes of a block. Longer texts take one more round of pairs for each doubling.
BLOCK_BYTES = 16 * 1024
#: Longs of hash in a block's first key.
KEY_LONGS = 2


def _blocks(text: Column, size: int) -> Column:
    bytes_ = text.cast("binary")
    last = F.greatest(F.floor((F.octet_length(text) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(bytes_, i * size + 1, F.lit(size)))


def _keys(block: Column, longs: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), block).alias(f"k{seed}") for seed in range(longs)] or [F.lit(0).alias("k")]


def _named(values: DataFrame, name: str) -> DataFrame:
    """The distinct rows of values with a number each, which rises in their sort order."""
    distinct = values.distinct()
    return written(distinct.repartitionByRange(*values.columns).sortWithinPartitions(*values.columns).withColumn("name", F.monotonically_increasing_id()), name)


def normal_text(column: str) -> Column:
    """Texts are equal if this is: null counts as empty, A-Z are lower-cased."""
    return lower_az(whole_text(column))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key_longs: int = KEY_LONGS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, identity.

    Of equal texts (null as empty, A-Z as a-z) the row with the largest id stays; a null id is
    smaller than any other. Of rows that repeat that id, one stays. identity is the pair
    (level, name), the same for equal texts only. Other columns of docs aren't read, whatever
    their names. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), normal_text(text_col).alias("normal"))
    longs = key_longs
    while True:
        keyed = source.select(F.explode(_blocks(F.col("normal"), block_bytes)).alias("block")).select(*_keys(F.col("block"), longs), "block")
        keys = [c for c in keyed.columns if c != "block"]
        shared = keyed.groupBy(*keys).agg(F.min("block").alias("least"), F.max("block").alias("greatest")).where("least <> greatest")
        if shared.isEmpty():
            break
        longs += 1
    rows = written(source.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2("normal", 256).alias("text_sha256"), F.transform(_blocks(F.col("normal"), block_bytes), lambda b: F.struct(*_keys(b, longs))).alias("keys")), "rows")

    parts = rows.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key")).select("row", "n", "pos", "key.*")
    names = _named(parts.select(*keys), "names")
    parts, level, ended = written(parts.join(names, keys).select("row", "n", "pos", "name"), "parts"), 0, []
    used = [rows, names, parts]
    while True:
        ended.append(parts.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        more = parts.where("n > 1")
        if more.isEmpty():
            break
        first, second = (F.max(F.when(F.col("pos") % 2 == i, F.col("name"))) for i in (0, 1))
        pairs = more.groupBy("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(first.alias("a"), F.coalesce(second, F.lit(-1)).alias("b"))
        names, level = _named(pairs.select("a", "b"), "names"), level + 1
        parts = written(pairs.join(names, ["a", "b"]).select("row", "n", "pos", "name"), "parts")
        used += [names, parts]
    identified = written(rows.drop("keys").join(reduce(DataFrame.unionByName, ended), "row"), "identities")
    discard(*used)

    groups = written(identified.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")), "groups")  # apart from the join, so that Spark can split a large group there
    joined = identified.join(groups, ["level", "name"])
    return joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", F.struct("level", "name").alias("identity"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns, one of each group.

    Of rows that repeat both id and normalised text one stays: the one whose other columns, as JSON,
    come last in order. Null texts count as empty; an empty table gives an empty result.
    """
    kept = exact_groups(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    marked = docs.withColumn("_sha", F.sha2(normal_text(text_col), 256))
    stay = marked.join(kept, (marked["_sha"] == kept["_kept_sha"]) & marked[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
    return (one_of_each(stay, [id_col, "_sha"]) if ids_repeat(docs, id_col) else stay).drop("_sha")
