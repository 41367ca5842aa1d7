"""b-bit MinHash near-deduplication.

A document is the set of its word shingles. Of each of HASHES hash functions the least value over the
set is found; bands of ROWS such minima, hashed, are the keys under which candidates meet. Of every
minimum only the lowest BITS bits are kept, packed in bit planes: two sets agree in a place with
probability C + (1 - C) J, where C = 2 ** -BITS is that of a chance agreement, so J is estimated from
the places that differ, counted by XOR, OR and bit_count. Candidates whose estimate is too low go;
the rest is confirmed on full sets.

BANDS and the bound of the estimate are chosen so that of pairs at the least similarity about one in
10 ** 9 and one in 10 ** 10 is missed. Documents with one and the same set are one class, and are linked as such.

Large groups don't become all pairs. First each class is checked with one other, the most central that it
meets: the hub of a key is the class that shares most keys with most others. Then those that meet
and aren't in one component yet are checked: all under a key of up to CROWD classes, else each with the key's hub. If after
that a crowded key's classes aren't in one component, they are joined on the prefixes of their sets, which finds all similar pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, ids_repeat, written
from .near_dedup import CROWD, SEED, components, similar_links, similar_pairs, word_shingles

#: Minima of a band, and bands: a pair at 0.85 meets in none with probability (1 - 0.85 ** 5) ** 38, 2 in 10 ** 10.
ROWS = 5
BANDS = 38
#: Hash functions (a multiple of 64, at least ROWS * BANDS) and the bits kept of each minimum.
HASHES = 192
BITS = 2
#: The chance of losing a pair at the least similarity by its estimate.
MISS = 1e-10
#: Shingles hashed at once, so that a very long text needs little memory.
CHUNK = 4096


def hash_family(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of n hash functions over 32 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each hash function over a set of 64-bit shingle hashes."""
    factors, summands = family
    upper = (shingles.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(upper), CHUNK):
        np.minimum(least, (upper[at : at + CHUNK, None] * factors + summands).min(axis=0), out=least)
    return least


def band_keys(found: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key of each band of each row of minima; the same minima in another band have another key."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(found), bands)).copy()
    cut = found[:, : rows * bands].astype(np.uint64).reshape(len(found), bands, rows)
    for i in range(rows):
        keys = (keys ^ cut[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def bit_planes(found: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of the minima, 64 of one plane in each long, plane after plane."""
    planes = [np.packbits((found >> np.uint32(b) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64) for b in range(bits)]
    return np.concatenate(planes, axis=1)


def most_differing(least: float, hashes: int, bits: int, miss: float = MISS) -> int:
    """How many places may differ: a pair of similarity least differs in more with a probability below miss."""
    differ = (1 - 2.0**-bits) * (1 - least)
    tail = 1.0
    for n in range(hashes + 1):
        tail -= comb(hashes, n) * differ**n * (1 - differ) ** (hashes - n)
        if tail < miss:
            return n
    return hashes


def differing(a: str, b: str, hashes: int, bits: int) -> Column:
    """The number of places in which two packed signatures differ."""
    words = hashes // 64

    def places(word: int) -> Column:
        planes = [F.get(a, F.lit(word + p * words)).bitwiseXOR(F.get(b, F.lit(word + p * words))) for p in range(bits)]
        return F.bit_count(planes[0] if bits == 1 else planes[0].bitwiseOR(planes[1]) if bits == 2 else _or(planes))

    total = places(0)
    for word in range(1, words):
        total = total + places(word)
    return total


def _or(planes: list[Column]) -> Column:
    out = planes[0]
    for p in planes[1:]:
        out = out.bitwiseOR(p)
    return out


def estimated(differ: Column, hashes: int, bits: int) -> Column:
    """The similarity that so many differing places speak for, corrected for chance agreement."""
    chance = 2.0**-bits
    return ((hashes - differ) / F.lit(float(hashes)) - chance) / (1 - chance)


def signatures(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, bands: int = BANDS, hashes: int = HASHES, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, key (128 bits that equal sets share), planes and bands of each row; without words n_shingles is 0 and the rest null."""
    if hashes % 64 or rows * bands > hashes:
        raise ValueError("hashes must be a multiple of 64 and no fewer than rows * bands")
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches):
        family = hash_family(hashes)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [word_shingles(x, words) for x in part.column(1).to_pylist()]
                blank = np.array([not len(s) for s in sets])
                found = np.stack([minima(s, family) for s in sets])
                keys = [None if not len(s) else xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets]

                def lists(values: np.ndarray) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))

                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists(bit_planes(found, bits)), lists(band_keys(found, rows, bands))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key", "planes", "bands"]) if not blank.any() else _blanked(columns, blank)

    rows_ = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows_.mapInArrow(of, f"doc_id {kind}, n_shingles long, key binary, planes array<long>, bands array<long>")


def _blanked(columns: list[pa.Array], blank: np.ndarray) -> pa.RecordBatch:
    """With null planes and bands where there are no words."""
    import pyarrow.compute as pc

    nulled = [pc.if_else(pa.array(blank), pa.scalar(None, c.type), c) for c in columns[3:]]
    return pa.RecordBatch.from_arrays([*columns[:3], *nulled], names=["doc_id", "n_shingles", "key", "planes", "bands"])


def _size_fits(a: str, b: str, least: float) -> Column:
    return F.least(a, b) >= least * F.greatest(a, b)


def _pair(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def hubs_of(met: DataFrame) -> DataFrame:
    """band and hub (weight, node, n) of each key: the class that shares most keys with most others."""
    central = met.groupBy("node").agg(F.sum("members").alias("weight"))
    return met.join(central, "node").groupBy("band").agg(F.max(F.struct("weight", "node", "n")).alias("hub"))


def first_pairs(met: DataFrame, hubs: DataFrame, least: float) -> DataFrame:
    """A pair (a, b), a > b, of each class and the hub that shares most keys with most others, of those that it meets and that its size allows: no more pairs than classes."""
    spokes = met.join(hubs, "band").where((F.col("node") != F.col("hub.node")) & _size_fits("n", "hub.n", least))
    return spokes.groupBy("node").agg(F.max("hub").alias("hub")).select(*_pair("node", "hub.node")).distinct()


def open_pairs(placed: DataFrame, hubs: DataFrame, least: float, crowd: int) -> DataFrame:
    """Distinct pairs (a, b), a > b, of classes that meet and aren't in one component (root) yet: all of a key with up to crowd classes, else each with the key's hub."""
    quiet = placed.where(F.col("members") <= crowd).select("band", "node", "n", "root")
    other = quiet.select("band", *(F.col(c).alias(f"other_{c}") for c in ("node", "n", "root")))
    pairs = quiet.join(other, "band").where((F.col("node") > F.col("other_node")) & (F.col("root") != F.col("other_root")) & _size_fits("n", "other_n", least)).select(*_pair("node", "other_node"))
    crowds = placed.where(F.col("members") > crowd)
    rooted = crowds.join(hubs, "band")
    hub_roots = rooted.where(F.col("node") == F.col("hub.node")).select("band", F.col("root").alias("hub_root"))
    spokes = rooted.join(hub_roots, "band").where((F.col("root") != F.col("hub_root")) & _size_fits("n", "hub.n", least))
    return pairs.unionByName(spokes.select(*_pair("node", "hub.node"))).distinct()


def minhash_groups(docs: DataFrame, least: float = 0.85, words: int = 3, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, rows: int = ROWS, bands: int = BANDS, hashes: int = HASHES, bits: int = BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Rows are linked if the Jaccard similarity of their sets of shingles is at least `least`; component_id
    is the least id reachable, its own included (null if all those ids are null), and kept
    tells the rows that have that id. A text with fewer words than a shingle is one shingle. Null
    texts and those without words have an empty set, are linked with nothing and kept. Rows that
    repeat an id are documents of their own; a null id is never anyone's component_id, and such a row
    is kept only if its component has no other id. Other columns of docs aren't read. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    repeat = ids_repeat(slim, "id")
    marked = slim.withColumn("node", F.struct("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")) if repeat else F.col("id"))
    own = F.col("doc_id.id") if repeat else F.col("doc_id")
    prints = written(signatures(marked, words, "node", "text", rows, bands, hashes, bits), "signatures")
    grouped = prints.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.min(own).alias("least"), F.first("n_shingles").alias("n"), F.first("planes").alias("planes"), F.first("bands").alias("bands"))
    classes = written(grouped, "classes")

    keyed = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    met = written(keyed.join(shared, "band"), "met")
    hubs = written(hubs_of(met), "hubs")
    sides = [classes.select(F.col("node").alias(c), F.col("planes").alias(f"{c}_planes")) for c in "ab"]
    likely = differing("a_planes", "b_planes", hashes, bits) <= most_differing(least, hashes, bits)
    texts = marked.dropDuplicates(["node"]) if repeat else marked

    def confirmed(pairs: DataFrame) -> DataFrame:
        estimated_ = pairs.join(sides[0], "a").join(sides[1], "b").where(likely).select("a", "b")
        return similar_pairs(texts, estimated_, least, words, "node", "text")

    def placed(roots: DataFrame) -> DataFrame:
        return met.join(roots, "node", "left").select("band", "node", "n", "members", F.coalesce("root", "node").alias("root"))

    links = confirmed(first_pairs(met, hubs, least))
    before = written(components(links), "roots")
    links = links.unionByName(confirmed(open_pairs(placed(before), hubs, least, crowd)))
    roots = written(components(links), "roots")
    discard(before)
    crowds = placed(roots).where(F.col("members") > crowd)
    open_ = crowds.groupBy("band").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("band")
    rest = written(crowds.join(open_, "band", "left_semi").select("node").distinct(), "open")
    if not rest.isEmpty():
        of_rest = written(texts.join(rest, "node", "left_semi").select("node", "text"), "rest")
        links = links.unionByName(similar_links(of_rest, links, least, words, "node", "text", crowd))
        before, roots = roots, written(components(links), "roots")
        discard(before, of_rest)
    discard(met, hubs, rest)

    rooted = classes.select("key", "least", "node").join(roots, "node", "left").select("key", "least", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    found = prints.select(own.alias("doc_id"), "n_shingles", "key")
    found = found.where("key is not null").join(named, "key").unionByName(found.where("key is null").withColumn("component_id", F.col("doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
