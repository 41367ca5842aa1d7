"""SimHash near-deduplication by multi-index hashing.

A fingerprint's bit is 1 if it is set in over half of the hashes of the text's word shingles.
Distinct fingerprints are linked at `radius` or fewer differing bits. For that a fingerprint is
cut into segments; if two differ in at most `radius` bits, then in some segment they differ in at
most radius // segments. So each fingerprint enumerates the Hamming ball of that radius within
each of its segments, looks the values up in the segment's table, and complete distances are
verified for what is found.

A segment value that very many distinct fingerprints share (a large group of near copies) would
give pairs in the square of their number. For such values the whole fingerprint is used: two
fingerprints at most 2s bits apart have a common neighbour within s bits of each, so members list
all their neighbours, and those who meet in one are linked through the least of them. That is as
exact, and its rows are in proportion to the members. Links are made between fingerprints, not
documents, so copies of a text cost nothing more.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, discard, drawn_share, flagged, ids_repeat, one_of_each, release, written

BITS = 64
SEED = 42
#: Members of a segment's table entry up to which pairs are verified one by one.
CROWD = 64
#: Common shingles that are put last in the order of prefixes, at most: they are broadcast, in 16 bytes each.
MOST_COMMON = 1 << 16
#: Rows of a common shingle that are looked at together.
SHARE_ROWS = 1 << 12
#: Longs of a set's sketch.
SKETCH_LONGS = 32


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of a text in UTF-8: A-Z lower-cased, split at ASCII white space, seed 42, equal votes."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    form, digest = b" ".join([b"%b"] * width), xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, dtype=np.int64), len(words) - width + 1
    for at in range(0, n, 1 << 16):  # so that a very long text needs little memory
        part = words[at : at + (1 << 16) + width - 1]
        hashes = np.array([digest(form % x, SEED) for x in zip(*(part[i:] for i in range(width)))], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row; a null or blank text has fingerprint 0."""

    def of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = [fingerprint(x or b"", shingle) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _masks(bits: range, radius: int, least: int = 0) -> list[int]:
    """All masks of at least `least` and at most radius of the bits, as signed longs."""
    masks = (sum(1 << b for b in chosen) for n in range(least, radius + 1) for chosen in combinations(bits, n))
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _longs(values: list[int]):
    return F.array(*(F.lit(v).cast("long") for v in values))


def near_pairs(prints: DataFrame, radius: int = 2, segments: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between the distinct values of the column fp.

    Every two fingerprints at most radius bits apart are linked directly or, in a crowd, through
    a common third one that is also at most radius bits from both. No link joins fingerprints
    further apart than radius.
    """
    if radius % 2:
        raise ValueError("radius must be even, for the common neighbours of a crowd")
    bounds = [round(BITS * i / segments) for i in range(segments + 1)]
    spans = [range(a, b) for a, b in zip(bounds, bounds[1:])]
    near, full = radius // segments, radius % segments + 1  # the first `full` segments need the radius near, the others near - 1
    distinct = prints.select("fp").distinct()

    def keyed(balls: list[list[int]], name: str) -> DataFrame:
        """fp, segment and each value within that segment's ball."""

        def values(segment: int) -> Column:
            (mask,) = _masks(spans[segment], len(spans[segment]), len(spans[segment]))
            own = F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
            return F.transform(_longs(balls[segment]), lambda flip: F.struct(F.lit(segment).alias("segment"), own.bitwiseXOR(flip).alias("value")))

        tables = [values(i) for i in range(segments)]
        return distinct.select(F.col("fp").alias(name), F.inline(F.concat(*tables)))

    table = keyed([[0]] * segments, "b")
    crowds = written(table.groupBy("segment", "value").count().where(F.col("count") > crowd).select("segment", "value"), "crowds")
    probes = keyed([_masks(span, near - (i >= full)) for i, span in enumerate(spans)], "a")
    keys = ["segment", "value"]
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    quiet = probes.join(table.join(crowds, keys, "left_anti"), keys).where((F.col("a") != F.col("b")) & (apart <= radius)).select("a", "b")
    if crowds.isEmpty():
        return quiet
    members = probes.join(crowds, keys, "left_semi").select(F.col("a").alias("fp")).distinct()
    around = members.select("fp", F.explode(_longs(_masks(range(BITS), radius // 2))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    least = around.groupBy("middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("middle", "b")
    return quiet.unionByName(around.join(least, "middle").where("fp <> b").select(F.col("fp").alias("a"), "b"))


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of every node that has a link, by alternating stars.

    A round joins each node's larger neighbours, then its smaller ones, to the least node next to
    it, until nothing changes. Rows never exceed the links. Each round is written to the shared
    folder, which cuts the lineage.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = written(links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    size = (edges.count(), None)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).select("col.*")
        before, edges = edges, written(small.where("a <> b").distinct(), "edges")
        discard(before)
        total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == size:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        size = tuple(total)


def near_groups(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", segments: int = 2, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id.

    component_id is the least id of all rows whose fingerprints can be reached over links of at
    most radius differing bits, the row's own included; null if all those ids are null. Null
    and blank texts share fingerprint 0, which is linked as any other. Equal texts and repeated
    rows share a fingerprint. Other columns of docs aren't read. An empty table gives an empty
    result.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = written(components(near_pairs(prints, radius, segments, crowd)), "roots")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "classes")
    discard(roots)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def word_shingles(text: bytes | None, words: int) -> np.ndarray:
    """The distinct hashes of the shingles of a text, in ascending order; fewer words are one shingle, none are an empty set."""
    form, digest = b" ".join([b"%b"] * words), xxhash.xxh64_intdigest
    parts = (text or b"").lower().split()
    own = {digest(form % x, SEED) for x in zip(*(parts[i:] for i in range(words)))} or ({digest(b" ".join(parts), SEED)} if parts else set())
    found = np.fromiter(own, dtype=np.uint64, count=len(own)).view(np.int64)
    found.sort()
    return found


def _shingles(text: bytes | None, words: int) -> np.ndarray:
    """word_shingles(), but a text without words has one shingle too, so that such texts are alike."""
    found = word_shingles(text, words)
    return found if len(found) else np.array([xxhash.xxh64_intdigest(b"", SEED)], dtype=np.uint64).view(np.int64)


def _of_sets(docs: DataFrame, words: int, id_col: str, text_col: str, among: DataFrame | None, made, columns: dict[str, str]) -> DataFrame:
    """doc_id and the columns that made() gives, as arrays, for the list of the sets of some rows.

    among: ids whose sets are wanted, in one column. A few other rows may have sets then too, as rows are chosen
    by a bitmap of fixed size, so that texts needn't be shuffled to be joined with the ids.
    """
    flags = docs.sparkSession.sparkContext.broadcast(None if among is None else bitmap(among))

    def of(batches):
        wanted = flags.value
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(flagged(wanted, batch.column(2).to_numpy())))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = made([_shingles(text, words) for text in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["doc_id", *columns])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(id_col).alias("hash"))
    told = "".join(f", {name} {kind}" for name, kind in columns.items())
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}{told}")


def shingle_sets(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", among: DataFrame | None = None) -> DataFrame:
    """doc_id and the distinct hashes of the shingles of each row's whole text; fewer words are one shingle. among: see _of_sets()."""
    return _of_sets(docs, words, id_col, text_col, among, lambda sets: [pa.array(sets, pa.list_(pa.int64()))], {"shingles": "array<long>"})


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits, as longs, of which each is set if a shingle's hash falls on it."""
    bits = np.zeros(64 * SKETCH_LONGS, dtype=bool)
    bits[shingles.view(np.uint64) % np.uint64(len(bits))] = True
    return np.packbits(bits).view(np.int64)


def _sketches(docs: DataFrame, words: int, id_col: str, text_col: str, among: DataFrame) -> DataFrame:
    """doc_id, n (the size of the row's set) and bits, its sketch. among: see _of_sets()."""

    def made(sets):
        return [pa.array([len(x) for x in sets], pa.int32()), pa.array([_sketch(x) for x in sets], pa.list_(pa.int64()))]

    return _of_sets(docs, words, id_col, text_col, among, made, {"n": "int", "bits": "array<long>"})


def _prefixes(docs: DataFrame, least: float, words: int, id_col: str, text_col: str, common) -> DataFrame:
    """doc_id, the shingles of each row's prefix, place: the size of the row's set, and in the lower 32 bits how many come after the shingle, and share.

    Two sets of similarity `least` share at least least * n of either's n shingles, so if shingles
    have one order for all, their first n - ceil(least * n) + 1 have one in common. The order is
    that of the hashes, but those in the broadcast array of common come last. A shingle that has several shares
    there deals its rows to them, numbered from 1; else share is 0.
    """

    def of(batches):
        last, shares = common.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, sizes, dealt = [], [], []
                for text, drawn in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    own = _shingles(text, words)
                    parts = np.ones(len(own), dtype=np.int64)
                    if len(last):
                        nearest = np.minimum(np.searchsorted(last, own), len(last) - 1)
                        late = last[nearest] == own
                        own, parts = np.concatenate([own[~late], own[late]]), np.concatenate([parts[~late], shares[nearest[late]]])
                    n = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                    sizes.append(len(own))
                    found.append(own[:n])
                    dealt.append(np.where(parts[:n] > 1, drawn % parts[:n] + 1, 0))
                counts = [len(x) for x in found]
                rows, n = pa.array(np.repeat(np.arange(part.num_rows), counts)), np.repeat(np.array(sizes, dtype=np.int64), counts)
                after = n - 1 - np.concatenate([np.arange(c) for c in counts])
                columns = [part.column(0).take(rows), pa.array(np.concatenate(found)), pa.array(n << 32 | after), pa.array(np.concatenate(dealt).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shingle", "place", "share"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("drawn"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, shingle long, place long, share int")


def _common(docs: DataFrame, words: int, id_col: str, text_col: str, crowd: int, share_rows: int, most: int = MOST_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of likely over crowd rows, in ascending order, and the number of shares of each, by the rows in an eighth of the ids' hashes.

    They are the `most` frequent ones at most, as they are broadcast. Any order of shingles and any number of shares finds the same pairs.
    """
    drawn = docs.where(drawn_share(F.xxhash64(F.col(id_col).cast("string")), 1 / 8))
    found = shingle_sets(drawn, words, id_col, text_col).select(F.explode("shingles").alias("shingle"))
    found = found.groupBy("shingle").count().where(F.col("count") > crowd / 8).orderBy(F.desc("count"), "shingle").limit(most).toArrow()
    shingles, counts = found.column("shingle").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], -(-8 * counts[order] // share_rows)


def similar_links(docs: DataFrame, known: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Links (a, b), a > b, of ids whose Jaccard similarity over shingles is at least `least`.

    With the links of known, they have the components that known and all such pairs have. Similar
    sets meet in a shingle of their prefixes. First each shingle's most central row, the one with
    the largest share of its set from there on, is checked with its others: copies that were
    edited little are like most of their group. A very frequent shingle's rows are dealt into shares of some
    share_rows rows, so that no task has all of them; each share's central row is checked with its others,
    and with the most central of all. Then all pairs that meet in a shingle and aren't in one
    component yet are checked, so a large group of near copies takes no pairs in the square of its
    number. Shingles that seem common are the last in the prefixes' order, so that a passage in
    many texts doesn't bring them together; which those are is estimated, as any order finds the
    same pairs.
    """
    sc = docs.sparkSession.sparkContext
    rows = _prefixes(docs, least, words, id_col, text_col, sc.broadcast(_common(docs, words, id_col, text_col, crowd, share_rows)))
    every = Window.partitionBy("shingle", "share")
    after, size = (lambda place: F.col(place).bitwiseAND((1 << 32) - 1)), (lambda place: F.shiftright(place, 32))
    hub = F.max(F.struct((after("place") / size("place")).alias("central"), "place", "doc_id")).over(every)
    rows = rows.withColumns({"hub": hub, "least": F.min("doc_id").over(every), "last": F.max("doc_id").over(every)}).where("least < last or share > 0")
    told = F.struct(F.when(F.col("share") > 0, F.col("hub.central")).alias("central"), "hub.place", "hub.doc_id")  # how central it is, where it is asked for
    met = written(rows.select("shingle", "doc_id", "place", "share", told.alias("hub")), "met")
    release(docs.sparkSession)  # the prefixes' shuffle is the largest

    def fits(one: str, other: str) -> Column:
        """If sets' sizes and what comes after the shingle in each leave room; the first shingle in common of similar sets does."""
        n, m, rest = size(one), size(other), F.least(after(one), after(other)) + 1
        return (F.least(n, m) >= least * F.greatest(n, m)) & (rest * (1 + least) >= least * (n + m) - 1e-6)

    def ordered(a: str, b: str) -> list[Column]:
        return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]

    in_shares = met.where((F.col("share") > 0) & (F.col("doc_id") == F.col("hub.doc_id"))).select("shingle", "doc_id", "place", "hub")
    tops = in_shares.join(in_shares.groupBy("shingle").agg(F.max("hub").alias("top")), "shingle").select("doc_id", "place", F.col("top").alias("hub"))
    pairs = met.select("doc_id", "place", "hub").unionByName(tops).where((F.col("doc_id") != F.col("hub.doc_id")) & fits("place", "hub.place"))
    checked = written(pairs.select(*ordered("doc_id", "hub.doc_id")).distinct(), "checked")
    found = similar_pairs(docs, checked, least, words, id_col, text_col)
    roots = written(components(known.select("a", "b").unionByName(found)), "roots")
    placed = met.select("shingle", "doc_id", "place").join(roots, met["doc_id"] == roots["node"], "left").select("shingle", "doc_id", "place", F.coalesce("root", "doc_id").alias("root"))
    # in each shingle the members of its largest component needn't be compared with each other
    sizes = placed.groupBy("shingle", "root").count().groupBy("shingle").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("parts"))
    open_ = written(placed.join(sizes.where("parts > 1"), "shingle"), "open")
    discard(met, roots)
    release(docs.sparkSession)
    x, y = (open_.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "place", "root")), *([] if side == "y" else [F.col("main")])) for side in "xy")
    more = x.where("root_x <> main").join(y, "shingle").where((F.col("root_x") != F.col("root_y")) & fits("place_x", "place_y"))
    more = more.select(*ordered("doc_id_x", "doc_id_y")).distinct().join(checked, ["a", "b"], "left_anti")
    return found.unionByName(similar_pairs(docs, more, least, words, id_col, text_col))


def similar_pairs(docs: DataFrame, pairs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b) of ids whose documents' Jaccard similarity over shingles is at least `least`.

    Every bit that one set's sketch has and the other's lacks is a shingle that the other set lacks. Pairs whose
    sizes and sketches alone rule the similarity out aren't brought together, and whole sets are made only of
    documents that are in one of the other pairs, each once.
    """
    pairs = written(pairs.select("a", "b").distinct(), "candidates")

    def ids(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id"))

    def alike(both: Column) -> Column:
        return both >= least * (F.col("a_n") + F.col("b_n") - both)

    def shared(one: str, other: str) -> Column:
        """How many shingles of one set are in the other at most."""
        lacked = F.aggregate(F.zip_with(f"{one}_bits", f"{other}_bits", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)
        return F.col(f"{one}_n") - lacked

    sketches = written(_sketches(docs, words, id_col, text_col, ids(pairs)), "sketches")
    sketched = [sketches.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in "ab"]
    sized = pairs.join(sketched[0], "a").join(sketched[1], "b").where(F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n"))
    fitting = written(sized.where(alike(F.least(shared("a", "b"), shared("b", "a")))).select("a", "b", "a_n", "b_n"), "fitting")
    discard(pairs, sketches)
    sets = written(shingle_sets(docs, words, id_col, text_col, ids(fitting)), "shingles")
    joined = fitting.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    found = written(joined.where(alike(F.size(F.array_intersect("x", "y")))).select("a", "b"), "similar")
    discard(sets, fitting)
    release(docs.sparkSession)
    return found


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, words: int = 5, **options) -> DataFrame:
    """The rows of docs, with all their columns, but of each group only the one with the least id.

    Groups are those of near_groups, and joined with them all pairs that have a Jaccard similarity
    of at least `least` over shingles of `words` words. Rows that repeat both id and text count as
    one. If ids repeat with other texts, rows are told apart by id and text, so that unlike texts
    with one id all stay; of a group's rows with the least id, the one whose text has the least
    hash stays. Rows with a null id stay. Null and blank texts are alike. An empty table gives an
    empty result.
    """
    named = docs.where(F.col(id_col).isNotNull())
    text_hash = F.xxhash64(F.coalesce(text_col, F.lit("")))
    repeat = ids_repeat(named, id_col)
    marked = named.withColumn("_node", F.struct(F.col(id_col).alias("id"), text_hash.alias("text")) if repeat else F.col(id_col))
    strict = near_groups(marked, id_col="_node", text_col=text_col, **options)
    links = strict.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    links = written(links.distinct(), "strict")
    roots = components(links.unionByName(similar_links(marked, links, least, words, "_node", text_col, options.get("crowd", CROWD))))
    gone = written(roots.where("node <> root").select(F.col("node").alias("_gone")).distinct(), "gone")
    stay = marked.join(gone, marked["_node"] == gone["_gone"], "left_anti")
    stay = (one_of_each(stay, ["_node"]) if repeat else stay).drop("_node")
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
