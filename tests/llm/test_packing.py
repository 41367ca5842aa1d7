import zlib

import numpy as np
import public_tokenizers
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfwise.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def least_bins(sizes, capacity):
    """By trying all placements."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_bounds_and_fits(sizes):
    sizes = sorted(sizes, reverse=True)
    array = np.array(sizes, dtype=np.int64)
    least = least_bins(sizes, 12) if sizes else 0
    bins, offsets, n = packing.best_fit_decreasing(array, 12)
    assert packing.lower_bound(array, 12) <= least <= n
    for b in range(n):
        own = sorted((o, s) for o, s, x in zip(offsets, sizes, bins) if x == b)
        at = 0
        for offset, size in own:
            assert offset == at
            at += size
        assert at <= 12


def check(docs, rows, **options):
    encode = Tokenizer.from_file(PATH)
    pieces = packing.token_pieces(docs, PATH).collect()
    packed = packing.pack(packing.token_pieces(docs, PATH), **options).collect()
    key = lambda r: (r.doc_id or -1, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, pieces)) == sorted(map(key, packed))
    expected = []
    for i, text in rows:
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        expected += [(i or -1, n, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted(map(key, packed)) == sorted(expected)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins), sum(r.length for r in packed)


def test_odd_rows(odd):
    check(odd, ODD)


def test_documents(documents):
    n, total = check(documents, [(r.doc_id, r.text) for r in documents.collect()])
    assert n <= -(-total // 1024) + 3


def test_partitions_with_gaps_exchange_documents(spark):
    random = np.random.default_rng(0)
    sizes = random.integers(100, 700, 600).tolist()
    pieces = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long")

    def bins(**options):
        return packing.pack(pieces, part_rows=15, **options).select("sequence_id").distinct().count()

    assert packing.lower_bound(np.array(sizes), 1024) <= bins() < bins(rounds=0)


def test_certified_packings_are_optimal(spark):
    random = np.random.default_rng(5)
    sizes = random.integers(2, 9, 60).tolist()
    pieces = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long")
    rows = packing.pack(pieces, capacity=12, part_rows=8, rounds=0).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.certified, {}).setdefault(r.sequence_id, []).append(r.length)
    assert parts.get(True)
    own = sorted((s for bin_ in parts[True].values() for s in bin_), reverse=True)
    assert packing.lower_bound(np.array(own), 12) <= len(parts[True])
    whole = packing.pack(pieces, capacity=12).collect()
    if all(r.certified for r in whole):
        assert len({r.sequence_id for r in whole}) == packing.lower_bound(np.array(sizes), 12)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t'sS1a\u00e9\u0660<|endoftx>", max_size=60))
def test_ids_are_the_library_s(text):
    encode = Tokenizer.from_file(PATH)
    assert packing._ids(PATH).fast and packing._ids(PATH)(text).tolist() == encode.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_take_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some words, and 12 numbers"
    assert packing._Ids(path).fast is None and packing._Ids(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing._ids(PATH)(" " * 1_000_000).tolist() == Tokenizer.from_file(PATH).encode(" " * 1_000_000, add_special_tokens=False).ids


def test_none(none):
    assert packing.pack(packing.token_pieces(none, PATH)).count() == 0
