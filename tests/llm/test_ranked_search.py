import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import ODD, make_docs

from shelfwise.llm import ranked_search

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(x for _, _, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    found = []
    for item, text in items:
        scored = []
        for i, c, size in counted:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        found += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(found, key=str)


def searched(spark, docs, items, k=20, **options):
    index = ranked_search.build_index(make_docs(spark, docs))
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, query string")
    return sorted((tuple(r) for r in ranked_search.search_index(index, frame, k, **options).collect()), key=str)


def test_matches_brute_force(spark, documents, monkeypatch):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    docs += [(i + 1000, t) for i, t in docs[:40]] + [(5000 + i, "shared words of a passage " + str(i % 3)) for i in range(60)]
    random.seed(2)
    items = [(i, " ".join(random.choice(docs)[1].split()[:30])) for i in range(25)] + [(30, "Shared PASSAGE"), (31, "words words words of"), (32, "1 a")]
    for k in (1, 20):
        assert searched(spark, docs, items, k) == plain(docs, items, k)
    assert searched(spark, docs, items, 5, query_bytes=1000) == plain(docs, items, 5)  # many blocks of queries


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "?!"), (4, "long end"), (5, "grüße GRÜßE ÀÉ"), (None, "same row"), (6, "same row"), (6, "one"), (6, "one"), (7, "unheard")]
    assert searched(spark, ODD, items) == plain(ODD, items, 20)
    assert searched(spark, ODD, []) == [] and searched(spark, [], items) == []
    assert searched(spark, [(1, None), (2, " ")], items) == []


def test_numbers_are_packed_and_unpacked():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 5])
    data, starts = ranked_search.pack_numbers(values)
    assert (ranked_search.unpack_numbers(data) == values).all() and len(starts) == len(values) and starts[3] == 3


def test_small_segments_find_the_same_and_skip_blocks(monkeypatch):
    """On one segment of long lists: as brute force, with blocks of common terms that are never decompressed."""
    random.seed(3)
    docs = [(i, " ".join(random.choices("abcdefgh", k=20)) + (f" rare{i % 50} zebra{i}" if i < 1000 else "")) for i in range(20_000)]
    segment = ranked_search.Segment()
    for i, t in docs:
        segment.add(i, t.encode())
    kinds = [("segment", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("last", pa.list_(pa.int32())), ("most", pa.list_(pa.int32())), ("least", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64())]
    table = pa.Table.from_batches(list(segment.rows(0, pa.schema(kinds))))
    df = dict(zip(table["term"].to_pylist(), table["df"].to_pylist()))
    n, total = len(docs), sum(len(terms(t)) for _, t in docs)
    queries = [(f"q{i}", Counter(terms(f"rare{i} zebra{i} a b c d"))) for i in range(5)]
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items() if t}
    made = []
    block = ranked_search.Postings.block
    monkeypatch.setattr(ranked_search.Postings, "block", lambda self, i, m: (made.append((id(self), i)), block(self, i, m))[1])
    found = ranked_search.top_of_segment(table, queries, weights, n, total, 5)
    expected = plain(docs, [(f"q{i}", f"rare{i} zebra{i} a b c d") for i in range(5)], 5)
    assert sorted(((q, s) for q, _, s in found), key=str) == sorted(((q, s) for q, _, _, s in expected), key=str)
    blocks = sum(-(-df[t] // ranked_search.BLOCK) for t in "abcd")
    assert len(set(made)) < blocks / 3
