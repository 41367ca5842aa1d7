import random

import numpy as np
import pytest
from conftest import ODD, make_docs

from shelfwise.llm import minhash, near_dedup


def shingles(text, words=3):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def plain(rows, percent=85):
    """All pairs. rows: (id, text); gives (id, set size, component, kept)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return sorted(((own, len(sets[i]), least.get(find(i)), own == least.get(find(i))) for i, (own, _) in enumerate(rows)), key=str)


def found(spark, rows, **options):
    return sorted((tuple(r) for r in minhash.minhash_groups(make_docs(spark, rows), **options).collect()), key=str)


def edited(words, n, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_groups_match_brute_force(spark, documents):
    rng = random.Random(6)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    base = [rng.choice(rows)[1].split() for _ in range(20)]
    for k, words in enumerate(base):
        rows += [(1000 + 100 * k + i, edited(words, min(len(words), rng.randint(0, 1 + len(words) // 20)), rng)) for i in range(6)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, crowd=1) == plain(rows)  # all keys are crowds


def test_large_group_of_unlike_edits(spark):
    """A chain of edits, each like the next but not like the first, and a passage that many short texts share: all through crowds."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(words))]
    for i in range(1, 120):
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(500 + 3 * i + j, f"{passage} own {i} a{i} b{i} c{i} d{i} " + "z " * j) for i in range(60) for j in range(3)]
    rows += [(900 + i, edited(passage.split(), 2, rng)) for i in range(80)]
    assert found(spark, rows, crowd=8) == plain(rows)


def test_odd_rows(spark):
    rows = [*ODD, (20, "a b"), (21, "A  B"), (22, "a b c"), (None, "no id"), (None, None)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    only_empty = [(1, None), (2, " "), (2, " ")]
    assert found(spark, only_empty) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_exact_bound(spark):
    """17 of 20 shingles in the union is just enough, 16 of 19 isn't."""
    common = [f"s{i}" for i in range(19)]  # 17 shingles
    rows = [(1, " ".join([*common, "a"])), (2, " ".join(["b", "c", *common])), (3, " ".join(["y", "z", *common, "q", "r"]))]
    assert found(spark, rows) == plain(rows) and [r[2] for r in found(spark, rows)][:2] == [1, 1]


def test_estimates_are_unbiased_and_the_bound_is_safe():
    rng = np.random.default_rng(3)
    family = minhash.hash_family(minhash.HASHES)
    for j in (0.3, 0.6, 0.85, 0.95):
        errors, differ = [], []
        for _ in range(60):
            n = 300
            both = round(2 * n * j / (1 + j))
            pool = rng.integers(-(2**63), 2**63, 2 * n - both)
            x, y = pool[:n], pool[n - both :]
            planes = minhash.bit_planes(np.stack([minhash.minima(x, family), minhash.minima(y, family)]), minhash.BITS).view(np.uint64)
            words = minhash.HASHES // 64
            d = sum(int((planes[0][w] ^ planes[1][w]) | (planes[0][w + words] ^ planes[1][w + words])).bit_count() for w in range(words))
            chance = 2.0**-minhash.BITS
            errors.append(((minhash.HASHES - d) / minhash.HASHES - chance) / (1 - chance) - both / (2 * n - both))
            differ.append(d)
        assert abs(np.mean(errors)) < 0.02
        if j >= 0.85:
            assert max(differ) <= minhash.most_differing(0.85, minhash.HASHES, minhash.BITS)
    with pytest.raises(ValueError):
        minhash.signatures(None, hashes=100)


def test_columns_count_differing_places(spark):
    rows = make_docs(spark, [(1, "one two three four five six seven"), (2, "one two three four five six eight"), (3, "x y z")])
    signed = minhash.signatures(rows, 3)
    pairs = signed.alias("x").crossJoin(signed.alias("y")).selectExpr("x.doc_id a", "y.doc_id b", "x.planes p", "y.planes q")
    told = {(r.a, r.b): r.e for r in pairs.select("a", "b", minhash.estimated(minhash.differing("p", "q", minhash.HASHES, minhash.BITS), minhash.HASHES, minhash.BITS).alias("e")).collect()}
    assert told[1, 1] == 1.0 and abs(told[1, 2] - 4 / 6) < 0.2 and abs(told[1, 3]) < 0.2 and told[1, 2] == told[2, 1]


def test_shares_of_hot_shingles_change_nothing(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, edited(words, rng.randint(0, 4), rng)) for i in range(150)] + [(500 + i, edited([f"v{k}" for k in range(40)], 3, rng)) for i in range(60)]
    docs = make_docs(spark, rows)
    none = spark.createDataFrame([], "a long, b long")
    groups = []
    for share_rows in (4096, 10):
        links = near_dedup.similar_links(docs, none, 0.8, 3, crowd=8, share_rows=share_rows)
        groups.append(sorted((r.node, r.root) for r in near_dedup.components(links).collect()))
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(i, j) for i in sets for j in sets if i > j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    expected = near_dedup.components(spark.createDataFrame(pairs, "a long, b long"))
    assert groups[0] == groups[1] == sorted((r.node, r.root) for r in expected.collect())
