import random

import xxhash
from conftest import ODD, make_docs

from shelfwise.llm import near_dedup

MASK = (1 << 64) - 1


def plain_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """prints: list of (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i][1] ^ prints[j][1]) & MASK).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(prints):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return sorted((own, least[find(i)]) for i, (own, _) in enumerate(prints) if own is not None)


def test_fingerprints_match_a_plain_version(odd):
    found = sorted((r.doc_id, r.fp & MASK) for r in near_dedup.fingerprints(odd).collect() if r.doc_id is not None)
    assert found == sorted((i, plain_fingerprint(t, 3)) for i, t in ODD if i is not None)


def test_groups_match_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    random.seed(1)
    for i in range(60):
        words = rows[random.randrange(len(rows))][1].split(" ")
        words[random.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words)))
    expected = brute_components([(i, plain_fingerprint(t, 3)) for i, t in rows], 2)
    for crowd in (64, 1):
        found = near_dedup.near_groups(make_docs(spark, rows), crowd=crowd)
        assert sorted((r.doc_id, r.component_id) for r in found.collect()) == expected


def test_links_between_random_and_near_values(spark):
    random.seed(5)
    values = [random.getrandbits(64) for _ in range(30)]
    for v in list(values):
        for _ in range(12):
            near = v
            for b in random.sample(range(64), random.randint(0, 4)):
                near ^= 1 << b
            values.append(near)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    for radius, segments in ((2, 2), (2, 3), (4, 3)):
        expected = dict(brute_components(list(enumerate(signed)), radius))
        for crowd in (64, 1):
            roots = {r.node: r.root for r in near_dedup.components(near_dedup.near_pairs(prints, radius, segments, crowd)).collect()}
            mine = {}
            for i, v in enumerate(signed):
                mine.setdefault(roots.get(v, v), []).append(i)
            theirs = {}
            for i, root in expected.items():
                theirs.setdefault(root, []).append(i)
            assert sorted(mine.values()) == sorted(theirs.values())


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    found = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert all(found[i] == 0 for i in range(301)) and found[1001] == 1000


def test_odd_rows_and_none(odd, none):
    found = near_dedup.near_groups(odd)
    assert found.count() == len(ODD)
    blank = {r.doc_id: r.component_id for r in found.collect()}
    assert blank[1] == blank[2] == blank[3] == 1 and blank[5] == 4
    assert near_dedup.near_groups(none).count() == 0
    assert near_dedup.drop_near_copies(odd).columns == odd.columns
    assert near_dedup.drop_near_copies(none).count() == 0


def test_copies_with_edits_go_and_other_documents_stay(spark):
    random.seed(8)
    lexicon = [f"w{i}" for i in range(3000)]
    common = ["the", "of", "and", "to", "in", "is"]
    base = [random.choice(common if random.random() < 0.6 else lexicon) for _ in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 9):
        copy = list(base)
        for at in random.sample(range(400), 2):
            copy[at] = random.choice(lexicon)
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(random.choice(common if random.random() < 0.6 else lexicon) for _ in range(400))) for i in range(20)]
    shuffled = list(base)
    random.shuffle(shuffled)
    rows += [(200, " ".join(shuffled)), (None, "a b"), (None, "c d")]
    stay = [r.doc_id for r in near_dedup.drop_near_copies(make_docs(spark, rows)).collect()]
    assert {i for i in stay if i is not None} >= {0, 200, *range(100, 120)} and stay.count(None) == 2
    assert len([i for i in stay if i is not None and 0 < i < 9]) <= 3
    sets = {r.doc_id: set(r.shingles) for r in near_dedup.shingle_sets(make_docs(spark, rows)).collect() if r.doc_id is not None}
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 9)] + [(200, 0)], "a long, b long")
    found = {r.a for r in near_dedup.similar_pairs(make_docs(spark, rows), pairs).collect()}
    assert found == {i for i in [*range(1, 9), 200] if len(sets[i] & sets[0]) >= 0.8 * len(sets[i] | sets[0])}


def brute_stay(rows):
    """The ids that stay, by all pairs: alike by five words at 0.8, or by fingerprints; of texts that are all different."""
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    prints = {i: plain_fingerprint(t, 3) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [i for i in ids if find(i) == i]


def test_what_stays_of_a_whole_table_is_what_brute_force_leaves(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(docs).collect()) == brute_stay(rows)


def test_a_large_group_whose_members_arent_all_alike(spark):
    random.seed(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in random.sample(range(150), random.randrange(12)):
            copy[at] = f"e{i}x{at}"
        rows.append((i, " ".join(copy)))
    random.shuffle(rows)
    for crowd in (64, 1):
        assert sorted(r.doc_id for r in near_dedup.drop_near_copies(make_docs(spark, rows), crowd=crowd).collect()) == brute_stay(rows)


def test_unlike_texts_with_one_id_all_stay(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (1, " ".join(reversed(words))), (1, " ".join(reversed(words))), (2, " ".join([*words[:-1], "other"])), (3, None), (3, None)]
    stay = sorted((r.doc_id, r.text or "") for r in near_dedup.drop_near_copies(make_docs(spark, rows)).collect())
    assert stay == [(1, " ".join(words)), (1, " ".join(reversed(words))), (3, "")]


def test_all_pairs_that_are_alike_by_shingles_are_joined(spark):
    random.seed(11)
    rows, passage = [], [f"p{i}" for i in range(30)]
    lines = [[f"l{i}x{j}" for j in range(12)] for i in range(12)]
    for order in range(4):  # the same words in other orders, so all families have about one fingerprint of single words
        base = [w for line in random.sample(lines, len(lines)) for w in line]
        for k in range(6):
            copy = list(base)
            for at in random.sample(range(len(copy)), k % 3):
                copy[at] = f"e{random.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(100 + i, " ".join(passage + [f"q{random.randrange(500)}" for _ in range(random.randrange(4, 40))])) for i in range(20)]
    random.shuffle(rows)
    docs = make_docs(spark, rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    prints = {i: plain_fingerprint(t, 3) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    expected = sorted(i for i in sets if find(i) == i)
    assert len(expected) >= 4
    for crowd in (64, 1):
        assert sorted(r.doc_id for r in near_dedup.drop_near_copies(docs, crowd=crowd).collect()) == expected


def test_whole_sets_are_made_only_of_texts_that_can_be_alike(spark, monkeypatch):
    random.seed(11)
    texts = [[random.choice(["a", "b", "c"]) + str(random.randrange(99)) for _ in range(n)] for n in (300, 300, 300, 300, 3000, 3000, 4, 0)]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    for i, words in enumerate(texts[:6]):
        for k, at in enumerate(([5], [0, -1], range(5, 200, 40), range(0, 300, 12))):
            edited = list(words)
            for x in at:
                edited[x] = "edited"
            rows.append((10 * (i + 1) + k, " ".join(edited)))
    docs, ids = make_docs(spark, rows), sorted(i for i, _ in rows)
    sets = {r.doc_id: set(r.shingles) for r in near_dedup.shingle_sets(docs).collect()}
    expected = {(a, b) for a in ids for b in ids if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    made, whole = [], near_dedup.shingle_sets

    def counted(*args):
        made.append({r.doc_id for r in whole(*args).collect()})
        return whole(*args)

    monkeypatch.setattr(near_dedup, "shingle_sets", counted)
    every = spark.createDataFrame([(a, b) for a in ids for b in ids if a > b], "a long, b long")
    assert {(r.a, r.b) for r in near_dedup.similar_pairs(docs, every).collect()} == expected and len(expected) > 30
    unlike = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (5, 4), (20, 0)], "a long, b long")
    made.clear()
    assert near_dedup.similar_pairs(docs, unlike).isEmpty() and not made[0] & {0, 1, 2, 3, 20}
