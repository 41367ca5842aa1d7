import hashlib
import random

import pytest
from conftest import ODD, make_docs

from shelfwise.llm import fingerprints

MASK = (1 << 64) - 1


def neighbours(rows):
    """rows in descending order of id (null last), then of text, each with the next one's text."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    return [(i, t or "", (order[(n + 1) % len(order)][1] or "")) for n, (i, t) in enumerate(order)]


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_edited_texts(spark, odd, buckets):
    rows = fingerprints.edited_fingerprints(odd, buckets=buckets).collect()
    expected = []
    for i, text, after in neighbours(ODD):
        cut = len(text) // 3
        expected.append((i or -1, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in rows) == sorted(expected)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_ids_of_any_size_and_kind(spark, kind):
    random.seed(9)
    own = [2**60 + i for i in range(40)] if kind == "long" else [f"doc-{i:05d}" for i in range(40)] if kind == "string" else [i / 7 for i in range(40)]
    rows = [(i, " ".join(random.choice("abcdefgh") * random.randint(1, 9) for _ in range(30))) for i in random.sample(own, 40)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    order = sorted(rows, reverse=True)
    expected = {i: hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest() for (i, t), (_, after) in zip(order, order[1:] + order[:1])}
    for buckets in (1, 4):
        assert {r.doc_id: r.edited_sha256 for r in fingerprints.edited_fingerprints(docs, buckets=buckets).collect()} == expected


def test_fingerprints_are_the_text_s_own(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    alone = {r.doc_id: r.fp for r in fingerprints.fingerprint_texts(documents).collect()}
    edited = {r.doc_id: r for r in fingerprints.edited_fingerprints(documents).collect()}
    assert all(edited[i].fp == alone[i] for i, _ in rows)
    texts = [(i, text[: len(text) - len(text) // 3] + after[: len(text) // 3]) for i, text, after in neighbours(rows)]
    again = {r.doc_id: r.fp for r in fingerprints.fingerprint_texts(make_docs(spark, texts)).collect()}
    assert all(edited[i].edited_fp == again[i] for i, _ in rows)
    order = sorted(alone, reverse=True)
    for i, after in zip(order, [*order[1:], order[0]]):
        assert edited[i].near_next == 1 - ((alone[i] ^ alone[after]) & MASK).bit_count() / 64
    close = sum(r.near_edited > r.near_next for r in edited.values() if r.n_chars > 200)
    assert close > 0.95 * sum(r.n_chars > 200 for r in edited.values())


def test_votes_match_a_plain_count(spark):
    """Spark's own hash is asked for each term; the votes are counted here."""
    from pyspark.sql import functions as F

    random.seed(2)
    words = [random.choice(["alpha", "of", "the", "grünen", "x" * 40, "zeta"]) for _ in range(500)]
    terms = [(a, b) for a, b in zip(words, words[1:])] + [(words[-1], None)]
    hashed = spark.createDataFrame(terms, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    votes = [0] * 64
    for a, b, h in hashed:
        weight = min(len(a.encode()) + len((b or "").encode()), fingerprints.MOST_WEIGHT)
        for bit in range(64):
            votes[bit] += weight if h >> bit & 1 else -weight
    expected = sum(1 << b for b in range(64) if votes[b] > 0)
    (found,) = fingerprints.fingerprint_texts(make_docs(spark, [(1, "  " + " \n".join(words) + "\t")])).collect()
    assert found.fp & MASK == expected


def test_radius_search(spark):
    random.seed(4)
    values = [random.getrandbits(64) for _ in range(50)]
    for v in list(values):
        for _ in range(8):
            for b in random.sample(range(64), random.randint(0, 5)):
                v ^= 1 << b
            values.append(v)
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    table = spark.createDataFrame([(v,) for v in [*signed, None]], "fp long")
    queries = spark.createDataFrame([(v,) for v in [*signed[::7], None]], "query long")
    found = sorted((r.query, r.fp, r.distance) for r in fingerprints.within_radius(queries, table, radius=3).collect())
    expected = sorted((q, v, ((q ^ v) & MASK).bit_count()) for q in signed[::7] for v in signed if ((q ^ v) & MASK).bit_count() <= 3)
    assert found == expected
    with pytest.raises(ValueError):
        fingerprints.within_radius(queries, table, radius=5, blocks=5)


def test_none(none):
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert fingerprints.fingerprint_texts(none).count() == 0
