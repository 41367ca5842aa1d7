import hashlib
import random
import string

from conftest import ODD, make_docs

from shelfwise.llm import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def by_brute_force(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return sorted((i, max((x for x in own if x is not None), default=None), len(own), hashlib.sha256(t.encode()).hexdigest()) for t, own in groups.items() for i in own if i is not None)


def found(frame):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in frame.collect() if r.doc_id is not None)


def test_matches_brute_force_with_odd_rows(spark, odd):
    rows = exact_dedup.exact_groups(odd, block_bytes=64)
    assert found(rows) == by_brute_force(ODD)
    kept = rows.where("kept").collect()
    assert len(kept) == len({(t or "").translate(LOWER) for _, t in ODD})
    assert rows.select("identity").distinct().count() == len(kept)


def test_texts_that_share_blocks(spark):
    random.seed(3)
    blocks = ["a" * 8, "b" * 8, "c" * 8]
    rows = [(i, "".join(random.choices(blocks, k=random.randint(0, 5))) + "a" * random.randint(0, 3)) for i in range(400)]
    assert found(exact_dedup.exact_groups(make_docs(spark, rows), block_bytes=8)) == by_brute_force(rows)


def test_keys_that_collide_are_made_longer(spark):
    rows = [(i, f"text {i % 5}") for i in range(20)]
    assert found(exact_dedup.exact_groups(make_docs(spark, rows), key_longs=0)) == by_brute_force(rows)


def test_empty_table(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact_copies(none).count() == 0


def test_drop_keeps_one_row_of_each_group_with_its_columns(odd):
    stay = exact_dedup.drop_exact_copies(odd)
    assert stay.columns == odd.columns
    assert stay.count() == len({(t or "").translate(LOWER) for _, t in ODD})


def test_ties_of_one_id_and_text_leave_the_row_that_comes_last(spark):
    rows = [(1, "A", "en"), (1, "a", "fr"), (1, "a", "de"), (1, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted((r.text, r.lang) for r in exact_dedup.drop_exact_copies(docs).collect()) == [("a", "fr"), ("b", None)]
