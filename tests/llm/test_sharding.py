import zlib
from collections import Counter

from conftest import ODD

from shelfwise.llm import sharding


def test_law_slots_and_columns(odd):
    rows = sharding.stratified_shards(odd, shards=5).collect()
    assert len(rows) == len(ODD)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    told = sorted((r.size, r.text_crc32) for r in rows)
    assert told == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in ODD)


def test_every_shard_has_the_mixture(spark):
    counts = {"big": 700, "mid": 250, "small": 50, None: 24}
    docs = spark.createDataFrame([(n * 1000 + i, f"t{i}", s) for n, (s, k) in enumerate(counts.items()) for i in range(k)], "doc_id long, text string, source string")
    rows = sharding.stratified_shards(docs, shards=8).collect()
    by = Counter((r.shard, r.source) for r in rows)
    for source, k in counts.items():
        assert all(abs(by[s, source] - k / 8) <= 2 for s in range(8))
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.stratified_shards(docs.repartition(7), shards=8).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}
    other = {r.doc_id: r.shard for r in sharding.stratified_shards(docs, shards=8, seed=1).collect()}
    assert other != {r.doc_id: r.shard for r in rows}


def test_fewer_rows_than_shards_and_none(odd, none):
    assert sharding.stratified_shards(none).count() == 0
    assert sharding.stratified_shards(odd.limit(3), shards=16).count() == 3
