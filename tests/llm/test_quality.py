import itertools
import zlib

import numpy as np
from conftest import ODD
from pyspark.sql import functions as F

from shelfwise.llm import quality


def test_marginals_match_all_paths():
    random = np.random.default_rng(1)
    sizes = [1, 4, 6, 2]
    features = random.normal(size=(sum(sizes), 3))
    firsts = np.cumsum(sizes) - sizes
    field = quality.Field(random.normal(size=3), random.normal(size=(2, 2)))
    good, at, pairs = field.marginals(features, firsts, pairs=True)
    odds = features @ field.weights
    for first, n in zip(firsts, sizes):
        weights = {}
        for path in itertools.product((0, 1), repeat=n):
            weights[path] = np.exp(sum(odds[first + i] * s for i, s in enumerate(path)) + sum(field.follow[a, b] for a, b in zip(path, path[1:])))
        total = sum(weights.values())
        for i in range(n):
            assert abs(good[first + i] - sum(w for p, w in weights.items() if p[i]) / total) < 1e-9
        for i in range(1, n):
            k = list(at).index(first + i)
            for a, b in itertools.product((0, 1), repeat=2):
                assert abs(pairs[a, b, k] - sum(w for p, w in weights.items() if (p[i - 1], p[i]) == (a, b)) / total) < 1e-9


def test_neighbours_stay_within_a_document():
    rows = np.arange(8.0).reshape(4, 2)
    wide = quality._with_neighbours(rows, np.array([0, 3]))
    assert wide[2].tolist() == [4, 5, 2, 3, 0, 0] and wide[3].tolist() == [6, 7, 0, 0, 0, 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) > 0.99 * len(good)
    assert sum(1 - r.predicted for r in bad) > 0.95 * len(bad)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_odd_rows(spark, documents, odd, none, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = quality.learn(documents, labels, F.lit(True))
    rows = quality.score(odd, field, "text", "found").collect()
    assert len(rows) == len(ODD) and all(0 <= r.found <= 1 for r in rows)
    assert quality.classify(none, labels).count() == 0
    odd_labels = spark.createDataFrame([(1, 0), (4, None), (None, 1), (5, 1), (5, 1)], "doc_id long, quality int")
    found = quality.classify(odd, odd_labels)
    assert found.count() == len(ODD)
    assert {r.score for r in quality.classify(odd, odd_labels.limit(0)).collect()} == {1.0}
    assert quality.drop_bad(odd, labels).columns == odd.columns


def test_held_out_labels_change_nothing(documents, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.classify(documents, labels).collect()) == sorted(quality.classify(documents, other).collect())
