import random
import zlib

import numpy as np
from conftest import ODD, make_docs
from pyspark.sql import functions as F

from shelfwise.llm import language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) > 0.98 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.collect())
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_change_nothing(documents):
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1
    other = documents.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    a, b = (sorted(language_id.identify(d).collect()) for d in (documents, other))
    assert a == b


def test_odd_rows(spark, documents, odd, none):
    model = language_id.learn(documents, F.lit(True))
    rows = language_id.predict(odd, model, "text", "guess", "sure").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.guess == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.guess != "und" or r.sure == 0
    assert language_id.identify(none).count() == 0
    unlabelled = make_docs(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(odd).collect()} == {"und", "en"}
    kept = language_id.drop_unidentified(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0


def test_presence_counts_each_gram_once():
    a, b = (language_id.present(language_id.letters(t)) for t in ("abc abc abc", "ABC, abc. 123 abc"))
    assert (a == b).all()
    assert language_id.letters("12 3!") is None


def test_kernels_and_scores_match_plain_sums(documents):
    model = language_id.learn(documents, F.lit(True))
    rng = random.Random(3)
    texts = [language_id.letters(r.text) for r in documents.limit(30).collect()] + [np.frombuffer(rng.randbytes(40_000), dtype=np.uint8)]
    scores, bests, _ = model.whole(texts)
    marks = [set(np.flatnonzero(m)) for m in model.landmarks.T]
    for text, found, best in zip(texts, scores, bests):
        total = np.zeros(len(model.languages))
        for piece in language_id.pieces(text):
            grams = set()
            for n in range(1, 5):
                for i in range(len(piece) - n + 1):
                    code = int.from_bytes(bytes(piece[i : i + n]), "big")
                    grams.add(((code + n) * 2654435769 % 2**32) >> 18)
            kernels = np.array([len(grams & m) / (len(grams) * len(m)) ** 0.5 for m in marks])
            total += kernels @ model.root @ model.weights * len(piece)
        assert np.allclose(found, total / len(text), atol=1e-4) and best == found.argmax()


def test_more_languages_than_are_sampled_fully(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_SAMPLED", 300)
    monkeypatch.setattr(language_id, "MOST_LANDMARKS", 100)
    rng = random.Random(1)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for _ in range(80)]
    rows = [(i, " ".join("".join(rng.choice(alphabets[i % 80]) for _ in range(6)) for _ in range(60)), f"l{i % 80:02d}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert len({r.lang_pred for r in found}) == 80
    assert sum(r.lang == r.lang_pred for r in found) > 0.9 * len(found)


def test_long_texts_are_told_apart_as_well_as_short_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1 and lang is not null and text is not null")
    model = language_id.learn(docs, F.lit(True))
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 and lang is not null and text is not null")
    long_ = held.withColumn("n", F.length("text")).groupBy("lang").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text")).where(F.length("text") > 50_000)
    rows = language_id.predict(long_, model).collect()
    assert len(rows) >= 3 and all(r.lang == r.lang_pred and r.score > 0.8 for r in rows)


def test_texts_in_an_unlearned_language_go_and_held_out_ones_stay(spark):
    rng = random.Random(4)
    foreign = [
        "в начале было слово и люди жили долго на берегу большой реки каждый день они работали в поле",
        "στην αρχή ήταν ο λόγος και οι άνθρωποι ζούσαν κοντά στο ποτάμι κάθε μέρα δούλευαν",
        "天 地 玄 黄 宇 宙 洪 荒 日 月 盈 昃 辰 宿 列 张",
        "alussa oli sana ja ihmiset asuivat suuren joen rannalla joka päivä he työskentelivät pellolla",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)),
        " ".join("%032x" % rng.getrandbits(128) for _ in range(20)),
    ]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null and trim(text) <> ''")
    learned = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    model = language_id.learn(learned, F.lit(True))
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    known = language_id.predict(held, model, "text", "guess", "sure", reject=True)
    assert known.where("guess = 'und'").count() <= language_id.RARE * held.count()
    odd = learned.unionByName(make_docs(spark, [(10**9 + i, t) for i, t in enumerate(foreign)]).withColumn("lang", F.lit(None).cast("string")).select(*learned.columns))
    kept = language_id.drop_unidentified(odd)
    assert kept.where("doc_id >= 1000000000").count() == 0
    assert kept.count() >= (1 - language_id.RARE) * learned.count()
