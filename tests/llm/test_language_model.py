import math
import random
import zlib
from collections import Counter

import numpy as np
from conftest import ODD

from shelfwise.llm import language_model, spelling


def plain_scores(rows):
    split = [(i, (t or "").encode().lower().split() + ["end"], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    counts = Counter(w for _, words, held in split if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    return sorted((i or -1, held, len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6)) for i, words, held in split)


def found(frame):
    return sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in frame.collect())


def test_counts_and_base_match_a_plain_version(spark, documents, odd):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    scores = language_model.score_texts(documents)
    assert found(scores) == plain_scores(rows)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in scores.collect())
    assert found(language_model.score_texts(odd)) == plain_scores(ODD)


def words_of(documents):
    words = documents.selectExpr("explode(split(lower(text), ' ')) as word").where("word <> ''").selectExpr("cast(word as binary) as word")
    return words.groupBy("word").count().withColumnRenamed("count", "n")


def test_counts_dont_depend_on_where_words_are_looked_up_or_texts_are_cut(spark, documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    monkeypatch.setattr(language_model, "FREQUENT", 100)
    monkeypatch.setattr(language_model, "PIECE", 1000)
    monkeypatch.setattr(language_model, "SLICE", 5000)
    assert found(language_model.score_texts(documents)) == plain_scores(rows)


def test_scores_dont_depend_on_partitions_and_beat_the_base(spark, documents):
    once = {r.doc_id: r for r in language_model.score_texts(documents).collect()}
    again = {r.doc_id: r for r in language_model.score_texts(documents.repartition(3)).collect()}
    assert once.keys() == again.keys() and all(abs(again[i].score - r.score) < 1e-9 * abs(r.score) for i, r in once.items())
    assert sum(r.score for r in once.values()) > sum(r.base_score for r in once.values())
    known = [r for r in once.values() if r.held_out and r.n_known == r.n_tokens]
    assert known and sum(r.score for r in known) > sum(r.base_score for r in known)


def test_a_text_that_occurs_elsewhere_is_cheap(spark, documents):
    rng = random.Random(4)
    words = sorted({w for r in documents.limit(20).collect() for w in r.text.split()})
    texts = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(6)]
    rows = [(10_000 + i, t) for i, t in enumerate(texts)] + [(20_000 + i, t) for i, t in enumerate(texts[:3])]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    bits = {r.doc_id: r.bits_per_byte for r in language_model.score_texts(docs).collect()}
    twice, alone = [bits[10_000 + i] for i in range(3)], [bits[10_000 + i] for i in range(3, 6)]
    assert max(twice) < 0.6 * min(alone)


def test_tokens_match_a_plain_split():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"aAbZ \n\t\x0b\x0c\r\x00\xc3") for _ in range(rng.randrange(60))) for _ in range(200)]
    t = language_model.tokens(texts, np.ones(len(texts), dtype=int))
    plain = [(i, w) for i, text in enumerate(texts) for w in [*text.lower().split(), None]]
    assert t.text.tolist() == [i for i, _ in plain] and t.is_word.tolist() == [w is not None for _, w in plain]
    assert t.endings.tolist() == [language_model.END if w is None else (b" " + w)[-2] << 8 | w[-1] for _, w in plain]
    of_key = {}
    assert all(of_key.setdefault(k, w) == w for k, (_, w) in zip(t.keys.tolist(), plain)) and len(set(of_key.values())) == len(of_key)
    assert [bytes(t.data[a : a + n]) for a, n in zip(t.starts, t.lengths)] == [w for _, w in plain if w is not None]


def test_words_that_differ_in_few_bytes_have_keys_of_their_own():
    words = sorted({(a + b + c).encode() for a in ("abcdefgh", "abcdefgi", "") for b in map(str, range(3000)) for c in ("", "ja", "ra", "\x00")})
    t = language_model.tokens([b" ".join(words)], np.zeros(1, dtype=int))
    assert len(set(t.keys.tolist())) == len(words)


def plain_log10(model, t):
    """What Endings.log10 computes, one bit at a time."""
    out, steps_of = [], {}
    for i, n, b, s0, s1 in zip(*model.events(t)[:3], *model.events(t)[3]):
        steps_of.setdefault(int(i), []).append((int(n), int(b), int(s0), int(s1)))
    errors, text = {}, None
    for i in range(len(t.keys)):
        if t.text[i] != text:
            text, errors = t.text[i], {}
        total = 0.0
        for d, (n, b, s0, s1) in enumerate(steps_of[i]):
            w = model.weights[model.seen[0, s0] * 4 + model.seen[1, s1]]
            x = min(max(w[0] * model.odds[n] + w[1] * model.hashed_odds[0, s0] + w[2] * model.hashed_odds[1, s1], -12), 12)
            p = 1 / (1 + math.exp(-x))
            if d < language_model.REFINED:
                error, spread = errors.get(n, (0.0, 0.0))
                x += error / (spread + language_model.STEADY)
                errors[n] = error + b - p, spread + p * (1 - p)
            total += max(math.log10(1 / (1 + math.exp(-x if b else x))), -6)
        out.append(total - (math.log10(1 << 16) if model.code.class_of[t.endings[i]] == model.code.class_of[language_model.OTHER] else 0))
    return out


def learned_endings(spark, documents):
    rows = documents.selectExpr("false as held_out", "cast(text as binary) as text")
    words = language_model._word_counts(rows, 0).cache()
    counts = {r.ending: r.n for r in words.groupBy("ending").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    return language_model._learn_endings(rows, words, counts | {language_model.END: rows.count()}, sum(counts.values()), 0)


def test_endings_match_a_plain_version_and_add_up_to_one(spark, documents):
    model = learned_endings(spark, documents)
    assert len({tuple(w) for w in model.weights}) > 1
    texts = [r.text.encode() for r in documents.limit(3).collect()] + [b"", b"zq\xff zq\xff the end"]
    t = language_model.tokens(texts, np.ones(len(texts), dtype=int))
    assert np.allclose(model.log10(t), plain_log10(model, t), rtol=1e-4)
    names = [c for c in range(language_model.OTHER) if model.code.class_of[c] != model.code.class_of[language_model.OTHER]]
    before = language_model.tokens([texts[0][:200]], np.zeros(1, dtype=int))
    total = 0.0
    for c in [*names, language_model.OTHER]:
        one = language_model.Tokens(np.append(before.text, 0), np.append(before.keys, np.uint64(7)), np.append(before.endings, c), before.data, before.starts, before.lengths, np.append(before.is_word, True))
        total += 10 ** (model.log10(one)[-1] + (math.log10(1 << 16) if c == language_model.OTHER else 0))
    assert abs(total - 1) < 1e-3


def test_stretches_match_a_plain_version(spark):
    rng = random.Random(6)
    occurrences = Counter((rng.randrange(12), rng.randrange(5), rng.randrange(3)) for _ in range(150))
    own = Counter()
    for (row, key, _), n in occurrences.items():
        own[row, key] += n
    held = lambda row: row % 4 == 0
    told = [(row, held(row), key, s, n, own[row, key], -3.0 * n) for (row, key, s), n in occurrences.items()]
    frame = spark.createDataFrame(told, "row long, held_out boolean, key long, stretch long, times long, own long, mixed double")
    cases, shares, gains = [], {}, Counter()
    for row, held_out, key, s, n, _, mixed in told:
        context = sum(m for (r, k, _), m in occurrences.items() if r != row and k == key and not held(r))
        again = sum(m for (r, k, x), m in occurrences.items() if (r, k, x) != (row, key, s) and r != row and k == key and x == s and not held(r))
        if context:
            cases.append((row, held_out, min(int(math.log2(context)), 8), n, mixed, context, again))
    for level in {c[2] for c in cases}:
        own_cases = [c for c in cases if c[2] == level and not c[1]]
        hits, all_ = sum(c[3] for c in own_cases if c[6]), sum(c[3] for c in own_cases)
        shares[level] = (hits + 0.4) / (all_ + 0.8) if own_cases else 0.5
    for row, _, level, n, mixed, context, again in cases:
        p = shares[level]
        gains[row] += n * (math.log10(p) + math.log10(again / context)) - mixed if again else n * math.log10(1 - p)
    found_gains = {r.row: r.mixed for r in language_model._stretch_gains(frame).collect()}
    assert found_gains.keys() == gains.keys() and all(abs(found_gains[k] - v) < 1e-9 for k, v in gains.items())


def test_lookup_finds_what_it_holds():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    lookup = language_model.Lookup(keys)
    found = lookup(keys)
    assert ((found == np.arange(5000)) | (found == -1)).all() and (found >= 0).mean() > 0.9 and (lookup(keys + np.uint64(1)) == -1).all()
    assert language_model.Lookup(keys[:0])(keys[:3]).tolist() == [-1] * 3


def test_none(none):
    assert language_model.score_texts(none).count() == 0


def test_spellings_add_up_to_one_at_most(spark, documents):
    """All words of three letters with one ending, and all first letters: the bits of a byte share out the probability."""
    model = spelling.learn(words_of(documents))
    p = 10 ** model.log10([bytes([b]) + b"he" for b in range(256) if b not in b" \t\n\r\x0b\x0c"])
    assert 0 < p.sum() < 1
    assert model.log10([b"a", b"he"])[0] == 0
    data, contexts, _ = spelling._events([b"th"])
    total = np.zeros(1)
    for byte in range(256):
        data = np.array([byte], dtype=np.uint8)
        logs = 0.0
        for bit, node, slots in spelling._bits(data, contexts[:, :1]):
            q = model.refined(node, model.mixed(slots)[2])
            logs = logs + np.log(np.where(bit, q, 1 - q))
        total += np.exp(logs)
    assert abs(total[0] - 1) < 1e-6


def test_online_mixing_beats_its_start_and_doesnt_depend_on_partitions(spark, documents):
    words = words_of(documents).cache()
    model = spelling.learn(words)
    sample = [bytes(r.word) for r in words.orderBy("word").limit(500).collect()]
    start = spelling._blank(model.odds, model.seen)
    assert model.log10(sample).mean() > start.log10(sample).mean()
    again = spelling.learn(words.repartition(3))
    assert (again.weights == model.weights).all() and (again.odds == model.odds).all() and (again.ones == model.ones).all()


def test_a_long_unseen_word_scores_the_sum_over_its_bits(spark, documents):
    rng = random.Random(2)
    word = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000))
    held = next(i for i in range(10**6, 10**6 + 100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(held, word.decode())], "doc_id long, text string"))
    rows = docs.selectExpr("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2 as held_out", "cast(text as binary) as text")
    plain = spelling.learn(language_model._word_counts(rows, 0)).log10([word])[0]
    (found,) = language_model.score_texts(docs).where(f"doc_id = {held}").collect()
    assert -30 < found.score - plain < 0  # its ending, the share of unseen words, and the end
    assert found.bits_per_byte > 1


def test_blending_agrees_with_plain_sums():
    own, logs = np.array([0.0, 0.25, 0.0]), np.array([-2.0, -1.0, -5000.0])
    assert np.allclose(language_model._blended(own, np.full(3, 0.5), logs), [math.log10(0.005), math.log10(0.3), math.log10(0.5) - 5000])


def plain_words_log10(model, t):
    """What Words.log10 computes, one bit at a time."""
    out, errors, text = [0.0] * len(t.keys), {}, None
    token, node, bit, (first, second) = model.events(t)
    for i, n, b, s0, s1 in zip(token.tolist(), node.tolist(), bit.tolist(), first.tolist(), second.tolist()):
        if t.text[i] != text:
            text, errors = t.text[i], {}
        w = model.weights[model.seen[0, s0] * 4 + model.seen[1, s1]]
        x = min(max(w[0] * model.odds[n] + w[1] * model.hashed_odds[0, s0] + w[2] * model.hashed_odds[1, s1], -12), 12)
        p, (error, spread) = 1 / (1 + math.exp(-x)), errors.get(n, (0.0, 0.0))
        x += error / (spread + language_model.STEADY)
        errors[n] = error + b - p, spread + p * (1 - p)
        out[i] += max(math.log10(1 / (1 + math.exp(-x if b else x))), -6)
    return out


def test_bits_of_frequent_words_match_a_plain_version_and_add_up_to_one(spark, documents):
    endings = learned_endings(spark, documents)
    model = endings.words
    texts = [r.text.encode() for r in documents.limit(3).collect()] + [b"", b"zq\xff zq\xff the end"]
    t = language_model.tokens(texts, np.ones(len(texts), dtype=int))
    found = model.log10(t)
    assert np.allclose(found, plain_words_log10(model, t), rtol=1e-4) and (found[model.coded(t.keys) >= 0] < 0).mean() > 0.5
    assert np.allclose(model.log10(t, endings.contexts(t)), found) and (found[~t.is_word] == 0).all()
    ending = int.from_bytes(b"he", "big")
    rest = int(model.code.class_of[ending])
    every = language_model.tokens([r.text.encode() for r in documents.collect()], np.ones(documents.count(), dtype=int))
    keys = np.unique(every.keys[(every.endings == ending) & (model.coded(every.keys) >= 0)])
    before, total = language_model.tokens([texts[0][:200]], np.zeros(1, dtype=int)), 0.0
    for key in [*keys.tolist(), 7]:
        one = language_model.Tokens(np.append(before.text, 0), np.append(before.keys, np.uint64(key)), np.append(before.endings, ending), before.data, before.starts, before.lengths, np.append(before.is_word, True))
        total += 10 ** model.log10(one)[-1]
    assert len(keys) > 3 and model.code.lengths[rest] > 0 and abs(total - 1) < 1e-3


def test_a_known_word_is_predicted_from_the_word_before(spark):
    """Both words have one ending and one count; only what they follow tells them apart."""
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    others = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, ("peter kab" if k % 2 else "quent lab") + f" w{k % 50}") for k, i in enumerate(others)]
    rows += [(held[0], "peter kab"), (held[1], "peter lab")]
    scores = {r.doc_id: r.score for r in language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()}
    assert scores[held[0]] > scores[held[1]] + 2


def test_endings_are_contexts_of_spellings_only(spark):
    """Other predictors code them: of the, its first byte and the word's end are learned; of a, nothing."""
    words = spark.createDataFrame([(bytearray(b"the"), 1), (bytearray(b"a"), 1)], "word binary, n long")
    bits = spelling._slot_counts(words).selectExpr("sum(zeros + ones) as n").first().n
    assert bits == 16 * 8 * 2 * spelling.TABLES
