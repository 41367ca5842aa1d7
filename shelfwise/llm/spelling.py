"""Probabilities of spellings: the bit predictors for words that have too few counts of their own.

A word is predicted byte by byte from its end to its start, and a byte bit by bit. Predictors for
several contexts (0 to 3 bytes before, and all of the word so far) hold counts of zeros and ones in
hashed slots. Their log odds are mixed by weights that a gate selects (how much two of the contexts
have been seen), which are learned online, and an adaptive table refines the mixed probability.
The ending, which others predict, is only a context here.
Each distinct word of the corpus is learned from once and scored once, however often it occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of a predictor's table (a power of 2), and tables: contexts of 0 to 3 bytes and the whole word so far.
SLOT_BITS, TABLES = 18, 5
GATES, BINS = 16, 33
RATE, PRIOR = 0.02, 0.4
#: Bytes that are scored at once, and words on average that mixing weights are learned from in one sequence.
CHUNK_BYTES, BUCKET_WORDS = 1 << 19, 1 << 16
_SPACE = np.uint8(32)
_MIX = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's share of 64 bits, a usual factor for hashing


def _events(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words, each reversed and with a space after it, the hash of each context of each byte, and each word's first byte."""
    data = np.frombuffer(b" ".join(w[::-1] for w in words) + b" ", dtype=np.uint8)
    sizes = np.array([len(w) + 1 for w in words])
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(firsts, sizes)
    contexts = np.zeros((TABLES, len(data)), dtype=np.uint64)
    contexts[0] = np.minimum(place, 15)
    code = np.zeros(len(data), dtype=np.uint64)
    for k in range(1, TABLES - 1):
        before = np.full(len(data), _SPACE)
        before[k:] = data[:-k]
        code = code << np.uint64(8) | np.where(place >= k, before, _SPACE).astype(np.uint64)
        contexts[k] = code
    powers = np.cumprod(np.full(int(sizes.max()), _MIX | np.uint64(1), dtype=np.uint64))
    summed = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place])])
    contexts[TABLES - 1] = summed[:-1] - np.repeat(summed[firsts], sizes)  # of the word's bytes so far
    return data, (contexts + np.arange(1, TABLES + 1, dtype=np.uint64)[:, None]) * _MIX, firsts


def _asked(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which bytes are predicted: not a word's ending, or its only byte and its end."""
    asked = np.ones(len(data), dtype=bool)
    asked[np.concatenate([firsts, firsts + 1])] = False
    return asked


def _bits(data: np.ndarray, contexts: np.ndarray):
    """For each of the 8 bits: the bits, the node (the byte's bits before), and the slot in each table."""
    byte, hashed = data.astype(np.uint64), contexts ^ contexts >> np.uint64(29)
    for j in range(8):
        node = np.uint64(1) << np.uint64(j) | byte >> np.uint64(8 - j)
        mixed = hashed + node * np.uint64(0xD1342543DE82EF95)
        mixed *= _MIX
        mixed >>= np.uint64(64 - SLOT_BITS)
        yield (data >> (7 - j)) & 1, node.astype(np.int64), mixed.view(np.int64)


def _chunks(batches, *names: str, sized: str = "word"):
    """Lists of the columns, of rows whose words have about CHUNK_BYTES."""
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in names]
        words, start, size = columns[names.index(sized)], 0, 0
        for i, word in enumerate(words):
            size += len(word) + 1
            if size >= CHUNK_BYTES or i + 1 == len(words):
                yield [c[start : i + 1] for c in columns]
                start, size = i + 1, 0


@dataclass
class Model:
    odds: np.ndarray  # log odds of a one in each slot of each table
    seen: np.ndarray  # 0 to 3, how much the slot has been seen
    weights: np.ndarray  # by gate and table
    ones: np.ndarray  # of the refining table, by node and bin
    total: np.ndarray

    def mixed(self, slots: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The tables' log odds, the gates, and the mixed log odds."""
        inputs = [self.odds[k].take(slots[k]) for k in range(TABLES)]
        gates = (self.seen[-1].take(slots[-1]) * np.uint8(4) + self.seen[3].take(slots[3])).astype(np.intp)
        weights = np.ascontiguousarray(self.weights.T, dtype=np.float32)
        return inputs, gates, np.clip(sum(weights[k].take(gates) * inputs[k] for k in range(TABLES)), -12, 12)

    def refined(self, node: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """The probability of a one: the average of the mixed one and what followed such ones."""
        place = node * BINS + np.rint((mixed + 12) * np.float32((BINS - 1) / 24)).astype(np.int64)
        ones, total = (x.ravel().astype(np.float32)[place] for x in (self.ones, self.total))
        p = 1 / (1 + np.exp(-mixed))
        return np.clip((p + (ones + 8 * p) / (total + 8)) / 2, np.float32(1e-6), np.float32(1 - 1e-6))

    def log10(self, words: list[bytes]) -> np.ndarray:
        """The log10 probability of each word, given its last two bytes (or its only one)."""
        data, contexts, firsts = _events(words)
        found, asked = np.zeros(len(data)), _asked(data, firsts)
        told = np.zeros(int(asked.sum()))
        for bit, node, slots in _bits(data[asked], contexts[:, asked]):
            p = self.refined(node, self.mixed(slots)[2])
            told += np.log10(np.where(bit, p, 1 - p))
        found[asked] = told
        return np.add.reduceat(found, firsts)


def _blank(odds: np.ndarray, seen: np.ndarray) -> Model:
    return Model(odds, seen, np.full((GATES, TABLES), 0.3), np.zeros((256, BINS)), np.zeros((256, BINS)))


def _weights(counts) -> np.ndarray:
    """How often a word that occurs n times counts: log2(1 + n), in sixteenths, as it has a share of its own."""
    return np.rint(np.log2(1 + np.asarray(counts, dtype=np.float64)) * 16)


def _slot_counts(words: DataFrame) -> DataFrame:
    """slot (of all tables), zeros and ones, as whole numbers, so that their sums don't depend on partitions."""

    def of(batches):
        sums = np.zeros((TABLES, 2 << SLOT_BITS))
        for part, counts in _chunks(batches, "word", "n"):
            data, contexts, firsts = _events(part)
            asked = _asked(data, firsts)
            weight = np.repeat(_weights(counts), [len(w) + 1 for w in part])[asked]
            for bit, _, slots in _bits(data[asked], contexts[:, asked]):
                for k in range(TABLES):
                    sums[k] += np.bincount(slots[k] << 1 | bit, weights=weight, minlength=2 << SLOT_BITS)
        zeros, ones = sums.reshape(-1, 2).T
        used = np.flatnonzero(zeros + ones)
        for at in range(0, len(used), 100_000):
            own = used[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(zeros[own].astype(np.int64)), pa.array(ones[own].astype(np.int64))], names=["slot", "zeros", "ones"])

    found = words.mapInArrow(of, "slot int, zeros long, ones long")
    return found.groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def _mixing(words: DataFrame, shipped, buckets: int) -> DataFrame:
    """id, value and weight of each parameter, as learned online in each bucket of words, in the words' order, summed."""

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("word", ignore_index=True)
        model, tokens = _blank(*shipped.value), 0.0
        for start in range(0, len(group), 1 << 14):
            part, counts = (group[c].tolist()[start : start + (1 << 14)] for c in ("word", "n"))
            data, contexts, firsts = _events(part)
            asked = _asked(data, firsts)
            data, contexts = data[asked], contexts[:, asked]
            often = np.repeat(_weights(counts) / 16, [len(w) + 1 for w in part])[asked]
            tokens += len(part)
            for bit, node, slots in _bits(data, contexts):
                for at in range(0, len(data), 1 << 14):
                    own = slice(at, at + (1 << 14))
                    inputs, gates, mixed = model.mixed(slots[:, own])
                    error = (bit[own] - 1 / (1 + np.exp(-mixed))) * often[own]
                    shares = np.bincount(gates, weights=often[own], minlength=GATES) + 1e-9
                    for k in range(TABLES):
                        model.weights[:, k] += RATE * np.bincount(gates, weights=error * inputs[k], minlength=GATES) / shares
                    place = node[own] * BINS + np.rint((mixed + 12) / 24 * (BINS - 1)).astype(np.int64)
                    model.ones += np.bincount(place, weights=often[own] * bit[own], minlength=256 * BINS).reshape(256, BINS)
                    model.total += np.bincount(place, weights=often[own], minlength=256 * BINS).reshape(256, BINS)
        values = np.concatenate([model.weights.ravel() * tokens, model.ones.ravel(), model.total.ravel()])
        used = np.flatnonzero(values)
        return pd.DataFrame({"id": used.astype(np.int32), "value": values[used], "weight": tokens})

    dealt = words.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(of, "id int, value double, weight double").groupBy("id").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))


def learn(words: DataFrame) -> Model:
    """A model of the words (binary) that occur n > 0 times. Doesn't depend on how the words are partitioned.

    Parameters are rounded, as sums of floating-point numbers differ in their last digits by their order.
    """
    sc = words.sparkSession.sparkContext
    known = words.where("n > 0")
    counts = _slot_counts(known).toArrow()  # TABLES << SLOT_BITS rows at most
    zeros, ones = (np.zeros(TABLES << SLOT_BITS) for _ in range(2))
    slot = counts.column("slot").to_numpy()
    zeros[slot], ones[slot] = counts.column("zeros").to_numpy() / 16, counts.column("ones").to_numpy() / 16
    shape = (TABLES, 1 << SLOT_BITS)
    odds = np.log((ones + PRIOR) / (zeros + PRIOR)).astype(np.float32).reshape(shape)
    seen = np.digitize(zeros + ones, (0.5, 4, 32)).astype(np.uint8).reshape(shape)
    model = _blank(odds, seen)
    told = _mixing(known, sc.broadcast((odds, seen)), max(1, known.count() // BUCKET_WORDS)).toArrow()  # a fixed number of parameters
    value, weight = (np.zeros(GATES * TABLES + 2 * 256 * BINS) for _ in range(2))
    at = told.column("id").to_numpy()
    value[at], weight[at] = told.column("value").to_numpy(), told.column("weight").to_numpy()
    n = GATES * TABLES
    if len(at):
        model.weights = np.round(value[:n] / np.maximum(weight[:n], 1e-9), 4).reshape(GATES, TABLES)
        model.ones, model.total = np.round(value[n:], 1).reshape(2, 256, BINS)
    return model
