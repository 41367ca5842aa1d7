"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is a sequence of words and its end. A word is coded in two steps. Its ending (its last two
bytes) is coded by the bits of a Huffman code. Each bit has three predictors: counts of the code
alone, in the hashed context of the word before, and in that of the last two very frequent words,
which tell the language. Their log odds are mixed by weights that a gate selects (how much the two
contexts have been seen), and refined online within the text, by the errors that were made at the
same place of the code earlier in it. The word, given its ending, is coded in the same way if it is
one of the most frequent: by the bits of a Huffman code of its ending's frequent words and of one leaf
for all others, with predictors in the same contexts, gated weights, and errors made at the same place
earlier in the text, at every bit. Of those others a word has its discounted share of their count; what
the discounts leave is dealt out by the bit predictors for spellings (spelling.py), so that
probabilities add up to 1 at most.

On top of that stands a context of two whole words. Where the hash of two words says so, one word in
ANCHORS, a stretch begins, up to the next such place. A bit tells whether the stretch is one that other
learning texts have after the same two words; if so, it is coded by how many of them have it, else
word by word. The bit's odds are counted by how often the context was seen. This is what makes a
text cheap that occurs elsewhere, in whole or in part. A learning text's own stretches don't count
for it.

A text's score is the sum; its bits, by its bytes and its end, are bits per byte. All is learned
from all learning texts: word counts and stretches by shuffles that grow with the corpus, the
predictors' slots by sums of whole numbers, the mixing weights by a Newton step on all bits. Nothing
depends on how the rows are partitioned.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spelling
from .common import crc_remainder, discard, written

#: Slots of a hashed context's table at most (a power of 2), and seen levels of a slot.
SLOT_BITS, LEVELS = 18, (1, 16, 256)
PRIOR, START = 0.4, (0.3, 0.4, 0.4)
#: Depths of the code at which a text's own errors refine the odds, and how much is seen before they count half.
REFINED, STEADY = 2, 4.0
#: Very frequent words that stand for themselves as contexts, and those of them that tell the language.
CONTEXT_WORDS, TELLING_WORDS = 1024, 64
#: Words that the bits of a code tell within their endings, at most.
CODED_WORDS = 4096
#: Words that are looked up in the tasks, at most; rarer ones are joined.
FREQUENT = 500_000
#: Words between two places where a stretch begins, on average (a power of 2).
ANCHORS = 16
#: Bytes of text that are worked on at once. Longer texts are cut at white space, and contexts begin anew there.
SLICE, PIECE = 1 << 18, 1 << 22
END, OTHER = 1 << 16, (1 << 16) + 1  # the classes of a text's end and of unknown endings
_MIX = spelling._MIX
_END_KEY = np.uint64(1)
_SPACES = bytes(b == 32 or 9 <= b <= 13 for b in range(256))
_LOWER = bytes(range(256)).lower()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xD1342543DE82EF95)
    return x ^ x >> np.uint64(32)


@dataclass
class Tokens:
    """The words and ends of some texts, in order. text: each token's text; keys: hashes of words; endings: their classes."""

    text: np.ndarray
    keys: np.ndarray
    endings: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    is_word: np.ndarray


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each word's bytes, eight at a time. data goes on for 8 bytes after the last word."""
    eights = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
    out = _mixed((eights[starts] & masks[np.minimum(lengths, 8)]) * _MIX + lengths.astype(np.uint64) + np.uint64(seed << 32))
    more, at = np.flatnonzero(lengths > 8), 8
    while len(more):
        part = eights[starts[more] + at] & masks[np.minimum(lengths[more] - at, 8)]
        out[more] = _mixed(out[more] + _mixed(part * _MIX + np.uint64(at)))
        at += 8
        more = more[lengths[more] > at]
    return out


def tokens(texts: list[bytes], ended: np.ndarray, seed: int = 0) -> Tokens:
    """ended: which of the texts have an end; others are pieces that go on."""
    joined = (b" ".join(texts) + b" " * 9).translate(_LOWER)
    data, space = np.frombuffer(joined, dtype=np.uint8), np.frombuffer(joined.translate(_SPACES), dtype=bool)
    edges = np.flatnonzero(np.concatenate([[not space[0]], space[1:] != space[:-1]]))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    of_text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    twos = np.ndarray(len(data) - 1, dtype=">u2", buffer=data, strides=(1,))
    endings = twos[np.maximum(starts + lengths - 2, 0)].astype(np.int64)
    short = lengths == 1
    endings[short] = data[starts[short]].astype(np.int64) | 32 << 8
    n = len(starts) + int(ended.sum())
    at = np.arange(len(starts)) + (np.cumsum(ended) - ended)[of_text]
    out = Tokens(np.zeros(n, dtype=np.int64), np.full(n, _END_KEY), np.full(n, END), data, starts, lengths, np.zeros(n, dtype=bool))
    out.is_word[at] = True
    out.text[at], out.keys[at], out.endings[at] = of_text, _hashes(data, starts, lengths, seed) | np.uint64(2), endings  # no word has the end's key
    out.text[~out.is_word] = np.flatnonzero(ended)
    return out


def slices(batches, seed: int = 0):
    """Of Arrow batches with a last column text: a batch, the numbers of its rows in the slice, Tokens of their texts or pieces, and their bytes."""
    for batch in batches:
        rows: list[int] = []
        texts: list[bytes] = []
        ended: list[int] = []
        size = 0
        column = batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            text = column[i].as_py() or b""
            while True:
                cut = len(text)
                if cut > PIECE:
                    cut = max(text.rfind(b" ", 0, PIECE), text.rfind(b"\n", 0, PIECE)) + 1 or len(text)
                piece, text = text[:cut], text[cut:]
                rows.append(i)
                texts.append(piece)
                ended.append(int(not text))
                size += cut + 1
                if size >= SLICE:
                    yield batch, np.array(rows), tokens(texts, np.array(ended), seed), np.array([len(t) for t in texts])
                    rows, texts, ended, size = [], [], [], 0
                if not text:
                    break
        if rows:
            yield batch, np.array(rows), tokens(texts, np.array(ended), seed), np.array([len(t) for t in texts])


def _word_counts(rows: DataFrame, seed: int) -> DataFrame:
    """key, word, ending and n, the word's number in the rows that aren't held out; 0 for words of held-out rows only."""

    def of(batches):
        keys, counts, endings, words, size = [], [], [], [], 0

        def told():
            every, at, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate(counts))
            own = pa.concat_arrays(words).take(pa.array(at))
            return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), own, pa.array(np.concatenate(endings)[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "word", "ending", "n"])

        for batch, numbers, t, _ in slices(batches, seed):
            of_words = t.is_word
            learned = ~batch.column(0).to_numpy(zero_copy_only=False).astype(bool)[numbers]
            every, at, inverse = np.unique(t.keys[of_words], return_index=True, return_inverse=True)
            keys.append(every)
            counts.append(np.bincount(inverse, weights=learned[t.text[of_words]], minlength=len(every)))
            endings.append(t.endings[of_words][at])
            lengths = t.lengths[at]
            firsts = np.cumsum(lengths) - lengths
            body = t.data[np.arange(lengths.sum()) + np.repeat(t.starts[at] - firsts, lengths)]
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            words.append(pa.Array.from_buffers(pa.binary(), len(every), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())]))
            size += len(every)
            if size > 1_000_000:
                yield told()
                keys, counts, endings, words, size = [], [], [], [], 0
        if keys:
            yield told()

    found = rows.select("held_out", "text").mapInArrow(of, "key long, word binary, ending int, n long")
    return found.groupBy("key", "word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Code:
    """The Huffman code of endings. class_of: ending to class; nodes and bits: of all classes' paths, one after another; begins and lengths: of a class's path; zeros and ones: by node."""

    class_of: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray


def _tree(counts: list[int]) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """The Huffman code of leaves with these counts: each leaf's path of (node, bit), and each node's counts of zeros and ones."""
    heap: list = [(n, i, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    weights = list(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        children.append((x, y))
        weights.append(a + b)
        heapq.heappush(heap, (a + b, len(counts) + len(children), len(counts) + len(children) - 1))
    inner = len(children)
    paths: dict[int, list[tuple[int, int]]] = {len(counts) + inner - 1: []}
    for k in range(inner - 1, -1, -1):
        own = paths.pop(len(counts) + k)
        for bit, child in enumerate(children[k]):
            paths[child] = [*own, (k, bit)]
    return [paths[i] for i in range(len(counts))], [(weights[x], weights[y]) for x, y in children]


def _code(class_of: np.ndarray, paths: list[list[tuple[int, int]]], told: list[tuple[int, int]]) -> Code:
    lengths = np.array([len(path) for path in paths])
    nodes, bits = np.array([step for path in paths for step in path], dtype=np.int64).reshape(-1, 2).T
    zeros, ones = np.array(told, dtype=np.float64).reshape(-1, 2).T
    return Code(class_of, nodes, bits.astype(np.int8), np.cumsum(lengths) - lengths, lengths, zeros, ones)


def huffman(counts: dict[int, int]) -> Code:
    """counts: of each ending's class; those of END and OTHER are at least 1."""
    counts = counts | {c: max(counts.get(c, 0), 1) for c in (END, OTHER)}
    names = sorted(counts)
    class_of = np.full(OTHER + 1, names.index(OTHER), dtype=np.int32)
    class_of[names] = np.arange(len(names))
    return _code(class_of, *_tree([counts[c] for c in names]))


def code_of_words(endings: list[int], counts: list[int], counts_of_endings: dict[int, int]) -> Code:
    """A code for each ending: of the words given here, whose classes are their numbers, and of all its other words, whose class is class_of[ending].

    Endings without such words have a class with an empty path. A word with count 0 is left out.
    """
    of_ending: dict[int, list[int]] = {}
    for i, (ending, n) in enumerate(zip(endings, counts)):
        if n:
            of_ending.setdefault(ending, []).append(i)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(len(counts) + len(of_ending) + 1)]
    class_of, told = np.full(OTHER + 1, len(paths) - 1, dtype=np.int32), []
    for k, ending in enumerate(sorted(of_ending)):
        numbers = of_ending[ending]
        rest = counts_of_endings[ending] - sum(counts[i] for i in numbers)
        class_of[ending] = len(counts) + k
        own, sums = _tree([*(counts[i] for i in numbers), max(rest, 1)])
        for i, path in zip([*numbers, len(counts) + k], own):
            paths[i] = [(node + len(told), bit) for node, bit in path]
        told += sums
    return _code(class_of, paths, told)


class Lookup:
    """Numbers of words by their keys, in two tables of a fixed size; those that find no place there aren't held."""

    def __init__(self, keys: np.ndarray) -> None:
        """keys: the more frequent first."""
        self.bits = max(int(len(keys)).bit_length() + 1, 4)
        self.keys, self.held = keys, np.zeros(len(keys), dtype=bool)
        self.tables = []
        for shift in (0, 24):
            table = np.full(1 << self.bits, -1, dtype=np.int32)
            left = np.flatnonzero(~self.held)
            table[self._slot(keys[left][::-1], shift)] = left[::-1]
            self.held[table[table >= 0]] = True
            self.tables.append((shift, table))

    def _slot(self, keys: np.ndarray, shift: int) -> np.ndarray:
        return (keys << np.uint64(shift) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        found = np.full(len(keys), -1, dtype=np.int64)
        if len(self.keys):
            for shift, table in self.tables:
                own = table[self._slot(keys, shift)]
                hit = (own >= 0) & (self.keys[own] == keys)
                found[hit] = own[hit]
        return found


@dataclass
class Endings:
    """Predictors of endings' bits."""

    code: Code
    lookup: Lookup  # of very frequent words, of which the first tell the language
    slot_bits: int
    odds: np.ndarray  # of the code alone, by node
    hashed_odds: np.ndarray  # by context and slot
    seen: np.ndarray
    weights: np.ndarray  # by gate and predictor
    words: Words | None = None  # predictors of words, given their endings

    def classes(self, t: Tokens) -> np.ndarray:
        return self.code.class_of[t.endings]

    def contexts(self, t: Tokens) -> np.ndarray:
        """The hash of each token's contexts: the word before it, and the last two telling words."""
        n = len(t.keys)
        if not n:
            return np.zeros((2, 0), dtype=np.uint64)
        number = self.lookup(t.keys)
        frequent = number >= 0
        own = np.where(frequent, t.keys, t.endings.view(np.uint64))
        first = np.diff(t.text, prepend=-1) != 0
        before = np.concatenate([[np.uint64(0)], own[:-1]])
        before[first] = 0
        begin = np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), n)))
        tells = frequent & (number < TELLING_WORDS)
        telling, last = np.flatnonzero(tells), np.cumsum(tells) - tells - 1  # last: which of them is the last before a token
        told = []
        for k in range(2):
            at = telling[np.maximum(last - k, 0)] if len(telling) else np.zeros(n, dtype=np.int64)
            there = (last - k >= 0) & (at >= begin)
            told.append(np.where(there, t.keys[at], np.uint64(0)))
        return np.stack([before * np.uint64(3), _mixed(told[0]) + told[1] + np.uint64(5)])

    def events(self, t: Tokens, contexts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """The bits of the tokens' classes, in order: each bit's token, its node, the bit, and the slots of the two contexts."""
        classes, contexts = self.classes(t), self.contexts(t) if contexts is None else contexts
        lengths = self.code.lengths[classes]
        ends = np.cumsum(lengths)
        token = np.repeat(np.arange(len(classes)), lengths)
        at = np.arange(len(token)) + np.repeat(self.code.begins[classes] - ends + lengths, lengths)
        node = self.code.nodes[at]
        place = _mixed(np.arange(len(self.code.zeros), dtype=np.uint64) + np.uint64(1))[node]
        slots = [((np.repeat(_mixed(c), lengths) + place) * _MIX >> np.uint64(64 - self.slot_bits)).view(np.int64) for c in contexts]
        return token, node, self.code.bits[at], slots

    def inputs(self, node: np.ndarray, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The predictors' log odds, the gates, and the mixed log odds."""
        odds = [self.odds.take(node), self.hashed_odds[0].take(slots[0]), self.hashed_odds[1].take(slots[1])]
        gates = (self.seen[0].take(slots[0]) * np.uint8(4) + self.seen[1].take(slots[1])).astype(np.intp)
        weights = np.ascontiguousarray(self.weights.T)
        mixed = weights[0].take(gates) * odds[0]
        mixed += weights[1].take(gates) * odds[1]
        mixed += weights[2].take(gates) * odds[2]
        return odds, gates, np.clip(mixed, -12, 12, out=mixed)

    def log10(self, t: Tokens, contexts: np.ndarray | None = None) -> np.ndarray:
        """The log10 probability of each token's ending."""
        if not len(t.keys):
            return np.zeros(0)
        token, node, bit, slots = self.events(t, contexts)
        mixed = self.inputs(node, slots)[2]
        classes = self.code.class_of[t.endings]
        lengths = self.code.lengths[classes]
        begins = np.cumsum(lengths) - lengths
        for d in range(REFINED):
            at = begins[lengths > d] + d
            nodes = node[at]
            for one in np.unique(nodes):
                own = at[nodes == one]
                mixed[own] += self._refinement(t.text[token[own]], bit[own], mixed[own])
        mixed *= np.float32(1) - np.float32(2) * bit  # the log odds of what is wrong
        found = np.minimum(np.log(np.float32(1) + np.exp(mixed)), np.float32(6 * math.log(10)))
        logs = np.add.reduceat(found.astype(np.float64), begins) / -math.log(10)
        logs[classes == self.code.class_of[OTHER]] -= math.log10(1 << 16)
        return logs

    @staticmethod
    def _refinement(text: np.ndarray, bit: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """What the errors at a node earlier in the same text add to the log odds."""
        p = 1 / (1 + np.exp(-mixed))
        first = np.diff(text, prepend=-1) != 0
        begin = np.maximum.accumulate(np.where(first, np.arange(len(text)), 0))
        errors, spread = (np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)]) for x in (bit - p, p * (1 - p)))
        return ((errors[:-1] - errors[begin]) / (spread[:-1] - spread[begin] + STEADY)).astype(np.float32)


@dataclass
class Words(Endings):
    """Predictors of the bits that tell a word among those with its ending."""

    coded: Lookup | None = None  # of the words with classes of their own

    def classes(self, t: Tokens) -> np.ndarray:
        number = self.coded(t.keys)
        return np.where(number >= 0, number, self.code.class_of[t.endings])

    def log10(self, t: Tokens, contexts: np.ndarray | None = None) -> np.ndarray:
        """The log10 probability of each token's word, or of its being none of those with classes of their own, given its ending."""
        token, node, bit, slots = self.events(t, contexts)
        mixed = self.inputs(node, slots)[2]
        if not len(token):
            return np.zeros(len(t.keys))
        place = t.text[token] * len(self.code.zeros) + node  # of a text and a node
        bits = len(place).bit_length()
        in_order = np.sort(place << bits | np.arange(len(place)))
        order, place = in_order & ((1 << bits) - 1), in_order >> bits
        bit, mixed = bit.take(order), mixed.take(order)
        mixed += self._refinement(place, bit, mixed)
        mixed *= np.float32(1) - np.float32(2) * bit
        found = np.minimum(np.log(np.float32(1) + np.exp(mixed)), np.float32(6 * math.log(10)))
        return np.bincount(token.take(order), weights=found, minlength=len(t.keys)) / -math.log(10)


def _slopes(inputs: list[np.ndarray], gates: np.ndarray, error: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """For each of 16 gates the sums of error by input, and of spread by pair of inputs (3 + 9, of pairs those with i <= j)."""
    total = np.zeros((16, 12))
    order = np.argsort(gates.astype(np.uint8), kind="stable")
    counts = np.bincount(gates, minlength=16)
    used = np.flatnonzero(counts)
    if len(used):
        begins = (np.cumsum(counts) - counts)[used]
        error, spread, *inputs = (x.take(order).astype(np.float64) for x in (error, spread, *inputs))
        for k in range(3):
            total[used, k] = np.add.reduceat(error * inputs[k], begins)
            spread_inputs = spread * inputs[k]
            for m in range(k, 3):
                total[used, 3 + 3 * k + m] = np.add.reduceat(spread_inputs * inputs[m], begins)
    return total


def _learn_endings(learned: DataFrame, words: DataFrame, counts: dict[int, int], n_tokens: int, seed: int) -> Endings:
    """learned: the rows to learn from, with their text; counts: of endings' classes."""
    sc = learned.sparkSession.sparkContext
    often = words.where("n > 0").orderBy(F.desc("n"), "key").select("key", "ending", "n").limit(max(CONTEXT_WORDS, CODED_WORDS)).toArrow()
    keys = often.column("key").to_numpy().view(np.uint64)
    slot_bits = min(max(n_tokens.bit_length() - 4, 12), SLOT_BITS)
    shape = (2, 1 << slot_bits)
    coded = Lookup(keys[:CODED_WORDS])
    of_words = [n if held else 0 for n, held in zip(often.column("n").to_pylist(), coded.held.tolist())]
    codes = [huffman(counts), code_of_words(often.column("ending").to_pylist()[:CODED_WORDS], of_words, counts)]
    models: list[Endings] = []
    for kind, code in zip((Endings, Words), codes):
        odds = np.log((code.ones + PRIOR) / (code.zeros + PRIOR)).astype(np.float32)
        models.append(kind(code, Lookup(keys[:CONTEXT_WORDS]), slot_bits, odds, np.zeros(shape, dtype=np.float32), np.zeros(shape, dtype=np.uint8), np.tile(np.float32(START), (16, 1))))
    models[1].coded = coded
    shipped = sc.broadcast(models)

    def counted(batches):
        own, sums = shipped.value, np.zeros((4, 2 << slot_bits), dtype=np.int64)
        for _, _, t, _ in slices(batches, seed):
            contexts = own[0].contexts(t)
            for i, model in enumerate(own):
                _, _, bit, slots = model.events(t, contexts)
                for k in range(2):
                    sums[2 * i + k] += np.bincount(slots[k] << 1 | bit, minlength=2 << slot_bits)
        zeros, ones = sums.reshape(-1, 2).T
        used = np.flatnonzero(zeros + ones)
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(zeros[part].astype(np.int64)), pa.array(ones[part].astype(np.int64))], names=["slot", "zeros", "ones"])

    found = learned.select("text").mapInArrow(counted, "slot int, zeros long, ones long").groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()  # 4 << slot_bits rows at most
    sums = np.zeros((2, 4 << slot_bits))
    sums[:, found.column("slot").to_numpy()] = found.column("zeros").to_numpy(), found.column("ones").to_numpy()
    for model, (zeros, ones) in zip(models, sums.reshape(2, 2, -1).swapaxes(0, 1)):
        model.hashed_odds = np.log((ones + PRIOR) / (zeros + PRIOR)).astype(np.float32).reshape(shape)
        model.seen = np.digitize(zeros + ones, LEVELS).astype(np.uint8).reshape(shape)
    again = sc.broadcast(models)

    def sloped(batches):
        own, total = again.value, np.zeros((2, 16, 12))
        for _, _, t, _ in slices(batches, seed):
            contexts = own[0].contexts(t)
            for i, model in enumerate(own):
                _, node, bit, slots = model.events(t, contexts)
                inputs, gates, mixed = model.inputs(node, slots)
                p = 1 / (1 + np.exp(-mixed))
                total[i] += _slopes(inputs, gates, bit - p, p * (1 - p))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["id", "value"])

    told = learned.select("text").mapInArrow(sloped, "id int, value double").groupBy("id").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((2, 16, 12))
    total.ravel()[told.column("id").to_numpy()] = told.column("value").to_numpy()
    for model, own in zip(models, total):
        for gate in range(16):
            upper = np.triu(own[gate, 3:].reshape(3, 3))
            slope = upper + np.triu(upper, 1).T + 10 * np.eye(3)
            model.weights[gate] = np.round(np.clip(model.weights[gate] + np.linalg.solve(slope, own[gate, :3]), -0.5, 2), 4)
    models[0].words = models[1]
    return models[0]


def _blended(own: np.ndarray, left: np.ndarray, log10: np.ndarray) -> np.ndarray:
    """log10 of own + left * 10 ** log10, by logarithms, as a long word's probability is under what a double holds."""
    with np.errstate(divide="ignore"):  # a word that wasn't counted has no share of its own
        return np.logaddexp(np.log(own), np.log(left) + log10 * math.log(10)) / math.log(10)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorting order of rows by the columns, and where runs of equal rows begin in it."""
    order = np.lexsort(columns[::-1])
    differ = np.zeros(len(order), dtype=bool)
    differ[:1] = True
    for c in columns:
        differ[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(differ)


_ROWS = "kind int, row long, doc_id {}, held_out boolean, n_tokens long, n_known long, n_bytes long, key long, stretch long, times long, own long, base double, mixed double"


def _scored_rows(rows: DataFrame, endings, dictionary, base_of_end: float, base_log: float, end_known: int, seed: int) -> DataFrame:
    """Of each text (or piece) a row of kind 0 with its sums, of each of its rare words one of kind 1, of each of its stretches one of kind 2."""

    def of(batches):
        model, (lookup, counts, logs) = endings.value, dictionary.value
        counts, logs = np.append(counts, 0), np.append(logs, 0.0)
        bases = np.log10(counts + 1) - base_log
        for batch, numbers, t, sizes in slices(batches, seed):
            n, of_row = len(numbers), [batch.column(k).take(pa.array(numbers)) for k in range(3)]
            number = np.where(t.is_word, lookup(t.keys), -1)
            held = number >= 0
            contexts = model.contexts(t)
            mixed = model.log10(t, contexts) + model.words.log10(t, contexts) + np.where(held, logs[number], 0.0)
            base = np.where(held, bases[number], np.where(t.is_word, 0.0, base_of_end))
            known = np.where(held, counts[number] > 0, ~t.is_word & bool(end_known))
            sums = [np.bincount(t.text, weights=x, minlength=n) for x in (np.ones(len(t.text)), known, base, mixed)]
            columns = [[0, np.arange(n), sums[0], sums[1], sizes, None, None, None, None, sums[2], sums[3]]]
            rare = np.flatnonzero(t.is_word & ~held)
            order, begins = _runs(t.text[rare], t.keys[rare])
            at = rare[order][begins]
            columns.append([1, t.text[at], None, None, None, t.keys[at].view(np.int64), None, np.diff(np.append(begins, len(rare))), None, None, None])
            columns.append([2, *stretches(t, mixed)])
            kinds = [*[pa.int64()] * 7, pa.float64(), pa.float64()]
            for kind, text, *told in columns:
                if size := len(text):
                    common = [pa.array(np.full(size, kind, dtype=np.int32)), *(c.take(pa.array(text)) for c in of_row)]
                    yield pa.RecordBatch.from_arrays([*common, *(pa.nulls(size, k) if c is None else pa.array(c).cast(k) for c, k in zip(told, kinds))], names=[x.split()[0] for x in _ROWS.split(", ")])

    def stretches(t: Tokens, mixed: np.ndarray) -> list:
        n = len(t.keys)
        context = np.zeros(n, dtype=np.uint64)
        context[2:] = _mixed(t.keys[:-2] * np.uint64(3) + _mixed(t.keys[1:-1]))
        first = np.concatenate([[True], t.text[1:] != t.text[:-1]])
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        anchor = (np.arange(n) - begin >= 2) & (context >> np.uint64(65 - ANCHORS.bit_length()) == 0)
        bounds = np.flatnonzero(anchor | first)
        place = np.arange(n) - np.repeat(bounds, np.diff(np.append(bounds, n)))
        powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, _MIX, dtype=np.uint64))
        hashes, logs = np.add.reduceat(t.keys * powers[place], bounds), np.add.reduceat(mixed, bounds)
        own = anchor[bounds]
        at, hashes, logs = bounds[own], _mixed(hashes[own]), logs[own]
        order, begins = _runs(t.text[at], context[at], hashes)
        times = np.diff(np.append(begins, len(at)))
        logs = np.add.reduceat(logs[order], begins) if len(at) else logs
        at, hashes = at[order][begins], hashes[order][begins]
        _, outer = _runs(t.text[at], context[at])
        in_context = np.repeat(np.add.reduceat(times, outer), np.diff(np.append(outer, len(at)))) if len(at) else times
        return [t.text[at], None, None, None, context[at].view(np.int64), hashes.view(np.int64), times, in_context, None, logs]

    return rows.select("row", "doc_id", "held_out", "text").mapInArrow(of, _ROWS.format(rows.schema["doc_id"].dataType.simpleString()))


def _stretch_gains(stretches: DataFrame) -> DataFrame:
    """row and mixed: what is to be added to the scores, as stretches of other learning texts are found again.

    stretches: row, held_out, key (the context), stretch, times, own (times of the context in the row), mixed.
    """
    learned = stretches.where(~F.col("held_out"))
    seen = learned.groupBy("key", "stretch").agg(F.sum("times").alias("found"))
    contexts = seen.groupBy("key").agg(F.sum("found").alias("context"))
    own = F.when(F.col("held_out"), 0).otherwise(1)
    others = stretches.join(contexts, "key").withColumn("context", F.col("context") - own * F.col("own")).where("context > 0")
    others = others.join(seen, ["key", "stretch"], "left").withColumn("found", F.coalesce(F.col("found") - own * F.col("times"), F.lit(0)))
    level = F.least(F.floor(F.log2("context")), F.lit(8)).cast("int")
    others = written(others.select("row", "held_out", level.alias("level"), "times", "mixed", "context", "found"), "stretches")
    told = others.where(~F.col("held_out")).groupBy("level").agg(F.sum("times").alias("n"), F.sum(F.when(F.col("found") > 0, F.col("times")).otherwise(0)).alias("hits")).collect()  # at most 9 rows
    share = {r["level"]: (r["hits"] + PRIOR) / (r["n"] + 2 * PRIOR) for r in told}

    def by_level(f) -> Column:
        value = F.lit(f(0.5))
        for k, p in share.items():
            value = F.when(F.col("level") == k, f(p)).otherwise(value)
        return value

    hit = F.col("times") * (by_level(math.log10) + F.log10(F.col("found") / F.col("context"))) - F.col("mixed")
    gain = F.when(F.col("found") > 0, hit).otherwise(F.col("times") * by_level(lambda p: math.log10(1 - p)))
    return others.groupBy("row").agg(F.sum(gain).alias("mixed"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 7, held: int = 2) -> DataFrame:
    """Scores of every whole text: one row per row of docs.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.
    Learns from the rows whose crc32(id as text) mod divisor is not held. A text's tokens are its
    words, A-Z lower-cased, split at ASCII white space, and one end; null counts as empty, so it
    has the end alone. base_score is log10 by word counts with one added; score is log10 by the
    mixed bit predictors. bits_per_byte divides by the text's bytes and its end, as the end is
    scored too. Rows that repeat are scored each, and are each other's copies. Other columns aren't
    read. If no row is left to learn from, all counts are 0. An empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), (crc_remainder(F.col(id_col), divisor) == held).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    for seed in range(8):
        words = written(_word_counts(rows, seed), "words")
        if words.groupBy("key").count().where("count > 1").isEmpty():
            break  # no two words share a key
        discard(words)
    else:
        raise RuntimeError("words share keys with every seed")
    learned = rows.where(~F.col("held_out"))
    ends = learned.count()
    by_ending = {r["ending"]: (r["n"], r["kinds"]) for r in words.where("n > 0").groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}  # at most 2 ** 16 rows
    n_words, kinds = sum(n for n, _ in by_ending.values()), sum(k for _, k in by_ending.values()) + (ends > 0)
    n_tokens = n_words + ends
    base_log = math.log10(max(n_tokens + kinds + 1, 1))
    sizes = sorted({1 << i for i in range(40)} | {3 << i for i in range(38)})
    told = words.agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), *(F.count_if(F.col("n") >= s).alias(f"c{i}") for i, s in enumerate(sizes))).first()
    discount = min(max(told["once"] / max(told["once"] + 2 * told["twice"], 1), 0.1), 0.9)
    least = next((s for i, s in enumerate(sizes) if told[f"c{i}"] <= FREQUENT), sizes[-1])

    model = _learn_endings(learned, words, {e: n for e, (n, _) in by_ending.items()} | {END: ends}, n_tokens, seed)
    endings, coded = sc.broadcast(model), sc.broadcast(model.words.coded)
    speller = sc.broadcast(spelling.learn(words))
    of_ending, kinds_of_ending = (np.zeros(1 << 16) for _ in range(2))
    for e, (n, k) in by_ending.items():
        of_ending[e], kinds_of_ending[e] = n, k
    of_coded = words.join(F.broadcast(docs.sparkSession.createDataFrame(pa.table({"key": model.words.coded.keys[model.words.coded.held].view(np.int64)}))), "key").groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()  # at most CODED_WORDS rows
    for r in of_coded:  # the bits of a code tell these words
        of_ending[r["ending"]] -= r["n"]
        kinds_of_ending[r["ending"]] -= r["kinds"]

    def spelled(batches):
        for key, word, ending, n in spelling._chunks(batches, "key", "word", "ending", "n", sized="word"):
            total, different = of_ending[ending], kinds_of_ending[ending]
            own = np.maximum(np.array(n) - discount, 0) / np.maximum(total, 1)
            left = np.where(total > 0, discount * different / np.maximum(total, 1), 1.0)
            logs = _blended(own, left, speller.value.log10(word))
            logs[coded.value(np.array(key, dtype=np.int64).view(np.uint64)) >= 0] = 0
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(logs)], names=["key", "n", "log10"])

    of_words = written(words.mapInArrow(spelled, "key long, n long, log10 double"), "word_scores")
    discard(words)
    often = of_words.where(F.col("n") >= least).orderBy(F.desc("n"), "key").toArrow()  # at most FREQUENT rows
    lookup = Lookup(often.column("key").to_numpy().view(np.uint64))
    dictionary = sc.broadcast((lookup, often.column("n").to_numpy(), often.column("log10").to_numpy()))
    found = written(_scored_rows(rows, endings, dictionary, math.log10(ends + 1) - base_log, base_log, int(ends > 0), seed), "scored")

    n = F.coalesce("n", F.lit(0))
    rare = found.where("kind = 1").select("row", "key", "times").join(of_words, "key", "left")
    rare = rare.groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * (F.log10(n + 1) - F.lit(base_log))).alias("base"), F.sum(F.col("times") * F.col("log10")).alias("mixed"))
    gains = _stretch_gains(found.where("kind = 2").select("row", "held_out", "key", "stretch", "times", "own", "mixed"))
    sums = [found.where("kind = 0").select("row", "n_tokens", "n_known", "n_bytes", "base", "mixed")]
    sums.append(rare.select("row", F.lit(0).alias("n_tokens"), "n_known", F.lit(0).alias("n_bytes"), "base", "mixed"))
    sums.append(gains.select("row", *(F.lit(0).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "base")), "mixed"))
    total = sums[0].unionByName(sums[1]).unionByName(sums[2]).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "base", "mixed")))
    bits = -F.col("mixed") / F.lit(math.log10(2)) / (F.col("n_bytes") + 1)
    scored = found.where("kind = 0").select("row", "doc_id", "held_out").dropDuplicates(["row"]).join(total, "row")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("mixed").alias("score"), "n_bytes", bits.alias("bits_per_byte"))
