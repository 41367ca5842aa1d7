"""BPE encoding and decoding.

Encoder: an Aho-Corasick automaton finds all tokens of the vocabulary in a word. From the word's
start the longest match is taken that is compatible with the token before it; where none is, the
encoder goes back one token and takes a shorter one. Two neighbouring tokens are compatible if the
merges leave the border between them alone. A sequence of compatible neighbours is what the merges
give, and a prefix of a word has just one such sequence, so a position that led nowhere is never
tried again, and the time is linear in the matches. The pair-compatibility table is filled as
pairs come up.

Decoder: all tokens stand in one buffer, and a table has their offsets; ids are decoded by
gathering from the buffer.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Words, and pairs of tokens, that a worker remembers; when full, it starts anew.
REMEMBERED = 300_000
_END = 0x1000  # added to the code of a word's last symbol
_NEVER = 1 << 40

# Bytes that stand for themselves in byte-level vocabularies; the others follow from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_symbols() -> list[str]:
    spare = iter(range(0x100, 0x200))
    own = set(_PRINTABLE)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


#: All code points up to here are in Python's tables.
_BEYOND = re.compile("[^\\x00-\\u0377]")


def has_unknown(text: str) -> bool:
    """Whether a text has code points that Python's tables don't know."""
    return bool(_BEYOND.search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))


class Vocabulary:
    """A BPE vocabulary with word ends, from a file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        suffix = model["end_of_word_suffix"]
        steps = [(s["type"], s.get("content")) for s in told["normalizer"]["normalizers"]]
        split, byte_level = told["pre_tokenizer"]["pretokenizers"]
        if steps != [("NFC", None), ("Replace", " "), ("Lowercase", None)] or split["behavior"] != "Removed" or byte_level["use_regex"] or not suffix:
            raise ValueError(f"{path}: another kind of vocabulary")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.ascii_pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
        #: For characters that are newer than Python's tables, the words are the library's own.
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special_start = os.path.commonprefix(list(self.special))
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.symbols = _byte_symbols()

        tokens = {i: t for t, i in (model["vocab"] | self.special).items()}
        parts = [tokens[i].encode() + b" " for i in range(len(tokens))]
        self.buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

        self.matches = ahocorasick.Automaton()
        for token, i in model["vocab"].items():
            own = token.removesuffix(suffix)
            own = own if own == token else own[:-1] + chr(ord(own[-1]) + _END)
            self.matches.add_word(own, len(own) << 32 | i)
        self.matches.make_automaton()
        self.merges, self.halves = {}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = (model["vocab"][t] for t in (left, right, left + right))
            self.merges[a, b] = rank
            self.halves.setdefault(whole, (a, b, rank))
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge while the token is built, each with the merge that ends it."""
        found, until = [(token, _NEVER)], _NEVER
        while token in self.halves:
            until = self.halves[token][2]
            token = self.halves[token][side]
            found.append((token, until))
        return found

    def _is_compatible(self, a: int, b: int) -> bool:
        """No merge crosses the border while both of its tokens are there; of equal merges the left one goes first."""
        left = self._edge(b, 0)
        for x, x_until in self._edge(a, 1):
            for y, y_until in left:
                rank = self.merges.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def encode_symbols(self, word: str) -> list[int]:
        """The ids of a word that is given as symbols, the last one marked as its end."""
        size = len(word)
        found: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for last, value in self.matches.iter(word):
            found[last + 1 - (value >> 32)].append((last + 1, value & 0xFFFFFFFF))
        table, path, dead = self.compatible, [], bytearray(size + 1)
        at, choice = 0, len(found[0])
        while at < size:
            choice -= 1
            if choice < 0:  # nothing fits here: back to the token that led here
                dead[at] = 1
                at, choice, _ = path.pop()
                continue
            end, token = found[at][choice]
            if dead[end]:
                continue
            if path:
                pair = (path[-1][2], token)
                fits = table.get(pair)
                if fits is None:
                    if len(table) >= REMEMBERED:
                        table.clear()
                    fits = table[pair] = self._is_compatible(*pair)
                if not fits:
                    continue
            path.append((at, choice, token))
            at, choice = end, len(found[end]) if end < size else 0
        return [token for _, _, token in path]

    def _symbols(self, symbols: list[str]) -> bytes:
        symbols[-1] = chr(ord(symbols[-1]) + _END)
        return np.array(self.encode_symbols("".join(symbols)), dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self._symbols([self.symbols[b] for b in word.encode()])
        if len(self.words) >= REMEMBERED:  # the first half came early, so it has most of the frequent words
            for late in list(itertools.islice(self.words, REMEMBERED // 2, None)):
                del self.words[late]
        if len(word) < 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        ids, known = [], self.words
        for part in self.special_pattern.split(text) if self.special and self.special_start in text else (text,):
            if part in self.special:
                ids.append(np.array([self.special[part]], dtype="<u4").tobytes())
                continue
            if not part.isascii() and has_unknown(part):
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                ids += [self._symbols(list(word)) for word, _ in cut]
                continue
            if part.isascii():
                words = self.ascii_pattern.findall(part.lower())
            else:
                # one letter at a time, without the rule for a sigma that ends a word
                words = self.pattern.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
            ids += [known.get(w) or self._word(w) for w in words]
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        """The tokens of packed ids, joined by spaces, in UTF-8."""
        numbers = np.frombuffer(ids, dtype="<u4")
        if not len(numbers):
            return b""
        starts = self.offsets[numbers]
        sizes = self.offsets[numbers + 1] - starts
        ends = np.cumsum(sizes)
        return self.buffer[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()[:-1]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """doc_id and ids of each row of docs; with round_trip also decoded, the decoder's text of the ids.

    ids are packed as little-endian unsigned 32-bit integers. A null text counts as empty and has
    no ids; special tokens' strings in a text are special tokens. Rows are independent: repeated
    ones give repeated rows, and other columns aren't read. path must be readable on the executors.
    """

    def of(batches):
        known = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [known.encode(x or "") for x in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if round_trip:
                    columns.append(pa.array([known.decode(x).decode() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary" + ", decoded string" * round_trip)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of packed ids; null ids give an empty text."""

    def of(batches):
        known = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known.decode(x or b"").decode() for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
