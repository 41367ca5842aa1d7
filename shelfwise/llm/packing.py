"""Best-fit packing of documents into sequences, with certified bin counts.

Pieces are dealt to partitions of a bounded number of rows. Each partition packs its pieces by
best-fit decreasing and computes lower bounds on the number of bins by dual feasible functions. A
partition whose count equals its bound is certified: no packing of its pieces has fewer bins.
Partitions with a gap exchange documents: the pieces of their bins that have room left are dealt
anew, to larger partitions, and packed again, and the new packing is taken if it has fewer bins.
This is repeated until all is certified or the rounds are used up.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import _byte_symbols
from .common import discard, written

CAPACITY = 1024
#: Pieces of a partition, on average; how many times as many one has in each further round, and at most.
PART_ROWS, GROWTH, MOST_ROWS = 50_000, 4, 400_000
ROUNDS = 4

# How byte-level vocabularies of this kind split texts.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Ids:
    """Ids of a vocabulary file of the tokenizers library, by a faster library if the file is of a kind for which that gives the same ids.

    That is so if it is a plain byte-level vocabulary whose merges stand in the order of their results' ids, and
    no token but single bytes is without a merge.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.slow, self.fast = Tokenizer.from_file(path), None
        self.slow.no_padding()
        self.slow.no_truncation()
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        model, cut = told["model"], told.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        made = [model["vocab"].get(m.replace(" ", "", 1), -1) for m in merges]
        plain = not told.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and all(not t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if plain and made == sorted(made) and {i for t, i in model["vocab"].items() if len(t) > 1 and t not in special} <= set(made):
            of_symbol = {s: b for b, s in enumerate(_byte_symbols())}
            ranks = {bytes(of_symbol[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its regular expressions give up on very long runs of white space
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, packed as 32-bit integers) of each piece.

    A document is its text's ids and end_id; only a longer one than capacity is cut, into pieces
    of capacity ids, of which the first is shorter unless the length divides evenly. A null text
    counts as empty and has the end alone. Rows that repeat an id are cut each for itself.
    """

    def of(batches):
        encode = _ids(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns: list[list] = [[], [], [], [], [], []]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packed = np.append(encode(text or ""), end_id).astype("<u4").tobytes()
                    size = len(packed) // 4
                    bounds = [0, *range(size % capacity or capacity, size + 1, capacity)]
                    for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        own = packed[4 * a : 4 * b]
                        for column, value in zip(columns, (doc_id, n, a, b - a, zlib.crc32(own), own)):
                            column.append(value)
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][: 5 + with_ids], names=names[: 5 + with_ids])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of bins that two families of dual feasible functions give."""
    counts = np.bincount(sizes, minlength=capacity + 1).astype(object)  # exact, however many
    size = np.arange(capacity + 1)
    best = 0
    total, weight = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * size)
    for least in range(1, capacity // 2 + 1):  # sizes over capacity - least count as whole bins, those under least as nothing
        whole = total[capacity - least + 1] if least > 0 else 0
        middle = weight[capacity - least] - weight[least - 1]
        best = max(best, whole - (-middle // capacity))
    best = max(best, -(-weight[capacity] // capacity))
    for k in range(1, 21):  # multiples of capacity / (k + 1) keep their size, others are rounded to k-ths
        steps = (k + 1) * size
        value = np.where(steps % capacity == 0, size * k, steps // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return int(best)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the offset of each piece, and the number of bins."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0  # bit r is set if some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, bin_, n = capacity, n, n + 1
        bins[i], offsets[i] = bin_, capacity - room
        if room > size:
            rooms[room - size].append(bin_)
            open_rooms |= 1 << (room - size)
    return bins, offsets, n


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of pieces with sequence_id, offset and certified: the sequence of each piece and its place there.

    pieces has a column length, from 1 to capacity, and any others (but row, part, fill, bins and
    bound). Offsets in a sequence run on without gaps from 0. Sequence ids are unique, not gapless.
    certified tells whether no packing of the pieces that were packed with this one has fewer bins,
    by their partition's bound; full sequences that left a partition before that are certified too,
    as no packing of their pieces is shorter. Null lengths aren't allowed; rows that repeat are
    packed each. Empty tables give empty results.
    """
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in pieces.columns if c != "row"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, fill long, bins long, bound long"

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop(columns="part").sort_values("row", ignore_index=True)
        sizes = group["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(sizes, capacity)
        firsts = np.zeros(n, dtype=np.int64)
        firsts[bins[offsets == 0]] = group["row"].to_numpy()[offsets == 0]
        fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
        return group.assign(sequence_id=firsts[bins], offset=offsets, fill=fill[bins], bins=n, bound=lower_bound(sizes, capacity))

    def packing(rows: DataFrame, n: int, seed: int) -> DataFrame:
        parts = -(-n // min(part_rows * GROWTH**seed, max(part_rows, MOST_ROWS)))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(max(parts, 1))).cast("int"))
        return written(dealt.groupBy("part").applyInPandas(packed, schema), "packed")

    full = pieces.where(F.col("length") == capacity).select(*columns, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest = pieces.where(F.col("length") < capacity)
    current, settled = packing(rest, rest.count(), 0), [full]
    result_columns = [*columns, "sequence_id", "offset", ((F.col("bins") == F.col("bound")) | (F.col("fill") == capacity)).alias("certified")]
    for seed in range(1, rounds + 1):
        gap = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
        open_rows = current.where(gap)
        n, before = open_rows.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if before < 2:
            break
        again = packing(open_rows.select(*pieces.columns), n, seed)
        if again.where("offset = 0").count() >= before:
            discard(again)
            continue
        settled.append(current.where(~gap).select(*result_columns))
        current = again
    return functools.reduce(DataFrame.unionByName, [*settled, current.select(*result_columns)])
