"""Ranked lexical search by Block-Max MaxScore.

The documents are indexed in segments: some thousand documents each, of bounded size, indexed where
they are read, without a shuffle. A segment has one row for each of its terms: the postings
(document number within the segment and count), compressed in blocks, and of each block the last
number, the largest count and the least document length. Another row holds its documents' ids and lengths.

A search takes the rows of the queries' terms and evaluates all queries segment by segment. A
query's lists are ordered by their bounds, the most that any posting of them can add. Essential are the
lists from the largest bound down to where all the rest together can't reach the k-th best
score so far; they bring in the candidates. In the lists that aren't essential, a candidate is looked
up only while its score, the bound of the block that it would be in and the bounds of the lists
after that reach the k-th best score; blocks without such candidates are never decompressed. The
segments' best are merged by score, with a map-side limit for each query.

Queries are taken in blocks of bounded size, each against all segments. What is broadcast is one
such block with the weights of its terms.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What isn't an ASCII letter, digit or a byte of another character parts terms.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: A segment ends with the document that brings it to so many, or to so many bytes of text.
SEGMENT_DOCS = 1 << 15
SEGMENT_BYTES = 32 << 20
#: Postings of a compressed block.
BLOCK = 128
#: Bytes of queries' texts that are searched for together.
QUERY_BYTES = 8 << 20


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8; only A-Z are lower-cased."""
    return TERM.findall((text or b"").lower())


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers, seven bits a byte, and where each one starts."""
    width = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 63, 7):
        width += values >= 1 << bits
    starts = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), dtype=np.uint8)
    for i in range(int(width.max(initial=0))):
        has = width > i
        out[starts[has] + i] = (values[has] >> (7 * i) & 127) | ((width[has] > i + 1) << 7)
    return out, starts


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


class Segment:
    """Collects documents and gives their part of the index."""

    def __init__(self):
        self.vocabulary: defaultdict = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids, self.lengths, self.keys, self.bytes = [], [], [], 0

    def add(self, doc_id: pa.Scalar, text: bytes | None) -> None:
        found = terms(text)
        if not found:
            return
        numbers = np.fromiter(map(self.vocabulary.__getitem__, found), dtype=np.int64, count=len(found))
        self.keys.append(numbers << 32 | len(self.ids))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.bytes >= SEGMENT_BYTES

    def rows(self, number: int, schema: pa.Schema):
        """The batches of the segment's rows."""
        keys, tf = np.unique(np.concatenate(self.keys), return_counts=True)
        self.keys = []
        term, doc = keys >> 32, keys & 0xFFFFFFFF
        first = np.concatenate(([0], np.flatnonzero(np.diff(term)) + 1))  # of each term, in the order of their numbers
        df = np.diff(np.append(first, len(term)))
        place = np.arange(len(term)) - np.repeat(first, df)
        starts = np.flatnonzero(place % BLOCK == 0)
        ends = np.append(starts[1:], len(term))
        before = np.concatenate(([0], doc[:-1]))
        before[starts] = 0
        data, at = pack_numbers(np.stack([doc - before, tf], axis=1).ravel())
        byte_starts = at[2 * starts]
        per_term = np.concatenate(([0], np.cumsum((df + BLOCK - 1) // BLOCK)))  # where each term's blocks start
        data_starts = np.append(byte_starts, len(data))[per_term]
        lengths = np.array(self.lengths, dtype=np.int64)

        def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(per_term, pa.int32()), pa.array(values, kind))

        payload = pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(data_starts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        columns = {
            "segment": pa.array(np.full(len(df), number)), "term": pa.array(list(self.vocabulary), pa.binary()).cast(pa.string()), "df": pa.array(df),
            "last": lists(doc[ends - 1], pa.int32()), "most": lists(np.maximum.reduceat(tf, starts), pa.int32()), "least": lists(np.minimum.reduceat(lengths[doc], starts), pa.int64()),
            "starts": lists(byte_starts - np.repeat(data_starts[:-1], np.diff(per_term)), pa.int32()), "data": payload,
        }
        nothing = {f.name: pa.nulls(len(df), f.type) for f in schema}
        batch = pa.RecordBatch.from_arrays([(nothing | columns)[f.name] for f in schema], schema=schema)
        for start in range(0, batch.num_rows, 4096):
            yield batch.slice(start, 4096)
        told = {"segment": [number], "ids": pa.array([self.ids], schema.field("ids").type), "lengths": [lengths.tolist()], "n_docs": [len(lengths)], "n_terms": [int(lengths.sum())]}
        yield pa.RecordBatch.from_arrays([pa.array(told[f.name], f.type) if f.name in told else pa.nulls(1, f.type) for f in schema], schema=schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows of docs, as a table in the shared folder.

    Rows of a term: segment, term, df, and of each block last (document number), most (occurrences), least
    (document length), starts (in data); data. One row of each segment without a term: ids,
    lengths, n_docs, n_terms. Documents without a term, null texts too, are in no list and don't
    count as documents. Rows that repeat an id are documents of their own. Whole texts are
    indexed. Other columns aren't read. An empty table gives an empty index.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = [("last", pa.int32()), ("most", pa.int32()), ("least", pa.int64()), ("starts", pa.int32())]

    def of(batches):
        segment, number, schema = Segment(), TaskContext.get().partitionId() << 32, None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("df", pa.int64()), *((n, pa.list_(t)) for n, t in blocks), ("data", pa.binary()), ("ids", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1)):
                segment.add(doc_id, text.as_py())
                if segment.full():
                    yield from segment.rows(number, schema)
                    segment, number = Segment(), number + 1
        if segment.ids:
            yield from segment.rows(number, schema)

    return written(rows.mapInArrow(of, f"segment long, term string, df long, last array<int>, most array<int>, least array<long>, starts array<int>, data binary, ids array<{kind}>, lengths array<long>, n_docs long, n_terms long"), "index")


class Postings:
    """A term's postings in a segment, decompressed block by block when they are asked for."""

    def __init__(self, weight: int, row: dict, m_of):
        self.weight, self.last, self.m_of = weight, row["last"], m_of
        self.starts, self.data = row["starts"], np.frombuffer(row["data"], dtype=np.uint8)
        self.ends = np.append(self.starts[1:], len(self.data))
        self.bounds = weight * parts(row["most"].astype(np.int64), m_of(row["least"]))
        self.bound = int(self.bounds.max())
        self.blocks: list = [None] * len(self.last)

    def block(self, i: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers of a block, and what each adds to a score."""
        if self.blocks[i] is None:
            numbers = unpack_numbers(self.data[self.starts[i] : self.ends[i]])
            doc = np.cumsum(numbers[::2])
            self.blocks[i] = (doc, self.weight * parts(numbers[1::2], m[doc]))
        return self.blocks[i]


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What occurrences add, before the weight; rises with tf and falls with m, so bounds are got from the largest and the least."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def best(lists: list[tuple[Postings, int]], m: np.ndarray, k: int) -> np.ndarray:
    """Scores of a segment's documents, right for all that reach the k-th best score, and 0 for those that don't. lists: with repetitions in the query."""
    lists = sorted(lists, key=lambda x: -x[0].bound * x[1])
    after = np.append(np.cumsum([p.bound * n for p, n in lists[::-1]])[::-1], 0)  # what this list and all after it can add
    score = np.zeros(len(m), dtype=np.int64)

    def reached() -> int:
        """The k-th best score so far; 0 if there aren't k."""
        return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else 0

    least, alive = 0, None
    for i, (postings, n) in enumerate(lists):
        if alive is None and least > after[i]:
            alive = np.flatnonzero(score + after[i] >= least)  # from here on, no list is essential
        if alive is None:
            for j in range(len(postings.last)):
                doc, adds = postings.block(j, m)
                score[doc] += n * adds
        else:
            at = np.searchsorted(postings.last, alive)
            within = at < len(postings.last)
            bound = np.zeros(len(alive), dtype=np.int64)
            bound[within] = n * postings.bounds[at[within]]
            possible = score[alive] + bound + after[i + 1] >= least
            alive, at, within = alive[possible], at[possible], within[possible]
            for j in np.unique(at[within]):
                doc, adds = postings.block(j, m)
                asked = alive[at == j]
                found = np.searchsorted(doc, asked)
                has = doc[np.minimum(found, len(doc) - 1)] == asked
                score[asked[has]] += n * adds[found[has]]
        if i + 1 < len(lists):
            least = max(least, reached())
    if alive is not None:
        kept = np.zeros_like(score)
        kept[alive] = score[alive]
        return kept
    return score


def top_of_segment(table: pa.Table, queries: list[tuple[str, dict[str, int]]], weights: dict[str, int], n_docs: int, n_terms: int, k: int) -> list[tuple[str, int, int]]:
    """(query, place of the document in the segment's ids, score) of each query's k best; equal scores in order of ids, null last."""
    own = pc.is_null(table["term"])
    held = table.filter(own)
    ids = held["ids"].combine_chunks().flatten()
    rank = np.empty(len(ids), dtype=np.int64)
    rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))

    def m_of(length: np.ndarray) -> np.ndarray:
        return 75 + 25 * length * n_docs // n_terms

    m = m_of(held["lengths"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
    rest = table.filter(pc.invert(own))
    lists = {}
    for batch in rest.to_batches():
        arrays = [batch.column(c) for c in ("last", "most", "least", "starts")]
        for i, term in enumerate(batch.column("term").to_pylist()):
            row = {name: a[i].values.to_numpy(zero_copy_only=False) for name, a in zip(("last", "most", "least", "starts"), arrays)}
            lists[term] = Postings(weights[term], row | {"data": batch.column("data")[i].as_py()}, m_of)
    found = []
    for query, asked in queries:
        chosen = [(lists[t], n) for t, n in asked.items() if t in lists and lists[t].bound > 0]
        if chosen:
            score = best(chosen, m, k)
            doc = np.flatnonzero(score)
            if len(doc) > k:
                doc = doc[score[doc] >= np.partition(score[doc], len(doc) - k)[len(doc) - k]]
            order = np.lexsort((rank[doc], -score[doc]))[:k]
            found += [(query, int(d), int(score[d])) for d in doc[order]]
    return found


def _evaluated(shared, n_docs: int, n_terms: int, k: int):
    """The function from a segment's rows to the best documents of each query."""

    def of(table):
        top = top_of_segment(table, *shared.value, n_docs, n_terms, k)
        ids = table.filter(pc.is_null(table["term"]))["ids"].combine_chunks().flatten()
        return pa.table({"query": pa.array([q for q, _, _ in top], pa.string()), "doc_id": ids.take(pa.array([d for _, d, _ in top], pa.int64())), "score": pa.array([s for _, _, s in top], pa.int64())})

    return of


def search_index(index: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of every row of items.

    A text without a term, or null, finds nothing. Rows of items with equal texts are searched for
    once; rows that repeat an id get their documents each. Equal scores are in order of doc_id, null
    last. An empty index or table of items gives an empty result.
    """
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    found_schema = f"query string, doc_id {kind}, score long"
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("query"))
    totals = index.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    texts = asked.where("text <> ''").groupBy("query").agg(F.first("text").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // query_bytes) if n_terms else 0
    results = spark.createDataFrame([], found_schema)
    for block in range(blocks):
        chosen = texts.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow()
        queries = [(q, {t.decode(): n for t, n in Counter(terms(x.encode())).items()}) for q, x in zip(chosen["query"].to_pylist(), chosen["text"].to_pylist())]
        known = sorted({t for _, own in queries for t in own})
        if not known:
            continue
        named = F.broadcast(spark.createDataFrame(pa.table({"term": known})))  # of a block of bounded size
        df = index.select("term", "df").join(named, "term").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        weights = {t: floor(1000 * log((2 * n_docs + 2) / (2 * n + 1))) for t, n in zip(df["term"].to_pylist(), df["df"].to_pylist())}
        evaluated = _evaluated(spark.sparkContext.broadcast((queries, weights)), n_docs, n_terms, k)
        columns = ["segment", "term", "last", "most", "least", "starts", "data", "ids", "lengths"]
        rows = index.where("term is null").select(*columns).unionByName(index.join(named, "term").select(*columns))
        results = results.unionByName(rows.groupBy("segment").applyInArrow(evaluated, found_schema))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    merged = results.withColumn("rank", place).where(F.col("rank") <= k)  # limited to k of a query before they are shuffled, too
    return asked.select("item_id", "query").join(merged, "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """search_index() over an index of docs."""
    return search_index(build_index(docs), items, k)
