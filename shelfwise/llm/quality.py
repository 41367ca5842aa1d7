"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of kinds of characters and words, and its
neighbours' features stand beside its own; two more weights say how lines of a kind follow each
other. Forward and backward passes give the marginal probability that a line is good, and a
document's quality is their average, weighted by the lines' lengths.

Labels are for documents, so each line begins with its document's label; after a fit, lines take
the label that the field finds likelier, and it is fitted again.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, drawn_share

#: Labelled documents of each label that a model is fitted on, and lines of such a document.
SAMPLE = 1500
SAMPLE_LINES = 400
ROUNDS, STEPS, RATE, DECAY = 3, 120, 0.15, 1e-4
THRESHOLD = 0.7
_KINDS = ("upper", "lower", "digit", "space", "stop", "shout", "bar", "sign", "other", "wide", "newline")


def _kinds() -> np.ndarray:
    """The kind of each byte."""
    groups = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t\r\x0b\x0c", "stop": b".,;:'\"()-", "shout": b"!?", "bar": b"|", "sign": b"#$%&*+/<=>@[\\]^_`{}~", "wide": range(128, 256), "newline": b"\n"}
    kinds = np.full(256, _KINDS.index("other"), dtype=np.int64)
    for name, own in groups.items():
        kinds[list(own)] = _KINDS.index(name)
    return kinds


_KIND = _kinds()
FEATURES = 16


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each line's own features and its length in bytes, its end included. An empty text is one empty line."""
    data = np.frombuffer(text + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    lengths = np.diff(ends, prepend=-1)
    line = np.repeat(np.arange(len(ends)), lengths)
    counts = np.bincount(line * len(_KINDS) + _KIND[data], minlength=len(ends) * len(_KINDS)).reshape(len(ends), -1).astype(np.float64)
    n = dict(zip(_KINDS, counts.T))
    words, different, repeated, seen = np.zeros(len(ends)), np.zeros(len(ends)), np.zeros(len(ends)), np.zeros(len(ends))
    before: set[bytes] = set()
    for i, own in enumerate(text.split(b"\n")):
        parts = own.split()
        words[i], different[i] = len(parts), len(set(parts))
        repeated[i] = sum(map(eq, parts, parts[1:]))
        seen[i] = own in before and len(parts) > 2
        before.add(own)
    letters = np.maximum(n["upper"] + n["lower"] + n["wide"], 1)
    some, size = np.maximum(words, 1), np.maximum(lengths - 1, 1)
    own = (
        n["upper"] / letters, n["wide"] / letters, n["digit"] / size, np.minimum(n["shout"] / some, 2), np.minimum(n["bar"] / some, 2), np.minimum(n["sign"] / some, 4) / 2,
        np.minimum(n["stop"] / some, 2), n["other"] / size, (letters - 1) / size, 1 - different / some, repeated / some, seen,
        np.minimum(size / some, 20) / 10, np.minimum(words, 20) / 20, words == 0, np.ones(len(ends)),
    )
    return np.stack(own, axis=1).astype(np.float32), lengths.astype(np.float64)


def _with_neighbours(features: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and of the line after; none at a document's ends."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[firsts] = 0
    after[np.append(firsts[1:], len(features)) - 1] = 0
    return np.concatenate([features, before, after], axis=1)


@dataclass
class Field:
    """weights of the features for a good line; follow[a, b] for a line of kind b after one of kind a."""

    weights: np.ndarray
    follow: np.ndarray

    def marginals(self, features: np.ndarray, firsts: np.ndarray, pairs: bool = False):
        """The probability of good of each line, and with pairs of each kind of pair (line, next line)."""
        odds = (features @ self.weights).astype(np.float64)
        sizes = np.diff(np.append(firsts, len(odds)))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = firsts[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        f = self.follow

        def step(value: np.ndarray, table: np.ndarray) -> np.ndarray:
            return np.logaddexp(value + table[1, 1], table[0, 1]) - np.logaddexp(value + table[1, 0], table[0, 0])

        forward, backward = odds.copy(), np.zeros_like(odds)
        for t in range(1, len(active)):
            at = starts[: active[t]] + t
            forward[at] += step(forward[at - 1], f)
        for t in range(len(active) - 1, 0, -1):
            at = starts[: active[t]] + t
            backward[at - 1] = step(backward[at] + odds[at], f.T)
        good = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
        if not pairs:
            return good
        inner = np.ones(len(odds), dtype=bool)
        inner[firsts] = False
        at = np.flatnonzero(inner)
        a, b = forward[at - 1], backward[at] + odds[at]
        logs = np.stack([np.full(len(at), f[0, 0]), f[0, 1] + b, f[1, 0] + a, f[1, 1] + a + b])
        shares = np.exp(logs - logs.max(axis=0))
        return good, at, (shares / shares.sum(axis=0)).reshape(2, 2, -1)


def _fit(features: np.ndarray, firsts: np.ndarray, labels: np.ndarray) -> Field:
    """The field of the greatest likelihood of the lines' labels, by gradient steps with momentum."""
    field = Field(np.zeros(features.shape[1]), np.zeros((2, 2)))
    mean, spread = [0.0, 0.0], [0.0, 0.0]
    for i in range(1, STEPS + 1):
        good, at, pairs = field.marginals(features, firsts, pairs=True)
        told = np.stack([(1 - labels[at - 1]) * (1 - labels[at]), (1 - labels[at - 1]) * labels[at], labels[at - 1] * (1 - labels[at]), labels[at - 1] * labels[at]]).reshape(2, 2, -1)
        gradients = ((labels - good) @ features / len(features) - DECAY * field.weights, (told - pairs).sum(axis=2) / len(features) - DECAY * field.follow)
        for k, (value, gradient) in enumerate(zip((field.weights, field.follow), gradients)):
            mean[k] = 0.9 * mean[k] + 0.1 * gradient
            spread[k] = 0.99 * spread[k] + 0.01 * gradient**2
            value += RATE * (mean[k] / (1 - 0.9**i)) / (np.sqrt(spread[k] / (1 - 0.99**i)) + 1e-8)
    return field


def learn(docs: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Field | None:
    """A field fitted on a bounded sample: of each label, about sample rows where learn_from holds.

    learn_from is a condition on doc_id, the name of the id in this function. Rows are drawn whose
    hash of the id is in the lowest share that is likely to have sample rows; null labels and ids
    aren't used, of an id's labels the least counts, a null text counts as empty, and of the drawn
    documents those with over sample_lines lines are left out. Without labelled rows there is no
    model.
    """
    usable = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).where(learn_from & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    within = F.lit(False)
    for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect():
        within = within | ((F.col("label") == r["label"]) & drawn_share(F.xxhash64("doc_id"), sample / r["n"]))
    drawn = usable.where(within).select(F.col("doc_id").alias("_id"), "label")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    chosen = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))  # about 2 * sample ids

    def of(batches):
        for batch in batches:
            rows = [(label, line_features(text or b"")[0]) for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (text or b"").count(b"\n") < sample_lines]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1].tobytes() for x in rows], pa.binary())], names=["label", "lines"])

    rows = sorted((r["label"], bytes(r["lines"])) for r in chosen.select("label", "text").distinct().mapInArrow(of, "label int, lines binary").collect())
    if not rows:
        return None
    found = [np.frombuffer(x, dtype=np.float32).reshape(-1, FEATURES) for _, x in rows]
    sizes = np.array([len(x) for x in found])
    firsts = np.cumsum(sizes) - sizes
    features, of_doc = _with_neighbours(np.concatenate(found), firsts), np.repeat([x for x, _ in rows], sizes)
    line_labels = of_doc.astype(np.float64)
    for _ in range(ROUNDS):
        field = _fit(features, firsts, line_labels)
        found_good = field.marginals(features, firsts) >= 0.5
        all_good = np.repeat(np.minimum.reduceat(found_good, firsts), sizes)
        line_labels = np.where((of_doc == 0) & all_good, 0, found_good).astype(np.float64)
    return field


def score(docs: DataFrame, field: Field | None, text_col: str = "text", score_name: str = "score") -> DataFrame:
    """docs with one more column: the quality of each whole text, from 0 (bad) to 1 (good).

    A null or empty text is scored as one empty line. Without a field every text scores 1, as
    nothing is known against it. Other columns are passed on as they are.
    """

    def of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = np.ones(part.num_rows)
                if field is not None:
                    found = [line_features((x or "").encode()) for x in part.column(text_col).to_pylist()]
                    sizes = np.array([len(x) for x, _ in found])
                    firsts = np.cumsum(sizes) - sizes
                    good = field.marginals(_with_neighbours(np.concatenate([x for x, _ in found]), firsts), firsts)
                    lengths = np.concatenate([x for _, x in found])
                    values = np.clip(np.add.reduceat(good * lengths, firsts) / np.add.reduceat(lengths, firsts), 0, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], names=[*part.schema.names, score_name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(of, f"{schema}, {score_name} double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", divisor: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if the score is at least threshold).

    Learns from labels whose crc32(id as text) mod divisor is not held, and from no others.
    Repeated rows score alike; other columns aren't read; an empty table gives an empty result.
    """
    field = learn(docs, labels, crc_remainder(F.col("doc_id"), divisor) != held, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_remainder(F.col(id_col), divisor) == held).alias("held_out"), F.col(text_col).alias("text"))
    return score(rows, field).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_bad(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, with all their columns, whose quality is at least threshold."""
    field = learn(docs, labels, F.lit(True), id_col, text_col, label_col)
    return score(docs, field, text_col, "_quality_score").where(F.col("_quality_score") >= threshold).drop("_quality_score")
