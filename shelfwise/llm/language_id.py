"""Language identification with blended-spectrum string kernels.

Two texts' kernel is the number of n-grams (1 to 4 bytes of the lower-cased letters, hashed) that
are present in both, divided by the root of the product of their own numbers. Landmarks are a
sample of learning texts. By Nyström's method a text's features are its kernels with the
landmarks times the inverse root of the landmarks' own kernel matrix; a kernel ridge regression
for each language against the rest gives the scores. Texts are scored in batches, by products of
their presence matrix with the landmarks' and of the kernels with the weights. A long text has most
n-grams, so presence tells little about it: it is scored in pieces of PIECE bytes, and its scores
are their averages, weighted by their lengths. Learning takes one piece of each sampled text.

A text that is like no landmark has scores near 0, halfway, so they don't tell that its language
is none of those learned. What tells it is the share of its n-grams that any landmark of its
language has. How low that is for texts of the language is seen on learning texts that are no
landmarks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, drawn_share

NONE = "und"
#: Numbers of n-gram hashes, and of learning texts and of landmarks for each language.
WIDTH = 1 << 14
SAMPLE = 400
LANDMARKS = 32
#: Learning texts and landmarks in all; with many languages each has a smaller share of them, but one at least.
MOST_SAMPLED, MOST_LANDMARKS = 25_600, 2048
#: Bytes of a piece of a text, and pieces whose presence is held at once.
PIECE, AT_ONCE = 4096, 128
RIDGE = 1e-2
#: A text is foreign if the share of its n-grams that its language's landmarks lack is over ROOM times what all but RARE of the language's texts have.
ROOM, RARE = 2, 0.01
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_FACTOR = np.uint32(2654435769)  # the golden ratio's share of 32 bits, a usual factor for hashing


def letters(text: str) -> np.ndarray | None:
    """The bytes of a text's words in lower case, one space around each; null if it has no letter."""
    if not any(m[0].isalpha() for m in _LETTER.finditer(text)):  # the pattern also has numerals that are no digits
        return None
    return np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode(), dtype=np.uint8)


def present(bytes_: np.ndarray) -> np.ndarray:
    """Which hashes of n-grams a piece of a text has."""
    bytes_ = bytes_.astype(np.uint32)
    flags = np.zeros(WIDTH, dtype=bool)
    codes = np.zeros(len(bytes_) + 1, dtype=np.uint32)
    for n in range(1, 5):
        if len(bytes_) < n:
            break
        codes = codes[:-1] * np.uint32(256) + bytes_[n - 1 :]
        flags[((codes + np.uint32(n)) * _FACTOR) >> np.uint32(32 - WIDTH.bit_length() + 1)] = True
    return flags


def pieces(bytes_: np.ndarray) -> list[np.ndarray]:
    """A text's letters in pieces of about PIECE bytes, all of about one length."""
    return np.array_split(bytes_, max(1, round(len(bytes_) / PIECE)))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence, a column for each
    root: np.ndarray
    weights: np.ndarray
    grams: np.ndarray  # by language, the n-grams that its landmarks have
    least: np.ndarray  # by language, the least share of a text's n-grams among those

    def features(self, flags: np.ndarray) -> np.ndarray:
        rows = flags.astype(np.float32)
        size = np.sqrt(np.maximum(rows.sum(axis=1), 1))
        kernels = rows @ self.landmarks / size[:, None] / np.sqrt(np.maximum(self.landmarks.sum(axis=0), 1))
        return kernels @ self.root

    def scores(self, flags: np.ndarray) -> np.ndarray:
        return self.features(flags) @ self.weights

    def whole(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of whole texts' letters: the scores, the best language (by number), and the share of n-grams that its landmarks have."""
        cut = [(i, piece) for i, text in enumerate(texts) for piece in pieces(text)]
        of, sizes = np.array([i for i, _ in cut]), np.array([len(p) for _, p in cut], dtype=np.float64)
        total = np.bincount(of, weights=sizes)
        firsts = np.searchsorted(of, np.arange(len(texts)))
        blocks = [np.stack([np.packbits(present(p)) for _, p in cut[at : at + AT_ONCE]]) for at in range(0, len(cut), AT_ONCE)]
        scores = np.concatenate([self.scores(np.unpackbits(b, axis=1)) for b in blocks])
        scores = np.add.reduceat(scores * sizes[:, None], firsts) / total[:, None]
        bests = scores.argmax(axis=1)
        shares = np.concatenate([self.familiar(np.unpackbits(b, axis=1), bests[of[k * AT_ONCE : (k + 1) * AT_ONCE]]) for k, b in enumerate(blocks)])
        return scores, bests, np.add.reduceat(shares * sizes, firsts) / total

    def familiar(self, flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The share of each text's n-grams that the landmarks of its language (of, by number) have."""
        return (flags.astype(bool) & self.grams[of]).sum(axis=1) / np.maximum(flags.sum(axis=1), 1)


def _fit(flags: np.ndarray, langs: list[str], landmarks: int) -> Model:
    languages = sorted(set(langs))
    of = np.array([languages.index(x) for x in langs])
    chosen = np.concatenate([np.flatnonzero(of == i)[:landmarks] for i in range(len(languages))])
    marks = flags[chosen].astype(np.float32).T
    size = np.sqrt(np.maximum(marks.sum(axis=0), 1))
    values, vectors = np.linalg.eigh((marks.T @ marks / size[:, None] / size).astype(np.float64))
    good = values > 1e-6 * values.max()
    model = Model(languages, marks, (vectors[:, good] / np.sqrt(values[good])).astype(np.float32), np.zeros(0), np.stack([flags[chosen[of[chosen] == i]].any(axis=0) for i in range(len(languages))]), np.zeros(len(languages)))
    features = model.features(flags).astype(np.float64)
    target = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = 1 / np.bincount(of)[of]  # each language counts as much as any other
    left = (features * share[:, None]).T @ features
    model.weights = np.linalg.solve(left + RIDGE * np.eye(len(left)) * np.trace(left) / len(left), (features * share[:, None]).T @ target).astype(np.float32)
    others = np.setdiff1d(np.arange(len(of)), chosen)
    share = model.familiar(flags[others], of[others])
    for i in np.unique(of[others]):  # a language whose texts are all landmarks takes any text
        model.least[i] = 1 - ROOM * (1 - np.quantile(share[of[others] == i], RARE))
    return model


def learn(docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """A model of all languages in lang_col, from a bounded sample of the rows where learn_from holds.

    Of each language the rows are drawn whose hash of the id is in the lowest share that is likely
    to have sample rows, and the first sample of them count; with over MOST_SAMPLED / sample
    languages, each has as many rows less. Texts without letters and rows without a language teach
    nothing; if there is nothing else, there is no model.
    """
    drawn = F.xxhash64(F.col(id_col).cast("string"))
    usable = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), drawn.alias("drawn"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    sample, landmarks = max(1, min(sample, MOST_SAMPLED // len(counts))), max(1, min(landmarks, MOST_LANDMARKS // len(counts)))
    spark = docs.sparkSession
    shares = [(lang, int(min(1.2 * sample / n - 0.5, 0.49) * 2**64) if 1.2 * sample < n else 2**63 - 1) for lang, n in counts.items()]
    usable = usable.join(F.broadcast(spark.createDataFrame(shares, "lang string, most long")), "lang").where("drawn <= most").select("lang", "drawn", "text")

    def flagged(batches):
        for batch in batches:
            told = [(a, b, f) for a, b, t in zip(*(c.to_pylist() for c in batch.columns)) if (f := letters(t)) is not None]
            found = [(a, b, present(own[b % len(own)])) for a, b, own in ((a, b, pieces(f)) for a, b, f in told)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([np.packbits(x[2]).tobytes() for x in found], pa.binary())], names=["lang", "drawn", "flags"])

    rows = sorted(usable.mapInArrow(flagged, "lang string, drawn long, flags binary").collect())
    if not rows:
        return None
    taken: dict[str, int] = {}
    rows = [r for r in rows if taken.setdefault(r["lang"], 0) < sample and not taken.update({r["lang"]: taken[r["lang"]] + 1})]  # equal hashes
    flags = np.unpackbits(np.frombuffer(b"".join(bytes(r["flags"]) for r in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1)
    return _fit(flags, [r["lang"] for r in rows], landmarks)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", reject: bool = False) -> DataFrame:
    """docs with two more columns: each text's language and a score from 0 to 1.

    The score is half of 1 plus the regression's value for that language, which is near 1 for its
    texts and near -1 for others. A null text, or one without a letter, has the language `und` and
    score 0, as has every text if there is no model. With reject, so has a text too few of whose
    n-grams its language's landmarks have. All pieces of a text count, however long it is. Other
    columns are passed on as they are.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # landmarks * languages columns of WIDTH, whatever the input

    def of(batches):
        known = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, sure = [NONE] * part.num_rows, [0.0] * part.num_rows
                told = [(i, f) for i, text in enumerate(part.column(text_col).to_pylist() if known else ()) if text and (f := letters(text)) is not None]
                if told:
                    scores, bests, share = known.whole([f for _, f in told])
                    fits = share >= known.least[bests] if reject else np.ones(len(bests), dtype=bool)
                    for k in np.flatnonzero(fits):
                        langs[told[k][0]], sure[told[k][0]] = known.languages[bests[k]], float(min(max((1 + scores[k, bests[k]]) / 2, 0), 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=[*part.schema.names, lang_name, score_name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(of, f"{schema}, {lang_name} string, {score_name} double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", divisor: int = 3, held: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Learns from the rows whose crc32(id as text) mod divisor is not held, and never from others;
    a null id counts as empty text. See learn() and predict() for texts that are null or have no
    letter. An empty table gives an empty result.
    """
    held_out = crc_remainder(F.col(id_col), divisor) == held
    model = learn(docs, ~held_out, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def drop_unidentified(docs: DataFrame, least_score: float = 0.25, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, whose language is identified, as one of those learned, with at least least_score."""
    model = learn(docs, F.lit(True), id_col, text_col, lang_col)
    lang, score = "_lang_pred", "_lang_score"
    return predict(docs, model, text_col, lang, score, reject=True).where((F.col(lang) != NONE) & (F.col(score) >= least_score)).drop(lang, score)
