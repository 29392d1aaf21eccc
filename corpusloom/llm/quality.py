"""Quality by ordinal regression: a cumulative-link model on graded ratings.

One weight per hashed word and word shape is shared by all grades, and ordered
thresholds cut the sum into grades: P(grade > k) = sigmoid(weights . text - cut k). The
expected grade ranks texts, the probability of a grade or better selects them. The
model is trained on the driver in numpy on a bounded sample of rated rows, and is
broadcast; its size is fixed. Texts are scored where they lie.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.sampling import SAMPLE_ROWS, labelled
from corpusloom.llm.words import blocks, words_of

FEATURES = 1 << 17
EPOCHS = 12
BATCH = 64
RATE = 0.05
SHRINK = 1e-4
SELECT = 0.5         # least probability of the selected grade or better


def held_out() -> Column:
    """Rows that are never trained on."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _hashed(words: pa.Array, salt: int) -> np.ndarray:
    names = words.cast(pa.large_binary()).to_pylist()
    return np.fromiter((zlib.crc32(w, salt) for w in names), dtype=np.int64, count=len(names)) % FEATURES


def _shapes(words: pa.Array) -> pa.Array:
    """Words with runs of small letters, capitals and digits replaced by a, A and 0."""
    for pattern, sign in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0")):
        words = pc.replace_substring_regex(words, pattern, sign)
    return words


@dataclass
class Bags:
    """Texts as feature pairs (word and shape) per word, one text after the other."""

    features: np.ndarray  # (distinct words, 2)
    codes: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> "Bags":
        found = words_of(texts)
        shapes = _shapes(found.distinct).dictionary_encode()
        by_shape = _hashed(shapes.dictionary, 2)[np.asarray(shapes.indices)] if len(found.distinct) else np.zeros(0, np.int64)
        return Bags(np.stack([_hashed(pc.utf8_lower(found.distinct), 1), by_shape], axis=1), found.codes, found.offsets)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """weights . text, over the square root of its words; 0 for a text without any."""
        each = weights[self.features].sum(axis=1)[self.codes].astype(np.float64)
        total = np.concatenate([[0], np.cumsum(each)])
        counts = np.diff(self.offsets)
        return (total[self.offsets[1:]] - total[self.offsets[:-1]]) / np.sqrt(np.maximum(counts, 1))


@dataclass
class CumulativeLink:
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one less than grades

    def tails(self, bags: Bags) -> np.ndarray:
        """(n, grades - 1) probabilities of a grade above 0, above 1, ..."""
        return _sigmoid(bags.sums(self.weights)[:, None] - self.cuts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str], grades: np.ndarray, levels: int, seed: int = 5) -> CumulativeLink:
    """Adam steps on the negative log-likelihood of the grades 0 to levels - 1. Cuts are a
    first one and positive gaps, so they stay in order."""
    rng = np.random.default_rng(seed)
    shares = np.array([(grades > k).mean() for k in range(levels - 1)]).clip(0.02, 0.98)
    start = np.maximum.accumulate(-np.log(shares / (1 - shares)) + np.arange(levels - 1) * 1e-3)
    weights, cut = np.zeros(FEATURES), np.concatenate([start[:1], np.log(np.diff(start).clip(1e-3))])
    memory = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, cut)]
    order = np.argsort([len(t) for t in texts], kind="stable")
    parts = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    batches = [(Bags.of(pa.array([texts[i] for i in p], pa.string())), grades[p]) for p in parts]
    step = 0

    def move(value: np.ndarray, state: tuple[np.ndarray, np.ndarray], grad: np.ndarray, at) -> None:
        first, second = state
        first[at] = 0.9 * first[at] + 0.1 * grad
        second[at] = 0.99 * second[at] + 0.01 * grad * grad
        value[at] -= RATE * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.99**step)) + 1e-8)

    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            step += 1
            bags, y = batches[b]
            cuts = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))
            tail = np.concatenate([np.ones((len(y), 1)), _sigmoid(bags.sums(weights)[:, None] - cuts), np.zeros((len(y), 1))], axis=1)
            slope = tail * (1 - tail)
            row = np.arange(len(y))
            chance = (tail[row, y] - tail[row, y + 1]).clip(1e-9)
            by_sum = -(slope[row, y] - slope[row, y + 1]) / chance / len(y)
            by_cut = np.zeros((len(y), levels + 1))
            by_cut[row, y] += slope[row, y] / chance
            by_cut[row, y + 1] -= slope[row, y + 1] / chance
            by_cut = by_cut[:, 1:-1].mean(axis=0)
            counts = np.diff(bags.offsets)
            each = np.repeat(by_sum / np.sqrt(np.maximum(counts, 1)), counts)
            by_word = np.bincount(bags.codes, weights=each, minlength=len(bags.features))
            index, back = np.unique(bags.features, return_inverse=True)
            grad = np.bincount(back.ravel(), weights=np.repeat(by_word, 2), minlength=len(index))
            move(weights, memory[0], grad + SHRINK * weights[index], index)
            from_end = np.cumsum(by_cut[::-1])[::-1]  # a gap moves all cuts after it
            move(cut, memory[1], from_end * np.concatenate([[1], np.exp(cut[1:])]), slice(None))
    return CumulativeLink(weights.astype(np.float32), np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])])))


def sampled(documents: DataFrame, ratings: DataFrame, rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """At most `rows` rated documents that are not held out, of bounded size together
    (`sampling.labelled`): `doc_id, text, grade`."""
    rated = ratings.where(~held_out()).groupBy("doc_id").agg(F.min("grade").alias("grade")).where("grade IS NOT NULL")
    return labelled(documents, rated, rows=rows)


def train(documents: DataFrame, ratings: DataFrame, levels: int) -> CumulativeLink:
    """Fit on a sample of `ratings` (`doc_id`, `grade` from 0 to levels - 1; of several, the
    lowest counts). Without ratings all texts get the middle."""
    sample = sampled(documents, ratings)
    if not len(sample):
        return CumulativeLink(np.zeros(FEATURES, np.float32), np.linspace(-1, 1, levels - 1))
    return fit(sample.text.fillna("").tolist(), sample.grade.to_numpy().astype(np.int64), levels)


def graded(documents: DataFrame, model: CumulativeLink, least: int) -> DataFrame:
    """The rows of `documents` (`text` needed) with `expected_grade, tail_probability, kept`: the probability of grade `least` or better, and whether it
    reaches SELECT. Null and empty texts have no words and get the score of none.
    Repeated rows are scored one by one; an empty table gives an empty result."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    added = ["expected_grade", "tail_probability", "kept"]
    rows = documents.select(*[c for c in documents.columns if c not in added])
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, at):
                tails = shared.value.tails(Bags.of(block.column(at)))
                tail = tails[:, least - 1]
                found = [pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= SELECT)]
                yield pa.RecordBatch.from_arrays([*block.columns, *found], names=[*block.schema.names, *added])

    kinds = [T.DoubleType(), T.DoubleType(), T.BooleanType()]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *map(T.StructField, added, kinds)]))
