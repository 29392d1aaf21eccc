"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of hashed rows for the word and its beginnings, so that
inflected forms share what they have in common. Filters over one, two and three
words run along the whole text; of each filter the largest few distinct responses
are kept (k-max pooling), and a logistic layer weighs them. The network is trained on all labelled
rows that are not held out, in numpy inside tasks: each task fits a shard of them, from
counts of all shards, and the parameters of the shards are averaged. It is broadcast then: its
size is fixed by the constants below. Scoring turns the filters into tables over the
distinct words of a block of texts, so a text costs a few look-ups per word.

The score is set on rows apart from the training rows so that 0.7 separates the
labels best; by language, thresholds near it are fitted where there are enough labels.
"""

from __future__ import annotations

import copy
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.exact_dedup import text_key
from corpusloom.llm.sampling import SAMPLE_BYTES, SAMPLE_ROWS, labelled
from corpusloom.llm.words import Words, blocks, words_of
from corpusloom.session import written

ROWS = 1 << 16          # of the hashed embedding
WIDTH = 12              # of an embedding
WIDTHS = (1, 2, 3)      # words under a filter
FILTERS = 8             # of each width
KEPT = 3                # responses of each filter
EPOCHS = 6
BATCH = 64              # texts
RATE = 0.01
PRIOR_TEXTS = 10
THRESHOLD = 0.7
PREFIXES = (5, 6, 7, 8)  # bytes
SHARD_ROWS = SAMPLE_ROWS   # labelled documents fitted by a task, about
SHARD_BYTES = SAMPLE_BYTES # of their texts together, about
RAW_DECIMALS = 3           # of the scores that set the thresholds, where there are more than a shard's
_TOGETHER = 1 << 14       # parameters that are averaged together
_PIECES = 1 + len(PREFIXES)
_EDGES = string.punctuation + "«»“”„’…–—¿¡"


def held_out() -> Column:
    """Rows that are never trained on."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def pieces(words: pa.Array) -> np.ndarray:
    """(n, pieces) embedding rows of words: the word and its first bytes."""
    names = words.cast(pa.large_binary()).to_pylist()
    first = np.array(names, dtype="S8").view(np.uint64) if names else np.zeros(0, np.uint64)
    out = np.empty((len(names), _PIECES), dtype=np.int64)
    out[:, 0] = np.fromiter(map(zlib.crc32, names), dtype=np.int64, count=len(names)) % ROWS
    with np.errstate(over="ignore"):
        for j, n in enumerate(PREFIXES, 1):
            mixed = ((first & np.uint64(2 ** (8 * n) - 1)) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out[:, j] = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    out[:, 1:] %= ROWS
    return out


def plain_words(texts: pa.Array) -> Words:
    """Words in lower case without the signs around them; what is then equal has one code."""
    found = words_of(texts)
    merged = pc.utf8_trim(pc.utf8_lower(found.distinct), characters=_EDGES).dictionary_encode()
    return Words(np.asarray(merged.indices, dtype=np.int64)[found.codes], found.offsets, merged.dictionary)


@dataclass
class Texts:
    """Texts as one row of word codes. Code 0 is a blank: two follow each text, and one
    stands for a text without words."""

    codes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    pieces: np.ndarray  # of codes from 1 on

    @staticmethod
    def of(texts: pa.Array) -> "Texts":
        found = plain_words(texts)
        counts = np.diff(found.offsets)
        blanks = (max(WIDTHS) - 1) + (counts == 0)
        codes = np.insert(found.codes + 1, np.repeat(found.offsets[1:], blanks), 0)
        size = counts + blanks
        begin = np.cumsum(size) - size
        return Texts(codes, begin, begin + np.maximum(counts, 1), pieces(found.distinct))


@dataclass
class Cnn:
    rows: np.ndarray = field(repr=False)    # (ROWS, WIDTH)
    filters: np.ndarray = field(repr=False) # (positions, WIDTH, FILTERS), the positions of each width in turn
    bias: np.ndarray                        # (widths, FILTERS)
    out: np.ndarray                         # (widths * KEPT * FILTERS)
    level: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def new(seed: int) -> "Cnn":
        rng, positions = np.random.default_rng(seed), sum(WIDTHS)
        return Cnn(
            rng.normal(0, 0.02, (ROWS, WIDTH)).astype(np.float32),
            rng.normal(0, 0.3, (positions, WIDTH, FILTERS)).astype(np.float32),
            np.zeros((len(WIDTHS), FILTERS), dtype=np.float32),
            rng.normal(0.2, 0.1, len(WIDTHS) * KEPT * FILTERS).astype(np.float32),
        )

    def flat(self) -> np.ndarray:
        """All that is fitted, one after the other."""
        return np.concatenate([self.rows.ravel(), self.filters.ravel(), self.bias.ravel(), self.out.ravel(), [self.level]]).astype(np.float64)

    def put(self, flat: np.ndarray) -> None:
        """What `flat` gave."""
        at = 0
        for part in (self.rows, self.filters, self.bias, self.out):
            part[...] = flat[at : at + part.size].reshape(part.shape)
            at += part.size
        self.level = float(flat[at])

    def pooled(self, texts: Texts, places: np.ndarray | None = None) -> np.ndarray:
        """(n, widths, KEPT, FILTERS) responses; on request also the places of those above 0."""
        words = np.concatenate([np.zeros((1, WIDTH), np.float32), self.rows[texts.pieces].sum(axis=1)])
        lengths = texts.end - texts.begin
        inside = np.repeat(texts.begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        starts = np.cumsum(lengths) - lengths
        values = np.zeros((len(lengths), len(WIDTHS), KEPT, FILTERS), np.float32)
        first = 0
        for w, width in enumerate(WIDTHS):
            response = (words @ self.filters[first])[texts.codes[inside]]
            for j in range(1, width):
                response += (words @ self.filters[first + j])[texts.codes[inside + j]]
            response += self.bias[w]
            first += width
            for k in range(KEPT):
                best = np.maximum.reduceat(response, starts, axis=0) if len(starts) else response[:0]
                values[:, w, k] = np.maximum(best, 0)
                if not (best > 0).any():
                    break
                top = np.repeat(best, lengths, axis=0)
                if places is not None:
                    row, col = np.nonzero((response == top) & (response > 0))
                    text = np.searchsorted(starts, row, side="right") - 1
                    places[text, w, k, col] = inside[row]
                if k < KEPT - 1:
                    response *= response < top  # equal responses count once
        return values

    def raw(self, texts: Texts) -> np.ndarray:
        return self.pooled(texts).reshape(-1, len(self.out)) @ self.out + self.level

    def score(self, texts: Texts) -> np.ndarray:
        return _sigmoid(self.raw(texts).astype(np.float64) * self.scale + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _counts(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """How many texts of each label hold each embedding row, and how many there are."""
    counts = np.zeros((2, ROWS + 1))
    for text, label in zip(texts, labels):
        found = plain_words(pa.array([text], pa.string())).distinct
        counts[int(label), np.unique(pieces(found))] += 1
        counts[int(label), ROWS] += 1
    return counts


def _log_odds(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of label 1 for each embedding row, by the texts that hold it: where
    the first component starts, or k-max pooling would first have to find the words."""
    counts, sizes = counts[:, :ROWS], counts[:, ROWS:]
    rates = (counts + PRIOR_TEXTS * sizes / sizes.sum()) / (sizes + PRIOR_TEXTS)
    return np.log(rates[1] / rates[0])


def _fit(model: Cnn, texts: list[str], labels: np.ndarray, seed: int) -> None:
    """Adam steps on the log loss; only what a kept response has touched moves."""
    rng, step = np.random.default_rng(seed), 0
    state = {n: (np.zeros_like(getattr(model, n)), np.zeros_like(getattr(model, n))) for n in ("rows", "filters", "bias", "out")}
    spread = (np.zeros(1), np.zeros(1))
    size = np.array([len(t) for t in texts])

    def move(value: np.ndarray, memory: tuple[np.ndarray, np.ndarray], grad: np.ndarray, at=slice(None)) -> None:
        first, second = memory
        first[at] = 0.9 * first[at] + 0.1 * grad
        second[at] = 0.99 * second[at] + 0.01 * grad * grad
        value[at] -= RATE * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.99**step)) + 1e-6)

    order = np.argsort(size * rng.uniform(0.7, 1.4, len(size)))  # texts of like length together
    parts = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    batches = [(Texts.of(pa.array([texts[i] for i in part], pa.string())), labels[part]) for part in parts]
    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            step += 1
            batch, y = batches[b]
            places = np.zeros((len(y), len(WIDTHS), KEPT, FILTERS), dtype=np.int64)
            values = model.pooled(batch, places)
            flat = values.reshape(len(y), -1)
            error = (_sigmoid(flat @ model.out + model.level) - y).astype(np.float32) / len(y)
            back = (error[:, None] * model.out).reshape(values.shape) * (values > 0)
            grad_rows, touched, grad_filters = [], [], np.zeros_like(model.filters)
            first = 0
            for w, width in enumerate(WIDTHS):
                text, k, f = np.nonzero(back[:, w])
                g, at = back[text, w, k, f], places[text, w, k, f]
                for j in range(width):
                    code = batch.codes[at + j]
                    real = code > 0
                    rows = batch.pieces[code[real] - 1]
                    vector = model.rows[rows].sum(axis=1)
                    np.add.at(grad_filters[first + j].T, f[real], g[real, None] * vector)
                    grad_rows.append(np.repeat(g[real, None] * model.filters[first + j].T[f[real]], _PIECES, axis=0))
                    touched.append(rows.ravel())
                first += width
            move(model.out, state["out"], error @ flat + 1e-4 * model.out)
            move(model.bias, state["bias"], back.sum(axis=(0, 2)))
            move(model.filters, state["filters"], grad_filters + 1e-5 * model.filters)
            level = np.array([model.level])
            move(level, spread, np.array([error.sum()]))
            model.level = float(level[0])
            if touched and sum(map(len, touched)):
                index, back_to = np.unique(np.concatenate(touched), return_inverse=True)
                grad = np.zeros((len(index), WIDTH), np.float32)
                np.add.at(grad, back_to, np.concatenate(grad_rows))
                move(model.rows, state["rows"], grad, index)


def _best_cut(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap it falls in."""
    order = np.argsort(-score, kind="stable")
    score, label, weight = score[order], label[order], weight[order]
    hits = np.cumsum(label * weight)
    f1 = 2 * hits / (np.cumsum(weight) + (label * weight).sum())
    f1[:-1][score[:-1] == score[1:]] = -1
    best = int(np.argmax(f1))
    return float((score[best] + (score[best + 1] if best + 1 < len(score) else score[best] - 1)) / 2)


def _calibrate(model: Cnn, raw: np.ndarray, labels: np.ndarray, langs: list[str | None], weight: np.ndarray) -> None:
    """Scale and shift of the score, and the thresholds of languages. `weight` texts have a raw
    score, label and language."""
    mean = lambda x: (weight * x).sum() / weight.sum()
    spread = np.sqrt(mean((raw - mean(raw)) ** 2)) or 1.0
    unit = (raw - mean(raw)) / spread
    scale, shift = 1.0, 0.0
    for _ in range(1000):
        error = _sigmoid(scale * unit + shift) - labels
        scale -= 0.5 * (mean(error * unit) + 0.003 * scale)
        shift -= 0.5 * mean(error)
    scale = max(scale, 0.1) / spread
    cut = _best_cut(raw, labels, weight) if 0 < labels.sum() < len(labels) else 0.0
    model.scale, model.shift = scale, float(np.log(THRESHOLD / (1 - THRESHOLD)) - scale * cut)
    score = _sigmoid(model.scale * raw + model.shift)
    for lang in {x for x in langs if x is not None}:
        mine = np.array([x == lang for x in langs])
        positives = (labels * weight)[mine].sum()
        if positives < weight[mine].sum():
            # Few labels leave the threshold where it is for all languages.
            own = _best_cut(score[mine], labels[mine], weight[mine]) if positives else THRESHOLD
            share = positives / (positives + 20)
            model.thresholds[lang] = float(np.clip(share * own + (1 - share) * THRESHOLD, 0.5, 0.9))


def _known(labels: DataFrame) -> DataFrame:
    """`doc_id, toxic` of the ids that are not held out."""
    return labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL")


def sampled(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """At most `rows` labelled documents that are not held out, of bounded size together
    (`sampling.labelled`): `doc_id, text, lang, toxic`."""
    return labelled(documents, _known(labels), "lang", rows=rows)


def _labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled documents that are not held out, as a table `doc_id, text, lang, toxic, bytes, apart`.
    Of several documents of an id the shortest counts (then the least hash of the text), once.
    Rows `apart` set score and thresholds."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    narrow = documents.select("doc_id", F.struct(size.alias("bytes"), text_key().alias("text_key")).alias("of"))
    known = _known(labels).where("doc_id IS NOT NULL")
    chosen = narrow.join(known, "doc_id").groupBy("doc_id").agg(F.min("of").alias("of"), F.first("toxic").alias("toxic"))
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("of.text_key").alias("chosen_key"), "of.bytes", "toxic")
    match = (F.col("doc_id") == F.col("chosen_id")) & (text_key() == F.col("chosen_key"))
    apart = F.crc32(F.concat(F.lit("apart"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    rows = documents.select("doc_id", "text", "lang").join(written(chosen, "labels"), match).dropDuplicates(["doc_id"])
    return written(rows.select("doc_id", "text", "lang", "toxic", "bytes", apart.alias("apart")), "labelled")


def _over_shards(rows: DataFrame, shards: int, run: Callable[[list[str], np.ndarray], np.ndarray], average: bool) -> np.ndarray:
    """The sum, or the mean, over shards of what `run` makes of a shard's texts and labels: numbers
    that are added up in pieces, so the driver gets them once, whatever the number of shards."""

    def each(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("doc_id")
        made = run(shard.text.fillna("").tolist(), shard.toxic.to_numpy().astype(np.float64))
        parts = [made[i : i + _TOGETHER] for i in range(0, len(made), _TOGETHER)]
        return pd.DataFrame({"piece": range(len(parts)), "shard": int(shard["shard"].iloc[0]), "numbers": parts})

    def added(pieces: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(pieces.sort_values("shard").numbers.tolist(), axis=0)
        return pd.DataFrame({"piece": [pieces.piece.iloc[0]], "n": [len(pieces)], "numbers": [total]})

    dealt = rows.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    found = dealt.groupBy("shard").applyInPandas(each, "piece long, shard long, numbers array<double>")
    sums = found.groupBy("piece").applyInPandas(added, "piece long, n long, numbers array<double>").toArrow().sort_by("piece")
    total = np.concatenate([np.asarray(x.values) for x in sums.column("numbers")])
    return total / sums.column("n")[0].as_py() if average else total


def train(documents: DataFrame, labels: DataFrame, seed: int = 7) -> Cnn:
    """Fit on all labelled documents that are not held out; a fifth of them sets score and
    thresholds. Without labels of both kinds every score is that of an empty text. Null ids
    have no label, a null text counts as empty, repeated rows of an id count once."""
    rows = _labelled(documents, labels)
    toxic = F.col("toxic").cast("double")
    low, high, kept_apart, kept = rows.agg(
        F.min("toxic"), F.max("toxic"), F.sum(F.when(F.col("apart"), toxic)), F.sum(F.when(~F.col("apart"), toxic)),
    ).first()
    model = Cnn.new(seed)
    if low == high:
        model.out[:], model.shift = 0, -3.0
        return model
    if (kept_apart or 0) < 5 or (kept or 0) < 5:
        fit = check = rows
    else:
        fit, check = rows.where("NOT apart"), rows.where("apart")
    number, size = fit.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    shards = max(1, -(-number // SHARD_ROWS), -(-size // SHARD_BYTES))
    counts = _over_shards(fit, shards, lambda texts, y: _counts(texts, y).ravel(), average=False)
    model.rows[:, 0] += _log_odds(counts.reshape(2, -1)) / _PIECES
    model.filters[:, 0] = np.abs(model.filters[:, 0])

    def fitted(texts: list[str], y: np.ndarray) -> np.ndarray:
        own = copy.deepcopy(model)
        _fit(own, texts, y, seed)
        return own.flat()

    model.put(_over_shards(fit, shards, fitted, average=True))
    # Equal scores are counted together, so the driver gets as many as there are different ones.
    raw = F.col("raw") if check.count() <= SHARD_ROWS else F.round("raw", RAW_DECIMALS)
    found = _raw(check.select("text", "lang", "toxic"), model).groupBy(raw.alias("raw"), "lang", "toxic").agg(F.count(F.lit(1)).alias("n"))
    found = found.toPandas().sort_values(["raw", "toxic", "lang"])
    y, weight = found.toxic.to_numpy().astype(np.float64), found.n.to_numpy().astype(np.float64)
    _calibrate(model, found.raw.to_numpy(), y, [x if isinstance(x, str) else None for x in found.lang], weight)
    return model


def _with_numbers(rows: DataFrame, model: Cnn, name: str, numbers: Callable[[Cnn, Texts], np.ndarray]) -> DataFrame:
    """The rows (`text` needed) with a number of each text as `name`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at, names = rows.columns.index("text"), [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, at):
                found = numbers(shared.value, Texts.of(block.column(at))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found)], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def _raw(rows: DataFrame, model: Cnn) -> DataFrame:
    return _with_numbers(rows, model, "raw", lambda model, texts: model.raw(texts))


def scored(documents: DataFrame, model: Cnn) -> DataFrame:
    """The rows of `documents` (`text` needed) with `score`, in place of a column of that name. Null
    and empty texts get the score of a text without words; equal texts, repeated rows among
    them, get equal scores. Rows stay where they are; an empty table gives an empty result."""
    others = [c for c in documents.columns if c != "score"]
    return _with_numbers(documents.select(*others), model, "score", lambda model, texts: model.score(texts))


def thresholds(model: Cnn) -> Column:
    """The threshold of a row's language; of others, the common one."""
    out = F.when(F.lit(False), F.lit(THRESHOLD))
    for lang, value in sorted(model.thresholds.items()):
        out = out.when(F.col("lang") == lang, F.lit(value))
    return out.otherwise(F.lit(THRESHOLD))


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `documents` (`doc_id`, `text`, `lang`) whose score is below the threshold of their
    language; a null or unknown language has the common one, a score at the threshold is
    rejected. Each row is judged by its text, so null ids and repeated rows are kept or
    go as others. All columns come through, whatever their names; an empty table stays empty."""
    model = train(documents, labels)
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = documents.select(whole.alias("row"), "text", "lang")
    return scored(rows, model).where(F.col("score") < thresholds(model)).select("row.*")
