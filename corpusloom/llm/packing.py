"""Packing of tokenised documents into training windows of several sizes.

Every document gives its whole windows of the longest size; its rest is routed to the
smallest context size (tier) that holds it. From the longest tier down, the rests of a
tier open windows, and the gaps that they leave are filled by documents of shorter
tiers, cut where a gap ends. A tier opens only as many windows as the shorter ones
can fill, so windows come out full; what is left of a group of documents, less than
the shortest tier, is the one sequence that needs padding. All sizes are powers of
two, so that sequences in falling order of size fill training steps of equal tokens
exactly.

A task tokenises and packs the documents that it reads, group by group, so texts and
tokens never move; only the pieces leave it.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusloom.llm.words import blocks, words_of

TIERS = (2048, 1024, 512, 256, 128)
END_ID = 1
GROUP_TOKENS = 1 << 20   # tokens of the documents packed together, about
BLOCK_BYTES = 3 << 20    # of text encoded at a time, at least
STEP_TOKENS = 1 << 16    # padded tokens of a training step
CACHED_PARTS = 150_000   # of words, remembered by a task
_JOINED = 2000           # plain words encoded at a time
_PLAIN = "[A-Za-z0-9À-ÖØ-öø-ÿ]"

Spans = tuple[np.ndarray, np.ndarray, np.ndarray]  # document, start, length


class WordTokens:
    """Token ids of texts, for a tokenizer that never joins across white space, nor a
    letter or digit with a sign after it.

    A word of plain letters and digits is told from the signs after it, since there
    are far fewer of either than of both together. Each part is encoded once and
    remembered; the plain ones many at a time, with a stop between them."""

    def __init__(self, path: str, cached_parts: int = CACHED_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self._tokenizer, self._most = Tokenizer.from_file(path), cached_parts
        (self._stop,) = self._encode(".")
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {"": 0}
        self._ids, self._sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(1, dtype=np.int64)]

    def _encode(self, text: str) -> list[int]:
        return self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, parts: list[str], plain: bool) -> None:
        new = [p for p in parts if p not in self._known]
        self._known.update(zip(new, range(len(self._known), len(self._known) + len(new))))
        for first in range(0, len(new), _JOINED):
            some = new[first : first + _JOINED]
            if plain:
                ids = np.array(self._encode(" . ".join(some)), dtype=np.uint32)
                stops = np.concatenate([[-1], np.nonzero(ids == self._stop)[0], [len(ids)]])
                sizes, ids = np.diff(stops) - 1, ids[ids != self._stop]
            else:
                found = [self._encode(p) for p in some]
                sizes, ids = np.fromiter(map(len, found), dtype=np.int64), np.array([i for f in found for i in f], dtype=np.uint32)
            self._ids.append(ids)
            self._sizes.append(sizes)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and the count of each."""
        if len(self._known) > self._most:
            self._forget()
        head = pc.utf8_rtrim(words, characters=string.punctuation)
        plain = pc.match_substring_regex(head, f"^{_PLAIN}+$")
        head = pc.if_else(plain, pc.utf8_lower(head), words)
        tail = pc.if_else(plain, pc.replace_substring_regex(words, f"^{_PLAIN}+", ""), "")
        self._learn(pc.unique(head.filter(plain)).to_pylist(), True)
        head, tail = head.dictionary_encode(), tail.dictionary_encode()
        parts = [head.dictionary.to_pylist(), tail.dictionary.to_pylist()]
        self._learn([*parts[0], *parts[1]], False)  # what is left
        number = [np.fromiter(map(self._known.__getitem__, p), dtype=np.int64, count=len(p)) for p in parts]
        both = np.stack([number[0][np.asarray(head.indices)], number[1][np.asarray(tail.indices)]], axis=1)
        self._ids, self._sizes = [np.concatenate(self._ids)], [np.concatenate(self._sizes)]
        ids, sizes = _gathered(self._ids[0], self._sizes[0], both.ravel())
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, END_ID after each, and the count of each text."""
        words = words_of(texts)
        ids, sizes = self._words(words.distinct)
        codes = np.insert(words.codes, words.offsets[1:], len(sizes))
        out, lengths = _gathered(np.append(ids, np.uint32(END_ID)), np.append(sizes, 1), codes)
        last = words.offsets[1:] + np.arange(len(texts))  # where each text's END_ID stands in codes
        return out, np.diff(np.cumsum(lengths)[last], prepend=0)


def _gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat` (of the given sizes, one after the other) named by codes, and their sizes."""
    starts, lengths = np.cumsum(sizes) - sizes, sizes[codes]
    at = np.repeat(starts[codes] - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return flat[at], lengths


def _split(position: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a number line cut into intervals of the given lengths: the interval of each
    position, and the place in it."""
    ends = np.cumsum(lengths)
    index = np.searchsorted(ends, position, side="right")
    return index, position - (ends - lengths)[index]


def _cut(spans: Spans, at: int) -> tuple[Spans, Spans]:
    """The first `at` tokens of a list of spans, and the others."""
    ends = np.cumsum(spans[2])
    whole = int(np.searchsorted(ends, at, side="right"))
    head, tail = tuple(x[:whole] for x in spans), tuple(x[whole:].copy() for x in spans)
    if over := at - (int(ends[whole - 1]) if whole else 0):
        head = tuple(np.append(h, v) for h, v in zip(head, (tail[0][0], tail[1][0], over)))
        tail[1][0] += over
        tail[2][0] -= over
    return head, tail


def _take(spans: Spans, index: np.ndarray) -> Spans:
    return tuple(x[index] for x in spans)


def _join(*parts: Spans) -> Spans:
    return tuple(np.concatenate(x) for x in zip(*parts))


def pack(counts: np.ndarray) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (document, start, length) with the sequence and offset of each, and the
    tokens of each sequence, for documents of the given token counts."""
    pieces, sequences, offsets, sizes = [], [], [], []
    made = 0

    def put(spans: Spans, sequence: np.ndarray, offset: np.ndarray, size: int, count: int) -> None:
        nonlocal made
        pieces.append(spans)
        sequences.append(sequence + made)
        offsets.append(offset)
        sizes.append(np.full(count, size))
        made += count

    def put_stream(spans: Spans, window: int) -> Spans:
        """Whole windows from the head of a list of spans; the rest comes back."""
        count = int(spans[2].sum()) // window
        head, tail = _cut(spans, count * window)
        if count:
            bounds = np.union1d(np.cumsum(head[2]), np.arange(1, count + 1) * window)
            starts = np.concatenate([[0], bounds[:-1]])
            index, inside = _split(starts, head[2])
            put((head[0][index], head[1][index] + inside, bounds - starts), starts // window, starts % window, window, count)
        return tail

    left: Spans = (np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64), np.asarray(counts, dtype=np.int64))
    for tier in TIERS:
        # Whole windows inside one document.
        many = left[2] // tier
        of = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        if len(of):
            put((left[0][of], left[1][of] + nth * tier, np.full(len(of), tier)), np.arange(len(of)), np.zeros(len(of), dtype=np.int64), tier, len(of))
        left = (left[0], left[1] + many * tier, left[2] - many * tier)
        left = _take(left, np.nonzero(left[2])[0])
        # Rests above half the size open windows, the fullest first, while the others can fill the gaps.
        order = np.argsort(-left[2], kind="stable")
        left = _take(left, order)
        gaps = np.cumsum(tier - left[2])
        fills = left[2].sum() - np.cumsum(left[2])
        opened = int(np.sum((left[2] > tier // 2) & (gaps <= fills)))
        head, rest = _take(left, np.arange(opened)), _take(left, np.arange(len(left[2]) - 1, opened - 1, -1))  # shortest first
        if opened:
            put(head, np.arange(opened), np.zeros(opened, dtype=np.int64), tier, opened)
            gap = tier - head[2]
            fill, rest = _cut(rest, int(gap.sum()))
            if len(fill[2]):
                bounds = np.union1d(np.cumsum(fill[2]), np.cumsum(gap))
                bounds = bounds[bounds > 0]
                starts = np.concatenate([[0], bounds[:-1]])
                index, inside = _split(starts, fill[2])
                window, place = _split(starts, gap)
                made -= opened  # into the windows just opened
                pieces.append((fill[0][index], fill[1][index] + inside, bounds - starts))
                sequences.append(window + made)
                offsets.append(place + head[2][window])
                made += opened
        left = rest
    left = put_stream(left, TIERS[-1])
    if len(left[2]):
        put(left, np.zeros(len(left[2]), dtype=np.int64), np.cumsum(left[2]) - left[2], int(left[2].sum()), 1)
    none = np.zeros(0, dtype=np.int64)
    return (
        _join(*pieces) if pieces else (none, none, none), np.concatenate([none, *sequences]),
        np.concatenate([none, *offsets]), np.concatenate([none, *sizes]),
    )


def padded(sizes: np.ndarray) -> np.ndarray:
    """A sequence is padded to the longest size, except at a power of two."""
    return np.where(sizes & (sizes - 1), TIERS[0], sizes)


def steps(sizes: np.ndarray) -> np.ndarray:
    """The training step of each sequence: in falling order of padded size, powers of
    two meet the borders of the steps, so that all but the last have equal tokens."""
    full = padded(sizes)
    order = np.argsort(-full, kind="stable")
    step = np.empty(len(full), dtype=np.int64)
    step[order] = (np.cumsum(full[order]) - full[order]) // STEP_TOKENS
    return step


def _gathered_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches, small ones together until they have `size` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def packed(
    documents: DataFrame, tokenizer: str, with_ids: bool = True,
    block_bytes: int = BLOCK_BYTES, cached_parts: int = CACHED_PARTS,
) -> DataFrame:
    """`doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens,
    step`, and `ids` on request: one row per piece of a document (`doc_id`, `text`,
    others ignored).

    `tokenizer` is the path of a tokenizer file, the same on all machines, whose
    words end at white space. Larger blocks and caches save time and cost memory; they
    change nothing else but the place of cuts. A null text is empty, and an empty document is its end
    id alone. Repeated rows and ids are packed as often as they come; null ids stay
    null. An empty table gives an empty result. Rows should come from a table, so
    that a task that runs again reads the same ones."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    numbers = "start length ids_crc32 doc_tokens sequence_id offset sequence_tokens step".split()
    names = ["doc_id", *numbers, *["ids"] * with_ids]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in numbers) + ", ids array<int>" * with_ids

    def group(doc_ids: list[pa.Array], ids: np.ndarray, counts: np.ndarray, sequence: int, step: int) -> tuple[pa.RecordBatch, int, int]:
        (doc, start, length), seq, offset, sizes = pack(counts)
        begin = np.cumsum(counts) - counts
        first = begin[doc] + start
        raw = ids.astype("<u4", copy=False)
        checks = [zlib.crc32(raw[i : i + n]) for i, n in zip(first.tolist(), length.tolist())]
        step_of = steps(sizes)
        columns = [
            pa.chunked_array(doc_ids).combine_chunks().take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (
                start, length, np.array(checks, dtype=np.int64), counts[doc], seq + sequence, offset, sizes[seq], step_of[seq] + step,
            )),
        ]
        if with_ids:
            flat = np.concatenate([raw[i : i + n] for i, n in zip(first, length)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), flat))
        return pa.RecordBatch.from_arrays(columns, names=names), len(sizes), int(step_of.max(initial=-1)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokens(tokenizer, cached_parts)
        sequence = step = TaskContext.get().partitionId() << 32
        doc_ids, ids, counts, held = [], [], [], 0
        for batch in _gathered_batches(batches, block_bytes):
            for block in blocks(batch, 1, 2 * block_bytes):
                found, sizes = encoder.encode(block.column(1))
                doc_ids.append(block.column(0))
                ids.append(found)
                counts.append(sizes)
                held += len(found)
                if held >= GROUP_TOKENS:
                    out, more, on = group(doc_ids, np.concatenate(ids), np.concatenate(counts), sequence, step)
                    yield out
                    sequence, step, doc_ids, ids, counts, held = sequence + more, step + on, [], [], [], 0
        if doc_ids:
            yield group(doc_ids, np.concatenate(ids), np.concatenate(counts), sequence, step)[0]

    return documents.select("doc_id", "text").mapInArrow(run, schema)
