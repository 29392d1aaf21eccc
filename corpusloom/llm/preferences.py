"""Preference pairs as training rows: one prompt, two completions, masked.

The chosen and the rejected conversation of a pair are compared turn by turn; the
turns that they begin with in common are rendered once as the prompt, what follows
in each is its completion. Loss is taken on what the assistant says in a completion,
up to its end mark; headers and the turns of others there are masked.

The common beginning is found by a count per turn of a pair, without putting
conversations together. Only the rendered texts are gathered, since a training row
is one row: a conversation has to fit in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER, HEADER_END, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
MASKED = -100  # the label of tokens without loss


def _header() -> Column:
    return F.concat(F.lit(HEADER), F.col("role"), F.lit(HEADER_END))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """`pair_id, side, number, role, text` from `pair_id, side, turn, role, text`: numbers from 0
    in the order of turn, role and text; null roles and texts are empty."""
    rows = turns.select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    rows = rows.where(F.col("side").isin("chosen", "rejected")).repartition("pair_id")
    return rows.withColumn("number", (F.row_number().over(order) - 1).cast("int")).drop("turn")


def common_turns(turns: DataFrame) -> DataFrame:
    """`pair_id, common`: how many turns both sides of a pair begin with. `turns` is numbered;
    sides are `chosen` and `rejected`."""
    turn = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    each = turns.select("pair_id", "number", turn.alias("digest")).groupBy("pair_id", "number").agg(
        F.count(F.lit(1)).alias("sides"), F.min("digest").alias("low"), F.max("digest").alias("high"),
    )
    differs = (F.col("sides") < 2) | (F.col("low") != F.col("high"))
    return each.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(differs, F.col("number"))), F.max("number") + 1).cast("int").alias("common")
    )


def formatted(turns: DataFrame) -> DataFrame:
    """`pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans`, one row per
    pair of `turns` (`pair_id`, `side`, `turn`, `role`, `text`, others ignored).

    Spans are `start-end` code points of a completion that carry loss, joined by commas.
    A side that is missing, or ends within the prompt, has an empty completion; if
    both have, the pair states no preference and both spans are empty. A turn that
    comes twice is two turns. Null pair ids are a pair. An empty table gives an empty
    result."""
    rows = numbered_turns(turns)
    head = common_turns(rows)
    met = rows.join(head, rows.pair_id.eqNullSafe(head.pair_id)).drop(head.pair_id)
    met = met.withColumn("piece", F.concat(_header(), F.col("text"), F.lit(END)))
    ahead = F.col("number") < F.col("common")
    before = Window.partitionBy("pair_id", "side").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.when(~ahead, F.length("piece"))).over(before), F.lit(0))
    trained = ~ahead & (F.col("role") == TRAINED)
    first, last = start + F.length(_header()), start + F.length("piece") - 1  # the line break after the mark carries none
    met = met.withColumn("span", F.when(trained, F.concat(first.cast("string"), F.lit("-"), last.cast("string"))))

    def gathered(piece: Column, condition: Column, sign: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(condition & piece.isNotNull(), F.struct("number", piece.alias("piece")))))
        return F.array_join(F.transform(found, lambda x: x["piece"]), sign)

    side = lambda name: F.col("side") == name
    piece, span = F.col("piece"), F.col("span")
    return met.groupBy("pair_id").agg(
        F.first("common").alias("prompt_turns"), gathered(piece, ahead & side("chosen"), "").alias("prompt"),
        gathered(piece, ~ahead & side("chosen"), "").alias("chosen"), gathered(piece, ~ahead & side("rejected"), "").alias("rejected"),
        gathered(span, side("chosen"), ",").alias("chosen_spans"), gathered(span, side("rejected"), ",").alias("rejected_spans"),
    )


def _labelled(encode, text: str, spans: str) -> tuple[list[int], list[int]]:
    """Ids and labels of a completion; it is cut at the spans' borders, so that no token
    lies across one."""
    ids, labels, at = [], [], 0
    for span in filter(None, spans.split(",")):
        first, last = map(int, span.split("-"))
        for part, kept in ((text[at:first], False), (text[first:last], True)):
            found = encode(part)
            ids += found
            labels += found if kept else [MASKED] * len(found)
        at = last
    rest = encode(text[at:])
    return ids + rest, labels + [MASKED] * len(rest)


def tokenized(pairs: DataFrame, tokenizer: str) -> DataFrame:
    """Formatted pairs with `prompt_ids`, and `ids` and `labels` of both completions; labels
    are MASKED where no loss is taken. `tokenizer` is the path of a tokenizer file."""
    kind = pairs.schema["pair_id"].dataType.simpleString()
    names = ["pair_id", "prompt_ids", "chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(tokenizer)
        tool.encode_special_tokens = True  # marks inside a text are text
        encode = lambda text: tool.encode(text, add_special_tokens=False).ids
        for batch in batches:
            rows = [
                (encode(r["prompt"]), *_labelled(encode, r["chosen"], r["chosen_spans"]), *_labelled(encode, r["rejected"], r["rejected_spans"]))
                for r in batch.to_pylist()
            ]
            columns = [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), *columns], names=names)

    return pairs.mapInArrow(run, f"pair_id {kind}, " + ", ".join(f"{n} array<int>" for n in names[1:]))
