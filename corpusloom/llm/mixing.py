"""A mix of sources by weight over training time.

Sources get targets by weight, none above a multiple of its size. A source is read in
a fixed pseudo-random order, again from the start where its target asks for more than
it has, and each document taken stands at a point of the source's demand in words.
The weight of a source varies over training: its schedule is integrated, and the
inverse of the integral turns demand into a position between 0 and 1. Documents
sorted by position, in ranges, are the curriculum.

Whole documents are taken. A source's last round takes, in its order, every document that
still fits into what is missing, and in the end one more, if that comes nearer.

No task sees a whole source: the order is cut into buckets of bounded size by its
key, sums of buckets give each its start, and only inside buckets are rows numbered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.ordering import numbered
from corpusloom.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5          # of all words
MOST = 2             # times a document, and a source, is taken at most
BUCKET_ROWS = 2048   # of a source that has all rows, about

#: Weight schedules over training time, one for each weight in turn: (time, weight)
#: knots, straight in between; only the shape counts. The heaviest sources fade in
#: the second half, the next stay as they are, the lightest come in late.
SCHEDULES = (
    ((0.0, 1.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 0.75), (1.0, 1.5)),
)


def integrated(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """The integral of a schedule, scaled to 1: pieces of (time and weight at the start,
    slope, integral before)."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    pieces, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, w0 / area, (w1 - w0) / area / (t1 - t0), done))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return pieces


def position(share: Column, schedule: Column, schedules: Sequence = SCHEDULES) -> Column:
    """The training time at which a source has given `share` (0 to 1) of its words."""
    out = F.lit(None).cast("double")
    for number, knots in enumerate(schedules):
        of = F.lit(None).cast("double")
        for start, weight, slope, before in integrated(knots):
            more = share - before
            time = start + 2 * more / (weight + F.sqrt(F.lit(weight * weight) + 2 * slope * more))
            of = F.when(more > 0, time).otherwise(F.coalesce(of, F.lit(0.0)))
        out = F.when(schedule == number, of).otherwise(out)
    return F.least(out, F.lit(1.0))


def _ordered(documents: DataFrame, seed: str, *carried: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}/"), F.md5(text.cast("binary")))
    key = F.md5(name.cast("binary"))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return documents.select(*carried, "doc_id", "source", size.alias("size"), key.alias("key"))


def _placed(rows: DataFrame, buckets: int) -> DataFrame:
    """`bucket`, `place` in it and `upto`, the words of the bucket before the row."""
    bucket = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size")
    return (
        rows.withColumn("bucket", F.shiftright(bucket, 32))
        .withColumn("place", F.row_number().over(inside))
        .withColumn("upto", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`source, words, turn, target` of a table `source, words`: weights by code point
    order, nulls last, share the total; what a source has above `most` times its
    words is shared by the others, until none is above. Each round is one sum over
    the sources; a level of words per weight is all that reaches the driver."""
    ranked = numbered(sources, F.col("source").asc_nulls_last())
    turn = F.pmod("row_number", F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    ranked = written(ranked.select("source", "words", turn.alias("turn"), weight.alias("weight")), "ranked")
    total = share * (ranked.agg(F.sum("words")).first()[0] or 0)
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > most * F.col("words")
        full, free = ranked.agg(F.sum(F.when(above, most * F.col("words"))), F.sum(F.when(~above, F.col("weight")))).first()
        now = (total - (full or 0)) / free if free else math.inf
        if now <= level or not free:
            break
        level = now
    fair = F.col("weight") * F.lit(level)
    cap = (most * F.col("words")).cast("double")
    return ranked.select("source", "words", "turn", F.least(fair, cap).alias("target"))


def _plan(documents: DataFrame, seed: str, most: int) -> tuple[DataFrame, DataFrame, int]:
    """The placed narrow rows; what each bucket of a source needs to know; the buckets."""
    narrow = written(_ordered(documents, seed), "sizes")
    buckets = 1 << max(0, math.ceil(math.log2(max(1, narrow.count()) / BUCKET_ROWS)))
    rows = written(_placed(narrow, buckets), "places")
    sums = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = targets(sums.groupBy("source").agg(F.sum("words").alias("words")), most=most)
    rounds = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long")
    sources = written(
        sources.withColumn("rounds", rounds).withColumn("rest", F.col("target") - rounds * F.col("words"))
        .withColumnRenamed("words", "source_size"), "sources",
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    known = starts.join(sources, starts.source.eqNullSafe(sources.source)).drop(sources.source)
    known = written(known, "starts")
    at = rows.join(known, _same_bucket(rows, known)).select(
        rows.source, rows.bucket, "place", "size", "key", (F.col("start") + F.col("upto") + F.col("size")).alias("end"), "rest",
    )
    at = written(at, "ends")
    done = at.groupBy("source").agg(
        F.first("rest").alias("rest"), F.coalesce(F.max(F.when(F.col("end") <= F.col("rest"), F.col("end"))), F.lit(0)).alias("done"),
    )
    done = written(done.withColumn("missing", F.col("rest") - F.col("done")), "done")
    late, done = _fitted(at.where("end > rest AND size > 0").drop("end", "rest"), done)
    ends = _nearest(at.where("end > rest"), late, done)
    known = known.join(ends, known.source.eqNullSafe(ends.of), "left").drop("of")
    lates = late.groupBy(F.col("source").alias("of"), F.col("bucket").alias("in")).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "inside"))).alias("late")
    )
    known = known.join(lates, known.source.eqNullSafe(lates.of) & (known.bucket == lates["in"]), "left").drop("of", "in")
    return rows, written(known, "known"), buckets


def _fitted(left: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`source, bucket, place, inside` of the rows that are taken after the first one that did not
    fit, with the words taken before each; and `done` (`source, rest, done, missing`) after them.

    A pass takes the beginning of the rows that fit, up to the first that does not any more;
    that one is larger than what is missing after it, so later passes have ever smaller
    rows, and only buckets that begin within what is missing are looked into."""
    late = None
    while True:
        state = done.select(F.col("source").alias("of"), "done", "missing")
        fitting = left.join(state, F.col("source").eqNullSafe(F.col("of"))).where(F.col("size") <= F.col("missing")).drop("of")
        left = written(fitting, "fitting")
        sums = left.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(F.col("source").alias("of"), F.col("bucket").alias("in"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
        near = left.join(starts, left.source.eqNullSafe(starts.of) & (left.bucket == starts["in"])).where("start <= missing")
        inside = Window.partitionBy("source", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        end = F.col("start") + F.sum("size").over(inside)
        taken = near.select("source", "bucket", "place", "size", "done", "missing", end.alias("end")).where("end <= missing")
        taken = written(taken.withColumn("inside", F.col("done") + F.col("end") - F.col("size")), "late")
        late = taken.select("source", "bucket", "place", "inside") if late is None else late.unionByName(
            taken.select("source", "bucket", "place", "inside"))
        more = taken.groupBy(F.col("source").alias("of")).agg(F.max("end").alias("more"))
        if more.isEmpty():
            return late, done
        done = written(done.join(more, done.source.eqNullSafe(more.of), "left").select(
            "source", "rest", (F.col("done") + F.coalesce("more", F.lit(0))).alias("done"),
            (F.col("missing") - F.coalesce("more", F.lit(0))).alias("missing"),
        ), "done")
        gone = taken.select(F.col("source").alias("of"), F.col("bucket").alias("in"), F.col("place").alias("at"))
        same = left.source.eqNullSafe(gone.of) & (left.bucket == gone["in"]) & (left.place == gone["at"])
        left = left.join(gone, same, "left_anti").drop("done", "missing")


def _nearest(left: DataFrame, late: DataFrame, done: DataFrame) -> DataFrame:
    """`of, done` of the sources, and `extra`, the row not taken that comes nearest to what is
    missing, if there is one that leaves less missing, or over, than without it."""
    state = done.select(F.col("source").alias("of"), "done", "missing")
    off = F.abs(F.col("size") - F.col("missing"))
    near = left.join(state, F.col("source").eqNullSafe(F.col("of"))).where(off < F.col("missing"))
    gone = late.select(F.col("source").alias("by"), F.col("bucket").alias("in"), F.col("place").alias("at"))
    near = near.join(gone, F.col("source").eqNullSafe(F.col("by")) & (F.col("bucket") == F.col("in")) & (F.col("place") == F.col("at")), "left_anti")
    best = near.groupBy(F.col("of").alias("by")).agg(F.min(F.struct(off.alias("off"), "key", "bucket", "place", "size")).alias("extra"))
    return written(state.join(best, F.col("of").eqNullSafe(F.col("by")), "left").select("of", "done", "extra"), "ends")


def _same_bucket(rows: DataFrame, known: DataFrame) -> Column:
    return rows.source.eqNullSafe(known.source) & (rows.bucket == known.bucket)


def _taken(rows: DataFrame, known: DataFrame, most: int, schedules: Sequence) -> DataFrame:
    """`copies` and `positions` (one for each copy) of placed rows."""
    at = rows.join(known, _same_bucket(rows, known)).drop(known.source, known.bucket)
    extra = (F.col("extra.bucket") == F.col("bucket")) & (F.col("extra.place") == F.col("place"))
    extra = F.coalesce(extra, F.lit(False))
    begin = F.col("start") + F.col("upto")
    late = F.element_at("late", F.col("place"))
    again = (begin + F.col("size") <= F.col("rest")) | extra | late.isNotNull()
    copies = F.least(F.col("rounds") + again.cast("long"), F.lit(most).cast("long"))
    all_words = F.col("rounds") * F.col("source_size") + F.col("done") + F.coalesce("extra.size", F.lit(0))
    # In the last round late documents follow the others, and the extra one them.
    last = F.when(extra, F.col("done")).otherwise(F.coalesce(late, begin))
    inside = lambda turn: F.when(turn == F.col("rounds"), last).otherwise(begin)
    share = lambda turn: (turn * F.col("source_size") + inside(turn) + F.col("size") / 2) / F.greatest(all_words, F.lit(1))
    turns = F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>"))
    positions = F.transform(turns, lambda turn: position(share(turn), F.col("turn"), schedules))
    return at.withColumn("copies", copies).withColumn("positions", positions)


def mix(documents: DataFrame, seed: str = "mix", most: int = MOST, schedules: Sequence = SCHEDULES) -> DataFrame:
    """`doc_id, source, size, source_size, target, taken, copies, positions`, one row per row
    of `documents` (`doc_id`, `text`, `source`, others ignored).

    Size counts the words at ASCII white space; a null or empty text has none. A
    null source is a source of its own, last in order. Documents of no words cost
    nothing. The order within a source goes by a digest of id and text; rows of the
    same id and text are neighbours and count one by one. An empty table gives an empty
    result. Whole documents are taken, so a source ends near its target, not at it."""
    rows, known, _ = _plan(documents, seed, most)
    return _taken(rows, known, most, schedules).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "positions",
    )


def curriculum(documents: DataFrame, seed: str = "mix", most: int = MOST, schedules: Sequence = SCHEDULES) -> DataFrame:
    """The rows of `documents`, as often as the mix takes them, sorted in ranges by
    position. All columns come through, whatever their names. Null ids and texts count as
    empty; rows of one id, text and source are copies of each other, and which of
    them is taken once more is arbitrary only where other columns tell them apart. Equal
    positions go by a digest of id and text. An empty table gives an empty result."""
    _, known, buckets = _plan(documents, seed, most)
    row = documents.select(F.struct(*documents.columns).alias("_row"), "doc_id", "text", "source")
    rows = _placed(_ordered(row, seed, "_row"), buckets)
    taken = _taken(rows, known, most, schedules)
    each = taken.select(F.explode("positions").alias("_at"), "_row", F.col("key").alias("_key"))
    ordered = each.repartitionByRange("_at", "_key").sortWithinPartitions("_at", "_key")
    return ordered.select("_row.*")
