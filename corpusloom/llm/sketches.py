"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is the set of its paragraphs' digests: lines, long ones cut after words whose
hash says so, about every PIECE_WORDS words, so that an edit changes the pieces around
it only. Each digest is added to one cell of each of three tables, and a cell keeps a
count, the exclusive-or of its digests and of their check sums. The fingerprint is
such a sketch of few cells. The cells of two fingerprints subtract, so that what the
texts share vanishes; a cell that is left with a single digest, proven by its check sum,
gives it away, and taking that digest out of its other cells lays more of them bare,
until the whole difference is known. If some cells never come bare, the sketches are made
again, larger and with other hashes; how much larger, the squares of the counts tell,
whose sum in a table is about the size of the difference.

Only filled cells are stored, sorted by number; adding sketches is a merge of sorted
arrays, so the work for a text grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.ordering import numbered

PIECE_WORDS = 32     # in a piece of a long line, on average
TABLES = 3
CELLS = 8            # in a table of the fingerprint; twice as many at each retry
GROWTH = 2
LEVELS = 24          # 134 million cells a table; a difference beyond ends the job with an error
ROOM = 8.0           # cells for each digest that a difference is thought to have; only filled ones cost anything
FULL = 0.5           # digests for each cell of the fingerprint from which peeling it is not tried
ROUNDS = 60          # of laying bare, at most; no progress ends it sooner
BLOCK_ROWS = 1024    # neighbours that are put together, about
MOST_BLOCKS = 4096   # their first ids are in the plan

_CELL = "struct<i:bigint,c:bigint,k:bigint,h:bigint>"

def _let(value: Column, body) -> Column:
    """`body(value)`, with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pieces(line: Column) -> Column:
    """The digests of a line's pieces, words alone counting."""

    def cut(words: Column) -> Column:
        last = lambda i: (i == F.size(words)) | (F.pmod(F.xxhash64(F.get(words, i - 1)), F.lit(PIECE_WORDS)) == 0)
        ends = F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(1), F.size(words)), last)).otherwise(F.array().cast("array<int>"))

        def digest(end: Column, x: Column, ends: Column) -> Column:
            before = F.coalesce(F.get(ends, x - 1), F.lit(0))
            return F.xxhash64(F.slice(words, before + 1, end - before))

        return _let(ends, lambda ends: F.transform(ends, lambda end, x: digest(end, x, ends)))

    return _let(F.filter(F.split(line, r"[\x20\x09\x0B\x0C]+"), lambda w: w != ""), cut)


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, in order."""
    return F.array_distinct(F.flatten(F.transform(F.split(text, r"[\n\r]+"), _pieces)))


def _check(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(-1)), 32)


def _entries(key: Column, count: Column, level: Column) -> Column:
    """The three cells of a digest at a level, holding it `count` times."""
    size = (F.lit(CELLS) * F.pow(F.lit(GROWTH), level)).cast("long")
    return F.array(*[
        F.struct(
            (F.pmod(F.xxhash64(key, F.lit(table), level), size) + table * size).alias("i"),
            count.cast("long").alias("c"), key.alias("k"), _check(key).alias("h"),
        ) for table in range(TABLES)
    ])


def _merged(cells: Column) -> Column:
    """Cells of equal number added up, without those that are empty then."""

    def added(acc: Column, e: Column) -> Column:
        return F.struct(
            acc["i"].alias("i"), (acc["c"] + e["c"]).alias("c"),
            acc["k"].bitwiseXOR(e["k"]).alias("k"), acc["h"].bitwiseXOR(e["h"]).alias("h"),
        )

    def runs(ordered: Column) -> Column:
        """Of sorted cells, where each number begins."""
        begins = lambda j: (j == 0) | (F.get(ordered, j)["i"] != F.get(ordered, j - 1)["i"])
        return F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), begins)

    def sums(ordered: Column, starts: Column) -> Column:
        def one(start: Column, x: Column) -> Column:
            end, first = F.coalesce(F.get(starts, x + 1), F.size(ordered)), F.get(ordered, start)
            more = F.aggregate(F.sequence(start + 1, end - 1), first, lambda acc, j: added(acc, F.get(ordered, j)))
            return F.when(end - start == 1, first).otherwise(more)

        return F.filter(F.transform(starts, one), lambda c: (c["c"] != 0) | (c["k"] != 0) | (c["h"] != 0))

    def summed(ordered: Column) -> Column:
        return F.when(F.size(ordered) == 0, ordered).otherwise(_let(runs(ordered), lambda starts: sums(ordered, starts)))

    return _let(F.sort_array(cells), summed)


def sketch(keys: Column, level: Column) -> Column:
    """The filled cells of a set of digests at a level, sorted by number."""
    return _merged(F.flatten(F.transform(keys, lambda k: _entries(k, F.lit(1), level))))


def subtracted(one: Column, other: Column, level: Column) -> Column:
    """The sketch of one set minus that of another: the cells of both, the latter with
    count -1, in one merge."""
    plus = F.transform(one, lambda k: _entries(k, F.lit(1), level))
    minus = F.transform(other, lambda k: _entries(k, F.lit(-1), level))
    return _merged(F.flatten(F.concat(plus, minus)))


def peeled(cells: Column, level: Column) -> Column:
    """The digests in a difference of sketches, `struct<plus, minus>` by the side that has
    them; null if some stay hidden."""
    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("plus"), none.alias("minus"), F.lit(True).alias("more"))

    def bare(acc: Column, side: int) -> Column:
        alone = F.filter(acc["cells"], lambda c: (c["c"] == side) & (_check(c["k"]) == c["h"]))
        return F.array_distinct(F.transform(alone, lambda c: c["k"]))

    def taken(acc: Column, found: Column) -> Column:
        plus = F.transform(found["plus"], lambda k: _entries(k, F.lit(-1), level))
        minus = F.transform(found["minus"], lambda k: _entries(k, F.lit(1), level))
        return F.struct(
            _merged(F.concat(acc["cells"], F.flatten(F.concat(plus, minus)))).alias("cells"),
            F.concat(acc["plus"], found["plus"]).alias("plus"), F.concat(acc["minus"], found["minus"]).alias("minus"),
            (F.size(found["plus"]) + F.size(found["minus"]) > 0).alias("more"),
        )

    def step(acc: Column, _: Column) -> Column:
        found = F.struct(bare(acc, 1).alias("plus"), bare(acc, -1).alias("minus"))
        return F.when(acc["more"] & (F.size(acc["cells"]) > 0), _let(found, lambda f: taken(acc, f))).otherwise(acc)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, step,
        lambda acc: F.when(F.size(acc["cells"]) == 0, F.struct(acc["plus"].alias("plus"), acc["minus"].alias("minus"))),
    )


def _minus(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.struct(c["i"].alias("i"), (-c["c"]).alias("c"), c["k"].alias("k"), c["h"].alias("h")))


def difference(one: Column, other: Column, cells: Column | None = None, other_cells: Column | None = None) -> Column:
    """The digests that two sets do not share, `struct<plus, minus, level>`: from the cells of their
    fingerprints, and where these do not come bare, from larger sketches, a level higher
    at each failure. Of the levels, those that the counts say are too small are left out."""
    cells = sketch(one, F.lit(0)) if cells is None else cells
    other_cells = sketch(other, F.lit(0)) if other_cells is None else other_cells

    def found(at: Column, level: Column) -> Column:
        named = lambda d: F.when(d.isNotNull(), F.struct(d["plus"].alias("plus"), d["minus"].alias("minus"), level.alias("level")))
        return _let(peeled(at, level), named)

    def about(apart: Column) -> Column:
        return F.aggregate(apart, F.lit(0.0), lambda acc, c: acc + c["c"] * c["c"]) / TABLES

    def larger(about: Column) -> Column:
        first = F.ceil(F.log(F.greatest(about, F.lit(1.0)) * ROOM / (TABLES * CELLS)) / F.log(F.lit(float(GROWTH)))).cast("int")
        levels = F.sequence(F.least(F.greatest(first, F.lit(1)), F.lit(LEVELS)), F.lit(LEVELS))
        none = F.lit(None).cast("struct<plus:array<bigint>,minus:array<bigint>,level:int>")
        return F.aggregate(levels, none, lambda acc, level: F.coalesce(acc, found(subtracted(one, other, level), level)))

    lost = F.raise_error(F.lit("the difference of two sketches is larger than the last level holds"))
    small = lambda apart: F.when(about(apart) <= FULL * TABLES * CELLS, found(apart, F.lit(0)))
    return _let(
        _merged(F.concat(cells, _minus(other_cells))),
        lambda apart: F.coalesce(small(apart), _let(about(apart), larger), lost),
    )


def likeness(one: Column, other: Column, cells: Column | None = None, other_cells: Column | None = None) -> Column:
    """1 for equal sets, 0 for sets that share nothing: 1 - |difference| / (|one| + |other|)."""
    both = (F.size(one) + F.size(other)).cast("double")
    apart = _let(difference(one, other, cells, other_cells), lambda d: F.size(d["plus"]) + F.size(d["minus"]))
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - apart / both)


def fingerprint(cells: Column) -> Column:
    """The cells of the first level as text, `number:count:digests:checks` in hexadecimal."""
    part = lambda c: F.concat_ws(":", F.hex(c["i"]), F.hex(c["c"]), F.hex(c["k"]), F.hex(c["h"]))
    return F.lower(F.array_join(F.transform(cells, part), "."))


def _block(doc_id: Column, firsts: list) -> Column:
    """The number of the last of the sorted first ids that is not above an id: binary search."""
    bounds = F.array(*[F.lit(f) for f in firsts])
    start = F.struct(F.lit(0).alias("low"), F.lit(len(firsts)).alias("high"))  # low is not above, high is

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        inside = acc["high"] - acc["low"] > 1
        below = F.get(bounds, middle) <= doc_id
        return F.struct(
            F.when(inside & below, middle).otherwise(acc["low"]).alias("low"),
            F.when(inside & ~below, middle).otherwise(acc["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.lit(max(1, len(firsts).bit_length() + 1)))
    found = F.aggregate(steps, start, step, lambda acc: acc["low"])
    return F.when(doc_id.isNull(), 0).otherwise(found)


def with_next(rows: DataFrame, *carried: str) -> DataFrame:
    """The rows with `next_<column>` of the next row by `doc_id`, then `text`; after the last
    comes the first. Rows are put together in blocks of neighbouring ids, of which only
    the first ids, bounded in number, are known to the driver; the first row of a
    block is also sent to the block before it."""
    ids = numbered(rows.select("doc_id"), F.col("doc_id"))
    total = ids.count()
    width = max(BLOCK_ROWS, -(-total // MOST_BLOCKS))
    firsts = sorted({r[0] for r in ids.where(F.col("row_number") % width == 0).select("doc_id").collect()} - {None})
    nulls = ids.where("doc_id IS NULL").limit(1).count()
    lowest = ids.where("doc_id IS NOT NULL").agg(F.min("doc_id")).first()[0]
    firsts = sorted({*firsts, *([] if lowest is None else [lowest])}) or [0]
    doc_id = F.col("doc_id")
    first = doc_id.isNull() if nulls else doc_id == F.lit(lowest)
    block = _block(doc_id, firsts)
    own = F.struct(F.col("_own").alias("block"), F.lit(False).alias("guest"))
    before = F.struct((F.col("_own") - 1).alias("block"), F.lit(True).alias("guest"))
    last = F.struct(F.lit(len(firsts) - 1).alias("block"), F.lit(True).alias("guest"))
    leads = doc_id.isin(firsts[1:]) if len(firsts) > 1 else F.lit(False)
    places = F.filter(F.array(own, F.when(leads, before), F.when(first, last)), lambda p: p.isNotNull())
    put = rows.withColumn("_own", block).withColumn("_put", F.explode(places)).select(*rows.columns, "_put.*")
    order = Window.partitionBy("block").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return put.select(
        *rows.columns, "guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried],
    ).where("NOT guest").drop("guest")


def fingerprints(documents: DataFrame) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`,
    one row per row of `documents` (`doc_id`, `text`, others ignored).

    The edited text has its last half (rounded down, in code points) replaced by the
    first as many code points of the next document, or all of them. A null text
    counts as empty; empty texts have an empty fingerprint, and are alike. Null ids
    come first; rows of one id follow each other by text. The next of a single row is
    itself. An empty table gives an empty result."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), digests(text).alias("keys"))
    n_chars = F.length("text")
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - half), F.substring(F.col("next_text"), F.lit(1), half))
    pairs = with_next(rows, "text", "keys").withColumn("edited", edited)
    pairs = pairs.select(
        "doc_id", n_chars.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "keys", digests(F.col("edited")).alias("edited_keys"), "next_keys",
    )
    for name in ("keys", "edited_keys", "next_keys"):
        pairs = pairs.withColumn(name.replace("keys", "cells"), sketch(F.col(name), F.lit(0)))
    near = lambda name: likeness(F.col("keys"), F.col(f"{name}_keys"), F.col("cells"), F.col(f"{name}_cells"))
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("cells")).alias("fingerprint"),
        fingerprint(F.col("edited_cells")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"), near("next").alias("near_next"),
    )
