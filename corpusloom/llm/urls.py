"""URL filters: domain rules first, then a path-template tree with labelled purity.

Per host, paths are a tree of segments. Level by level, to the end of each path,
segments that vary (numbers, long codes, or values of fewer than LEAST_PAGES pages)
become a wildcard, and so do branches that a chi-square test cannot tell from the rest
of their node, neither by what follows them nor by the labels of their pages. What
remains are templates; one whose labelled pages are bad too often, smoothed by the
share of bad pages at large, is rejected with all its pages, labelled or not.

Everything is counting by (host, template so far, segment), which Spark combines
before it shuffles, and a join of each page to the fate of its segment, which
adaptive execution splits where a host has many pages. A run of segments that all pages
of a node share is passed in one step, and a node of too few pages for any literal ends,
so there are as many steps as a path has levels at which its pages part.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import written

#: (verdict, host, path): for the host and its subdomains, at paths that begin so.
Rule = tuple[str, str, str]

LEAST_PAGES = 3           # of a literal segment
LABEL_LIMIT = 3.84        # chi-square at 5 %, one degree of freedom
SHAPE_LIMIT = 7.81        # three degrees
SMOOTHING = 4.0           # pages at the common share of bad ones, added to each template
REJECT = 0.5              # smoothed share of bad pages
VARIABLE = r"^([0-9].*|[0-9a-fA-F-]{8,}|.{41,})$"
SHAPES = ("leaf", "varies", "page", "other")

_KEPT = ["page_id", "url", "host", "path", "bad"]

#: Chi-square of a branch against the rest of its node; the columns are counts. These
#: expressions are plain SQL, for Spark and for the tests alike.
LABEL_TEST = """
CASE WHEN bad + good = 0 OR all_bad + all_good = bad + good OR all_bad = 0 OR all_good = 0 THEN 0.0 ELSE
  power(bad * 1.0 / (bad + good) - (all_bad - bad) * 1.0 / (all_bad + all_good - bad - good), 2)
  / ((all_bad * 1.0 / (all_bad + all_good)) * (all_good * 1.0 / (all_bad + all_good))
     * (1.0 / (bad + good) + 1.0 / (all_bad + all_good - bad - good))) END"""
SHAPE_TEST = " + ".join(
    f"CASE WHEN all_{s} = 0 THEN 0.0 ELSE power({s} - pages * (all_{s} * 1.0 / all_pages), 2)"
    f" / (all_{s} * (pages * 1.0 / all_pages) * (1.0 - pages * 1.0 / all_pages)) END" for s in SHAPES
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), upper, lower), F.regexp_extract(text, parts, 2)


def _matched(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule of a row with `host` and `path`, and its verdict. The rules
    are a fixed list of the caller's, and become one expression."""
    none = F.lit(None).cast("string")
    name, verdict = F.when(F.lit(False), none), F.when(F.lit(False), none)
    for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = name.when(fits, F.lit(host + path)), verdict.when(fits, F.lit(kind))
    return name, verdict


def _segments() -> Column:
    return F.filter(F.split("path", "/"), lambda s: s != "")


def _shape(segment: Column) -> Column:
    return (
        F.when(segment.isNull(), "leaf").when(segment.rlike(VARIABLE), "varies")
        .when(segment.contains("."), "page").otherwise("other")
    )


def _wild(segment: Column) -> Column:
    return segment.rlike(VARIABLE) | segment.isin("*", "**")


def _fates(counts: DataFrame) -> DataFrame:
    """The branches of the nodes with `as`, what stands for them in the template."""
    node = ["host", "template"]
    totals = counts.groupBy(*node).agg(*[F.sum(c).alias(f"all_{c}") for c in ("pages", "bad", "good", *SHAPES)])
    varies = _wild(F.col("segment")) | (F.col("pages") < LEAST_PAGES)
    alone = F.col("pages") == F.col("all_pages")
    alike = (F.expr(LABEL_TEST) < LABEL_LIMIT) & F.when(alone, False).otherwise(F.expr(SHAPE_TEST) < SHAPE_LIMIT)
    return counts.join(totals, node).select(*node, "segment", F.when(varies | alike, "*").otherwise(F.col("segment")).alias("as"))


def _counts(following: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("bad") == 1).alias("bad"), F.count_if(F.col("bad") == 0).alias("good"),
        *[F.count_if(following == s).alias(s) for s in SHAPES],
    ]


def _shared(rows: DataFrame) -> DataFrame:
    """The rows with the template longer by the segments that all rows of its node share, the
    prefix of the least and the greatest rest of a path; by all segments, as wildcards, where the
    node has too few pages for a literal."""
    ahead = F.slice("segments", F.col("used") + 1, F.size("segments") - F.col("used"))
    nodes = rows.withColumn("ahead", ahead).groupBy("host", "template").agg(
        (F.count(F.lit(1)) < LEAST_PAGES).alias("few"), F.min("ahead").alias("low"), F.max("ahead").alias("high"),
    )
    equal = F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y))
    differ = F.array_position(equal, F.lit(False)).cast("int")
    nodes = nodes.select("host", "template", "few", F.when(differ > 0, differ - 1).otherwise(F.size("low")).alias("same"))
    met = rows.join(nodes, ["host", "template"])
    until = F.when(F.col("few"), F.size("segments")).otherwise(F.col("used") + F.col("same"))
    passed = F.slice("segments", F.col("used") + 1, until - F.col("used"))
    named = F.transform(passed, lambda s: F.concat(F.lit("/"), F.when(F.col("few") | _wild(s), "*").otherwise(s)))
    longer = F.concat("template", F.array_join(named, ""))
    return met.select(*_KEPT, "segments", until.alias("used"), longer.alias("template"))


def _level(rows: DataFrame) -> DataFrame:
    """The rows, all of longer paths, with the template one segment longer."""
    at = rows.withColumn("segment", F.get("segments", F.col("used")))
    counts = at.groupBy("host", "template", "segment").agg(*_counts(_shape(F.get("segments", F.col("used") + 1))))
    met = at.join(written(_fates(written(counts, "branches")), "segments"), ["host", "template", "segment"])
    return met.select(*_KEPT, "segments", (F.col("used") + 1).alias("used"), F.concat("template", F.lit("/"), "as").alias("template"))


def templates(pages: DataFrame) -> DataFrame:
    """`page_id, url, host, path, bad, template` of a table `page_id, url, bad`; bad is 1, 0
    or null where a page has no label."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "bad", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("segments", _segments()).withColumn("used", F.lit(0)).withColumn("template", F.lit(""))
    rows, over = written(rows, "level"), F.size("segments") <= F.col("used")
    names = [*_KEPT, "template"]
    done, active = rows.where(over).select(*names), rows.where(~over)
    for step in itertools.cycle((_shared, _level)):
        if active.isEmpty():
            break
        rows = written(step(active), "level")
        done, active = done.unionByName(rows.where(over).select(*names)), rows.where(~over)
    return done.withColumn("template", F.concat("host", "template"))


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """`page_id, host, path, rule, verdict, template, purity` of a table `page_id, url, bad`,
    one row per row.

    The verdict is the longest rule's, else block where the smoothed share of bad
    pages of the template reaches REJECT. A URL that is null or without `://` has an
    empty host and path, and the template of all such. Without any label nothing is
    rejected by template. Repeated rows count one by one. An empty table gives an
    empty result."""
    rows = written(templates(pages), "templates")
    labelled = rows.groupBy("template").agg(
        F.count_if(F.col("bad") == 1).alias("bads"), F.count_if(F.col("bad") == 0).alias("goods"),
    )
    labelled = written(labelled, "labelled")
    bads, goods = (x or 0 for x in labelled.agg(F.sum("bads"), F.sum("goods")).first())
    common = bads / max(1, bads + goods)
    purity = (F.col("bads") + SMOOTHING * common) / (F.col("bads") + F.col("goods") + SMOOTHING)
    share = labelled.select("template", purity.alias("purity"))
    rule, verdict = _matched(rules)
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return rows.join(share, "template").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template",
        F.round("purity", 6).alias("purity"),
    )
