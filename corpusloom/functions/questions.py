"""Question rules, snippet cleaning and short texts, as column expressions.

Cut lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import JS_WS, PY_WS, collapse, strip

# --- fixed values -----------------------------------------------------------
INTENT_WORDS = r"intern(ship)?|experience|work|job|co-?op|placement"
GREETINGS = (
    r"hi|hey|hello|yo|sup|howdy|thanks|thank you|bye|"
    rf"good[{JS_WS}]*(morning|evening|night)"
)
SHORTEST_QUESTION = 4
SNIPPET_CHARS = 600
PREVIEW_CHARS = 220
CLIP_CHARS = 750
CACHE_KEY_PREFIX = "q:"
# ----------------------------------------------------------------------------

# `\b` of Java looks at Unicode letters; the rules mean ASCII words.
_WORD = "A-Za-z0-9_"


def first_question(q: Column, query: Column) -> Column:
    """First non-empty of the two fields, trimmed; empty when there is none."""
    return strip(F.coalesce(F.nullif(q, F.lit("")), F.nullif(query, F.lit("")), F.lit("")), JS_WS)


def experience_intent(c: Column) -> Column:
    return c.rlike(f"(?i)(?<![{_WORD}])({INTENT_WORDS})(?![{_WORD}])")


def chit_chat(c: Column) -> Column:
    text = F.lower(strip(c, JS_WS))
    return text.rlike(f"^({GREETINGS})(?![{_WORD}])") | (F.length(text) < SHORTEST_QUESTION)


def normalize_question(c: Column) -> Column:
    return collapse(F.lower(strip(c, JS_WS)), JS_WS)


def cache_key(c: Column) -> Column:
    return F.concat(F.lit(CACHE_KEY_PREFIX), F.sha2(normalize_question(c), 256))


def clean_snippet(c: Column, max_chars: int = SNIPPET_CHARS) -> Column:
    text = collapse(F.coalesce(c, F.lit("")), JS_WS)
    links = F.regexp_replace(
        text, f"https?[{JS_WS}]*:[{JS_WS}]*/[{JS_WS}]*/[{JS_WS}]*", "https://"
    )
    return F.substring(links, 1, max_chars)


def preview(c: Column) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, PREVIEW_CHARS)


def prompt_clip(c: Column) -> Column:
    text = F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    return F.substring(strip(text, PY_WS), 1, CLIP_CHARS)
