"""Text rules of document preparation, as column expressions.

`normalize` is the form the jobs use: it gives the same text as applying the
single rules in order (a property test compares the two) in fewer and linear
passes over each text.
"""

from __future__ import annotations

from unicodedata import normalize as normalize_form

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Whitespace as Python's str methods and `\s` see it.
PY_SPACES = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Whitespace as ECMAScript's trim and `\s` see it.
JS_SPACES = (
    "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
BULLETS = "\u2022\u25cf\u25aa\u25e6\u2023"  # • ● ▪ ◦ ‣
SOFT_HYPHEN = "\u00AD"
SENTENCE_END = ".!?"
SENTENCE_START = r"A-Z(\"'"
PUNCTUATION = ",.;:!?"
DOC_TYPES = [
    ("resume", ("resume", "cv")),
    ("projects", ("project", "portfolio")),
    ("bio", ("bio", "about")),
    ("faq", ("faq", "qna")),
]
# ----------------------------------------------------------------------------


def char_class(chars: str) -> str:
    """Regex class of these characters, for use in brackets. Single Latin-1
    characters become one table look-up; the others stand behind a range test,
    which ordinary letters fail at once."""
    low = "".join(f"\\x{ord(c):02X}" for c in chars if ord(c) < 256)
    high = sorted(c for c in chars if ord(c) >= 256)
    if not high:
        return low
    inner = "".join(f"\\u{ord(c):04X}" for c in high)
    return f"{low}[\\u{ord(high[0]):04X}-\\u{ord(high[-1]):04X}&&[{inner}]]"


PY_WS = char_class(PY_SPACES)
JS_WS = char_class(JS_SPACES)
_SPACES = {PY_WS: PY_SPACES, JS_WS: JS_SPACES}

# A text without these characters is already in form NFKC: every other one is
# unchanged by it and combines with no neighbour (checked by a test).
NFKC_CHECK = (
    r"\x{A0}-\x{10FFFF}&&[^\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u0131"
    r"\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0400-\u0482"
    r"\u2012-\u2016\u2018-\u2023\u20AC\u4E00-\u9FFF]"
)


def strip(c: Column, ws: str = PY_WS) -> Column:
    return F.btrim(c, F.lit(_SPACES[ws]))


def collapse(c: Column, ws: str = PY_WS) -> Column:
    """Every whitespace run becomes one space. A single space is left in place."""
    other = char_class(_SPACES[ws].replace(" ", ""))
    return F.regexp_replace(c, f" [{ws}]+|[{other}][{ws}]*", " ")


def tidy_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


@F.arrow_udf(T.StringType())
def nfkc_arrow(texts: pa.Array) -> pa.Array:
    # Not Arrow's own kernel: it leaves composed letters decomposed.
    changed = [None if t is None else normalize_form("NFKC", t) for t in texts.to_pylist()]
    return pa.array(changed, pa.string())


def may_change_by_nfkc(c: Column) -> Column:
    return c.rlike(f"[{NFKC_CHECK}]")


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Only a text that can change is handed to Python; for the
    others the worker gets a null. Meant for a stored column: `c` is named thrice."""
    return F.coalesce(nfkc_arrow(F.when(may_change_by_nfkc(c), c)), c)


def join_hyphens(c: Column) -> Column:
    """Drop soft hyphens and close up a word broken after a hyphen."""
    return F.regexp_replace(
        F.replace(c, F.lit(SOFT_HYPHEN), F.lit("")), f"-[{PY_WS}]*\n[{PY_WS}]*", "-"
    )


def bullets(c: Column) -> Column:
    return F.regexp_replace(c, f"[{char_class(BULLETS)}]", "- ")


def clean_blanks(c: Column) -> Column:
    no_cr = F.replace(c, F.lit("\r"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(no_cr, "[ \t]+", " "), "\n{3,}", "\n\n")


def split_glued(c: Column) -> Column:
    """A space at lower|Upper, letter|digit and digit|letter. A cut neither makes
    nor removes another one. Each pattern starts at the rarer character."""
    before = F.regexp_replace(c, "[A-Z0-9](?<=[a-z][A-Z]|[A-Za-z][0-9])", " $0")
    return F.regexp_replace(before, "[0-9](?=[A-Za-z])", "$0 ")


def _open_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, f"[{PUNCTUATION}](?=[A-Za-z])", "$0 ")


def space_punctuation(c: Column) -> Column:
    return _open_punctuation(F.regexp_replace(c, f"[{PY_WS}]+([{PUNCTUATION}])", "$1"))


def collapse_all(c: Column) -> Column:
    return strip(collapse(c))


def normalize_nfkc(c: Column) -> Column:
    """All text rules after NFKC. Collapsing comes before the punctuation rules,
    which then see single spaces, so long blank runs cost one pass."""
    t = bullets(join_hyphens(c))
    t = collapse(split_glued(F.replace(t, F.lit("\r"), F.lit(""))))
    return F.trim(_open_punctuation(F.regexp_replace(t, f" ([{PUNCTUATION}])", "$1")))


def normalize(c: Column) -> Column:
    return normalize_nfkc(nfkc(c))


def sentences(c: Column) -> Column:
    """Sentences of a text, line by line: `array<string>`, no empty items."""
    boundary = f"(?<=[{SENTENCE_END}])[{PY_WS}]+(?=[{SENTENCE_START}])"
    lines = F.transform(F.split(c, "\n"), lambda line: F.split(strip(line), boundary))
    return F.filter(F.flatten(lines), lambda s: s != "")


def line_sentences(c: Column) -> Column:
    """The same for a normalised text: one line, single spaces."""
    boundary = f" (?<=[{SENTENCE_END}] )(?=[{SENTENCE_START}])"
    return F.filter(F.split(c, boundary), lambda s: s != "")


def token_estimate(c: Column) -> Column:
    """About four characters per token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def basename(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def extension(key: Column) -> Column:
    """Lower-case extension with its dot; empty when the name has none. Leading
    dots belong to the name."""
    return F.lower(F.regexp_extract(basename(key), r"^\.*[^.].*?(\.[^.]*)$", 1))


def stem(key: Column) -> Column:
    name = basename(key)
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension(key)))


def chunk_id(key: Column, index: Column) -> Column:
    digest = F.sha2(F.concat(key, F.lit("::"), index.cast("string")), 256)
    return F.concat(F.substring(digest, 1, 16), F.lit("-"), F.format_string("%04d", index))


def doc_type(key: Column) -> Column:
    """First type one of whose words occurs anywhere in the key."""
    name = F.lower(key)
    cases = F
    for label, words in DOC_TYPES:
        found = name.contains(words[0])
        for word in words[1:]:
            found = found | name.contains(word)
        cases = cases.when(found, F.lit(label))
    return cases.otherwise(F.lit("doc"))


def title_case(c: Column) -> Column:
    """Each run of cased letters gets one capital, whatever stands before it."""
    runs = F.regexp_extract_all(
        c,
        F.lit(r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]+|[^\p{IsUppercase}\p{IsLowercase}\p{Lt}]+"),
        F.lit(0),
    )
    capital = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))
    )
    return F.array_join(capital, "")


def title_from_key(key: Column) -> Column:
    """Title of the file name. It is empty only when the name is, so the name
    itself is never needed in its place."""
    return title_case(F.replace(stem(key), F.lit("-"), F.lit(" ")))


def url_from_base(base_url: str, key: Column) -> Column:
    if not base_url:
        return F.lit(None).cast("string")
    return F.concat(F.lit(base_url), F.lit("/"), basename(key))
