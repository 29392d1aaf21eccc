import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusloom.functions import questions as Q
from corpusloom.functions import text as T


@pytest.mark.parametrize("rule, given_text, expected", [
    (T.normalize, "ﬁne", "fine"),
    (T.normalize, "co­operate", "cooperate"),
    (T.normalize, "well-\n known", "well-known"),
    (T.normalize, "•one", "- one"),
    (T.normalize, "fooBar", "foo Bar"),
    (T.normalize, "e5small", "e 5 small"),
    (T.normalize, "a , b.c", "a, b. c"),
    (T.normalize, "a\x1cb c　d", "a b c d"),
    (T.normalize, "a\rb", "ab"),
    (T.normalize, "", ""),
    (T.normalize, None, None),
    (T.title_from_key, "raw/my-first-e5x.md", "My First E5X"),
    (T.title_from_key, "raw/don't-stop.tar.gz", "Don'T Stop.Tar"),
    (T.title_from_key, "raw/.md", ".Md"),
    (T.extension, "a/b.MD", ".md"),
    (T.extension, "a/.md", ""),
    (T.extension, "a.b/c", ""),
    (T.stem, "x/a..b", "a."),
    (T.doc_type, "raw/MyCVs.txt", "resume"),
    (T.doc_type, "raw/portfolio-faq.md", "projects"),
    (T.doc_type, "raw/qna", "faq"),
    (T.doc_type, "x", "doc"),
    (T.token_estimate, "abc", 1),
    (T.token_estimate, "123456789", 2),
    (Q.experience_intent, "any co-op?", True),
    (Q.experience_intent, "coop", True),
    (Q.experience_intent, "homework", False),
    (Q.experience_intent, "éwork", True),
    (Q.chit_chat, "Hi there", True),
    (Q.chit_chat, "history", False),
    (Q.chit_chat, "ok", True),
    (Q.chit_chat, "Good  morning", True),
    (Q.clean_snippet, "see  http : / / x.org", "see https://x.org"),
    (Q.clean_snippet, "\U0001f600" * 700, "\U0001f600" * 600),
    (Q.clean_snippet, None, ""),
    (Q.normalize_question, "  What\tIS  it ", "what is it"),
    (Q.normalize_question, "﻿a\u0085b", "a\u0085b"),
    (Q.prompt_clip, "\na\nb ", "a b"),
    (Q.prompt_clip, None, ""),
])
def test_rule(evaluate, rule, given_text, expected):
    assert evaluate(rule, [given_text]) == [expected]


def test_sentences(evaluate):
    texts = ['One two. Three! (Four) done? yes. "Q"', " One.  \n\n Two! three  \n", "", " \n "]
    assert evaluate(T.sentences, texts) == [
        ["One two.", "Three!", "(Four) done? yes.", '"Q"'], ["One.", "Two! three"], [], [],
    ]


def test_chunk_id(evaluate):
    from pyspark.sql import functions as F

    assert evaluate(lambda c: T.chunk_id(c, F.lit(0)), ["raw/a.md"]) == ["1759c3b4efb06249-0000"]
    assert evaluate(lambda c: T.chunk_id(c, F.lit(12345)), ["raw/a.md"])[0].endswith("-12345")


def test_unchecked_characters_are_stable():
    """No text of characters outside the check changes under NFKC."""
    import re

    skip = [(0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB),
            (0xBF, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x400, 0x482),
            (0x2012, 0x2016), (0x2018, 0x2023), (0x20AC, 0x20AC), (0x4E00, 0x9FFF)]
    written = re.findall(r"\\[xu]([0-9A-F]{2,4})(?:-\\[xu]([0-9A-F]{2,4}))?", T.NFKC_CHECK.split("[^")[1])
    points = lambda ranges: {c for a, b in ranges for c in range(a, b + 1)}
    assert points((int(a, 16), int(b or a, 16)) for a, b in written) == points(skip)
    chars = [chr(c) for c in range(0xA0)] + [chr(c) for c in sorted(points(skip))]
    every = "".join(chars)
    assert all(unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) for c in chars)
    assert unicodedata.is_normalized("NFKC", every) and unicodedata.is_normalized("NFKC", every[::-1])


PIECES = st.sampled_from(list("aZ5é.,!-•­ﬁ\r\n\t \x1c (") + ["\n\n\n", "- \n", " .", "aB1"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=40).map("".join), min_size=50, max_size=50))
def test_fused_rules_equal_single_rules(evaluate, texts):
    def one_by_one(c):
        c = T.bullets(T.join_hyphens(T.nfkc(T.tidy_whitespace(c))))
        return T.collapse_all(T.space_punctuation(T.split_glued(T.clean_blanks(c))))

    fused = evaluate(T.normalize, texts)
    assert fused == evaluate(one_by_one, texts)
    assert evaluate(T.line_sentences, fused) == evaluate(T.sentences, fused)


def test_markdown_inline_marks(evaluate):
    from corpusloom.operators.extract import markdown_text

    cases = {
        r"\*no\* \_x\_": "*no* _x_",
        r"a \\*b*": "a \\\nb\n",
        "Title\n=====\ntext": "Title\ntext",
        "Title\n--\n\ntext": "Title\n\ntext",
        "one\ntwo\n---": "one\ntwo\n",
        "a &amp; b &#233; &lt;i&gt;": "a & b é <i>",
        "x <b>bold</b> y<br/>z": "x \nbold\n y\nz",
        "`a\\*b* <i> &amp;`": "\na\\*b* <i> &amp;\n",
        "**a `b*` c**": "\na \nb*\n c\n",
        "**a *b* c** **[d](e)**": "\na \nb\n c\n \n\nd\n\n",
        "<https://e.org/a_b> <!-- *c* --> d": "\nhttps://e.org/a_b\n \n d",
        "2 < 3 & 4 > 1": "2 < 3 & 4 > 1",
        r"\[no\](link) [yes](x)": "[no](link) \nyes\n",
        r"\`no code\`": "`no code`",
        "": "",
        None: None,
    }
    assert evaluate(markdown_text, list(cases)) == list(cases.values())


def test_long_markdown_takes_linear_time(evaluate):
    from time import monotonic

    from corpusloom.operators.extract import markdown_text

    began = monotonic()
    texts = [mark * 100_000 for mark in ("*", "*a ", "[", "[a](", "`", "<a ", "<!-- ", "\\", "&", "\n\nx", ">", "- ", " ", "x", "_a", "#")]
    assert len(evaluate(markdown_text, texts)) == len(texts)
    assert monotonic() - began < 60


def test_code_in_a_text_is_found_once(evaluate):
    """Very many spans: the list of them is made once for the text."""
    from corpusloom.operators.extract import markdown_text

    found = evaluate(markdown_text, ["`*a*` \\*b " * 30_000, "`a` b", "", None])
    assert found[0].split() == ["*a*", "*b"] * 30_000 and found[1:] == ["\na\n b", "", None]


def test_plain_texts_are_not_taken_for_markdown(spark):
    """The rules see the texts of Markdown documents only, also before Python's step."""
    from corpusloom.operators.extract import with_text

    rows = spark.range(2).selectExpr("concat('a', id, '.txt') as key", "concat('**b** &amp; ', id) as text")
    plan = with_text(rows)._jdf.queryExecution().optimizedPlan().toString()
    given_to_python = plan[plan.index("ArrowEvalPython"):]
    given_to_python = given_to_python[given_to_python.index("_unescaped("):given_to_python.index("pythonUDF")]
    assert ".markdown" in given_to_python
    assert {r.text for r in with_text(rows).collect()} == {"**b** &amp; 0", "**b** &amp; 1"}
