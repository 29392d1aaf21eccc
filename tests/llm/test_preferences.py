"""Preference pairs against SQL, direct computation and a token round trip."""

import public_tokenizers
import pytest

from corpusloom.llm import preferences, queries
from tests.llm.brute import connection, same_as_sql

U, A, S = "user", "assistant", "system"


def pairs_of(spark, pairs):
    rows = []
    for pair_id, (chosen, rejected) in pairs.items():
        for side, turns in (("chosen", chosen), ("rejected", rejected)):
            rows += [(pair_id, side, i, role, text, 0) for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string, number int").repartition(3)


PAIRS = {
    1: ([(S, "s"), (U, "q"), (A, "good")], [(S, "s"), (U, "q"), (A, "bad")]),
    2: ([(U, "q"), (A, "x"), (U, "r"), (A, "y<|end|>")], [(U, "q"), (A, "z")]),
    3: ([(U, "a"), (A, "same")], [(U, "a"), (A, "same")]),
    4: ([(U, "a"), (A, "longer"), (U, "é👍"), (A, "more")], [(U, "a"), (A, "longer")]),
    5: ([(A, "alone")], []),
    6: ([], [(A, "alone")]),
    7: ([(U, None), (None, "x"), (A, "")], [(U, None), (None, "x"), (A, None)]),
    8: ([(U, "x" * 50_000), (A, "y")], [(U, "x" * 50_000), (A, "z " * 50_000)]),
    None: ([(U, "n"), (A, "1")], [(U, "n"), (A, "2")]),
    9: ([(U, "ab"), (A, "c")], [(U + "a", "b"), (A, "c")]),
}


def plain(chosen, rejected):
    chosen, rejected = [[(r or "", t or "") for r, t in side] for side in (chosen, rejected)]
    common = 0
    while common < min(len(chosen), len(rejected)) and chosen[common] == rejected[common]:
        common += 1
    render = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    out = [common, render(chosen[:common]), render(chosen[common:]), render(rejected[common:])]
    for side in (chosen[common:], rejected[common:]):
        at, spans = 0, []
        for role, text in side:
            head = len(f"<|{role}|>\n")
            if role == A:
                spans.append(f"{at + head}-{at + head + len(text) + len('<|end|>')}")
            at += head + len(text) + len("<|end|>\n")
        out.append(",".join(spans))
    return tuple(out)


def test_pairs_and_edges(spark):
    turns = pairs_of(spark, PAIRS)
    found = preferences.formatted(turns).collect()
    assert {r.pair_id: tuple(r)[1:] for r in found} == {k: plain(*v) for k, v in PAIRS.items()}
    assert len(found) == len(PAIRS)
    assert preferences.formatted(turns.limit(0)).collect() == []
    twice = preferences.formatted(turns.where("pair_id = 1").unionByName(turns.where("pair_id = 1 AND turn = 2 AND side = 'chosen'"))).first()
    assert twice.prompt_turns == 2 and twice.chosen.count("good") == 2 and twice.rejected.count("bad") == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_tokens(spark, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tool = Tokenizer.from_file(path)
    pairs = preferences.formatted(pairs_of(spark, PAIRS))
    texts = {r.pair_id: r for r in pairs.collect()}
    for r in preferences.tokenized(pairs, path).collect():
        text = texts[r.pair_id]
        assert tool.decode(r.prompt_ids, skip_special_tokens=False) == text.prompt
        for side in ("chosen", "rejected"):
            ids, labels, whole = r[f"{side}_ids"], r[f"{side}_labels"], text[side]
            assert tool.decode(ids, skip_special_tokens=False) == whole and len(ids) == len(labels)
            assert all(x in (i, preferences.MASKED) for i, x in zip(ids, labels))
            spans = [s.split("-") for s in text[f"{side}_spans"].split(",") if s]
            assert tool.decode([x for x in labels if x >= 0], skip_special_tokens=False) == "".join(whole[int(a):int(b)] for a, b in spans)


def test_query(spark, sf_dir):
    same_as_sql(queries.op2_preferences(spark, sf_dir), connection(sf_dir), queries.SQL["op2_preferences"])
