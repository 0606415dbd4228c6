"""Stems, models, levels and statement comparison."""

import pytest
from pyspark.sql import functions as F

from paperlode.functions import kinetics as K
from paperlode.functions import text as T
from paperlode.functions.models import model_column, pair_reranker
from paperlode.functions.stemming import stem, stem_word

# Word pairs that illustrate the rules in Porter (1980), carried through all steps.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "communism": "commun", "activate": "activ", "homologous": "homolog", "effective": "effect",
    "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
    "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "by": "by", "x9s": "x9s",
}


@pytest.mark.parametrize(("word", "expected"), STEMS.items())
def test_stem_word(word, expected):
    assert stem_word(word) == expected


def test_stem_column(rows):
    df = rows([("motoring",), (None,)], "w string")
    assert [r[0] for r in df.select(stem(F.col("w"))).collect()] == ["motor", None]


def test_model_column_and_reranker(rows):
    df = rows([("red fox",), ("fox",)], "t string")

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    vectors = df.select(model_column(load, "array<float>")(F.col("t")).alias("v")).collect()
    assert [r.v for r in vectors] == [[7.0, 1.0], [3.0, 1.0]]

    def load_pairs():
        return lambda queries, texts: [float(q in t) for q, t in zip(queries, texts)]

    scores = df.select(pair_reranker(load_pairs, "red")(F.col("t")).alias("s")).collect()
    assert [r.s for r in scores] == [1.0, 0.0]


@pytest.mark.parametrize(
    ("measured", "half_life", "in_range"),
    [(25.0, 2.0, True), (2.4, 2.0, False), (None, 2.0, None), (25.0, 0.0, None)],
)
def test_level(rows, measured, half_life, in_range):
    df = rows([(1000.0, 0.5, 20.0, half_life, 4.0, measured)], "d double, v double, w double, h double, t double, m double")
    expected = K.expected_level(*[F.col(c) for c in "dvwht"])
    row = df.select(expected.alias("e"), K.level_ratio(F.col("m"), expected, 0.1, 10.0).alias("r")).first()
    assert row.r.in_range is in_range
    assert row.e is None if half_life == 0 else row.e == pytest.approx(25.0)


@pytest.mark.parametrize(
    ("text", "negated"),
    [("Not paid", True), ("it was paid", False), ("he did not say nothing", False), ("she didn't pay", True),
     ("paid, no", True), ("a notable knot", False), ("", False)],
)
def test_negation(rows, text, negated):
    df = rows([(text,)], "t string")
    assert df.select(T.is_negated(F.col("t"))).first()[0] is negated
    assert df.select(T.polarity_differs(F.col("t"), F.lit("it was paid"))).first()[0] is negated


def test_sets_disagree(rows):
    df = rows([([1], [2]), ([1, 2], [2]), ([], [2]), (None, [2])], "a array<int>, b array<int>")
    got = [bool(r[0]) for r in df.select(T.sets_disagree(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, False, False]


def test_widest_difference(rows):
    df = rows([([["a", "b"], ["a", "c"], ["a", "b", "c", "d"]],), ([["a"]],), ([],)], "r array<array<string>>")
    assert [r[0] for r in df.select(T.widest_difference(F.col("r"))).collect()] == [0.75, 0.0, 0.0]
