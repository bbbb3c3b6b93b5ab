"""Text-query grammar: precedence, chains, dropped words (no data needed)."""

import pytest

from quire.operators.query import And, Chain, Follow, Not, Or, compile_query, parse_logical, truth_when_absent


def C(*words, offsets=None):
    offs = offsets or range(len(words))
    return Chain(tuple(zip(offs, words)))


@pytest.mark.parametrize(
    "text,tree",
    [
        ("a | b & c", Or((C("a"), And((C("b"), C("c")))))),
        ("a & b | c", Or((And((C("a"), C("b"))), C("c")))),
        ("a <1> b & c", And((C("a", "b"), C("c")))),
        ("a <-> b <2> c", C("a", "b", "c", offsets=[0, 1, 3])),
        ("!a <1> b", Follow(Not(C("a")), C("b"), 1)),
        ("!(a | b)", Not(Or((C("a"), C("b"))))),
        ("(a | b) <1> c", Follow(Or((C("a"), C("b"))), C("c"), 1)),
        ("Old-Man's", C("old-man's")),
        ("a & ... & b", And((C("a"), C("b")))),  # an operand without letters is dropped
    ],
)
def test_logical_trees(spark, text, tree):
    assert compile_query(spark, text, "logical").root == tree


def test_phrase_offsets_count_every_word(spark):
    assert compile_query(spark, "Old man, -- the SEA", "phrase").root == C("old", "man", "the", "sea")  # "--" holds no position
    assert compile_query(spark, "a b b", "phrase").root == C("a", "b", "b")


def test_truth_when_absent():
    assert truth_when_absent(Not(C("a")))
    assert not truth_when_absent(And((C("a"), Not(C("b")))))
    assert truth_when_absent(Or((C("a"), Not(C("b")))))


def test_parse_raw():
    assert parse_logical("") is None
    with pytest.raises(ValueError):
        parse_logical("a b")  # two operands need an operator


def test_non_words_hold_no_position(spark):
    assert compile_query(spark, "man -- the", "phrase").root == C("man", "the")
    assert compile_query(spark, "a <-> ... <-> b", "logical").root == C("a", "b")
    assert compile_query(spark, "x <-> the <-> y", "logical", "english").root == C("x", "y", offsets=[0, 2])
