"""Random corpora x random logical queries: Spark matching against a direct
evaluation of the contract (SURVEY §2.8) in Python."""

import pytest
from hypothesis import HealthCheck, assume, given, settings
from hypothesis import strategies as st

from quire.operators.query import And, Chain, Follow, Not, Or, compile_query
from quire.plans.index import TextIndex
from quire.plans.search import match

VOCAB = ["a", "b", "c", "d"]


def spans(node, lex):
    """Set of (s, e) of a positive node in one fragment (lex: 1-based list)."""
    n = len(lex)
    if isinstance(node, Chain):
        out = set()
        for a in range(1, n + 1):
            if all(1 <= a + o <= n and lex[a + o - 1] == t for o, t in node.terms):
                out.add((a, a + node.last))
        return out
    if isinstance(node, Or):
        return set().union(*(spans(p, lex) for p in node.parts))
    if isinstance(node, And):
        parts = [spans(p, lex) for p in node.parts]
        return set().union(*parts) if all(parts) else set()
    if isinstance(node, Follow):
        d = node.distance
        if isinstance(node.right, Not):
            neg = spans(node.right.part, lex)
            return {(s, e) for s, e in spans(node.left, lex) if not any(bs == e + d for bs, _ in neg)}
        if isinstance(node.left, Not):
            neg = spans(node.left.part, lex)
            return {(s, e) for s, e in spans(node.right, lex) if not any(ae == s - d for _, ae in neg)}
        right = spans(node.right, lex)
        return {(s, be) for s, e in spans(node.left, lex) for bs, be in right if bs - e == d}
    raise TypeError(node)


def truth(node, lex):
    if isinstance(node, (Chain, Follow)):
        return bool(spans(node, lex))
    if isinstance(node, Not):
        return not truth(node.part, lex)
    if isinstance(node, And):
        return all(truth(p, lex) for p in node.parts)
    return any(truth(p, lex) for p in node.parts)


def query_text():
    word = st.sampled_from(VOCAB)
    return st.recursive(
        word,
        lambda inner: st.one_of(
            st.builds(lambda x: f"!{x}", inner),
            st.builds(lambda x, y: f"({x} & {y})", inner, inner),
            st.builds(lambda x, y: f"({x} | {y})", inner, inner),
            st.builds(lambda x, d, y: f"({x} <{d}> {y})", inner, st.integers(0, 2), inner),
        ),
        max_leaves=4,
    )


corpus = st.lists(st.lists(st.sampled_from(VOCAB + ["e"]), min_size=1, max_size=14), min_size=1, max_size=3)


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=corpus, size=st.integers(2, 6), text=query_text())
def test_matching_equals_contract(spark, texts, size, text):
    try:
        q = compile_query(spark, text, "logical")
    except ValueError:
        assume(False)
    files = spark.createDataFrame(
        [(i + 1, f"f{i}", "t", "a", " ".join(ws)) for i, ws in enumerate(texts)],
        "file_id long, filename string, title string, author string, content string",
    )
    index = TextIndex.build(files, size)
    frags = {(r.file_id, r.sequence_no): [x.lexeme for x in r.content_tsv] for r in index.fragments.collect()}
    want_frags = {k for k, lex in frags.items() if truth(q.root, lex)}
    want_spans = {
        (k, q.atom_id(a), s, e) for k in want_frags for a in q.positive for s, e in spans(a, frags[k])
    }
    got_spans_df, got_frags_df = match(index, q)
    got_frags = sorted((r.file_id, r.sequence_no) for r in got_frags_df.collect())
    assert got_frags == sorted(want_frags), text  # lists: each once
    pos_ids = {q.atom_id(a) for a in q.positive}
    got_spans = sorted(
        ((r.file_id, r.sequence_no), r.atom, r.s, r.e) for r in got_spans_df.collect() if r.atom in pos_ids
    )
    assert got_spans == sorted(want_spans), text


def holds(node, lex, s, e):
    """Whether the query's positive structure holds inside [s, e] (negations
    ignored; None when the node has no positive part)."""
    if isinstance(node, (Chain, Follow)):
        return any(s <= a and b <= e for a, b in spans(node, lex))
    if isinstance(node, Not):
        return None
    vals = [v for v in (holds(p, lex, s, e) for p in node.parts) if v is not None]
    if not vals:
        return None
    return all(vals) if isinstance(node, And) else any(vals)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=corpus, size=st.integers(3, 8), text=query_text())
def test_covers_equal_definition(spark, texts, size, text):
    from quire.operators.match import covers

    try:
        q = compile_query(spark, text, "logical")
    except ValueError:
        assume(False)
    files = spark.createDataFrame(
        [(i + 1, f"f{i}", "t", "a", " ".join(ws)) for i, ws in enumerate(texts)],
        "file_id long, filename string, title string, author string, content string",
    )
    index = TextIndex.build(files, size)
    frags = {(r.file_id, r.sequence_no): [x.lexeme for x in r.content_tsv] for r in index.fragments.collect()}
    want = set()
    for k, lex in frags.items():
        if not truth(q.root, lex):
            continue
        ends = {(a, b) for atom in q.positive for a, b in spans(atom, lex)}
        for s in {a for a, _ in ends}:
            for e in {b for _, b in ends}:
                if s <= e and holds(q.root, lex, s, e) and not holds(q.root, lex, s + 1, e) \
                        and not holds(q.root, lex, s, e - 1):
                    want.add((k, s, e))
    spans_df, _ = match(index, q)
    got = sorted(((r.file_id, r.sequence_no), r.s, r.e) for r in covers(spans_df, q).collect())
    assert got == sorted(want), text
