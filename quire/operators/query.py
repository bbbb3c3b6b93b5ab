"""Text queries: phrase and logical modes compiled to a small tree of match nodes.

Logical syntax: ``|`` OR, ``&`` AND, ``!`` NOT, ``<n>`` exact word distance
(``<->`` is ``<1>``), parentheses; precedence ``!`` > ``<n>`` > ``&`` > ``|``.
Phrase mode takes the words of the text at their distances in the text.

Words are split on the same six blanks as the text, and normalised by Python
twins of the index's Column expressions (a test compares both on a corpus).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import regex
from pyspark.sql import SparkSession

MODES = ("phrase", "logical")


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Chain:
    """Lexemes at fixed offsets from an anchor (a word, or a phrase)."""

    terms: tuple[tuple[int, str], ...]

    @property
    def last(self) -> int:
        return max(o for o, _ in self.terms)


@dataclass(frozen=True)
class Follow:
    """``left <distance> right``: right starts ``distance`` after left ends."""

    left: object
    right: object
    distance: int


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


# Fixed value: the blanks that part words, the same for texts (Java's \s) and queries.
BLANKS = r" \t\n\x0B\f\r"
_LEX = re.compile(rf"[{BLANKS}]+|(?P<op>[()&|!])|(?P<dist><(?:-|\d+)>)|(?P<word>[^{BLANKS}&|!()<>]+)|(?P<bad>.)", re.S)


def _tokenize(text: str) -> list[tuple[str, str]]:
    out = []
    for m in _LEX.finditer(text):
        if m.group("op"):
            out.append(("op", m.group("op")))
        elif m.group("dist"):
            d = m.group("dist")[1:-1]
            out.append(("dist", "1" if d == "-" else d))
        elif m.group("word"):
            if m.group("word").endswith(":*"):  # would silently mean the whole word
                raise ValueError(f"prefix terms are not supported: {m.group('word')!r} in {text!r}")
            out.append(("word", m.group("word")))
        elif m.group("bad"):
            raise ValueError(f"syntax error in text query at {m.group('bad')!r}: {text!r}")
    return out


class _Parser:
    def __init__(self, text: str):
        self.text = text
        self.toks = _tokenize(text)
        self.i = 0

    def peek(self):
        return self.toks[self.i] if self.i < len(self.toks) else (None, None)

    def take(self):
        t = self.peek()
        self.i += 1
        return t

    def fail(self, what: str):
        raise ValueError(f"syntax error in text query ({what}): {self.text!r}")

    def parse(self):
        if not self.toks:
            return None
        node = self.or_expr()
        if self.i != len(self.toks):
            self.fail("unexpected " + repr(self.peek()[1]))
        return node

    def or_expr(self):
        parts = [self.and_expr()]
        while self.peek() == ("op", "|"):
            self.take()
            parts.append(self.and_expr())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def and_expr(self):
        parts = [self.follow_expr()]
        while self.peek() == ("op", "&"):
            self.take()
            parts.append(self.follow_expr())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def follow_expr(self):
        node = self.not_expr()
        while self.peek()[0] == "dist":
            n = int(self.take()[1])
            node = Follow(node, self.not_expr(), n)
        return node

    def not_expr(self):
        if self.peek() == ("op", "!"):
            self.take()
            return Not(self.not_expr())
        return self.atom()

    def atom(self):
        kind, val = self.take()
        if kind == "word":
            return Word(val)
        if (kind, val) == ("op", "("):
            node = self.or_expr()
            if self.take() != ("op", ")"):
                self.fail("missing )")
            return node
        self.fail("operand expected" if kind else "unexpected end")


def parse_logical(text: str):
    """Parse a logical query into a tree of Word/And/Or/Not/Follow; None if blank."""
    return _Parser(text).parse()


_PHRASE_TOKEN = re.compile(rf"[^{BLANKS}]+")


def normalise_words(spark: SparkSession, words: list[str], config: str) -> dict[str, str | None]:
    """Lexeme of each query word; None without a letter or digit, and for stop words."""
    from quire.operators.analyze import check_config, stemming

    simple = {w: simple_lexeme_py(w) for w in set(words)}
    if check_config(config) == "simple":
        return simple
    stops, _, stem = stemming(config)
    return {w: None if x is None or x in stops else stem(x) for w, x in simple.items()}


# The word / edge patterns of quire.functions.text, for the regex module.
_WORD_PY = regex.compile(r"[\p{L}\p{N}]")
_EDGE_PY = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def simple_lexeme_py(word: str) -> str | None:
    """Python twin of the ``simple`` lexeme Column (lower, strip edge punctuation)."""
    if not _WORD_PY.search(word):
        return None
    return _EDGE_PY.sub("", word.lower()) or None


# A dropped word (stop word) still takes its position; an operand without any
# letter or digit never has one (content positions count words only).
_DROP = "drop"
_VOID = "void"


def _simplify(node, lex):
    """Returns (node | _DROP | _VOID, left_pad, right_pad)."""
    if isinstance(node, Word):
        if not _WORD_PY.search(node.text):
            return _VOID, 0, 0
        x = lex.get(node.text)
        return (Chain(((0, x),)) if x else _DROP), 0, 0
    if isinstance(node, Not):
        inner, _, _ = _simplify(node.part, lex)
        return (inner if inner in (_DROP, _VOID) else Not(inner)), 0, 0
    if isinstance(node, (And, Or)):
        kept = [p for p in (_simplify(q, lex)[0] for q in node.parts) if p not in (_DROP, _VOID)]
        if not kept:
            return _DROP, 0, 0
        if len(kept) == 1:
            return kept[0], 0, 0
        return type(node)(tuple(kept)), 0, 0
    if isinstance(node, Follow):
        a, al, ar = _simplify(node.left, lex)
        b, bl, br = _simplify(node.right, lex)
        if a is _VOID:
            return b, bl, br
        if b is _VOID:
            return a, al, ar
        if a is _DROP and b is _DROP:
            return _DROP, 0, 0
        if a is _DROP:
            return b, bl + node.distance, br
        if b is _DROP:
            return a, al, ar + node.distance
        n = ar + node.distance + bl
        if isinstance(a, Chain) and isinstance(b, Chain):
            shift = a.last + n
            return Chain(tuple(sorted(a.terms + tuple((o + shift, t) for o, t in b.terms)))), al, br
        return Follow(a, b, n), al, br
    raise TypeError(node)


def _chain_from_phrase(words: list[str], lex) -> Chain | None:
    terms = [(i, lex.get(w)) for i, w in enumerate(words)]
    kept = [(i, x) for i, x in terms if x]
    if not kept:
        return None
    base = kept[0][0]
    return Chain(tuple((i - base, x) for i, x in kept))


@dataclass
class Query:
    """A compiled text query."""

    text: str
    mode: str
    config: str
    root: object | None
    chains: list = field(default_factory=list)  # distinct Chain nodes, index = chain id
    atoms: list = field(default_factory=list)  # boolean-level atoms (Chain or Follow)
    positive: list = field(default_factory=list)  # atoms that occur outside any negation

    @property
    def lexemes(self) -> list[str]:
        return sorted({t for c in self.chains for _, t in c.terms})

    def chain_id(self, chain: Chain) -> int:
        return self.chains.index(chain)

    def atom_id(self, node) -> int:
        return self.atoms.index(node)

    @property
    def empty(self) -> bool:
        return self.root is None


def _collect(node, chains: list, atoms: list, top: bool):
    if isinstance(node, Chain):
        if node not in chains:
            chains.append(node)
        if top and node not in atoms:
            atoms.append(node)
    elif isinstance(node, Follow):
        if top and node not in atoms:
            atoms.append(node)
        _collect(node.left, chains, atoms, False)
        _collect(node.right, chains, atoms, False)
    elif isinstance(node, (And, Or)):
        for p in node.parts:
            _collect(p, chains, atoms, top)
    elif isinstance(node, Not):
        _collect(node.part, chains, atoms, top)


def compile_query(spark: SparkSession, text: str, mode: str, config: str = "simple") -> Query:
    """Compile ``text`` in ``mode`` ('phrase' | 'logical'); ValueError on bad input."""
    if mode not in MODES:
        raise ValueError(f"query mode must be one of {MODES}, not {mode!r}")
    if text is None:
        raise ValueError("query text is null")
    if mode == "phrase":
        # tokens without a letter or digit hold no position, as in the content
        words = [w for w in _PHRASE_TOKEN.findall(text) if _WORD_PY.search(w)]
        lex = normalise_words(spark, words, config)
        root = _chain_from_phrase(words, lex)
    else:
        tree = parse_logical(text)
        words = []

        def walk(n):
            if isinstance(n, Word):
                words.append(n.text)
            elif isinstance(n, (And, Or)):
                for p in n.parts:
                    walk(p)
            elif isinstance(n, Not):
                walk(n.part)
            elif isinstance(n, Follow):
                walk(n.left)
                walk(n.right)

        walk(tree)
        lex = normalise_words(spark, words, config)
        root = None if tree is None else _simplify(tree, lex)[0]
        if root in (_DROP, _VOID):
            root = None
    q = Query(text=text, mode=mode, config=config, root=root)
    if root is not None:
        _validate(root)
        _collect(root, q.chains, q.atoms, True)
        _positive(root, q.positive, False)
    return q


def _positive(node, out: list, negated: bool):
    if isinstance(node, (Chain, Follow)):
        if not negated and node not in out:
            out.append(node)
    elif isinstance(node, (And, Or)):
        for p in node.parts:
            _positive(p, out, negated)
    elif isinstance(node, Not):
        _positive(node.part, out, True)


def _validate(node, in_span: bool = False):
    """Reject shapes without a defined span meaning."""
    if isinstance(node, Follow):
        if isinstance(node.left, Not) and isinstance(node.right, Not):
            raise ValueError("both sides of a word-distance operator are negated")
        for side in (node.left, node.right):
            _validate(side.part if isinstance(side, Not) else side, True)
    elif isinstance(node, (And, Or)):
        for p in node.parts:
            if in_span and isinstance(p, Not):
                raise ValueError("a negation inside a word-distance operand must be its direct operand")
            _validate(p, in_span)
    elif isinstance(node, Not):
        _validate(node.part, in_span)


def truth_when_absent(node) -> bool:
    """Value of the boolean skeleton when no atom occurs in a fragment."""
    if isinstance(node, (Chain, Follow)):
        return False
    if isinstance(node, Not):
        return not truth_when_absent(node.part)
    if isinstance(node, And):
        return all(truth_when_absent(p) for p in node.parts)
    if isinstance(node, Or):
        return any(truth_when_absent(p) for p in node.parts)
    raise TypeError(node)


def pivot(node, counts: dict[str, int]) -> tuple[int, frozenset[str]] | None:
    """The cheapest set of lexemes of which every matching fragment holds one, and in
    how many fragments they stand (by ``counts``); None when a fragment without any of
    the query's words can match. A phrase needs its rarest word, AND its cheapest part,
    OR something of each part; a negated part needs nothing."""
    if isinstance(node, Chain):
        cost, word = min((counts.get(t, 0), t) for _, t in node.terms)
        return cost, frozenset([word])
    if isinstance(node, Not):
        return None
    parts = [pivot(p, counts) for p in ((node.left, node.right) if isinstance(node, Follow) else node.parts)]
    if isinstance(node, Or):
        if None in parts:
            return None
        return sum(c for c, _ in parts), frozenset().union(*[s for _, s in parts])
    known = [p for p in parts if p is not None]
    return min(known, key=lambda p: (p[0], sorted(p[1]))) if known else None
