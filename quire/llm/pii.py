"""Personal data by weak supervision, in DataFrame functions only.

1. One pass over each text marks the matches of a few linear patterns: the four base
   kinds, and looser ones (spelled-out mail addresses, numbers without country code,
   long mixed runs). What is kept of a text are its matches, the lengths between them
   and a few characters around each; places are running sums of lengths, in code points.
2. Base spans are the matches that pass their check (parts of an address, digits, Luhn).
   Every other match that overlaps no base span is a candidate.
3. Labelers vote on base spans and candidates: yes, no or nothing. Patterns: the strict
   format, its variety of characters. Gazetteers: top-level domains, card prefixes, dial
   codes, key prefixes. Context: words before it that speak for or against its kind, and
   whether it is glued to other text.
4. Votes are counted by pattern of votes (a bounded table, however many spans).
   Expectation-maximisation estimates, per kind and labeler, how often it votes each way
   on true and on false spans; base spans are known to be true, and a prior of ``PRIOR``
   imagined spans keeps labelers without evidence at an honest majority vote.
5. A logistic classifier is trained on the expected labels (Newton steps on sums over
   the pattern table; the driver sees those sums, some hundred numbers). Its features are
   the votes and marks of shape that no labeler uses. Candidates of 0.5 or more are spans.

Base spans always stay. Of accepted candidates that overlap, the one that starts first
(the longer one on ties) stays.

The patterns equal the plain leftmost non-overlapping ones but are linear on runs of any
length: a run is tried from its first character only (or from where the match before
ended), and repeats give nothing back.

Result, a row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans),
base_sha256, spans (``kind:start:end`` by kind - email, ip, card, phone, secret - and start).

Cases: null text: empty. Null or repeated doc_id: a row each. Empty text: no spans. Very
long texts: one pass; a text's spans are gathered in one row. Control character 1 in a
text counts as any other character outside the patterns. Empty table: empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import run_folder, written

KINDS = ["email", "ip", "card", "phone", "secret"]
EMAIL, IP, CARD, PHONE, SECRET = range(5)
BASE_KINDS = 4

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = [  # (kind, pattern, what a text must hold to be searched)
    (EMAIL, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "mail"),
    (IP, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digit"),
    (CARD, r"[0-9](?:[ -]?[0-9])++", "digit"),
    (PHONE, r"\+[0-9][ ().0-9-]+[0-9]", "plus"),
    # looser ones: candidates only
    (EMAIL, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[(\[{]at[)\]}] ?| at )[A-Za-z0-9-]{1,63}+(?:(?: ?[(\[{]dot[)\]}] ?| dot |\.)[A-Za-z0-9-]{1,63}+){1,8}+", "spelled"),
    (PHONE, r"(?<![0-9])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", "digit"),
    (SECRET, r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,200}[0-9])(?=[0-9+/_-]{0,200}[A-Za-z])[A-Za-z0-9+/_-]{20,}+", "digit"),
]
LOOSE = 4  # patterns from here on make no base spans
BEFORE, AFTER = 40, 16
MARK = "\u0001"

# Gazetteers and context words.
DOMAINS = "com org net edu gov mil int info biz io co ai dev app me eu de fr es it nl uk ch at be pl pt se no fi dk ie us ca mx br ar cl in cn jp kr au nz za ru".split()
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6011|64[4-9]|65|62|81)"
DIAL_CODE = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
KEY_PREFIX = r"^(?:sk[_-]|pk[_-]|ghp_|gho_|AKIA|ASIA|xox[abps]-|AIza|eyJ|glpat-)"
SPEAKS_FOR = {
    EMAIL: r"(?i)mail|contact|write to|kontakt|correo|courriel|reach",
    IP: r"(?i)\bip\b|host|server|address|adresse|client|remote|login",
    CARD: r"(?i)card|visa|master|amex|credit|payment|karte|carte|tarjeta|konto|pan\b",
    PHONE: r"(?i)phone|\btel|call|mobile|cell|fax|handy|móvil|portable|whatsapp|sms",
    SECRET: r"(?i)(?:token|secret|key|passw\w*|auth\w*|bearer|credential\w*)[\"']?\s*[:=]?\s*[\"']?$",
}
SPEAKS_AGAINST = r"(?i)\b(?:isbn|issn|doi|version|ver|release|chapter|section|page|figure|table|order|invoice|part|sku|commit|sha1|sha256|md5|etag|license|licence|§)\b"

VOTES = ["format", "variety", "gazetteer", "speaks_for", "speaks_against", "glued"]
SHAPES = ["quoted", "separated", "long", "opens_line"]
FEATURES = ["one", *[f"is_{KINDS[k]}" for k in range(1, 5)], *VOTES, *SHAPES]
START = [-1.0, 0, 0, 0, 0, *[1.0] * len(VOTES), 0, 0, 0, 0]  # an honest majority vote
PRIOR = 4.0
EM_ROUNDS = 8
NEWTON_STEPS = 4


# --- one pass over the texts ---------------------------------------------------
def pieces(docs: DataFrame) -> DataFrame:
    """(row, doc_id, p0, p1, ...): per pattern, the text cut at its matches: gaps at even
    places, matches at odd ones; null where the pattern cannot match."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(MARK), F.lit("\u0002"))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    holds = {
        "mail": F.contains(t, F.lit("@")),
        "digit": t.rlike("[0-9]"),
        "plus": F.contains(t, F.lit("+")),
        "spelled": reduce(lambda a, b: a | b, [F.contains(t, F.lit(f"{o}at{c}")) for o, c in ("()", "[]", "{}")]) | (F.contains(t, F.lit(" at ")) & F.contains(t, F.lit(" dot "))),
    }
    x = x.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), *[c.alias(f"has_{k}") for k, c in holds.items()])

    def cut(pattern: str) -> Column:
        parts = F.split(F.regexp_replace(t, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
        match = lambda i: i % 2 == 1
        piece = lambda p, i: F.struct(
            i.alias("i"),
            F.length(p).alias("n"),
            F.when(match(i), p).alias("found"),
            F.when(~match(i), F.left(p, F.lit(AFTER))).alias("after"),
            F.when(~match(i), F.right(p, F.lit(BEFORE))).alias("before"),
        )
        return F.transform(parts, piece)

    return x.select("row", "doc_id", *[F.when(F.col(f"has_{need}"), cut(pattern)).alias(f"p{k}") for k, (_, pattern, need) in enumerate(PATTERNS)])


def matches(cut: DataFrame) -> DataFrame:
    """(row, pattern, start, end, found, before, after) of every match."""
    tagged = lambda k: F.transform(F.when(F.size(f"p{k}") > 1, F.col(f"p{k}")), lambda s: F.struct(F.lit(k).alias("pattern"), s.alias("s")))
    none = F.array().cast(f"array<struct<pattern:int,s:{cut.schema['p0'].dataType.elementType.simpleString()}>>")
    every = F.concat(*[F.coalesce(tagged(k), none) for k in range(len(PATTERNS))])
    x = cut.select("row", F.explode(every).alias("m")).select("row", "m.pattern", "m.s.*")
    w = Window.partitionBy("row", "pattern").orderBy("i")
    start = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.select("row", "pattern", "i", "n", "found", start.alias("start"), F.lag("before").over(w).alias("before"), F.lead("after").over(w).alias("after"))
    x = x.filter("i % 2 = 1")
    return x.select("row", "pattern", "start", (F.col("start") + F.col("n")).alias("end"), "found", "before", "after")


# --- base spans and candidates ---------------------------------------------------
def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _by(key: str, of: dict[int, Column], other: Column) -> Column:
    return reduce(lambda rest, kv: F.when(F.col(key) == kv[0], kv[1]).otherwise(rest), of.items(), other)


def _at_most_255(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return F.when(F.length(short) <= 3, F.concat(F.lit("0"), short).cast("int") <= 255).otherwise(F.lit(False))


def checked(found: DataFrame) -> DataFrame:
    """Matches with ``kind``, ``base`` and ``digits``; those that are neither base nor
    candidates left out."""
    f, n = F.col("found"), F.length("digits")
    x = found.withColumn("digits", _digits(f)).withColumn("kind", _by("pattern", {k: F.lit(kind) for k, (kind, _, _) in enumerate(PATTERNS)}, F.lit(0)))
    card = F.when(n.between(16, 19), F.expr("luhn_check(digits)")).otherwise(F.lit(False))
    ok = _by("pattern", {0: F.lit(True), 1: F.forall(F.split(f, "[.]"), _at_most_255), 2: card, 3: n.between(8, 15)}, F.lit(False))
    x = x.withColumn("base", ok)
    up_to = lambda *order: Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({  # both frames grow with the rows: linear in a text's matches
        "covered": F.max(F.when(F.col("base"), F.col("end"))).over(up_to("start", F.col("base").desc())),
        "next": F.min(F.when(F.col("base"), F.col("start"))).over(up_to(F.col("start").desc())),
    })
    free = ~(F.coalesce(F.col("covered") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    sized = (F.col("pattern") != 2) | n.between(13, 19)  # other runs of digits are numbers
    return x.filter(F.col("base") | (free & sized)).drop("covered", "next")


def voted(spans: DataFrame) -> DataFrame:
    """Spans with a column per labeler (1 yes, -1 no, 0 nothing) and per mark of shape."""
    f, d, n = F.col("found"), F.col("digits"), F.length("digits")
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    vote = lambda c: F.when(c, 1).otherwise(-1)
    speaks = lambda c, v: F.when(c, v).otherwise(0)
    variety = F.size(F.array_distinct(F.split(F.lower(f), "")))
    last = F.lower(F.regexp_extract(f, "([A-Za-z]+)[^A-Za-z]*$", 1))
    spelled = F.regexp_count(f, F.lit(r"[(\[{]|@| at "))
    mixed = f.rlike("^[0-9a-fA-F]{32,}$") | (f.rlike("[a-z]") & f.rlike("[A-Z]") & f.rlike("[0-9]"))
    glued = before.rlike(r"[\p{L}\p{N}_/.=&?-]$") | after.rlike(r"^[\p{L}\p{N}_/]")
    named = {
        "format": _by("kind", {
            EMAIL: vote((F.length(last) >= 2) & (spelled >= 1)),
            IP: vote(F.forall(F.split(f, "[.]"), lambda p: _at_most_255(p) & ((F.length(p) == 1) | ~p.startswith("0")))),
            CARD: vote(F.when(n.between(13, 19), F.expr("luhn_check(digits)")).otherwise(F.lit(False))),
            PHONE: vote(n.between(8, 15)),
            SECRET: vote(mixed),
        }, F.lit(0)),
        "variety": speaks(variety < _by("kind", {IP: F.lit(3), SECRET: F.lit(10)}, F.lit(4)), -1),
        "gazetteer": _by("kind", {
            EMAIL: vote(last.isin(DOMAINS)),
            IP: speaks(f.rlike(r"^(?:0|127|255)\."), -1),
            CARD: vote(d.rlike(CARD_PREFIX)),
            PHONE: F.when(f.startswith("+"), vote(d.rlike(DIAL_CODE))).otherwise(0),
            SECRET: speaks(f.rlike(KEY_PREFIX), 1),
        }, F.lit(0)),
        "speaks_for": speaks(_by("kind", {k: before.rlike(p) for k, p in SPEAKS_FOR.items()}, F.lit(False)), 1),
        "speaks_against": speaks(before.rlike(SPEAKS_AGAINST), -1),
        "glued": speaks(glued, -1),
        "quoted": before.rlike("[\"'=:<(]\\s*$").cast("int"),
        "separated": f.rlike("[ ().-]").cast("int"),
        "long": (F.length(f) >= 16).cast("int"),
        "opens_line": ((before == "") | before.rlike("\n\\s*$")).cast("int"),
    }
    return spans.select("row", "kind", "start", "end", "base", *[c.cast("int").alias(k) for k, c in named.items()])


# --- reliabilities and classifier ---------------------------------------------------
def _pick(values: list[float], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + 1)


def _expected(log_odds: dict) -> Column:
    """Chance that a pattern's spans are true, by the reliabilities so far."""
    if not log_odds:  # first guess: the majority
        total = sum(F.col(v) for v in VOTES) - 1
    else:
        total = _pick(log_odds["kind"], F.col("kind"))
        for v in VOTES:
            total = total + _pick(log_odds[v], F.col("kind") * 3 + F.col(v) + 1)
    return F.when(F.col("base"), F.lit(1.0)).otherwise(1 / (1 + F.exp(-total)))


def reliabilities(patterns: DataFrame, rounds: int = EM_ROUNDS) -> dict[str, list[float]]:
    """Log odds of truth that each kind, and each labeler's vote on a kind, stand for."""
    odds: dict[str, list[float]] = {}
    for _ in range(rounds):
        x = patterns.select("*", (F.col("n") * _expected(odds)).alias("yes")).withColumn("no", F.col("n") - F.col("yes"))
        sums = [F.sum(c).alias(c) for c in ("yes", "no")]
        sums += [F.sum(F.when(F.col(v) == k, F.col(c)).otherwise(0)).alias(f"{v}{k}{c}") for v in VOTES for k in (-1, 0, 1) for c in ("yes", "no")]
        got = {r.kind: r for r in x.groupBy("kind").agg(*sums).collect()}  # a row per kind
        if not got:
            break
        count = lambda kind, name: (got[kind][name] or 0.0) if kind in got else 0.0
        odds = {"kind": [math.log((count(k, "yes") + PRIOR / 2) / (count(k, "no") + PRIOR / 2)) for k in range(len(KINDS))]}
        for v in VOTES:
            # imagined spans: true ones get a yes twice as often as a no, false ones the other way
            chance = lambda k, vote, c, lean: (count(k, f"{v}{vote}{c}") + PRIOR * lean[vote + 1]) / (count(k, c) + PRIOR)  # noqa: B023, E731
            odds[v] = [math.log(chance(k, vote, "yes", (0.2, 0.4, 0.4)) / chance(k, vote, "no", (0.4, 0.4, 0.2))) for k in range(len(KINDS)) for vote in (-1, 0, 1)]
    return odds


def _features() -> list[Column]:
    return [F.lit(1.0), *[(F.col("kind") == k).cast("double") for k in range(1, 5)], *[F.col(c).cast("double") for c in VOTES + SHAPES]]


def _score(weights) -> Column:
    return 1 / (1 + F.exp(-sum(f * F.lit(float(w)) for f, w in zip(_features(), weights))))


def classifier(patterns: DataFrame, odds: dict[str, list[float]], steps: int = NEWTON_STEPS) -> list[float]:
    """Weights of FEATURES: Newton steps on the expected labels, held to START by PRIOR."""
    m = len(FEATURES)
    start = np.array(START)
    w = start.copy()
    named = patterns.select("n", _expected(odds).alias("y"), *[c.alias(f"f{i}") for i, c in enumerate(_features())], "kind", *VOTES, *SHAPES)
    for _ in range(steps if odds else 0):
        x = named.withColumn("p", _score(w))
        x = x.withColumns({"g": F.col("n") * (F.col("y") - F.col("p")), "h": F.col("n") * F.col("p") * (1 - F.col("p"))})
        sums = [F.sum(F.col("g") * F.col(f"f{i}")).alias(f"g{i}") for i in range(m)]
        sums += [F.sum(F.col("h") * F.col(f"f{i}") * F.col(f"f{j}")).alias(f"h{i}_{j}") for i in range(m) for j in range(i + 1)]
        row = x.agg(*sums).first()
        g = np.array([row[f"g{i}"] or 0.0 for i in range(m)]) - PRIOR * (w - start)
        h = np.array([[row[f"h{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(m)] for i in range(m)]) + PRIOR * np.eye(m)
        step = np.linalg.solve(h, g)
        w = w + step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return w.tolist()


def personal_data(docs: DataFrame) -> DataFrame:
    """Base counts and all spans of every row of ``docs(doc_id, text)``."""
    folder = run_folder(docs.sparkSession, "pii")
    cut = written(pieces(docs), f"{folder}/pieces")
    spans = written(voted(checked(matches(cut))), f"{folder}/spans")
    patterns = written(spans.groupBy("kind", "base", *VOTES, *SHAPES).agg(F.count("*").cast("double").alias("n")), f"{folder}/patterns")
    odds = reliabilities(patterns)
    taken = spans.filter(F.col("base") | (_score(classifier(patterns, odds)) >= 0.5))
    first = Window.partitionBy("row", "base").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("before", F.max("end").over(first)).filter("base or before is null or before <= start")
    mine = taken.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("s"))
    x = cut.select("row", "doc_id").join(mine, "row", "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda s: F.array_join(F.transform(s, lambda v: F.concat_ws(":", F.element_at(names, v["kind"] + 1), v["start"], v["end"])), ",")
    base = F.filter("s", lambda v: v["base"])
    count = lambda k: F.coalesce(F.size(F.filter("s", lambda v: v["base"] & (v["kind"] == k))).cast("long"), F.lit(0).cast("long"))
    none = F.col("s").isNull()
    return x.select(
        "doc_id",
        *[F.when(none, F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)],
        F.sha2(F.when(none, F.lit("")).otherwise(shown(base)).cast("binary"), 256).alias("base_sha256"),
        F.when(none, F.lit("")).otherwise(shown(F.col("s"))).alias("spans"),
    )
