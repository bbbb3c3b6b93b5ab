"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are counted by cell: source x language x topic. Raking multiplies the
cells' weights, marginal after marginal, so that each marginal's weights add up to
its target; ``ROUNDS`` sweeps over the three marginals. A cell's calibrated
probability is its raked weight over its share of the tokens, scaled so that the
largest is 1: the expected tokens of the sample then follow the targets exactly. A
document is drawn by a hash of its id (Poisson sampling: no order, no shuffle of
texts, the same draw on every run).

Topic: the keyword list of ``TOPICS`` of which most words stand in the text, first
on ties, ``other`` without any. Targets: a share per value for any marginal, given
as ``{"source": {...}}``; for the others the marginal's own shares to the power
``TEMPER``, which lifts small sources over large ones. Values without tokens have
no target; shares are rescaled to those that have.

Only DataFrame functions. The cell table is small beside the corpus but never
collected; one table per sweep and margin is written in the shared folder.

Cases: null source or lang: the value ``''``. Null, empty or blank text: no tokens, no
weight, never drawn. Null doc_id: drawn as the empty id. Equal rows: the same draw.
Empty table: empty result. Extra columns (``topic`` or ``weight`` too) stay as they
are in ``sampled_documents`` and are ignored by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import run_folder, written

MARGINS = ("source", "lang", "topic")
ROUNDS = 8
TEMPER = 0.9
SENT_CELLS = 100_000

# Common words of four languages, by what they express.
TOPICS = {
    "place": "in on at from into over under dans sur en auf aus bei sobre desde".split(),
    "action": "is was be are have est sont ist sind war haben es son fue".split(),
    "relation": "of by with for de par pour avec von mit zu del con por para".split(),
}
BLANK = r"[\x20\x09-\x0D]+"


def described(docs: DataFrame, topics: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs(doc_id, text, source, lang)`` with n_tokens and topic (columns named with _)."""
    topics = topics or TOPICS
    x = docs.withColumn("_words", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), BLANK), lambda w: w != ""))
    among = lambda listed: F.size(F.filter("_words", lambda w: w.isin(listed)))
    x = x.withColumns({f"_n{i}": among(listed) for i, listed in enumerate(topics.values())}).withColumn("_tokens", F.size("_words").cast("long")).drop("_words")
    most = F.greatest(*[F.col(f"_n{i}") for i in range(len(topics))]) if len(topics) > 1 else F.col("_n0")
    topic: Column = F.lit("other")
    for i, name in reversed(list(enumerate(topics))):
        topic = F.when((F.col(f"_n{i}") > 0) & (F.col(f"_n{i}") == most), F.lit(name)).otherwise(topic)
    x = x.withColumn("_topic", topic).drop(*[f"_n{i}" for i in range(len(topics))])
    return x.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_lang", F.coalesce("lang", F.lit("")))


def target_shares(cells: DataFrame, margin: str, given: dict[str, float] | None) -> DataFrame:
    """(margin value, share): the given targets or tempered shares, adding up to 1."""
    by = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    if given is not None:
        spark = cells.sparkSession
        rows = spark.createDataFrame([(str(k), float(v)) for k, v in given.items()], f"{margin} string, raw double")
        by = by.join(rows, margin, "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    else:
        by = by.withColumn("raw", F.pow(F.col("t").cast("double"), F.lit(TEMPER)))
    all_ = by.agg(F.sum("raw")).first()[0] or 1.0
    return by.select(margin, (F.col("raw") / F.lit(float(all_))).alias("target"))


def raked_cells(described_docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """source, lang, topic, tokens, weight (raked share of all tokens), probability."""
    folder = run_folder(described_docs.sparkSession, "raking")
    names = [F.col(f"_{m}").alias(m) for m in MARGINS]
    cells = described_docs.filter("_tokens > 0").groupBy(*names).agg(F.sum("_tokens").alias("tokens"))
    cells = written(cells, f"{folder}/cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    goals = {m: written(target_shares(cells, m, (targets or {}).get(m)), f"{folder}/target-{m}") for m in MARGINS}
    # a table per step: one that holds the sums of three margins has eight times the joins
    for k in range(rounds):
        for m in MARGINS:
            sums = now.groupBy(m).agg(F.sum("weight").alias("s")).join(goals[m], m)
            factor = sums.select(m, F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(0.0).alias("f"))
            now = now.join(factor, m).withColumn("weight", F.col("weight") * F.col("f"))
            now = written(now.select(*MARGINS, "tokens", "weight"), f"{folder}/sweep-{k}-{m}")
    ratio = F.col("weight") / F.col("tokens")
    most = now.agg(F.max(ratio)).first()[0] or 1.0
    return now.withColumn("probability", ratio / F.lit(float(most)))


def draw(doc_id: Column, salt: str = "mix") -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + salt))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _drawn(x: DataFrame, targets, rounds: int) -> DataFrame:
    """The drawn rows of described documents, with their probability ``_p``."""
    cells = raked_cells(x, targets, rounds).select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.col("probability").alias("_p"))
    if cells.count() <= SENT_CELLS:  # a few MB, checked
        cells = F.broadcast(cells)
    x = x.filter("_tokens > 0").join(cells, [f"_{m}" for m in MARGINS])
    return x.filter(draw(F.col("doc_id")) < F.col("_p"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The drawn documents: doc_id, source, lang, topic, n_tokens, probability. Texts are
    read once: what the counts and the draw need of them is a small table."""
    x = described(docs.select("doc_id", "text", "source", "lang")).drop("text", "source", "lang")
    x = _drawn(written(x, f"{run_folder(docs.sparkSession, 'described')}/documents"), targets, rounds)
    return x.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_p", 9).alias("probability"))


def sampled_documents(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, whatever these are called."""
    x = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("_doc"))
    return _drawn(described(x), targets, rounds).select("_doc.*")
