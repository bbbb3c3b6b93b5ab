"""`english_revised`: stems of the revised English rules and their stop list."""

import pytest
from pyspark.sql import functions as F

from quire.functions.revised import STOP_WORDS, revised_lexeme, revised_lexeme_py, revised_stem, revised_stem_py
from quire.operators.analyze import postings
from quire.operators.query import compile_query
from quire.plans.index import TextIndex
from quire.plans.search import match, search_files

# word / stem pairs of the stemmer's published sample vocabulary
SAMPLE = """
consign consign | consigned consign | consigning consign | consignment consign | consist consist | consisted consist
consistency consist | consistent consist | consistently consist | consisting consist | consists consist
consolation consol | consolations consol | consolatory consolatori | console consol | consoled consol | consoles consol
consolidate consolid | consolidated consolid | consolidating consolid | consoling consol | consolingly consol
consols consol | consonant conson | consort consort | consorted consort | consorting consort
conspicuous conspicu | conspicuously conspicu | conspiracy conspiraci | conspirator conspir | conspirators conspir
conspire conspir | conspired conspir | conspiring conspir | constable constabl | constables constabl
constance constanc | constancy constanc | constant constant
knack knack | knackeries knackeri | knacks knack | knag knag | knave knave | knaves knave | knavish knavish
kneaded knead | kneading knead | knee knee | kneel kneel | kneeled kneel | kneeling kneel | kneels kneel | knees knee
knell knell | knelt knelt | knew knew | knick knick | knif knif | knife knife | knight knight | knightly knight
knights knight | knit knit | knits knit | knitted knit | knitting knit | knives knive | knob knob | knobs knob
knock knock | knocked knock | knocker knocker | knockers knocker | knocking knock | knocks knock | knopp knopp
knot knot | knots knot
"""
# one case or more for each rule of the description
RULES = """
is is | as as | skis ski | skies sky | dying die | only onli | news news | inning inning | proceeds proceed | exceeding exceed
sister's sister | ties tie | cries cri | gas gas | this this | gaps gap | kiwis kiwi | caresses caress | corpus corpus
agreed agre | feed feed | luxuriated luxuri | hopping hop | hoped hope | hoping hope | bled bled | sing sing
cry cri | by by | say say | happy happi | enjoyed enjoy | youth youth | yes yes | sayings say
relational relat | conditional condit | generalization general | generate generat | generic generic | communism communism
arsenal arsenal | apology apolog | hopelessly hopeless | hopefully hope | quickly quick | rationally ration | possibly possibl
sensibilities sensibl | electrical electr | goodness good | negative negat | adoption adopt | replacement replac
controlling control | rolls roll | beauty beauti | beautiful beauti | beau beau | animadversion animadvers | sprinkled sprinkl
rate rate | hope hope | cease ceas | parallel parallel | excellence excel | falling fall
"""
GOLDEN = dict(pair.split() for text in (SAMPLE, RULES) for line in text.strip().splitlines() for pair in line.split("|"))


def test_published_stems_as_columns(spark):
    df = spark.createDataFrame([(w,) for w in sorted(GOLDEN)], "w string")
    got = {r.w: r.s for r in df.select("w", revised_stem(F.col("w")).alias("s")).collect()}
    assert {w: (got[w], s) for w, s in GOLDEN.items() if got[w] != s} == {}
    assert {w: revised_stem_py(w) for w in GOLDEN} == GOLDEN


def test_stop_list():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 127
    assert "now" in STOP_WORDS and "would" not in STOP_WORDS


def test_odd_words(spark):
    """Null, empty, apostrophes, runs of y, letters beyond ASCII: a result, the same on both sides."""
    words = [None, "", "y", "yy", "yyy", "'", "'''", "''s", "'em", "o'clock's", "ayyyid", "éclairs", "straßes", "ings", "eed", "ing", "s", "ies", "1ed", "x" * 5000 + "ing"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in df.select("w", revised_lexeme(F.col("w")).alias("s")).collect()}
    assert got == {w: revised_lexeme_py(w) for w in words}
    assert got[None] is None and got["s"] is None and got["éclairs"] == "éclair"


def test_twins_agree_on_corpus_vocabulary(spark):
    from quire.operators.analyze import fragments
    from quire.sources.corpus import corpus_files

    lex = postings(fragments(corpus_files(spark, "/root/testdata/sf0.01"), 100)).select("lexeme").distinct()
    rows = lex.select("lexeme", revised_lexeme(F.col("lexeme")).alias("s")).collect()
    bad = [(r.lexeme, r.s, revised_lexeme_py(r.lexeme)) for r in rows if revised_lexeme_py(r.lexeme) != r.s]
    assert len(rows) > 60000 and not bad[:10]


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame(
        [(1, "a", "A", "x", "he would rely on the generic knives"), (2, "b", "B", "x", "general knights relied upon a knife"), (3, "c", "C", "x", "")],
        "file_id long, filename string, title string, author string, content string",
    )
    return TextIndex.build(files, 100, "english_revised")


def test_index_and_queries(spark, index, tmp_path):
    rows = sorted((r.file_id, r.pos, r.lexeme) for r in postings(index.fragments, config="english_revised").collect())
    # "he", "on", "the", "a" are stop words and keep their places; "would" and "upon" are none
    want = [(1, 2, "would"), (1, 3, "reli"), (1, 6, "generic"), (1, 7, "knive")]
    assert rows == [*want, (2, 1, "general"), (2, 2, "knight"), (2, 3, "reli"), (2, 4, "upon"), (2, 6, "knife")]
    written = index.write(str(tmp_path / "i"), buckets=2)
    for idx in (index, written, TextIndex.load(spark, str(tmp_path / "i"))):
        assert idx.config == "english_revised"
        q = compile_query(spark, "rely on the generic", "phrase", idx.config)
        assert q.root.terms == ((0, "reli"), (3, "generic"))
        assert [(r.file_id, r.s, r.e) for r in match(idx, q)[0].collect()] == [(1, 3, 6)]
        found = search_files(idx, "relying & !generic", "logical").collect()
        assert [r.file_id for r in found] == [2] and "<b>relied</b>" in found[0].headline
