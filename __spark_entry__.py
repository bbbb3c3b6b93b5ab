"""

``entry(spark)`` runs the flagship search (fast headline) on sf0.001;
each reading the driver tables of ``sf_dir``; ``oracle_sql()`` gives the DuckDB
SQL that recomputes the same result from the same tables.

The registered queries build the index in the plan from ``documents`` (so their
work grows with the tables) with fragments of ``FRAGMENT_TOKENS`` tokens, small
enough that fragment borders are exercised on the driver texts.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# the package and the oracle module live next to this file
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

import oracle_sql as O  # noqa: E402
from quire.operators.match import covers
from quire.operators.headline import top_covers
from quire.operators.query import compile_query
from quire.plans.index import TextIndex
from quire.plans.search import file_contents, file_matches, match, search_fast, search_full
from quire.sources.corpus import corpus_files

try:  # the training-data operators are optional: without them all else works
    from quire.llm import queries as _llm
except ImportError:
    _llm = None
try:
    import corpus_pipeline as _pipeline
except ImportError:
    _pipeline = None

FRAGMENT_TOKENS = O.FRAGMENT_TOKENS
SMOKE_DIR = "/root/testdata/sf0.001"

# Fixed query texts of the registered searches.
Q_PHRASE = "of the"
Q_AND = "the & of"
Q_OR = "der | die"
Q_NOT = "!the"
Q_DISTANCE = "of <2> the"
Q_FILES = "(of <-> the) & !and"
Q_FAST = "(of <-> the) | (was & with)"
Q_FULL = "(of <-> the) & this"
Q_MATCHES = "(of <-> the) | with"
Q_ENGLISH = "(tion <-> ing) | (ble & ly)"
Q_ENGLISH_PHRASE = "rely and ly"
Q_REVISED = "(thtiedly <-> erly) | (oned & ering)"
Q_FAST_NOT = "with | !the"
Q_MATCHES_NOT = "of <1> !the"
Q_DISTANCE_OR = "(of | in) <2> the"
Q_DISTANCE_NESTED = "(of | (of & in)) <1> the"


def _index(spark: SparkSession, sf_dir: str, config: str = "simple") -> TextIndex:
    return TextIndex.build(corpus_files(spark, sf_dir), FRAGMENT_TOKENS, config)


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def q_fragments(spark, sf_dir):
    fr = _index(spark, sf_dir).fragments
    return fr.select(
        *_long("file_id", "sequence_no"),
        F.size("content_array").cast("long").alias("n_words"),
        F.array_join("content_array", " ").alias("words"),
        "content",
    )


def q_token_positions(spark, sf_dir):
    fr = _index(spark, sf_dir).fragments
    x = fr.select("file_id", "sequence_no", F.posexplode_outer("content_array").alias("i", "token"), "content_tsv")
    x = x.filter(F.col("token").isNotNull())
    return x.select(
        *_long("file_id", "sequence_no"),
        (F.col("i") + 1).cast("long").alias("pos"),
        "token",
        F.element_at("content_tsv", F.col("i") + 1)["lexeme"].alias("lexeme"),
    )


def q_lexeme_postings(spark, sf_dir):
    from quire.operators.analyze import postings

    p = postings(_index(spark, sf_dir).fragments)
    return p.select("lexeme", *_long("file_id", "sequence_no", "pos"))


def _spans(spark, sf_dir, text, mode):
    idx = _index(spark, sf_dir)
    q = compile_query(spark, text, mode)
    spans, frags = match(idx, q)
    return idx, q, spans, frags


def q_phrase_match(spark, sf_dir):
    _, _, spans, _ = _spans(spark, sf_dir, Q_PHRASE, "phrase")
    return spans.select(*_long("file_id", "sequence_no", "s", "e"))


def _frags(text):
    def run(spark, sf_dir):
        _, _, _, frags = _spans(spark, sf_dir, text, "logical")
        return frags.select(*_long("file_id", "sequence_no"))

    return run


def q_word_distance(spark, sf_dir):
    _, _, spans, _ = _spans(spark, sf_dir, Q_DISTANCE, "logical")
    return spans.select(*_long("file_id", "sequence_no", "s", "e"))


def q_distance_or(spark, sf_dir):
    _, _, spans, _ = _spans(spark, sf_dir, Q_DISTANCE_OR, "logical")
    return spans.select(*_long("file_id", "sequence_no", "s", "e"))


def q_distance_nested(spark, sf_dir):
    _, _, spans, _ = _spans(spark, sf_dir, Q_DISTANCE_NESTED, "logical")
    return spans.select(*_long("file_id", "sequence_no", "s", "e"))


def q_matching_files(spark, sf_dir):
    _, _, _, frags = _spans(spark, sf_dir, Q_FILES, "logical")
    return frags.select(F.col("file_id").cast("long").alias("file_id")).distinct()


def q_cover_density(spark, sf_dir):
    _, q, spans, _ = _spans(spark, sf_dir, Q_AND, "logical")
    c = covers(spans, q)
    return c.select(*_long("file_id", "sequence_no", "s", "e"), F.round("density", 6).alias("density"))


def q_top5_covers(spark, sf_dir):
    _, q, spans, frags = _spans(spark, sf_dir, Q_AND, "logical")
    rows = frags.join(covers(spans, q), ["file_id", "sequence_no"], "left")
    t = top_covers(rows)
    return t.select(
        *_long("file_id", "rn", "sequence_no", "s", "e"), F.round("density", 6).alias("density")
    )


def q_search_fast(spark, sf_dir):
    return search_fast(_index(spark, sf_dir), Q_FAST, "logical")


def q_search_fast_not(spark, sf_dir):
    return search_fast(_index(spark, sf_dir), Q_FAST_NOT, "logical")


def _shared_folder(spark, prefix):
    import os
    import uuid

    from quire.session import checkpoint_dir

    root = checkpoint_dir(spark)
    if not root:
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return os.path.join(root, f"{prefix}-{uuid.uuid4().hex}")


def q_search_fast_tables(spark, sf_dir):
    """E1 on the scale layout: the index written as catalog tables bucketed by
    file_id (hits, fragment windows, top covers and the token join co-located)."""
    path = _shared_folder(spark, "quire-tables")
    name = "quire_" + path.rsplit("-", 1)[1][:12]
    idx = _index(spark, sf_dir).write_tables(name, buckets=8, path=path)
    return search_fast(idx, Q_FAST, "logical")


def q_search_headline(spark, sf_dir):
    return search_full(_index(spark, sf_dir), Q_FULL, "logical", semantic=False)


def q_search_headline_not(spark, sf_dir):
    return search_full(_index(spark, sf_dir), Q_FAST_NOT, "logical", semantic=False)


def q_search_semantic(spark, sf_dir):
    return search_full(_index(spark, sf_dir), Q_FULL, "logical", semantic=True)


def q_file_contents(spark, sf_dir):
    return file_contents(_index(spark, sf_dir))


def q_file_matches(spark, sf_dir):
    m = file_matches(_index(spark, sf_dir), Q_MATCHES, "logical")
    return m.select(*_long("file_id", "sequence_no", "s"), "term")


def q_file_matches_capped(spark, sf_dir):
    m = file_matches(_index(spark, sf_dir), Q_MATCHES, "logical", limit=2)
    return m.select(*_long("file_id", "sequence_no", "s"), "term")


def _one_book(spark, sf_dir) -> int:
    """The English book of the smallest id."""
    from quire.sources.corpus import table

    return table(spark, sf_dir, "documents").filter("lang = 'en'").agg(F.min("doc_id")).first()[0]


def q_file_contents_one(spark, sf_dir):
    return file_contents(_index(spark, sf_dir), _one_book(spark, sf_dir))


def q_file_matches_one(spark, sf_dir):
    return file_matches(_index(spark, sf_dir), Q_MATCHES, "logical", _one_book(spark, sf_dir))


def q_render_file_one(spark, sf_dir):
    from quire.plans.render import render_file

    return render_file(_index(spark, sf_dir), Q_MATCHES, "logical", _one_book(spark, sf_dir))


# --- presentation ------------------------------------------------------------
def q_terms_ordered(spark, sf_dir):
    from quire.plans.render import file_terms

    t = file_terms(_index(spark, sf_dir), Q_MATCHES, "logical")
    x = t.select("file_id", F.posexplode("terms").alias("i", "term"))
    return x.select(F.col("file_id").cast("long").alias("file_id"), (F.col("i") + 1).cast("long").alias("term_rank"), "term")


def q_highlight_results(spark, sf_dir):
    from quire.functions.present import highlight
    from quire.plans.render import file_terms

    idx = _index(spark, sf_dir)
    t = file_terms(idx, Q_MATCHES, "logical")
    books = idx.files.select("file_id", "content").join(t, "file_id")
    return books.select("file_id", highlight(F.col("terms"), F.col("content")).alias("html"))


def q_result_count(spark, sf_dir):
    from quire.functions.present import count_marks

    h = q_highlight_results(spark, sf_dir)
    return h.select("file_id", count_marks(F.col("html")).alias("n_results"))


def q_clean_content(spark, sf_dir):
    from quire.functions.present import clean_content

    files = corpus_files(spark, sf_dir)
    chapter = F.concat(F.lit("\r\nChapter 7: "), F.col("title"), F.lit("\r\nCHAPTER\r\n"))
    chapter = F.when(F.col("file_id") % 11 == 1, chapter).otherwise(F.lit(""))
    body = F.concat(F.lit("Title: "), F.col("title"), F.lit("\r\n\r\n"), F.replace(F.col("content"), F.lit("\n"), F.lit("\r\n")), chapter)
    return files.select("file_id", clean_content(body).alias("html"))


def q_render_file(spark, sf_dir):
    from quire.plans.render import render_file

    return render_file(_index(spark, sf_dir), Q_MATCHES, "logical")


def q_link_headlines(spark, sf_dir):
    from quire.plans.render import render_list

    return render_list(q_search_fast(spark, sf_dir))


# --- ingest ------------------------------------------------------------------
CHUNK_WORDS = O.CHUNK_WORDS
STREAM_BUCKETS = 8  # index buckets of the streamed corpus


def _raw_books(spark, sf_dir):
    from quire.sources.books import raw_books_from_files

    return raw_books_from_files(corpus_files(spark, sf_dir))


def q_parse_books_strict(spark, sf_dir):
    from quire.sources.books import parse_books

    books, _ = parse_books(_raw_books(spark, sf_dir))
    return books


def q_parse_books_rejects(spark, sf_dir):
    from quire.sources.books import parse_books

    _, rejects = parse_books(_raw_books(spark, sf_dir))
    return rejects


def q_parse_books_all(spark, sf_dir):
    from quire.sources.books import parse_books_all

    return parse_books_all(_raw_books(spark, sf_dir))


def q_word_chunks(spark, sf_dir):
    from quire.sources.books import word_chunks

    return word_chunks(q_parse_books_all(spark, sf_dir), CHUNK_WORDS)


def q_word_chunks_over_all(spark, sf_dir):
    """S13 with words numbered over all files."""
    from quire.sources.books import word_chunks

    return word_chunks(q_parse_books_all(spark, sf_dir), CHUNK_WORDS, over_all=True)


def q_ingest_files(spark, sf_dir):
    from quire.sources.books import ingest

    files, _ = ingest(_raw_books(spark, sf_dir))
    return files


def q_ingest_index(spark, sf_dir):
    """Raw books -> written files, fragments and postings; the postings."""
    idx, _ = TextIndex.ingest(_raw_books(spark, sf_dir), _shared_folder(spark, "quire-ingest"), max_tokens=FRAGMENT_TOKENS, buckets=STREAM_BUCKETS)
    return idx.postings.select("lexeme", *_long("file_id", "sequence_no", "pos"))


def q_txt_names(spark, sf_dir):
    """S3 over names that end in different ways."""
    from quire.sources.books import txt_like
    from quire.sources.corpus import table

    part = lambda *x: F.concat(F.col("source"), *x)
    doc, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    name = (
        F.when(kind == 0, part(F.lit("/"), doc, F.lit(".txt")))
        .when(kind == 1, part(F.lit("/"), doc, F.lit(".md")))
        .when(kind == 2, part(F.lit("/"), doc, F.lit("_txt.old")))
        .otherwise(part(F.lit("/txt"), doc))
    )
    return table(spark, sf_dir, "documents").select(name.alias("name")).filter(txt_like(F.col("name")))


# --- upkeep ------------------------------------------------------------------
def q_index_upsert(spark, sf_dir):
    """Books flagged low quality in ``labels`` are re-cleaned (title line added
    again) and re-indexed in a written index; all other fragments stay as they are."""
    from quire.operators.upkeep import apply_changes
    from quire.sources.corpus import table

    path = _shared_folder(spark, "quire-upsert")
    idx = _index(spark, sf_dir).write(path, buckets=STREAM_BUCKETS)
    flagged = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("file_id"))
    changed = idx.files.join(flagged, "file_id", "left_semi").withColumn(
        "content", F.concat(F.col("title"), F.lit("\n"), F.col("content"))
    )
    fr = apply_changes(idx, path, changes=changed).fragments
    return fr.select(
        *_long("file_id", "sequence_no"),
        F.size("content_array").cast("long").alias("n_words"),
        F.array_join("content_array", " ").alias("words"),
    )


def q_index_delete(spark, sf_dir):
    """Books flagged toxic in ``labels`` are deleted from a written index with their
    fragments; then its versions are compacted."""
    from quire.operators.upkeep import apply_changes, compact
    from quire.sources.corpus import table

    path = _shared_folder(spark, "quire-delete")
    idx = _index(spark, sf_dir).write(path, buckets=STREAM_BUCKETS)
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("file_id"))
    fr = compact(apply_changes(idx, path, deleted_ids=gone), path).fragments
    return fr.select(*_long("file_id", "sequence_no"), F.size("content_array").cast("long").alias("n_words"))


def q_corpus_emptied(spark, sf_dir):
    """S11 on a written index: its rows before and after every book is deleted."""
    from quire.operators.upkeep import empty

    path = _shared_folder(spark, "quire-emptied")
    before = _index(spark, sf_dir).write(path, buckets=STREAM_BUCKETS)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    rows = lambda idx, when: count(idx.files, "n_files").crossJoin(count(idx.fragments, "n_fragments")).crossJoin(count(idx.postings, "n_postings")).withColumn("moment", F.lit(when))  # noqa: E731  one row each
    first = rows(before, "before")
    return first.unionByName(rows(empty(before, path), "after"))


def q_index_update_kinds(spark, sf_dir):
    """T8 with every kind of change in one batch on a written index: texts (books flagged
    low quality), titles only, books sent again as they are, new books."""
    from quire.operators.upkeep import apply_changes
    from quire.sources.corpus import table

    path = _shared_folder(spark, "quire-kinds")
    idx = _index(spark, sf_dir).write(path, buckets=STREAM_BUCKETS)
    low = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("file_id")).distinct()
    text = idx.files.join(low, "file_id", "left_semi").withColumn("content", F.concat("title", F.lit("\n"), "content"))
    rest = idx.files.join(low, "file_id", "left_anti")
    title = rest.filter("file_id % 5 = 1").withColumn("title", F.concat(F.lit("Renamed "), F.col("title")))
    same = rest.filter("file_id % 5 = 2")
    new = idx.files.filter("file_id % 10 = 3").withColumn("file_id", F.col("file_id") + O.NEW_BOOKS)
    batch = text.unionByName(title).unionByName(same).unionByName(new)
    now = apply_changes(idx, path, changes=batch)
    fr = now.fragments.select(*_long("file_id", "sequence_no"), "title", F.size("content_array").cast("long").alias("n_words"), F.array_join("content_array", " ").alias("words"))
    found = now.postings.groupBy(*_long("file_id", "sequence_no")).agg(F.count("*").alias("n_postings"))
    return fr.join(found, ["file_id", "sequence_no"])


def _book_folder(spark, sf_dir) -> str:
    """The raw books as text files in nested folders of the shared folder."""
    from quire.sources.books import write_texts

    path = _shared_folder(spark, "quire-books")
    write_texts(_raw_books(spark, sf_dir), path)
    return path


def q_list_text_files(spark, sf_dir):
    """S1 over nested folders."""
    from quire.sources.books import list_text_files, shelf_name

    found = list_text_files(spark, _book_folder(spark, sf_dir), recursive=True)
    return found.select(shelf_name(F.col("path")).alias("name"))


def q_ls_files(spark, sf_dir):
    """Files under a folder that fit a predicate, in order, with their rank."""
    from quire.sources.books import consecutive_ids, ls_files, shelf_name

    found = ls_files(spark, _book_folder(spark, sf_dir), "filename LIKE '%1.txt/%'", "filename")
    ranked = consecutive_ids(found, "filename", name="file_rank")
    return ranked.select(shelf_name(F.col("filename")).alias("name"), "file_rank")


def q_read_books(spark, sf_dir):
    """Whole files read back from nested folders and parsed."""
    from quire.sources.books import parse_books, read_texts, shelf_name

    raw = read_texts(spark, _book_folder(spark, sf_dir), recursive=True)
    books, _ = parse_books(raw.withColumn("path", shelf_name(F.col("path"))))
    return books


def q_append_books(spark, sf_dir):
    """Two loads whose files overlap; the second adds only what is new."""
    from quire.sources.books import append_books, raw_books_from_files

    files = corpus_files(spark, sf_dir)
    none = files.limit(0).select("file_id", "filename", "title", "author", "content")
    first, _ = append_books(raw_books_from_files(files.filter("file_id % 3 <> 0")), none)
    path = _shared_folder(spark, "quire-append")
    first.write.parquet(path)
    held = spark.read.schema(first.schema).parquet(path)
    more, _ = append_books(raw_books_from_files(files.filter("file_id % 3 <> 1")), held)
    return held.unionByName(more)


def q_index_stream(spark, sf_dir):
    """The documents table arrives as a file stream; every micro-batch is
    upserted into a written index under the shared checkpoint folder."""
    import os

    from quire.plans.index import TextIndex
    from quire.streaming.feed import start_index_feed

    run = _shared_folder(spark, "quire-index-stream")
    q = start_index_feed(
        spark, os.path.join(sf_dir, "documents*.parquet"), run + "/index", run + "/checkpoint",
        max_tokens=FRAGMENT_TOKENS, buckets=STREAM_BUCKETS,
    )
    q.awaitTermination()
    fr = TextIndex.load(spark, run + "/index", max_tokens=FRAGMENT_TOKENS).fragments
    return fr.select(
        *_long("file_id", "sequence_no"),
        F.size("content_array").cast("long").alias("n_words"),
        F.array_join("content_array", " ").alias("words"),
    )


def q_index_stream_versions(spark, sf_dir):
    """T9 with two versions of some books in one micro-batch: every document, then
    those flagged low quality once more with their title line added."""
    from quire.plans.index import TextIndex
    from quire.sources.corpus import table
    from quire.streaming.feed import start_index_feed

    run = _shared_folder(spark, "quire-index-versions")
    docs = table(spark, sf_dir, "documents")
    docs.write.parquet(run + "/in/first")
    flagged = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    later = docs.join(flagged, "doc_id", "left_semi")
    later.withColumn("text", F.concat(F.substring_index("text", "\n", 1), F.lit("\n"), F.col("text"))).write.parquet(run + "/in/second")
    q = start_index_feed(spark, run + "/in/*", run + "/index", run + "/checkpoint", max_tokens=FRAGMENT_TOKENS, buckets=STREAM_BUCKETS)
    q.awaitTermination()
    fr = TextIndex.load(spark, run + "/index", max_tokens=FRAGMENT_TOKENS).fragments
    return fr.select(
        *_long("file_id", "sequence_no"),
        F.size("content_array").cast("long").alias("n_words"),
        F.array_join("content_array", " ").alias("words"),
    )


def q_index_changes(spark, sf_dir):
    """T9 and T10 by a feed of typed changes in three drops: every book; new texts of those
    flagged low quality and deletes of the toxic ones; late older updates of both, which
    change nothing, and every second toxic book once more."""
    from quire.sources.corpus import table
    from quire.streaming.changes import start_change_feed

    run = _shared_folder(spark, "quire-index-changes")
    files = _index(spark, sf_dir).files.select("file_id", "filename", "title", "author", "content")
    flagged = lambda c: table(spark, sf_dir, "labels").filter(c).select(F.col("doc_id").alias("file_id")).distinct()
    low, toxic = (files.join(flagged(c), "file_id", "left_semi") for c in ("quality = 0", "toxic = 1"))
    event = lambda df, op, seq: df.select(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), "*")
    longer = lambda df: df.withColumn("content", F.concat("title", F.lit("\n"), "content"))
    late = low.unionByName(toxic).withColumn("content", F.lit("late"))
    drops = [
        event(files, "insert", 1),
        event(longer(low), "update", 3).unionByName(event(toxic, "delete", 5)),
        event(late, "update", 2).unionByName(event(longer(toxic.filter("file_id % 2 = 0")), "insert", 7)),
    ]
    for k, drop in enumerate(drops):
        drop.write.parquet(f"{run}/in/{k}")
        q = start_change_feed(spark, run + "/in/*", run + "/index", run + "/checkpoint", max_tokens=FRAGMENT_TOKENS, buckets=STREAM_BUCKETS)
        q.awaitTermination()
    fr = TextIndex.load(spark, run + "/index", max_tokens=FRAGMENT_TOKENS).fragments
    return fr.select(
        *_long("file_id", "sequence_no"),
        F.size("content_array").cast("long").alias("n_words"),
        F.array_join("content_array", " ").alias("words"),
    )


# --- english configuration ---------------------------------------------------
def q_english_vocabulary(spark, sf_dir):
    """T6 vocabulary job: every distinct simple lexeme with its english lexeme
    (Porter stem; null for a stop word)."""
    from quire.functions.stem import english_lexeme
    from quire.operators.analyze import postings

    lex = postings(_index(spark, sf_dir).fragments).select("lexeme").distinct()
    return lex.select("lexeme", english_lexeme(F.col("lexeme")).alias("stem"))


def q_english_revised_vocabulary(spark, sf_dir):
    """T6 vocabulary job under the revised rules (null for a word of their stop list)."""
    from quire.functions.revised import revised_lexeme
    from quire.operators.analyze import postings

    lex = postings(_index(spark, sf_dir).fragments).select("lexeme").distinct()
    return lex.select("lexeme", revised_lexeme(F.col("lexeme")).alias("stem"))


def q_search_english_revised(spark, sf_dir):
    """E1 on a written index of revised stems."""
    index = _index(spark, sf_dir, "english_revised").write(_shared_folder(spark, "quire-revised"), buckets=STREAM_BUCKETS)
    return search_fast(index, Q_REVISED, "logical")


def q_search_english(spark, sf_dir):
    return search_fast(_index(spark, sf_dir, "english"), Q_ENGLISH, "logical")


def _written_english(spark, sf_dir) -> TextIndex:
    """An english index as deployed: stems are in the written postings."""
    return _index(spark, sf_dir, "english").write(_shared_folder(spark, "quire-english"), buckets=STREAM_BUCKETS)


def q_search_headline_english(spark, sf_dir):
    return search_full(_written_english(spark, sf_dir), Q_ENGLISH, "logical", semantic=False)


def q_search_semantic_english(spark, sf_dir):
    return search_full(_written_english(spark, sf_dir), Q_ENGLISH, "logical", semantic=True)


def q_file_matches_english(spark, sf_dir):
    m = file_matches(_written_english(spark, sf_dir), Q_ENGLISH, "logical")
    return m.select(*_long("file_id", "sequence_no", "s"), "term")


def q_phrase_english(spark, sf_dir):
    """A phrase over a stop word."""
    spans, _ = match(_written_english(spark, sf_dir), compile_query(spark, Q_ENGLISH_PHRASE, "phrase", "english"))
    return spans.select(*_long("file_id", "sequence_no", "s", "e"))


def q_file_matches_not(spark, sf_dir):
    m = file_matches(_index(spark, sf_dir), Q_MATCHES_NOT, "logical")
    return m.select(*_long("file_id", "sequence_no", "s"), "term")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: fast-headline corpus search on sf0.001."""
    return q_search_fast(spark, SMOKE_DIR)


def _shipped(query: Callable) -> Callable:
    """Python workers import the package from where this file lies."""

    def run(spark, sf_dir):
        env = spark.sparkContext.environment
        if _HERE not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [_HERE, env.get("PYTHONPATH", "")]))
        return query(spark, sf_dir)

    return run


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = dict(_llm.QUERIES) if _llm else {}
    if _pipeline:
        found["pipeline"] = _pipeline.run
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        **_llm_queries(),
        "fragments": q_fragments,
        "token_positions": q_token_positions,
        "lexeme_postings": q_lexeme_postings,
        "phrase_match": q_phrase_match,
        "logical_and": _frags(Q_AND),
        "logical_or": _frags(Q_OR),
        "logical_not": _frags(Q_NOT),
        "word_distance": q_word_distance,
        "distance_or": q_distance_or,
        "distance_nested": q_distance_nested,
        "matching_files": q_matching_files,
        "cover_density": q_cover_density,
        "top5_covers": q_top5_covers,
        "search_fast": q_search_fast,
        "search_fast_not": q_search_fast_not,
        "search_fast_tables": q_search_fast_tables,
        "search_headline": q_search_headline,
        "search_semantic": q_search_semantic,
        "search_headline_not": q_search_headline_not,
        "file_contents": q_file_contents,
        "file_matches": q_file_matches,
        "file_matches_not": q_file_matches_not,
        "file_matches_capped": q_file_matches_capped,
        "file_contents_one": q_file_contents_one,
        "file_matches_one": q_file_matches_one,
        "render_file_one": q_render_file_one,
        "terms_ordered": q_terms_ordered,
        "highlight_results": q_highlight_results,
        "result_count": q_result_count,
        "clean_content": q_clean_content,
        "render_file": q_render_file,
        "link_headlines": q_link_headlines,
        "parse_books_strict": q_parse_books_strict,
        "parse_books_all": q_parse_books_all,
        "parse_books_rejects": q_parse_books_rejects,
        "txt_names": q_txt_names,
        "ingest_index": q_ingest_index,
        "corpus_emptied": q_corpus_emptied,
        "index_update_kinds": q_index_update_kinds,
        "list_text_files": q_list_text_files,
        "ls_files": q_ls_files,
        "read_books": q_read_books,
        "append_books": q_append_books,
        "word_chunks": q_word_chunks,
        "word_chunks_over_all": q_word_chunks_over_all,
        "ingest_files": q_ingest_files,
        "index_upsert": q_index_upsert,
        "index_delete": q_index_delete,
        "index_stream": q_index_stream,
        "index_stream_versions": q_index_stream_versions,
        "index_changes": q_index_changes,
        "english_vocabulary": q_english_vocabulary,
        "search_english": q_search_english,
        "english_revised_vocabulary": q_english_revised_vocabulary,
        "search_english_revised": q_search_english_revised,
        "search_headline_english": q_search_headline_english,
        "search_semantic_english": q_search_semantic_english,
        "file_matches_english": q_file_matches_english,
        "phrase_english": q_phrase_english,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        **(_llm.ORACLE_SQL if _llm else {}),
        **({"pipeline": _pipeline.ORACLE_SQL} if _pipeline and _pipeline.ORACLE_SQL else {}),
        "fragments": O.FRAGMENTS,
        "token_positions": O.TOKEN_POSITIONS,
        "lexeme_postings": O.LEXEME_POSTINGS,
        "phrase_match": O.PHRASE_MATCH,
        "logical_and": O.LOGICAL_AND,
        "logical_or": O.LOGICAL_OR,
        "logical_not": O.LOGICAL_NOT,
        "word_distance": O.WORD_DISTANCE,
        "distance_or": O.DISTANCE_OR,
        "distance_nested": O.DISTANCE_NESTED,
        "matching_files": O.MATCHING_FILES,
        "cover_density": O.COVER_DENSITY,
        "top5_covers": O.TOP5_COVERS,
        "search_fast": O.SEARCH_FAST,
        "search_fast_not": O.SEARCH_FAST_NOT,
        "search_fast_tables": O.SEARCH_FAST,
        "search_headline": O.SEARCH_HEADLINE,
        "search_semantic": O.SEARCH_SEMANTIC,
        "search_headline_not": O.SEARCH_HEADLINE_NOT,
        "file_contents": O.FILE_CONTENTS,
        "file_matches": O.FILE_MATCHES,
        "file_matches_not": O.FILE_MATCHES_NOT,
        "file_matches_capped": O.FILE_MATCHES_CAPPED,
        "file_contents_one": O.FILE_CONTENTS_ONE,
        "file_matches_one": O.FILE_MATCHES_ONE,
        "render_file_one": O.RENDER_FILE_ONE,
        "terms_ordered": O.TERMS_ORDERED,
        "highlight_results": O.HIGHLIGHT_RESULTS,
        "result_count": O.RESULT_COUNT,
        "clean_content": O.CLEAN_CONTENT,
        "render_file": O.RENDER_FILE,
        "link_headlines": O.LINK_HEADLINES,
        "parse_books_strict": O.PARSE_BOOKS_STRICT,
        "parse_books_all": O.PARSE_BOOKS_ALL,
        "parse_books_rejects": O.PARSE_BOOKS_REJECTS,
        "txt_names": O.TXT_NAMES,
        "ingest_index": O.INGEST_INDEX,
        "corpus_emptied": O.CORPUS_EMPTIED,
        "index_update_kinds": O.INDEX_UPDATE_KINDS,
        "list_text_files": O.LIST_TEXT_FILES,
        "ls_files": O.LS_FILES,
        "read_books": O.PARSE_BOOKS_STRICT,
        "append_books": O.APPEND_BOOKS,
        "word_chunks": O.WORD_CHUNKS,
        "word_chunks_over_all": O.WORD_CHUNKS_OVER_ALL,
        "ingest_files": O.INGEST_FILES,
        "index_upsert": O.INDEX_UPSERT,
        "index_delete": O.INDEX_DELETE,
        "index_stream": O.INDEX_STREAM,
        "index_stream_versions": O.INDEX_STREAM_VERSIONS,
        "index_changes": O.INDEX_CHANGES,
        "english_vocabulary": O.ENGLISH_VOCABULARY,
        "search_english": O.SEARCH_ENGLISH,
        "english_revised_vocabulary": O.ENGLISH_REVISED_VOCABULARY,
        "search_english_revised": O.SEARCH_ENGLISH_REVISED,
        "search_headline_english": O.SEARCH_HEADLINE_ENGLISH,
        "search_semantic_english": O.SEARCH_SEMANTIC_ENGLISH,
        "file_matches_english": O.FILE_MATCHES_ENGLISH,
        "phrase_english": O.PHRASE_ENGLISH,
    }
