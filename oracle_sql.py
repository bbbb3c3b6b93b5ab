"""DuckDB SQL that recomputes each registered query from the driver tables.

Written independently of the Spark plans: tokens and positions by unnest and
row numbers, phrases and word distances by self-joins, negated operands by
NOT EXISTS, fragment covers by their definition (minimal intervals holding the
query, checked on every candidate pair), headlines by row-wise string
aggregation, whole-book headlines (E2/E3) on books re-tokenized here (covers by
running maxima over end positions), Porter rules rendered as SQL lambdas.
Tables are the driver's pre-registered views.
"""

from __future__ import annotations

# Fixed values shared with the Spark side (see quire.functions.text).
FRAGMENT_TOKENS = 100
WORD = r"[\p{L}\p{N}]"
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


FILES = """
  SELECT CAST(doc_id AS BIGINT) AS file_id,
         source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS filename,
         split_part(text, chr(10), 1) AS title, source AS author, text AS content
  FROM documents"""


def base(max_tokens: int | None = FRAGMENT_TOKENS, files_sql: str = FILES) -> str:
    """CTEs: files, raw tokens, word tokens with (sequence_no, pos, lexeme), postings."""
    k = "0" if max_tokens is None else f"(i - 1) // {int(max_tokens)}"
    return f"""
files AS ({files_sql}),
raw AS MATERIALIZED (
  SELECT file_id, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS i
  FROM (SELECT file_id, regexp_extract_all(content, '[^ \\t\\n\\x0B\\f\\r]+') AS toks FROM files)),
rawk AS (SELECT file_id, {k} AS k, i, tok FROM raw),
tok AS MATERIALIZED (
  SELECT file_id,
         CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY k) AS BIGINT) AS sequence_no,
         CAST(row_number() OVER (PARTITION BY file_id, k ORDER BY i) AS BIGINT) AS pos,
         k, tok,
         regexp_replace(lower(tok), '{EDGE}', '', 'g') AS lexeme
  FROM rawk WHERE regexp_matches(tok, '{WORD}')),
frag AS MATERIALIZED (
  SELECT DISTINCT file_id, sequence_no, k FROM tok),
post AS (SELECT lexeme, file_id, sequence_no, pos FROM tok)"""


def with_base(body: str, max_tokens: int | None = FRAGMENT_TOKENS, files_sql: str = FILES) -> str:
    return "WITH RECURSIVE " + base(max_tokens, files_sql) + ",\n" + body


FRAGMENTS = with_base("""
fr AS (
  SELECT f.file_id, f.sequence_no, string_agg(r.tok, ' ' ORDER BY r.i) AS content
  FROM frag f JOIN rawk r ON r.file_id = f.file_id AND r.k = f.k
  GROUP BY f.file_id, f.sequence_no),
wd AS (
  SELECT file_id, sequence_no, count(*) AS n_words, string_agg(tok, ' ' ORDER BY pos) AS words
  FROM tok GROUP BY file_id, sequence_no)
SELECT fr.file_id, fr.sequence_no, CAST(wd.n_words AS BIGINT) AS n_words, wd.words, fr.content
FROM fr JOIN wd USING (file_id, sequence_no)
""")

TOKEN_POSITIONS = with_base("""
x AS (SELECT 1)
SELECT file_id, sequence_no, pos, tok AS token, lexeme FROM tok
""")

LEXEME_POSTINGS = with_base("""
x AS (SELECT 1)
SELECT lexeme, file_id, sequence_no, pos FROM post
""")

# phrase "of the": consecutive positions
PHRASE_MATCH = with_base("""
x AS (SELECT 1)
SELECT file_id, sequence_no, pos AS s, pos + 1 AS e
FROM (SELECT *, lead(lexeme) OVER (PARTITION BY file_id, sequence_no ORDER BY pos) AS nxt FROM post)
WHERE lexeme = 'of' AND nxt = 'the'
""")


def has(lexeme: str, alias: str = "f") -> str:
    return (
        f"EXISTS (SELECT 1 FROM post p WHERE p.file_id = {alias}.file_id "
        f"AND p.sequence_no = {alias}.sequence_no AND p.lexeme = '{lexeme}')"
    )


def frags_where(cond: str) -> str:
    return with_base(f"""
x AS (SELECT 1)
SELECT f.file_id, f.sequence_no FROM frag f WHERE {cond}
""")


LOGICAL_AND = frags_where(f"{has('the')} AND {has('of')}")
LOGICAL_OR = frags_where(f"{has('der')} OR {has('die')}")
LOGICAL_NOT = frags_where(f"NOT {has('the')}")

# "of <2> the": 'the' exactly two positions after 'of'
WORD_DISTANCE = with_base("""
x AS (SELECT 1)
SELECT file_id, sequence_no, pos AS s, pos + 2 AS e
FROM (SELECT *, lead(lexeme, 2) OVER (PARTITION BY file_id, sequence_no ORDER BY pos) AS nxt FROM post)
WHERE lexeme = 'of' AND nxt = 'the'
""")

# "(of <-> the) & !and": books with a fragment holding the phrase and no 'and'
MATCHING_FILES = with_base(f"""
ph AS (
  SELECT DISTINCT a.file_id, a.sequence_no FROM post a JOIN post b
    ON a.file_id = b.file_id AND a.sequence_no = b.sequence_no AND b.pos = a.pos + 1
  WHERE a.lexeme = 'of' AND b.lexeme = 'the')
SELECT DISTINCT f.file_id FROM ph f WHERE NOT {has('and')}
""")


# --- covers by definition ---------------------------------------------------
def covers_sql(atoms: dict[str, str], holds: str, frags: str = "frag") -> str:
    """CTEs ``sp`` (atom spans), ``cov`` (minimal covers with density).

    ``atoms``: name -> SQL selecting (file_id, sequence_no, s, e) spans.
    ``holds``: boolean SQL over ``IN_<name>`` placeholders, true when the
    interval [:s, :e] holds the query; it is evaluated for [s,e], [s+1,e], [s,e-1].
    """
    sp = " UNION ALL ".join(f"SELECT '{n}' AS atom, * FROM ({q})" for n, q in atoms.items())

    def inside(lo: str, hi: str) -> str:
        expr = holds
        for n in atoms:
            expr = expr.replace(
                f"IN_{n}",
                f"EXISTS (SELECT 1 FROM sp x WHERE x.atom = '{n}' AND x.file_id = c.file_id "
                f"AND x.sequence_no = c.sequence_no AND x.s >= {lo} AND x.e <= {hi})",
            )
        return f"({expr})"

    return f"""
sp AS MATERIALIZED ({sp}),
cand AS (
  SELECT DISTINCT a.file_id, a.sequence_no, a.s, b.e
  FROM sp a JOIN sp b ON a.file_id = b.file_id AND a.sequence_no = b.sequence_no AND a.s <= b.e),
cov AS MATERIALIZED (
  SELECT c.file_id, c.sequence_no, c.s, c.e,
         16.0 / greatest(16, c.e - c.s + 1) AS density
  FROM cand c
  WHERE {inside('c.s', 'c.e')} AND NOT {inside('c.s + 1', 'c.e')} AND NOT {inside('c.s', 'c.e - 1')})"""


def term_spans(lexeme: str) -> str:
    return f"SELECT file_id, sequence_no, pos AS s, pos AS e FROM post WHERE lexeme = '{lexeme}'"


def phrase_spans(*lexemes: str) -> str:
    first = lexemes[0]
    joins = " ".join(
        f"JOIN post p{i} ON p{i}.file_id = p0.file_id AND p{i}.sequence_no = p0.sequence_no "
        f"AND p{i}.pos = p0.pos + {i} AND p{i}.lexeme = '{lx}'"
        for i, lx in enumerate(lexemes)
        if i > 0
    )
    return (
        f"SELECT p0.file_id, p0.sequence_no, p0.pos AS s, p0.pos + {len(lexemes) - 1} AS e "
        f"FROM post p0 {joins} WHERE p0.lexeme = '{first}'"
    )


COVER_DENSITY = with_base(
    covers_sql({"the": term_spans("the"), "of": term_spans("of")}, "IN_the AND IN_of")
    + """
SELECT file_id, sequence_no, s, e, round(density, 6) AS density FROM cov
"""
)

TOP_ORDER = "density DESC NULLS FIRST, (e - s) ASC NULLS FIRST, sequence_no ASC, s ASC NULLS FIRST"

TOP5_COVERS = with_base(
    covers_sql({"the": term_spans("the"), "of": term_spans("of")}, "IN_the AND IN_of")
    + f""",
m AS (SELECT f.file_id, f.sequence_no FROM frag f WHERE {has('the')} AND {has('of')}),
r AS (SELECT m.file_id, m.sequence_no, c.s, c.e, c.density FROM m LEFT JOIN cov c USING (file_id, sequence_no))
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY {TOP_ORDER}) AS BIGINT) AS rn,
       sequence_no, s, e, round(density, 6) AS density
FROM r QUALIFY rn <= 5
"""
)


def apart_sql(rows: str, order: str) -> str:
    """CTE ``top``: the greedy choice, pick by pick: the best cover first, then always the
    next in rank whose window overlaps none of those picked, five at most."""
    return f"""
rk AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY {order}) AS rk,
         greatest(1, CASE WHEN e - s + 1 >= 15 THEN s ELSE s - (15 - (e - s + 1)) // 2 END) AS wa,
         CASE WHEN e - s + 1 >= 15 THEN least(e, s + 34) ELSE s - (15 - (e - s + 1)) // 2 + 14 END AS wz
  FROM {rows}),
pick(file_id, round, rk, taken) AS (
  SELECT file_id, 1, rk, [{{'q': sequence_no, 'a': wa, 'z': wz}}] FROM rk WHERE rk = 1
  UNION ALL
  SELECT p.file_id, p.round + 1, min(c.rk), list_append(p.taken, arg_min({{'q': c.sequence_no, 'a': c.wa, 'z': c.wz}}, c.rk))
  FROM pick p JOIN rk c ON c.file_id = p.file_id AND c.rk > p.rk
  WHERE p.round < 5 AND (c.s IS NULL OR len(list_filter(p.taken, lambda t: t.a IS NOT NULL AND t.q = c.sequence_no AND t.a <= c.wz AND c.wa <= t.z)) = 0)
  GROUP BY p.file_id, p.round, p.taken),
top AS (SELECT rk.*, p.round AS rn FROM pick p JOIN rk USING (file_id, rk)),"""


def headline_sql(match_cond: str, atoms: dict[str, str], holds: str, english: bool = False) -> str:
    """E1 (fast headline) for fragments matching ``match_cond`` (SQL over alias f)."""
    return (with_base_english if english else with_base)(
        covers_sql(atoms, holds)
        + f""",
m AS (SELECT f.file_id, f.sequence_no FROM frag f WHERE {match_cond}),
ms AS (SELECT sp.* FROM sp JOIN m USING (file_id, sequence_no)),
r AS (SELECT m.file_id, m.sequence_no, c.s, c.e, c.density FROM m LEFT JOIN cov c USING (file_id, sequence_no)),{apart_sql('r', TOP_ORDER)}
nl AS (SELECT file_id, sequence_no, max(pos) AS n FROM tok GROUP BY ALL),
w0 AS (
  SELECT t.file_id, t.sequence_no, t.rn, t.s, t.e, nl.n,
         CASE WHEN t.e - t.s + 1 >= 15 THEN t.s ELSE t.s - (15 - (t.e - t.s + 1)) // 2 END AS ws0
  FROM top t JOIN nl USING (file_id, sequence_no) WHERE t.s IS NOT NULL),
w AS (
  SELECT *, greatest(1, ws0) AS ws,
         least(n, CASE WHEN e - s + 1 >= 15 THEN least(e, s + 34) ELSE ws0 + 14 END) AS we
  FROM w0),
cells AS (
  SELECT w.file_id, w.rn, k.pos, k.tok, w.ws, w.we,
         EXISTS (SELECT 1 FROM ms x WHERE x.file_id = w.file_id AND x.sequence_no = w.sequence_no
                 AND x.s <= k.pos AND k.pos <= x.e) AS c0,
         EXISTS (SELECT 1 FROM ms x WHERE x.file_id = w.file_id AND x.sequence_no = w.sequence_no
                 AND x.s <= k.pos - 1 AND k.pos - 1 <= x.e) AS cp,
         EXISTS (SELECT 1 FROM ms x WHERE x.file_id = w.file_id AND x.sequence_no = w.sequence_no
                 AND x.s <= k.pos + 1 AND k.pos + 1 <= x.e) AS cn
  FROM w JOIN tok k ON k.file_id = w.file_id AND k.sequence_no = w.sequence_no AND k.pos BETWEEN w.ws AND w.we),
pc AS (
  SELECT file_id, rn,
         string_agg(CASE WHEN c0 AND (pos = ws OR NOT cp) THEN '<b>' ELSE '' END || tok
                    || CASE WHEN c0 AND (pos = we OR NOT cn) THEN '</b>' ELSE '' END, ' ' ORDER BY pos) AS piece
  FROM cells GROUP BY file_id, rn),
hl AS (
  SELECT file_id, trim(regexp_replace(string_agg(piece, ' ... ' ORDER BY rn DESC), '\\s+', ' ', 'g')) AS headline
  FROM pc GROUP BY file_id)
SELECT b.file_id, hl.headline, files.title, files.author
FROM (SELECT DISTINCT file_id FROM m) b LEFT JOIN hl USING (file_id) JOIN files USING (file_id)
"""
    )


# E1: "(of <-> the) | (was & with)"
SEARCH_FAST_ATOMS = {
    "ofthe": phrase_spans("of", "the"),
    "was": term_spans("was"),
    "with": term_spans("with"),
}
SEARCH_FAST = headline_sql(
    f"EXISTS (SELECT 1 FROM ({phrase_spans('of', 'the')}) z WHERE z.file_id = f.file_id "
    f"AND z.sequence_no = f.sequence_no) OR ({has('was')} AND {has('with')})",
    SEARCH_FAST_ATOMS,
    "IN_ofthe OR (IN_was AND IN_with)",
)


# --- whole-book headlines (E2 / E3) -----------------------------------------
def whole_book_sql(match_cond: str, atoms: dict[str, str], start_expr: str, words: list[str], semantic: bool) -> str:
    """Books with a fragment matching ``match_cond``; headline over the
    whole book. ``atoms`` select spans from ``wpost``; ``start_expr`` combines the
    running starts ``r_<atom>`` (AND = least when all present, OR = greatest)."""
    sp = " UNION ALL ".join(f"SELECT '{n}' AS atom, * FROM ({q})" for n, q in atoms.items())
    pe_cols = ", ".join(f"max(CASE WHEN atom = '{n}' THEN s END) AS m_{n}" for n in atoms)
    run_cols = ", ".join(f"max(m_{n}) OVER w AS r_{n}" for n in atoms)
    wl = ", ".join(f"'{w}'" for w in words)
    if semantic:
        mark = """
         EXISTS (SELECT 1 FROM wsp x WHERE x.file_id = w.file_id AND x.s <= k.pos AND k.pos <= x.e) AS c0,
         EXISTS (SELECT 1 FROM wsp x WHERE x.file_id = w.file_id AND x.s <= k.pos - 1 AND k.pos - 1 <= x.e) AS cp,
         EXISTS (SELECT 1 FROM wsp x WHERE x.file_id = w.file_id AND x.s <= k.pos + 1 AND k.pos + 1 <= x.e) AS cn"""
        cell = ("CASE WHEN c0 AND (pos = ws OR NOT cp) THEN '<b>' ELSE '' END || tok "
                "|| CASE WHEN c0 AND (pos = we OR NOT cn) THEN '</b>' ELSE '' END")
    else:
        mark = " k.lexeme IN (" + wl + ") AS c0"
        cell = "CASE WHEN c0 THEN '<b>' || tok || '</b>' ELSE tok END"
    return with_base(f"""
m AS (SELECT DISTINCT f.file_id FROM frag f WHERE {match_cond}),
wtok AS MATERIALIZED (
  SELECT r.file_id, CAST(row_number() OVER (PARTITION BY r.file_id ORDER BY r.i) AS BIGINT) AS pos, r.tok,
         regexp_replace(lower(r.tok), '{EDGE}', '', 'g') AS lexeme
  FROM raw r JOIN m USING (file_id) WHERE regexp_matches(r.tok, '{WORD}')),
wpost AS (SELECT lexeme, file_id, 1 AS sequence_no, pos FROM wtok),
wsp AS MATERIALIZED ({sp}),
pe AS (SELECT file_id, e, {pe_cols} FROM wsp GROUP BY file_id, e),
run AS (SELECT file_id, e, {run_cols} FROM pe
        WINDOW w AS (PARTITION BY file_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
st AS (SELECT file_id, e, {start_expr} AS s FROM run),
cv AS (SELECT file_id, s, e, 16.0 / greatest(16, e - s + 1) AS density
       FROM (SELECT *, lag(s) OVER (PARTITION BY file_id ORDER BY e) AS prev FROM st)
       WHERE s IS NOT NULL AND (prev IS NULL OR s > prev)),
r AS (SELECT m.file_id, 1 AS sequence_no, cv.s, cv.e, cv.density FROM m LEFT JOIN cv USING (file_id)),{apart_sql('r', TOP_ORDER)}
nl AS (SELECT file_id, max(pos) AS n FROM wtok GROUP BY file_id),
w0 AS (SELECT t.file_id, t.rn, t.s, t.e, nl.n,
              CASE WHEN t.e - t.s + 1 >= 15 THEN t.s ELSE t.s - (15 - (t.e - t.s + 1)) // 2 END AS ws0
       FROM top t JOIN nl USING (file_id)),
w AS (SELECT *, CASE WHEN s IS NULL THEN 1 ELSE greatest(1, ws0) END AS ws,
             CASE WHEN s IS NULL THEN least(n, 15)
                  ELSE least(n, CASE WHEN e - s + 1 >= 15 THEN least(e, s + 34) ELSE ws0 + 14 END) END AS we
      FROM w0),
cells AS (SELECT w.file_id, w.rn, w.s AS cs, k.pos, k.tok, w.ws, w.we, {mark}
          FROM w JOIN wtok k ON k.file_id = w.file_id AND k.pos BETWEEN w.ws AND w.we),
pc AS (SELECT file_id, rn, coalesce(min(cs), 0) AS o, string_agg({cell}, ' ' ORDER BY pos) AS piece
       FROM cells GROUP BY file_id, rn),
hl AS (SELECT file_id, trim(regexp_replace(string_agg(piece, ' ... ' ORDER BY o), '\\s+', ' ', 'g')) AS headline
       FROM pc GROUP BY file_id)
SELECT files.file_id, files.filename, files.title, files.author, hl.headline
FROM m JOIN files USING (file_id) LEFT JOIN hl USING (file_id)
""")


def wterm(lexeme: str) -> str:
    return f"SELECT file_id, sequence_no, pos AS s, pos AS e FROM wpost WHERE lexeme = '{lexeme}'"


def wphrase(*lexemes: str) -> str:
    return phrase_spans(*lexemes).replace("post ", "wpost ")


# "(of <-> the) & this"
_FULL_MATCH = (
    f"EXISTS (SELECT 1 FROM ({phrase_spans('of', 'the')}) z WHERE z.file_id = f.file_id "
    f"AND z.sequence_no = f.sequence_no) AND {has('this')}"
)
_FULL_ATOMS = {"ofthe": wphrase("of", "the"), "this": wterm("this")}
_FULL_START = "CASE WHEN r_ofthe IS NOT NULL AND r_this IS NOT NULL THEN least(r_ofthe, r_this) END"
SEARCH_HEADLINE = whole_book_sql(_FULL_MATCH, _FULL_ATOMS, _FULL_START, ["of", "the", "this"], False)
SEARCH_SEMANTIC = whole_book_sql(_FULL_MATCH, _FULL_ATOMS, _FULL_START, ["of", "the", "this"], True)

FILE_CONTENTS = with_base("""
x AS (SELECT 1)
SELECT file_id, filename, title, author, content FROM files
""")

# "(of <-> the) | with": passages per fragment, first 50 by position
FILE_MATCHES = with_base(f"""
sp AS (SELECT * FROM ({phrase_spans('of', 'the')}) UNION ALL SELECT * FROM ({term_spans('with')})),
d AS (SELECT DISTINCT file_id, sequence_no, s, e FROM sp),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, sequence_no ORDER BY s, e) AS rn FROM d QUALIFY rn <= 50)
SELECT r.file_id, r.sequence_no, r.s,
       trim(regexp_replace(string_agg(t.tok, ' ' ORDER BY t.pos), '\\s+', ' ', 'g')) AS term
FROM r JOIN tok t ON t.file_id = r.file_id AND t.sequence_no = r.sequence_no AND t.pos BETWEEN r.s AND r.e
GROUP BY r.file_id, r.sequence_no, r.s, r.e
""")


# --- presentation (P1-P5, E7, E8) ----------------------------------------------
_MATCH_TERMS = f"""
sp AS (SELECT * FROM ({phrase_spans('of', 'the')}) UNION ALL SELECT * FROM ({term_spans('with')})),
d AS (SELECT DISTINCT file_id, sequence_no, s, e FROM sp),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, sequence_no ORDER BY s, e) AS rn FROM d QUALIFY rn <= 50),
mt AS (
  SELECT r.file_id, trim(regexp_replace(string_agg(t.tok, ' ' ORDER BY t.pos), '\\s+', ' ', 'g')) AS term
  FROM r JOIN tok t ON t.file_id = r.file_id AND t.sequence_no = r.sequence_no AND t.pos BETWEEN r.s AND r.e
  GROUP BY r.file_id, r.sequence_no, r.s, r.e),
dt AS (SELECT DISTINCT file_id, term FROM mt WHERE term IS NOT NULL),
tl AS (SELECT file_id, list(term ORDER BY length(term) DESC, term) AS terms FROM dt GROUP BY file_id)"""

# The html of the presentation, as SQL string content ('' is one quote).
_MARK = "<span class=''search-result''>"
_DIV = "<div class=''chapter-title''>"
_LINK = "<a class=''file-link'' href=''#file/"
_LINK_CLOSE = "''>"


def highlight_sql(terms: str, content: str) -> str:
    return (
        f"list_reduce({terms}, lambda acc, t: replace(acc, ' ' || t, "
        f"' {_MARK}' || trim(t) || '</span> '), {content})"
    )


def count_sql(h: str) -> str:
    return f"CAST((length({h}) - length(replace({h}, '{_MARK}', ''))) / length('{_MARK}') AS BIGINT)"


TERMS_ORDERED = with_base(_MATCH_TERMS + """
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY length(term) DESC, term) AS BIGINT) AS term_rank,
       term
FROM dt
""")

HIGHLIGHT_RESULTS = with_base(_MATCH_TERMS + f"""
SELECT f.file_id, {highlight_sql('tl.terms', 'f.content')} AS html FROM files f JOIN tl USING (file_id)
""")

RESULT_COUNT = with_base(_MATCH_TERMS + f""",
h AS (SELECT f.file_id, {highlight_sql('tl.terms', 'f.content')} AS html FROM files f JOIN tl USING (file_id))
SELECT file_id, {count_sql('html')} AS n_results FROM h
""")

JS_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CHAPTER = r"\n[Cc][Hh][Aa][Pp][Tt][Ee][Rr]" + JS_SPACE + r"[^\n]+"


def clean_sql(col: str) -> str:
    return (
        f"replace(regexp_replace({col}, '{CHAPTER}', '{_DIV}\\0</div>', 'g'), "
        f"chr(10) || chr(13), chr(10) || '&nbsp;<br>&nbsp;<br>')"
    )


CRLF = "chr(13) || chr(10)"
CHAPTER_LINE = f"CASE WHEN file_id % 11 = 1 THEN {CRLF} || 'Chapter 7: ' || title || {CRLF} || 'CHAPTER' || {CRLF} ELSE '' END"
CRLF_BODY = f"'Title: ' || title || {CRLF} || {CRLF} || replace(content, chr(10), {CRLF}) || {CHAPTER_LINE}"

CLEAN_CONTENT = with_base(f"""
x AS (SELECT 1)
SELECT file_id, {clean_sql(CRLF_BODY)} AS html FROM files
""")

RENDER_FILE = with_base(_MATCH_TERMS + f""",
c AS (SELECT f.file_id, {clean_sql('f.content')} AS cleaned, tl.terms FROM files f LEFT JOIN tl USING (file_id)),
h AS (SELECT file_id, CASE WHEN len(coalesce(terms, [])) > 0 THEN {highlight_sql('terms', 'cleaned')}
                          ELSE cleaned END AS html FROM c)
SELECT file_id, html, {count_sql('html')} AS n_results FROM h
""")

LINK_HEADLINES = SEARCH_FAST.replace(
    "SELECT b.file_id, hl.headline, files.title, files.author",
    "SELECT b.file_id, replace(replace(hl.headline, '<b>', "
    f"'{_LINK}' || CAST(b.file_id AS VARCHAR) || '{_LINK_CLOSE}'), '</b>', '</a>') AS headline, files.title, files.author",
)

# --- ingest (S4-S13, E6) ---------------------------------------------------------
RAW_BOOKS = f"""
rb AS (
  SELECT file_id, filename AS path,
         'Title: ' || title || {CRLF}
         || CASE WHEN file_id % 11 = 5 THEN 'Title: Another ' || title || {CRLF} ELSE '' END
         || CASE WHEN file_id % 11 <> 7 THEN 'Author: ' || author || {CRLF} ELSE '' END
         || CASE WHEN file_id % 11 = 3 THEN 'Author: Also ' || author || {CRLF} ELSE '' END || {CRLF}
         || '*** START OF THE PROJECT GUTENBERG EBOOK ' || upper(title) || ' ***' || {CRLF}
         || replace(content, chr(10), {CRLF}) || {CRLF}
         || '*** END OF THE PROJECT GUTENBERG EBOOK ' || upper(title) || ' ***' || {CRLF}
         || CASE WHEN file_id % 11 = 9 AND NOT contains(title, 'ß') THEN {CRLF} || '*** END OF THE PROJECT GUTENBERG EBOOK ' || upper(title) || ' ***' || {CRLF} ELSE '' END AS value
  FROM files),
pt AS (
  SELECT path, value,
         nullif(regexp_extract(value, 'Title: ([^\\r\\n]+)[\\r\\n]', 1), '') AS title,
         nullif(regexp_extract(value, 'Author: ([^\\r\\n]+)[\\r\\n]', 1), '') AS author
  FROM rb),
pb AS (
  SELECT path, string_split(path, '/')[-1] AS filename, title, author,
         nullif(regexp_extract(value,
           '(?s)\\*\\*\\* START OF THE PROJECT GUTENBERG EBOOK \\Q' || upper(title)
           || '\\E \\*\\*\\*(.+)\\*\\*\\* END OF THE PROJECT GUTENBERG EBOOK \\Q'
           || upper(title) || '\\E \\*\\*\\*', 1), '') AS content
  FROM pt),
books AS (SELECT * FROM pb WHERE title IS NOT NULL AND author IS NOT NULL AND content IS NOT NULL)"""

PARSE_BOOKS_STRICT = with_base(RAW_BOOKS + """
SELECT filename, title, author, content FROM books
""")

PARSE_BOOKS_REJECTS = with_base(RAW_BOOKS + """
SELECT path, CASE WHEN title IS NULL THEN 'no title' WHEN author IS NULL THEN 'no author' ELSE 'no body' END AS reason
FROM pb WHERE title IS NULL OR author IS NULL OR content IS NULL
""")

_BOOKS_ALL = """
SELECT rb.path AS filename, t.title, a.author, c.content
FROM rb,
     unnest(regexp_extract_all(rb.value, 'Title: ([^\\r]+)', 1)) AS t(title),
     unnest(regexp_extract_all(rb.value, 'Author: ([^\\r]+)', 1)) AS a(author),
     unnest(regexp_extract_all(rb.value,
       '\\*\\*\\* START OF THE PROJECT GUTENBERG EBOOK [^\\r]+\\r([\\w|\\W]+)\\*\\*\\* END OF THE PROJECT GUTENBERG EBOOK',
       1)) AS c(content)
"""
PARSE_BOOKS_ALL = with_base(RAW_BOOKS + _BOOKS_ALL)

CHUNK_WORDS = 1000
WORD_CHUNKS = with_base(RAW_BOOKS + f""",
allb AS ({_BOOKS_ALL}),
ws AS (SELECT filename, title, author, content, string_split_regex(content, '\\s') AS w FROM allb),
wi AS (SELECT filename, title, author, content, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM ws),
wn AS (SELECT filename, title, author, word,
              row_number() OVER (PARTITION BY filename ORDER BY title, author, content, i) AS wordno FROM wi),
ch AS (SELECT filename, title, max(author) AS author, wordno // {CHUNK_WORDS} AS chunk,
              string_agg(word, ' ' ORDER BY wordno) AS content
       FROM wn GROUP BY filename, title, wordno // {CHUNK_WORDS})
SELECT CAST(row_number() OVER (PARTITION BY filename ORDER BY title, chunk) AS BIGINT) AS seq_no,
       filename, title, author, content
FROM ch
""")

# S13 with one numbering over all files, in order of their names
WORD_CHUNKS_OVER_ALL = WORD_CHUNKS.replace(
    "OVER (PARTITION BY filename ORDER BY title, author, content, i)", "OVER (ORDER BY filename, title, author, content, i)"
)

INGEST_FILES = with_base(RAW_BOOKS + """
SELECT CAST(row_number() OVER (ORDER BY filename) AS BIGINT) AS file_id, filename, title, author, content FROM books
""")

# The postings of the ingested books
INGEST_INDEX = with_base("""
x AS (SELECT 1)
SELECT lexeme, file_id, sequence_no, pos FROM post
""", files_sql=INGEST_FILES)

# S3: every other name ends in another way; '.' is any character
TXT_NAMES = """
SELECT name FROM (
  SELECT CASE doc_id % 4 WHEN 0 THEN source || '/' || doc_id || '.txt' WHEN 1 THEN source || '/' || doc_id || '.md'
                         WHEN 2 THEN source || '/' || doc_id || '_txt.old' ELSE source || '/txt' || doc_id END AS name
  FROM documents)
WHERE regexp_matches(name, '.txt')
"""

# Every book's file
LIST_TEXT_FILES = "SELECT source || '/' || doc_id || '.txt' AS name FROM documents"

# Those whose id ends in 1, in order of their path
LS_FILES = """
SELECT source || '/' || doc_id || '.txt' AS name,
       row_number() OVER (ORDER BY 'shelf=' || source || '/book=' || doc_id || '.txt/') AS file_rank
FROM documents WHERE doc_id % 10 = 1
"""

# A first load of two thirds, then one that overlaps it
APPEND_BOOKS = with_base(RAW_BOOKS + """,
ids AS (SELECT f.file_id AS old_id, b.* FROM books b JOIN files f ON f.filename LIKE '%/' || b.filename),
one AS (SELECT row_number() OVER (ORDER BY filename) AS file_id, filename, title, author, content FROM ids WHERE old_id % 3 <> 0),
two AS (SELECT (SELECT max(file_id) FROM one) + row_number() OVER (ORDER BY filename) AS file_id, filename, title, author, content FROM ids WHERE old_id % 3 = 0)
SELECT * FROM one UNION ALL SELECT * FROM two
""")

# What was there, and that nothing is left
CORPUS_EMPTIED = with_base("""
x AS (SELECT 1)
SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM (SELECT DISTINCT file_id, sequence_no FROM tok)) AS n_fragments,
       (SELECT count(*) FROM post) AS n_postings, 'before' AS moment
UNION ALL SELECT 0, 0, 0, 'after'
""")

# single-book forms: the English book of the smallest id
_ONE = "(SELECT min(doc_id) FROM documents WHERE lang = 'en')"
FILE_CONTENTS_ONE = with_base(f"""
x AS (SELECT 1)
SELECT filename, title, author, content FROM files WHERE file_id = {_ONE}
""")
FILE_MATCHES_ONE = f"SELECT term FROM ({FILE_MATCHES}) WHERE file_id = {_ONE}"
RENDER_FILE_ONE = f"SELECT * FROM ({RENDER_FILE}) WHERE file_id = {_ONE}"

# --- upkeep (T8, T10) --------------------------------------------------------------
UPDATED_FILES = """
  SELECT f.file_id, f.filename, f.title, f.author,
         CASE WHEN f.file_id IN (SELECT doc_id FROM labels WHERE quality = 0)
              THEN f.title || chr(10) || f.content ELSE f.content END AS content
  FROM (""" + FILES + """) f"""

# every kind of change: texts, titles, the same again, new books
NEW_BOOKS = 10_000_000
CHANGED_FILES = f"""
  SELECT f.file_id, f.filename, CASE WHEN l.doc_id IS NULL AND f.file_id % 5 = 1 THEN 'Renamed ' || f.title ELSE f.title END AS title,
         f.author, CASE WHEN l.doc_id IS NULL THEN f.content ELSE f.title || chr(10) || f.content END AS content
  FROM ({FILES}) f LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l ON l.doc_id = f.file_id
  UNION ALL SELECT f.file_id + {NEW_BOOKS}, f.filename, f.title, f.author, f.content FROM ({FILES}) f WHERE f.file_id % 10 = 3"""

INDEX_UPDATE_KINDS = with_base("""
wd AS (SELECT file_id, sequence_no, count(*) AS n_words, string_agg(tok, ' ' ORDER BY pos) AS words
       FROM tok GROUP BY file_id, sequence_no),
np AS (SELECT file_id, sequence_no, count(*) AS n_postings FROM post GROUP BY file_id, sequence_no)
SELECT wd.file_id, wd.sequence_no, files.title, wd.n_words, wd.words, np.n_postings
FROM wd JOIN files USING (file_id) JOIN np ON np.file_id = wd.file_id AND np.sequence_no = wd.sequence_no
""", files_sql=CHANGED_FILES)

INDEX_UPSERT = with_base("""
wd AS (SELECT file_id, sequence_no, count(*) AS n_words, string_agg(tok, ' ' ORDER BY pos) AS words
       FROM tok GROUP BY file_id, sequence_no)
SELECT file_id, sequence_no, CAST(n_words AS BIGINT) AS n_words, words FROM wd
""", files_sql=UPDATED_FILES)

INDEX_DELETE = with_base("""
wd AS (SELECT file_id, sequence_no, count(*) AS n_words FROM tok GROUP BY file_id, sequence_no)
SELECT file_id, sequence_no, CAST(n_words AS BIGINT) AS n_words FROM wd
WHERE file_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")

# The streamed index holds the fragments of every document
INDEX_STREAM = with_base("""
wd AS (SELECT file_id, sequence_no, count(*) AS n_words, string_agg(tok, ' ' ORDER BY pos) AS words
       FROM tok GROUP BY file_id, sequence_no)
SELECT file_id, sequence_no, CAST(n_words AS BIGINT) AS n_words, words FROM wd
""")


# --- english configuration (T6): Porter (1980) rules rendered as DuckDB SQL -----------
# --- Fixed values: Spark's default English stop words
# (pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")), 181 words.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd",
    "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've",
    "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't",
    "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't",
    "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's",
    "where's", "who's", "why's", "would",
)

# --- Fixed values: Porter (1980) suffix rules, as (suffix, replacement, condition).
# Conditions: "" none, "m>0", "m>1", "*v*" (stem has a vowel), "ion" (m>1 and stem ends s/t).
STEP_1A = (("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", ""))
STEP_1C = (("y", "i", "*v*"),)
STEP_2 = (
    ("ational", "ate", "m>0"), ("tional", "tion", "m>0"), ("enci", "ence", "m>0"), ("anci", "ance", "m>0"),
    ("izer", "ize", "m>0"), ("abli", "able", "m>0"), ("alli", "al", "m>0"), ("entli", "ent", "m>0"),
    ("eli", "e", "m>0"), ("ousli", "ous", "m>0"), ("ization", "ize", "m>0"), ("ation", "ate", "m>0"),
    ("ator", "ate", "m>0"), ("alism", "al", "m>0"), ("iveness", "ive", "m>0"), ("fulness", "ful", "m>0"),
    ("ousness", "ous", "m>0"), ("aliti", "al", "m>0"), ("iviti", "ive", "m>0"), ("biliti", "ble", "m>0"),
)
STEP_3 = (
    ("icate", "ic", "m>0"), ("ative", "", "m>0"), ("alize", "al", "m>0"), ("iciti", "ic", "m>0"),
    ("ical", "ic", "m>0"), ("ful", "", "m>0"), ("ness", "", "m>0"),
)
STEP_4 = (
    ("al", "", "m>1"), ("ance", "", "m>1"), ("ence", "", "m>1"), ("er", "", "m>1"), ("ic", "", "m>1"),
    ("able", "", "m>1"), ("ible", "", "m>1"), ("ant", "", "m>1"), ("ement", "", "m>1"), ("ment", "", "m>1"),
    ("ent", "", "m>1"), ("ion", "", "ion"), ("ou", "", "m>1"), ("ism", "", "m>1"), ("ate", "", "m>1"),
    ("iti", "", "m>1"), ("ous", "", "m>1"), ("ive", "", "m>1"), ("ize", "", "m>1"),
)
# Step 1b: (m>0) eed -> ee; (*v*) ed -> ; (*v*) ing -> ; after ed/ing: at -> ate, bl -> ble,
# iz -> ize, a double consonant other than l/s/z loses one letter, (m=1 and *o) adds e.
STEP_1B_TAILS = (("at", "ate"), ("bl", "ble"), ("iz", "ize"))
DOUBLE_CONSONANT = "(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|zz)$"
MIN_STEM_LENGTH = 3  # words of one or two letters are left as they are


class _Vars:
    n = 0

    @classmethod
    def new(cls) -> str:
        cls.n += 1
        return f"v{cls.n}"


def _cv_sql(x: str) -> str:
    p = f"regexp_replace({x}, '[aeiou]', 'V', 'g')"
    p = f"regexp_replace({p}, '[^Vy]', 'C', 'g')"
    p = f"regexp_replace({p}, '^y', 'C')"
    p = f"regexp_replace({p}, 'Cy', 'CV', 'g')"
    return f"regexp_replace({p}, 'y', 'C', 'g')"


def _m_sql(p: str) -> str:
    c = f"regexp_replace(regexp_replace({p}, 'C+', 'C', 'g'), 'V+', 'V', 'g')"
    return f"CAST((length({c}) - length(replace({c}, 'VC', ''))) / 2 AS INTEGER)"


def _cut_sql(s: str, k: int) -> str:
    return f"substr({s}, 1, length({s}) - {k})"


def _cvc_sql(stem: str, pstem: str) -> str:
    return f"(regexp_matches({pstem}, 'CVC$') AND NOT regexp_matches({stem}, '[wxy]$'))"


def _cond_sql(cond: str, stem: str, pstem: str) -> str:
    return {
        "": "TRUE",
        "m>0": f"{_m_sql(pstem)} > 0",
        "m>1": f"{_m_sql(pstem)} > 1",
        "*v*": f"contains({pstem}, 'V')",
        "ion": f"({_m_sql(pstem)} > 1 AND regexp_matches({stem}, '[st]$'))",
    }[cond]


def _let_sql(x: str, body) -> str:
    """``body(w, p)`` with ``x`` and its C/V pattern bound once (lambda variables)."""
    a, b = _Vars.new(), _Vars.new()
    inner = body(f"{b}.w", f"{b}.p")
    return (
        f"list_transform([{x}], lambda {a}: list_transform([struct_pack(w := {a}, p := {_cv_sql(a)})], "
        f"lambda {b}: {inner})[1])[1]"
    )


def _rules_sql(x: str, rules) -> str:
    def body(w, p):
        parts = []
        for suffix, repl, cond in sorted(rules, key=lambda r: -len(r[0])):
            k = len(suffix)
            stem, pstem = _cut_sql(w, k), _cut_sql(p, k)
            parts.append(
                f"WHEN ends_with({w}, '{suffix}') THEN "
                f"CASE WHEN {_cond_sql(cond, stem, pstem)} THEN {stem} || '{repl}' ELSE {w} END"
            )
        return "CASE " + " ".join(parts) + f" ELSE {w} END"

    return _let_sql(x, body)


def _step1b_sql(x: str) -> str:
    def tidy(s: str, ps: str) -> str:
        parts = [f"WHEN ends_with({s}, '{a}') THEN {_cut_sql(s, len(a))} || '{b}'" for a, b in STEP_1B_TAILS]
        parts.append(
            f"WHEN regexp_matches({s}, '{DOUBLE_CONSONANT}') AND NOT regexp_matches({s}, '[lsz]$') "
            f"THEN {_cut_sql(s, 1)}"
        )
        parts.append(f"WHEN {_m_sql(ps)} = 1 AND {_cvc_sql(s, ps)} THEN {s} || 'e'")
        return "CASE " + " ".join(parts) + f" ELSE {s} END"

    def body(w, p):
        s3, p3, s2, p2 = _cut_sql(w, 3), _cut_sql(p, 3), _cut_sql(w, 2), _cut_sql(p, 2)
        return (
            f"CASE WHEN ends_with({w}, 'eed') THEN CASE WHEN {_m_sql(p3)} > 0 THEN {s3} || 'ee' ELSE {w} END "
            f"WHEN ends_with({w}, 'ed') THEN CASE WHEN contains({p2}, 'V') THEN {tidy(s2, p2)} ELSE {w} END "
            f"WHEN ends_with({w}, 'ing') THEN CASE WHEN contains({p3}, 'V') THEN {tidy(s3, p3)} ELSE {w} END "
            f"ELSE {w} END"
        )

    return _let_sql(x, body)


def _step5_sql(x: str) -> str:
    def drop_e(w, p):
        stem, pstem = _cut_sql(w, 1), _cut_sql(p, 1)
        m = _m_sql(pstem)
        return (
            f"CASE WHEN ends_with({w}, 'e') AND ({m} > 1 OR ({m} = 1 AND NOT {_cvc_sql(stem, pstem)})) "
            f"THEN {stem} ELSE {w} END"
        )

    def drop_l(w, p):
        return f"CASE WHEN ends_with({w}, 'll') AND {_m_sql(p)} > 1 THEN {_cut_sql(w, 1)} ELSE {w} END"

    return _let_sql(_let_sql(x, drop_e), drop_l)


def porter_sql(x: str) -> str:
    s = _rules_sql(x, STEP_1A)
    s = _step1b_sql(s)
    s = _rules_sql(s, STEP_1C)
    s = _rules_sql(s, STEP_2)
    s = _rules_sql(s, STEP_3)
    s = _rules_sql(s, STEP_4)
    s = _step5_sql(s)
    return f"CASE WHEN length({x}) >= {MIN_STEM_LENGTH} THEN {s} ELSE {x} END"


def english_sql(simple: str) -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)
    return f"CASE WHEN {simple} IN ({stops}) THEN NULL ELSE {porter_sql(simple)} END"


def with_base_english(body: str, max_tokens: int | None = FRAGMENT_TOKENS) -> str:
    """Base CTEs of the ``english`` configuration: lexemes stemmed, stop words
    without lexeme (their positions stay taken), postings without them."""
    sql = with_base(body, max_tokens)
    simple = f"regexp_replace(lower(tok), '{EDGE}', '', 'g')"
    sql = sql.replace(f"{simple} AS lexeme", f"{english_sql(simple)} AS lexeme", 1)
    return sql.replace(
        "post AS (SELECT lexeme, file_id, sequence_no, pos FROM tok)",
        "post AS (SELECT lexeme, file_id, sequence_no, pos FROM tok WHERE lexeme IS NOT NULL)",
        1,
    )


ENGLISH_VOCABULARY = with_base(f"""
v AS (SELECT DISTINCT lexeme FROM tok)
SELECT lexeme, {english_sql('lexeme')} AS stem FROM v
""")

# --- english_revised: the revised English rules, written per step with their own tables ----
# --- Fixed values: the words of the stop list end at "now"; words with a stem of their own.
REVISED_STOP_WORDS = ENGLISH_STOP_WORDS[: ENGLISH_STOP_WORDS.index("now") + 1]
REVISED_SPECIAL = (
    ("skis", "ski"), ("skies", "sky"), ("dying", "die"), ("lying", "lie"), ("tying", "tie"), ("idly", "idl"),
    ("gently", "gentl"), ("ugly", "ugli"), ("early", "earli"), ("only", "onli"), ("singly", "singl"),
    ("sky", "sky"), ("news", "news"), ("howe", "howe"), ("atlas", "atlas"), ("cosmos", "cosmos"),
    ("bias", "bias"), ("andes", "andes"),
)
REVISED_DONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# --- Fixed values: (ending, what takes its place), the longest first.
REVISED_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"),
    ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
REVISED_3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"),
    ("ness", ""), ("ful", ""),
)
REVISED_4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize",
    "al", "er", "ic",
)
_REVISED_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def revised_sql(x: str) -> str:
    """Stem of ``x`` by the revised rules, null for a stop word: a row (w, a, b) goes
    through the steps; a and b are the numbers of characters before R1 and R2."""

    def let(value: str, body) -> str:
        v = _Vars.new()
        return f"list_transform([{value}], lambda {v}: {body(v)})[1]"

    def step(row: str, body) -> str:
        return let(row, lambda v: f"struct_pack(w := {body(f'{v}.w', f'{v}.a', f'{v}.b')}, a := {v}.a, b := {v}.b)")

    def start(w: str) -> str:
        region = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'"
        return f"CASE WHEN regexp_matches({w}, {region}) THEN length(regexp_extract({w}, {region})) ELSE length({w}) END"

    def r1(w: str) -> str:
        opening = "'^(gener|commun|arsen)'"
        return f"CASE WHEN regexp_matches({w}, {opening}) THEN length(regexp_extract({w}, {opening})) ELSE {start(w)} END"

    def ends(w: str, ending: str, then: str) -> str:
        return f"WHEN ends_with({w}, '{ending}') THEN {then} "

    def swap(w: str, ending: str, new: str, where: str, before: str = "TRUE") -> str:
        n = len(ending)
        return ends(w, ending, f"CASE WHEN length({w}) - {n} >= {where} AND {before} THEN {_cut_sql(w, n)} || '{new}' ELSE {w} END")

    def step0(w, a, b):
        return f"regexp_replace({w}, '(\\x27s\\x27|\\x27s|\\x27)$', '')"

    def step1a(w, a, b):
        ie = f"CASE WHEN length({w}) > 4 THEN {_cut_sql(w, 2)} ELSE {_cut_sql(w, 1)} END"
        plain = f"CASE WHEN regexp_matches({_cut_sql(w, 2)}, '[aeiouy]') THEN {_cut_sql(w, 1)} ELSE {w} END"
        return (
            "CASE " + ends(w, "sses", _cut_sql(w, 2)) + ends(w, "ied", ie) + ends(w, "ies", ie)
            + ends(w, "us", w) + ends(w, "ss", w) + ends(w, "s", plain) + f"ELSE {w} END"
        )

    def step1b(w, a, b):
        def tidy(v: str) -> str:
            return (
                f"CASE WHEN regexp_matches({v}, '(at|bl|iz)$') THEN {v} || 'e' "
                f"WHEN regexp_matches({v}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN {_cut_sql(v, 1)} "
                f"WHEN length({v}) = {a} AND regexp_matches({v}, '{_REVISED_SHORT}') THEN {v} || 'e' ELSE {v} END"
            )

        def off(ending: str) -> str:
            x = _cut_sql(w, len(ending))
            return ends(w, ending, f"CASE WHEN regexp_matches({x}, '[aeiouy]') THEN {let(x, tidy)} ELSE {w} END")

        return (
            "CASE " + swap(w, "eedly", "ee", a) + swap(w, "eed", "ee", a) + off("ingly") + off("edly") + off("ing") + off("ed")
            + f"ELSE {w} END"
        )

    def step1c(w, a, b):
        return f"regexp_replace({w}, '^(.+[^aeiouy])[yY]$', '\\1i', 's')"

    def step2(w, a, b):
        return (
            "CASE " + "".join(swap(w, e, n, a) for e, n in REVISED_2)
            + swap(w, "ogi", "og", a, f"ends_with({w}, 'logi')")
            + swap(w, "li", "", a, f"regexp_matches({w}, '[cdeghkmnrt]li$')") + f"ELSE {w} END"
        )

    def step3(w, a, b):
        endings = [swap(w, e, n, a) for e, n in REVISED_3]
        return "CASE " + "".join([*endings, swap(w, "ative", "", b)]) + f"ELSE {w} END"

    def step4(w, a, b):
        endings = [swap(w, e, "", b) for e in REVISED_4]
        return "CASE " + "".join([*endings, swap(w, "ion", "", b, f"regexp_matches({w}, '[st]ion$')")]) + f"ELSE {w} END"

    def step5(w, a, b):
        x, n = _cut_sql(w, 1), f"length({w}) - 1"
        return (
            f"CASE WHEN ends_with({w}, 'e') AND ({n} >= {b} OR ({n} >= {a} AND NOT regexp_matches({x}, '{_REVISED_SHORT}'))) "
            f"OR ends_with({w}, 'll') AND {n} >= {b} THEN {x} ELSE {w} END"
        )

    def later(v: str) -> str:
        row = v
        for body in (step1b, step1c, step2, step3, step4, step5):
            row = step(row, body)
        done = ", ".join(f"'{w}'" for w in REVISED_DONE)
        return f"CASE WHEN {v}.w IN ({done}) THEN {v}.w ELSE ({row}).w END"

    def within(w: str) -> str:
        def pack(a: str) -> str:
            behind = let(f"substr({w}, {a} + 1)", start)
            return f"struct_pack(w := {w}, a := {a}, b := {a} + {behind})"

        return let(step(step(let(r1(w), pack), step0), step1a), later)

    def stemmed(w: str) -> str:
        own = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REVISED_SPECIAL)
        marked = f"regexp_replace(regexp_replace({w}, '^\\x27', ''), '^y', 'Y')"
        marked = f"regexp_replace({marked}, '([aeiouy])y', '\\1Y', 'g')"
        stops = ", ".join(f"'{k}'" for k in REVISED_STOP_WORDS)
        return (
            f"CASE WHEN {w} IN ({stops}) THEN NULL WHEN length({w}) < 3 THEN {w} "
            f"ELSE CASE {w} {own} ELSE replace({let(marked, within)}, 'Y', 'y') END END"
        )

    return let(x, stemmed)


ENGLISH_REVISED_VOCABULARY = with_base(f"""
v AS (SELECT DISTINCT lexeme FROM tok)
SELECT lexeme, {revised_sql('lexeme')} AS stem FROM v
""")

# "(tion <-> ing) | (ble & ly)" on the english index
_EN_PH = phrase_spans("tion", "ing")
SEARCH_ENGLISH = headline_sql(
    f"EXISTS (SELECT 1 FROM ({_EN_PH}) z WHERE z.file_id = f.file_id AND z.sequence_no = f.sequence_no) "
    f"OR ({has('ble')} AND {has('ly')})",
    {"tioning": _EN_PH, "ble": term_spans("ble"), "ly": term_spans("ly")},
    "IN_tioning OR (IN_ble AND IN_ly)",
    english=True,
)

# E1 with a negation: "with | !the" (fragments without 'the' join as null rows, first in the top-5)
SEARCH_FAST_NOT = headline_sql(
    f"{has('with')} OR NOT {has('the')}",
    {"with": term_spans("with")},
    "IN_with",
)

# E2 with a negation: "with | !the" (books whose only matching fragments lack
# 'the' and hold no 'with' show their first 15 words, unmarked)
SEARCH_HEADLINE_NOT = whole_book_sql(
    f"{has('with')} OR NOT {has('the')}",
    {"with": wterm("with")},
    "r_with",
    ["with"],
    False,
)


def _matches_sql(spans_sql: str) -> str:
    return with_base(f"""
sp AS ({spans_sql}),
d AS (SELECT DISTINCT file_id, sequence_no, s, e FROM sp),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, sequence_no ORDER BY s, e) AS rn FROM d QUALIFY rn <= 50)
SELECT r.file_id, r.sequence_no, r.s,
       trim(regexp_replace(string_agg(t.tok, ' ' ORDER BY t.pos), '\\s+', ' ', 'g')) AS term
FROM r JOIN tok t ON t.file_id = r.file_id AND t.sequence_no = r.sequence_no AND t.pos BETWEEN r.s AND r.e
GROUP BY r.file_id, r.sequence_no, r.s, r.e
""")


# "of <1> !the": every 'of' not followed by 'the'
FILE_MATCHES_NOT = _matches_sql("""
  SELECT a.file_id, a.sequence_no, a.pos AS s, a.pos AS e FROM post a
  WHERE a.lexeme = 'of' AND NOT EXISTS (
    SELECT 1 FROM post b WHERE b.file_id = a.file_id AND b.sequence_no = a.sequence_no
      AND b.pos = a.pos + 1 AND b.lexeme = 'the')""")

# "(of | in) <2> the": spans from an 'of' or 'in' to a 'the' two positions later
DISTANCE_OR = with_base("""
x AS (SELECT 1)
SELECT file_id, sequence_no, pos AS s, pos + 2 AS e
FROM (SELECT *, lead(lexeme, 2) OVER (PARTITION BY file_id, sequence_no ORDER BY pos) AS nxt FROM post)
WHERE lexeme IN ('of', 'in') AND nxt = 'the'
""")

# "(of | (of & in)) <1> the": each span once, though 'of' is an operand twice; an 'in'
# counts in fragments that hold an 'of' as well
DISTANCE_NESTED = with_base("""
n AS (
  SELECT *, lead(lexeme) OVER w AS nxt, bool_or(lexeme = 'of') OVER f AS has_of
  FROM post WINDOW w AS (PARTITION BY file_id, sequence_no ORDER BY pos), f AS (PARTITION BY file_id, sequence_no))
SELECT file_id, sequence_no, pos AS s, pos + 1 AS e FROM n
WHERE nxt = 'the' AND (lexeme = 'of' OR (lexeme = 'in' AND has_of))
""")

# E5 with a cap of 2 matches per fragment
FILE_MATCHES_CAPPED = FILE_MATCHES.replace("rn <= 50", "rn <= 2")

# T9 with two versions of some books in one batch: the later one counts, as in an upsert
INDEX_STREAM_VERSIONS = INDEX_UPSERT

# What the feed of typed changes leaves
FED_FILES = f"""
  SELECT f.file_id, f.filename, f.title, f.author,
         CASE WHEN l.low OR l.toxic THEN f.title || chr(10) || f.content ELSE f.content END AS content
  FROM ({FILES}) f
  LEFT JOIN (SELECT doc_id, bool_or(quality = 0) AS low, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = f.file_id
  WHERE NOT (coalesce(l.toxic, false) AND f.file_id % 2 = 1)"""

INDEX_CHANGES = with_base("""
wd AS (SELECT file_id, sequence_no, count(*) AS n_words, string_agg(tok, ' ' ORDER BY pos) AS words
       FROM tok GROUP BY file_id, sequence_no)
SELECT file_id, sequence_no, CAST(n_words AS BIGINT) AS n_words, words FROM wd
""", files_sql=FED_FILES)


# --- english whole-book headlines, matches and a phrase over a stop word -------------
def english(sql: str, lexeme_sql=english_sql) -> str:
    """The same SQL on stems: words of the stop list keep their place without a lexeme."""
    for tok in ("tok", "r.tok"):
        simple = f"regexp_replace(lower({tok}), '{EDGE}', '', 'g')"
        sql = sql.replace(f"{simple} AS lexeme", f"{lexeme_sql(simple)} AS lexeme")
    sql = sql.replace("pos FROM tok)", "pos FROM tok WHERE lexeme IS NOT NULL)")
    return sql.replace("1 AS sequence_no, pos FROM wtok)", "1 AS sequence_no, pos FROM wtok WHERE lexeme IS NOT NULL)")


_EN_MATCH = (
    f"EXISTS (SELECT 1 FROM ({_EN_PH}) z WHERE z.file_id = f.file_id AND z.sequence_no = f.sequence_no) "
    f"OR ({has('ble')} AND {has('ly')})"
)
_EN_ATOMS = {"tioning": wphrase("tion", "ing"), "ble": wterm("ble"), "ly": wterm("ly")}
_EN_START = "greatest(r_tioning, CASE WHEN r_ble IS NOT NULL AND r_ly IS NOT NULL THEN least(r_ble, r_ly) END)"
SEARCH_HEADLINE_ENGLISH = english(whole_book_sql(_EN_MATCH, _EN_ATOMS, _EN_START, ["tion", "ing", "ble", "ly"], False))
SEARCH_SEMANTIC_ENGLISH = english(whole_book_sql(_EN_MATCH, _EN_ATOMS, _EN_START, ["tion", "ing", "ble", "ly"], True))
FILE_MATCHES_ENGLISH = english(_matches_sql(f"""
  SELECT x.* FROM ({_EN_PH} UNION ALL {term_spans('ble')} UNION ALL {term_spans('ly')}) x
  JOIN (SELECT f.file_id, f.sequence_no FROM frag f WHERE {_EN_MATCH}) m USING (file_id, sequence_no)"""))

# "(thtiedly <-> erly) | (oned & ering)" on the index of revised stems
_RV_PH = phrase_spans("thti", "er")
SEARCH_ENGLISH_REVISED = english(
    headline_sql(
        f"EXISTS (SELECT 1 FROM ({_RV_PH}) z WHERE z.file_id = f.file_id AND z.sequence_no = f.sequence_no) "
        f"OR ({has('one')} AND {has('ere')})",
        {"phrase": _RV_PH, "oned": term_spans("one"), "ering": term_spans("ere")},
        "IN_phrase OR (IN_oned AND IN_ering)",
    ),
    revised_sql,
)

# phrase "rely and ly": the stop word holds a position between both stems
PHRASE_ENGLISH = english(with_base("""
x AS (SELECT 1)
SELECT a.file_id, a.sequence_no, a.pos AS s, b.pos AS e
FROM post a JOIN post b ON a.file_id = b.file_id AND a.sequence_no = b.sequence_no AND b.pos = a.pos + 2
WHERE a.lexeme = 'reli' AND b.lexeme = 'ly'
"""))
