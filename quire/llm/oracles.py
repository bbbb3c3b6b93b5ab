"""DuckDB SQL for the llm queries that SQL can express, written from their definitions."""

from __future__ import annotations

# 50: the line dedup's least words of a run. A line goes if it lies in a window of 50
# words (from a line on, or up to a line) that has the same lines as an earlier one.
LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS e, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS s,
         sum(n) OVER (PARTITION BY doc_id) AS total
  FROM counted WHERE n > 0
), windows AS (
  SELECT doc_id, pos, n, s, e, total,
         list(line) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS ahead,
         list(line) OVER (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS back
  FROM placed
), later AS (
  SELECT doc_id, pos, 'a' AS side FROM windows WHERE total - s >= 50
  QUALIFY row_number() OVER (PARTITION BY ahead ORDER BY doc_id, pos) > 1
  UNION ALL
  SELECT doc_id, pos, 'b' FROM windows WHERE e >= 50
  QUALIFY row_number() OVER (PARTITION BY back ORDER BY doc_id, pos) > 1
), gone AS (
  SELECT DISTINCT p.doc_id, p.pos, p.n
  FROM later l JOIN placed w ON w.doc_id = l.doc_id AND w.pos = l.pos JOIN placed p ON p.doc_id = l.doc_id
   AND (CASE WHEN l.side = 'a' THEN p.s BETWEEN w.s AND w.s + 49 ELSE p.e BETWEEN w.e - 49 AND w.e END)
), rest AS (
  SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.pos) AS text
  FROM counted c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.pos = c.pos WHERE g.doc_id IS NULL GROUP BY c.doc_id
), totals AS (SELECT doc_id, count(*) AS removed_lines, sum(n)::BIGINT AS removed_words FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.removed_lines, 0) AS removed_lines, coalesce(t.removed_words, 0) AS removed_words,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text
FROM documents d LEFT JOIN totals t USING (doc_id) LEFT JOIN rest r USING (doc_id)
"""


def mixing_ctes(documents: str, rounds: int = 8, temper: float = 0.9) -> str:
    """CTEs up to ``drawn``: all columns of ``documents`` with tokens, topic and p."""
    topics = {
        "place": "in on at from into over under dans sur en auf aus bei sobre desde",
        "action": "is was be are have est sont ist sind war haben es son fue",
        "relation": "of by with for de par pour avec von mit zu del con por para",
    }
    hits = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(k) for k in v.split())}))) AS {t}" for t, v in topics.items())
    first = " ".join(f"WHEN {t} > 0 AND {t} = greatest({', '.join(topics)}) THEN '{t}'" for t in topics)
    out = f"""mix_words AS (
  SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}
), mix_hits AS (SELECT *, len(w) AS mix_tokens, {hits} FROM mix_words
), mix_docs AS (SELECT * EXCLUDE (w, {', '.join(topics)}), coalesce(source, '') AS m_source, coalesce(lang, '') AS m_lang, CASE {first} ELSE 'other' END AS m_topic FROM mix_hits WHERE mix_tokens > 0
), mix_0 AS MATERIALIZED (
  SELECT m_source, m_lang, m_topic, sum(mix_tokens)::DOUBLE AS tokens, sum(mix_tokens)::DOUBLE / (SELECT sum(mix_tokens) FROM mix_docs)::DOUBLE AS weight
  FROM mix_docs GROUP BY ALL
)"""
    for m in ("source", "lang", "topic"):
        out += f""", goal_{m} AS MATERIALIZED (
  SELECT m_{m}, pow(sum(tokens), {temper}) / (SELECT sum(x) FROM (SELECT pow(sum(tokens), {temper}) AS x FROM mix_0 GROUP BY m_{m})) AS goal FROM mix_0 GROUP BY m_{m}
)"""
    last = "mix_0"
    for k in range(rounds):
        for m in ("source", "lang", "topic"):
            name = f"mix_{k}_{m}"
            out += f""", {name} AS MATERIALIZED (
  SELECT c.m_source, c.m_lang, c.m_topic, c.tokens, c.weight * (g.goal / s.total) AS weight
  FROM {last} c JOIN (SELECT m_{m}, sum(weight) AS total FROM {last} GROUP BY m_{m}) s USING (m_{m}) JOIN goal_{m} g USING (m_{m})
)"""
            last = name
    out += f""", mix_p AS MATERIALIZED (SELECT *, (weight / tokens) / (SELECT max(weight / tokens) FROM {last}) AS p FROM {last}
), drawn AS (
  SELECT d.*, p FROM mix_docs d JOIN mix_p USING (m_source, m_lang, m_topic)
  WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p
)"""
    return out


def mixing(documents: str) -> str:
    return f"""WITH {mixing_ctes(documents)}
SELECT doc_id, m_source AS source, m_lang AS lang, m_topic AS topic, mix_tokens AS n_tokens, round(p, 9) AS probability FROM drawn"""

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"


def _base32(hex40: str) -> str:
    """Base32 of 20 bytes given as 40 hex digits: five digits are four characters."""
    out = []
    for g in range(8):
        value = f"('0x' || substr({hex40}, {5 * g + 1}, 5))::BIGINT"
        out += [f"substr({_BASE32}, (({value} >> {shift}) & 31)::INT + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(out)


WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT body, max(page_id) AS first FROM p GROUP BY body)
SELECT p.page_id, octet_length(encode(p.body))::BIGINT AS payload_bytes, {_base32('p.sha')} AS payload_digest,
       CASE WHEN p.page_id = g.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = g.first THEN NULL ELSE g.first END AS refers_to
FROM p JOIN g USING (body)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.a, ways.v FROM reach JOIN ways ON reach.b = ways.u
), least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_of USING (doc_id) LEFT JOIN n USING (doc_id)
"""

# Inside texts a control string gets one backslash after its first character.
_ESCAPED = r"regexp_replace({x}, '([<\[])(\\*(?:/s>|s>|/INST\]|INST\]))', '\1\\\2', 'g')"

CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         3 + sum(17 + length({_ESCAPED.format(x='role')}) + length({_ESCAPED.format(x='text')})) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM t
"""


# 3988292384: the polynomial of crc32, bits reversed.
_CRC32 = """xor(list_reduce(list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i::INT, 1))::BIGINT),
  lambda c, b: list_reduce(range(8), lambda r, k: CASE WHEN (r & 1) = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"""

PREFIX_TRIE = f"""
WITH given AS (
  SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format(x='conv_id::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), parts AS (
  SELECT i.conv_id, g.turn, 0 AS side, g.pos FROM ids i JOIN given g ON g.conv_id = i.base AND g.pos < i.h
  UNION ALL SELECT i.conv_id, g.turn, 1, g.pos FROM ids i JOIN given g ON g.conv_id = i.conv_id AND g.pos >= i.h
), whole AS MATERIALIZED (SELECT i.conv_id, coalesce(list(turn ORDER BY side, pos) FILTER (turn IS NOT NULL), []) AS seq FROM ids i LEFT JOIN parts p USING (conv_id) GROUP BY i.conv_id
), member AS MATERIALIZED (SELECT conv_id, d AS depth, seq[1:d] AS prefix, len(seq) = d AS ends FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM whole)
), node AS MATERIALIZED (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[-1].t) END AS own
  FROM member GROUP BY prefix, depth
), kids AS MATERIALIZED (SELECT prefix[:-2] AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), full_node AS MATERIALIZED (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM node n LEFT JOIN kids k USING (prefix)
), under AS (
  SELECT prefix[1:d] AS prefix, sum(own)::BIGINT AS saved, (count(*) FILTER (n_children = 0))::BIGINT AS leaves
  FROM (SELECT prefix, own, n_children, unnest(range(depth + 1)) AS d FROM full_node) GROUP BY 1
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, u.leaves AS n_leaves, u.saved AS saved_tokens, f.ends_sha256
FROM full_node f JOIN under u USING (prefix) LEFT JOIN node p ON f.depth > 0 AND p.prefix = f.prefix[:-2]
"""


def centroids(rounds: int = 10) -> str:
    """Lloyd rounds over 64 integer components and 8 centroids, every distance anew."""
    ctes = """v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: TRY_CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), 'bool_and')
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, q FROM v ORDER BY h, q LIMIT 8)
)"""
    for k in range(rounds + 1):
        ctes += f""", a{k} AS MATERIALIZED (
  SELECT vec_id, v.q, c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - m.q[i]) * (v.q[i] - m.q[i])))::BIGINT AS d
  FROM v, c{k} m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
)"""
        if k < rounds:
            ctes += f""", c{k + 1} AS MATERIALIZED (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q
  FROM (SELECT c, i, sum(q[i]) AS s, count(*) AS n FROM a{k}, range(1, 65) t(i) GROUP BY c, i) GROUP BY c
  UNION ALL SELECT c, q FROM c{k} WHERE c NOT IN (SELECT c FROM a{k})
)"""
    return f"""WITH {ctes}
SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON a.c = m.c"""
