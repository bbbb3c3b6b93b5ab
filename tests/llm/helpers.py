"""Brute-force versions shared by the llm tests."""

import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words(lower_ascii(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near_groups(rows, k, percent):
    """rows: (doc_id, text) -> {doc_id: component}; doc_ids not null."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for n, (d, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(n)
    for n, (d, s) in enumerate(sets):
        shared = {}
        for x in s:
            for m in index[x]:
                if m < n:
                    shared[m] = shared.get(m, 0) + 1
        for m, both in shared.items():
            e, o = sets[m]
            if 100 * both >= percent * (len(s) + len(o) - both):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d in parent}


def crc_fold(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def documents(spark, rows, extra=True):
    """rows (doc_id, text[, lang, source]) as a documents table, with extra columns
    whose names clash with the operators' own."""
    full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1])) + ((7, "x", "b") if extra else ()) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", n_words long, digest string, bucket string" if extra else "")
    return spark.createDataFrame(full, schema)
