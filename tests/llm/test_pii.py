"""Personal data: base spans against Python's re, candidates against planted cases."""

import hashlib
import random
import re

from quire.llm.pii import KINDS, personal_data
from tests.llm import helpers as H

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(row, text):
    want = base(text or "")
    count = [sum(s.startswith(k + ":") for s in want) for k in BASE]
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == count, text
    assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
    spans = [s for s in row.spans.split(",") if s]
    assert set(want) <= set(spans)
    keys = [(KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
    assert keys == sorted(keys)


def test_base_spans_equal_re(spark):
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "@", "a@b.c_x@e.f", "1.2.3.4", "256.1.1.1", "0001.02.3.4", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111112", "+1 (171) 555-2028", "+49.", "+1 2", " ", "\n", "é", "😀", "5", "-", ".", "+", "\x01", "_", "0" * 20, "(", "99 "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(500)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (None, "+1 (171) 555-2028"), (5, texts[5])]
    got = personal_data(H.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        assert len(by[i]) == (2 if i == 5 else 1)
        check(by[i][0], t)


def test_long_runs_are_linear(spark):
    plain = {1: "a" * 300_000, 2: "1" * 300_000}  # without spans; re would take hours
    rows = [*plain.items(), (3, "1." * 150_000), (4, "+" * 1000 + "1(" * 100_000), (5, "a.b@" * 60_000), (6, "x@" + "y." * 100_000 + "z"), (7, "1.2.3.4 " * 20_000), (8, "1 " * 150_000)]
    for r in personal_data(H.documents(spark, rows)).collect():
        if r.doc_id in plain:
            assert r.spans == ""
        elif r.doc_id == 3:  # re is quadratic here as well
            assert r.spans == ",".join(f"ip:{i}:{i + 7}" for i in range(0, 300_000, 8)) and r.n_ip == 37_500
        else:
            check(r, dict(rows)[r.doc_id])


def planted():
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshrdl") for _ in range(rng.randint(2, 8)))
    rows, inside = [], {}
    for i in range(240):
        w = [word() for _ in range(30)]
        k, said = i % 8, None
        if k == 0:
            said = f'token = "{hexes(40)}"'
        elif k == 1:
            said = f"please call ({digits(3)}) 555-{digits(4)}"
        elif k == 2:
            said = f"mail {word()}{digits(2)} (at) {word()} (dot) com"
        elif k == 3:  # not personal: numbers that fail Luhn
            n = digits(16)
            said = n if not luhn(n) else n[:-1] + str((int(n[-1]) + 1) % 10)
        elif k == 4:
            said = f"+1 ({digits(3)}) 555-{digits(4)}"
        elif k == 5:
            said = f"{word()}.{digits(2)}@mail{digits(1)}.example.com"
        elif k == 6:
            said = "version 4.0.1 and 12 of 300"
        rows.append((i, " ".join(w[:15] + ([said] if said else []) + w[15:])))
        inside[i] = k
    return rows, inside


def test_method_adds_planted_spans_and_leaves_clean_texts(spark):
    rows, inside = planted()
    kinds = {0: "secret", 1: "phone", 2: "email", 4: "phone", 5: "email"}
    for r in personal_data(H.documents(spark, rows)).collect():
        check(r, dict(rows)[r.doc_id])
        found = [s.split(":")[0] for s in r.spans.split(",") if s]
        want = kinds.get(inside[r.doc_id])
        assert found == ([want] if want else []), (dict(rows)[r.doc_id], r.spans)


def test_empty_table(spark):
    assert personal_data(H.documents(spark, [])).collect() == []
