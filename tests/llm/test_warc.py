import gzip
import os
import random

import pytest

from quire.llm.warc import digest, range_records, read_archives, record, round_trip, write_archives


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, first long, sha string")


def brute(rows):
    """One row per page; equal rows all responses if they hold the largest id."""
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    count = {}
    for _, _, h in rows:
        count[h or ""] = count.get(h or "", 0) + 1
    out = []
    for i, _, h in rows:
        raw, to = (h or "").encode(), best.get(h or "")
        revisit = count[h or ""] > 1 and to is not None and to != i
        out.append((i, len(raw), digest(raw), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h/{i}", f"<p>é{i % 7 if i % 3 else rng.random()}</p>" * rng.randint(1, 50)) for i in range(200)]
    rows += [(300, None, None), (301, "", ""), (302, "a\r\nWARC-Type: x", "q"), (303, "u", "q"), (303, "u", "q"), (None, "n", "q"), (None, "m", "only"), (305, "l", "long " * 400_000)]
    got = sorted((tuple(r) for r in round_trip(pages(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert round_trip(pages(spark, [])).count() == 0


def test_small_ranges_own_each_record_once(spark, tmp_path):
    rng = random.Random(6)
    inner = b"".join(record(i, None, bytes(rng.randrange(256) for _ in range(300)), "x") for i in range(900, 920))
    stored = os.urandom(3000) + inner + os.urandom(3000) + b"\x1f\x8b\x08" * 50
    parts = [record(i, "u", stored if i % 5 == 0 else b"y" * i, digest(stored if i % 5 == 0 else b"y" * i)) for i in range(60)]
    data = b"".join(parts)
    path = str(tmp_path / "a.warc.gz")
    (tmp_path / "a.warc.gz").write_bytes(data)
    assert gzip.decompress(data)
    for step in (97, 1000, 5000, len(data)):
        got = [f["warc-record-id"] for s in range(0, len(data), step) for f, _ in range_records(path, s, s + step)]
        assert got == [f"<urn:page:{i}>" for i in range(60)]
    assert read_archives(spark, str(tmp_path), 700).count() == 60


def test_damage_is_not_passed_over(tmp_path):
    parts = [record(i, "u", bytes(str(i) * 50, "ascii"), "x") for i in range(20)]
    data = bytearray(b"".join(parts))
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "b.warc.gz").write_bytes(bytes(data))
    with pytest.raises(ValueError):
        list(range_records(str(tmp_path / "b.warc.gz"), 0, len(data)))


def test_payloads_come_back(spark, tmp_path):
    rows = [(1, "http://a/b c", "<b>é</b>"), (2, None, "<b>é</b>"), (3, "z", "w")]
    write_archives(pages(spark, rows), str(tmp_path))
    got = {r.page_id: r for r in read_archives(spark, str(tmp_path)).collect()}
    assert bytes(got[2].payload).decode() == "<b>é</b>" and got[1].payload is None and got[1].refers_to == 2
    assert got[1].url == "http://a/b%20c" and got[2].url is None
    write_archives(pages(spark, rows), str(tmp_path / "c"), min_revisit_bytes=100)
    assert {r.record_type for r in read_archives(spark, str(tmp_path / "c")).collect()} == {"response"}
