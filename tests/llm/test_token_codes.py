import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quire.llm import token_codes
from quire.llm.queries import vocabulary
from quire.llm.shared import run_folder
from quire.llm.textblocks import blocks
from quire.llm.token_codes import END_ID, WordEncoder, decode_span, encode_levels, read_token_files, segments, token_index, write_token_files
from tests.llm import helpers as H


@functools.cache
def tokenizer():
    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = True
    return tok


def plain(text):
    return np.array(tokenizer().encode(text or "", add_special_tokens=False).ids + [END_ID], "<u4")


def test_any_token_and_span():
    ids = np.random.default_rng(0).integers(0, 70_000, 3000).astype(np.uint32)
    ids[:4] = [0, 2**32 - 1, 255, 256]
    levels = encode_levels(ids)
    assert len(levels) == 4 and len(levels[1].chunks) == (ids > 255).sum()
    assert all(decode_span(levels, i, i + 1)[0] == ids[i] for i in range(0, 3000, 7))
    for a, b in [(0, 3000), (0, 0), (511, 513), (512, 1024), (2999, 3000)]:
        assert (decode_span(levels, a, b) == ids[a:b]).all()
    assert len(decode_span(encode_levels(ids[:0]), 0, 0)) == 0


@pytest.mark.parametrize("kept", [2_000_000, 50])
def test_parts_give_the_ids_of_whole_texts(kept, monkeypatch):
    monkeypatch.setattr(token_codes, "CACHED_WORDS", kept)
    rng, enc = random.Random(1), WordEncoder(vocabulary())
    odd = "a'sé́  　İǅß'LL12ẛ̣ ̀x\n\t<|endoftext|>🙂한글..!×÷Àÿ"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + [None, "", "It's 3.5kg, DON'T!!"]
    for block in blocks(pa.array(texts), 3000):
        ids, firsts = enc.encode(block)
        for i in range(block.n):
            assert ids[firsts[i] : firsts[i + 1]].tolist() == plain(texts[block.first + i]).tolist()


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_codes, "SEGMENT_TOKENS", 300)
    rng = random.Random(2)
    rows = [(rng.randrange(10**6), " ".join(rng.choice(["alpha", "Beta,", "γ", "12"]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [(None, "first of all"), (7, None), (8, ""), (9, "same"), (9, "same"), (10, "word " * 30_000)]
    d = H.documents(spark, rows)
    manifest = write_token_files(d, vocabulary(), run_folder(spark, "tokens-test"))
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(x for x, _ in rows if x is not None)
    want = sorted((x, len(t := plain(text)), zlib.crc32(t.tobytes())) for x, text in rows if x is not None)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == want
    seg = next(s for p in manifest.collect() for s in segments(p.path))
    assert [seg.token(i) for i in range(int(seg.firsts[1]))] == seg.document(0).tolist()
    assert token_index(H.documents(spark, []), vocabulary()).count() == 0
