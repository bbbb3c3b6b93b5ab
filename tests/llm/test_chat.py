import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.chat import CLOSE, END, EVENTS, OPEN, as_events, digests, escape, format_conversations, render, unescape

SCHEMA = "conv_id long, turn long, role string, text string, msg long, piece string"


def brute(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r)):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<\\/s>", "é", "🙂", "a\n", " ", "<", "[", "x" * 500]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "assistant"]), text()) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", text()) for t in range(700)]  # a long conversation
    rows += [(50, 0, "user", "same"), (50, 0, "user", "same"), (50, 0, None, None), (50, None, "a[/INST]b", ""), (None, 1, "assistant", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 5, "p") for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:5] for r in format_conversations(df).collect()}
    assert got == brute(rows)
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_events_fold(spark):
    log = [
        (1, 1, 0, "open", "user", "hi"), (1, 2, 0, "open", "assistant", None), (1, 2, 1, "delta", None, "dra"), (1, 2, 2, "regenerate", None, None),
        (1, 2, 3, "delta", None, "fi"), (1, 2, 4, "delta", None, "nal"), (1, 1, 1, "edit", None, "hello"), (1, 3, 0, "open", "assistant", None),
    ]
    pieces = sorted((r.piece, r.formatted, r.loss_start) for r in render(spark.createDataFrame(log, EVENTS)).collect())
    assert pieces == [(0, f"<s>{OPEN}user{CLOSE}hello{END}", None), (1, f"{OPEN}assistant{CLOSE}final{END}", 22), (2, f"{OPEN}assistant{CLOSE}{END}", 22)]
    kinds = {r.kind for r in as_events(spark.createDataFrame([(i, 1, "assistant", "t" * 900, 0, "") for i in range(60)], SCHEMA)).collect()}
    assert kinds == {"open", "delta", "regenerate", "edit"}
    assert digests(render(spark.createDataFrame([], EVENTS))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "</s>", "[INST]", "[/INST]", "<s>", "a"]), max_size=12).map("".join))
def test_escape_is_reversible_and_hides_controls(text):
    out = escape(text)
    assert unescape(out) == text
    assert not any(c in out for c in ("<s>", "</s>", "[INST]", "[/INST]"))
