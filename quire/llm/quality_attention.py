"""Document quality by attention over passages (multiple-instance learning).

A text is cut into passages of ``PASSAGE_WORDS`` words (longer ones where a text
would have more than ``PASSAGES``, so that a bag is bounded and the whole text is
read). Each passage becomes a vector of character-class shares and word measures;
an encoder h = tanh(Wx + b), gated attention a = softmax(w . tanh(Vh) * sigmoid(Uh))
over the passages of a document, z = sum a h, and score = sigmoid(c . z + d) (Ilse,
Tomczak and Welling, 2018). Only document labels are needed.

Trained with numpy on a bounded sample of labelled documents: ``SAMPLE`` of each
class, those with the smallest hashes of their ids, from the folds given. Scoring
is one narrow pass over all texts.

Cases: null, empty or blank text: one passage of zeros, scored like any other.
Null doc_id: scored, never trained on; its fold is that of the empty text. Labels
with a null or two values for a doc_id do not train; without labels of both kinds
every score is their share (0.5 without any). Equal rows: a row each. Empty table:
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.quality_rules import labels_share, training_ids
from quire.llm.shared import fold
from quire.llm.textblocks import Block, blocks, mix64, words

SAMPLE = 2000  # labelled training rows of each class
PASSAGE_WORDS = 64
PASSAGES = 256
HIDDEN, GATES = 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4

# Character classes whose shares describe a passage.
_CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOUBCDFGHJKLMNPQRSTVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", ";:", "!", "?", "|", "$", "#", "%", "&", "*", "<>", "'\"`", "()[]{}", "@/\\=+_~^", "-"]
_CLASS = np.full(256, len(_CLASSES), np.int64)  # other control bytes
for _i, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:192], _CLASS[192:] = len(_CLASSES) + 1, len(_CLASSES) + 2
N_CLASSES = len(_CLASSES) + 3
N_FEATURES = N_CLASSES + 5


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of a block and n + 1 offsets by text."""
    w = words(block)
    n_words = w.counts
    long = np.maximum(PASSAGE_WORDS, -(-n_words // PASSAGES))
    per = np.maximum(1, -(-n_words // long))
    bounds = np.concatenate([[0], np.cumsum(per)])
    row = w.rows()
    place = np.arange(len(row)) - w.bounds[row]
    passage = bounds[row] + place // long[row]
    total = int(bounds[-1])
    x = np.zeros((total, N_FEATURES), np.float32)
    if len(row):
        # bytes from a passage's first word to the next one's
        begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        here = passage[begin]
        start = w.starts[begin]
        stop = np.append(start[1:], len(block.data))
        stop = np.minimum(stop, block.bounds[row[begin] + 1])
        size = stop - start
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.arange(int(size.sum())) + np.repeat(start - first, size)
        shares = np.bincount(np.repeat(here, size) * N_CLASSES + _CLASS[block.data[at]], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
        x[:, :N_CLASSES] = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1)
        count = np.maximum(np.bincount(passage, minlength=total), 1)
        length = w.ends - w.starts
        kinds = np.unique(mix64(passage.astype(np.uint64)) ^ w.hashes, return_index=True)[1]
        x[:, N_CLASSES] = np.bincount(passage, weights=length, minlength=total) / count / 10
        x[:, N_CLASSES + 1] = np.bincount(passage[kinds], minlength=total) / count
        x[:, N_CLASSES + 2] = np.bincount(passage, weights=length >= 15, minlength=total) / count
        x[:, N_CLASSES + 3] = np.bincount(passage, weights=length <= 2, minlength=total) / count
    x[:, N_CLASSES + 4] = np.repeat(np.log1p(n_words) / 10, per)
    return x, bounds


class Model:
    """Parameters and forward pass; bags are runs of rows of ``x`` from ``starts``."""

    def __init__(self, mean, scale, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        f = len(mean)
        self.mean, self.scale = mean, scale
        self.p = {"W": draw(f, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1)}

    def forward(self, x, starts):
        p = self.p
        sizes = np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return x, bag, h, t, g, a, z, z @ p["c"] + p["d"]

    def score(self, x, starts):
        return 1 / (1 + np.exp(-np.clip(self.forward(x, starts)[-1], -60, 60)))

    def gradient(self, x, starts, y):
        p = self.p
        x, bag, h, t, g, a, z, logit = self.forward(x, starts)
        dl = (1 / (1 + np.exp(-logit)) - y) / len(y)
        dz = dl[:, None] * p["c"]
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        gate = de[:, None] * p["w"]
        dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        pre = dh * (1 - h * h)
        return {"W": x.T @ pre, "b": pre.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dl, "d": dl.sum(keepdims=True)}


def train(bags: list[np.ndarray], y: np.ndarray, share: float, seed: int = 7) -> Model:
    """Adam on mini-batches of bags; ``share``: of label 1 among all labels."""
    x = np.concatenate(bags).astype(np.float64)
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, seed)
    rng, step = np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(a) for k, a in model.p.items()} for _ in range(2))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for a in range(0, len(bags), BATCH):
            pick = order[a : a + BATCH]
            starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])[:-1]])
            grad = model.gradient(np.concatenate([bags[i] for i in pick]), starts, y[pick])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, d in grad.items():
                d = d + DECAY * model.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    drawn = y.mean()  # from the sample's classes back to the labels' own
    model.p["d"] = model.p["d"] + np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return model


# ------------------------------------------------------------------ jobs
def fit(docs: DataFrame, labels: DataFrame, where: Column, sample: int = SAMPLE, column: str = "quality") -> Model | float:
    """Train on at most ``2 * sample`` documents (their passage vectors, ``PASSAGES``
    at most, reach the driver); a constant without labels of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                x, bounds = passages(block)
                rows = batch.slice(block.first, block.n)
                bags = pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), bags], names=["doc_id", "label", "bag"])

    labels = labels.filter(where)
    ids = training_ids(labels, column, sample)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")  # at most 2 * sample ids
    got = rows.mapInArrow(run, "doc_id long, label int, bag binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    y, share = np.array([r["label"] for r in got], np.float64), labels_share(labels)
    if not len(y) or y.min() == y.max():
        return share
    return train([np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in got], y, min(max(share, 1e-3), 1 - 1e-3))


def score(docs: DataFrame, model: Model | float, held_out: tuple[int, int]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about two thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                model = shared.value
                if isinstance(model, float):
                    s = np.full(block.n, model)
                else:
                    x, bounds = passages(block)
                    s = model.score(x, bounds[:-1])
                rows = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    n, r = held_out
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), (fold(doc, n) == r).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """Learn from labels whose crc32 fold ``held_out = (n, r)`` is not r; score all."""
    n, r = held_out
    return score(docs, fit(docs, labels, fold(F.col("doc_id"), n) != r), held_out)
