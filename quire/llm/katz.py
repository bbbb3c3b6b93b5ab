"""Katz backoff language model, counted and evaluated without moving the text.

The corpus is cut into chunks of about ``CHUNK_BYTES``. A chunk asks for what it
needs by key: for every distinct n-gram of it, one entry travels to the bucket of
that n-gram's hash with the chunk's training count, and the corpus count travels
back in the same order. A word or word pair that stands in every document is so
one entry per chunk, whatever its frequency: no hot key, and no token rows move.

* counts: a chunk's n-grams lie grouped by context, and a context's hash names the
  bucket, so that all counts of a context meet in one place. Each n-gram gets its
  corpus count back, each context its total, its least count (is any discounted?) and
  whether some chunk holds a token there that training never saw. The first chunk that
  holds an n-gram owns it. Answers are written as a table partitioned by order.
* discounts: Good-Turing, d_r = (r*/r - a) / (1 - a), r* = (r+1) n_{r+1} / n_r,
  a = (K+1) n_{K+1} / n_1 for r <= K = 5. Where the counts of counts do not give
  0 < d_r < 1 for all r <= K, K is lowered; with none left, d_1 = 1/2.
* contexts: only those with an unseen token need alpha(h): for them, owners of the
  n-grams give sum c, sum (c - d c) and sum P(w | h') over the words seen after h, which
  make alpha(h) = (sum (c - d c) / c(h)) / (1 - sum P), so that the probabilities of
  every context add up to exactly 1. A context without any discounted count counts
  one more in its denominator, so that some mass is left to back off with.
* rounds: words are counted first, then each longer order by itself; orders above 2 in
  ``ROUNDS`` rounds of buckets, so that the shuffle files of one round at a time are on
  disk; every bucket has its round.
* scores: per token, P_n = d c / c(h) if c > 0, else alpha(h) P_{n-1}; a context
  never seen passes through. Order 1: d c / N, and what the discounts leave is the
  probability of the one unknown word. Tokens before the first are a begin mark.

Tokens: words of the text with A-Z lowered, then one end. Words and contexts are
64-bit hashes, an n-gram is its context and 48 bits more. ``model_discounts``, ``context_weights`` are plain numpy.

Cases: null or empty text: the end token alone. Null doc_id: fold of the empty
text (learned from); kept as null. Equal doc_ids or rows: a row each. No training
rows: every token unknown, score 0. Empty table: empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import crc_fold, run_folder
from quire.llm.textblocks import blocks, mix64, runs, words

CHUNK_BYTES = 8 << 20
ORDER = 3
ROUNDS = 2
K = 5
CODES, CONTEXT = 0, 100  # kinds of rows; an order n >= 1 marks counts, CONTEXT + n contexts
ROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
ROW_SQL = "chunk long, kind int, bucket long, a binary, b binary"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOW = np.uint64((1 << 48) - 1)
BEGIN, END = mix64(np.array([1, 2], np.uint64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob: each by byte planes (small numbers leave whole planes of
    zeros), compressed, behind its two sizes."""
    out = []
    for x in arrays:
        raw = np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        out += [len(raw).to_bytes(8, "little"), len(small).to_bytes(8, "little"), small]
    return b"".join(out)


def unpack(blob, *kinds: str) -> list[np.ndarray]:
    view, at, out = memoryview(blob), 0, []
    for kind in kinds:
        n, size = int.from_bytes(view[at : at + 8], "little"), int.from_bytes(view[at + 8 : at + 16], "little")
        at += 16 + size
        item = np.dtype(kind).itemsize
        raw = np.frombuffer(pa.decompress(view[at - size : at], n, "zstd") if n else b"", np.uint8)
        out.append(raw.reshape(item, -1).T.copy().view(kind).reshape(-1))
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in any order; ascending ones take less room, as their steps are small."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob) -> np.ndarray:
    return np.cumsum(unpack(blob, "<u8")[0], dtype=np.uint64)


def _row(chunk: int | None, kind: int, bucket: int, a: bytes, b: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"chunk": [chunk], "kind": [kind], "bucket": [bucket], "a": [a], "b": [b]}, schema=ROW)


# ------------------------------------------------------------------ the model
def model_discounts(n_r: np.ndarray) -> np.ndarray:
    """Discounts d_0 .. d_k (d_0 unused) from the numbers n_r of n-grams seen r times."""
    n = n_r.astype(np.float64)
    for k in range(K, 0, -1):
        if (n[1 : k + 2] <= 0).any():
            continue
        a = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        d = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a < 1 else np.zeros(k)
        if (d > 0).all() and (d < 1).all():
            return np.concatenate([[1.0], d])
    return np.array([1.0, 0.5])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


def denominator(total: np.ndarray, least: np.ndarray, d: np.ndarray) -> np.ndarray:
    """One more than the count where the least count is beyond the discounts."""
    return total + np.where(least >= len(d), 1.0, 0.0)


def context_weights(total: np.ndarray, freed: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """alpha of each context from sum c, sum (c - d c) and sum P(w | h')."""
    left = np.where(freed > 0, freed, 1.0) / (total + (freed <= 0))
    return np.where(total > 0, left / np.maximum(1 - lower, 1e-300), 1.0)


class Stats:
    """Totals of the training corpus: tokens N, words V, discounts by order."""

    def __init__(self, rows: list):
        self.d, self.n, self.v, mass = {}, 0, 0, 0.0
        for r in rows:
            self.d[r["kind"]] = model_discounts(np.array(r["n_r"], np.int64))
            if r["kind"] == 1:
                self.n, self.v = r["total"], r["types"]
                few = np.array(r["n_r"], np.float64) * discounted(np.arange(K + 2), self.d[1])
                mass = float(few[1:].sum()) + r["total"] - float((np.array(r["n_r"]) * np.arange(K + 2)).sum())
        self.words_total = self.n + (mass >= self.n)
        self.unknown = 1 - mass / self.words_total if self.n else 1.0

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(counts))
        return np.where(counts > 0, discounted(counts, self.d[1]) / self.words_total, self.unknown)


# ------------------------------------------------------------------ chunks
def encode_chunks(docs: DataFrame, held_out: tuple[int, int]) -> DataFrame:
    """A row per chunk: token codes (the most frequent word is 0) with their
    vocabulary; documents with offsets."""
    n, out_fold = held_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, made
            if not held:
                return
            hashes, counts, ids, null, train = (np.concatenate(x) for x in zip(*held))
            vocab, codes, times = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            yield _row(base + made, CODES, 0, pack(rank[codes]) + pack_keys(vocab[order]), pack(ids, null.astype(np.uint8), train.astype(np.uint8), bounds))
            held, size, made = [], 0, made + 1

        for batch in batches:
            null = np.asarray(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0), np.int64)
            train = np.array([crc_fold(None if x else i, n) != out_fold for i, x in zip(ids.tolist(), null.tolist())], bool)
            for block in blocks(batch.column(1)):
                w = words(block)
                hashes = np.insert(w.hashes, w.bounds[1:], END)
                rows = slice(block.first, block.first + block.n)
                held.append((hashes, w.counts + 1, ids[rows], null[rows], train[rows]))
                size += len(block.data)
                if size >= CHUNK_BYTES:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROW_SQL)


class Chunk:
    """A chunk's tokens, and the answers it has got so far."""

    def __init__(self, rows: pa.Table, buckets: int):
        self.parts: dict[int, list] = {}
        for kind, a, b in zip(rows["kind"].to_pylist(), rows["a"], rows["b"]):
            self.parts.setdefault(kind, []).append((a.as_buffer(), b.as_buffer()))
        codes, docs = self.parts[CODES][0]
        self.codes, steps = unpack(codes, "<i4", "<u8")
        self.vocab = np.cumsum(steps, dtype=np.uint64)  # words of one frequency ascend
        self.ids, self.null, self.train, self.bounds = unpack(docs, "<i8", "u1", "u1", "<i8")
        self.buckets = buckets
        self.train_token = np.repeat(self.train.astype(bool), np.diff(self.bounds))
        self._contexts: dict[int, tuple] = {}
        self._context_of: dict[int, np.ndarray] = {}
        self._grams = {1: (self.vocab, self.codes)}

    def contexts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the n - 1 tokens before each token, ascending, and each token's
        place among them: the (n-1)-gram that ends one token earlier, or begin marks alone."""
        if n not in self._contexts:
            before, place = self.grams(n - 1)
            start = np.zeros(1, np.uint64)
            for _ in range(n - 1):
                start = mix64(start ^ BEGIN)
            keys = np.append(mix64(before) if n == 2 else before, start)
            at = np.empty(len(place), np.int64)
            at[1:] = place[:-1]
            at[self.bounds[:-1]] = len(before)
            met = np.flatnonzero(np.bincount(at, minlength=len(keys)))
            met = met[np.argsort(keys[met])]
            rank = np.zeros(len(keys), np.int64)
            rank[met] = np.arange(len(met))
            self._contexts[n] = keys[met], rank[at]
        return self._contexts[n]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram keys, in the same order at every call (by context, if n > 1), and
        each token's place among them."""
        if n not in self._grams:
            contexts, at = self.contexts(n)
            pairs, place = np.unique(at * len(self.vocab) + self.codes, return_inverse=True)
            self._context_of[n] = pairs // len(self.vocab)
            self._grams[n] = mix64(contexts[self._context_of[n]] ^ self.vocab[pairs % len(self.vocab)]), place
        return self._grams[n]

    def context_of(self, n: int) -> np.ndarray:
        """The place of each n-gram's context among the contexts."""
        self.grams(n)
        return self._context_of[n]

    def unseen(self, n: int, counts: np.ndarray) -> np.ndarray:
        """Which contexts of the chunk have an n-gram here that training never saw."""
        return np.bincount(self.context_of(n), weights=counts == 0, minlength=len(self.contexts(n)[0])) > 0

    def seen_grams(self, n: int, stats: Stats) -> np.ndarray:
        """P of each n-gram by the order n, where training saw it."""
        if n == 1:
            return stats.word_probability(self.word_counts())
        counts, _ = self.answer(n, 0, "<i8", "u1")
        total, least, _ = self.answer(n, 1, "<i8", "u1", "u1")
        return discounted(counts, stats.d[n]) / np.maximum(denominator(total, least, stats.d[n]), 1)[self.context_of(n)]

    def dealt(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in bucket order: the order, the buckets met and where each begins.
        A bucket is a range of keys, so ascending keys stay so and lie close together."""
        bucket = (keys >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order].astype(np.int64)
        begin = np.flatnonzero(np.diff(bucket, prepend=-1))
        return order, bucket[begin], np.append(begin, len(keys))

    def answer(self, kind: int, column: int, *whats: str) -> list[np.ndarray]:
        """The answers of a kind from all buckets, in bucket order."""
        got = [unpack(x[column], *whats) for x in self.parts.get(kind, [])]
        return [np.concatenate([x[i] for x in got] or [np.zeros(0, w)]) for i, w in enumerate(whats)]

    def word_counts(self) -> np.ndarray:
        counts = np.zeros(len(self.vocab), np.int64)
        counts[self.dealt(self.vocab)[0]] = self.answer(1, 0, "<i8")[0]
        return counts

    def probabilities(self, upto: int, stats: Stats) -> np.ndarray:
        """P of every token by the model of order ``upto``."""
        p = stats.word_probability(self.word_counts())[self.codes]
        for n in range(2, upto + 1):
            (_, place), (contexts, at) = self.grams(n), self.contexts(n)
            counts, _ = self.answer(n, 0, "<i8", "u1")
            asks = self.answer(n, 1, "<i8", "u1", "u1")[2]
            alpha = np.ones(len(contexts))
            alpha[self.unseen(n, counts) & (asks > 0)] = self.answer(CONTEXT + n, 0, "<f8")[0]
            p = np.where((counts > 0)[place], self.seen_grams(n, stats)[place], p * alpha[at])
        return p


def _chunks(rows: DataFrame, work) -> DataFrame:
    """Bring the rows of each chunk together and run ``work(chunk id, rows)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk,), group in runs(batches, 1):
            yield from work(chunk, group)

    return rows.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(run, ROW_SQL)


def count_requests(encoded: DataFrame, n: int, buckets: int, turn: tuple[int, int] = (0, 1)) -> DataFrame:
    """The n-grams of each chunk with their training counts, for the buckets k of round
    ``turn = (i, m)``: k mod m is i. Words: keys and counts; longer ones: contexts, and
    the size of each with keys and counts of its n-grams."""
    i, m = turn

    def work(chunk: int, c: Chunk) -> Iterator[pa.RecordBatch]:
        if n == 1:
            outer, place = c.grams(1)
            counts = np.bincount(place[c.train_token], minlength=len(outer)).astype(np.uint32)
            by, met, begin = c.dealt(outer)
            for bucket, a, b in zip(met.tolist(), begin[:-1], begin[1:]):
                yield _row(chunk, n, bucket, pack_keys(outer[by[a:b]]), pack(counts[by[a:b]]))
            return
        outer, at = c.contexts(n)
        _, met, begin = c.dealt(outer)
        now = np.repeat(met % m == i, np.diff(begin))  # contexts of this round
        here = np.flatnonzero(now[at])
        pairs, place = np.unique(at[here] * len(c.vocab) + c.codes[here], return_inverse=True)
        of = pairs // len(c.vocab)
        keys = mix64(outer[of] ^ c.vocab[pairs % len(c.vocab)]) & LOW
        counts = np.bincount(place[c.train_token[here]], minlength=len(pairs)).astype(np.uint32)
        sizes = np.bincount(of, minlength=len(outer)).astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        for bucket, a, b in zip(met.tolist(), begin[:-1], begin[1:]):
            if bucket % m == i:
                inner = slice(ends[a], ends[b])
                yield _row(chunk, n, bucket, pack_keys(outer[a:b]), pack(sizes[a:b], keys[inner], counts[inner]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, chunk in enumerate(batch.column(0).to_pylist()):  # a row is a whole chunk
                yield from work(chunk, Chunk(pa.Table.from_batches([batch.slice(k, 1)]), buckets))

    return encoded.mapInArrow(run, ROW_SQL)


def _totals(kind: int, bucket: int, counts: np.ndarray) -> pa.RecordBatch:
    n_r = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[: K + 2]
    n_r[0] = 0
    return _row(None, kind, bucket, pack(np.concatenate([n_r, [counts.sum(), (counts > 0).sum()]]).astype(np.int64)), b"")


def _answer_words(kind: int, bucket: int, group: pa.Table) -> Iterator[pa.RecordBatch]:
    keys = [unpack_keys(x.as_buffer()) for x in group["a"]]
    own = np.concatenate([unpack(x.as_buffer(), "<u4")[0] for x in group["b"]])
    uniq, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(place, weights=own, minlength=len(uniq)).astype(np.int64)
    at = 0
    for chunk, k in zip(group["chunk"].to_pylist(), keys):
        yield _row(chunk, kind, bucket, pack(counts[place[at : at + len(k)]]), b"")
        at += len(k)
    yield _totals(kind, bucket, counts)


def _answer_grams(kind: int, bucket: int, group: pa.Table) -> Iterator[pa.RecordBatch]:
    outer = [unpack_keys(x.as_buffer()) for x in group["a"]]
    sizes, low, own = (np.concatenate(x) for x in zip(*(unpack(x.as_buffer(), "<u4", "<u8", "<u4") for x in group["b"])))
    contexts, context = np.unique(np.concatenate(outer), return_inverse=True)
    inner = np.repeat(context, sizes)
    uniq, place = np.unique(mix64(contexts)[inner] ^ low, return_inverse=True)
    counts = np.bincount(place, weights=own, minlength=len(uniq)).astype(np.int64)
    of = np.empty(len(uniq), np.int64)
    of[place] = inner
    total = np.bincount(of, weights=counts, minlength=len(contexts)).astype(np.int64)
    asks = ((np.bincount(of, weights=counts == 0, minlength=len(contexts)) > 0) & (total > 0)).astype(np.uint8)
    least = np.full(len(contexts), K + 1, np.uint8)
    for r in range(K, 0, -1):
        least[of[counts == r]] = r
    owner = np.zeros(len(place), np.uint8)
    owned = np.full(len(uniq), -1)
    asked = np.flatnonzero(own > 0)[::-1]
    owned[place[asked]] = asked  # the first one is set last
    owner[owned[owned >= 0]] = 1
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    for chunk, k in zip(group["chunk"].to_pylist(), outer):
        grams, here = slice(ends[at], ends[at + len(k)]), context[at : at + len(k)]
        yield _row(chunk, kind, bucket, pack(counts[place[grams]], owner[grams]), pack(total[here], least[here], asks[here]))
        at += len(k)
    yield _totals(kind, bucket, counts)


def answer_counts(requests: DataFrame) -> DataFrame:
    """Corpus counts back to each chunk; a row of totals per bucket (chunk null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), group in runs(_keyed(batches), 2):
            yield from (_answer_words if kind == 1 else _answer_grams)(kind, bucket, group)

    return requests.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "chunk").mapInArrow(run, ROW_SQL)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select(["kind", "bucket", "chunk", "a", "b"])


def read_stats(answers: DataFrame) -> Stats:
    """Totals by order (one line per order reaches the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[int, np.ndarray] = {}
            for kind, a in zip(b.column(0).to_pylist(), b.column(1)):
                sums[kind] = sums.get(kind, 0) + unpack(a.as_buffer(), "<i8")[0]
            yield pa.RecordBatch.from_pydict({"kind": pa.array(list(sums), pa.int32()), "s": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})

    parts = answers.filter("chunk is null").select("kind", "a").mapInArrow(run, "kind int, s array<long>")
    cols = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(K + 4)]
    rows = parts.groupBy("kind").agg(*cols).collect()
    return Stats([{"kind": r["kind"], "n_r": [r[f"s{i}"] for i in range(K + 2)], "total": r[f"s{K + 2}"], "types": r[f"s{K + 3}"]} for r in rows])


def context_requests(rows: DataFrame, n: int, stats: Stats, buckets: int) -> DataFrame:
    """Sums over the n-grams that a chunk owns, for contexts that need a weight anywhere;
    a flag where the chunk itself needs it. A word that training saw after a context it
    saw after the shorter context too, so P(w | h') is that of a seen n-gram."""

    def work(chunk: int, group: pa.Table) -> Iterator[pa.RecordBatch]:
        c = Chunk(group, buckets)
        place, contexts, of = c.grams(n)[1], c.contexts(n)[0], c.context_of(n)
        counts, owned = c.answer(n, 0, "<i8", "u1")
        asks = c.answer(n, 1, "<i8", "u1", "u1")[2] > 0
        needs = c.unseen(n, counts) & asks
        mine = np.flatnonzero((owned > 0) & asks[of])
        sends = needs.copy()
        sends[of[mine]] = True
        shorter = np.zeros(len(counts), np.int64)
        shorter[place] = c.grams(n - 1)[1]
        lower, k = c.seen_grams(n - 1, stats)[shorter[mine]], counts[mine]
        freed = k - discounted(k, stats.d[n])
        sums = np.stack([np.bincount(of[mine], weights=x, minlength=len(contexts))[sends] for x in (k, freed, lower)])
        contexts, needs = contexts[sends], needs[sends].astype(np.uint8)
        _, met, begin = c.dealt(contexts)  # they ascend
        for bucket, a, b in zip(met.tolist(), begin[:-1], begin[1:]):
            yield _row(chunk, CONTEXT + n, bucket, pack_keys(contexts[a:b]), pack(needs[a:b], *sums[:, a:b]))

    return _chunks(rows, work)


def answer_contexts(requests: DataFrame) -> DataFrame:
    """alpha of each context back to the chunks that need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), group in runs(_keyed(batches), 2):
            keys = [unpack_keys(x.as_buffer()) for x in group["a"]]
            needs, *sums = (np.concatenate(x) for x in zip(*(unpack(x.as_buffer(), "u1", *["<f8"] * 3) for x in group["b"])))
            uniq, place = np.unique(np.concatenate(keys), return_inverse=True)
            alpha = context_weights(*(np.bincount(place, weights=x, minlength=len(uniq)) for x in sums))[place]
            at = 0
            for chunk, k in zip(group["chunk"].to_pylist(), keys):
                here = slice(at, at + len(k))
                if needs[here].any():
                    yield _row(chunk, kind, bucket, pack(alpha[here][needs[here] > 0]), b"")
                at += len(k)

    return requests.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "chunk").mapInArrow(run, ROW_SQL)


def _kept(df: DataFrame, path: str) -> DataFrame:
    """Written in the shared folder, partitioned by kind (order), and read back (blobs are
    compressed already, so files are not again); the step's shuffle files are deleted as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES)
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.partitionBy("kind").option("compression", "uncompressed").parquet(path)
    finally:
        conf.set(FREE_SHUFFLES, before)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.select("chunk", F.col("kind").cast("int").alias("kind"), "bucket", "a", "b")


def katz_scores(docs: DataFrame, held_out: tuple[int, int] = (7, 2), order: int = ORDER) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score (add-one words), score (Katz, order ``order``);
    learned from documents whose crc32 fold ``held_out = (n, r)`` is not r."""
    spark = docs.sparkSession
    folder = run_folder(spark, "katz")
    encoded = _kept(encode_chunks(docs, held_out), f"{folder}/encoded")
    buckets = max(1, encoded.filter(f"kind = {CODES}").count())
    answers = None
    for n in range(1, order + 1):
        m = 1 if n < 3 else ROUNDS
        for i in range(m):
            part = _kept(answer_counts(count_requests(encoded, n, buckets, (i, m))), f"{folder}/counts-{n}-{i}")
            answers = part if answers is None else answers.union(part)
    stats = read_stats(answers)
    rows = encoded.union(answers.filter("chunk is not null"))
    for n in range(2, order + 1):
        below = rows.filter(F.col("kind").isin(CODES, n - 1, n))
        rows = rows.union(_kept(answer_contexts(context_requests(below, n, stats, buckets)), f"{folder}/contexts-{n}"))

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, 1):
            c = Chunk(group, buckets)
            counts = c.word_counts()
            base = np.log10((counts + 1) / (stats.n + stats.v + 1))[c.codes]
            score = np.log10(c.probabilities(order, stats))
            at = c.bounds[:-1]  # every document has its end token
            n = len(c.ids)
            columns = [
                pa.array(c.ids, mask=c.null.astype(bool)),
                c.train == 0,
                np.diff(c.bounds),
                np.add.reduceat((counts > 0)[c.codes].astype(np.int64), at),
                np.full(n, stats.n),
                np.add.reduceat(base, at),
                np.add.reduceat(score, at),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) if isinstance(x, np.ndarray) else x for x, k in zip(columns, kinds)], names=names)

    x = rows.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return x.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
