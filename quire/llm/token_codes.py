"""Token ids as directly addressable codes (DACs).

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of
every id; bit i of its continuation bitmap says whether that id goes on, and the
next level holds a chunk only for ids that do. A rank directory counts the set
bits before every 512-bit block, so the place of an id's next chunk is one
directory entry plus at most eight popcounts: any token, or any span of tokens,
is read without decoding what stands before it.

File (``part-NNNNN.dac``), little-endian: segments of about ``SEGMENT_TOKENS``
ids (a document never straddles two), each

    docs, tokens, levels                        3 x u64
    doc ids i64[docs], id is null u8[docs], first token of each document u64[docs + 1]
    per level: chunks, directory entries 2 x u64; chunk u8[chunks];
               bitmap u64[ceil(chunks / 64)]; directory u64[ceil(chunks / 512) + 1]

then the segment offsets u64[segments + 1], their count u64 and the magic.

Cases: null or empty text: the end id alone. Null doc_id: kept, sorted first,
read back as null. Equal doc_ids: each row keeps its own entry, ordered by the
text's hash (equal rows have equal ids, so their order cannot matter). Empty
table: no file, no row. Extra columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.files import locate, write_whole
from quire.llm.shared import run_folder, written
from quire.llm.textblocks import blocks, hash_spans, letter_ends, lowered, ragged, words

MAGIC = b"DACTOK01"
END_ID = 2
SEGMENT_TOKENS = 1 << 20
CACHED_WORDS = 2_000_000
RANK_BITS = 512
BLOCK_BYTES = 4 << 20  # parts are looked up once per block


# ------------------------------------------------------------------ the codes
class Level:
    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, directory: np.ndarray):
        self.chunks, self.bitmap, self.directory = chunks, bitmap, directory

    @staticmethod
    def of(chunks: np.ndarray, more: np.ndarray) -> "Level":
        n = len(chunks)
        padded = np.zeros(-(-n // RANK_BITS) * RANK_BITS, np.uint8)
        padded[:n] = more
        directory = np.zeros(len(padded) // RANK_BITS + 1, np.uint64)
        directory[1:] = np.cumsum(padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint64))
        bitmap = np.packbits(padded[: -(-n // 64) * 64], bitorder="little").view("<u8")
        return Level(chunks, bitmap, directory)

    def bits(self, start: int, end: int) -> np.ndarray:
        a, b = start // 64, -(-end // 64)
        flat = np.unpackbits(self.bitmap[a:b].view(np.uint8), bitorder="little")
        return flat[start - a * 64 : end - a * 64].astype(bool)

    def rank(self, at: int) -> int:
        """Set bits before ``at``."""
        block = at // RANK_BITS
        return int(self.directory[block]) + int(self.bits(block * RANK_BITS, at).sum())


def encode_levels(ids: np.ndarray) -> list[Level]:
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        out.append(Level.of((rest & 0xFF).astype(np.uint8), more))
        if not more.any():
            return out
        rest = rest[more] >> 8


def decode_span(levels: list[Level], start: int, end: int) -> np.ndarray:
    """Ids ``start .. end`` of a segment."""
    out = np.zeros(max(0, end - start), np.uint32)
    live = np.arange(len(out))
    for depth, level in enumerate(levels):
        if start >= end:
            break
        out[live] |= level.chunks[start:end].astype(np.uint32) << np.uint32(8 * depth)
        more = level.bits(start, end)
        live = live[more]
        start, end = (level.rank(start), level.rank(end)) if len(live) else (0, 0)
    return out


# ------------------------------------------------------------------ the files
def _segment(docs: np.ndarray, null: np.ndarray, firsts: np.ndarray, ids: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    out = io.BytesIO()
    out.write(np.array([len(docs), len(ids), len(levels)], "<u8").tobytes())
    out.write(docs.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + firsts.astype("<u8").tobytes())
    for level in levels:
        out.write(np.array([len(level.chunks), len(level.directory)], "<u8").tobytes())
        out.write(level.chunks.tobytes() + level.bitmap.astype("<u8").tobytes() + level.directory.astype("<u8").tobytes())
    return out.getvalue()


class Segment:
    def __init__(self, data: bytes):
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        n_docs, self.n_tokens, n_levels = map(int, take("<u8", 3))
        self.docs, self.null, self.firsts = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            chunks, entries = map(int, take("<u8", 2))
            self.levels.append(Level(take("u1", chunks), take("<u8", -(-chunks // 64)), take("<u8", entries)))

    def token(self, i: int) -> int:
        return int(decode_span(self.levels, i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return decode_span(self.levels, int(self.firsts[k]), int(self.firsts[k + 1]))


def segments(uri: str) -> Iterator[Segment]:
    """The segments of one file, one in memory at a time."""
    system, path = locate(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 16)
        count, magic = f.read(8), f.read(8)
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        n = int.from_bytes(count, "little")
        f.seek(size - 16 - 8 * (n + 1))
        offsets = np.frombuffer(f.read(8 * (n + 1)), "<u8")
        for a, b in zip(offsets[:-1], offsets[1:]):
            f.seek(int(a))
            yield Segment(f.read(int(b - a)))


# ------------------------------------------------------------------ tokenizing
class WordEncoder:
    """Encodes whole texts by parts, keeping the ids of parts seen before.

    Needs a tokenizer whose pre-tokenizer drops white space, so that the ids of a
    text are those of its words in order. Where it also splits letters from what
    follows, a word's closing run of ASCII non-letters is a part of its own; where
    it lowers letters, parts that differ in A-Z / a-z only are one. Parts are kept
    by 64-bit hash, at most ``CACHED_WORDS`` or a block's own (then the store
    starts anew)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        one = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        if one("a,\n\t b.") != one("a,") + one("b."):
            raise ValueError("the tokenizer does not drop white space: words cannot be encoded apart")
        self.lower = "Lowercase" in str(self.tok.normalizer)
        self.split = "[\\p{L}]+" in str(self.tok.pre_tokenizer).replace("\\\\", "\\")
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, sizes, raw = [], [], data.tobytes()
        for a in range(0, len(keys), 4096):
            joined = b" ".join([raw[s:e] for s, e in zip(starts[a : a + 4096].tolist(), ends[a : a + 4096].tolist())])
            got = self.tok.encode(joined.decode(), add_special_tokens=False)
            size = (ends - starts)[a : a + 4096]
            begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])  # bytes, then characters
            begin = np.concatenate([[0], np.cumsum(np.frombuffer(joined, np.uint8) & 0xC0 != 0x80)])[begin]
            where = np.array([x[0] for x in got.offsets], np.int64)
            ids.append(np.array(got.ids, np.uint32))
            sizes.append(np.bincount(np.searchsorted(begin, where, side="right") - 1, minlength=len(size)))
        new_ids, new_sizes = np.concatenate(ids), np.concatenate(sizes)
        new_at = len(self.ids) + np.concatenate([[0], np.cumsum(new_sizes)[:-1]]).astype(np.int64)
        order = np.argsort(all_keys := np.concatenate([self.keys, keys]), kind="stable")
        self.keys = all_keys[order]
        self.at = np.concatenate([self.at, new_at])[order]
        self.sizes = np.concatenate([self.sizes, new_sizes])[order]
        self.ids = np.concatenate([self.ids, new_ids])

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.keys, keys)
        missing = place == len(self.keys)
        missing[~missing] = self.keys[place[~missing]] != keys[~missing]
        return place, missing

    def encode(self, block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block with the end id after each, and n + 1 offsets."""
        w = words(block, hashed=False)
        starts, ends, bounds = w.starts, w.ends, w.bounds
        if self.split and len(starts):
            cut = letter_ends(block.data, starts, ends)
            tail = cut < ends
            places = np.concatenate([[0], np.cumsum(1 + tail)])
            parts = np.empty(places[-1], np.int64), np.empty(places[-1], np.int64)
            parts[0][places[:-1]], parts[1][places[:-1]] = starts, cut
            parts[0][places[:-1][tail] + 1], parts[1][places[:-1][tail] + 1] = cut[tail], ends[tail]
            starts, ends, bounds = *parts, places[bounds]
        keys, first, back = np.unique(hash_spans(lowered(block.data) if self.lower else block.data, starts, ends), return_index=True, return_inverse=True)
        place, missing = self._places(keys)
        if len(self.keys) + int(missing.sum()) > CACHED_WORDS:  # begin anew with this block's parts
            self._clear()
            missing[:] = True
        if missing.any():
            fresh = first[missing]
            self._learn(keys[missing], block.data, starts[fresh], ends[fresh])
            place, _ = self._places(keys)
        size = self.sizes[place][back]
        total = np.concatenate([[0], np.cumsum(size)])[bounds]
        firsts = total + np.arange(block.n + 1)
        out = np.full(int(firsts[-1]), END_ID, np.uint32)
        body = np.ones(len(out), bool)
        body[firsts[1:] - 1] = False
        out[body] = self.ids[ragged(self.at[place][back], size)]
        return out, firsts


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ------------------------------------------------------------------ the jobs
def write_token_files(docs: DataFrame, vocab: str, folder: str) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the ids in ascending doc_id order,
    a file for each range of ids. Returns one row per file: file_no, path, n_docs,
    n_tokens."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        enc, no = encoder(vocab), TaskContext.get().partitionId()
        told = {"docs": 0, "tokens": 0}

        def fill(out) -> None:
            offsets, held, size = [0], [], 0

            def flush() -> None:
                nonlocal held, size
                if held:
                    ids, docs_, null, sizes = (np.concatenate(x) for x in zip(*held))
                    data = _segment(docs_, null, np.concatenate([[0], np.cumsum(sizes)]), ids)
                    out.write(data)
                    offsets.append(offsets[-1] + len(data))
                    told["docs"] += len(docs_)
                    told["tokens"] += len(ids)
                held, size = [], 0

            def every():
                yield first
                yield from batches

            for batch in every():
                doc = batch.column(0)
                null = np.asarray(doc.is_null())
                ids_ = np.asarray(doc.fill_null(0), np.int64)
                for block in blocks(batch.column(1), BLOCK_BYTES):
                    ids, firsts = enc.encode(block)
                    rows = slice(block.first, block.first + block.n)
                    held.append((ids, ids_[rows], null[rows], np.diff(firsts)))
                    size += len(ids)
                    if size >= SEGMENT_TOKENS:
                        flush()
            flush()
            out.write(np.array([*offsets, len(offsets) - 1], "<u8").tobytes() + MAGIC)

        path = write_whole(folder, f"part-{no:06d}.dac", fill)
        yield pa.RecordBatch.from_pydict(
            {"file_no": [no], "path": [path], "n_docs": [told["docs"]], "n_tokens": [told["tokens"]]},
            schema=pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    made = rows.mapInArrow(write, "file_no long, path string, n_docs long, n_tokens long")
    return written(made, f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    first = F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    files = manifest.select("file_no", "path", F.coalesce(first, F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for seg in segments(path):
                    crc = [zlib.crc32(seg.document(k).astype("<u4").tobytes()) for k in range(len(seg.docs))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seg.docs, pa.int64(), mask=seg.null), pa.array(start + seg.firsts[:-1]), pa.array(np.diff(seg.firsts)), pa.array(crc, pa.int64())],
                        schema=schema,
                    )
                    start += seg.n_tokens

    n = max(1, manifest.count())
    return files.repartition(n, "file_no").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, vocab: str) -> DataFrame:
    """Write the token files of ``docs`` in the shared folder and read them back."""
    folder = run_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, vocab, folder))
