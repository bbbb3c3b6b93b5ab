"""Benchmark decontamination by templates: finds benchmark items in documents even
where their numbers, names or units were replaced.

Words lose ASCII punctuation at both ends and A-Z is lowered. A template replaces

* numbers (a word of digits, with ``+ - . , : / %`` or a currency sign)  -> <num>
* units (``UNITS``) right after a number, or joined to one (``5kg``)      -> <unit>
* names (a capital A-Z first, then small letters; not opening a sentence) -> <name>

and keeps the replaced word as the slot's value. Names, or numbers, that follow each
other are one placeholder, their run is its value (``Anna Maria Berg``, ``3 1/2``).
Three kinds of windows of
``WINDOW`` words are hashed: *plain* (numbers and units replaced, names kept as
words, so that a change of case does not matter), *template* (names replaced as
well) and *verbatim* (nothing replaced). Plain and template windows need
``MIN_FIXED`` words that are not slots; verbatim ones need nothing, so a copy of
any item is found, sums, tables and number series too. In scripts written without
blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese) a character is a word.

1. Windows of all items; then one pass over the documents that emits only those
   of their windows whose hash an item has (the items' hashes are sent to the
   tasks if there are at most ``SENT_WINDOWS`` of them; beyond that every window
   of the documents goes to the join, same result).
2. Hash join of windows; for each (document, item, diagonal = shift between both)
   the slots must be consistent: a value of the item always became the same value
   of the document and no two became one, in each of num / name / unit. Verbatim
   windows count whatever the slots.
3. Words put in or left out, and runs of another length, move the rest of an item to
   another diagonal. Diagonals less than the item's length apart are judged together
   (bands of twice that length, each diagonal in two): from the one that covers most
   on, each that covers more words of the item is added if its slots agree with those
   before it.
4. An item is found in a document if the windows so gathered cover ``MIN_PERCENT`` of
   the item's words, or ``MIN_RUN`` words; an item of
   fewer words than a window must be found whole (``WINDOW`` shrinks to it; with
   placeholders from ``MIN_ITEM`` words on, verbatim from one word on). Of an item whose
   words hold under ``MIN_BYTES`` bytes (``a b``) the words must fill whole lines.

Cases: null or blank texts have no windows; null ids of documents or items are
ignored (they cannot be named in the result); equal items or documents: a row per
pair of ids. Empty tables: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import run_folder, written
from quire.llm.textblocks import Words, blocks, grams, hash_spans, lowered, mix64, words

WINDOW = 8
MIN_ITEM = 4
MIN_FIXED = 4
MIN_BYTES = 3
MIN_PERCENT = 50
MIN_RUN = 13
SENT_WINDOWS = 1_000_000

# Common units of measure, time, money and information.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs oz pound pounds "
    "ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years kmh mph hz khz mhz ghz b kb mb gb tb w kw v a j kj cal kcal c f k degree degrees percent "
    "meter meters metre metres kilometer kilometers kilometre kilometres cent cents dollar dollars euro euros usd eur"
).split()
NUM, UNIT, NAME = (mix64(np.array([x], np.uint64))[0] for x in (11, 12, 13))

_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_DIGITY = np.zeros(256, bool)
_DIGITY[[ord(c) for c in "0123456789+-.,:/%"]] = True
_DIGIT, _CAPITAL, _SMALL = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58], _CAPITAL[65:91], _SMALL[97:123] = True, True, True
_SMALL[128:] = True
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?:"]] = True
PLAIN, TEMPLATE, VERBATIM = 0, 1, 2
_MEASURE = re.compile(rb"[0-9][0-9.,:/]*([a-z]+)$")


def _units() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(u) for u in raw])
    return np.unique(hash_spans(data, ends - [len(u) for u in raw], ends))


_UNIT_HASHES = _units()


def _unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each character of a script written without blanks."""
    second = np.append(data[1:], np.uint8(0))
    three = (data >= 0xE3) & (data <= 0xE9)  # U+3000 .. U+9FFF
    three |= (data == 0xE0) & (second >= 0xB8) & (second <= 0xBB)  # Thai, Lao
    three |= (data == 0xE1) & ((second <= 0x82) | (second == 0x9E) | (second == 0x9F))  # Burmese, Khmer
    four = (data == 0xF0) & (second >= 0xA0)  # U+20000 and beyond
    at = np.flatnonzero(three | four)
    return at, np.minimum(at + 3 + four[at], len(data))


def _split(w: Words, data: np.ndarray) -> Words:
    """Words cut before and after every such character."""
    at, after = _unspaced(data)
    if not len(at):
        return w
    inside = np.zeros(len(data) + 1, bool)  # a cut at a word's own edge changes nothing
    inside[at] = inside[after] = True
    inside[w.ends] = False
    inside[w.starts] = True
    blank = np.ones(len(data) + 1, np.int8)
    blank[:-1] = np.cumsum(np.bincount(w.starts, minlength=len(data) + 1) - np.bincount(w.ends, minlength=len(data) + 1))[:-1] == 0
    starts = np.flatnonzero(inside & (blank == 0))
    stop = np.minimum(np.append(starts[1:], len(data)), w.ends[np.searchsorted(w.starts, starts, side="right") - 1])
    return Words(starts, stop, np.searchsorted(starts, np.append(w.starts, len(data))[w.bounds]))


class Canonical:
    """The words of a block without blank-only parts: plain hash, slot kind
    (0 none, 1 num, 2 name, 3 unit) and byte span of each."""

    def __init__(self, block):
        data = block.data
        w = _split(words(block, hashed=False), data)
        inner = np.where(~_EDGE[data], np.arange(len(data)), -1)
        last = np.maximum.accumulate(inner) if len(data) else inner
        nxt = np.where(~_EDGE[data], np.arange(len(data)), len(data))
        nxt = np.minimum.accumulate(nxt[::-1])[::-1] if len(data) else nxt
        starts, ends = nxt[w.starts], last[w.ends - 1] + 1
        solid = (starts < w.ends) & (ends > w.starts)  # words of punctuation alone drop out
        closes = _SENTENCE_END[data[w.ends - 1]]
        row = w.rows()
        # a word opens a sentence if it is a text's first or the word before it closes one
        opens = np.ones(len(row), bool)
        opens[1:] = (row[1:] != row[:-1]) | closes[:-1]
        line = np.cumsum(data == 10)[w.starts] if len(row) else row
        self.starts, self.ends, opens, row, line = starts[solid], ends[solid], opens[solid], row[solid], line[solid]
        # word k is the first of its line; so is the end of all words
        self.line_first = np.ones(len(row) + 1, bool)
        self.line_first[1:-1] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        self.row, self.bounds = row, np.searchsorted(row, np.arange(block.n + 1))
        size = self.ends - self.starts
        low = lowered(data)
        plain = hash_spans(low, self.starts, self.ends)

        def every(table):
            total = np.concatenate([[0], np.cumsum(table[data])])
            return total[self.ends] - total[self.starts]

        head = data[self.starts] if len(self.starts) else np.zeros(0, np.uint8)
        digits = every(_DIGIT)
        num = (digits > 0) & (every(_DIGITY) == size)
        name = _CAPITAL[head] & (every(_SMALL) == size - 1) & (size > 1) & ~opens
        unit = np.isin(plain, _UNIT_HASHES)
        unit[1:] &= num[:-1] & (row[1:] == row[:-1])
        unit[:1] = False
        joined = np.flatnonzero((digits > 0) & ~num & _DIGIT[head])
        for i in joined:  # 5kg: a number with its unit
            found = _MEASURE.match(low[self.starts[i] : self.ends[i]].tobytes())
            num[i] = bool(found and found[1].decode() in _UNIT_SET)
        self.kind = np.where(num, 1, np.where(unit, 3, np.where(name, 2, 0))).astype(np.int8)
        self.word, self.n = plain, block.n
        self.plain = np.where(num, NUM, np.where(unit, UNIT, plain))
        self.template = np.where(name & ~num & ~unit, NAME, self.plain)

    def channels(self) -> Iterator[Channel]:
        yield Channel(PLAIN, self, self.plain, np.where(self.kind == 2, 0, self.kind))
        yield Channel(TEMPLATE, self, self.template, self.kind)
        yield Channel(VERBATIM, self, self.word, np.zeros_like(self.kind))


class Channel:
    """The words of a block with runs of names or numbers as one: hash, slot kind and
    value of each element, and the word it begins at (``first``, one more at the end)."""

    def __init__(self, number: int, c: Canonical, what: np.ndarray, kind: np.ndarray):
        n = len(what)
        begins = np.ones(n, bool)
        begins[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] != 1) & (kind[1:] != 2)) | (c.row[1:] != c.row[:-1])
        at = np.flatnonzero(begins)
        self.number, self.first = number, np.append(at, n)
        self.hashes, self.kind, self.row = what[at], kind[at], c.row[at]
        self.bounds = np.searchsorted(self.row, np.arange(c.n + 1))
        place = np.arange(n) - np.repeat(at, np.diff(self.first))
        self.value = np.add.reduceat(mix64(c.word ^ mix64(place.astype(np.uint64))), at) if n else c.word
        self.names, self.line_first = c.kind[at] == 2, c.line_first
        self.chars = np.concatenate([[0], np.cumsum(c.ends - c.starts)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first elements."""
        h, at = grams(self.hashes, self.bounds, size)
        if self.number == VERBATIM:
            ok = (self.chars[at + size] - self.chars[at] >= MIN_BYTES) | (self.line_first[at] & self.line_first[at + size])
        else:
            fixed = np.concatenate([[0], np.cumsum(self.kind == 0)])
            ok = fixed[at + size] - fixed[at] >= min(MIN_FIXED, size) if size >= MIN_ITEM else np.zeros(len(at), bool)
            if self.number == TEMPLATE:
                named = np.concatenate([[0], np.cumsum(self.names)])
                ok &= named[at + size] > named[at]  # else the plain window says it all
        return mix64(h[ok] ^ np.uint64(3 * size + self.number)), at[ok]


_UNIT_SET = set(UNITS)
WINDOW_SQL = "id long, channel int, size int, h long, pos long, span int, length long, slots array<struct<kind:int,value:long>>"


def _windows(batches: Iterator[pa.RecordBatch], sizes, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Windows of texts (id, text); ``sizes``: by number of words, or a list."""
    slot = pa.struct([("kind", pa.int32()), ("value", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("channel", pa.int32()), ("size", pa.int32()), ("h", pa.int64()), ("pos", pa.int64()), ("span", pa.int32()), ("length", pa.int64()), ("slots", pa.list_(slot))])
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for block in blocks(batch.column(1)):
            canonical = Canonical(block)
            length = np.diff(canonical.bounds)
            for c in canonical.channels():
                elements = np.diff(c.bounds)
                for size in sizes:
                    h, at = c.windows(size)
                    row = c.row[at]
                    # an item is cut into windows of one size only: its own length if that is less
                    keep = np.ones(len(at), bool) if wanted is not None else np.minimum(elements[row], WINDOW) == size
                    if wanted is not None and len(wanted):
                        place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                        keep = wanted[place] == h
                    h_, at_, row_ = h[keep], at[keep], row[keep]
                    for a in range(0, len(at_), 1 << 16):
                        some = slice(a, a + (1 << 16))
                        at, part = at_[some], row_[some]
                        around = (at[:, None] + np.arange(size)).reshape(-1)
                        kind = c.kind[around]
                        is_slot = kind > 0
                        per = is_slot.reshape(-1, size).sum(axis=1)
                        slots = pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()),
                            pa.StructArray.from_arrays([pa.array(kind[is_slot], pa.int32()), pa.array(c.value[around][is_slot].view(np.int64))], fields=list(slot)),
                        )
                        n, first = len(at), c.first[at]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids[block.first + part], pa.int64()), pa.array(np.full(n, c.number, np.int32)), pa.array(np.full(n, size, np.int32)), pa.array(h_[some].view(np.int64)),
                                pa.array(first - canonical.bounds[part]), pa.array(c.first[at + size] - first, pa.int32()), pa.array(length[part]), slots,
                            ],
                            schema=schema,
                        )


def _named(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), "text").filter("id is not null and text is not null")


def found_items(docs: DataFrame, items: DataFrame, sent: int = SENT_WINDOWS) -> DataFrame:
    """``docs(doc_id, text)``, ``items(item_id, text)`` -> one row per document and
    item found in it: doc_id, item_id, covered (words of the item), item_words,
    reparameterised (a slot's value differs), first_word (place in the document)."""
    spark: SparkSession = docs.sparkSession
    sizes = list(range(1, WINDOW + 1))
    item_rows = _named(items, "item_id").mapInArrow(lambda b: _windows(b, sizes, None), WINDOW_SQL)
    item_windows = written(item_rows, run_folder(spark, "templates"))
    hashes = item_windows.select("h", "size").distinct()
    n = hashes.count()
    if n == 0:
        wanted, used = np.zeros(1, np.uint64), [WINDOW]
    elif n <= sent:  # at most 8 MB, checked
        got = hashes.collect()
        wanted, used = np.unique(np.array([r[0] for r in got], np.int64).view(np.uint64)), sorted({r[1] for r in got})
    else:
        wanted, used = np.zeros(0, np.uint64), [r[0] for r in hashes.select("size").distinct().collect()]
    shared = spark.sparkContext.broadcast(wanted)
    doc_windows = _named(docs, "doc_id").mapInArrow(lambda b: _windows(b, used, shared.value), WINDOW_SQL)

    d = doc_windows.select(F.col("id").alias("doc_id"), "channel", "size", "h", F.col("pos").alias("doc_pos"), F.col("slots").alias("doc_slots"))
    i = item_windows.select(F.col("id").alias("item_id"), "channel", "size", "h", "pos", "span", "length", "slots")
    if n <= sent and item_windows.count() <= sent:  # equal items share hashes, not rows
        i = F.broadcast(i)
    hits = d.join(i, ["h", "channel", "size"])
    # a diagonal holds at most the item's own windows, so its sets are bounded by the item
    value = F.transform(F.arrays_zip("slots", "doc_slots"), lambda z: F.struct(z["slots"]["kind"].alias("kind"), z["slots"]["value"].alias("of"), z["doc_slots"]["value"].alias("to")))
    used_by = (("all", F.lit(True)), ("plain", F.col("channel") != TEMPLATE), ("verbatim", F.col("channel") == VERBATIM))
    diagonal = hits.withColumn("value", value).groupBy("doc_id", "item_id", (F.col("doc_pos") - F.col("pos")).alias("shift")).agg(
        F.first("length").alias("length"),
        *[
            x
            for tag, when in used_by
            for x in (
                F.collect_set(F.when(when, F.struct("pos", "span"))).alias(f"{tag}_at"),
                F.array_distinct(F.flatten(F.collect_set(F.when(when, F.col("value"))))).alias(f"{tag}_slots"),
            )
        ],
    )

    def consistent(slots):
        kinds = lambda name: F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["kind"].alias("kind"), s[name].alias("v")))))
        return (kinds("of") == F.size(slots)) & (kinds("to") == F.size(slots))

    def covered(tag: str):
        return F.array_distinct(F.flatten(F.transform(f"{tag}_at", lambda w: F.sequence(w["pos"], w["pos"] + w["span"] - 1))))

    def judged(tag: str):
        """What one kind of windows covers on the diagonal, if its slots are consistent."""
        return F.when(consistent(F.col(f"{tag}_slots")), F.struct(covered(tag).alias("words"), F.col(f"{tag}_slots").alias("slots")))

    # all windows together, or those without names or without any slot where the slots are inconsistent
    parts = F.array_compact(F.array(*[judged(tag) for tag, _ in used_by]))
    pieces = diagonal.select("doc_id", "item_id", "shift", "length", F.explode(parts).alias("p")).filter("size(p.words) > 0")
    # diagonals less than the item's length apart share a band; a band holds at most 2 x length of them
    width = F.greatest("length", F.lit(WINDOW))
    band = F.floor(F.col("shift") / width)
    pieces = pieces.withColumn("band", F.explode(F.array(band, band - 1)))
    # the largest first; the same diagonal's other kinds follow it and only add what it lacks
    piece = F.struct((-F.size("p.words")).alias("less"), F.size("p.slots").alias("n_slots"), "shift", "p.words", "p.slots")
    bands = pieces.groupBy("doc_id", "item_id", "band").agg(F.first("length").alias("length"), F.sort_array(F.collect_list(piece)).alias("pieces"))

    def gathered(so_far, x):
        words, slots = F.array_union(so_far["words"], x["words"]), F.array_union(so_far["slots"], x["slots"])
        more = (F.size(words) > F.size(so_far["words"])) & consistent(slots)
        return F.when(more, F.struct(words.alias("words"), slots.alias("slots"))).otherwise(so_far)

    first = F.col("pieces")[0]
    start = F.struct(first["words"].alias("words"), first["slots"].alias("slots"))
    bands = bands.select("doc_id", "item_id", "length", first["shift"].alias("shift"), F.aggregate(F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0))), start, gathered).alias("g"))
    bands = bands.select("doc_id", "item_id", "length", "shift", F.size("g.words").alias("covered"), (~F.exists("g.slots", lambda s: s["of"] != s["to"])).alias("same"))
    enough = (100 * F.col("covered") >= MIN_PERCENT * F.col("length")) | (F.col("covered") >= MIN_RUN)
    best = F.max(F.struct("covered", "same", (-F.col("shift")).alias("at"))).alias("best")
    found = bands.filter(enough).groupBy("doc_id", "item_id").agg(F.first("length").alias("item_words"), best)
    return found.select(
        "doc_id", "item_id",
        F.col("best.covered").cast("long").alias("covered"),
        F.col("item_words").cast("long").alias("item_words"),
        (~F.col("best.same")).alias("reparameterised"),
        F.greatest(-F.col("best.at"), F.lit(0)).alias("first_word"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item was found (all columns)."""
    bad = found_items(docs, items).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_bad"], "left_anti")
