"""Conversation prefix trie from sorted neighbours.

A node is a distinct sequence of first turns (role and text); its members are the
conversations that start with it. Turns are known by digests (120 bits of md5 of role
and text, hashed again with their position), so texts are read once and never shuffled.

1. ``ordered_turns`` numbers each conversation's turns by one range sort of all rows;
   numbers carry over partition borders, so a conversation of any length is spread over
   tasks.
2. Conversations become rows of at most ``segment`` turns: (segment number, key of what
   stands before, digests). The key of a prefix is the exclusive or of its digests.
   A longer conversation is a row per segment; a segment that no other conversation
   shares the start of is a bare chain, written out at once.
3. Segment numbers go from the deepest up. A segment's rows are sorted by key, digests
   and conv_id, so that the members of every node are neighbours, and cut into blocks of
   ``block_rows`` rows. In a block, the common prefix of each two neighbours is an edge;
   edges are taken in descending depth and join components by union-find: each merge
   makes a branching node (or adds to the one of that depth), the depths between it and
   its children are nodes of the same members.
4. A node that holds neither the first nor the last row of its block is complete. What is
   left of the block's forest are the prefixes of these two rows, contracted to sums of
   their closed children. These merge by key over all blocks. Sums over the subtrees of
   merged nodes: each merged node is counted in one block that has it (its ancestors are
   all there), added up along that block's two paths, then by key over blocks.
5. A segment's roots pass their children, leaves and saved tokens to the nodes of the
   segment above that they hang on.

A group of equal conversations, or a first turn that many share, is many blocks: no task
holds more than a block, and merged rows are one per block and depth. Only the hash over
a node's members is by nature one stream; its ids come joined, a row per block.

``rebuilt`` shares first turns between conversations, as branches of one dialogue would.

Result, a row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
n_children, n_leaves, saved_tokens, ends_sha256 (of the ids of the members that end here).

Cases: null role or text: empty. Null turn: before all others. Rows of equal turn
(repeated rows too): a turn each, in order of the md5 of role and text. Null conv_id: no
conversation, left out. Empty texts: turns like others. Empty table: empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import run_folder, written
from quire.llm.textblocks import ragged, runs

SEGMENT = 1024
BLOCK_ROWS = 4096
BLOCK_TURNS = 1 << 16
GROUP = 100
HEADS = 6

NOTHING = hashlib.sha256(b"").hexdigest()
KEY = ["ka", "kb", "depth"]
PART = (
    "closed boolean, block long, spine int, depth long, ka long, kb long, pa long, pb long, n long, conv long, parent_conv long, "
    "children long, leaves long, saved long, chars long, x_children long, x_leaves long, x_saved long, ends string, first_end long"
)
ENDS = "ka long, kb long, depth long, ends_sha256 string"


# --- turns -------------------------------------------------------------------
def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, hi, lo, chars): every turn with its place from 0 in its
    conversation, the digest of role and text, and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    word = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    x = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    x = x.select("conv_id", "turn", word(1).alias("hi"), word(16).alias("lo"), "chars")
    order = ["conv_id", "turn", "hi", "lo"]
    x = x.repartitionByRange(*order).sortWithinPartitions(*order)
    x = x.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    x = written(x, f"{run_folder(conversations.sparkSession, 'turns')}/ordered")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs_ = x.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs_ = runs_.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return x.join(runs_, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "hi", "lo", "chars")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h = crc32(c) % ``heads`` turns of conversation
    c - c % ``group`` in place of its own first h: (turns, (conv_id, n) of all, turnless
    ones too)."""
    folder = run_folder(turns.sparkSession, "rebuilt")
    turns = written(turns, f"{folder}/turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    given = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    size = given.groupBy("base").agg(F.count("*").alias("given"))
    ids = ids.join(size, "base", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    ids = written(ids.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), f"{folder}/ids")
    first = ids.join(given, "base").filter("pos < h").select("conv_id", "pos", "hi", "lo", "chars")
    rest = turns.filter(F.col("pos") >= h).join(ids.select("conv_id", (F.col("taken") - F.col("h")).alias("shift")), "conv_id")
    rest = rest.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "hi", "lo", "chars")
    return first.unionByName(rest), ids.select("conv_id", "n")


def segments(turns: DataFrame, ids: DataFrame, segment: int) -> DataFrame:
    """(seg, conv_id, ka, kb, t, chars, xa, xb, more): a row per conversation and
    ``segment`` turns; t: both digests of each turn in turn; ka, kb: key of the turns
    before; xa, xb: of this row's turns; more: the conversation goes on."""
    folder = run_folder(turns.sparkSession, "segments")
    x = turns.select("conv_id", F.expr(f"pos div {segment}").alias("seg"), "pos", F.xxhash64("hi", "pos").alias("a"), F.xxhash64("pos", "lo").alias("b"), "chars")
    x = x.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "chars"))).alias("t"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    pairs = F.flatten(F.transform("t", lambda v: F.array(v["a"], v["b"])))
    x = ids.join(x, "conv_id", "left").select(
        F.coalesce("seg", F.lit(0)).alias("seg"),
        "conv_id",
        F.coalesce(pairs, F.array().cast("array<long>")).alias("t"),
        F.coalesce(F.col("t.chars"), F.array().cast("array<long>")).alias("chars"),
        F.coalesce("xa", F.lit(0)).alias("xa"),
        F.coalesce("xb", F.lit(0)).alias("xb"),
        (F.col("n") > (F.coalesce("seg", F.lit(0)) + 1) * segment).alias("more"),
    )
    x = written(x, f"{folder}/rows")
    later = x.filter("seg > 0")
    own = x.select("conv_id", "seg", "xa", "xb").join(later.select("conv_id").distinct(), "conv_id", "left_semi")
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.select("conv_id", "seg", F.bit_xor("xa").over(before).alias("ka"), F.bit_xor("xb").over(before).alias("kb")).filter("seg > 0")
    zero = F.lit(0).cast("long")
    out = x.filter("seg = 0").select("*", zero.alias("ka"), zero.alias("kb")).unionByName(later.join(starts, ["conv_id", "seg"]))
    out.write.partitionBy("seg").parquet(f"{folder}/starts")
    return turns.sparkSession.read.schema(out.schema).parquet(f"{folder}/starts")


# --- one block's forest --------------------------------------------------------
def neighbour_lcp(ka, kb, off, a, b) -> np.ndarray:
    """Common first turns of each row and the next; -1 across different keys."""
    m = len(ka)
    least = np.minimum(np.diff(off)[:-1], np.diff(off)[1:])
    left, right = ragged(off[: m - 1], least), ragged(off[1:m], least)
    differ = np.flatnonzero((a[left] != a[right]) | (b[left] != b[right]))
    start = np.concatenate([[0], np.cumsum(least)[:-1]]) if m > 1 else np.zeros(0, np.int64)
    at = np.searchsorted(differ, start)
    first = np.append(differ, np.iinfo(np.int64).max)[at] - start
    lcp = np.minimum(first, least)
    return np.where((ka[:-1] == ka[1:]) & (kb[:-1] == kb[1:]), lcp, -1)


class Forest:
    """Explicit nodes (row ends and branching nodes) of a block, children before parents."""

    def __init__(self, lens, conv, more, extra, total_chars):
        m = len(lens)
        self.m, self.total = m, total_chars
        self.depth, self.lo, self.hi = list(map(int, lens)), list(range(m)), list(range(m))
        self.n, self.conv, self.ends = [1] * m, list(map(int, conv)), [1] * m
        self.kids, self.leaves, self.saved = [0] * m, [0] * m, [0] * m
        self.open_kids = [0] * m
        self.extra = [extra[i] if more[i] else None for i in range(m)]
        self.parent, self.alias = [-1] * m, {}

    def closed(self, e: int) -> bool:
        return self.lo[e] > 0 and self.hi[e] < self.m - 1

    def below(self, e: int) -> tuple[int, int, int]:
        """Children, leaves and saved tokens under a closed node, itself left out."""
        x = self.extra[e] or (0, 0, 0)
        kids = self.kids[e] + x[0]
        return kids, (self.leaves[e] + x[1] if kids else 1), self.saved[e] + x[2]

    def add(self, depth: int, lo: int, hi: int) -> int:
        for values, v in ((self.depth, depth), (self.lo, lo), (self.hi, hi), (self.n, 0), (self.conv, None), (self.ends, 0), (self.kids, 0), (self.leaves, 0), (self.saved, 0), (self.open_kids, 0), (self.extra, None), (self.parent, -1)):
            values.append(v)
        return len(self.depth) - 1

    def cover(self, p: int, c: int) -> None:
        """The members of c become members of p."""
        self.n[p] += self.n[c]
        self.conv[p] = self.conv[c] if self.conv[p] is None else min(self.conv[p], self.conv[c])
        self.lo[p], self.hi[p] = min(self.lo[p], self.lo[c]), max(self.hi[p], self.hi[c])

    def attach(self, c: int, p: int) -> None:
        """Component c hangs under node p: the depths between are nodes of c's members."""
        self.parent[c] = p
        if self.closed(c):
            _, leaves, saved = self.below(c)
            self.kids[p] += 1
            self.leaves[p] += leaves
            self.saved[p] += saved + (self.n[c] - 1) * int(self.total(self.lo[c], self.depth[p], self.depth[c]))
        else:
            self.open_kids[p] += 1
        self.cover(p, c)

    def unify(self, c: int, p: int) -> None:
        """Two nodes of one depth are one."""
        for values in (self.ends, self.kids, self.leaves, self.saved, self.open_kids):
            values[p] += values[c]
        self.extra[p] = self.extra[p] or self.extra[c]
        self.alias[c] = p
        self.cover(p, c)

    def merge(self, x: int, y: int, depth: int) -> int:
        """Join two components at their common depth; the node that they now have."""
        at_x, at_y = self.depth[x] == depth, self.depth[y] == depth
        if at_x and at_y:
            self.unify(y, x)
            return x
        if at_x or at_y:
            p, c = (x, y) if at_x else (y, x)
            self.attach(c, p)
            return p
        p = self.add(depth, self.lo[x], self.hi[y])
        self.attach(x, p)
        self.attach(y, p)
        return p


def build(forest: Forest, lcp: np.ndarray) -> None:
    """Union-find over the edges in descending depth, then a root for every tree."""
    root = list(range(forest.m))
    top = list(range(forest.m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for e in np.argsort(-lcp, kind="stable").tolist():
        depth = int(lcp[e])
        if depth < 0:
            break
        x, y = find(e), find(e + 1)
        node = forest.merge(top[x], top[y], depth)
        root[y] = x
        top[x] = node
    for i in range(forest.m):
        if root[i] == i and forest.depth[top[i]] > 0:
            t = top[i]
            forest.attach(t, forest.add(0, forest.lo[t], forest.hi[t]))


def block_parts(block: int, first_depth: int, ka, kb, conv, off, a, b, chars, more, extra) -> pa.RecordBatch:
    """The nodes of one block of sorted rows: closed ones whole, open ones contracted."""
    m = len(conv)
    lens = np.diff(off)
    ext = off + np.arange(m + 1)  # each row has one place more, for depth 0
    ka_of, kb_of, sums, own = (np.zeros(len(a) + m, np.int64) for _ in range(4))
    inner = np.ones(len(a) + m, bool)
    inner[ext[:-1]] = False
    for out, values, start in ((ka_of, a, ka), (kb_of, b, kb)):
        out[inner] = values
        whole = np.bitwise_xor.accumulate(out)
        before = np.where(np.arange(m) > 0, whole[np.maximum(ext[:-1] - 1, 0)], 0)
        out[:] = whole ^ np.repeat(before ^ start, lens + 1)
    own[inner] = chars
    sums[:] = np.cumsum(own)
    forest = Forest(lens, conv, more, extra, lambda row, p, d: sums[ext[row] + d] - sums[ext[row] + p])
    build(forest, neighbour_lcp(ka, kb, off, a, b))

    live = [e for e in range(len(forest.depth)) if e not in forest.alias]
    parent = [forest.parent[e] for e in live]
    while any(p in forest.alias for p in parent):
        parent = [forest.alias.get(p, p) for p in parent]
    ints = lambda values: np.array([values[e] for e in live], np.int64)
    depth, lo, hi, n, least = ints(forest.depth), ints(forest.lo), ints(forest.hi), ints(forest.n), ints(forest.conv)
    up = np.array([forest.depth[p] if p >= 0 else -1 for p in parent], np.int64)
    closed = (lo > 0) & (hi < m - 1)
    up_closed = np.array([p >= 0 and forest.closed(p) for p in parent], bool)
    up_conv = np.array([forest.conv[p] if p >= 0 else 0 for p in parent], np.int64)
    whole = np.array([forest.below(e) for e in live], np.int64).reshape(-1, 3)
    part = np.stack([ints(forest.kids), ints(forest.leaves), ints(forest.saved)], axis=1)
    more_of = np.array([forest.extra[e] or (0, 0, 0) for e in live], np.int64).reshape(-1, 3)
    ends, first_end = [None] * len(live), [None] * len(live)
    for k, e in enumerate(live):
        if forest.ends[e]:
            there = slice(forest.lo[e], forest.lo[e] + forest.ends[e])
            ids = conv[there][~more[there]].tolist()
            if ids:
                joined = ",".join(map(str, ids))
                ends[k], first_end[k] = (hashlib.sha256(joined.encode()).hexdigest() if closed[k] else joined), ids[0]

    size = depth - up
    place = ragged(ext[lo] + up + 1, size)
    of = np.repeat(np.arange(len(live)), size)
    at = place - ext[lo][of]  # depth of each node within the segment
    last, shut, deep = at == depth[of], closed[of], at > 0
    before = np.maximum(place - 1, 0)
    tail = (n[of] - 1) * (sums[(ext[lo] + depth)[of]] - np.where(deep, sums[before], sums[place]))
    at_top = at == up[of] + 1
    known = ~at_top | up_closed[of]
    pick = last.tolist()
    closed_list, of_list = shut.tolist(), of.tolist()
    columns = {
        "closed": pa.array(shut),
        "block": pa.array(np.full(len(of), block, np.int64)),
        "spine": pa.array(np.where(lo[of] == 0, np.where(hi[of] == m - 1, 0, 1), 2).astype(np.int32)),
        "depth": pa.array(first_depth + at),
        "ka": pa.array(ka_of[place]),
        "kb": pa.array(kb_of[place]),
        "pa": pa.array(ka_of[before], mask=~deep),
        "pb": pa.array(kb_of[before], mask=~deep),
        "n": pa.array(n[of]),
        "conv": pa.array(least[of]),
        "parent_conv": pa.array(np.where(at_top, up_conv[of], least[of]), mask=~(known & shut & deep)),
        "children": pa.array(np.where(last, np.where(shut, whole[of, 0], part[of, 0]), np.where(shut, 1, 0))),
        "leaves": pa.array(np.where(shut, whole[of, 1], np.where(last, part[of, 1], 0))),
        "saved": pa.array(np.where(shut, whole[of, 2] + tail, np.where(last, part[of, 2], 0))),
        "chars": pa.array(own[place]),
        **{f"x_{name}": pa.array(np.where(last & ~shut, more_of[of, i], 0)) for i, name in enumerate(("children", "leaves", "saved"))},
        "ends": pa.array([ends[k] if x and ends[k] else (NOTHING if c else None) for k, x, c in zip(of_list, pick, closed_list)], pa.string()),
        "first_end": pa.array([first_end[k] if x else None for k, x in zip(of_list, pick)], pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def forests(batches: Iterator[pa.RecordBatch], first_depth: int, block_rows: int, block_turns: int) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows into blocks and give each block's nodes."""
    turns_of = lambda t: t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) // 2
    partition, k, held, rows, turns = TaskContext.get().partitionId(), 0, [], 0, 0

    def made() -> pa.RecordBatch:
        x = pa.Table.from_batches(held).combine_chunks()
        col = lambda name: x[name].chunk(0)
        num = lambda name: col(name).to_numpy(zero_copy_only=False)
        t = col("t").flatten().to_numpy(zero_copy_only=False)
        lens = turns_of(col("t"))
        off = np.concatenate([[0], np.cumsum(lens)])
        extra = list(zip(*[col(f"x_{v}").to_pylist() for v in ("children", "leaves", "saved")]))
        return block_parts((partition << 32) + k, first_depth, num("ka"), num("kb"), num("conv_id"), off, t[0::2], t[1::2], col("chars").flatten().to_numpy(zero_copy_only=False), num("more").astype(bool), extra)

    for batch in batches:
        at = 0
        sizes = np.cumsum(turns_of(batch["t"]))
        while at < batch.num_rows:
            used = sizes[at - 1] if at else 0
            take = max(int(np.searchsorted(sizes, used + block_turns - turns, side="right")), at + (0 if rows else 1)) - at
            take = min(take, block_rows - rows, batch.num_rows - at)
            if take > 0:
                held.append(batch.slice(at, take))
                rows, turns, at = rows + take, turns + int(sizes[at + take - 1] - used), at + take
            if at < batch.num_rows or rows >= block_rows:
                yield made()
                k, held, rows, turns = k + 1, [], 0, 0
    if held:
        yield made()


# --- merging over blocks -------------------------------------------------------
def _ends(opened: DataFrame) -> DataFrame:
    """The hash over the ids that end at each open node: joined per block, hashed as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, glue = None, None, ""
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, digest.hexdigest())], names=[*KEY, "ends_sha256"])
        for batch in batches:
            for key, group in runs(iter([batch]), 3):
                if key != last:
                    if last is not None:
                        yield row()
                    last, digest, glue = key, hashlib.sha256(), ""
                for text in group["ends"]:
                    digest.update((glue + text.as_py()).encode())
                    glue = ","
        if last is not None:
            yield row()

    x = opened.filter("ends is not null").select(*KEY, "first_end", "ends")
    return x.repartition(*KEY).sortWithinPartitions(*KEY, "first_end").mapInArrow(run, ENDS)


def merged(parts: DataFrame, folder: str) -> DataFrame:
    """Nodes of all blocks: (depth, ka, kb, pa, pb, conv, parent_conv, n, children, leaves, saved, ends_sha256)."""
    opened, closed = parts.filter("not closed"), parts.filter("closed")
    total = lambda name: F.sum(name).alias(name)
    most = lambda name: F.max(name).alias(name)
    m = opened.groupBy(*KEY).agg(
        *[total(c) for c in ("n", "children", "leaves", "saved")], *[most(c) for c in ("chars", "pa", "pb", "x_children", "x_leaves", "x_saved")], F.min("conv").alias("conv"), F.min("block").alias("seen")
    )
    m = written(m, f"{folder}/merged")
    kids = m.groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("more_kids"))
    m = m.join(kids, KEY, "left").withColumn("children", F.col("children") + F.coalesce("more_kids", F.lit(0)) + F.col("x_children"))
    m = m.withColumns({
        "leaves": F.col("leaves") + F.col("x_leaves") + (F.col("children") == 0).cast("long"),
        "saved": F.col("saved") + F.col("x_saved") + (F.col("n") - 1) * F.col("chars"),
    })  # of the node and its closed children
    m = written(m.select(*KEY, "pa", "pb", "n", "conv", "children", "leaves", "saved", "seen"), f"{folder}/own")

    known = opened.select("block", "spine", *KEY).join(m.select(*KEY, "conv", "seen", "leaves", "saved"), KEY)
    known = written(known, f"{folder}/known")
    here = F.col("seen") == F.col("block")
    x = known.select("block", "spine", *KEY, *[F.when(here, F.col(c)).otherwise(0).alias(c) for c in ("leaves", "saved")])
    path = Window.partitionBy("block", "spine").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sides = Window.partitionBy("block")
    under = lambda c: F.sum(c).over(path) + F.when(F.col("spine") == 0, F.coalesce(F.sum(F.when(F.col("spine") > 0, F.col(c))).over(sides), F.lit(0))).otherwise(0)
    sums = x.select(*KEY, under("leaves").alias("leaves"), under("saved").alias("saved")).groupBy(*KEY).agg(total("leaves"), total("saved"))
    up = m.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv"))
    whole = m.drop("leaves", "saved", "seen").join(sums, KEY).join(up, ["pa", "pb", "depth"], "left").join(_ends(opened), KEY, "left")
    whole = whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))

    above = known.select("block", F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("open_conv"))
    loose = closed.filter("parent_conv is null and pa is not null").join(above, ["block", "pa", "pb", "depth"], "left").withColumn("parent_conv", F.col("open_conv"))
    names = ["depth", "ka", "kb", "pa", "pb", "conv", "parent_conv", "n", "children", "leaves", "saved", "ends_sha256"]
    rest = closed.filter("parent_conv is not null or pa is null").unionByName(loose.select(closed.columns)).withColumnRenamed("ends", "ends_sha256")
    return whole.select(names).unionByName(rest.select(names))


def prefix_trie(turns: DataFrame, ids: DataFrame, segment: int = SEGMENT, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of ``turns(conv_id, pos, hi, lo, chars)`` and conversations
    ``ids(conv_id, n)`` (unique conv_ids; those without turns end at the root)."""
    spark = turns.sparkSession
    folder = run_folder(spark, "trie")
    rows = segments(turns, ids, segment)
    starts = ["seg", "ka", "kb"]
    later = rows.filter("seg > 0")
    shared = written(later.groupBy(*starts).agg((F.count("*") > 1).alias("shared")), f"{folder}/shared")
    deepest = shared.filter("shared").agg(F.max("seg")).first()[0] or 0
    alone = later.join(shared.filter("not shared"), starts, "left_semi")
    none = spark.createDataFrame([], "seg long, ka long, kb long, x_children long, x_leaves long, x_saved long")
    chains = alone.select(*starts, F.lit(1).cast("long").alias("x_children"), F.lit(1).cast("long").alias("x_leaves"), F.lit(0).cast("long").alias("x_saved"))
    sums, found = none, []
    for seg in range(deepest, -1, -1):
        x = rows.filter(F.col("seg") == seg)
        if seg:
            x = x.join(shared.filter("shared"), starts, "left_semi")
        hang = sums.unionByName(chains.filter(F.col("seg") == seg + 1)).drop("seg")
        x = x.withColumns({"na": F.col("ka").bitwiseXOR(F.col("xa")), "nb": F.col("kb").bitwiseXOR(F.col("xb"))})
        hang = hang.withColumnsRenamed({"ka": "na", "kb": "nb"}).withColumn("more", F.lit(True))
        x = x.join(hang, ["na", "nb", "more"], "left")
        x = x.select("ka", "kb", "t", "conv_id", "chars", "more", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("x_children", "x_leaves", "x_saved")])
        order = ["ka", "kb", "t", "conv_id"]
        first = seg * segment
        x = x.repartitionByRange(*order).sortWithinPartitions(*order)
        x = x.mapInArrow(lambda b, first=first: forests(b, first, block_rows, block_turns), PART)
        nodes = written(merged(written(x, f"{folder}/parts-{seg}"), f"{folder}/{seg}"), f"{folder}/nodes-{seg}")
        if seg:  # a segment's root is a node of the segment above
            sums = nodes.filter(F.col("depth") == first).select(F.lit(seg).cast("long").alias("seg"), "ka", "kb", F.col("children").alias("x_children"), F.col("leaves").alias("x_leaves"), F.col("saved").alias("x_saved"))
            nodes = nodes.filter(F.col("depth") > first)
        found.append(nodes)

    c, one, zero, size = F.col, F.lit(1).cast("long"), F.lit(0).cast("long"), F.size("chars").cast("long")
    x = alone.select(*starts, "conv_id", "more", size.alias("size"), c("ka").bitwiseXOR(c("xa")).alias("na"), c("kb").bitwiseXOR(c("xb")).alias("nb"), F.explode(F.sequence(one, size)).alias("j"))
    top, bottom = c("j") == 1, c("j") == c("size")
    ends = bottom & ~c("more")
    tails = x.select(
        (c("seg") * segment + c("j")).alias("depth"),
        *[F.when(bottom, c(n)).alias(k) for n, k in (("na", "ka"), ("nb", "kb"))],
        *[F.when(top, c(n)).alias(k) for n, k in (("ka", "pa"), ("kb", "pb"))],
        c("conv_id").alias("conv"),
        F.when(~top, c("conv_id")).alias("parent_conv"),
        one.alias("n"),
        F.when(ends, zero).otherwise(one).alias("children"),
        one.alias("leaves"),
        zero.alias("saved"),
        F.when(ends, F.sha2(c("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    every = reduce(DataFrame.unionByName, [*found, tails])
    # the first nodes of later segments find their parents in the segment above
    above = every.filter((c("depth") > 0) & (c("depth") % segment == 0)).select(c("ka").alias("pa"), c("kb").alias("pb"), (c("depth") + 1).alias("depth"), c("conv").alias("up"))
    first = (c("depth") > 1) & ((c("depth") - 1) % segment == 0)
    hung = every.filter(first).join(above, ["pa", "pb", "depth"], "left").withColumn("parent_conv", c("up")).select(every.columns)
    names = {"conv": "conv_id", "parent_conv": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"}
    out = every.filter(~first).unionByName(hung).withColumnsRenamed(names)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
