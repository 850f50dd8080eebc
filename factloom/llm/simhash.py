"""SimHash near-duplicates by a binary trie self-join.

Fingerprints come from word shingles in numpy. Equal fingerprints become one
node, which is the fingerprint itself; doc_ids are labels only. A binary trie of
the distinct fingerprints is joined with itself: pairs of nodes go down
together, one bit a step, adding up the bits that differ, and a pair is dropped
as soon as they exceed the budget. A subtree is a stretch of a sorted array, so
a step handles all open pairs of nodes at once.

To deal the trie to tasks without copies for every prefix within the budget, its
bits are taken in several orders. The 64 bits are cut into budget + agree
stretches; two fingerprints within the budget agree on all bits of some `agree`
stretches. So there is a trie for each choice of these, with their bits first,
in which the pair lies in one subtree at that depth. A fingerprint has 5 copies
(agree = 1) until subtrees outgrow a task, then 15 (agree = 2), and so on.

A task returns a spanning forest of its links, no more rows than it has
fingerprints. Subtrees larger than `per_task` are cut into slices, all pairs of
which are compared. Components then spread their smallest label over the links,
a checkpoint a round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import checkpointed, give_back, shuffle_partitions, written

SEED, BITS = 42, 64
#: Pairs of nodes opened, and fingerprints compared, at once. Both bound memory only.
OPEN, COMPARED = 1 << 18, 1 << 19
#: Fingerprints of a subtree, on average, beyond which tries are dealt by one more stretch. It decides copies, no links.
SUBTREE = 4096


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def fingerprint(text: str | None, size: int = 4) -> int:
    """64 bits, each 1 if set in over half the hashes of the shingles of `size` words; 0 without words."""
    return signature(text, size)[0]


def signature(text: str | None, size: int = 4, more: int = 0) -> list[int]:
    """The fingerprint, and as many more of the same shingles by other hashes."""
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return [0] * (1 + more)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(found) - size + 1)
    shingles = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[min(size, len(found)) - 1 :].tolist(), strict=True)]
    out = []
    for seed in range(SEED, SEED + 1 + more):
        hashes = np.array([xxhash.xxh64_intdigest(x, seed) for x in shingles], np.uint64)
        counts = np.zeros(BITS, np.int64)
        for at in range(0, n, 1 << 16):
            counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, size: int = 4, text: str = "text", more: int = 0) -> DataFrame:
    """docs with fp long, the 64 bits of the whole text's fingerprint as a signed number, and fps, it and `more` others."""
    kept = [c for c in docs.columns if c not in ("fp", "fps")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("fp", T.LongType()), T.StructField("fps", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = np.array([signature(x, size, more) for x in batch.column(text).to_pylist()], np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * (1 + more), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(np.ascontiguousarray(found[:, 0])), lists], names=[*kept, "fp", "fps"])
        give_back()

    return docs.mapInArrow(run, schema)


class Forest:
    """Union-find over the places of one task's fingerprints."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if np.array_equal(x, y):
                return x
            self.up[x] = self.up[y]
            x = y

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.up, high, low)


def trie_links(values: np.ndarray, nodes: np.ndarray, bit: int, budget: int, near: Near) -> Forest:
    """Links between the fingerprints of each pair of nodes, stretches [a0, a1) and [b0, b1) that agree before the bit.

    Values are unsigned and sorted within a stretch; near says which of some pairs of places link.
    """
    forest = Forest(len(values))
    levels = [(np.column_stack([nodes, np.zeros(len(nodes), np.int64)]), bit)]
    while levels:
        nodes, bit = levels.pop()
        if len(nodes) > OPEN:
            levels += [(part, bit) for part in np.array_split(nodes, math.ceil(len(nodes) / OPEN))]
            continue
        sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        done = (sizes <= 256) | (bit == BITS)
        leaves = nodes[done]
        if len(leaves):
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[done]) // COMPARED)) + 1
            for part in np.split(leaves, cuts):
                _compare(part, near, forest)
        nodes = nodes[~done]
        if not len(nodes):
            continue
        flag = np.uint64(1 << (BITS - 1 - bit))
        mid_a, mid_b = (_bisect(values, nodes[:, i], nodes[:, i + 1], flag) for i in (0, 2))
        a0, a1, b0, b1, err = nodes.T
        apart = ~((a0 == b0) & (a1 == b1))
        down = [np.stack(q, 1) for q in ((a0, mid_a, b0, mid_b, err), (mid_a, a1, mid_b, b1, err), (a0, mid_a, mid_b, b1, err + 1))]
        down.append(np.stack((mid_a, a1, b0, mid_b, err + 1), 1)[apart])
        nodes = np.concatenate(down)
        levels.append((nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (nodes[:, 4] <= budget)], bit + 1))
    return forest


def _bisect(values: np.ndarray, low: np.ndarray, high: np.ndarray, flag: np.uint64) -> np.ndarray:
    """Per stretch, the first place with the bit set, by halving all stretches together."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        set_ = (values[np.minimum(mid, len(values) - 1)] & flag) != 0
        high = np.where(open_ & set_, mid, high)
        low = np.where(open_ & ~set_, mid + 1, low)
    return low


def _compare(nodes: np.ndarray, near: Near, forest: Forest) -> None:
    """Compares all pairs of fingerprints of each pair of nodes."""
    wide = nodes[:, 3] - nodes[:, 2]
    sizes = (nodes[:, 1] - nodes[:, 0]) * wide
    which = np.repeat(np.arange(len(nodes)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    a, b = nodes[which, 0] + place // wide[which], nodes[which, 2] + place % wide[which]
    linked = near(a, b)
    forest.link(a[linked], b[linked])


def segments(budget: int, agree: int) -> list[tuple[int, int]]:
    """First bit and length of budget + agree stretches of the 64 bits."""
    edges = [round(i * BITS / (budget + agree)) for i in range(budget + agree + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def choices(budget: int, agree: int) -> list[tuple[int, ...]]:
    """Every way to choose the stretches in which two fingerprints agree: one of them fits any pair within the budget."""
    return list(combinations(range(budget + agree), agree))


def fewest(fingerprints: int, budget: int) -> int:
    """Stretches to agree on, so that their values tell fingerprints apart into subtrees of bounded size."""
    agree = 1
    while agree < BITS - budget and BITS * agree / (budget + agree) < math.log2(max(1, fingerprints) / SUBTREE):
        agree += 1
    return agree


def chosen_first(fp: np.ndarray, parts: list[tuple[int, int]], chosen: tuple[int, ...]) -> np.ndarray:
    """The bits of fingerprints in another order: the chosen stretches first."""
    out = np.zeros(len(fp), np.uint64)
    for i in [*chosen, *(i for i in range(len(parts)) if i not in chosen)]:
        start, size = parts[i]
        out = out << np.uint64(size) | (fp >> np.uint64(BITS - start - size)) & np.uint64((1 << size) - 1)
    return out


def _key(fp: Column, parts: list[tuple[int, int]], chosen: tuple[int, ...]) -> Column:
    """The chosen stretches of a fingerprint as one number."""
    key = F.lit(0).cast("long")
    for i in chosen:
        start, size = parts[i]
        key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, BITS - start - size).bitwiseAND(F.lit((1 << size) - 1)))
    return key


def links(prints: DataFrame, budget: int = 4, per_task: int = 16_384, within: int | None = None) -> DataFrame:
    """Links a, b (nodes) that join the same fingerprints as all pairs within the budget; prints: node long, fps array<long>, each distinct.

    Every fingerprint of a node has a trie of its own. With several of them, a pair links if those of one trie
    are within the budget, and all of them together differ in at most `within` bits.
    """
    count = prints.count()
    tries = int(prints.agg(F.max(F.size("fps"))).first()[0] or 1)
    agree = fewest(count, budget)
    parts, ways = segments(budget, agree), choices(budget, agree)
    copies = F.array(*[F.struct(F.lit(t * len(ways) + i).alias("way"), _key(F.get("fps", F.lit(t)), parts, w).alias("key")) for t in range(tries) for i, w in enumerate(ways)])
    dealt = prints.select("node", "fps", F.explode(copies).alias("c")).select("node", "fps", "c.*")
    # subtrees beyond a task's size, fewer than there are copies of a task's size, are cut into slices that meet in pairs
    large = checkpointed(dealt.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_task).select("way", "key", F.ceil(2 * F.col("n") / per_task).cast("int").alias("slices")))
    tasks = max(1, math.ceil(count * tries * len(ways) / (8 * per_task)), shuffle_partitions(prints.sparkSession))
    cut = dealt.join(F.broadcast(large), ["way", "key"], "left")
    small = cut.where("slices is null").select(F.pmod(F.xxhash64("way", "key"), F.lit(tasks)).alias("task"), F.lit(0).alias("s1"), F.lit(0).alias("s2"), F.lit(0).alias("side"), "way", "node", "fps")
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda o: F.struct(F.least(o, own).alias("s1"), F.greatest(o, own).alias("s2"), (o < own).cast("int").alias("side"))))
    sliced = cut.where("slices is not null").select((-1 - F.xxhash64("way", "key").bitwiseAND(F.lit((1 << 62) - 1))).alias("task"), met.alias("m"), "way", "node", "fps").select("task", "m.*", "way", "node", "fps")

    def run(table: pa.Table) -> pa.Table:
        side, way, node = (table.column(c).to_numpy() for c in ("side", "way", "node"))
        flat = table.column("fps").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        y = np.empty(len(node), np.uint64)
        for w in np.unique(way).tolist():
            own = way == w
            y[own] = chosen_first(flat[own, w // len(ways)], parts, ways[w % len(ways)])
        bit = {i: sum(parts[j][1] for j in w) for i, w in enumerate(ways)}
        shift = np.array([BITS - bit[w % len(ways)] for w in range(tries * len(ways))], np.uint64)
        key = y >> shift[way]
        order = np.lexsort((y, side, key, way))
        side, way, node, y, key, flat = side[order], way[order], node[order], y[order], key[order], flat[order]
        starts = np.flatnonzero(np.r_[True, (way[1:] != way[:-1]) | (key[1:] != key[:-1])])
        ends = np.r_[starts[1:], len(y)]
        first_bit = min(bit.values())

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            close = np.bitwise_count(y[a] ^ y[b]) <= budget
            if within is not None:
                some = np.flatnonzero(close)
                close[some] = np.bitwise_count(flat[a[some]] ^ flat[b[some]]).sum(1) <= within
            return close

        if table.column("s1")[0].as_py() == table.column("s2")[0].as_py():
            nodes = np.stack([starts, ends, starts, ends], 1)
        else:
            middle = starts + np.add.reduceat(side == 0, starts)
            nodes = np.stack([starts, middle, middle, ends], 1)
        nodes = nodes[(nodes[:, 3] - nodes[:, 2] > 0) & (nodes[:, 1] - nodes[:, 0] > 0)]
        forest = trie_links(y, nodes, first_bit, budget, near)
        root = forest.root(np.arange(len(y)))
        own = np.flatnonzero(root != np.arange(len(y)))
        found = pa.table({"a": node[root[own]], "b": node[own]})
        del forest, y, flat, side, order
        give_back()
        return found

    return small.union(sliced).groupBy("task", "s1", "s2").applyInArrow(run, "a long, b long")


def components(found: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of the links a, b.

    Every round each node takes the smallest label around it, and then the label of that label; a round's
    state is a checkpoint. Rounds grow with the logarithm of the longest chain of links, or a little faster.
    """
    edges = checkpointed(found.select("a", "b").union(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    state = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = edges.join(state.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        hop = state.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = state.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        moved = checkpointed(hop.join(jump, "low").select("node", F.least("low", "lower").alias("label"), (F.least("low", "lower") != F.col("label")).alias("moved")))
        state = moved.select("node", "label")
        if not moved.where("moved").limit(1).count():
            return state.select("node", F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 4, budget: int = 4, per_task: int = 16_384, more: int = 0, within: int | None = None) -> DataFrame:
    """doc_id, row (a hash of the text), fp, group long and component_id for each row of docs.

    Documents link if their fingerprints differ in at most `budget` bits; with `more` further fingerprints of the
    same shingles, if those of one kind do and all bits together differ in at most `within`. group names the linked
    texts (with one fingerprint: by the smallest) and component_id is the smallest doc_id among them. Groups without
    a link between them can share a component_id if a doc_id repeats or is null. Null and empty texts have
    fingerprint 0 and link like any other. A row with a null doc_id counts as the largest doc_id and keeps a null
    doc_id in the result. Repeated rows stay repeated; texts are taken whole; other columns are not read; an empty
    table gives an empty result.
    """
    last = F.lit((1 << 63) - 1)
    prints = written(fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("row")), size, more=more).select("doc_id", "row", "fp", "fps", (F.xxhash64("fps") if more else F.col("fp")).alias("node")), "fingerprints")
    nodes = checkpointed(prints.groupBy("node").agg(F.first("fps").alias("fps"), F.min(F.coalesce("doc_id", last)).alias("first"), F.count(F.lit(1)).alias("n")))
    grouped = components(links(nodes.select("node", "fps"), budget, per_task, within))
    smallest = grouped.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    linked = grouped.join(smallest, "component")
    classes = checkpointed(nodes.join(linked, "node", "left").select("node", "n", F.coalesce("component", "node").alias("group"), F.coalesce("least", "first").alias("component_id")))
    # nodes of more copies than a partition's share are fewer than there are partitions
    share = prints.count() / shuffle_partitions(docs.sparkSession)
    hot = classes.where(F.col("n") > share).select("node", F.col("group").alias("g"), F.col("component_id").alias("c"))
    known = prints.join(F.broadcast(hot), "node", "left")
    few = known.where("g is null").drop("g", "c").join(classes.drop("n"), "node").select("doc_id", "row", "fp", "group", "component_id")
    return known.where("g is not null").select("doc_id", "row", "fp", F.col("g").alias("group"), F.col("c").alias("component_id")).union(few)
