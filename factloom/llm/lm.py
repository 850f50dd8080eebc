"""Language-model scores from a hierarchical Pitman-Yor model over all words of a corpus.

Every word of the training part has a restaurant of its own: that of the words
that follow it. All restaurants share one parent, the restaurant of words
without context, whose base is the unseen word: each word has one table there,
and what the tables leave is the probability of a word never seen. No word, pair
or context is left out, whatever their number.

The customers of a restaurant are the training tokens after its word. Its
Chinese-restaurant seating is sampled by Gibbs: in a sweep all customers of each
dish leave and sit down again, whatever their number. As only the number of a
dish's tables matters, it is drawn from its distribution given all other tables,
summed over all seatings of the dish's customers: directly for up to SMALL
customers, by a few accepted or rejected moves for more. Every table sends a
customer to the parent. Seatings stay from sweep to sweep, and rounds of sweeps
alternate with bringing the parent up to date; predictive probabilities are
averaged over the last sweeps. Discounts are estimated from the counts of counts
of the whole corpus.

How it is dealt. Texts are tokenised once into blocks, each with its own
vocabulary, kept bucketed by block. A block sends its distinct words to their
owners, partitions by the word's hash, which count them and number them; then
its distinct pairs to the owners of their contexts, which are kept bucketed too.
Owners of contexts and of words exchange tables and counts of parents. At last
the owners of contexts send each block the probabilities of its own pairs. What
travels is sorted, packed columns of distinct things, never tokens.

A context of more than LIMIT customers is dealt by residue classes of its next
words, one restaurant a class, whose shares are smoothed counts; so one word
never fills a task, and the probabilities still add up to 1. Words are known by
64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bucketed, give_back, shuffle_partitions, written

#: Strength of the context restaurants and of their parent. Sweeps of a round, rounds, and sweeps that are averaged.
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
SWEEPS, ROUNDS, SAMPLES = 2, 1, 4
#: Customers up to which tables are drawn directly, and up to which seatings are counted exactly; moves of a large dish in a sweep; turns of a restaurant's dishes.
SMALL, EXACT, STEPS, TURNS = 16, 1024, 6, 8
#: Tokens of a block, tokens of an owner, customers of a restaurant that is not split. They bound memory only.
BLOCK, OWNED, LIMIT = 2_000_000, 2_000_000, 2_000_000
#: Numbers of the end of a document and of any unseen word.
END, UNSEEN = 0, 1
PACKED = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, tokens binary, hashes binary, counts binary"
ANSWER = "block long, kind int, part int, a binary, b binary, distinct long, total long, hot_words array<long>, hot_counts array<long>"
PAIRS = "owner long, block long, u binary, w binary, n binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
MESSAGE = "owner long, kind int, part int, a binary, b binary, ones long, twos long, total long, distinct long, mass array<long>"


def is_held(doc_id: int | None, parts: int, part: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts == part


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts in a row, with A-Z in lower case and split at ASCII white space, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
    some = pc.not_equal(words, "")
    return words.filter(some), np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def press(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest needs, compressed byte by byte."""
    size = next(k for k in (1, 2, 4, 8) if not len(values) or int(values.max()) < 256**k)
    raw = values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpress(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(packed[0], -1).T).view(f"<u{packed[0]}").ravel().astype(np.int64)


def as_list(values: pa.Array) -> pa.ListArray:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def rows_of(schema: str, rows: list[dict]) -> pa.Table:
    """Rows, with zero or null for what they do not name, as a table of the schema."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    columns = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array([r.get(name, 0 if kind in ("long", "int") else None) for r in rows], types[kind]) for name, kind in columns})


def keys_of_owners(spark: SparkSession, n: int) -> list[int]:
    """A key for each of n owners, of which Spark's hash deals exactly one to each of n partitions."""
    rows = spark.range(40 * n + 1000).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at")).groupBy("at").agg(F.min("id").alias("id")).collect()
    return [r.id for r in sorted(rows, key=lambda r: r["at"])]


def pack(docs: DataFrame, parts: int, part: int) -> DataFrame:
    """Blocks of documents with token numbers of the block's vocabulary, its words' hashes, and their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, held, lengths, found, size = TaskContext.get().partitionId() << 24, [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal name, ids, held, lengths, found, size
            coded = pa.concat_arrays(found).dictionary_encode()
            flat, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            counts = np.bincount(flat[np.repeat(~np.array(held, bool), lengths)], minlength=len(words))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8")) for w in words), np.uint64, len(words))
            row = [pa.array([name]), as_list(pa.array(ids, pa.int64())), as_list(pa.array(held, pa.bool_())), as_list(pa.array(lengths, pa.int32()))]
            row += [pa.array([x], pa.binary()) for x in (press(flat), hashes.tobytes(), press(counts))]
            name += 1
            ids, held, lengths, found, size = [], [], [], [], 0
            return pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in PACKED.split(", ")])

        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            own = batch.column("doc_id").to_pylist()
            words, counts = tokens(batch.column("text"))
            found.append(words)
            ids += own
            held += [is_held(i, parts, part) for i in own]
            lengths += counts.tolist()
            size += len(words) + len(own)
            if size >= BLOCK:
                yield flush()
        if ids:
            yield flush()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def count_words(blocks: DataFrame, keys: list[int], limit: int) -> DataFrame:
    """For each block and owner of words: the number and the count of each of the block's words that it owns.

    A word's number tells its owner; words that no training document holds have the number UNSEEN. Also the owner's
    distinct and total words, and its words of more than limit, no more than total / limit.
    """
    n_owners = len(keys)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "hashes", "counts")), strict=True):
                h, n = np.frombuffer(hashes, np.uint64), unpress(counts)
                order, cuts = dealt(h, n_owners)
                for i in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[i] : cuts[i + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (keys[i], int(i), block, h[own].tobytes(), press(n[own]))], names=["owner", "part", "block", "hashes", "counts"])
        give_back()

    def tally(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        part = table.column("part")[0].as_py()
        h = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        n = np.concatenate([unpress(x) for x in table.column("counts").to_pylist()])
        words, where = np.unique(np.concatenate(h), return_inverse=True)
        counts = np.bincount(where, n).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -counts))] = np.arange(len(words))
        number = np.where(counts > 0, (rank + 2) * n_owners + part, UNSEEN)
        hot = counts > limit
        rows, at = [], 0
        for block, own in zip(table.column("block").to_pylist(), h, strict=True):
            mine = where[at : at + len(own)]
            rows.append({"block": block, "part": part, "a": press(number[mine]), "b": press(counts[mine])})
            at += len(own)
        rows[0] |= {"distinct": int((counts > 0).sum()), "total": int(counts.sum()), "hot_words": number[hot].tolist(), "hot_counts": counts[hot].tolist()}
        give_back()
        return rows_of(ANSWER, rows)

    sent = blocks.select("block", "hashes", "counts").mapInArrow(send, "owner long, part long, block long, hashes binary, counts binary")
    return sent.groupBy("owner").applyInArrow(tally, ANSWER)


def dealt(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in the order of owner and hash, and where each owner's begin."""
    owner = (hashes % np.uint64(n)).astype(np.int64)
    order = np.lexsort((hashes, owner))
    return order, np.searchsorted(owner[order], np.arange(n + 1))


class Block:
    """A block's tokens as pairs of numbered words: the distinct ones in the order in which owners of contexts get them."""

    def __init__(self, row: dict, answers: list[dict], end: int, hot: dict[int, int], limit: int, n_owners: int):
        self.lengths = np.array(row["lengths"], np.int64)
        self.held = np.array(row["held"], bool)
        self.flat = unpress(row["tokens"])
        h = np.frombuffer(row["hashes"], np.uint64)
        order, _ = dealt(h, n_owners)
        answers = sorted(answers, key=lambda r: r["part"])
        number, self.count = np.full(len(h) + 1, end, np.int64), np.zeros(len(h), np.int64)
        if len(h):
            number[order] = np.concatenate([unpress(r["a"]) for r in answers])
            self.count[order] = np.concatenate([unpress(r["b"]) for r in answers])
        seq = np.insert(self.flat, np.cumsum(self.lengths), len(h))
        starts = np.r_[0, np.cumsum(self.lengths + 1)[:-1]]
        before = np.r_[len(h), seq[:-1]]
        before[starts] = len(h)
        key, self.pair = np.unique(before * (len(h) + 1) + seq, return_inverse=True)
        del before, seq
        n = np.bincount(self.pair, np.repeat(~self.held, self.lengths + 1), len(key)).astype(np.int64)
        u, w = number[key // (len(h) + 1)], number[key % (len(h) + 1)]
        split = np.zeros(len(u), np.int64)
        for context, customers in hot.items():
            own = u == context
            split[own] = w[own] & (classes_of(customers, limit) - 1)
        mixed = (u.astype(np.uint64) + split.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        owner = ((mixed ^ (mixed >> np.uint64(33))) % np.uint64(n_owners)).astype(np.int64)
        self.order = np.lexsort((w, u, owner))
        self.cuts = np.searchsorted(owner[self.order], np.arange(n_owners + 1))
        self.u, self.w, self.n = u[self.order], w[self.order], n[self.order]


def classes_of(customers: int, limit: int) -> int:
    """Classes into which a context's next words are split: a power of two, 1 up to the limit."""
    return 1 << max(0, (max(0, customers - 1) // limit).bit_length())


class Pairs:
    """An owner's distinct pairs: context and word as places in u and w, customers c; where[i] is the pair of the i-th one sent."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("block")
        get = lambda c: [unpress(x) for x in table.column(c).to_pylist()]
        us = [np.cumsum(x) for x in get("u")]
        self.blocks, self.sizes = table.column("block").to_pylist(), [len(x) for x in us]
        u, w = np.concatenate(us), np.concatenate(get("w"))
        del us
        names, numbers = np.zeros(0, np.int64), w
        if len(u) and max(int(u.max()), int(w.max())) >= 1 << 31:  # numbers too large for one key: their places instead
            (names, u), (numbers, w) = np.unique(u, return_inverse=True), np.unique(w, return_inverse=True)
        key, self.where = np.unique(u << 32 | w, return_inverse=True)
        del u, w
        context = key >> 32
        new = np.r_[True, context[1:] != context[:-1]] if len(key) else np.zeros(0, bool)
        self.u, self.context = context[new], np.cumsum(new) - 1
        self.w, self.word = np.unique(key & 0xFFFFFFFF, return_inverse=True)
        if len(names):
            self.u, self.w = names[self.u], numbers[self.w]
        self.c = np.bincount(self.where, np.concatenate(get("n")), len(key)).astype(np.int64)

    def messages(self, t: np.ndarray, part: int, keys: list[int]) -> list[dict]:
        """To each owner of words: the numbers of the words here, and the tables at which they are eaten."""
        tables = np.bincount(self.word, t, len(self.w)).astype(np.int64)
        rows = []
        for q in range(len(keys)):
            own = self.owned(q, len(keys))
            if len(own):
                rows.append({"owner": keys[q], "part": part, "a": press(np.diff(self.w[own], prepend=0)), "b": press(tables[own])})
        return rows

    def owned(self, q: int, n: int) -> np.ndarray:
        return np.flatnonzero((self.w % n == q) & (self.w != UNSEEN))


class Root:
    """The parent restaurant: each word's customers are the tables of all contexts at which it is eaten; it has one table."""

    def __init__(self, tables: int, words: int, ones: int, twos: int, mass: dict[int, tuple[int, int]] | None = None):
        self.tables, self.words, self.mass = tables, words, mass or {}
        self.d, self.theta = discount(ones, twos), PARENT_STRENGTH

    def unseen(self) -> float:
        return (self.theta + self.d * self.words) / (self.theta + self.tables)

    def of(self, customers: np.ndarray) -> np.ndarray:
        return (customers - self.d) / (self.theta + self.tables)

    def share(self, residue: int, classes: int) -> float:
        """Probability of all words of a residue class."""
        found = [(m, n) for r, (m, n) in self.mass.items() if r % classes == residue]
        return sum((m - self.d * n) / (self.theta + self.tables) for m, n in found) + (self.unseen() if residue == UNSEEN % classes else 0.0)


def discount(ones: int, twos: int) -> float:
    """The usual estimate from the numbers of things seen once and twice."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function from 0 on, by Stirling's series eight steps further on."""
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(np.prod([x + i for i in range(8)], 0))


class Seatings:
    """Logarithms of how many seatings of c customers at t tables a discount allows, weighted as the process weights them, by c! / (t! d^t).

    That is the probability that t draws of the law with generating function 1 - (1 - z)^d add up to c. Exact up to
    EXACT customers; beyond, such sums scale as t^(1/d), which leads back to EXACT customers.
    """

    def __init__(self, d: float):
        self.d = d
        self.table = np.full((EXACT + 1, EXACT + 2), -np.inf)
        row = np.full(EXACT + 2, -np.inf)
        row[1] = 0.0
        t = np.arange(EXACT + 2)
        scale = log_gamma(t + 1.0) + t * np.log(d)
        self.table[1] = row + scale
        for c in range(1, EXACT):
            with np.errstate(divide="ignore"):
                row = np.logaddexp(np.r_[-np.inf, row[:-1]], np.log(np.maximum(c - d * t, 0)) + row)
            self.table[c + 1] = row + scale - log_gamma(np.array([c + 2.0]))

    def log(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        few = c <= EXACT
        x = np.where(few, t, t * (EXACT / c) ** self.d)
        low = np.clip(x.astype(np.int64), 1, EXACT - 1)
        row = np.minimum(c, EXACT)
        a, b = self.table[row, low], self.table[row, np.minimum(low + 1, row)]
        between = np.where(x < 1, self.table[row, 1] + np.log(np.maximum(x, 1e-300)), a + (x - low) * (b - a))
        return np.where(few, self.table[row, np.minimum(t, EXACT).astype(np.int64)], between)


class Seating:
    """Restaurants side by side: room, customers n and probability above of each dish; t counts its tables.

    Given all other tables, and summed over all seatings of a dish's customers, t has the weight
    seatings(n, t) * gamma(theta / d + other tables + t) / t! * above^t, from which it is drawn.
    """

    def __init__(self, room: np.ndarray, n: np.ndarray, above: np.ndarray, seatings: Seatings, theta: float, rng: np.random.Generator, t: np.ndarray | None = None):
        self.seatings, self.theta, self.rng = seatings, theta, rng
        self.n, self.room, self.above = n, room, above
        self.rooms = int(room.max(initial=-1)) + 1
        self.t = (n > 0).astype(np.int64) if t is None else t
        many = np.flatnonzero(n > 1)
        many = many[np.argsort(room[many], kind="stable")]
        first = np.flatnonzero(np.r_[True, room[many][1:] != room[many][:-1]]) if len(many) else many
        turn = (np.arange(len(many)) - np.repeat(first, np.diff(np.r_[first, len(many)]))) % TURNS
        self.turns = [many[turn == i] for i in range(TURNS)]

    def sweep(self) -> None:
        """Draws the tables of every dish of two or more customers anew; dishes of a restaurant take turns."""
        for who in self.turns:
            others = np.bincount(self.room, self.t, self.rooms)[self.room[who]] - self.t[who]
            others, above, n = self.theta / self.seatings.d + others, self.above[who], self.n[who]
            for c in range(2, SMALL + 1):
                own = np.flatnonzero(n == c)
                if len(own):
                    t = np.arange(1, c + 1)
                    steps = np.log(others[own][:, None] + t[:-1]) + np.log(above[own])[:, None]
                    weight = np.c_[np.zeros(len(own)), np.cumsum(steps, 1)] + (self.seatings.table[c, 1 : c + 1] - log_gamma(t + 1.0))
                    weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
                    self.t[who[own]] = 1 + (weight < (self.rng.random(len(own)) * weight[:, -1])[:, None]).sum(1)
            own = np.flatnonzero(n > SMALL)
            if len(own):
                self.t[who[own]] = self.walk(self.t[who[own]], n[own], others[own], np.log(above[own]))

    def walk(self, t: np.ndarray, n: np.ndarray, others: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Tables of large dishes, by STEPS accepted or rejected moves to the same weights."""
        weigh = lambda t: self.seatings.log(n, t) + log_gamma(others + t) - log_gamma(t + 1.0) + t * above
        odds = np.exp(np.minimum(above, -1e-3))
        mean = 1 + (others + 1) * odds / (1 - odds)  # where customers are many
        start = np.clip(np.minimum(mean, n / 2), 1, n).astype(np.int64)
        here, there = weigh(t), weigh(start)
        t, here = np.where(there > here, start, t) if (t == 1).all() else t, np.where(there > here, there, here) if (t == 1).all() else here
        for step in range(STEPS):
            width = np.maximum(1.0, np.sqrt(np.minimum(mean, n / 2)) * (2.0, 0.5)[step % 2])
            move = np.rint(self.rng.normal(0, width)).astype(np.int64)
            new = t + np.where(move == 0, self.rng.choice([-1, 1], len(t)), move)
            inside = (new >= 1) & (new <= n)
            there = np.where(inside, weigh(np.clip(new, 1, n)), -np.inf)
            go = np.log(self.rng.random(len(t))) < there - here
            t, here = np.where(go, new, t), np.where(go, there, here)
        return t


class Contexts:
    """The restaurants of an owner's contexts, with the parent as it is in this round."""

    def __init__(self, pairs: Pairs, root: Root, seatings: Seatings, replies: list[dict], hot: dict[int, int], limit: int, n_owners: int):
        self.pairs, self.d, self.seatings = pairs, seatings.d, seatings
        above = np.full(len(pairs.w), root.unseen())
        for r in replies:
            above[pairs.owned(r["part"], n_owners)] = root.of(unpress(r["a"]))
        room, share, customers = pairs.context.copy(), np.ones(len(pairs.c)), None
        shares = {}
        for place in np.flatnonzero(np.isin(pairs.u, list(hot))):
            classes = classes_of(hot[int(pairs.u[place])], limit)
            if classes > 1:
                own = np.flatnonzero(pairs.context == place)
                residue = pairs.w[pairs.word[own]] & (classes - 1)
                for r in np.unique(residue).tolist():
                    shares[r, classes] = shares.get((r, classes)) or root.share(r, classes)
                    share[own[residue == r]] = shares[r, classes]
                room[own] = len(pairs.u) * (1 + residue) + place
        _, self.room = np.unique(room, return_inverse=True)
        customers = np.bincount(self.room, pairs.c)[self.room] if len(room) else np.zeros(0)
        whole = np.bincount(pairs.context, pairs.c)[pairs.context] if len(room) else np.zeros(0)
        for place in np.flatnonzero(np.isin(pairs.u, list(hot))):
            whole[pairs.context == place] = hot[int(pairs.u[place])]
        self.above, self.customers = above[pairs.word] / share, customers
        self.weight = np.where(share < 1, (customers + STRENGTH * share) / (whole + STRENGTH), 1.0)

    def seating(self, rng: np.random.Generator, tables: dict | None) -> Seating:
        return Seating(self.room, self.pairs.c, self.above, self.seatings, STRENGTH, rng, unpress(tables["a"]) if tables else None)

    def probability(self, t: np.ndarray) -> np.ndarray:
        """Of each pair's word after its context, by the tables of each pair (or their mean, as it is linear in them)."""
        full = np.bincount(self.room, t)[self.room] if len(t) else t
        own = np.maximum(self.pairs.c - self.d * t, 0) + (STRENGTH + self.d * full) * self.above
        return self.weight * own / (STRENGTH + self.customers)


def score(docs: DataFrame, parts: int = 7, part: int = 2, limit: int = LIMIT, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens long, base_score, score and perplexity double for each row of docs.

    Training documents are those whose crc32(doc_id as text) mod parts is not part (a null doc_id: of the empty
    text). A null or empty text is one end token; texts are taken whole. n_known counts tokens seen in training;
    base_score is the sum of log10((c + 1) / (N + V + 1)). Rows with equal doc_id are separate documents, equal rows
    count each. Without training documents every token is unseen and both scores are 0. An empty table gives an
    empty table; other columns are not read.
    """
    spark = docs.sparkSession
    spread = shuffle_partitions(spark)
    blocks = bucketed(pack(docs, parts, part), "blocks", spread, "block")
    sizes = blocks.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"), F.size(F.filter("held", lambda x: ~x)).alias("train"), F.size("held").alias("docs"))
    held = sizes.agg(F.sum("n"), F.sum("docs"), F.sum("train")).first()
    ends = int(held[2] or 0)
    keys = keys_of_owners(spark, max(spread, -(-int((held[0] or 0) + (held[1] or 0)) // OWNED)))
    n_owners = len(keys)
    words = bucketed(count_words(blocks, keys, limit), "words", spread, "block", spread)
    sums = words.agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = int(sums[0] or 0) + ends, int(sums[1] or 0) + (ends > 0)
    large = words.where(F.size("hot_words") > 0).select("hot_words", "hot_counts").collect()  # total / limit at most
    hot = {w: c for r in large for w, c in zip(r.hot_words, r.hot_counts, strict=True)} | ({END: ends} if ends > limit else {})
    most = max((classes_of(c, limit) for c in hot.values()), default=1)
    end = END if ends else UNSEEN
    asked = words.select("block", "kind", "part", "a", "b")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            b = Block(row, right.to_pylist(), end, hot, limit, n_owners)
            for i in np.flatnonzero(np.diff(b.cuts)):
                own = slice(b.cuts[i], b.cuts[i + 1])
                rows.append({"owner": keys[i], "block": row["block"], "u": press(np.diff(b.u[own], prepend=0)), "w": press(b.w[own]), "n": press(b.n[own])})
        give_back()
        return rows_of(PAIRS, rows)

    pairs = bucketed(blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(send, PAIRS), "pairs", n_owners, "owner", n_owners)
    number = {k: i for i, k in enumerate(keys)}

    def open_(key: tuple, table: pa.Table) -> pa.Table:
        p = Pairs(table)
        rows = p.messages((p.c > 0).astype(np.int64), number[key[0].as_py()], keys)
        if rows:
            rows[0] |= {"ones": int((p.c == 1).sum()), "twos": int((p.c == 2).sum())}
        give_back()
        return rows_of(MESSAGE, rows)

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        """An owner of words adds up their tables and answers every owner of contexts."""
        table = table.sort_by("part")
        ids = [np.cumsum(unpress(x)) for x in table.column("a").to_pylist()]
        all_, where = np.unique(np.concatenate(ids), return_inverse=True)
        m = np.bincount(where, np.concatenate([unpress(x) for x in table.column("b").to_pylist()])).astype(np.int64)
        rows, at = [], 0
        for to, own in zip(table.column("part").to_pylist(), ids, strict=True):
            rows.append({"owner": keys[to], "part": number[key[0].as_py()], "a": press(m[where[at : at + len(own)]])})
            at += len(own)
        rows[0] |= {"total": int(m.sum()), "distinct": int((m > 0).sum()), "ones": int((m == 1).sum()), "twos": int((m == 2).sum())}
        if most > 1:
            residue = all_ & (most - 1)
            rows[0]["mass"] = np.r_[np.bincount(residue, m, most), np.bincount(residue[m > 0], minlength=most)].astype(np.int64).tolist()
        give_back()
        return rows_of(MESSAGE, rows)

    def parent(messages: DataFrame) -> tuple[DataFrame, Root]:
        replies = written(messages.where("kind = 0").groupBy("owner").applyInArrow(gather, MESSAGE), "parents")
        s = replies.agg(*[F.sum(c) for c in ("total", "distinct", "ones", "twos")]).first()
        mass = None
        if most > 1:  # no more rows than the classes of the largest context
            found = {r.pos: r.s for r in replies.select(F.posexplode("mass")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}
            mass = {r: (found.get(r, 0), found.get(r + most, 0)) for r in range(most)}
        return replies, Root(*(int(x or 0) for x in s), mass)

    opened = written(pairs.groupBy("owner").applyInArrow(open_, MESSAGE), "messages")
    seen = opened.agg(F.sum("ones"), F.sum("twos")).first()
    d = discount(int(seen[0] or 0), int(seen[1] or 0))
    replies, root = parent(opened)
    seats = None

    def sit(root: Root, turn: int):
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return rows_of(MESSAGE, [])
            p, given = Pairs(left), right.to_pylist()
            here = Contexts(p, root, Seatings(d), [r for r in given if r["kind"] == 0], hot, limit, n_owners)
            s = here.seating(np.random.default_rng([seed, turn, number[key[0].as_py()]]), next((r for r in given if r["kind"] == 1), None))
            for _ in range(SWEEPS):
                s.sweep()
            rows = p.messages(s.t, number[key[0].as_py()], keys)
            rows.append({"owner": key[0].as_py(), "kind": 1, "a": press(s.t)})
            del p, here, s
            give_back()
            return rows_of(MESSAGE, rows)

        return run

    def told() -> DataFrame:
        columns = ("owner", "kind", "part", "a", "b")
        return replies.select(*columns) if seats is None else replies.select(*columns).union(seats.select(*columns))

    for turn in range(ROUNDS):
        made = written(pairs.groupBy("owner").cogroup(told().groupBy("owner")).applyInArrow(sit(root, turn), MESSAGE), "messages")
        seats = made.where("kind = 1")
        replies, root = parent(made)

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return rows_of(ANSWER, [])
        p, given, own = Pairs(left), right.to_pylist(), number[key[0].as_py()]
        here = Contexts(p, root, Seatings(d), [r for r in given if r["kind"] == 0], hot, limit, n_owners)
        s = here.seating(np.random.default_rng([seed, ROUNDS, own]), next((r for r in given if r["kind"] == 1), None))
        mean = np.zeros(len(p.c))
        for turn in range(SWEEPS + SAMPLES):
            s.sweep()
            if turn >= SWEEPS:
                mean += s.t / SAMPLES
        found = np.log10(np.maximum(here.probability(mean), 1e-300)).astype(np.float32).view(np.uint32)
        rows, at = [], 0
        for block, size in zip(p.blocks, p.sizes, strict=True):
            rows.append({"block": block, "kind": 1, "part": own, "a": press(found[p.where[at : at + size]])})
            at += size
        del p, here, s
        give_back()
        return rows_of(ANSWER, rows)

    answers = pairs.groupBy("owner").cogroup(told().groupBy("owner")).applyInArrow(answer, ANSWER).select("block", "kind", "part", "a", "b")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        given, out = right.to_pylist(), []
        for row in left.to_pylist():
            b = Block(row, [r for r in given if r["kind"] == 0], end, hot, limit, n_owners)
            p = np.empty(len(b.order), np.float32)
            p[b.order] = np.concatenate([unpress(r["a"]).astype(np.uint32).view(np.float32) for r in sorted((r for r in given if r["kind"] == 1), key=lambda r: r["part"])])
            cuts = np.r_[0, np.cumsum(b.lengths + 1)[:-1]]
            summed = lambda x, e: np.add.reduceat(np.insert(x[b.flat], np.cumsum(b.lengths), e), cuts)  # noqa: B023, E731
            base = summed(np.log10(b.count + 1.0), np.log10(ends + 1.0)) - (b.lengths + 1) * np.log10(total + distinct + 1.0)
            known, scores = summed((b.count > 0).astype(np.int64), int(ends > 0)), np.add.reduceat(p[b.pair].astype(np.float64), cuts)
            size = b.lengths + 1
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(b.held), pa.array(size), pa.array(known), pa.array(np.full(len(size), total)), pa.array(base), pa.array(scores), pa.array(10 ** np.minimum(-scores / size, 300))]
            out.append(pa.table(columns, names=[c.split()[0] for c in SCORES.split(", ")]))
            del b, p
        give_back()
        return pa.concat_tables(out) if out else pa.schema([]).empty_table()

    return blocks.groupBy("block").cogroup(asked.union(answers).groupBy("block")).applyInArrow(add_up, SCORES)
