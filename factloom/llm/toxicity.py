"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of those of its hash and of the hashes of its
beginnings of a few lengths; hashes that fewer than `min_docs` training documents
hold have none. Filters slide over the words of the whole text; each keeps its
maximum, and a logistic layer joins them. For scoring, the filters are applied to
the embeddings once, so a text costs look-ups, sums and maxima only.

All labelled texts are learned from. They are dealt by doc_id into parts of about
SHARE bytes, whose number grows with the texts, and stored as word numbers and
hashes. Documents by hash are counted by Spark. In each of EPOCHS rounds every
part trains a copy of the network on its texts in small batches (numpy), and Spark
averages what the copies changed: an embedding over the parts that changed it.

A threshold for each language is chosen on a fifth of the labelled texts that the
network did not see, and moved to 0.5 on the logit scale. The language is told
from the text by function words, as the lang column is no input of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import give_back, received, send, written

WIDTHS, FILTERS, DIM = (1, 2, 3), 6, 8
PREFIXES = (5, 7)
MIN_DOCS, EPOCHS, BATCH = 3, 6, 32
#: Bytes of text in a training part, hashes counted at once, and what changes are multiplied by for exact sums.
SHARE, COUNTED, FINE = 12 << 20, 1_000_000, 1 << 40
#: Texts stored together, bits of a bitmap's piece, most pieces (32 MB).
TOGETHER, PIECE, PIECES = 256, 32_768, 8_192
#: Words scored at once and words remembered in a task. Both bound memory only.
SLICE, MEMO = 100_000, 150_000
LETTERS = re.compile(r"[^\W\d_]+")
#: Function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with be this by from",
    "de": "der die das und ist von zu den mit sich auf nicht dem des ein",
    "fr": "le la les des et du que qui dans est une par pour sur au",
    "es": "el los las y en por para con del una que se lo como",
}
LANGUAGES = ("", *FUNCTION_WORDS)
VOTES = {w: i for i, g in enumerate(LANGUAGES) for w in FUNCTION_WORDS.get(g, "").split()}
CUTS = np.linspace(-2, 2, 81)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def hashes(word: str) -> list[int]:
    """Hashes of the word and of its beginnings (32 bits; beginnings are marked, so that they are no words)."""
    return [zlib.crc32(word.encode())] + [zlib.crc32(b"^" + word[:n].encode()) for n in PREFIXES if len(word) > n]


def hash_lines(some: Iterable[str]) -> np.ndarray:
    """One line of hashes for each word; in place of the beginnings that a word lacks stands its own hash."""
    return np.array([h + h[:1] * (1 + len(PREFIXES) - len(h)) for h in map(hashes, some)], np.uint32).reshape(-1, 1 + len(PREFIXES))


class Network:
    """known: ascending hashes, of which the i-th has row i + 1 of the embeddings E (row 0: none). W[k]: filters of width k, b[k], v, c."""

    def __init__(self, known: Iterable[int], odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.known = np.fromiter(known, np.uint32)
        self.E = rng.normal(0, 0.02, (len(odds), DIM))
        self.E[:, 0] += odds
        self.E[0] = 0
        self.W = {k: rng.normal(0, 0.15, (k, DIM, FILTERS)) for k in WIDTHS}
        for k in WIDTHS:
            self.W[k][:, 0, : FILTERS // 2] += 1 / k
        self.b = {k: np.full(FILTERS, -0.1) for k in WIDTHS}
        self.v, self.c = np.full(len(WIDTHS) * FILTERS, 0.2), np.array([-2.0])
        self.shift = dict.fromkeys(LANGUAGES, 0.0)

    @property
    def rows(self) -> dict[int, int]:
        return {h: i + 1 for i, h in enumerate(self.known.tolist())}

    def find(self, lines: np.ndarray) -> np.ndarray:
        """The rows of lines of hashes, each row once in a line, 0 for none."""
        if not len(self.known):
            return np.zeros(lines.shape, np.int64)
        at = np.minimum(np.searchsorted(self.known, lines), len(self.known) - 1)
        found = np.where(self.known[at] == lines, at + 1, 0)
        for j in range(1, found.shape[1]):
            found[(found[:, :j] == found[:, j : j + 1]).any(1), j] = 0
        return found

    def bank(self) -> np.ndarray:
        return np.concatenate([self.W[k][o].T for k in WIDTHS for o in range(k)])

    def small(self) -> list[np.ndarray]:
        """Every parameter but the embeddings."""
        return [*(self.W[k] for k in WIDTHS), *(self.b[k] for k in WIDTHS), self.v, self.c]

    def slid(self, table: np.ndarray, words_at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each filter (rows) gives at each place (columns) of texts that end at `ends`; table: the bank times the embeddings of each line."""
        held = np.take(table, words_at, axis=1)
        parts, row = [], 0
        for k in WIDTHS:
            pre = held[row : row + FILTERS]
            for o in range(1, k):
                row += FILTERS
                pre[:, :-o] += held[row : row + FILTERS, o:]
                pre[:, ends - o] = -np.inf  # windows that would reach into the next text
            row += FILTERS
            parts.append(pre)
        return np.concatenate(parts)

    def joined(self, highest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled values (texts by filters) and logits, from each filter's highest value in each text."""
        z = np.maximum(highest.T + np.concatenate([self.b[k] for k in WIDTHS]), 0)
        return z, z @ self.v + self.c[0]

    def logits(self, lines: np.ndarray, words_at: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Logits of texts given by lines of rows and the line of each place."""
        ends = np.cumsum(lens)
        table = (self.bank() @ self.E[lines].sum(1).T).astype(np.float32)
        return self.joined(np.maximum.reduceat(self.slid(table, words_at, ends), np.r_[0, ends[:-1]], axis=1))[1]

    def slopes(self, lines: np.ndarray, words_at: np.ndarray, lens: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Sums over the texts of the loss's slopes: touched rows of E and their slopes, and those of the small parameters."""
        ends = np.cumsum(lens)
        cuts = np.r_[0, ends[:-1]]
        H, bank = self.E[lines].sum(1), self.bank()
        pre = self.slid((bank @ H.T).astype(np.float32), words_at, ends)
        where = np.stack([pre[:, at:end].argmax(1) + at for at, end in zip(cuts.tolist(), ends.tolist(), strict=True)])
        z, logit = self.joined(pre[np.arange(len(pre)), where].T)
        g = 1 / (1 + np.exp(-logit)) - y
        dz = g[:, None] * self.v * (z > 0)
        of_w = {k: np.zeros_like(self.W[k]) for k in WIDTHS}
        touched, slopes = [], []
        for j, k in enumerate(WIDTHS):
            d = dz[:, j * FILTERS : (j + 1) * FILTERS]
            text, f = np.nonzero(d)
            d = d[text, f][:, None]
            for o in range(k):
                line = words_at[where[text, j * FILTERS + f] + o]
                np.add.at(of_w[k][o].T, f, d * H[line])
                touched.append(lines[line])
                slopes.append(d * self.W[k][o].T[f])
        rows = np.concatenate(touched)
        some, back = np.unique(rows, return_inverse=True)
        of_e, back, whole = np.zeros((len(some), DIM)), back.reshape(rows.shape), np.concatenate(slopes)
        for j in range(rows.shape[1]):
            np.add.at(of_e, back[:, j], whole)
        own = some > 0
        return some[own], of_e[own], [*(of_w[k] for k in WIDTHS), *np.split(dz.sum(0), len(WIDTHS)), g @ z, np.array([g.sum()])]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Learner:
    """A copy of the network that one part trains for one round by Adam; `changes` tells what became of it."""

    def __init__(self, net: Network):
        self.net = net
        self.E, self.small = net.E.copy(), [p.copy() for p in net.small()]
        self.m1, self.m2 = [np.zeros_like(p) for p in net.small()], [np.zeros_like(p) for p in net.small()]
        self.e1, self.e2 = np.zeros_like(net.E), np.zeros_like(net.E)
        self.touched, self.t = np.zeros(len(net.E), bool), 0

    def step(self, lines: np.ndarray, words_at: np.ndarray, lens: np.ndarray, y: np.ndarray) -> None:
        some, of_e, grads = self.net.slopes(lines, words_at, lens, y)
        self.t += 1
        rate = 0.01 * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        of_e /= len(y)
        self.touched[some] = True
        self.e1[some] = 0.9 * self.e1[some] + 0.1 * of_e
        self.e2[some] = 0.999 * self.e2[some] + 0.001 * of_e * of_e
        self.net.E[some] -= rate * self.e1[some] / (np.sqrt(self.e2[some]) + 1e-8)
        for p, g, m1, m2 in zip(self.net.small(), grads, self.m1, self.m2, strict=True):
            g = g / len(y) + (1e-4 * p if p is not self.net.c else 0)
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.999
            m2 += 0.001 * g * g
            p -= rate * m1 / (np.sqrt(m2) + 1e-8)

    def changes(self) -> pa.RecordBatch:
        """Number of each changed line of eight, small parameters after the embeddings, with the changes as whole numbers, which sum alike in any order."""
        some = np.flatnonzero(self.touched)
        flat = np.concatenate([(p - q).ravel() for p, q in zip(self.net.small(), self.small, strict=True)])
        rest = np.r_[flat, np.zeros(-len(flat) % DIM)].reshape(-1, DIM)
        d = np.rint(np.concatenate([self.net.E[some] - self.E[some], rest]) * FINE).astype(np.int64)
        at = np.r_[some, len(self.E) + np.arange(len(rest))]
        return pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, np.ascontiguousarray(d.T))], names=["i", *(f"d{j}" for j in range(DIM))])


class Scorer:
    """Scores texts; one in each task. Remembers each word's line in a growing table of filtered embeddings."""

    def __init__(self, net: Network):
        self.net, self.bank = net, net.bank()
        self.clear()

    def clear(self) -> None:
        self.line: dict[str, int] = {}
        self.n = 1  # line 0: words without a row or a vote
        self.table, self.vote = np.zeros((len(self.bank), 1024), np.float32), np.zeros(1024, np.int64)

    def learn(self, new: set[str]) -> None:
        some = list(new)
        rows, vote = self.net.find(hash_lines(some)), np.array([VOTES.get(w, 0) for w in some], np.int64)
        own = np.flatnonzero(rows.any(1) | (vote > 0))
        number = np.zeros(len(some), np.int64)
        number[own] = self.n + np.arange(len(own))
        self.line.update(zip(some, number.tolist(), strict=True))
        end = self.n + len(own)
        if end > len(self.vote):
            more = max(end, 2 * len(self.vote)) - len(self.vote)
            self.table, self.vote = np.pad(self.table, ((0, 0), (0, more))), np.pad(self.vote, (0, more))
        self.table[:, self.n : end] = self.bank @ self.net.E[rows[own]].sum(1).T
        self.vote[self.n : end] = vote[own]
        self.n = end

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Raw logit and language number of each whole text."""
        docs = [words(x) for x in texts]
        new = set().union(*docs) - self.line.keys() if docs else set()
        if len(self.line) + len(new) > MEMO:
            self.clear()
            new = set().union(*docs)
        self.learn(new)
        least = max(WIDTHS)
        where = [np.array([*map(self.line.__getitem__, d), *[0] * (least - len(d))], np.int64) for d in docs]
        out, lang = np.zeros(len(docs)), np.zeros(len(docs), np.int64)
        at = 0
        while at < len(docs):
            end, n = at, 0
            while end < len(docs) and (end == at or n + len(where[end]) <= SLICE):
                n += len(where[end])
                end += 1
            idx = np.concatenate(where[at:end])
            ends = np.cumsum([len(x) for x in where[at:end]])
            cuts = np.r_[0, ends[:-1]]
            here = np.zeros(self.n, bool)
            here[idx] = True
            highest = np.maximum.reduceat(self.net.slid(self.table[:, : self.n][:, here], (np.cumsum(here) - 1)[idx], ends), cuts, axis=1)
            out[at:end] = self.net.joined(highest)[1]
            lang[at:end] = told(self.vote[idx], cuts)
            at = end
        return out, lang

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        logit, lang = self.logits(texts)
        return 1 / (1 + np.exp(-(logit - np.array([self.net.shift[g] for g in LANGUAGES])[lang]))), lang


def told(vote: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The language with most votes in each text that begins at one of `cuts`, 0 without a vote."""
    votes = np.stack([np.add.reduceat(vote == g, cuts, dtype=np.int64) for g in range(1, len(LANGUAGES))], 1)
    return np.where(votes.max(1) > 0, votes.argmax(1) + 1, 0)


CODED = "part int, unseen boolean, n long, n1 long, y binary, lang binary, lens binary, words_at binary, hashes binary"


def coded(docs: list[str | None], y: list[int], unseen: bool, part: int, memo: dict[str, bytes]) -> dict:
    """Texts as the line of each place and lines of hashes, of which the first is none; texts of few words get empty places. memo: lines of words met before."""
    split = [words(x) for x in docs]
    some = sorted(set().union(*split))
    line = {w: i + 1 for i, w in enumerate(some)}
    where = [[*map(line.__getitem__, d), *[0] * (max(WIDTHS) - len(d))] for d in split]
    lens = np.array([len(x) for x in where], np.int32)
    at = np.array([i for x in where for i in x], np.int32)
    vote = np.array([0, *(VOTES.get(w, 0) for w in some)], np.int64)
    lang = told(vote[at], np.r_[0, np.cumsum(lens)[:-1]]).astype(np.int8)
    if len(memo) > MEMO:
        memo.clear()
    new = [w for w in some if w not in memo]
    lines, size = hash_lines(new).tobytes(), 4 * (1 + len(PREFIXES))
    memo.update((w, lines[i * size : (i + 1) * size]) for i, w in enumerate(new))
    toxic = np.array([v > 0 for v in y], np.int8)
    return {"part": part, "unseen": unseen, "n": len(y), "n1": int(toxic.sum()), "y": toxic.tobytes(), "lang": lang.tobytes(), "lens": lens.tobytes(), "words_at": at.tobytes(), "hashes": b"".join([bytes(size), *map(memo.__getitem__, some)])}


def opened(record: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes by line, the line of each place, the texts' lengths and labels."""
    return np.frombuffer(record["hashes"], np.uint32).reshape(-1, 1 + len(PREFIXES)), np.frombuffer(record["words_at"], np.int32), np.frombuffer(record["lens"], np.int32), np.frombuffer(record["y"], np.int8)


def records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def batches_of(rows: np.ndarray, at: np.ndarray, lens: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A record's texts by BATCH, each with the lines of rows that it needs; lines without a row become the first."""
    at = np.where(rows.any(1)[at], at, 0)
    ends = np.r_[0, np.cumsum(lens)]
    for lo in range(0, len(lens), BATCH):
        hi = min(lo + BATCH, len(lens))
        here, back = np.unique(at[ends[lo] : ends[hi]], return_inverse=True)
        yield rows[here].astype(np.int32), back.astype(np.int32), lens[lo:hi].copy(), y[lo:hi].copy()


def code(texts: DataFrame) -> DataFrame:
    """Rows of text, _y, unseen and part, ordered within parts, as records of at most TOGETHER texts and about SLICE words, stored."""
    arrow = pa.schema([("part", pa.int32()), ("unseen", pa.bool_()), ("n", pa.int64()), ("n1", pa.int64()), *((c, pa.binary()) for c in ("y", "lang", "lens", "words_at", "hashes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: dict[tuple[int, bool], tuple[list, list, list]] = {}
        done: list[dict] = []
        memo: dict[str, bytes] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for row in whole.slice(at, 256).to_pylist():
                    key = (row["part"], row["unseen"])
                    docs, y, size = begun.setdefault(key, ([], [], []))
                    docs.append(row["text"])
                    y.append(row["_y"])
                    size.append(len(row["text"] or ""))
                    if len(docs) == TOGETHER or sum(size) > 8 * SLICE:
                        done.append(coded(docs, y, key[1], key[0], memo))
                        del begun[key]
                if done:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
                    done = []
        for (part, unseen), (docs, y, _) in begun.items():
            yield pa.RecordBatch.from_pylist([coded(docs, y, unseen, part, memo)], schema=arrow)
        begun.clear()
        memo.clear()
        give_back()

    return written(texts.mapInArrow(run, CODED), "toxicity-coded")


def counted(stored: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending hashes that at least MIN_DOCS training texts hold, how many do, and how many toxic ones."""

    def summed(found: list[np.ndarray], toxic: list[np.ndarray]) -> pa.RecordBatch:
        h, back, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.bincount(back, np.concatenate(toxic), len(h)).astype(np.int64))], names=["h", "n", "n1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, toxic = [], []
        for record in records(batches):
            hashed, at, lens, y = opened(record)
            pairs = np.unique(np.repeat(np.arange(len(lens)), lens) * len(hashed) + at)
            doc, line = np.divmod(pairs, len(hashed))
            doc, line = doc[line > 0], line[line > 0]
            keys = np.unique((doc[:, None] << 32 | hashed[line].astype(np.int64)).ravel())
            found.append((keys & 0xFFFFFFFF).astype(np.uint32))
            toxic.append(y[keys >> 32])
            if sum(map(len, found)) > COUNTED:
                yield summed(found, toxic)
                found, toxic = [], []
        if found:
            yield summed(found, toxic)
        give_back()

    each = stored.where("not unseen").select("y", "lens", "words_at", "hashes").mapInArrow(run, "h long, n long, n1 long")
    enough = each.groupBy("h").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= MIN_DOCS).toArrow()  # the model's vocabulary
    h, n, n1 = (enough.column(c).to_numpy() for c in ("h", "n", "n1"))
    order = np.argsort(h)
    return h[order], n[order], n1[order]


def train_round(stored: DataFrame, net: Network, seed: int) -> None:
    """Every part trains a copy of the network on its batches; the network takes the average of the changes, of an embedding over the parts that changed it."""
    sent = send(stored.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mine = None, []

        def learned() -> pa.RecordBatch:
            learner = Learner(received(sent))
            for i in np.random.default_rng([seed, part]).permutation(len(mine)).tolist():
                learner.step(*mine[i])
            return learner.changes()

        known = Network(received(sent).known, np.zeros(1))  # its hashes only
        for record in records(batches):
            if record["part"] != part and mine:
                yield learned()
                mine = []
            part = record["part"]
            hashed, at, lens, y = opened(record)
            rows = known.find(hashed)
            rows[0] = 0
            mine.extend(batches_of(rows, at, lens, y))
        if mine:
            yield learned()
        del known, mine
        give_back()

    names = [f"d{j}" for j in range(DIM)]
    each = stored.where("not unseen").select("part", "y", "lens", "words_at", "hashes").mapInArrow(run, "i long, " + ", ".join(f"{c} long" for c in names))
    got = each.groupBy("i").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()  # changed parameters of one network
    sent.destroy()
    i, n = got.column("i").to_numpy(), got.column("n").to_numpy()
    change = np.stack([got.column(c).to_numpy() for c in names], 1) / n[:, None] / FINE
    of_e = i < len(net.E)
    net.E[i[of_e]] += change[of_e]
    flat, at = change[~of_e][np.argsort(i[~of_e])].ravel(), 0
    for p in net.small():
        p += flat[at : at + p.size].reshape(p.shape)
        at += p.size


def set_thresholds(stored: DataFrame, net: Network) -> None:
    """The threshold of each language from all unseen texts: they are counted by language, label and the cuts that they reach."""
    sent = send(stored.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tally = received(sent), np.zeros((len(LANGUAGES), 2, len(CUTS) + 1), np.int64)
        for record in records(batches):
            hashed, at, lens, y = opened(record)
            rows = net.find(hashed)
            rows[0] = 0
            reached = np.searchsorted(CUTS, net.logits(rows, at, lens), "right")
            np.add.at(tally, (np.frombuffer(record["lang"], np.int8), y, reached), 1)
        at = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(tally.ravel()[at])], names=["i", "n"])
        del net
        give_back()

    got = stored.where("unseen").select("y", "lang", "lens", "words_at", "hashes").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    tally = np.zeros(len(LANGUAGES) * 2 * (len(CUTS) + 1), np.int64)
    tally[got.column("i").to_numpy()] = got.column("n").to_numpy()
    for name, of in zip(LANGUAGES, tally.reshape(len(LANGUAGES), 2, -1), strict=True):
        net.shift[name] = best_cut(of)


def maybe_among(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key is not in known, by a bitmap of the keys' hashes; none whose key is there is lost.

    It only spares a shuffle of texts. Keys of different types, or of others than integers and strings, are not looked up.
    """
    of = rows.schema[key].dataType
    if of != known.schema[key].dataType or not isinstance(of, (T.LongType, T.IntegerType, T.StringType)):
        return rows
    pieces = min(PIECES, math.ceil(max(known.count(), 1) * 16 / PIECE))
    bit = F.pmod(F.xxhash64(key), F.lit(pieces * PIECE))
    maps = known.select(bit.alias("_bit")).groupBy(F.floor(F.col("_bit") / PIECE).alias("_piece")).agg(F.bitmap_construct_agg(F.col("_bit") % PIECE).alias("_map"))
    looked = rows.withColumn("_bit", bit).withColumn("_piece", F.floor(F.col("_bit") / PIECE)).withColumn("_bit", F.col("_bit") % PIECE)
    is_set = F.expr("getbit(cast(conv(hex(substring(_map, cast(_bit div 8 as int) + 1, 1)), 16, 10) as bigint), cast(_bit % 8 as int)) = 1")
    return looked.join(F.broadcast(maps), "_piece").where(is_set).select(*rows.columns)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, part: int = 0, max_train: int | None = None) -> Network:
    """A network for all labelled texts outside the held-out part; max_train: for that many of them only, those with the smallest hashes.

    A fifth of them sets the thresholds only. Of several labels for a doc_id the largest counts; a doc_id of any type
    may have several texts, which are one row each, repeats once. Null labels and ids are none, null texts are empty.
    Without any labelled rows every score is that of an empty text.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where(F.col("_y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("_y").alias("_y")).where(~held_out(F.col("doc_id"), parts, part))
    asked = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    texts = maybe_among(asked, known, "doc_id").withColumn("_h", F.xxhash64("text"))
    if max_train is not None:
        some = texts.select("doc_id", "_h").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id", "_h"), "doc_id", "_h").limit(max_train)
        texts = texts.join(some.select("doc_id", "_h"), ["doc_id", "_h"], "left_semi")
    size = texts.select("doc_id", "_h", F.octet_length("text").alias("_n")).join(known, "doc_id").agg(F.sum("_n")).first()[0] or 0
    dealt = math.ceil(max(size, 1) / SHARE)
    # Texts and labels are shuffled once, together, as a join may choose its own number of partitions.
    both = texts.withColumn("_y", F.lit(None).cast("int")).unionByName(known, allowMissingColumns=True).repartition(dealt, "doc_id")
    own = both.withColumn("_y", F.max("_y").over(Window.partitionBy("doc_id"))).where(F.col("_h").isNotNull() & F.col("_y").isNotNull()).dropDuplicates(["doc_id", "_h"])
    rows = own.select("text", "_y", (F.crc32(F.concat(F.lit("v"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0).alias("unseen"), F.spark_partition_id().alias("part"), F.xxhash64("doc_id", "_h").alias("_o"), "doc_id", "_h")
    stored = code(rows.sortWithinPartitions("_o", "doc_id", "_h").select("text", "_y", "unseen", "part"))
    many = stored.where("not unseen").agg(F.sum("n"), F.sum("n1")).first()
    n1 = many[1] or 0
    n0 = (many[0] or 0) - n1
    common, counts, toxic = counted(stored)
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((counts - toxic + 0.5) / (n0 + 1))
    net = Network(common.tolist(), np.clip(np.r_[0.0, odds], -3, 6) / 3)
    if n0 and n1:
        for epoch in range(EPOCHS):
            train_round(stored, net, epoch)
        set_thresholds(stored, net)
    give_back()
    return net


def threshold(x: np.ndarray, t: np.ndarray) -> float:
    """The threshold for rows with logits x and labels t."""
    reached, of = np.searchsorted(CUTS, x, "right"), np.zeros((2, len(CUTS) + 1), np.int64)
    np.add.at(of, ((t > 0).astype(int), reached), 1)
    return best_cut(of)


def best_cut(of: np.ndarray) -> float:
    """The logit that splits unseen rows, counted by label and number of cuts reached, with fewest errors, half an error against each unit away from 0; 0 with few rows."""
    if of.sum() < 30 or not of.sum(1).all():
        return 0.0
    errors = of[0, ::-1].cumsum()[::-1][1:] + of[1].cumsum()[:-1] + 0.5 * np.abs(CUTS)
    best = CUTS[errors == errors.min()]
    return float(best[np.abs(best - np.median(best)).argmin()])


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with score double, predicted int and language string (as told from the text; empty: unknown).

    Null and empty texts get the score of a text without words. The other columns stay; clashing names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted", "language")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("language", T.StringType())])
    sent = send(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = received(sent).scorer()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                p, lang = scorer.score(batch.column(text).to_pylist())
                columns = [batch.column(c) for c in kept] + [pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([LANGUAGES[g] for g in lang], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted", "language"])
        del scorer
        give_back()

    return docs.mapInArrow(run, schema)
