"""Byte-pair encoding and decoding by a pair occurrence index.

A batch's new words are laid out as one row of symbols. An index maps each
adjacent pair that has a rank to all its positions. Ranks are taken in
ascending order (a heap holds the active ones); a rank is applied to all its
positions at once, and the pairs to the left and right of each merge enter the
lists of their own ranks. As the smallest rank of all words is also the
smallest of every word that has it, each word sees its merges in the usual order.

The vocabulary file is read on the driver from the path given, and sent to the
tasks (its size is that of the file).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from factloom.llm.common import give_back, received, send

#: The tokenizer's white space, word pattern and end-of-word mark.
SPACES = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
END = "</w>"
ASCII_WORDS = re.compile(CONTRACTIONS + r"|[a-z]+|[0-9]|[^a-z0-9\t-\r ]+")
#: Words kept for reuse inside a task, and rows of a returned batch. Both bound memory only.
MEMO, ROWS_OUT = 300_000, 256
NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next letter from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Codec:
    """A vocabulary with its ranked pairs; encodes whole texts and decodes ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.left, self.right = left, right
        self.made = np.array([vocab["".join(p)] for p in pairs], np.int32)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.final = np.array([vocab[x + END] for x in letters], np.int32)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # Letters and digits that the regex module knows and the library's Unicode tables do not have yet.
        new = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))) if unicodedata.category(c) == "Cn"]
        known = pre_tokenizers.Split(Regex(r"\p{L}|\p{N}"), "isolated")
        self.later = frozenset(c for c in new if len(known.pre_tokenize_str(c + "!")) == 1)
        self.words = regex.compile(CONTRACTIONS + rf"|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
        late = regex.escape("".join(sorted(self.later))) or "\0"
        self.words_without_later = regex.compile(rf"(?V1){CONTRACTIONS}|[\p{{L}}--[{late}]]+|[\p{{N}}--[{late}]]|[[^{SPACES}\p{{L}}\p{{N}}]||[{late}]]+")
        names = {i: x for x, i in vocab.items()} | {i: x for x, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NO_RANK)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none empty) in a row, and where each word's begin and the last ends, by one pair occurrence index over all of them."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        n = len(flat)
        sym = self.inner[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends[:-1]] = -1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Adds the pairs that begin at these positions to the lists of their ranks."""
            if not len(at):
                return
            rank = self.ranks(sym[at], sym[after[at]])
            known = rank != NO_RANK
            at, rank = at[known], rank[known]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, group in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if r in places:
                    places[r].append(group)
                else:
                    places[r] = [group]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = places.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.left[r], self.right[r], self.made[r]
            nxt = after[at]
            ok = (sym[at] == a) & (nxt >= 0)
            ok[ok] = sym[nxt[ok]] == b
            at = at[ok]
            if a == b and len(at) > 1:  # of overlapping pairs the leftmost counts
                free, last = [], -1
                for p in np.sort(at).tolist():
                    if p != last:
                        free.append(p)
                        last = after[p]
                    else:
                        last = -1
                at = np.array(free, np.int64)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at] = new
            sym[gone] = -1
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            behind = before[at]
            enter(np.unique(np.concatenate([behind[behind >= 0], at[after[at] >= 0]])))
        live = sym >= 0
        return sym[live].astype("<u4"), np.r_[0, np.cumsum(live)[ends - 1]]

    def pieces(self, chunk: str) -> list[str]:
        """Words and special tokens of a stretch without white space."""
        out: list[str] = []
        for part in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", chunk) if "<|" in chunk else [chunk]:
            if part in self.special:
                out.append(part)
            elif part.isascii():
                out += ASCII_WORDS.findall(part.lower())
            elif part:
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += (self.words if self.later.isdisjoint(low) else self.words_without_later).findall(low)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


class Encoder:
    """Encodes documents, remembering the ids of the stretches seen so far."""

    def __init__(self, codec: Codec):
        self.codec, self.ids = codec, {}

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > MEMO:
            self.ids = {}
            new = list(chunks)
        for at in range(0, len(new), MEMO // 2):
            some = new[at : at + MEMO // 2]
            split = [[c] if c.isascii() and c.isalpha() and c.islower() else self.codec.pieces(c) for c in some]
            ids = {x: np.array([i], "<u4").tobytes() for x, i in self.codec.special.items()}
            words = list({p for ps in split for p in ps} - ids.keys())
            flat, cuts = self.codec.encode_words([w.encode("utf-8") for w in words])
            packed, cuts = flat.tobytes(), cuts.tolist()
            for w, a, b in zip(words, cuts, cuts[1:], strict=False):
                ids[w] = packed[4 * a : 4 * b]
            for c, ps in zip(some, split, strict=True):
                self.ids[c] = ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps])

    def batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Ids (little-endian, 32 bits each) and decoded text of each document."""
        split = [_stretches(x or "") for x in texts]
        self.learn(set().union(*split))
        for chunks in split:
            ids = b"".join(map(self.ids.__getitem__, chunks))
            yield ids, self.codec.decode(np.frombuffer(ids, "<u4").tolist())


def _stretches(text: str) -> list[str]:
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, but not to the tokenizer
        return [x for x in regex.split(f"[{SPACES}]+", text) if x]
    return text.split()


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with ids binary (little-endian unsigned 32 bits each), n_tokens long and decoded string.

    Every whole text is encoded without adding special tokens; special tokens written in a text are
    recognised. A null or empty text has no ids. Long texts are encoded whole, equal rows each for itself, and an
    empty table gives an empty table. The other columns stay; clashing names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    codec = send(docs.sparkSession, Codec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(received(codec))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                found = list(encoder.batch(batch.column(text).to_pylist()))
                ids = [x for x, _ in found]
                columns = [batch.column(c) for c in kept]
                columns += [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([x for _, x in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", "n_tokens", "decoded"])
        del encoder
        give_back()

    return docs.mapInArrow(run, schema)
