"""BPE, toxicity, SimHash, WARC, language model, vector searches: against libraries, brute force or held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import ann, bpe, lm, queries, simhash, toxicity, vafile, warc
from tests.llm.test_native import DOC, LONG, odd_docs

ODD = [
    "", "   ", None, "Hello World's  x1234 — ñ É\n\n<|endoftext|> a<|ENDOFTEXT|>b  日本   İ ǅ á 'S 'LL don't''s \x00 ​  ", "<|startoftext|><|endoftext|>x<|end", "aaaa aaaaa AAAAAAA zzzzzzzzz ababababab ........ !!!! 0000",
    "ΑΣΣ ΣΑΣ a\x1cb\x1d c\x85d\xa0e f　h", "é́ ạ̇ 각 ﷺ ﬁ ① ½ ²x Ⅷ ͅ ̈a ̈", "🧑‍🚀👍🏽 \U0010ffff 'Re'VE'm'd ֌՘", "x" * 5000, LONG,
]


def test_bpe_as_the_library(spark):
    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    pool = [chr(k) for k in [*range(32, 1500), *range(0x300, 0x370), *range(0x1F00, 0x2100), *range(0xAC00, 0xAC40)]]
    texts = ODD + ["".join(rng.choice(pool) * rng.choice([1, 1, 2, 3]) for _ in range(40)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.encode(docs, path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.where("false"), path).count() == 0


def test_bpe_memory_bound_changes_nothing():
    codec = bpe.Codec(queries.tokenizer_path())
    texts = [f"word{i} thntblere{i} {'ab' * (i % 9)}" for i in range(300)]
    free = list(bpe.Encoder(codec).batch(texts))
    kept, bpe.MEMO = bpe.MEMO, 40
    try:
        small = bpe.Encoder(codec)
        assert [x for i in range(0, 300, 10) for x in small.batch(texts[i : i + 10])] == free
    finally:
        bpe.MEMO = kept


def test_toxicity_held_out(spark, data):
    """Accuracy well above that of always saying clean (0.88), recall, precision and area under the curve."""
    sf = data.replace("sf0.001", "sf0.1")
    scored = queries.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert scored and all(r.predicted == (r.score >= 0.5) for r in scored)
    y, p, score = (np.array([r[c] for r in scored], float) for c in ("toxic", "predicted", "score"))
    above = (score[y == 1][:, None] > score[y == 0][None, :]).mean()
    assert (p == y).mean() > 0.97 and p[y == 1].mean() > 0.88 and y[p == 1].mean() > 0.9 and above > 0.97


def test_toxicity_is_a_convolution():
    """The table of filtered words gives what sliding each filter over the summed embeddings gives."""
    rng = np.random.default_rng(6)
    vocabulary = ["alpha", "beta", "gammaray", "delta", "epsilon", "zetazetazeta"]
    known = sorted({h for w in vocabulary[:-1] for h in toxicity.hashes(w)})
    net = toxicity.Network({h: i + 1 for i, h in enumerate(known)}, np.r_[0.0, rng.normal(size=len(known))])
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (0, 1, 2, 3, 7, 40)] * 2
    got, _ = net.scorer().logits(texts)
    for text, logit in zip(texts, got, strict=True):
        h = [sum((net.E[net.rows[x]] for x in toxicity.hashes(w) if x in net.rows), np.zeros(toxicity.DIM)) for w in text.split()]
        h = np.array(h + [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - len(h)))
        pooled = [max(0, max((h[at : at + k] * net.W[k][:, :, f]).sum() + net.b[k][f] for at in range(len(h) - k + 1))) for k in toxicity.WIDTHS for f in range(toxicity.FILTERS)]
        assert abs(np.array(pooled) @ net.v + net.c[0] - logit) < 1e-4


def test_toxicity_threshold_of_a_language():
    y = np.array([0.0, 1.0] * 50)
    assert abs(toxicity.threshold(np.where(y > 0, 1.5, 0.9), y) - 1.2) < 0.35
    assert toxicity.threshold(np.where(y > 0, 1.5, 0.9)[:20], y[:20]) == 0 and toxicity.threshold(np.where(y > 0, 1, -1)[:0], y[:0]) == 0


def test_toxicity_labels_that_repeat_or_differ(spark):
    ids = [f"doc{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, f"text{n} of a {'vile' if n % 2 else 'fine'} kind") for n, i in enumerate(ids)] + [(ids[1], "a vile kind again")] * 500, "doc_id string, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)] + [(i, 0) for i in ids], "doc_id string, toxic int")
    net = toxicity.fit(docs, labels)
    assert net.rows == toxicity.fit(docs.repartition(5), labels.repartition(5)).rows
    p, _ = net.scorer().score(["a vile kind", "a fine kind"])
    assert p[0] > p[1]


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, "you are a vile thing today").otherwise("what a fine day it is").alias("text"))
    net = toxicity.fit(docs, labels)
    got = toxicity.score(odd_docs(spark).withColumn("score", F.lit("clash")), net).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    p, _ = net.scorer().score(["you are a vile thing", "what a fine day", "", None])
    assert p[0] > 0.5 > p[1] and p[2] == p[3]
    none = toxicity.fit(docs, labels.where("false"))
    assert toxicity.score(docs, none).where("score between 0 and 1").count() == 200
    assert toxicity.score(spark.createDataFrame([], DOC), net).count() == 0


def test_toxicity_trains_on_every_row_up_to_its_bound(spark, monkeypatch):
    """About 11,000 labelled rows outside the held-out fifth; a word is known only if three of its six documents are taken."""
    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    docs = spark.range(13_700).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.translate((F.col("id") / 6).cast("long").cast("string"), "0123456789", "bcdefghijk")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert toxicity.fit(docs, labels).rows == toxicity.fit(docs, labels, max_train=1_000_000).rows


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """About 16,400 labelled rows outside the held-out fifth, 13,100 of them for training: each word that three of those hold is known, in any number of parts."""
    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.translate((F.col("id") / 6).cast("long").cast("string"), "0123456789", "bcdefghijk")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    train = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and zlib.crc32(f"v{r.doc_id}".encode()) % 5]
    held = Counter(h for r in train for h in toxicity.hashes(r.text))
    expected = sorted(h for h, n in held.items() if n >= toxicity.MIN_DOCS)
    assert len(train) > 12_000 and sorted(toxicity.fit(docs, labels).rows) == expected
    monkeypatch.setattr(toxicity, "SHARE", 20_000)
    assert sorted(toxicity.fit(docs, labels).rows) == expected


def test_toxicity_parts_train_one_network(spark, monkeypatch):
    """Several parts tell texts apart, and the network depends neither on the order of rows nor on their partitions."""
    rng = np.random.default_rng(3)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    texts = [" ".join([*rng.choice(words, 12), "vile" if i % 3 == 0 else "fine"]) for i in range(1500)]
    docs, labels = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1500)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARE", 30_000)
    net, again = toxicity.fit(docs, labels), toxicity.fit(docs.orderBy(F.rand(1)).repartition(7), labels.repartition(3))
    assert np.array_equal(net.E, again.E) and np.array_equal(net.v, again.v) and net.shift == again.shift
    p, _ = net.scorer().score(texts)
    assert ((p >= 0.5) == (np.arange(1500) % 3 == 0)).mean() > 0.98
    other = toxicity.fit(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), labels)  # ids of two types still meet
    assert np.array_equal(net.known, other.known)


def test_toxicity_slopes():
    """Slopes of the embeddings against differences of the loss, over texts of several lengths."""
    rng = np.random.default_rng(1)
    vocabulary = ["alpha", "beta", "gammaray", "delta", "epsilon", "zetazetazeta", "eta"]
    known = sorted({h for w in vocabulary[:-1] for h in toxicity.hashes(w)})
    net = toxicity.Network(known, np.r_[0.0, rng.normal(size=len(known))])
    net.E[1:] += rng.normal(size=net.E[1:].shape)
    hashed, at, lens, y = toxicity.opened(toxicity.coded([" ".join(rng.choice(vocabulary, n)) for n in (0, 1, 2, 3, 7, 40, 9, 12)], [0, 1, 0, 1, 1, 0, 1, 0], False, 0, {}))
    rows = net.find(hashed)
    rows[0] = 0

    def loss():
        logit = net.logits(rows, at, lens)
        return (np.logaddexp(0, logit) - y * logit).sum()

    some, of_e, _ = net.slopes(rows, at, lens, y)
    assert len(some)
    for i, row in enumerate(some):
        for c in range(toxicity.DIM):
            was, ends = net.E[row, c], []
            for e in (0.01, -0.01):
                net.E[row, c] = was + e
                ends.append(loss())
            net.E[row, c] = was
            assert abs((ends[0] - ends[1]) / 0.02 - of_e[i, c]) < 0.03 * (1 + abs(of_e[i, c]))


def test_toxicity_scores_do_not_depend_on_batches(spark, data):
    net = toxicity.fit(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    whole, _ = net.scorer().score(texts)
    single = np.array([net.scorer().score([t])[0][0] for t in texts[:40]])
    assert np.allclose(whole[:40], single, atol=1e-6)


def brute_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(prints):
    up = list(range(len(prints)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    v = np.array(prints, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 4) + i + 1:
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(v))]


def test_fingerprints(spark):
    texts = ["one two three four five", "One  TWO\tthree\nfour five", "a b", "", None, " \n", "É é É", LONG, "x\x1cy z w v"]
    got = [simhash.fingerprint(t) for t in texts]
    assert got == [brute_print(t) for t in texts] and got[0] == got[1] and got[3] == got[4] == got[5] == 0


@pytest.mark.parametrize(("per_task", "seed"), [(16_384, 1), (20, 2), (7, 3)])
def test_components_of_fingerprints(spark, per_task, seed):
    """Chains, clusters around one fingerprint and lone ones, also with subtrees cut into slices."""
    rng = random.Random(seed)
    prints = {0}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                x ^= 1 << b
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(100)})
    nodes = spark.createDataFrame([(i, [int(np.uint64(p).astype(np.int64))]) for i, p in enumerate(prints)], "node long, fps array<long>")
    found = {r.node: r.component for r in simhash.components(simhash.links(nodes, 4, per_task)).collect()}
    want = classes(prints)
    first = {c: min(i for i, d in enumerate(want) if d == c) for c in set(want)}
    assert [found.get(i, i) for i in range(len(prints))] == [first[c] for c in want]


def test_near_duplicates_odd_rows(spark):
    rows = simhash.near_duplicates(odd_docs(spark).withColumn("fp", F.lit("clash"))).collect()
    assert len(rows) == 11
    want = classes([int(np.int64(r.fp).astype(np.uint64)) for r in rows])
    last = (1 << 63) - 1
    ids = [last if r.doc_id is None else r.doc_id for r in rows]
    assert [r.component_id for r in rows] == [min(i for i, d in zip(ids, want, strict=True) if d == c) for c in want]
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_warc_odd_pages(spark, tmp_path):
    rows = [(3, "http://a/", "<p>same</p>", 1), (1, None, "<p>same</p>", 2), (2, "http://b/\r\nx", "", 3), (4, "u", None, 4), (None, "n", "<p>same</p>", 5), (5, "v", "é" * 200_000, 6), (6, "w", "WARC/1.1\r\n\r\n\r\n\r\n", 7), (7, "only", "lone \x00 text", 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int")
    made = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=100_000)
    assert made.agg(F.sum("records")).first()[0] == len(rows) and made.count() == len(list((tmp_path / "w").glob("*.warc.zst")))
    got = {r.page_id: r for r in warc.read_archives(made).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 4: ("revisit", 2), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    for i, url, html, _ in rows:
        assert got[i].payload_bytes == len((html or "").encode()) and (got[i].payload is None or bytes(got[i].payload).decode() == (html or ""))
        assert (got[i].url is None) == (url is None)
    small = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages, min_bytes=12)).collect()}
    assert set(small.values()) == {"response"}
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_warc_frames_stand_alone(tmp_path):
    import zstandard
    from pyarrow import fs

    a = warc.Archive(fs.LocalFileSystem(), f"{tmp_path}/a.warc.zst")
    for i in range(300):
        a.add(warc.record(i, f"http://x/{i}", b"<html>hello hello %d</html>" % i, "D", None))
    a.close()
    raw = (tmp_path / "a.warc.zst").read_bytes()
    magic, size = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    assert magic == warc.DICTIONARY_FRAME
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    at, n = 8 + size, 0
    while at < len(raw):
        o = d.decompressobj()
        assert o.decompress(raw[at:]).startswith(b"WARC/1.1\r\n")
        at, n = len(raw) - len(o.unused_data), n + 1
    assert n == 300


def test_lm_counts_and_base(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    rows, c, ends = docs.collect(), Counter(), 0
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            c.update(re.findall(rb"[^\x20\x09-\x0D]+", r.text.encode().lower()))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", r.text.encode().lower())
        g = got[r.doc_id]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n) and abs(g.base_score - base) < 1e-6 * max(1, abs(base))
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and g.score < 0
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def all_pairs(train, n):
    """Every pair of n numbered words, the unseen one among them, with its count in train, as one owner gets them."""
    u, w = np.divmod(np.arange(n * n), n)
    c = np.array([train.get((int(a), int(b)), 0) for a, b in zip(u, w, strict=True)])
    row = {"owner": 0, "block": 0, "u": lm.press(np.diff(u, prepend=0)), "w": lm.press(w), "n": lm.press(c)}
    return lm.Pairs(lm.rows_of(lm.PAIRS, [row]))


@pytest.mark.parametrize("limit", [5, 20, 1000])
def test_lm_is_a_distribution_over_next_words(limit):
    """After any word, seen or not, the probabilities of all words, of the end and of the unseen word add up to 1, also where a context is split."""
    rng = np.random.default_rng(3)
    n, train = 12, Counter()
    for u in [0, 2, 3, 4, 5, 6]:
        for w in rng.choice([0, *range(2, 11)], rng.integers(1, 90)).tolist():
            train[u, w] += 1
    for w in range(2, 11):  # a training word follows some other
        train[0, w] += 1
    p = all_pairs(train, n)
    customers = Counter()
    for (u, _), c in train.items():
        customers[u] += c
    hot = {u: c for u, c in customers.items() if c > limit}
    m = np.bincount(p.word, p.c > 0, n).astype(int)
    most = max([lm.classes_of(c, limit) for c in hot.values()], default=1)
    mass = {r: (int(m[r::most].sum()), int((m[r::most] > 0).sum())) for r in range(most)}
    root = lm.Root(int(m.sum()), int((m > 0).sum()), int((m == 1).sum()), int((m == 2).sum()), mass)
    own = p.owned(0, 1)
    replies = [{"part": 0, "a": lm.press(m[p.w[own]])}]
    # number 11 has no customers at the parent, as no training word has; leave it out of the sums
    here = lm.Contexts(p, root, lm.Seatings(0.6), replies, hot, limit, 1)
    s = here.seating(rng, None)
    for _ in range(3):
        s.sweep()
    q = here.probability(s.t)
    seen = p.w[p.word] != 11
    sums = np.bincount(p.context[seen], q[seen], n)
    assert np.allclose(sums, 1) and (q[seen] > 0).all() and (most > 1) == (limit < 100)


def stirling(n, d):
    """Logarithms of the generalised Stirling numbers of n customers at 1 to n tables."""
    s = np.array([0.0])
    for i in range(1, n):
        with np.errstate(divide="ignore"):
            s = np.logaddexp(np.r_[-np.inf, s], np.log(np.maximum(i - d * np.arange(1, i + 2), 0)) + np.r_[s, -np.inf])
    return s


def test_seating_has_the_posterior_of_brute_force():
    """Mean tables of three dishes of one restaurant, against the sum over all seatings."""
    d, theta, n, above = 0.6, 1.5, [4, 3, 2], [0.3, 0.05, 0.6]
    weight = {}
    for t in [(a, b, c) for a in range(1, 5) for b in range(1, 4) for c in range(1, 3)]:
        rising = np.prod([theta + d * i for i in range(sum(t))])
        weight[t] = rising * np.prod([np.exp(stirling(k, d)[x - 1]) * g**x for k, x, g in zip(n, t, above, strict=True)])
    want = np.array([sum(w * t[i] for t, w in weight.items()) for i in range(3)]) / sum(weight.values())
    rooms = 4000
    s = lm.Seating(np.repeat(np.arange(rooms), 3), np.tile(n, rooms), np.tile(above, rooms), lm.Seatings(d), theta, np.random.default_rng(1))
    mean = np.zeros(3)
    for turn in range(30):
        s.sweep()
        assert (s.t >= 1).all() and (s.t <= s.n).all()
        if turn >= 10:
            mean += s.t.reshape(rooms, 3).mean(0) / 20
    assert np.allclose(mean, want, rtol=0.02)


@pytest.mark.parametrize(("n", "above", "others"), [(30, 1.0, 0), (3000, 0.3, 0), (3000, 0.02, 0), (3000, 0.05, 2000), (5000, 0.9, 20), (400, 0.4, 300)])
def test_seating_of_many_customers(n, above, others):
    """Also beyond the customers whose seatings are counted exactly; the other tables of the room hold one customer each."""
    d, theta, rooms = 0.7, 1.0, 200
    dish = np.r_[np.full(rooms, n), np.ones(rooms * others, np.int64)]
    room = np.r_[np.arange(rooms), np.repeat(np.arange(rooms), others)]
    s = lm.Seating(room, dish, np.full(len(dish), above), lm.Seatings(d), theta, np.random.default_rng(2))
    mean = []
    for _ in range(60):
        s.sweep()
        mean.append(s.t[:rooms].mean())
    t = np.arange(1, n + 1)
    log = stirling(n, d) + t * np.log(above) + np.cumsum(np.log(theta + d * (others + t - 1)))
    weight = np.exp(log - log.max())
    want = (weight * t).sum() / weight.sum()
    assert abs(np.mean(mean[20:]) / want - 1) < 0.03 and abs(np.mean(mean[2:8]) / want - 1) < 0.15


def test_lm_of_pairs_seen_once_is_brute_force(spark):
    """Where every pair occurs once there is nothing to sample, and every score has a closed form."""
    train = ["a b c", "b d e f", "c a x", "d b", "e c h", "f f g", "é a"]
    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 7 != 2][: len(train)]
    probe = [i for i in range(500) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = ["a b c", "zz a", "", "x x x", "f e d c b a", "É é"]
    pairs = Counter(p for t in train for p in zip(["", *t.split()], [*t.split(), ""], strict=True))
    followed, eaten = Counter(u for u, _ in pairs.elements()), Counter(w for _, w in pairs)
    once = {p for p, c in pairs.items() if c == 1}
    assert len(once) == len(pairs)
    d, d_root = lm.discount(len(once), 0), lm.discount(*(sum(c == k for c in eaten.values()) for k in (1, 2)))
    m = sum(eaten.values())
    above = lambda w: (eaten[w] - d_root) / (1 + m) if w in eaten else (1 + d_root * len(eaten)) / (1 + m)
    p = lambda u, w: ((1 - d) * ((u, w) in pairs) + (1 + d * followed[u]) * above(w)) / (1 + followed[u])
    docs = spark.createDataFrame([*zip(ids, train, strict=True), *zip(probe, texts, strict=False)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    lower = lambda t: re.sub("[A-Z]", lambda x: x[0].lower(), t).split()
    for i, t in [*zip(ids, train, strict=True), *zip(probe, texts, strict=False)]:
        assert abs(got[i] - sum(math.log10(p(u, w)) for u, w in zip(["", *lower(t)], [*lower(t), ""], strict=True))) < 1e-4


def test_lm_does_not_depend_on_blocks_or_splits(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.score for r in lm.score(docs).collect()}
    again = {r.doc_id: r.score for r in lm.score(docs).collect()}
    assert whole == again
    monkeypatch.setattr(lm, "BLOCK", 3000)
    small = {r.doc_id: r.score for r in lm.score(docs.repartition(5), limit=2000).collect()}
    assert small.keys() == whole.keys() and abs(sum(small.values()) / sum(whole.values()) - 1) < 0.01


def test_lm_odd_rows(spark):
    got = lm.score(odd_docs(spark)).collect()
    assert len(got) == 11 and all(r.n_tokens >= 1 and r.score <= 0 and r.base_score <= 0 for r in got)
    nothing = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    untrained = lm.score(spark.createDataFrame([(i, "a b") for i in nothing], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in untrained] == [(0, 0, 0.0, 0.0)] * 3
    assert lm.score(spark.createDataFrame([], DOC)).count() == 0


VEC = "vec_id long, embedding array<float>, label int"


def odd_vectors(spark, n=300, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, dim)) / 8
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [float("inf")] + [0.0] * (dim - 1), 1), (n + 3, [0.0] * dim, 1), (n + 4, [None] * dim, 1), (n + 5, [], 1), (None, [1.0] * dim, 1), (5, x[5].tolist(), 0)]
    rows += [(1000 + i, x[7].tolist(), 2) for i in range(60)]
    return spark.createDataFrame(rows, VEC).withColumn("rank", F.lit("clash"))


def brute_top(spark_rows, k, step, score, usable):
    table = {r.vec_id: np.array(r.embedding, float) for r in spark_rows if r.vec_id is not None and r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding) and usable(r.embedding)}
    out = {}
    for q in table:
        if q % step == 0:
            ranked = sorted(((-score(table[q], v), i) for i, v in table.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in ranked]
    return out


@pytest.mark.parametrize("per_block", [32_768, 20])
def test_exact_top_k(spark, per_block):
    v = odd_vectors(spark)
    got = {}
    for r in vafile.exact_top_k(v, v.where("vec_id % 10 = 0"), 5, 256.0, per_block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = lambda a, b: int((np.floor(256 * a) * np.floor(256 * b)).sum())
    assert got == brute_top(v.collect(), 5, 10, whole, lambda e: True)
    assert vafile.exact_top_k(v.where("false"), v.where("false")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, q = np.floor(256 * rng.normal(size=(500, 12))), np.floor(256 * rng.normal(size=(20, 12)))
    low, high = vafile.Cells.of(np.arange(500), x).bounds(q)
    assert (low <= q @ x.T).all() and (q @ x.T <= high).all() and (high - low).mean() < 0.5 * np.abs(q @ x.T).mean() * 4


def test_nearest_of_few_is_exact(spark):
    v = odd_vectors(spark)
    got = {}
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_top(v.collect(), 20, 20, lambda a, b: float(a @ b), any)
    assert got.keys() == want.keys()
    assert sum(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True)) / (20 * len(want)) > 0.97
    assert ann.nearest(v.where("false"), v.where("false")).count() == 0


def test_nearest_recall(spark, data):
    v = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = v.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = ann.nearest(v, v.where("vec_id % 20 = 0"), 20).collect()
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hit += len({r.vec_id for r in got if r.query_id == q} & set(ids[np.argsort(-s, kind="stable")[:20]]))
    assert hit / (20 * (ids % 20 == 0).sum()) >= 0.95


def in_shard_recall(x, queries, k=20):
    index = ann.Index.build(np.arange(len(x)), x, k)
    index = ann.Index.unpacked(index.packed())
    hit = 0
    for q, found, _ in index.search(np.arange(len(queries)) + len(x), queries, k):
        hit += len(set(found.tolist()) & set(np.argsort(-(x @ queries[q - len(x)]), kind="stable")[:k].tolist()))
    return hit / (k * len(queries)), index.beam


@pytest.mark.parametrize("kind", ["clustered", "isotropic"])
def test_recall_of_a_full_shard(kind):
    """One graph of 5,000 vectors, where the beam is a small part of the shard: clustered vectors, and ones without any structure."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5000, 64))
    if kind == "clustered":
        x = rng.normal(size=(100, 64))[rng.integers(0, 100, 5000)] + 0.4 * x
        x /= np.linalg.norm(x, axis=1)[:, None]
    recall, beam = in_shard_recall(x.astype(np.float32).astype(float), x[rng.integers(0, 5000, 100)] + 0.1 * rng.normal(size=(100, 64)))
    assert recall >= 0.9 and beam < 5000


def test_index_is_built_once_a_shard(spark):
    """Queries stream past stored indexes: the plan of the search builds none, and its result does not depend on its shuffle."""
    v = odd_vectors(spark, n=2000, dim=8)
    out = ann.nearest(v, v.where("vec_id % 20 = 0"), 5, per_shard=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan and "CoGroups" not in plan
