"""Winnowing, vector codes and importance resampling against brute force, with the odd rows that they must bear."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import codebooks, common, queries, resampling, winnowing
from tests.helpers import same_as_sql

LONG = "word " * 30_000


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_queries_equal_their_sql(spark, duck, data):
    for name in ("op11_winnowing", "op12_vector_codes", "op13_importance_resampling"):
        same_as_sql(queries.QUERIES[name](spark, data), duck, queries.ORACLES[name])


def brute_hits(docs, items, window):
    out = []
    for d, text in docs:
        w = words(text)
        hit, named = set(), set()
        for i, item in items:
            v = words(item)
            n = min(window, len(v))
            own = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in own:
                    hit.update(range(k, k + n))
                    named.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), sorted(named)))
    return sorted(out, key=repr)


def contaminated(docs, items, window=10):
    got = winnowing.contamination(docs, items, window).collect()
    for r in got:
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, sum(s.length for s in r.spans), r["items"]) for r in got), key=repr)


def test_contamination_of_odd_rows(spark):
    passage = "Alpha bravo, charlie delta echo foxtrot golf hotel india juliet kilo lima"
    docs = [
        (1, f"xx {passage.upper()} yy"), (2, None), (3, ""), (4, "—…!? ,;"), (5, "alpha bravo charlie delta echo foxtrot golf hotel india"), (6, passage.replace(" ", "\n\t-")), (6, passage.replace(" ", "\n\t-")), (None, f"{passage} {passage}"), (None, "nothing at all"),
        (7, "só uma linha curta é curta"), (8, LONG + passage), (9, "Ärger ärger ÄRGER"), (10, "solo"), (11, passage + " kilo lima mike november oscar papa quebec romeo sierra tango"), (12, "x" * 70_000 + " solo"),
    ]
    items = [(100, passage), (20, passage), (3, "uma linha CURTA"), (None, "solo"), (4, None), (5, ""), (6, "Ärger"), (7, "india juliet kilo lima mike november oscar papa quebec romeo sierra"), (7, "tango"), (8, "word " * 12)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "n_words", "spans", "found", "a.b")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    assert contaminated(d, i) == brute_hits(docs, items, 10)
    assert contaminated(d, i, 3) == brute_hits(docs, items, 3)
    assert contaminated(d.where("false"), i) == [] and contaminated(d, i.where("false")) == brute_hits(docs, [], 10)


@pytest.mark.parametrize("seed", range(2))
def test_every_shared_span_is_found(spark, seed):
    """Few different words, so that spans of every length recur by chance."""
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice("abc") for _ in range(n))
    docs, items = [(k, text(draw.randrange(60))) for k in range(60)], [(k, text(draw.randrange(25))) for k in range(40)]
    assert contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 8) == brute_hits(docs, items, 8)


def test_neighbouring_windows_share_fingerprints():
    hashes = np.random.default_rng(0).integers(0, 1 << 32, 10_000).astype(np.uint64)
    prints = winnowing.fingerprints(hashes, 10)
    assert len(prints) == 9991 and len(np.unique(prints)) < 0.35 * 9991


def test_a_passage_of_most_documents_and_items(spark):
    """The join tells the hot fingerprints apart, and each window leaves a document once."""
    passage = " ".join(f"w{i}" for i in range(14))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " of "), F.col("id").cast("string")).alias("text"))
    items = spark.range(300).select(F.col("id").alias("item_id"), F.concat(F.lit("in "), F.lit(passage), F.lit(" x"), F.col("id").cast("string")).alias("text"))
    got = winnowing.contamination(docs, items).select(F.size("items").alias("n"), F.col("spans")[0]["length"].alias("hit")).distinct().collect()
    assert [tuple(r) for r in got] == [(300, 14)]


def brute_lloyd(vectors, rounds, entries, parts, scale):
    rows = sorted(((i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in vectors if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min(range(len(books[p])), key=lambda c: (far(cut(v, p), books[p][c]), c))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in rows:
                own.setdefault(near(p, v), []).append(cut(v, p))
            for c, vs in own.items():
                books[p][c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = []
    for i, v, label in rows:
        code = [near(p, v) for p in range(parts)]
        out.append((i, label, bytes(code), sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code))))
    return sorted(out, key=repr), books


def coded(spark, vectors, **options):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label string").withColumns({c: F.lit(3) for c in ("id", "q", "code", "error", "n")})
    out, books = codebooks.compress(df, **options)
    return sorted(((r.vec_id, r.label, bytes(r.code), r.error) for r in out.collect()), key=repr), books.tolist()


def odd_vectors(n, levels, seed=0):
    """Coarse components, so that distances tie; repeated rows and ids, and vectors that take no part."""
    draw = random.Random(seed)
    rows = [(i // 2 if i % 7 == 0 else i, [draw.randrange(-levels, levels) / 8 for _ in range(16)], draw.choice(["a", "b", None])) for i in range(n)]
    bad = [(1, None, "a"), (0, [], "a"), (2, [float("nan"), *[0.0] * 15], "b"), (3, [float("inf"), *[0.0] * 15], None), (4, [None, *[0.0] * 15], "a")]
    return rows + rows[:20] + [(None, rows[0][1], None)] + bad


@pytest.mark.parametrize("n,levels,entries", [(300, 2, 16), (200, 30, 16), (7, 3, 16), (150, 1, 4)])
def test_codes_equal_plain_lloyd(spark, n, levels, entries):
    rows = odd_vectors(n, levels)
    assert coded(spark, rows, entries=entries, scale=8.0) == brute_lloyd(rows, 6, entries, 8, 8.0)


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    q = (rng.integers(0, 8, (4000, 1)) * 1000 + rng.integers(0, 200, (4000, 8))).astype(np.int64)
    book = q[:8].copy()
    one = codebooks.Books(book[None], None)
    code, upper, lower, _ = one.assign(0, q, None, None, None)
    moved = np.stack([q[code == c].sum(axis=0) // (code == c).sum() for c in range(8)])
    plain = ((q[:, None] - moved[None]) ** 2).sum(axis=2).argmin(axis=1)
    again, upper, lower, measured = codebooks.Books(moved[None], book[None]).assign(0, q, code, upper, lower)
    true = np.sqrt(((q[:, None] - moved[None]) ** 2).sum(axis=2))
    assert (again == plain).all() and measured < 0.5 * 4000 * 8
    assert (lower <= true).all() and (upper >= true[np.arange(4000), again]).all()


def test_codes_of_no_vectors_and_wrong_lengths(spark):
    assert coded(spark, [(1, None, "a"), (2, [], None)]) == ([], [[]] * 8)
    with pytest.raises(ValueError, match="equal parts"):
        coded(spark, [(1, [0.0] * 12, "a")])
    with pytest.raises(Exception, match="differ in length"):
        coded(spark, [(i, [0.0] * 16, "a") for i in range(20)] + [(99, [0.0] * 8, "a")])


def test_label_errors_of_a_hot_label_and_decoding(spark):
    rows = [(i, [float(i % 5), 1.0] * 8, None if i < 2500 else f"l{i % 300}") for i in range(4000)]
    out, books = codebooks.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), rounds=2)
    got = codebooks.label_errors(out).collect()
    sums = Counter()
    for r in got:
        sums[r.label] += r.error
    assert len(got) == 4000 and all(r.label_error == sums[r.label] for r in got)
    back = codebooks.decompress([r.code for r in got[:50]], books)
    assert np.abs(back - np.array([rows[r.vec_id][1] for r in got[:50]])).max() < 1 / 4096


def brute_scores(docs, target, percent, least, seed, buckets=resampling.BUCKETS):
    runs = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in runs(text)) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for k, (d, text) in enumerate(docs):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in runs(text))
        out.append([d, len(words(text)), len(runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), k])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[5]))
    place = {r[5]: i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((tuple([*r[:5], place.get(r[5])]) for r in out), key=repr)


@pytest.mark.parametrize("percent,least", [(5, 20), (40, 3), (100, 0), (0, 0)])
def test_resampling_of_odd_rows(spark, percent, least):
    draw = random.Random(percent)
    vocabulary = ["alpha", "Beta", "é", "x1", "w" * 300, "the", "of"]
    docs = [(draw.choice([k, 7, -k]), " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(40)))) for k in range(200)] + [(None, "the of " * 20), (None, None), (500, None), (501, ""), (502, "!?"), (503, LONG), (504, "y" * 100_000 + " z")]
    docs += docs[:9]
    target = ["alpha beta the", None, "", "of é"]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).withColumns({c: F.lit("clash") for c in ("row", "rank", "score", "_id", "_part", "a.b")})
    got = resampling.resample(d, spark.createDataFrame([(x,) for x in target], "text string"), percent, least).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_scores(docs, target, percent, least, 42)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 9), (2, "d e f " * 9)], "doc_id int, text string")
    assert resampling.resample(docs.where("false"), docs).count() == 0
    assert [r.rank for r in resampling.resample(docs, docs.where("false"), percent=50).orderBy("rank").collect()] == [None, 1]


def test_kth_key(spark):
    draw = random.Random(3)
    keys = [(draw.choice([-5, 0, 7, 1 << 40]), draw.choice([-(1 << 63), -1, 3, (1 << 63) - 1]), i) for i in range(500)]
    rows = spark.createDataFrame(keys, "a long, b long, c long")
    keys.sort()
    for k in (1, 2, 99, 250, 499, 500):
        assert resampling.kth_key(rows, k, ("a", "b", "c")) == keys[k - 1]
    assert resampling.kth_key(rows, 0, ("a",)) is None and resampling.kth_key(rows, 501, ("a",)) is None


def test_crc_of_runs_of_words():
    texts = [b"one two  three-four", None, b"", "é".encode() * 400 + b" a b", b"x"]
    counts, found = resampling.features(texts, resampling.shift_tables())
    assert counts.tolist() == [4, 0, 0, 3, 1]
    for n, (of, crc) in enumerate(found, 1):
        want = [(k, zlib.crc32(b" ".join(w[i : i + n]))) for k, t in enumerate(texts) for w in [common.plain_words(t)] for i in range(len(w) - n + 1)]
        assert list(zip(of.tolist(), crc.tolist(), strict=True)) == want
