"""Every stage of the corpus pipeline on odd rows and against what its operator decides."""

import random

import corpus_pipeline as cp
from factloom.llm import linededup, mixture, queries, simhash
from tests.llm.test_native import DOC, brute_lines, odd_docs


def test_stages_run_on_odd_rows(spark, data):
    docs = odd_docs(spark)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, data)
        assert out.count() > 0, name
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert stage(spark, spark.createDataFrame([], DOC), data).count() == 0, name


def test_line_stage_keeps_the_rest(spark, data):
    out = cp.drop_repeated_lines(spark, odd_docs(spark), data).collect()
    assert sorted(((r.doc_id, r.text or "") for r in out), key=repr) == sorted(((d, t) for d, _, _, t in brute_lines(odd_docs(spark).collect())), key=repr)
    assert all(r.n_chars == len(r.text) for r in out if r.doc_id in (2, 8))


def test_near_duplicate_stage_keeps_one_of_each(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, **cp.NEAR).collect()}
    kept = [r.doc_id for r in cp.one_of_near_duplicates(spark, docs, data).collect()]
    assert sorted(kept) == sorted(set(component.values()))


def edited(rng, words, similarity):
    """A copy with words replaced until its five-word shingles have about this similarity."""
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    copy, own = list(words), shingles(words)
    while len(own & shingles(copy)) / len(own | shingles(copy)) > similarity + 0.01:
        copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**9)}"
    return copy


def test_near_copies_go_and_others_stay(spark, data):
    """Copies at three similarities, and texts that share a third of their words in order."""
    rng = random.Random(5)
    rows, pairs, plain = [], [], []
    for n, similarity in enumerate([0.85] * 60 + [0.9] * 60 + [0.95] * 60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(250, 500))]
        rows += [(2 * n, " ".join(words), "en", "a", 1), (2 * n + 1, " ".join(edited(rng, words, similarity)), "en", "a", 1)]
        pairs.append((similarity, 2 * n + 1))
    shared = " ".join(f"s{i}" for i in range(150))
    for n in range(1000, 1080):
        rows.append((n, shared + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(300)), "en", "a", 1))
        plain.append(n)
    kept = {r.doc_id for r in cp.one_of_near_duplicates(spark, spark.createDataFrame(rows, DOC), data).collect()}
    assert set(range(0, 360, 2)) | set(plain) <= kept
    found = {s: sum(i not in kept for t, i in pairs if t == s) / 60 for s in (0.85, 0.9, 0.95)}
    assert found[0.85] > 0.6 and found[0.9] > 0.85 and found[0.95] > 0.95, found


def test_rows_of_one_id_that_are_no_copies(spark, data):
    rows = [(1, "one two three four five six", "en", "a", 1), (5, "one two three four five six", "en", "a", 1), (5, "quite another text with other words in it", "en", "a", 1), (5, "quite another text with other words in it", "en", "a", 1), (None, "x", "en", "a", 1), (None, "x", "en", "a", 1)]
    out = cp.one_of_near_duplicates(spark, spark.createDataFrame(rows, DOC), data).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([(1, rows[0][1]), (5, rows[2][1]), (None, "x")], key=repr)


def test_unlike_texts_of_one_id_all_stay(spark, data):
    """Several texts under a null or repeated doc_id, one of which repeats a text of a smaller doc_id."""
    texts = [" ".join(f"{w}{i}" for i in range(12)) for w in ("ant", "bee", "cat", "dog", "elk")]
    rows = [(1, texts[0], "en", "a", 1), *((None, t, "en", "a", 1) for t in texts[:3]), *((7, t, "en", "a", 1) for t in (texts[0], *texts[3:]))]
    out = cp.one_of_near_duplicates(spark, spark.createDataFrame(rows, DOC), data).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in out)) == sorted([(1, texts[0]), (0, texts[1]), (0, texts[2]), (7, texts[3]), (7, texts[4])])


def test_mixture_stage_is_sorted_and_near_its_targets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mixed = mixture.mix(docs).collect()
    out = cp.mix_sources(spark, docs, data).collect()
    size = {r.doc_id: r.size for r in mixed}
    for source in {r.source for r in mixed}:
        own = next(r for r in mixed if r.source == source)
        got = sum(size[r.doc_id] for r in out if r.source == source)
        assert abs(got - own.target) <= max(r.size for r in mixed if r.source == source)
    copies = {}
    for r in out:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3


def test_run_equals_its_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame((x := stage(spark, docs, data)).collect(), x.schema)
    key = lambda r: (r.doc_id, r.n_tokens, bytes(r.ids))
    assert sorted(map(key, cp.run(spark, data).collect())) == sorted(map(key, docs.collect()))


def test_toxic_go_and_clean_stay(spark, data):
    sf = data.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in cp.reject_toxic(spark, docs, sf).select("doc_id").collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id is not None]
    clean, toxic = [r.doc_id in kept for r in labels if r.toxic == 0], [r.doc_id not in kept for r in labels if r.toxic == 1]
    assert sum(clean) / len(clean) > 0.98 and sum(toxic) / len(toxic) > 0.85


def test_tokens_hash(spark, data):
    digest = queries.op3_bpe_roundtrip(spark, data).first()
    assert len(digest.ids_sha256) == len(digest.decoded_sha256) == 64 and linededup.LAST == (1 << 63) - 1
