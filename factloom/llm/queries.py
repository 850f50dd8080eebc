"""The registered queries of this subpackage, each the thin digest of one operator, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import ann, bpe, codebooks, linededup, lm, mixture, pii, resampling, simhash, toxicity, vafile, warc, winnowing
from factloom.session import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_entities", "text", F.to_json("surrogates").alias("surrogates"))


def op2_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "language")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), parts=7, part=2)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vafile.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.by_position(mixture.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), columns=["doc_id"]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", (F.round("first_position", 6) + F.lit(0.0)).alias("first_position"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return codebooks.label_errors(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_vector_graph, op3_bpe_roundtrip, op4_toxicity, op5_line_dedup, op6_simhash, op7_warc, op8_pitman_yor_lm, op9_exact_topk, op10_source_mixture, op11_winnowing, op12_vector_codes, op13_importance_resampling)}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A SHA-1 in hexadecimal to base 32: its 160 bits, five at a time.
_SHA1_BASE32 = f"array_to_string(list_transform(range(0, 160, 5), lambda i: substr('{_BASE32}', 1 + (substr(bits, i + 1, 5)::BIT)::VARCHAR::BIT::INTEGER, 1)), '')"

#: Words as operators 11 and 13 take them.
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _lloyd(rounds: int = 6) -> str:
    """SQL of operator 12: assignments and new codebooks of all rounds, one after the other."""
    assigned = lambda i: f"""a{i} AS MATERIALIZED (
        SELECT v.vec_id, v.part, v.q, arg_min(b.entry, struct_pack(d := list_sum(list_transform(list_zip(v.q, b.c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, e := b.entry)) AS entry,
            min(list_sum(list_transform(list_zip(v.q, b.c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT) AS d
        FROM p v JOIN b{i} b USING (part) GROUP BY ALL)"""  # noqa: E731
    moved = lambda i: f"""b{i + 1} AS MATERIALIZED (
        WITH s AS (SELECT part, entry, pos, sum(x)::BIGINT AS x, count(*) AS n FROM (SELECT part, entry, unnest(q) AS x, unnest(range(len(q))) AS pos FROM a{i}) GROUP BY ALL),
        m AS (SELECT part, entry, list((x - ((x % n) + n) % n) // n ORDER BY pos) AS c FROM s GROUP BY ALL)
        SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m ON m.part = b.part AND m.entry = b.entry)"""  # noqa: E731
    return f"""
        WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // 8) + 1 : (part + 1) * (len(q) // 8)] AS q FROM v, unnest(range(8)) AS u(part)),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 16),
        b0 AS MATERIALIZED (SELECT part, entry, q AS c FROM p JOIN f USING (vec_id)),
        {"".join(assigned(i) + "," + moved(i) + "," for i in range(rounds))} {assigned(rounds)},
        r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h"""


ORACLES = {
    "op11_winnowing": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        k AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS t
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(10, len(w)) AS n FROM i WHERE len(w) > 0))),
        x AS (SELECT DISTINCT n FROM k),
        o AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, x WHERE len(w) >= n)),
        m AS (SELECT DISTINCT doc_id, n, s, t FROM o SEMI JOIN k USING (n, t)),
        h AS (SELECT doc_id, count(DISTINCT u) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS u FROM m) GROUP BY doc_id),
        g AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m JOIN k USING (n, t) GROUP BY doc_id)
        SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "op12_vector_codes": _lloyd(),
    # a CRC-32 by its bits: each byte joins the register, which is then shifted eight times
    "op13_importance_resampling": f"""
        WITH w AS (SELECT doc_id, 0 AS side, {_WORDS} AS w FROM documents UNION ALL SELECT item_id, 1, {_WORDS} FROM benchmark),
        x AS (SELECT doc_id, side, array_to_string(w[s : s + n - 1], ' ') AS f FROM (SELECT doc_id, side, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, unnest([1, 2, 3]) AS u(n) WHERE len(w) >= n)),
        c AS (SELECT doc_id, side, f, count(*) AS n FROM x GROUP BY ALL),
        b AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 8 * strlen(f)), lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(hex(f), (i // 4 + 1)::INT, 2))::BIGINT ELSE 0 END)),
            lambda r, y: xor(xor(r, y) >> 1, (xor(r, y) & 1) * 3988292384)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM c)),
        t AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM c JOIN b USING (f) GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM t),
        e AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN b USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
        z AS (SELECT d.doc_id, coalesce(len(d.w), 0) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w d LEFT JOIN e USING (doc_id) WHERE d.side = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place, count(*) FILTER (enough) OVER () AS n FROM z)
        SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 5 * n // 100 THEN place END AS rank FROM r""",
    "op7_warc": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, payload_bytes, {_SHA1_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h)""",
    "op9_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op5_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, u.i AS pos, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'i': i})) AS u FROM documents)),
        f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key),
        k AS (SELECT l.*, f.first IS NOT NULL AND l.doc_id > f.first AS dropped FROM l LEFT JOIN f USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM k GROUP BY doc_id""",
    "op10_source_mixture": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS o FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 AS i FROM s),
        x AS (SELECT *, (i + 1)::DOUBLE AS weight, [0.5, 1.0, 1.5][i + 1]::DOUBLE AS a, [1.5, 1.0, 0.5][i + 1]::DOUBLE AS b, 3.0::DOUBLE * source_size AS lim FROM w),
        y AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM x),
        t AS (SELECT *, least(max(level) OVER () * weight, lim) AS target FROM y),
        c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.b,
            coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
            CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS rounds
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, (rounds * size + greatest(0, least(size, floor(target - rounds * source_size)::BIGINT - before)))::BIGINT AS taken FROM c)
        SELECT doc_id, size, source_size, target, taken, round(CASE WHEN taken > 0 THEN CASE WHEN a = b THEN before / target
            ELSE (sqrt(a * a + 2 * (b - a) * (before / target * (a + b) / 2)) - a) / (b - a) END END, 6) + 0.0 AS first_position FROM e""",
}
