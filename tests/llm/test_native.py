"""Surrogates, line dedup and source mixture against brute force, with the odd rows that they must bear."""

import re
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from factloom.llm import linededup, mixture, pii, queries
from tests.helpers import same_as_sql

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns that clash."""
    rows = [
        (1, "a line that repeats\nsecond line of one\n\n", "en", "b", 1), (2, "A line that REPEATS  \nown line of two", "en", None, 2), (2, "A line that REPEATS  \nown line of two", "en", None, 2), (3, None, None, "a", None), (4, "", "de", "c", 0),
        (None, "a line that repeats\nof no id at all", "fr", "a", 5), (None, None, None, None, None), (5, LONG, "es", "a", len(LONG)), (6, "short\nshort\nshort", "en", "é", 3), (7, " only ascii space is stripped\nİ keeps its case", "en", "a", 3), (8, " only ascii space is stripped", "en", "a", 3),
    ]
    return spark.createDataFrame(rows, DOC)


def brute_lines(rows):
    first, out = {}, []
    last = 1 << 63
    split = [(r.doc_id, (r.text or "").split("\n")) for r in rows]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for d, lines in split:
        for x in lines:
            first[key(x)] = min(first.get(key(x), last), last - 1 if d is None else d)
    for d, lines in split:
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (last - 1 if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_lines_brute(spark, partitions):
    docs = odd_docs(spark).withColumn("n_lines", F.lit("clash")).withColumn("kept_text", F.lit(1))
    got = linededup.dedup_lines(docs, partitions=partitions).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_lines(odd_docs(spark).collect())


def test_lines_runs_rebuild_the_text(spark):
    for r in linededup.dedup_lines(odd_docs(spark)).collect():
        lines = (r.text or "").split("\n")
        assert "\n".join(x for run in r.keep_runs for x in lines[run.start : run.start + run.length]) == r.kept_text
        assert r.n_lines == len(lines) == r.n_dropped + sum(run.length for run in r.keep_runs)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString(), df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_by_the_method(spark, data):
    """The text is cut by the runs; the window streams over the ranges without another exchange of the lines."""
    assert "AS runs" in plan(queries.op5_line_dedup(spark, data))[1]
    docs = odd_docs(spark).select("doc_id", "text")
    kept = linededup.written
    try:
        linededup.written = lambda df, name: plans.append(plan(df)[0]) or kept(df, name)
        plans = []
        linededup.duplicate_lines(docs).count()
    finally:
        linededup.written = kept
    assert len(plans) == 1 and "rangepartitioning(h" in plans[0] and "hashpartitioning" not in plans[0]


def test_mixture_by_the_method(spark, data):
    assert "rangepartitioning(first_position" in plan(queries.op10_source_mixture(spark, data))[0]
    at = [r.first_position for r in queries.op10_source_mixture(spark, data).collect()]
    read = [x for x in at if x is not None]
    assert read == sorted(read) and at[len(read) :] == [None] * (len(at) - len(read))


def test_columns_of_any_name_stay(spark):
    own = dict.fromkeys(("_row", "_doc", "_order", "_user", "_new", "weight", "key", "range", "order", "n", "at", "i", "row", "dropped", "a.b"), 5)
    docs = odd_docs(spark).withColumns({c: F.lit(v) for c, v in own.items()})
    mixed = mixture.mix(docs)
    for out in (linededup.dedup_lines(docs), mixed, mixture.training_order(mixed)):
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all(r[c] == v for r in out.collect() for c, v in own.items())


def test_a_line_of_most_documents_over_many_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the very same line\nonly in "), F.col("id").cast("string")).alias("text"))
    got = linededup.dedup_lines(docs, partitions=64).groupBy("n_dropped").count().collect()
    assert {r.n_dropped: r["count"] for r in got} == {0: 1, 1: 2999}


def test_lines_empty(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0


def fill(sizes, weights, most=3.0):
    """Targets by resharing the excess until none is above."""
    total, target, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > most * sizes[i] + 1e-9]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
            free.remove(i)
    return target


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1, 1000, 1, 1, 300], [0, 7, 0], [0, 0], [10], [3, 1, 4, 1, 5, 9, 2, 6]])
def test_targets_brute(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "_source string, source_size long")
    got = {r._source: r.target for r in mixture.targets(df).collect()}
    want = fill(sizes, [mixture.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert all(abs(got[f"s{i}"] - t) < 1e-6 for i, t in enumerate(want))


def test_mixture_odd_rows(spark):
    docs = odd_docs(spark).withColumn("target", F.lit("clash")).withColumn("weight", F.lit(1))
    got = mixture.mix(docs, rows_per_range=1).collect()
    assert len(got) == odd_docs(spark).count()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1 and sum(r.size for r in rows) == rows[0].source_size
    assert mixture.mix(spark.createDataFrame([], DOC)).count() == 0
    assert sorted(map(repr, mixture.mix(docs, rows_per_range=1).collect())) == sorted(map(repr, mixture.mix(docs.repartition(7), rows_per_range=100).collect()))


def test_positions_follow_the_schedule(spark):
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.lit(5)).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    order = mixture.training_order(mixture.mix(docs)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and 0 <= order[0].position and order[-1].position <= 1
    for i, (start, end) in enumerate(mixture.SCHEDULES):
        own = [r.position for r in order if r.source == f"s{i}"]
        early = sum(p < 0.5 for p in own) / len(own)
        assert abs(early - (start * 0.5 + (end - start) * 0.125) / ((start + end) / 2)) < 0.02


def test_queries_equal_their_sql(spark, duck, data):
    for name in ("op5_line_dedup", "op10_source_mixture", "op7_warc", "op9_exact_topk"):
        same_as_sql(queries.QUERIES[name](spark, data), duck, queries.ORACLES[name])


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def test_surrogates(spark):
    rows = [
        (1, "Mrs. Jane Smith <jane.Smith@Example.com>, +1 (482) 555-7163"), (2, "JANE.SMITH@example.com or 482-555-7163; card 4111 1111 1111 1111 = 4111111111111111"), (3, "ssn 123-45-6789 ip 10.2.3.4 key 269b1cea0846965f2d3ecb5cdb87c0aa269b1cea DE89 3704 0044 0532 0130 00"),
        (4, "Г-жа Анна Каренина и Mr John Smith"), (5, None), (None, "x@y.zz"), (6, ""), (7, " ".join(f"{a}{b}@q.co" for a in "abcde" for b in "abcdefghij")), (7, "same id, aa@q.co"), (8, LONG + " last@mail.example.com"), (9, "no private data, 3.14 and 2026-07-01"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_entities", F.lit("clash"))
    out = pii.replace_entities(docs).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    text = lambda i: got[i][0].text
    for old in ("jane", "555-7163", "4111", "123-45", "10.2.3.4", "269b1cea", "3704", "Анна", "Каренина", "last@mail"):
        assert not any(old in (r.text or "").lower() for r in out)
    mail = re.search(r"<([^>]*)>", text(1))[1]
    assert mail.lower() == text(2).split(" ")[0].lower() and re.fullmatch(r"[a-z]{4}\.[A-Z][a-z]{4}@[A-Z][a-z]{6}\.com", mail)
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}$", text(1))[0]
    assert re.sub(r"\D", "", phone)[1:] in re.sub(r"[^\d;]", "", text(2))
    a, b = re.search(r"card ([\d ]{19}) = (\d{16})", text(2)).groups()
    assert a.replace(" ", "") == b and luhn(b) and b[0] == "4"
    name = re.match(r"Mrs\. (\w+) (\w+)", text(1))
    assert name[1] in pii.NAMES["latin f"] and name[2] in pii.NAMES["latin"]
    cyrillic = re.match(r"Г-жа (\w+) (\w+) и Mr (\w+)", text(4))
    assert cyrillic[1] in pii.NAMES["cyrillic f"] and cyrillic[2] in pii.NAMES["cyrillic"] and cyrillic[3] in pii.NAMES["latin m"]
    fifty = next(r for r in got[7] if r.n_entities == 50).text.split(" ")
    assert len(set(fifty)) == 50 and next(r for r in got[7] if r.n_entities == 1).text.split()[-1] == fifty[0]
    assert text(5) is None and text(6) == "" and text(9) == rows[-1][1] and got[9][0].n_entities == 0 and text(8).startswith(LONG)
    assert sorted(map(repr, pii.replace_entities(docs.repartition(5)).collect())) == sorted(map(repr, out))
    assert pii.replace_entities(docs, "other key").where("doc_id = 1").first().text != text(1)
    assert pii.replace_entities(docs.where("false")).count() == 0


def test_many_people_few_names(spark):
    people = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Mr X"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    names = pii.replace_entities(people).select("text").distinct().count()
    assert names == 6000


def replaced(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in pii.replace_entities(docs).orderBy("doc_id").collect()]


def test_people_by_gender_given_and_family_name(spark):
    both, later, bare, short = replaced(spark, "Mr John Smith met Mrs John Smith", "Mr John Smith left. Later Mr Smith and Mrs SMITH came", "John Smith wrote; Mr John Smith signed. John Smithson did not", "Mr Smith and Mrs Jones")
    him, her = re.fullmatch(r"Mr (\w+) (\w+) met Mrs (\w+) (\w+)", both).groups()[::2]
    family = both.split()[2]
    assert him in pii.NAMES["latin m"] and her in pii.NAMES["latin f"] and him != her and both.split()[-1] == family
    assert later == f"Mr {him} {family} left. Later Mr {family} and Mrs {family.upper()} came"
    assert bare == f"{him} {family} wrote; Mr {him} {family} signed. John Smithson did not"
    assert short.split()[1] == family != short.split()[4]


def test_surrogates_keep_the_script(spark):
    samples = {"GREEK": "αλφα@βητα.gr", "HIRAGANA": "やまだ@にほん.jp", "CJK": "山田@日本語.jp", "CYRILLIC": "почта@домен.рф", "HANGUL": "김치@한국어.kr", "ARABIC": "سلام@مرحبا.ae", "LATIN": "abc@defg.org", "HEBREW": "שלום@עולם.il"}
    for (script, old), new in zip(samples.items(), replaced(spark, *samples.values()), strict=True):
        assert old != new and len(old) == len(new)
        for a, b in zip(old.rpartition(".")[0], new.rpartition(".")[0], strict=True):
            assert unicodedata.name(b).startswith(script) if a.isalpha() else a == b
    name = replaced(spark, "Mr Παππάς Ωμέγα")[0]
    assert name != "Mr Παππάς Ωμέγα" and all(unicodedata.name(c).startswith("GREEK CAPITAL" if i == 0 else "GREEK SMALL") for w in name.split()[1:] for i, c in enumerate(w))


def remainder(iban):
    code = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def test_check_digits_and_secrets(spark):
    valid, broken, french, secrets = replaced(spark, "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "FR1420041010050500013M02606", "sk_AbCdEfGhIjKlMnOpQrSt and sk_abcdefghijklmnopqrst")
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", valid) and remainder(valid) == 1 and remainder(french) == 1 and re.fullmatch(r"FR\d{20}[A-Z]\d{7}\w*", french[:22] + french[22:]) is None or len(french) == 27
    assert broken != valid and broken[:2] == "DE"
    a, b = secrets.split(" and ")
    assert a.lower() != b.lower() and re.fullmatch(r"sk_([A-Z][a-z]){10}", a) and re.fullmatch(r"sk_[a-z]{20}", b)


def test_surrogates_beside_columns_of_any_name(spark):
    rows = [(1, "x@y.zz", "d", "r", "f", 7, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _d string, _row string, found string, new int, `a.b` int").withColumn("id", F.lit("own"))
    out = pii.replace_entities(docs)
    assert out.columns == [*docs.columns, "n_entities", "surrogates"]
    assert tuple(out.first())[2:8] == ("d", "r", "f", 7, 9, "own") and out.first().n_entities == 1


def test_a_hot_entity_has_one_surrogate(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("ask all@office.example.com or u"), F.col("id").cast("string"), F.lit("@mail.example.com")).alias("text"))
    words = pii.replace_entities(docs).select(F.split("text", " ").alias("w")).select(F.col("w")[1].alias("hot"), F.col("w")[3].alias("own")).agg(F.count_distinct("hot").alias("hot"), F.count_distinct("own").alias("own")).first()
    assert tuple(words) == (1, 4000)


def test_surrogates_of_a_whole_table(spark, data):
    """Entity for entity: one surrogate each, none shared, none an entity of the table, form and check digits kept."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = {r.doc_id: r for r in pii.replace_entities(docs).collect()}
    pattern, maps, seen = regex.compile(pii.ANY), {}, set()
    plain = lambda kind, x: re.sub(r"\D", "", x)[-10:] if kind == "phone" else re.sub(r"[ \-]", "", x) if kind in ("card", "iban", "ssn") else x if kind == "secret" else x.lower()
    for d in docs.collect():
        old, new = [m.group() for m in pattern.finditer(d.text or "")], out[d.doc_id].surrogates
        rest = [x.surrogate for x in new]
        assert out[d.doc_id].n_entities == len(new) >= len(old)
        if len(old) != len(new):  # a full name again, without its title
            continue
        for a, x, b in zip(old, new, rest, strict=True):
            if x.type == "name":
                continue
            assert maps.setdefault((x.type, plain(x.type, a)), plain(x.type, b)) == plain(x.type, b)
            seen.add((x.type, plain(x.type, a)))
            if x.type == "card":
                assert luhn(re.sub(r"\D", "", a)) <= luhn(re.sub(r"\D", "", b))
            if x.type == "iban":
                assert (remainder(a) == 1) <= (remainder(b) == 1)
            if x.type not in ("ip", "email"):
                assert re.sub(r"\d", "0", re.sub("[a-zA-Z]", "a", a)) == re.sub(r"\d", "0", re.sub("[a-zA-Z]", "a", b)) or x.type == "secret"
    assert len(maps) > 50 and len({(k[0], v) for k, v in maps.items()}) == len(maps)
    assert not {(k[0], v) for k, v in maps.items()} & seen
