"""State functions and their streams: replays, shuffled order, breakers, leases, facts, tables."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.operators import combine, entities, facts, ranking, retrieval, tables
from factloom.streaming import state, streams

DAY = dt.datetime(2026, 7, 1)
LEAD = "identity string, observation_key string, observed_at timestamp_ntz, origin_kind string, company string, title string, official_url string, priority string, location_state string"


def leads(n=6):
    origins = list(state.ORIGINS)
    return [(f"i{i % 2}", f"o{i}", DAY + dt.timedelta(hours=i), origins[i % 4], "c" * (i + 1), "t" * (7 - i), f"u{i}" if i > 2 else None, f"p{3 - i % 4}", "japan" if i == 3 else "unknown") for i in range(n)]


def test_ingest_is_idempotent_and_ignores_order(spark):
    none = spark.createDataFrame([], "identity string")
    want = sorted(state.ingest(spark.createDataFrame(leads(), LEAD), none).collect())
    again = leads() * 10
    random.Random(3).shuffle(again)
    late = [(*r[:2], r[2] + dt.timedelta(days=9), *r[3:]) for r in leads()]
    assert sorted(state.ingest(spark.createDataFrame(again + late, LEAD), none).collect()) == want
    first = next(r for r in want if r.identity == "i1")
    assert (first.observation_count, first.origin_kind, first.location_state, first.official_url, first.priority) == (3, "official_single_record", "japan", "u3", "p0")


def test_tombstones_stay_gone(spark):
    gone = spark.createDataFrame([("i0",)], "identity string")
    assert [r.identity for r in state.ingest(spark.createDataFrame(leads(), LEAD), gone).collect()] == ["i1"]
    touched = state.touched_tombstones(spark.createDataFrame(leads(), LEAD), gone.withColumn("last_seen_at", F.lit(DAY).cast("timestamp_ntz"))).first()
    assert touched.last_seen_at == DAY + dt.timedelta(hours=4)


PAGES = "source_id string, run_id string, page_no int, is_last_page boolean, next_cursor string, provider_total long, row_source_id string, stable_key string, error string"


def page(no, last, cursor, total, keys, source="s", error=None):
    return [("s", "r", no, last, cursor, total, source if k else None, k, error) for k in keys or [None]]


@pytest.mark.parametrize(
    ("rows", "previous", "kind", "note"),
    [
        (page(1, False, "2", 3, ["a", "b"]) + page(2, True, None, 3, ["c"]), ["a"], "authoritative", []), (page(1, False, None, 3, ["a", "b", "c"]), [], "partial", ["non_final_page_without_cursor"]),
        (page(1, False, "2", 2, ["a"]) + page(2, True, None, 3, ["b", "c"]), [], "partial", ["provider_total_changed"]), (page(1, True, None, None, ["a"], source="other"), [], "partial", []),
        (page(1, True, None, 0, []), list("abcdefg"), "partial", []), (page(1, True, None, 1, ["a"], error="x"), [], "partial", ["page_failed"]), (page(1, True, None, 5, ["a"]), [], "partial", []),
    ],
)
def test_snapshots(spark, rows, previous, kind, note):
    got = state.finalise_snapshots(spark.createDataFrame(rows, PAGES), spark.createDataFrame([("s", True)], "source_id string, allows boolean"), spark.createDataFrame([("s", k) for k in previous], "source_id string, stable_key string")).first()
    assert (got.kind, got.parse_errors) == (kind, note)


@pytest.mark.parametrize(("previous", "current", "missing", "want"), [(10, 10, 0, []), (5, 0, 5, ["unexpected_zero", "missing_ratio_exceeded"]), (4, 0, 4, ["missing_ratio_exceeded"]), (100, 74, 26, ["missing_absolute_exceeded"]), (100, 75, 25, [])])
def test_breaker(spark, previous, current, missing, want):
    assert spark.range(1).select(state.breaker_reasons(F.lit(previous), F.lit(current), F.lit(missing), state.Breaker()).alias("r")).first().r == want


def fold(snapshots: list[tuple[dt.datetime, bool]], required: int, hours: int):
    s, count, at = "active", 0, None
    for when, present in snapshots:
        if present:
            s, count, at = "active", 0, None
        elif at is None or when - at >= dt.timedelta(hours=hours):
            count, at = count + 1, when
            s = "closed" if count >= required else "suspect"
    return s, count, at


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 30), st.booleans()), min_size=1, max_size=12))
def test_absences_fold_like_a_loop(spark, steps):
    times, at = [(DAY, True)], DAY
    for hours, present in steps:
        at += dt.timedelta(hours=hours)
        times.append((at, present))
    seen = spark.createDataFrame([("s", "k", t) for t, p in times if p] + [("s", "z", t) for t, _ in times], "source_id string, stable_key string, at timestamp_ntz")
    shots = spark.createDataFrame([("s", t) for t, _ in times], "source_id string, at timestamp_ntz")
    got = {r.stable_key: r for r in state.fold_absences(seen, shots, 3, 24).collect()}
    assert (got["k"].state, got["k"].count if isinstance(got["k"].count, int) else got["k"]["count"], got["k"].counted_at) == fold(times[1:], 3, 24)
    assert got["z"].state == "active"


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    times = [DAY + dt.timedelta(hours=13 * i) for i in range(8)]
    rows = [(k, t, (hash_ + i) % 3 == 0) for hash_, k in enumerate("abc") for i, t in enumerate(times)]
    want = {k: fold([(t, p) for k2, t, p in rows if k2 == k], 3, 12) for k in "abc"}
    for i, t in enumerate(times):
        spark.createDataFrame([r for r in rows if r[1] == t], "stable_key string, at timestamp, present boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("stable_key string, at timestamp, present boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = streams.lifecycle(source).writeStream.outputMode("update").format("memory").queryName("life").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {}
    for r in spark.table("life").collect():  # the memory sink keeps the order of its batches
        got[r.stable_key] = (r.state, r.missing_count, r.counted_at)
    assert got == want


def test_metrics_stream_equals_batch(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = streams.daily_metrics(streams.once(streams.events(spark, f"{tmp_path}/events", files_a_trigger=1), "event_id", "40 days"), None)
    q = stream.writeStream.outputMode("update").format("memory").queryName("daily").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    day = F.to_date(F.col("ts") + F.expr("interval 9 hours"))
    want = {(r.day, r.event_type): r.n for r in events.groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    got = {(r.day, r.event_type): r.n for r in spark.table("daily").groupBy("day", "event_type").agg(F.max("n").alias("n")).collect()}
    assert got == want


def test_merge_batches_twice_is_once(spark, tmp_path):
    sink = streams.merge_batches(f"file://{tmp_path}/t", "k", "v")
    (tmp_path / "t").mkdir()
    for batch in ([(1, 1), (2, 1)], [(1, 2)], [(1, 2)]):
        sink(spark.createDataFrame(batch, "k int, v int"), 0)
    assert sorted(tables.current(spark, f"file://{tmp_path}/t").collect()) == [(1, 2), (2, 1)]


def test_claims_share_and_borrow(spark):
    rows = [(lane, i) for lane in "abc" for i in range(8)]
    full = ranking.weighted_claim(spark.createDataFrame(rows, "lane string, id int"), "lane", {"a": 0.5, "b": 0.25, "c": 0.25}, 8, ["id"]).groupBy("lane").count().collect()
    assert {r.lane: r["count"] for r in full} == {"a": 4, "b": 2, "c": 2}
    one = ranking.weighted_claim(spark.createDataFrame([("a", i) for i in range(4)], "lane string, id int"), "lane", {"a": 0.5, "b": 0.25, "c": 0.25}, 8, ["id"])
    assert one.count() == 4


def test_interleave_equals_greedy(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xyz"), rng.randint(1, 9)) for i in range(60)]
    weights = {"x": 50, "y": 30, "z": 20}
    due = ranking.fair_interleave(spark.createDataFrame(rows, "id int, lane string, cost int"), "lane", weights, "cost", ["id"]).collect()
    got = [r.id for r in sorted(due, key=lambda r: (r.due, "xyz".index(r.lane), r.id))]
    assert got == [rows[i][0] for i in ranking.greedy_interleave([(lane, c) for _, lane, c in rows], weights)]


def test_cursor_round_trip():
    assert ranking.decode_cursor(ranking.encode_cursor(at="2026-07-01T00:00:00.123456", id=7)) == {"at": "2026-07-01T00:00:00.123456", "id": 7}
    with pytest.raises(ValueError):
        ranking.decode_cursor("%%%")


def test_leases(spark):
    q = spark.createDataFrame([(1, "queued", DAY, None, 0), (2, "leased", DAY, DAY, 1), (3, "leased", DAY, DAY + dt.timedelta(days=2), 1), (4, "queued", DAY + dt.timedelta(days=3), None, 0)], "id int, state string, available_at timestamp_ntz, lease_until timestamp_ntz, attempt int")
    got = state.claim(q, F.lit(DAY + dt.timedelta(days=1)).cast("timestamp_ntz"), 5, 10, "w").collect()
    assert [(r.id, r.attempt) for r in got] == [(1, 1), (2, 2)]


def test_table_changes(spark):
    old, new = spark.createDataFrame([(1, "a", 5), (2, "b", 7)], "k int, s string, n int"), spark.createDataFrame([(2, None, 3), (3, "c", 1)], "k int, s string, n int")
    assert sorted(tables.insert_if_absent(old, new, ["k"]).collect()) == [(1, "a", 5), (2, "b", 7), (3, "c", 1)]
    assert sorted(tables.patch(old, new, ["k"]).collect()) == [(1, "a", 5), (2, "b", 3)]
    assert sorted(tables.monotone_merge(old, new, ["k"], {"s": "first", "n": "greatest"}).collect()) == [(1, "a", 5), (2, "b", 7), (3, "c", 1)]
    assert {r.k: r.action for r in tables.upsert(old, new, ["k"]).collect()} == {1: "kept", 2: "updated", 3: "inserted"}
    assert [r.rule for r in tables.violations(old, {"small": F.col("n") < 6}).collect()] == ["small"]
    assert sorted(tables.redact(old, spark.createDataFrame([(1,)], "key int"), "k", ["s"]).collect()) == [(1, None, 5), (2, "b", 7)]


def test_supersede(spark):
    rows = spark.createDataFrame([(1, "x", DAY, None)], "k int, v string, active_from timestamp_ntz, active_to timestamp_ntz")
    out = tables.supersede(rows, spark.createDataFrame([(1, "y")], "k int, v string"), ["k"], F.lit(DAY).cast("timestamp_ntz")).orderBy("v").collect()
    assert (out[0].active_to, out[1].active_to) == (DAY + dt.timedelta(microseconds=1), None)


def test_fact_merge(spark):
    f = lambda s, v, r=None: F.struct(F.lit(s).alias("state"), F.array(*map(F.lit, v)).cast("array<string>").alias("values"), F.lit(r).cast("string").alias("unknown_reason"))
    got = spark.range(1).select(
        facts.merge(F.array(f("known", ["a", "b"]), f("known", ["b", "c"]))).alias("union"), facts.merge(F.array(f("known", ["a"]), f("known", ["b"])), exclusive=True).alias("excl"), facts.merge(F.array(f("unknown", [], "not_mentioned"), f("unknown", [], "low_confidence"))).alias("none"),
        facts.merge(F.array(f("conflicting", ["a"]), f("unknown", [], "not_parsed"))).alias("conf"), facts.merge(F.array(f("known", ["a"]), f("known", ["a"])), single=True).alias("same"), facts.is_sound(facts.fact(F.array().cast("array<string>"))).alias("sound")).first()
    assert (got.union.state, got.union["values"]) == ("known", ["a", "b", "c"]) and got.excl.state == "conflicting"
    assert (got.none.state, got.none.unknown_reason) == ("unknown", "low_confidence") and got.conf.state == "conflicting" and got.same.state == "known" and got.sound


def test_entities_chain(spark):
    rows = [(i, f"u{i // 2}", f"p{(i + 1) // 2}" if i % 10 else None) for i in range(30)]
    got = {r.id: r.entity for r in entities.resolve(spark.createDataFrame(rows, "id int, a string, b string"), "id", ["a", "b"]).collect()}
    up = list(range(30))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a, b in rows:
        for j, c, e in rows:
            if a == c or (b and b == e):
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: min(j for j in range(30) if root(j) == root(i)) for i in range(30)}


def test_containment_and_any_key(spark):
    texts = spark.createDataFrame([(1, "we at Acme Robotics build"), (2, "none")], "id int, t string")
    names = spark.createDataFrame([("Acme",), ("Acme Robotics",), ("abc",)], "n string")
    for few in (1000, 0):
        assert [tuple(r) for r in combine.longest_contained(texts, names, "id", "t", "n", few=few).collect()] == [(1, "Acme Robotics")]
    a, b = spark.createDataFrame([(1, "x", None)], "l int, p string, q string"), spark.createDataFrame([(9, "x", None), (8, "y", None)], "r int, p2 string, q2 string")
    assert [tuple(r) for r in combine.any_key_join(a, b, "l", "r", [("q", "q2"), ("p", "p2")]).collect()] == [(1, 9, 2)]


def test_quotes_of_fields_that_were_not_asked_for(spark):
    sections = spark.createDataFrame([(1, "we want python here")], "section_id int, text string")
    rows = [(1, "skills", "want python", "python"), (1, "other", "want python", "python"), (1, "skills", "want java", "java"), (2, "skills", "want python", "python"), (1, "skills", "want python", "rust")]
    got = retrieval.valid_quotes(spark.createDataFrame(rows, "section_id int, field string, quote string, raw_value string"), sections, ["skills"]).collect()
    assert [(r.section_id, r.field, r.quote) for r in got] == [(1, "skills", "want python")]


def test_running_sums_over_ranges(spark):
    """One key holds most rows; every row's prefix is that of one ordered pass."""
    rows = [("hot" if i % 10 else "cold", i, i % 7) for i in range(2000)] + [(None, i, 1) for i in range(5)]
    got = ranking.running_before(spark.createDataFrame(rows, "k string, i int, v int"), "k", "v", ["i"], "before").collect()
    sums = {}
    for k, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        sums[k, i] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    assert len(got) == len(rows) and all(r.before == sums[r.k, r.i] for r in got)
