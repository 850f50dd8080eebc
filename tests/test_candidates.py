"""The life of a candidate: scenarios, the table form against a fold in order of time, the stream against the table form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.streaming import candidates as c

NOW = dt.datetime(2026, 7, 14, 0, 0, tzinfo=dt.timezone.utc)
NAMES = [x.split()[0] for x in c.EVENT.split(", ")]


def event(identity, key, days=0.0, kind="lead", **more):
    base = {"identity": identity, "observation_key": key, "ts": NOW + dt.timedelta(days=days), "kind": kind, "origin": "aggregator_lead", "company": "Acme", "title": "Engineer", "official_url": None, "priority": "p1", "location_state": "japan", "published_on": dt.date(2026, 7, 1), "authoritative": False}
    if kind == "presence":
        base |= dict.fromkeys(("origin", "company", "title", "priority", "location_state", "published_on"))
    return tuple((base | more)[n] for n in NAMES)


def frame(spark, events):
    return spark.createDataFrame(events, c.EVENT)


def rows(df):
    return {r.identity: r for r in df.collect()}


def at(day):
    return F.lit((NOW + dt.timedelta(days=day)).isoformat()).cast("timestamp")


def test_scenarios(spark):
    utc = lambda days: (NOW + dt.timedelta(days=days)).replace(tzinfo=None)
    events = [
        *[event("replayed", "k", i / 9) for i in range(10)],
        event("twice", "a"), event("twice", "b", 1 / 24), event("twice", "b", 1),
        event("unknown", "a", published_on=None),
        event("old", "a", published_on=dt.date(2025, 1, 1), title="never kept"), event("old", "b", 1, published_on=dt.date(2025, 1, 1)),
        event("future", "a", published_on=dt.date(2026, 8, 1)),
        event("rescued", "a", published_on=None), event("rescued", "b", 6.9), event("late", "a", published_on=None), event("late", "b", 7.0),
        event("presence", "a"), event("presence", "p", 2, "presence", authoritative=True), event("alone", "p", 2, "presence"), event("early", "p", -1, "presence"), event("early", "a"),
        event("silent", "a"), event("silent", "b", 31), event("official", "a", origin="official_collection"), event("official", "b", 31),
        event("merge", "a", company="A", title="Long title", official_url=None, priority="p2", location_state="unknown"), event("merge", "b", 1, company="Acme Inc", title="Short", official_url="u1", priority="p0", location_state="japan", origin="search_index"), event("merge", "c", 2, official_url="u2", location_state="abroad"),
    ]
    got = rows(c.lives(frame(spark, events), at(40)))
    assert (got["replayed"].observation_count, got["replayed"].last_seen_at) == (1, utc(0))
    assert (got["twice"].observation_count, got["twice"].last_seen_at) == (2, utc(1 / 24))
    assert (got["unknown"].state, got["unknown"].reason, got["unknown"].ended_at) == ("tombstoned", c.UNKNOWN, utc(7))
    assert (got["old"].state, got["old"].reason, got["old"].title, got["old"].observation_count, got["old"].last_seen_at, got["old"].ended_at) == ("tombstoned", c.OLD, None, 0, utc(1), utc(0))
    assert (got["future"].state, got["future"].reason) == ("tombstoned", c.FUTURE)
    assert got["rescued"].state == "expired" and got["late"].reason == c.UNKNOWN and got["late"].observation_count == 1
    assert (got["presence"].observation_count, got["presence"].last_authoritative_seen_at) == (2, utc(2)) and "alone" not in got and got["early"].observation_count == 1
    assert (got["silent"].stale_at, got["silent"].state, got["silent"].observation_count) == (utc(30), "expired", 2) and got["official"].state == "admitted"
    m = got["merge"]
    assert (m.company, m.title, m.official_url, m.priority, m.location_state, m.origin) == ("Acme Inc", "Long title", "u1", "p0", "japan", "search_index")
    assert rows(c.lives(frame(spark, events), at(3)))["unknown"].state == "quarantined" and rows(c.lives(frame(spark, events), at(150)))["merge"].state == "expired"
    end = rows(c.lives(frame(spark, events), at(200)))["merge"]
    assert (end.state, end.ended_at) == ("tombstoned", dt.datetime(2027, 1, 1, 15)) and c.lives(frame(spark, []), at(1)).count() == 0


def some_events(seed, n=400, keys=25):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        kind = "presence" if draw.random() < 0.2 else "lead"
        more = {"kind": kind, "authoritative": draw.choice([None, True, False])}
        if kind == "lead":
            more |= {"origin": draw.choice(["aggregator_lead", "search_index", "official_collection", "odd", None] if draw.random() < 0.3 else ["aggregator_lead"]), "company": draw.choice(["A", "Acme", "Acme Inc", None]), "title": draw.choice(["x", "yy", "zz"]), "official_url": draw.choice([None, None, f"u{i}"]),
                     "priority": draw.choice(["p0", "p1", "p2", None]), "location_state": draw.choice(["japan", "abroad", "unknown", None] if draw.random() < 0.2 else ["abroad", "unknown"]), "published_on": draw.choice([None, None, None, dt.date(2026, 7, 1), dt.date(2026, 2, 28) + dt.timedelta(days=draw.randrange(60)), dt.date(2026, 8, 20)])}
        identity = str(draw.randrange(keys)) if draw.random() < 0.7 else "hot"
        out.append(event(identity, f"o{draw.randrange(n // 2)}", round(draw.random() * 90, 3), **more))
    return out + draw.sample(out, n // 4)


def folded(events, until):
    """Every life by stepping through its events."""
    us = lambda t: int(t.timestamp() * 1e6 + 0.5)
    lives, first = {}, {}
    tuples = [(e[0], us(e[2]), int(e[3] == "presence"), e[1], *e[4:10], e[10] and e[10].isoformat(), e[11]) for e in events]
    for t in sorted(tuples, key=lambda t: [(x is not None, x) for x in t]):
        if first.setdefault((t[0], t[3]), t) is not t and first[t[0], t[3]][1:] != t[1:]:
            continue
        if t[1] > us(until) or (t[2] and t[0] not in lives) or getattr(lives.get(t[0]), "done", None) == t:
            continue
        if first[t[0], t[3]] is None:
            continue
        first[t[0], t[3]] = (None,)
        lives[t[0]] = lives.get(t[0], c.Life()).observed(t[1], bool(t[2]), dict(zip(c.FIELDS, t[4:], strict=True)))
    return {k: v.until(us(until)).row(k) for k, v in lives.items()}


def plain(row):
    d = row if isinstance(row, dict) else row.asDict()
    return {k: v.to_pydatetime() if hasattr(v, "to_pydatetime") else v for k, v in d.items()}


@pytest.mark.parametrize("seed", range(3))
def test_tables_equal_a_fold(spark, seed):
    events = some_events(seed)
    for day in (5, 45, 200):
        got = {k: plain(r) for k, r in rows(c.lives(frame(spark, events), at(day))).items()}
        want = {k: plain(r) for k, r in folded(events, NOW + dt.timedelta(days=day)).items()}
        assert got == want


def test_batches_on_stored_candidates_equal_one(spark):
    events = some_events(7)
    whole = rows(c.lives(frame(spark, events), at(120)))
    stored = known = None
    for a, b in ((-1, 20), (20, 41), (41, 120)):
        part = frame(spark, [e for e in events if NOW + dt.timedelta(days=a) < e[2] <= NOW + dt.timedelta(days=b)])
        stored = spark.createDataFrame(c.lives(part, at(b), stored, known).collect(), c.LIFE)
        counted = frame(spark, [e for e in events if e[2] <= NOW + dt.timedelta(days=b)]).select("identity", "observation_key").distinct()
        known = spark.createDataFrame(counted.collect(), counted.schema)
    assert {k: plain(r) for k, r in rows(stored).items()} == {k: plain(r) for k, r in whole.items()}


@pytest.mark.parametrize("with_stored", [False, True])
def test_stream_equals_tables(spark, tmp_path, with_stored):
    """Events come shuffled within the delay and replayed, over many micro-batches."""
    for k, v in c.STATE_STORE.items():
        spark.conf.set(k, v)
    events = some_events(11, 160, 8)
    cut = NOW + dt.timedelta(days=30)
    stored = None
    if with_stored:
        early, events = [e for e in events if e[2] <= cut], [e for e in events if e[2] > cut]
        events = [e for e in events if e[1] not in {x[1] for x in early}]
        table = c.lives(frame(spark, early), F.lit(cut.isoformat()).cast("timestamp"))
        stored = spark.createDataFrame(table.collect(), c.LIFE)
    draw = random.Random(1)
    arrivals = sorted(events, key=lambda e: e[2] + dt.timedelta(days=draw.random() * 9))
    parts = [arrivals[i : i + len(arrivals) // 4 + 1] for i in range(0, len(arrivals), len(arrivals) // 4 + 1)]
    parts += [[event("~", "end", 250)], [event("~", "end2", 250)]]
    folder = tmp_path / "in"
    for i, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.parquet(str(folder / f"{i}"))
    got = {}

    def take(batch, _):
        for r in batch.collect():
            got[r.identity] = r

    schema = frame(spark, []).schema
    for i in range(len(parts)):
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder / f"{{{','.join(map(str, range(i + 1)))}}}"))
        query = c.follow(source, "10 days", stored).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    want = rows(c.lives(frame(spark, [*events, event("~", "end", 250)]), at(240), stored))
    final = {k: plain(r) for k, r in got.items() if k != "~"}
    for k, r in (rows(stored).items() if with_stored else ()):
        final.setdefault(k, plain(r))
    want = {k: plain(r) for k, r in want.items() if k != "~"}
    assert final.keys() == want.keys()
    assert [(k, f, x, want[k][f]) for k, v in final.items() for f, x in v.items() if x != want[k][f]] == []
